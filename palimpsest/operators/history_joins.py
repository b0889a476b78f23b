"""As-of bounds, merged histories and comparisons of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def day_bounds(labels: DataFrame, asked: DataFrame) -> DataFrame:
    """Of each asked (page_id, date) the last revision before the day before, before the day, the last kept one on it, and its edits.

    Revisions are reduced to one row a page and day; the asked days are rows among these, and calendar frames do the rest, so no
    day of activity is joined to any question. The greatest (time, id) counts.
    """
    when, day = F.struct("ts", "revision_id"), F.to_date("ts")
    daily = labels.groupBy("page_id", day.alias("day")).agg(F.max(when).alias("last"), F.max(F.when(~F.col("is_reverted"), when)).alias("kept"), F.count(F.lit(1)).alias("n"), F.lit(False).alias("ask"))
    none = F.lit(None).cast(daily.schema["last"].dataType)
    asks = asked.select("page_id", F.col("date").alias("day")).distinct().select("page_id", "day", none.alias("last"), none.alias("kept"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("ask"))
    page = W.partitionBy("page_id").orderBy(F.unix_date("day"))
    until = lambda c, end: F.max(c).over(page.rangeBetween(W.unboundedPreceding, end))["revision_id"]
    today = page.rangeBetween(0, 0)
    out = daily.unionByName(asks).select("page_id", F.col("day").alias("date"), "ask", until("last", -2).alias("start_id"), until("last", -1).alias("prompt_id"), F.max("kept").over(today)["revision_id"].alias("end_id"), F.sum("n").over(today).alias("edits_on_day"))
    return out.filter("ask").drop("ask")


def merged_history(archive: DataFrame, live: DataFrame, until: str, day: str, lookback: int) -> DataFrame:
    """The archive before ``until`` and the live rows before ``day``, of pages with a live row in the ``lookback`` days before."""
    cut = F.lit(day).cast("timestamp_ntz")
    recent = live.filter(F.col("ts") < cut)
    candidates = recent.filter(F.col("ts") >= F.date_sub(F.lit(day).cast("date"), lookback).cast("timestamp_ntz")).select("page_id").distinct()
    both = archive.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz")).unionByName(recent, allowMissingColumns=True)
    return both.join(candidates, "page_id", "left_semi")


def source_differences(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of one source only, and of shared rows how many differ in each field; null equals null."""
    left = a.select(key, F.lit(True).alias("_a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    right = b.select(key, F.lit(True).alias("_b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    both = left.join(right, key, "full")
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    differ = [F.count_if(shared & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f"{f}_differs") for f in fields]
    return both.agg(F.count_if(shared).alias("shared"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), *differ)


def require_days(present: DataFrame, first: str, last: str) -> DataFrame:
    """The days between that ``present`` (day) lacks."""
    days = present.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(present.select("day").distinct(), "day", "left_anti")

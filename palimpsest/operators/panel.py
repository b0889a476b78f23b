"""Samples, splits and panels of page-days."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.firsts import first_rows

KNUTH = 2654435761
SPAN = 4294967296


@dataclass(frozen=True)
class Span:
    start: date
    end: date

    def holds(self, column: str) -> Column:
        return F.col(column).between(F.lit(self.start), F.lit(self.end))


def day_grid(spark, start: date, end: date, stride: int = 1) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.make_dt_interval(F.lit(stride)))).alias("day"))


def time_splits(final: date, test: int, validation: int, train: int, embargo: int) -> dict[str, Span]:
    """Train, validation and test, each followed by a gap; test ends on ``final``."""
    out, end = {}, final
    for name, days in (("test", test), ("validation", validation), ("train", train)):
        start = end - timedelta(days=days - 1)
        out[name] = Span(start, end)
        end = start - timedelta(days=embargo + 1)
    return out


def hash_share(column: Column, factor: int = KNUTH) -> Column:
    """A multiplicative hash between 0 and 2**32, the same in every run; the high bits decide, so it doesn't follow buckets."""
    low = F.pmod(column, F.lit(SPAN))
    upper = F.pmod(F.shiftright(low, 16) * F.lit(factor), F.lit(65536)) * F.lit(65536)  # in two halves, as 64 bits hold the products
    return F.pmod(upper + low.bitwiseAND(F.lit(65535)) * F.lit(factor), F.lit(SPAN))


def sampled(column: Column, rate: float) -> Column:
    return hash_share(column) < F.lit(int(rate * SPAN))


def day_draw(seed: int) -> Column:
    """A draw for each page and day."""
    return hash_share(hash_share(F.col("page_id")) + F.unix_date("day") * F.lit(40503) + F.lit(seed))


def period_draw(every: int, seed: int) -> Column:
    """A day from 0 to ``every`` - 1 for each page and period ``_b``."""
    return F.floor(hash_share(hash_share(F.col("page_id")) + F.col("_b") * F.lit(40503) + F.lit(seed)) * F.lit(every) / F.lit(SPAN))


def panel(daily: DataFrame, last: date, rate: float, final: date, seed: int = 0) -> DataFrame:
    """All page-days with kept edits from the day after a page's first, and a share of the others with a weight to match.

    Of every 1 / rate days of a page one is drawn by a hash, so that only drawn days are ever made.
    """
    every = round(1 / rate)
    firsts = daily.groupBy("page_id").agg(F.min("day").alias("first_day")).filter(F.col("first_day") < F.lit(last))
    number = F.explode(F.sequence(F.lit(0), F.floor((F.datediff(F.lit(last), "first_day") - 1) / every).cast("int"))).alias("_b")
    drawn = firsts.select("page_id", "first_day", number).withColumn("day", F.date_add("first_day", (F.col("_b") * every + 1 + period_draw(every, seed)).cast("int")))
    negatives = drawn.filter(F.col("day") <= F.lit(last)).select("page_id", "day")
    positives = daily.filter("kept_edits > 0").select("page_id", "day", "kept_edits").join(firsts, "page_id").filter((F.col("day") > F.col("first_day")) & (F.col("day") <= F.lit(last))).select("page_id", "day", "kept_edits")
    rest = negatives.join(positives.select("page_id", "day"), ["page_id", "day"], "left_anti").withColumn("kept_edits", F.lit(0).cast("bigint"))
    rows = positives.withColumn("sample_weight", F.lit(1.0)).unionByName(rest.withColumn("sample_weight", F.lit(float(every))))
    return rows.select("page_id", F.col("day").alias("date"), (F.col("kept_edits") > 0).alias("y"), "kept_edits", "sample_weight", (F.col("day") <= F.lit(final)).alias("label_is_final"))


def evaluation_days(firsts: DataFrame, days: list[date]) -> DataFrame:
    """Every page on each of a few days after its first; the days are spelled out in each row."""
    return firsts.select("page_id", "first_day", F.explode(F.array(*[F.lit(d) for d in days])).alias("date")).filter("date > first_day").drop("first_day")


def evaluation_panel(daily: DataFrame, days: list[date]) -> DataFrame:
    """Every page on each of ``days`` after its first, and whether it has kept edits on it: page_id, date, y. Nothing is sampled."""
    firsts = daily.groupBy("page_id").agg(F.min("day").alias("first_day"))
    hits = daily.filter("kept_edits > 0").select("page_id", F.col("day").alias("date"), F.lit(True).alias("y"))
    return evaluation_days(firsts, days).join(hits, ["page_id", "date"], "left").withColumn("y", F.coalesce("y", F.lit(False)))


def edit_bucket(edits: Column) -> Column:
    return F.when(edits < 5, "low").when(edits < 25, "medium").otherwise("high")


def stratified_sample(strata: DataFrame, keys: list[str], per_stratum: int) -> DataFrame:
    """Up to ``per_stratum`` pages of each stratum, in the order of a hash; each task passes on no more than that."""
    return first_rows(strata, keys, [hash_share(F.col("page_id")).asc(), F.col("page_id").asc()], per_stratum, "_i").drop("_i")


def top_and_others(scored: DataFrame, top: int, others: int, seed: int = 0) -> DataFrame:
    """Of each date the ``top`` rows by score, the smaller page_id first on a tie, and ``others`` drawn from the rest."""
    first = first_rows(scored, ["date"], [F.desc("score"), F.col("page_id").asc()], top, "_i").drop("_i")
    rest = scored.join(first.select("date", "page_id"), ["date", "page_id"], "left_anti")
    drawn = first_rows(rest, ["date"], [hash_share(F.col("page_id") + F.lit(seed)).asc(), F.col("page_id").asc()], others, "_i").drop("_i")
    return first.withColumn("selection", F.lit("top")).unionByName(drawn.withColumn("selection", F.lit("random")))

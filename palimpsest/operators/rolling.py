"""Rolling totals over trailing periods, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.revisions import first_delivery

PERIODS = (7, 30)


def rolling_totals(daily: DataFrame, asked: DataFrame, measures: list[str], periods: tuple[int, ...] = PERIODS, averages: bool = False) -> DataFrame:
    """Totals of the days before each asked (entity, day): ``{measure}_{n}d`` for each period of n days, D-n to D-1.

    With ``averages`` also ``avg_{measure}_{n}d``, a day of the period; days without activity count as 0.

    ``daily``: entity bigint, day date and bigint measures; rows of one day are added up, null as 0. ``asked``: entity, day and
    any other columns, which come out again; repeated rows come out repeatedly, rows with a null entity or day with totals of 0.
    The asked entities get one row for each day of the calendar, by exploding it and not by a join; the sums run over a fixed
    number of preceding rows. A window holds one row a day, however many events an entity has.
    """
    names = asked.columns
    span = asked.agg(F.min("day"), F.max("day")).first()
    longest = max(periods)
    zero = F.lit(0).cast("bigint")
    spans = [(m, n) for m in measures for n in periods]
    shown = lambda total: [*[total(i).alias(f"{m}_{n}d") for i, (m, n) in enumerate(spans)], *([(total(i) / F.lit(float(n))).alias(f"avg_{m}_{n}d") for i, (m, n) in enumerate(spans)] if averages else [])]
    if span[0] is None:
        return asked.select("*", *shown(lambda i: zero))
    first, last = F.date_sub(F.lit(span[0]), longest), F.lit(span[1])
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: the calendar multiplies what a small partition holds
    pairs = asked.select("entity", "day").dropna().distinct().repartition(parts, "entity")
    days = F.explode(F.sequence(first, last)).alias("day")
    grid = pairs.select("entity").distinct().select("entity", days, *[zero.alias(m) for m in measures], F.lit(True).alias("_grid"), F.lit(False).alias("_asked"))
    wanted = pairs.select("entity", "day", *[zero.alias(m) for m in measures], F.lit(False).alias("_grid"), F.lit(True).alias("_asked"))
    active = daily.filter(F.col("day").between(first, last) & F.col("entity").isNotNull()).select("entity", "day", *measures, F.lit(False).alias("_grid"), F.lit(False).alias("_asked"))
    rows = active.repartition(parts, "entity").unionByName(grid).unionByName(wanted)
    sums = [F.sum(F.coalesce(F.col(m), zero)).cast("bigint").alias(m) for m in measures]
    dense = rows.groupBy("entity", "day").agg(*sums, F.max("_grid").alias("_grid"), F.max("_asked").alias("_asked")).filter("_grid")
    of = W.partitionBy("entity").orderBy("day")
    totals = {f"{m}_{n}d": F.coalesce(F.sum(m).over(of.rowsBetween(-n, -1)), zero) for m in measures for n in periods}
    rolled = dense.select(F.col("entity").alias("_entity"), F.col("day").alias("_day"), "_asked", *[c.alias(f"_t{i}") for i, c in enumerate(totals.values())]).filter("_asked")
    given = asked.select(*[F.col(f"`{c}`").alias(f"r_{i}") for i, c in enumerate(names)])
    entity, day = (f"r_{names.index(c)}" for c in ("entity", "day"))
    joined = given.join(rolled, (F.col(entity) == F.col("_entity")) & (F.col(day) == F.col("_day")), "left")
    return joined.select(*[F.col(f"r_{i}").alias(c) for i, c in enumerate(names)], *shown(lambda i: F.coalesce(F.col(f"_t{i}"), zero)))


def page_days(revisions: DataFrame, bursts: DataFrame) -> DataFrame:
    """Edits and burst editors of each page and day: entity, day, edits, burst_editors."""
    zero = F.lit(0).cast("bigint")
    log = first_delivery(revisions, ["page_id", "timestamp"]).filter(F.col("page_id").isNotNull())
    edits = log.groupBy(F.col("page_id").alias("entity"), F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("edits")).withColumn("burst_editors", zero)
    editors = bursts.distinct().groupBy(F.col("page_id").alias("entity"), F.col("date").alias("day")).agg(F.coalesce(F.sum("editors"), zero).alias("burst_editors")).withColumn("edits", zero)
    return edits.unionByName(editors)


def trailing_totals(revisions: DataFrame, bursts: DataFrame, asked: DataFrame) -> DataFrame:
    """Totals and averages before each (page_id, date) of ``asked``, days without activity included."""
    days = asked.select(F.col("page_id").alias("entity"), F.col("date").alias("day"))
    return rolling_totals(page_days(revisions, bursts), days, ["edits", "burst_editors"], averages=True)


def wrong_totals(revisions: DataFrame, bursts: DataFrame, published: DataFrame) -> DataFrame:
    """Rows of ``published`` with a null, a wrong total or an average off by more than 0.001: (page_id, day)."""
    given = [f"{m}_{n}d" for m in ("edits", "burst_editors") for n in PERIODS]
    asked = published.select(F.col("page_id").alias("entity"), F.col("date").alias("day"), *[F.col(c).alias(f"given_{c}") for c in (*given, *(f"avg_edits_{n}d" for n in PERIODS))])
    found = rolling_totals(page_days(revisions, bursts), asked, ["edits", "burst_editors"], averages=True)
    right = F.lit(True)
    for c in given:
        right = right & F.col(c).eqNullSafe(F.col(f"given_{c}"))
    for n in PERIODS:
        right = right & F.coalesce(F.abs(F.col(f"given_avg_edits_{n}d") - F.col(f"avg_edits_{n}d")) <= 0.001, F.lit(False))
    return found.filter(~right).select(F.col("entity").alias("page_id"), F.col("day").cast("string").alias("day")).distinct()

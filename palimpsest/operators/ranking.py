"""Rankings of scored rows by day, and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.panel import hash_share
from palimpsest.shared import write_shared

PRECISION_AT = (100, 1000)
RECALL_AT = (1000, 10000)


def positions(df: DataFrame, group: str, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Adds ``rank`` of each row in its group by ``order``, and running sums up to it, with no group in one task.

    Rows are range-partitioned by group and order, so a large group lies in several partitions one after the other. Places and
    sums are counted within a partition and shifted by those of the group's partitions before: one row a group and partition.
    ``order`` has to leave no ties for the result to be the same in every run.
    """
    part = df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    rows = write_shared(part, "positions")
    sums = {"rank": F.lit(1).cast("bigint"), **totals}
    each = rows.groupBy(group, "_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = each.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    local = W.partitionBy(group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = rows.select("*", *[F.sum(c).over(local).alias(n) for n, c in sums.items()])
    joined = placed.join(shifts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def ranked(scored: DataFrame, seed: int = 0) -> DataFrame:
    """``scored`` (date, page_id, score, y) with its rank and the hits up to it on each date; equal scores in the order of a hash."""
    order = [F.desc_nulls_last("score"), hash_share(F.col("page_id") + F.lit(seed)).asc(), F.col("page_id").asc()]
    return positions(scored, "date", order, {"hits": F.col("y").cast("bigint")})


def day_metrics(scored: DataFrame, precision_at: tuple = PRECISION_AT, recall_at: tuple = RECALL_AT, seed: int = 0) -> DataFrame:
    """Of each date precision and recall among the first k and average precision.

    Precision divides by k also where there are fewer rows; recall and average precision are null on a date without positives.
    """
    y = F.col("y").cast("bigint")
    within = lambda k: F.sum(F.when(F.col("rank") <= k, y).otherwise(0))
    positives = F.sum(y)
    out = [F.round(within(k) / F.lit(k), 6).alias(f"precision_{k}") for k in precision_at]
    out += [F.round(F.when(positives > 0, within(k) / positives), 6).alias(f"recall_{k}") for k in recall_at]
    out.append(F.round(F.avg(F.when(F.col("y"), F.col("hits") / F.col("rank"))), 6).alias("average_precision"))
    return ranked(scored, seed).groupBy("date").agg(*out)


def ranking_metrics(rows: DataFrame, rankings: dict[str, list[str]], precision_at: tuple = PRECISION_AT, recall_at: tuple = RECALL_AT, seed: int = 0) -> DataFrame:
    """``day_metrics`` of several rankings of the same ``rows`` (date, page_id, y and the keys), each by its keys, largest first, nulls last.

    All rankings are range-partitioned and sorted in one pass. The measures follow from the places of the positives alone, so that
    of each part of a ranking and date only its number of rows and those places are passed on.
    """
    width = max(map(len, rankings.values()))
    keys = [f"k{i}" for i in range(width)]
    padded = lambda own: [*(F.col(k).cast("double") for k in own), *[F.lit(0.0)] * (width - len(own))]
    each = F.array(*[F.struct(F.lit(i).alias("r"), *[c.alias(k) for k, c in zip(keys, padded(own))]) for i, own in enumerate(rankings.values())])
    long = rows.select("date", "page_id", "y", F.explode(each).alias("b")).select("b.*", "date", "page_id", "y")
    groups, by_score = ["r", "date"], [F.desc_nulls_last(k) for k in keys]
    parts = long.repartitionByRange(*groups, *by_score, hash_share(F.col("page_id") + F.lit(seed)), "page_id").withColumn("hash", hash_share(F.col("page_id") + F.lit(seed)))
    placed = parts.sortWithinPartitions(*groups, *by_score, "hash", "page_id").select(*groups, "y", F.monotonically_increasing_id().alias("at"))  # the task's number << 33, and the row's
    own = placed.groupBy(*groups, F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"), F.sort_array(F.collect_list(F.when(F.col("y"), F.col("at")))).alias("hits"))
    before = W.partitionBy(*groups).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    shifted = own.select(*groups, F.size("hits").alias("h"), "hits", (earlier(F.col("n")) - F.col("start") + 1).alias("shift"), earlier(F.size("hits")).alias("found"))
    ranks = shifted.select(*groups, "h", "found", F.transform("hits", lambda x: x + F.col("shift")).alias("ranks"))
    within = lambda k: F.sum(F.size(F.filter("ranks", lambda x: x <= k)))
    shares = F.aggregate(F.transform("ranks", lambda x, i: (F.col("found") + i + 1) / x), F.lit(0.0), lambda a, x: a + x)
    positives, index = F.sum("h"), F.array(*map(F.lit, rankings))
    out = [F.round(within(k) / F.lit(k), 6).alias(f"precision_{k}") for k in precision_at]
    out += [F.round(F.when(positives > 0, within(k) / positives), 6).alias(f"recall_{k}") for k in recall_at]
    out.append(F.round(F.when(positives > 0, F.sum(shares) / positives), 6).alias("average_precision"))
    return ranks.groupBy(*groups).agg(*out).select(F.element_at(index, F.col("r") + 1).alias("ranking"), "*").drop("r")


def macro_average(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.round(F.avg(c), 6).alias(c) for c in metrics.columns if c != "date"])


def paired_difference(baseline: DataFrame, candidate: DataFrame, metric: str) -> DataFrame:
    """Mean, standard error and numbers of better and worse dates of candidate - baseline, where both are defined."""
    pairs = baseline.select("date", F.col(metric).alias("b")).join(candidate.select("date", F.col(metric).alias("c")), "date")
    d = F.col("c") - F.col("b")
    own = pairs.filter(d.isNotNull())
    return own.agg(F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d) / F.sqrt(F.count(d)), 6).alias("se"), F.count_if(d > 0).alias("days_better"), F.count_if(d < 0).alias("days_worse"), F.count(d).alias("days"))


def lexicographic_rank(rows: DataFrame, keys: list[str], groups: tuple[str, ...] = ("date",)) -> DataFrame:
    """Dense ranks from 0 that order the rows of each group, by default a date, by ``keys``, nulls first; equal keys tie. Adds ``score``.

    The distinct keys of a group are placed over range partitions, so no group is ranked by one task, and joined back.
    """
    tuples = rows.select(F.concat_ws("|", *[F.col(g).cast("string") for g in groups]).alias("_group"), *keys).distinct()
    placed = positions(tuples, "_group", [F.col(k).asc_nulls_first() for k in keys], {}).select("_group", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("rank") - 1).alias("score"))
    same = F.concat_ws("|", *[F.col(g).cast("string") for g in groups]) == F.col("_group")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(placed, same).drop("_group", *[f"_k{i}" for i in range(len(keys))])


BASELINES = {
    "edits_yesterday": ["edits_1d", "edits_30d", "edits_365d"],
    "edits_month": ["edits_30d", "edits_365d"],
    "recency": ["recency", "edits_365d"],
    "edits_year": ["edits_365d"],
    "burst_z": ["burst_z_1d", "edits_1d"],
}


def baseline_scores(features: DataFrame) -> DataFrame:
    """The scores of five simple rankings, one row for each page-day and ranking; all are placed in one pass."""
    rows = features.withColumn("recency", -F.col("days_since_last_edit"))
    width = max(map(len, BASELINES.values()))
    padded = lambda keys: [*(F.col(k).cast("double") for k in keys), *[F.lit(0.0)] * (width - len(keys))]
    each = F.array(*[F.struct(F.lit(name).alias("baseline"), *[c.alias(f"k{i}") for i, c in enumerate(padded(keys))]) for name, keys in BASELINES.items()])
    long = write_shared(rows.select("page_id", "date", F.explode(each).alias("b")).select("page_id", "date", "b.*"), "baselines")
    scored = lexicographic_rank(long, [f"k{i}" for i in range(width)], ("baseline", "date"))
    return scored.select("page_id", "date", "baseline", F.col("score").cast("bigint").alias("score"))

"""Exact per-key selection without gathering a key's values, and work on keys that hold most rows.

Ranks are resolved by radix histograms: in each round every open target keeps a prefix of its value's bits, counts of the
next bits are merged map-side, and the bin that holds the rank becomes the new prefix. After the last round the prefix is
the value. Only counts move; the driver sees one row per target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.revisions import first_delivery
from palimpsest.shared import write_shared

#: Bits that one round of histograms resolves.
BITS = 12
#: Keys with more rows than this are split; on large inputs the bound rises so that no more than MAX_SHARDS shards exist.
SHARD_ROWS = 20_000
MAX_SHARDS = 8_192


def select_ranks(df: DataFrame, key: str, value: str, targets: list[tuple[int, int]], low: int, high: int, bits: int = BITS, weight: str | None = None) -> dict[tuple[int, int], tuple[int, int, int]]:
    """The values at 1-based ``(key, rank)`` targets, among non-null bigint ``value`` between ``low`` and ``high``.

    To each target the value, and the ranks below it and up to it.

    With ``weight``, a non-negative bigint column, ranks count weight instead of rows: the value at which the sum of weights in
    the order of ``value`` reaches the rank. A rank has to lie between 1 and the key's rows or weight. ``targets`` is bounded by the caller (2 * MAX_SHARDS here) and is broadcast with its prefixes each round.
    """
    if not targets:
        return {}
    spark = df.sparkSession
    total = F.sum(weight) if weight else F.count(F.lit(1))
    columns = [key, *([weight] if weight else [])]
    width = 64 if (low < 0) != (high < 0) else (low ^ high).bit_length()
    shift = max(1, min(width, 63))
    state = {t: (low >> shift, 0, 0) for t in targets}
    if shift == 63:  # both signs, or the full width: the sign is the first prefix
        counts = {(r[0], r[1]): r[2] for r in df.groupBy(key, F.shiftright(F.col(value), 63)).agg(total).join(F.broadcast(_frame(spark, [(k,) for k in {k for k, _ in targets}], f"{key} bigint")), key).collect()}
        state = {(k, n): ((-1, 0, 0) if n <= counts.get((k, -1), 0) else (0, counts.get((k, -1), 0), 0)) for k, n in targets}
    while shift > 0:
        step = min(bits, shift)
        shift -= step
        prefixes = F.broadcast(_frame(spark, sorted({(k, p) for (k, _), (p, _, _) in state.items()}), f"{key} bigint, _prefix bigint"))
        cell = F.shiftright(F.col(value), shift)
        counts = df.select(*columns, cell.alias("_cell"), F.shiftright(cell, step).alias("_prefix")).join(prefixes, [key, "_prefix"]).groupBy(key, "_prefix", "_cell").agg(total.alias("_n"))
        up_to = F.sum("_n").over(W.partitionBy(key, "_prefix").orderBy("_cell"))  # at most 2**bits rows of counts each
        bins = counts.withColumn("_to", up_to).withColumn("_from", F.col("_to") - F.col("_n"))
        open_ = F.broadcast(_frame(spark, [(k, n, p, n - below) for (k, n), (p, below, _) in state.items()], f"{key} bigint, _rank bigint, _prefix bigint, _left bigint"))
        hit = bins.join(open_, [key, "_prefix"]).filter((F.col("_from") < F.col("_left")) & (F.col("_left") <= F.col("_to")))
        found = {(r[0], r[1]): r[2:] for r in hit.select(key, "_rank", "_cell", "_from", "_to").collect()}  # one row per target
        state = {t: (found[t][0], below + found[t][1], below + found[t][2]) for t, (_, below, _) in state.items()}
    return state


def _frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _hot(df: DataFrame, key: str, value: str, shard_rows: int, max_shards: int) -> tuple[int, list]:
    """The bound of rows per shard, and (key, rows, min, max) of the keys above it: at most ``max_shards``."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    total = df.count()
    bound = max(shard_rows, math.ceil(total / max_shards))
    return bound, per_key.filter(F.col("n") > bound).collect()


def key_quantiles(df: DataFrame, key: str, value: str, probabilities: list[float], shard_rows: int = SHARD_ROWS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Exact discrete quantiles of a bigint ``value`` for every ``key``: (key, probability, value).

    The quantile at p is the value at rank max(1, ceil(p * n)). Rows with a null key or value are left out; a key without
    values has no row. Repeated values count as often as they occur. Keys of up to ``shard_rows`` rows are ranked in one
    group; larger ones are resolved by ``select_ranks`` and never gathered.
    """
    spark = df.sparkSession
    rows = write_shared(df.select(F.col(key).cast("bigint").alias(key), F.col(value).cast("bigint").alias(value)).dropna(), "quantiles")
    _, hot = _hot(rows, key, value, shard_rows, max_shards)
    rank = lambda n, p: max(1, math.ceil(round(p * n, 9)))
    targets = {(r[0], p): (r[0], rank(r["n"], p)) for r in hot for p in probabilities}
    values = select_ranks(rows, key, value, sorted(set(targets.values())), min((r["lo"] for r in hot), default=0), max((r["hi"] for r in hot), default=0))
    large = _frame(spark, [(k, float(p), values[t][0]) for (k, p), t in targets.items()], f"{key} bigint, probability double, {value} bigint")
    hot_keys = F.broadcast(_frame(spark, [(r[0],) for r in hot], f"{key} bigint"))
    few = rows.join(hot_keys, key, "left_anti")
    group = W.partitionBy(key)
    ranked = few.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_r", F.row_number().over(group.orderBy(value)))
    wanted = ranked.withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    at = F.greatest(F.lit(1), F.ceil(F.round(F.col("probability") * F.col("_n"), 9)))
    return wanted.filter(F.col("_r") == at).select(key, "probability", value).unionByName(large)


def split_hot_keys(df: DataFrame, key: str, value: str, shard_rows: int = SHARD_ROWS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Cut every key of more rows than the bound at exact quantiles of ``value`` (unique within a key).

    Adds ``_shard`` (0 for other keys), ``_hot`` and ``_context``. A cut is the last row of its shard; a copy of it with
    ``_context`` true opens the next shard, so that a shard knows the row before it. ``df`` is read several times.
    """
    spark = df.sparkSession
    bound, hot = _hot(df, key, value, shard_rows, max_shards)
    if not hot:
        return df.withColumns({"_shard": F.lit(0), "_hot": F.lit(False), "_context": F.lit(False)})
    shards = {r[0]: math.ceil(r["n"] / bound) for r in hot}
    ranks = [(r[0], math.ceil(r["n"] * i / shards[r[0]])) for r in hot for i in range(1, shards[r[0]])]
    cuts = select_ranks(df, key, value, ranks, min(r["lo"] for r in hot), max(r["hi"] for r in hot))
    shift, most = 0, 8 * sum(shards.values())
    while sum((r["hi"] >> shift) - (r["lo"] >> shift) + 1 for r in hot) > most:
        shift += 1
    by_key: dict[int, list[int]] = {}
    for (k, _), (v, _, _) in cuts.items():
        by_key.setdefault(k, []).append(v)
    cells = []  # of each hot key the cells of equal width with the cuts below and in them: a bounded table, found by equality
    for r in hot:
        own = sorted(by_key.get(r[0], []))
        at = 0
        for cell in range(r["lo"] >> shift, (r["hi"] >> shift) + 1):
            begin = at
            while at < len(own) and own[at] >> shift == cell:
                at += 1
            cells.append((r[0], cell, begin, own[begin:at]))
    lookup = F.broadcast(_frame(spark, cells, "_k bigint, _cell bigint, _base int, _cuts array<bigint>"))
    found = df.join(lookup, (F.col(key) == F.col("_k")) & (F.shiftright(F.col(value), shift) == F.col("_cell")), "left")
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    shard = F.when(F.col("_k").isNull(), 0).otherwise(F.col("_base") + below)
    copies = F.when(F.array_contains("_cuts", F.col(value)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    cut = found.withColumns({"_shard": shard, "_hot": F.col("_k").isNotNull()}).withColumn("_copy", F.explode(copies))
    return cut.withColumns({"_shard": F.col("_shard") + F.col("_copy"), "_context": F.col("_copy") == 1}).drop("_k", "_cell", "_base", "_cuts", "_copy")


def restored_contents(revisions: DataFrame, shard_rows: int = SHARD_ROWS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Revisions that bring back an earlier content of their page: (page_id, revision_id).

    In the order of ``revision_id`` a revision with a non-null ``sha1`` is one whose nearest earlier revision of the same page
    with the same ``sha1`` isn't the one directly before; revisions without ``sha1`` keep their position. Revisions without
    ``page_id`` belong to no page. Large pages are cut into shards of equal size; whether a content was seen in an earlier
    shard is settled between the shards' first rows of each content alone.
    """
    rows = write_shared(first_delivery(revisions, ["page_id", "sha1"]).filter(F.col("page_id").isNotNull()), "restored")
    cut = split_hot_keys(rows, "page_id", "revision_id", shard_rows, max_shards)
    shard = W.partitionBy("page_id", "_shard")
    seen = cut.select("page_id", "revision_id", "sha1", "_shard", "_hot", "_context",
        F.lag("sha1").over(shard.orderBy("revision_id")).alias("_before"),
        F.row_number().over(W.partitionBy("page_id", "_shard", "sha1").orderBy("revision_id")).alias("_nth"))
    seen = seen.filter(F.col("sha1").isNotNull() & ~F.col("_context")).withColumn("_new", ~F.col("sha1").eqNullSafe(F.col("_before")))
    first_in_hot = (F.col("_nth") == 1) & F.col("_hot")
    open_ = seen.filter(((F.col("_nth") > 1) & F.col("_new")) | first_in_hot)
    open_ = write_shared(open_.select("page_id", "revision_id", F.when(first_in_hot, F.col("sha1")).alias("sha1"), "_shard", first_in_hot.alias("_first"), "_new"), "restored-open")
    within = open_.filter(~F.col("_first")).select("page_id", "revision_id")
    earlier = F.row_number().over(W.partitionBy("page_id", "sha1").orderBy("_shard")) > 1  # one row a shard
    across = open_.filter("_first").withColumn("_earlier", earlier).filter(F.col("_earlier") & F.col("_new")).select("page_id", "revision_id")
    return within.unionByName(across)

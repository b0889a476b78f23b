"""The N highest-scoring items of every group, by descending bands of scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.firsts import first_rows
from palimpsest.shared import write_shared

#: Each band holds so many times the rows of the one above it; the first one so many rows for each place.
GROWTH, FIRST = 8, 4
#: Up to so many filled groups are broadcast for the anti-join; more are joined by a shuffle.
BROADCAST_GROUPS = 500_000


def _edges(df: DataFrame, score: str, rows: int, first: int) -> list:
    """Lower edges of the bands, descending: quantiles from a mergeable sketch. The last band has no lower edge."""
    shares, size = [], max(1, first)
    while size < rows:
        shares.append(1 - size / rows)
        size *= GROWTH
    if not shares:
        return []
    found = df.agg(F.percentile_approx(score, shares, 10_000)).first()[0] or []
    return sorted(set(found), reverse=True)


def top_per_group(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The ``n`` items of each group with the highest ``score``, the smaller ``item`` first on a tie: (group, item, score).

    An item counts once in a group, with its best score; rows with a null group, item or score are left out, and a group with
    fewer items has them all. Rows are written in range partitions of the score, one folder for each band, and the bands are
    taken from the top, each reading its own files only. Groups filled by higher bands are anti-joined; the others keep what the
    band gives up to their free places, in exact order of score and item. A band's rows of a large group are ranked in parts
    first, for any ``n``, so neither a large group nor very many equal scores gather in one task. No band is read once all groups
    are full or have no more rows.
    """
    rows = write_shared(df.select(group, item, score).dropna().groupBy(group, item).agg(F.max(score).alias(score)), "topn")
    groups = write_shared(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")), "topn-groups")
    totals = groups.agg(F.count(F.lit(1)), F.sum("_rows"), F.max("_rows")).first()
    edges = _edges(rows, score, totals[1] or 0, FIRST * n * totals[0])
    number = reduce(lambda low, e: F.when(F.col(score) >= F.lit(e[1]), e[0]).otherwise(low), reversed(list(enumerate(edges))), F.lit(len(edges)))
    banded = write_shared(rows.withColumn("_band", number), "topn-bands", by="_band") if edges else rows.withColumn("_band", F.lit(0))
    order = [F.col(score).desc(), F.col(item).asc()]
    kept, have = [], None
    for i in range(len(edges) + 1):
        band = banded.filter(F.col("_band") == i).select(group, item, score)
        if kept:
            counted = reduce(DataFrame.unionByName, kept).groupBy(group).agg(F.count(F.lit(1)).alias("_have"))
            have = write_shared(groups.join(counted, group).select(group, "_have", (F.col("_have") >= F.least(F.lit(n), "_rows")).alias("_full")), "topn-have")
            filled = have.filter("_full").select(group)
            n_filled = filled.count()
            if n_filled == totals[0]:
                break
            band = band.join(F.broadcast(filled) if n_filled <= BROADCAST_GROUPS else filled, group, "left_anti")
        ranked = first_rows(band, [group], order, n, "_rank", totals[2] or 0)
        if have is not None:
            ranked = ranked.join(have, group, "left").filter(F.col("_rank") <= n - F.coalesce("_have", F.lit(0)))
        kept.append(write_shared(ranked.select(group, item, score), "topn-band"))
    return reduce(DataFrame.unionByName, kept)

"""The first rows of groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a group that one task ranks before the group's best rows come together.
RANK_ROWS = 200_000


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str, largest: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group of ``keys`` in ``order``, with their ``rank`` from 1; ``order`` should leave no ties.

    No group is ranked by one task, whatever ``n``: rows are spread by a hash, each part passes on its first ``n``, and parts are
    merged some at a time until one is left. ``largest`` bounds a group's rows; without it, Spark's own limit on ranks does the
    first step where ``n`` is small enough for it, and 64 parts else.
    """
    spark = df.sparkSession
    if largest is not None:
        parts = math.ceil(largest / RANK_ROWS)
    else:
        parts = 1 if n <= int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")) else 64
    names = df.columns
    while parts > 1:
        part = F.pmod(F.xxhash64(*_hashable(df)), F.lit(parts))
        best = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
        df = df.withColumn("_part", part).withColumn(rank, best).filter(F.col(rank) <= n).select(*names)
        parts = math.ceil(parts / max(2, RANK_ROWS // n))
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def _hashable(df: DataFrame) -> list[Column]:
    """All columns that can be hashed."""
    return [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]

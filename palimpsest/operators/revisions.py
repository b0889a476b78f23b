"""The revision log: deliveries, titles and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_delivery(revisions: DataFrame, columns: list[str]) -> DataFrame:
    """One row per ``revision_id``: of its deliveries the one with the lowest ``fetched_at``, with its nulls.

    A null ``fetched_at`` counts as the latest delivery; deliveries equal in ``fetched_at`` are ordered by their values, so
    the result doesn't depend on the order of rows. Rows without ``revision_id`` are no revisions. The minimum of a struct
    combines map-side: a revision delivered very often is no hot key. Other columns of the input aren't read.
    """
    delivery = F.struct(F.col("fetched_at").isNull().alias("_late"), F.col("fetched_at").alias("_at"), *[F.col(c) for c in columns])
    first = revisions.filter(F.col("revision_id").isNotNull()).groupBy("revision_id").agg(F.min(delivery).alias("_d"))
    return first.select("revision_id", *[F.col(f"_d.{c}").alias(c) for c in columns])


def title_key(title: Column) -> Column:
    """Titles that differ only in spaces and underscores are the same."""
    return F.trim(F.regexp_replace(title, "[ _]+", " "))


def tag_key(tag: Column) -> Column:
    """Tags that differ only in letter case or in outer spaces are the same."""
    return F.lower(F.trim(tag))

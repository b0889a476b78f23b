"""Identity reverts: which revisions bring back an earlier content, and which ones they undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.revisions import first_delivery, title_key
from palimpsest.operators.selection import MAX_SHARDS, SHARD_ROWS, split_hot_keys
from palimpsest.shared import write_shared

REACH = 15
MAX_DAYS = 90
LOG = ["page_id", "page_title", "namespace", "parent_id", "timestamp", "user_text", "is_anon", "is_bot", "byte_size", "sha1", "page_created"]


def revision_log(revisions: DataFrame, namespace: int = 0) -> DataFrame:
    """The revisions of pages of one namespace, each once, with canonical names: ``ts``, and titles with spaces."""
    log = first_delivery(revisions, LOG).filter(F.col("page_id").isNotNull() & (F.col("namespace") == namespace))
    return log.withColumnRenamed("timestamp", "ts").withColumn("page_title", title_key(F.col("page_title"))).drop("namespace")


def is_bot() -> Column:
    """The source's flag; without one, whether the name says so; a hidden user is no bot."""
    return F.coalesce("is_bot", F.lower("user_text").contains("bot"), F.lit(False))


def label_reverts(log: DataFrame, reach: int = REACH, max_days: int = MAX_DAYS, shard_rows: int = SHARD_ROWS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """``log`` with restored_revision_id, is_revert, is_reverted, reverted_by_revision_id and reverted_by_ts.

    In the order of revision_id a revert is a revision whose content was last seen in an earlier revision that isn't the one
    directly before. It undoes the revisions between, up to ``reach`` before it and ``max_days`` older (a time that runs
    backwards counts as younger); the first such revert of a revision counts. Revisions without sha1 keep their place, restore
    nothing and can be undone. Large pages are cut at exact quantiles of revision_id; a shard sees ``reach`` rows beyond its end.
    """
    names = log.columns
    rows = write_shared(log, "log")
    cut = split_hot_keys(rows, "page_id", "revision_id", shard_rows, max_shards)
    shard = W.partitionBy("page_id", "_shard").orderBy("revision_id")
    before = F.lag("revision_id").over(shard)
    same = F.when(F.col("sha1").isNotNull(), F.lag("revision_id").over(W.partitionBy("page_id", "_shard", "sha1").orderBy("revision_id")))

    def undone(marked: DataFrame) -> DataFrame:
        """The first revert after each row that undoes it, within ``reach`` rows."""
        later = F.collect_list(F.struct("revision_id", "ts", "is_revert", "_same")).over(shard.rowsBetween(1, reach))
        until = F.make_dt_interval(F.lit(max_days))
        hits = F.filter("_later", lambda j: j.is_revert & (j._same < F.col("revision_id")) & (j.ts - F.col("ts") <= until))
        return marked.withColumn("_later", later).withColumn("_by", F.try_element_at(hits, F.lit(1)))

    def marked(found: DataFrame) -> DataFrame:
        return found.withColumn("is_revert", F.coalesce(F.col("_same") != F.col("_before"), F.lit(False)))

    # pages in one piece: one shuffle, and the rows stay whole
    small = undone(marked(cut.filter(~F.col("_hot")).withColumns({"_before": before, "_same": same})))
    # large pages: the last revision of each content in each shard, one row a shard, so few for any content
    large = cut.filter("_hot")
    seen = large.withColumns({"_before": before, "_same": same, "_nth": F.row_number().over(shard)}).filter(~F.col("_context"))
    last = large.filter(F.col("sha1").isNotNull() & ~F.col("_context")).groupBy("page_id", "sha1", "_shard").agg(F.max("revision_id").alias("_last"))
    earlier = last.withColumn("_earlier", F.lag("_last").over(W.partitionBy("page_id", "sha1").orderBy("_shard"))).filter(F.col("_earlier").isNotNull()).drop("_last")
    found = seen.join(earlier, ["page_id", "sha1", "_shard"], "left").withColumn("_same", F.coalesce("_same", "_earlier"))
    first = F.when((F.col("_shard") > 0) & (F.col("_nth") <= reach + 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = marked(found).withColumn("_ahead", F.explode(first)).withColumn("_shard", F.col("_shard") - F.col("_ahead"))
    split = undone(spread).filter(F.col("_ahead") == 0)
    labels = [F.when(F.col("is_revert"), F.col("_same")).alias("restored_revision_id"), "is_revert", F.col("_by").isNotNull().alias("is_reverted"), F.col("_by.revision_id").alias("reverted_by_revision_id"), F.col("_by.ts").alias("reverted_by_ts")]
    return small.select(*names, *labels).unionByName(split.select(*names, *labels))

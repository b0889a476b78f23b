"""Histories of changing attributes: closed versions from co-partitioned, key-sorted snapshots.

A snapshot is shuffled once, when it is added: its rows go to the partition of their entity, are sorted there by entity and
time, and lie in a folder of that snapshot and partition. Adding another one leaves those before untouched. A history is
read by merging, in each partition, the sorted rows of all snapshots through a heap of iterators; a version is emitted when
the payload changes, and only the open version is held.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.revisions import first_delivery, title_key
from palimpsest.shared import arrow_path, keep, qualified, shared_dir, write_shared

#: Rows of one partition of a history, and of one shard of a large entity; shards rise in size so that no more than MAX_SHARDS exist.
MERGE_ROWS = 500_000
MAX_SHARDS = 8_192
#: A time or tie that is null sorts first.
NEVER = -(2**63)
BATCH = 16_384
#: Schemes of files that tasks can open.
READABLE = ("file", "hdfs", "s3", "gs")

_SCHEMA = pa.schema([("entity", pa.int64()), ("shard", pa.int32()), ("payload", pa.string()), ("valid_from", pa.timestamp("us")), ("first_tie", pa.int64()), ("last_at", pa.timestamp("us")), ("last_tie", pa.int64()), ("valid_to", pa.timestamp("us")), ("n_updates", pa.int64()), ("several", pa.bool_()), ("is_first", pa.bool_()), ("is_last", pa.bool_())])
_RUNS = "entity bigint, shard int, payload string, valid_from timestamp_ntz, first_tie bigint, last_at timestamp_ntz, last_tie bigint, valid_to timestamp_ntz, n_updates bigint, several boolean, is_first boolean, is_last boolean"
_OUT = ["entity", "payload", "valid_from", "first_tie", "last_at", "last_tie", "valid_to", "n_updates", "several"]


def _stream(path: str) -> Iterator[tuple]:
    """(entity, shard, at, tie, payload) of a sorted file, a batch at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        for batch in pq.ParquetFile(file).iter_batches(BATCH, columns=["entity", "shard", "at", "tie", "payload"]):
            yield from _rows(batch)


def _within(folder: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return sorted(f"{folder}/{f.base_name}" for f in found if not f.base_name.startswith(("_", ".")))


def _versions(rows: Iterator[tuple]) -> Iterator[list]:
    """Runs of equal payload of each entity and shard, of rows in order. ``several``: there is another run of them."""
    run: list | None = None
    for entity, shard, at, tie, payload in rows:
        same = run is not None and run[0] == entity and run[1] == shard
        if same and run[2] == payload:
            run[5], run[6] = at, tie
            run[8] += 1
            continue
        if run is not None:
            if same:
                run[7], run[9], run[11] = at, True, False
            yield run
        run = [entity, shard, payload, at, tie, at, tie, NEVER, 1, same, not same, True]
    if run is not None:
        yield run


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = []
    for values, f in zip(zip(*rows), _SCHEMA):
        if f.name in ("valid_from", "first_tie", "last_at", "last_tie", "valid_to"):
            values = [None if v == NEVER else v for v in values]
        columns.append(pa.array(values, pa.int64()).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    entity, shard, at, tie, payload = batch.columns
    return zip(entity.to_pylist(), shard.to_pylist(), at.cast(pa.int64()).fill_null(NEVER).to_pylist(), tie.fill_null(NEVER).to_pylist(), payload.to_pylist())


def _from_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    versions = _versions(row for batch in batches for row in _rows(batch))
    while out := list(islice(versions, BATCH)):
        yield _batch(out)


def _merge(folders: list[str]):
    """The versions of each partition, by merging its files of all snapshots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                files = [file for folder in folders for snapshot in _within(folder) for file in _within(f"{snapshot}/part={part}")]
                versions = _versions(heapq.merge(*map(_stream, files)))
                while out := list(islice(versions, BATCH)):
                    yield _batch(out)

    return run


@dataclass
class Snapshots:
    """Sorted snapshots of attributes in a folder; ``parts`` partitions, by a hash of entity and shard.

    ``cuts``: of each large entity the times at which its shards begin. They are chosen once; later snapshots use them too.
    """

    spark: SparkSession
    path: str
    parts: int
    cuts: dict[int, list] = field(default_factory=dict)
    folders: list[str] = field(default_factory=list)

    @classmethod
    def like(cls, updates: DataFrame, parts: int | None = None, merge_rows: int = MERGE_ROWS, max_shards: int = MAX_SHARDS) -> Snapshots:
        """An empty store laid out for data like ``updates`` (entity, at): as many rows a partition, the same large entities.

        Large are entities of more than ``merge_rows`` rows, or a ``max_shards``-th of all; so few come to the driver. Rows of one
        moment stay together.
        """
        spark = updates.sparkSession
        known = updates.select("entity", "at").filter("entity IS NOT NULL")
        per = known.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
        total = known.count()
        bound = max(merge_rows, math.ceil(total / max_shards))
        large = {r[0]: math.ceil(r[1] / bound) for r in per.filter(F.col("n") > bound).collect()} if total > bound else {}
        cuts: dict[int, list] = {}
        if large:
            most = max(large.values())
            wanted = F.broadcast(spark.createDataFrame([(e,) for e in large], "entity bigint"))
            found = known.join(wanted, "entity").groupBy("entity").agg(F.percentile_approx("at", [i / most for i in range(1, most)], 10_000).alias("q")).collect()
            for e, q in found:
                cuts[e] = sorted({q[math.ceil(i * most / large[e]) - 1] for i in range(1, large[e])} - {None}) if q else []
        parts = parts or max(spark.sparkContext.defaultParallelism, math.ceil(total / merge_rows))
        return cls(spark, qualified(spark, keep(spark, f"{shared_dir(spark)}/palimpsest-snapshots-{uuid.uuid4().hex}")), parts, {e: c for e, c in cuts.items() if c})

    def add(self, updates: DataFrame, snapshot: Column | None = None) -> None:
        """Add a snapshot (entity, at, tie, payload), or several of them told apart by ``snapshot``: one shuffle, of these rows only.

        Rows without entity or payload are left out.
        """
        number = [] if snapshot is None else [F.coalesce(snapshot.cast("int"), F.lit(-1)).alias("snapshot")]
        rows = updates.select("entity", "at", "tie", "payload", *number).filter("entity IS NOT NULL AND payload IS NOT NULL")
        shard = F.lit(-1)
        if self.cuts:
            cuts = F.broadcast(self.spark.createDataFrame(list(self.cuts.items()), "_e bigint, _cuts array<timestamp_ntz>"))  # MAX_SHARDS times at most
            rows = rows.join(cuts, F.col("entity") == F.col("_e"), "left")
            shard = F.when(F.col("_e").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col("at"))))
        folders = ["snapshot", "part"] if number else ["part"]  # the rows' order begins with them, so the writer keeps it
        placed = rows.select(*folders[:-1], "entity", shard.alias("shard"), "at", "tie", "payload")
        placed = placed.withColumn("part", F.pmod(F.xxhash64("entity", "shard"), F.lit(self.parts)).cast("int"))
        ordered = placed.repartitionById(self.parts, "part").sortWithinPartitions(*folders, "entity", "shard", "at", "tie", "payload")
        out = f"{self.path}/{len(self.folders)}"
        ordered.write.option("compression", "zstd").partitionBy(*folders).parquet(out if number else f"{out}/snapshot=0")
        self.folders.append(out)

    def history(self) -> DataFrame:
        """The versions over all snapshots, as ``attribute_history`` gives them."""
        if self.path.partition("://")[0] in READABLE:
            runs = self.spark.range(0, self.parts, 1, self.parts).mapInArrow(_merge([arrow_path(f) for f in self.folders]), _RUNS)
        else:  # tasks can't open the files themselves: Spark reads and merges them
            files = [self.spark.read.parquet(f).select("part", "entity", "shard", "at", "tie", "payload") for f in self.folders]
            ordered = reduce(DataFrame.unionByName, files).repartitionById(self.parts, F.col("part")).drop("part").sortWithinPartitions("entity", "shard", "at", "tie", "payload")
            runs = ordered.mapInArrow(_from_rows, _RUNS)
        if not self.cuts:
            return runs.select(*_OUT)
        runs = write_shared(runs, "runs")
        edge = (F.col("shard") >= 0) & (F.col("is_first") | F.col("is_last"))
        inner = runs.filter(~edge).withColumn("several", F.col("several") | (F.col("shard") >= 0))
        return inner.select(*_OUT).unionByName(_across_shards(runs.filter(edge)))


def _across_shards(edges: DataFrame) -> DataFrame:
    """Joins the last version of a shard with the first one of the next where they are equal; two rows a shard of a large entity."""
    order = W.partitionBy("entity").orderBy("shard", F.desc("is_first"))
    before = F.lag(F.struct("payload", "is_last")).over(order)
    goes_on = F.coalesce(F.col("is_first") & before["is_last"] & (before["payload"] == F.col("payload")), F.lit(False))
    placed = edges.withColumns({"_i": F.row_number().over(order), "_on": goes_on})
    placed = placed.withColumn("_chain", F.sum((~F.col("_on")).cast("int")).over(order))
    first, last = (lambda c: F.min_by(c, "_i").alias(c)), (lambda c: F.max_by(c, "_i").alias(c))
    whole = placed.groupBy("entity", "_chain").agg(first("payload"), first("valid_from"), first("first_tie"), last("last_at"), last("last_tie"), last("valid_to"), last("is_last"), F.sum("n_updates").alias("n_updates"), F.bool_or("several").alias("several"))
    own = W.partitionBy("entity")
    until = F.when(F.col("is_last"), F.lead("valid_from").over(own.orderBy("_chain"))).otherwise(F.col("valid_to"))
    return whole.withColumns({"valid_to": until, "several": (F.count(F.lit(1)).over(own) > 1) | F.bool_or("several").over(own)}).select(*_OUT)


def attribute_history(updates: DataFrame, partitions: int | None = None, snapshot: Column | None = None, like: DataFrame | None = None, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The versions of each entity's payload: entity, payload, valid_from, first_tie, last_at, last_tie, valid_to, n_updates, several.

    ``updates``: entity bigint, at timestamp_ntz, tie bigint, payload string, of one snapshot or of several told apart by
    ``snapshot``; ``Snapshots`` takes them one after the other. A version is a longest run of equal payloads by (at, tie,
    payload); one that comes back is a new version. ``valid_to`` is the start of the next version, null for the current one;
    ``several`` tells whether the entity has more than one version. Rows without entity or payload are left out; a null ``at`` or
    ``tie`` sorts first. Repeated rows lengthen a version. ``like``: a cheaper table (entity, at) from which the layout is chosen.
    """
    store = Snapshots.like(updates if like is None else like, partitions, merge_rows)
    store.add(updates, snapshot)
    return store.history()


def title_updates(revisions: DataFrame) -> DataFrame:
    log = first_delivery(revisions, ["page_id", "timestamp", "page_title"])
    return log.select(F.col("page_id").alias("entity"), F.col("timestamp").alias("at"), F.col("revision_id").alias("tie"), title_key(F.col("page_title")).alias("payload"))


def title_history(revisions: DataFrame, partitions: int | None = None, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The history of the titles of pages; the log of each month is a snapshot."""
    like = revisions.select(F.col("page_id").alias("entity"), F.col("timestamp").alias("at"))
    month = F.year("at") * 100 + F.month("at")
    return attribute_history(title_updates(revisions), partitions, month, like, merge_rows)


def changed_titles(revisions: DataFrame, partitions: int | None = None) -> DataFrame:
    """All versions of the titles of pages with at least two: (page_id, first_revision_id, last_revision_id)."""
    versions = title_history(revisions, partitions).filter("several")
    return versions.select(F.col("entity").alias("page_id"), F.col("first_tie").alias("first_revision_id"), F.col("last_tie").alias("last_revision_id"))

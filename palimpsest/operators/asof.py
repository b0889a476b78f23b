"""Attributes as known at event time, from path-copied persistent search trees.

An attribute version has the time it became known and the time it is valid from. The versions of an entity are inserted into
a search tree by valid time, in the order in which they became known; an insertion copies only the path to its leaf, so the
root after each insertion stays a tree of what was known then. An event picks its root by known time and searches that tree.
"""

from __future__ import annotations

import bisect
import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.revisions import first_delivery, title_key
from palimpsest.shared import write_shared

#: Entities with more events than this are spread over several tasks, each with its own copy of the entity's tree.
HOT_EVENTS = 200_000
MAX_HOT = 1_000
#: Entities with more versions than this have several trees, by ranges of the valid day.
HOT_VERSIONS = 50_000


class PersistentTree:
    """Search trees over fixed ranks 0..n-1; node 0 is the empty tree, and a node's arrays never change after its creation."""

    def __init__(self, keys: list) -> None:
        self.keys = keys
        self.left, self.right, self.least, self.most = array("i", [0]), array("i", [0]), array("i", [len(keys)]), array("i", [-1])
        self.value: list = [None]
        self.roots = array("i", [0])
        self.known: list = []

    def insert(self, known, rank: int, value) -> None:
        """Add ``value`` at ``rank`` from ``known`` on; calls come in the order of ``known``."""
        path, node, lo, hi = [], self.roots[-1], 0, len(self.keys) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            path.append((node, rank <= mid))
            node = self.left[node] if rank <= mid else self.right[node]
            lo, hi = (lo, mid) if rank <= mid else (mid + 1, hi)
        new = self._node(0, 0, rank, rank, value)
        for node, went_left in reversed(path):
            left, right = (new, self.right[node]) if went_left else (self.left[node], new)
            new = self._node(left, right, min(self.least[left], self.least[right]), max(self.most[left], self.most[right]), None)
        self.known.append(known)
        self.roots.append(new)

    def _node(self, left: int, right: int, least: int, most: int, value) -> int:
        for column, x in zip((self.left, self.right, self.least, self.most, self.value), (left, right, least, most, value)):
            column.append(x)
        return len(self.left) - 1

    def last_below(self, known, key):
        """The value with the greatest key < ``key`` among those inserted with a known time < ``known``."""
        node = self.roots[bisect.bisect_left(self.known, known)]
        limit = bisect.bisect_left(self.keys, key) - 1
        if self.least[node] > limit:
            return None
        while self.left[node] or self.right[node]:
            right = self.right[node]
            node = right if right and self.least[right] <= limit else self.left[node]
        return self.value[node]


def _build(versions: list[tuple]) -> PersistentTree:
    tree = PersistentTree(sorted({key for _, key, _ in versions}))
    ranks = {key: i for i, key in enumerate(tree.keys)}
    for known, key, value in sorted(versions, key=lambda v: v[0]):
        tree.insert(known, ranks[key], value)
    return tree


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by entity, shard, copy and kind (0: versions, 1: events); the events of a tree follow its versions and stream by."""
    of, versions, tree, answers = None, [], None, {}
    for batch in batches:
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        known, valid = column("_known").cast(pa.int64()).to_pylist(), column("_valid").cast(pa.int64()).to_pylist()
        rows, values = [], []
        for i, (entity, shard, copy, kind, tie, value) in enumerate(zip(*(column(c).to_pylist() for c in ("_entity", "_shard", "_copy", "_kind", "_tie", "_value")))):
            if (entity, shard, copy) != of:
                of, versions, tree, answers = (entity, shard, copy), [], None, {}
            if kind == 0:
                versions.append((known[i], (valid[i], tie), value))
                continue
            if tree is None:
                tree, versions = _build(versions), []
            rows.append(i)
            at = known[i], valid[i]
            if at not in answers:
                answers[at] = tree.last_below(known[i], (valid[i], -(2**63)))
            values.append(answers[at])
        if rows:
            own = batch.take(pa.array(rows))
            names = [f.name for f in own.schema if f.name.startswith("r_")]
            yield pa.RecordBatch.from_arrays([*[own.column(own.schema.get_field_index(c)) for c in names], pa.array(values, pa.string())], names=[*names, "known_value"])


_VERSION = "entity bigint, shard int, known int, valid timestamp_ntz, tie bigint, value string"


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard of an entity, of all earlier shards, the latest versions as they became known.

    Rows are the latest version of each shard and known day, sorted by entity, shard and known day. Of those before a shard only
    such count as are later than all known before them: one for each known day at most.
    """
    of, shard = None, None
    records: list[tuple] = []  # (known, valid, tie, value), later both ways
    own: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for entity, number, known, valid, tie, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.int64()).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
            if (entity, number) != (of, shard):
                if entity != of:
                    records, own, shard = [], [], None
                records = _records(records, own)
                out += [(entity, number, *r) for r in records]
                of, shard, own = entity, number, []
            own.append((known, valid, tie, value))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            columns[3] = columns[3].cast(pa.timestamp("us"))
            yield pa.RecordBatch.from_arrays(columns, names=["entity", "shard", "known", "valid", "tie", "value"])


def _records(before: list[tuple], own: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for r in sorted([*before, *own], key=lambda r: (r[0], r[1], r[2])):
        if not out or r[1:3] > out[-1][1:3]:
            out.append(r)
    return out


def _shards(versions: DataFrame, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """``versions`` (entity, known, valid, tie, value) with the ``shard`` of their valid day, and the days at which the shards of large entities begin.

    Each shard but the first also gets the versions of earlier ones that may be the answer of one of its events, so that an
    event needs one shard only. An entity without ``bound`` versions has one shard.
    """
    spark = versions.sparkSession
    total = versions.count()
    large = {r[0]: math.ceil(r[1] / bound) for r in versions.groupBy("entity").count().filter(F.col("count") > bound).collect()} if total > bound else {}
    if not large:
        return versions.withColumn("shard", F.lit(0)), None
    most = max(large.values())
    wanted = F.broadcast(spark.createDataFrame([(e,) for e in large], "entity bigint"))
    day = F.unix_date(F.to_date("valid"))
    found = versions.join(wanted, "entity").groupBy("entity").agg(F.percentile_approx(day, [i / most for i in range(1, most)], 10_000).alias("q")).collect()
    cuts = {e: sorted({q[math.ceil(i * most / large[e]) - 1] for i in range(1, large[e])}) for e, q in found}
    table = F.broadcast(spark.createDataFrame(list(cuts.items()), "_large bigint, _cuts array<int>"))  # total / bound days at most
    placed = versions.join(table, F.col("entity") == F.col("_large"), "left").withColumn("shard", _shard(day))
    latest = placed.filter("_large IS NOT NULL").groupBy("entity", "shard", "known").agg(F.max(F.struct("valid", "tie", "value")).alias("v"))
    ordered = latest.select("entity", "shard", F.unix_date("known").alias("known"), "v.valid", "v.tie", "v.value").repartition("entity").sortWithinPartitions("entity", "shard", "known")
    carried = ordered.mapInArrow(_carried, _VERSION).withColumn("known", F.date_from_unix_date("known"))
    names = ["entity", "known", "valid", "tie", "value", "shard"]
    return placed.select(*names).unionByName(carried.select(*names)), table


def _shard(day: Column) -> Column:
    return F.coalesce(F.size(F.filter("_cuts", lambda c: c <= day)), F.lit(0))


def known_as_of(versions: DataFrame, events: DataFrame) -> DataFrame:
    """Each event with the attribute value that was known and valid before it.

    ``versions``: entity bigint, known date, valid timestamp_ntz, tie bigint, value string. ``events``: entity bigint, at date
    and any other columns, which come out again with ``known_value``: of the versions with ``known`` < at and ``valid`` < at
    00:00 the value with the latest (valid, tie), null if there is none. Versions with a null entity, time or value don't count;
    a null tie is below all others; of versions equal in valid and tie the greatest value of the latest known day counts. Events
    with a null entity or day get null and aren't shuffled. Repeated events come out repeatedly.

    Versions of one entity that became known on a day and are valid from the same day are reduced, map-side first, to the last
    of them: none but it can be found by an event of a later day. What is left, up to one version for each pair of days, lies in
    trees of HOT_VERSIONS about, by ranges of the valid day; an event asks the tree of its own range, which also has what may be
    the answer of the ranges before. Entities with very many events are spread over copies of their trees.
    """
    spark, names = events.sparkSession, events.columns
    usable = versions.select("entity", "known", "valid", F.coalesce("tie", F.lit(-(2**62))).alias("tie"), "value").dropna()
    reduced = usable.groupBy("entity", "known", F.to_date("valid").alias("_day")).agg(F.max(F.struct("valid", "tie", "value")).alias("v"))
    last, cuts = _shards(write_shared(reduced.select("entity", "known", "v.valid", "v.tie", "v.value"), "versions"), HOT_VERSIONS)
    all_ = events.select(F.col("entity").alias("_entity"), F.col("at").alias("_known"), *[F.col(f"`{c}`").alias(f"r_{i}") for i, c in enumerate(names)])
    given = [f"r_{i}" for i in range(len(names))]
    asked = all_.filter("_entity IS NOT NULL AND _known IS NOT NULL")
    without = all_.filter("_entity IS NULL OR _known IS NULL").select(*given, F.lit(None).cast("string").alias("known_value"))
    n = events.count()
    bound = max(HOT_EVENTS, math.ceil(n / MAX_HOT))
    hot = events.groupBy("entity").count().filter(F.col("count") > bound).filter(F.col("entity").isNotNull()).collect() if n > bound else []  # at most MAX_HOT rows
    if hot:
        copies = F.broadcast(spark.createDataFrame([(r[0], math.ceil(r[1] / bound)) for r in hot], "_hot bigint, _copies int"))
        last = last.join(copies, F.col("entity") == F.col("_hot"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)))
        asked = asked.join(copies, F.col("_entity") == F.col("_hot"), "left").withColumn("_copy", F.pmod(F.xxhash64(*given), F.coalesce("_copies", F.lit(1))).cast("int"))
    else:
        last, asked = last.withColumn("_copy", F.lit(0)), asked.withColumn("_copy", F.lit(0))
    if cuts is not None:
        asked = asked.join(cuts, F.col("_entity") == F.col("_large"), "left").withColumn("_shard", _shard(F.unix_date("_known") - 1))
    else:
        asked = asked.withColumn("_shard", F.lit(0))
    none = [F.lit(None).cast(f.dataType).alias(f"r_{i}") for i, f in enumerate(events.schema)]
    trees = last.select(F.col("entity").alias("_entity"), F.col("shard").alias("_shard"), "_copy", F.lit(0).alias("_kind"), F.col("known").alias("_known"), F.col("valid").alias("_valid"), F.col("tie").alias("_tie"), F.col("value").alias("_value"), *none)
    asked = asked.select("_entity", "_shard", "_copy", F.lit(1).alias("_kind"), "_known", F.col("_known").cast("timestamp_ntz").alias("_valid"), F.lit(0).cast("bigint").alias("_tie"), F.lit(None).cast("string").alias("_value"), *given)
    key = ["_entity", "_shard", "_copy"]
    ordered = trees.unionByName(asked).withColumn("_known", F.unix_date("_known")).repartition(*key).sortWithinPartitions(*key, "_kind")
    fields = ", ".join(f"r_{i} {f.dataType.simpleString()}" for i, f in enumerate(events.schema))
    out = ordered.mapInArrow(_search, f"{fields}, known_value string").unionByName(without)
    return out.select(*[F.col(f"r_{i}").alias(c) for i, c in enumerate(names)], "known_value")


def title_versions(revisions: DataFrame, titles: DataFrame) -> DataFrame:
    """The rows of ``titles`` as versions of the page of their revision; a row whose revision isn't in the log or has no page is none."""
    rows = titles.select("revision_id", F.col("date").alias("known"), F.col("title_then").alias("value")).dropna().distinct()
    log = first_delivery(revisions, ["page_id", "timestamp"]).filter(F.col("page_id").isNotNull())
    return rows.join(log, "revision_id").select(F.col("page_id").alias("entity"), "known", F.col("timestamp").alias("valid"), F.col("revision_id").alias("tie"), "value")


def titles_not_known(revisions: DataFrame, titles: DataFrame, forecasts: DataFrame) -> DataFrame:
    """``forecasts`` (page_id, page_title, date) shown under another title than the one known before their day: (page_id, day)."""
    events = forecasts.select(F.col("page_id").alias("entity"), F.col("date").alias("at"), "page_title").filter(F.col("page_title").isNotNull())
    found = known_as_of(title_versions(revisions, titles), events)
    return found.filter(~title_key(F.col("page_title")).eqNullSafe(title_key(F.col("known_value")))).select(F.col("entity").alias("page_id"), F.col("at").cast("string").alias("day")).distinct()

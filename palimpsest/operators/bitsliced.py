"""Feature tables over hundreds of event types from bit-sliced counters.

Entities are ordinals; a chunk is 2**12 neighbouring ordinals. Slice k of a counter is the set of the entities whose count has
bit k, as a compressed bitmap: of its words only those that hold a bit exist. Adding events to all entities of a chunk is a carry
addition of such bitmaps, word by word. The latest times are kept by ordinal beside them. Days are taken in order: the state
before a day is the table as of that day.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ranking import positions
from palimpsest.operators.revisions import first_delivery, tag_key
from palimpsest.shared import write_shared

#: A type's chunk is one group of a shuffle: 4,096 entities and a row for each of their days with events at most, however many events.
CHUNK_BITS = 12
NEVER = np.iinfo(np.int64).min
#: Rows of a batch of the wide table.
WIDE_ROWS = 512


class BitSlicedCounter:
    """Counters of the entities of one chunk; ``slices[k]`` has the words of the bitmap of bit k that aren't 0, by their place."""

    __slots__ = ("slices",)

    def __init__(self) -> None:
        self.slices: list[dict[int, int]] = []

    def add(self, amounts: Iterable[tuple[int, int]]) -> None:
        """Add (ordinal, non-negative amount) pairs, an ordinal at most once: for each bit of the amounts one carry addition of the ordinals that have it."""
        addends: list[dict[int, int]] = []
        for ordinal, amount in amounts:
            word, bit, k = ordinal >> 6, 1 << (ordinal & 63), 0
            while amount:
                if amount & 1:
                    while k >= len(addends):
                        addends.append({})
                    addends[k][word] = addends[k].get(word, 0) | bit
                amount >>= 1
                k += 1
        for k, addend in enumerate(addends):
            for word, bits in addend.items():
                self._carry(k, word, bits)

    def _carry(self, k: int, word: int, bits: int) -> None:
        while bits:
            while k >= len(self.slices):
                self.slices.append({})
            own = self.slices[k]
            old = own.get(word, 0)
            if old == bits:
                del own[word]
            else:
                own[word] = old ^ bits
            bits &= old
            k += 1

    def decode(self, ordinal: int) -> int:
        word, bit, value = ordinal >> 6, ordinal & 63, 0
        for k, own in enumerate(self.slices):
            value |= ((own.get(word, 0) >> bit) & 1) << k
        return value


class _Chunk:
    """The state of one type and chunk. Events wait, summed by ordinal, until the state is asked for, and are then added at once."""

    __slots__ = ("counters", "latest", "waiting")

    def __init__(self, measures: int) -> None:
        self.counters = [BitSlicedCounter() for _ in range(measures)]
        self.latest: dict[int, int] = {}
        self.waiting: dict[int, list[int]] = {}

    def settle(self) -> None:
        for i, counter in enumerate(self.counters):
            counter.add((low, own[i]) for low, own in self.waiting.items() if own[i])
        for low, own in self.waiting.items():
            if own[-1] > self.latest.get(low, NEVER):
                self.latest[low] = own[-1]
        self.waiting = {}


def _ints(column: pa.ChunkedArray | pa.Array, null: int = 0) -> np.ndarray:
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.int64())
    return column.fill_null(null).to_numpy(zero_copy_only=False)


def _decoder(measures: list[str]):
    """For rows sorted by type, chunk, day and kind (0: as asked, 1: events): the asked rows with their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, of = _Chunk(len(measures)), None
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            types = column("_type").to_pylist()
            chunks, kinds, lows = (_ints(column(c)).tolist() for c in ("_chunk", "_kind", "_low"))
            adds = zip(*(_ints(column(f"_{m}")).tolist() for m in measures), _ints(column("_last"), NEVER).tolist())
            asked: list[int] = []
            found: list[list[int]] = []
            for i, (kind, chunk, low, is_event, add) in enumerate(zip(types, chunks, lows, kinds, adds)):
                if (kind, chunk) != of:
                    state, of = _Chunk(len(measures)), (kind, chunk)
                if is_event:
                    own = state.waiting.get(low)
                    if own is None:
                        state.waiting[low] = list(add)
                    else:
                        last = own[-1]
                        own[:] = map(int.__add__, own, add)
                        own[-1] = max(last, add[-1])
                    continue
                if state.waiting:
                    state.settle()
                asked.append(i)
                found.append([*(counter.decode(low) for counter in state.counters), state.latest.get(low, NEVER)])
            if asked:
                rows = batch.take(pa.array(asked))
                *values, latest = (np.array(c, np.int64) for c in zip(*found))
                names = [f.name for f in rows.schema if f.name.startswith("r_")]
                carried = [rows.column(rows.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*carried, *map(pa.array, values), pa.array(latest, mask=latest == NEVER).cast(pa.timestamp("us"))], names=[*names, *measures, "last_at"])

    return run


def features_as_of(events: DataFrame, asked: DataFrame, dense: bool = True) -> DataFrame:
    """Counts, distinct actors and the latest time of every asked (entity, type) as of its day.

    ``events``: entity bigint, type string, at timestamp_ntz, actor string, flag boolean. ``asked``: entity bigint, type
    string, as_of date and any other columns, which come out again. Added: n_events, n_flagged, n_actors bigint and last_at
    timestamp_ntz over the events before ``as_of`` 00:00; 0 and null if there are none. Events without entity, type or time
    belong to no row; a null actor is an event without actor, a null flag is false. Asked rows without ``as_of``, entity or
    type get 0 and null, and don't move. Repeated asked rows come out repeatedly.

    An entity's id is its ordinal if ``dense``: best for ids that are mostly used up, as page ids are; for others the chunks hold
    few entities each, and cost as much as these. Otherwise ids get ordinals in their order among the asked entities, counted
    over range partitions.

    Events are summed map-side by entity, type and day before they move, so no entity or type is a hot key: a chunk of a type
    has at most 2**12 rows a day. ``events`` is read twice; hand over a written table where it is costly.
    """
    names = asked.columns
    known = events.select("entity", "type", F.to_date("at").alias("_date"), "at", "actor", "flag").filter(F.col("entity").isNotNull() & F.col("type").isNotNull() & F.col("at").isNotNull())
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    counts = known.groupBy("entity", "type", "_date").agg(F.sum(one).alias("n_events"), F.sum(F.when(F.col("flag"), one).otherwise(zero)).alias("n_flagged"), F.max("at").alias("_last"))
    counts = counts.withColumn("n_actors", zero)
    first = known.filter(F.col("actor").isNotNull()).groupBy("entity", "type", "actor").agg(F.min("_date").alias("_date"))
    actors = first.groupBy("entity", "type", "_date").agg(F.sum(one).alias("n_actors")).withColumns({"n_events": zero, "n_flagged": zero, "_last": F.lit(None).cast("timestamp_ntz")})
    measures = ["n_events", "n_flagged", "n_actors"]
    adds = counts.unionByName(actors).select("entity", "type", "_date", *measures, "_last")
    carried = [F.lit(None).cast(f.dataType).alias(f"r_{i}") for i, f in enumerate(asked.schema)]
    given = asked.select(*[F.col(f"`{c}`").alias(f"r_{i}") for i, c in enumerate(names)], F.col("entity"), F.col("type"), F.col("as_of"))
    whole = F.col("entity").isNotNull() & F.col("type").isNotNull() & F.col("as_of").isNotNull()
    empty = given.filter(~whole).select(*[f"r_{i}" for i in range(len(names))], *[zero.alias(m) for m in measures], F.lit(None).cast("timestamp_ntz").alias("last_at"))
    given = given.filter(whole)
    if not dense:
        ids = given.select("entity").dropna().distinct().withColumn("_all", F.lit(0))
        ordinals = positions(ids, "_all", [F.col("entity").asc()], {}).select("entity", (F.col("rank") - 1).alias("_ordinal"))
        adds = adds.join(ordinals, "entity").drop("entity").withColumnRenamed("_ordinal", "entity")
        given = given.join(ordinals, "entity").drop("entity").withColumnRenamed("_ordinal", "entity")
    adds = adds.select(*_place("entity", "type", "_date"), F.lit(1).alias("_kind"), *[F.col(m).alias(f"_{m}") for m in measures], "_last", *carried)
    wanted = given.select(*_place("entity", "type", "as_of"), F.lit(0).alias("_kind"), *[zero.alias(f"_{m}") for m in measures], F.lit(None).cast("timestamp_ntz").alias("_last"), *[f"r_{i}" for i in range(len(names))])
    ordered = adds.unionByName(wanted).repartition("_type", "_chunk").sortWithinPartitions("_type", "_chunk", "_day", "_kind")
    fields = ", ".join(f"r_{i} {f.dataType.simpleString()}" for i, f in enumerate(asked.schema))
    out = ordered.mapInArrow(_decoder(measures), f"{fields}, n_events bigint, n_flagged bigint, n_actors bigint, last_at timestamp_ntz").unionByName(empty)
    return out.select(*[F.col(f"r_{i}").alias(c) for i, c in enumerate(names)], *measures, "last_at")


def _place(entity: str, kind: str, date: str) -> list:
    return [
        F.col(kind).alias("_type"),
        F.shiftright(F.col(entity), CHUNK_BITS).alias("_chunk"),
        F.unix_date(F.col(date)).alias("_day"),
        F.col(entity).bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int").alias("_low"),
    ]


def revision_events(revisions: DataFrame, untyped: bool = False) -> DataFrame:
    """Revisions as events of their page, by type of change; written once, narrow. ``untyped``: with those that have no type."""
    log = first_delivery(revisions, ["page_id", "change_tag", "timestamp", "user_text", "is_anon"])
    events = log.select(F.col("page_id").alias("entity"), tag_key(F.col("change_tag")).alias("type"), F.col("timestamp").alias("at"), F.col("user_text").alias("actor"), F.col("is_anon").alias("flag"))
    return write_shared(events.filter("entity IS NOT NULL AND at IS NOT NULL" + ("" if untyped else " AND type IS NOT NULL")), "events")


def column_names(types: list[str]) -> list[str]:
    """Of each type the start of its columns: with underscores for spaces, unless two types would then be the same."""
    shown = Counter(t.replace(" ", "_") for t in types)
    return [n if shown[n := t.replace(" ", "_")] == 1 else t for t in types]


def _widener(types: list[str], names: list[str]):
    """For rows (entity, type, n_events, n_flagged, n_actors, last_at) sorted by entity: a row of all columns for each entity."""
    place = {t: i for i, t in enumerate(types)}

    def wide(ids: list, rows: list, kinds: list, columns: list) -> pa.RecordBatch:
        at = np.array(rows, np.int64), np.array(kinds, np.int64)
        out = [pa.array(ids, pa.int64())]
        cells = [np.full((len(types), len(ids)), NEVER if i == 3 else 0) for i in range(4)]
        for cell, values in zip(cells, columns):
            cell[at[1], at[0]] = values
        for k in range(len(types)):
            out += [pa.array(cell[k]) for cell in cells[:3]]
            out.append(pa.array(cells[3][k], mask=cells[3][k] == NEVER).cast(pa.timestamp("us")))
        return pa.RecordBatch.from_arrays(out, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        rows: list = []
        kinds: list = []
        columns: list[list] = [[], [], [], []]
        for batch in batches:
            entity, type_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            values = [_ints(batch.column(i)).tolist() for i in (2, 3, 4)] + [_ints(batch.column(5), NEVER).tolist()]
            for i, (e, t) in enumerate(zip(entity, type_)):
                if not ids or ids[-1] != e:
                    if len(ids) == WIDE_ROWS:
                        yield wide(ids, rows, kinds, columns)
                        ids, rows, kinds, columns = [], [], [], [[], [], [], []]
                    ids.append(e)
                if t is not None:
                    rows.append(len(ids) - 1)
                    kinds.append(place[t])
                    for own, v in zip(columns, values):
                        own.append(v[i])
        if ids:
            yield wide(ids, rows, kinds, columns)

    return run


def wide_features(revisions: DataFrame, as_of: str, types: list[str] | None = None) -> DataFrame:
    """One row per page with activity before ``as_of``: page_id, and of every type ``{type}_n_edits``, ``_n_anon``, ``_n_editors``, ``_last_edit_at``.

    ``types`` are all of the log, some hundreds, unless given. Counts of types without events are 0, their times null; a page
    whose events have other types or none has such a row too.
    """
    events = revision_events(revisions, untyped=True)
    if types is None:
        types = sorted(r["type"] for r in events.select("type").dropna().distinct().collect())
    day = F.lit(as_of).cast("date")
    own = F.when(F.col("type").isin(types), F.col("type"))
    asked = events.filter(F.col("at") < day.cast("timestamp_ntz")).select("entity", own.alias("type")).distinct().withColumn("as_of", day)
    long = features_as_of(events.filter(own.isNotNull()), asked).select("entity", "type", "n_events", "n_flagged", "n_actors", "last_at")
    outputs = ("n_edits bigint", "n_anon bigint", "n_editors bigint", "last_edit_at timestamp_ntz")
    fields = [("page_id", "bigint"), *((f"{n}_{o.split()[0]}", o.split()[1]) for n in column_names(types) for o in outputs)]
    schema = ", ".join(f"`{n.replace('`', '``')}` {kind}" for n, kind in fields)
    return long.repartition("entity").sortWithinPartitions("entity").mapInArrow(_widener(types, [n for n, _ in fields]), schema)


def wrong_features(revisions: DataFrame, published: DataFrame) -> DataFrame:
    """Rows of ``published`` (page_id, change_tag, as_of, n_edits, n_anon, n_editors, last_edit_at) that differ in any value: (page_id, change_tag)."""
    asked = published.select(F.col("page_id").alias("entity"), tag_key(F.col("change_tag")).alias("type"), "as_of", "change_tag", "n_edits", "n_anon", "n_editors", "last_edit_at")
    found = features_as_of(revision_events(revisions), asked)
    same = F.lit(True)
    for right, given in (("n_events", "n_edits"), ("n_flagged", "n_anon"), ("n_actors", "n_editors"), ("last_at", "last_edit_at")):
        same = same & F.col(right).eqNullSafe(F.col(given))
    return found.filter(~same).select(F.col("entity").alias("page_id"), "change_tag").distinct()

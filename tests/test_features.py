import glob
import os
import random
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import asof, bitsliced, history, rolling
from palimpsest.operators.asof import PersistentTree

T0 = datetime(2026, 6, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.dictionaries(st.integers(0, 4095), st.integers(0, 70_000), max_size=20), st.builds(lambda a, b, n: {i: n for i in range(a, b)}, st.integers(0, 4000), st.integers(0, 4096), st.integers(0, 9))), max_size=12))
def test_counter_adds(days):
    counter, want = bitsliced.BitSlicedCounter(), {}
    for day in days:
        counter.add(day.items())
        for k, v in day.items():
            want[k] = want.get(k, 0) + v
    asked = [*want, 1, 4095]
    assert [counter.decode(k) for k in asked] == [want.get(k, 0) for k in asked]
    assert all(bits for own in counter.slices for bits in own.values())  # words without a bit don't exist


def test_null_rows_are_not_shuffled(spark):
    events = spark.createDataFrame([(1, "x", T0, "u", True)], "entity bigint, type string, at timestamp_ntz, actor string, flag boolean")
    asked = spark.range(1000).selectExpr("CAST(NULL AS BIGINT) AS entity", "'x' AS type", "DATE'2026-07-01' AS as_of", "id")
    out = bitsliced.features_as_of(events, asked)
    assert out.filter("n_events = 0 AND last_at IS NULL").count() == 1000 and out.rdd.getNumPartitions() > 1


def test_features_as_of(spark):
    r = random.Random(1)
    events = [(r.choice([1, 2, 70_000, -5, None]), r.choice(["x", "y", None]), T0 + timedelta(hours=r.randrange(24 * 30)), r.choice(["u", "v", None, str(r.randrange(9))]), r.choice([True, False, None])) for _ in range(4000)]
    asked = [(e, t, T0.date() + timedelta(days=d), d, "k") for e in (1, 2, 70_000, -5, 99) for t in ("x", "y", "z") for d in (0, 3, 10, 40)] + [(1, "x", None, 0, "k"), (None, "x", date(2026, 7, 1), 0, "k"), (1, None, date(2026, 7, 1), 0, "k"), (1, "x", date(2026, 6, 11), 7, "k")]
    a = spark.createDataFrame(events, "entity bigint, type string, at timestamp_ntz, actor string, flag boolean")
    b = spark.createDataFrame(asked, "entity bigint, type string, as_of date, _day int, _low string")
    want = []
    for e, t, d, i, k in asked:
        own = [x for x in events if d and e is not None and t is not None and x[0] == e and x[1] == t and x[2] < datetime(d.year, d.month, d.day)]
        want.append((e, t, d, i, k, len(own), sum(x[4] is True for x in own), len({x[3] for x in own} - {None}), max((x[2] for x in own), default=None)))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, bitsliced.features_as_of(a, b).collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, bitsliced.features_as_of(a, b, dense=False).collect()), key=key) == sorted(want, key=key)
    assert bitsliced.features_as_of(a.limit(0), b.limit(0)).count() == 0
    assert {x[5] for x in bitsliced.features_as_of(a.limit(0), b).collect()} == {0}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 12)), max_size=30), st.lists(st.tuples(st.integers(-1, 11), st.integers(-1, 14)), min_size=1, max_size=8))
def test_persistent_tree(versions, questions):
    rows = [(known, key, i) for i, (known, key) in enumerate(sorted(versions))]
    tree = PersistentTree(sorted({k for _, k, _ in rows}))
    for known, key, value in rows:
        tree.insert(known, tree.keys.index(key), value)
    for known, key in questions:
        own = [(k, n, v) for n, k, v in rows if n < known and k < key]
        assert tree.last_below(known, key) == (max(own)[2] if own else None)


@pytest.mark.parametrize("seed, hot_events, hot_versions", [(2, 20, 10**6), (3, 10**6, 30), (4, 20, 7)])
def test_known_as_of_with_hot_entity(spark, monkeypatch, seed, hot_events, hot_versions):
    monkeypatch.setattr(asof, "HOT_EVENTS", hot_events)
    monkeypatch.setattr(asof, "HOT_VERSIONS", hot_versions)
    r = random.Random(seed)
    versions = [(r.choice([1, 1, 2, None]), T0.date() + timedelta(days=r.randrange(30)), T0 + timedelta(minutes=r.randrange(45_000)), r.choice([r.randrange(99), None]), r.choice(["a", "b", "c", None])) for _ in range(500)]
    events = [(r.choice([1, 1, 1, 2, 3]), T0.date() + timedelta(days=r.randrange(40)), i, True) for i in range(300)] + [(None, T0.date(), 1, False), (1, None, 2, False)]
    a = spark.createDataFrame(versions, "entity bigint, known date, valid timestamp_ntz, tie bigint, value string")
    b = spark.createDataFrame(events, "entity bigint, at date, _copies int, _hot boolean")
    want = []
    for e, d, i, h in events:
        at = d and datetime(d.year, d.month, d.day)
        own = [(v, -(2**62) if t is None else t, x) for n, k, v, t, x in versions if e is not None and n == e and d and x is not None and k < d and v < at]
        want.append((e, d, i, h, max(own)[:2] if own else None))
    best = {(n, v, -(2**62) if t is None else t): set() for n, k, v, t, x in versions}
    for n, k, v, t, x in versions:
        best[n, v, -(2**62) if t is None else t].add(x)
    got = asof.known_as_of(a, b).collect()
    assert len(got) == len(want)
    for row, (e, d, i, h, top) in zip(sorted(got, key=lambda x: (x[2], str(x[0]))), sorted(want, key=lambda x: (x[2], str(x[0])))):
        assert tuple(row)[:4] == (e, d, i, h)
        assert row.known_value is None if top is None else row.known_value in best[e, top[0], top[1]]
    assert asof.known_as_of(a.limit(0), b.limit(0)).count() == 0


def test_large_entities_are_split(spark):
    rows = [(1, T0.date() + timedelta(days=k), T0 + timedelta(days=v), 0, f"{k}-{v}") for k in range(40) for v in range(40)]
    versions = spark.createDataFrame(rows, "entity bigint, known date, valid timestamp_ntz, tie bigint, value string")
    placed, cuts = asof._shards(versions, 200)
    sizes = {x["shard"]: x["count"] for x in placed.groupBy("shard").count().collect()}
    assert len(sizes) == 8 and max(sizes.values()) <= 200 + 40 + 40 and cuts is not None  # a cut between days, and one carried a known day
    none = spark.range(500).selectExpr("CAST(NULL AS BIGINT) AS entity", "DATE'2026-07-01' AS at")
    out = asof.known_as_of(versions, none)
    assert out.filter("known_value IS NULL").count() == 500 and max(x.n for x in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 500


def test_rolling_totals(spark):
    r = random.Random(3)
    d0 = T0.date()
    daily = [(r.choice([1, 2, None]), d0 + timedelta(days=r.randrange(60)), r.choice([1, 5, None])) for _ in range(300)]
    asked = [(e, d0 + timedelta(days=d), "t") for e in (1, 2, 3) for d in range(0, 70, 7)] + [(1, d0, "t"), (None, d0, "t"), (1, None, "t")]
    got = rolling.rolling_totals(spark.createDataFrame(daily, "entity bigint, day date, n bigint"), spark.createDataFrame(asked, "entity bigint, day date, n_7d string"), ["n"])
    want = [(e, d, t, *(sum(v or 0 for x, y, v in daily if e is not None and d and x == e and d - timedelta(days=k) <= y < d) for k in (7, 30))) for e, d, t in asked]
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    asked_ = spark.createDataFrame(asked, "entity bigint, day date, avg_n_7d string")
    means = rolling.rolling_totals(spark.createDataFrame(daily, "entity bigint, day date, n bigint"), asked_, ["n"], averages=True).collect()
    assert sorted(map(tuple, means), key=key) == sorted([(*w, w[3] / 7.0, w[4] / 30.0) for w in want], key=key)
    empty = spark.createDataFrame([], "entity bigint, day date, n bigint")
    assert rolling.rolling_totals(empty, spark.createDataFrame([], "entity bigint, day date"), ["n"]).count() == 0


def test_attribute_history(spark, monkeypatch):
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), T0 + timedelta(minutes=r.randrange(3000)), i, r.choice(["a", "a", "b", None])) for i in range(900)] + [(8, T0, 1, "only")] * 3 + [(9, None, 1, "x"), (9, T0, 2, "y")]
    df = spark.createDataFrame(rows, "entity bigint, at timestamp_ntz, tie bigint, payload string")
    want = set()
    for e in {x[0] for x in rows} - {None}:
        own = sorted((x for x in rows if x[0] == e and x[3] is not None), key=lambda x: (x[1] is not None, x[1] or T0, x[2], x[3]))
        runs = []
        for x in own:
            if runs and runs[-1][0][3] == x[3]:
                runs[-1].append(x)
            else:
                runs.append([x])
        for i, run in enumerate(runs):
            want.add((e, run[0][3], run[0][1], run[0][2], run[-1][1], run[-1][2], runs[i + 1][0][1] if i + 1 < len(runs) else None, len(run), len(runs) > 1))
    for partitions, merge_rows in ((1, 10**6), (3, 10**6), (7, 100), (50, 20), (None, 3)):
        got = [tuple(x) for x in history.attribute_history(df, partitions, merge_rows=merge_rows).collect()]
        assert len(got) == len(want) and set(got) == want, partitions
    store = history.Snapshots.like(df.filter("tie % 2 = 0"), 4, merge_rows=50)
    assert 1 in store.cuts and len(store.cuts[1]) > 2
    for i in range(3):  # snapshots that come one after the other
        store.add(df.filter(F.coalesce("tie", F.lit(0)) % 3 == i))
    before = [os.stat(f).st_mtime_ns for f in glob.glob(store.path.removeprefix("file://") + "/**/*.parquet", recursive=True)]
    assert {tuple(x) for x in store.history().collect()} == want and len(store.folders) == 3
    monkeypatch.setattr(history, "READABLE", ())  # a file system that tasks can't open
    assert {tuple(x) for x in store.history().collect()} == want
    monkeypatch.undo()
    store.add(spark.createDataFrame([(77, T0, 1, "late")], df.schema))
    assert len(store.history().filter("entity = 77").collect()) == 1 and store.history().count() == len(want) + 1
    assert before and {os.stat(f).st_mtime_ns for f in glob.glob(store.path.removeprefix("file://") + "/**/*.parquet", recursive=True)} >= set(before)
    assert history.attribute_history(df.limit(0)).count() == 0

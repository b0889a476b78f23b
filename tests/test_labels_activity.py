import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import activity as A
from palimpsest.operators import links as L
from palimpsest.operators import panel as P
from palimpsest.operators import ranking as R
from palimpsest.operators.labels import label_reverts

T0 = datetime(2026, 1, 1)
LOG = "page_id bigint, revision_id bigint, ts timestamp_ntz, sha1 string, user_text string, is_bot boolean, byte_size bigint"


def page(contents, page_id=1, gaps=None, user="u"):
    return [(page_id, 10 * page_id + i + 1 if page_id == 1 else 1000 * page_id + i, T0 + timedelta(days=(gaps or {}).get(i, 0), minutes=i), c, user, None, 100 + i) for i, c in enumerate(contents)]


def labels(spark, rows, **kw):
    got = label_reverts(spark.createDataFrame(rows, LOG), **kw).collect()
    ids = sorted(r[1] for r in rows)
    at = {v: i for i, v in enumerate(ids)}
    by = [None] * len(ids)
    revert = [False] * len(ids)
    for r in got:
        by[at[r.revision_id]] = None if r.reverted_by_revision_id is None else at[r.reverted_by_revision_id] + 1
        revert[at[r.revision_id]] = r.is_revert
    return by, [i + 1 for i, x in enumerate(revert) if x]


@pytest.mark.parametrize(
    "contents, by, reverts",
    [
        ("ABA", [None, 3, None], [3]),
        ("ABACA", [None, 3, None, 5, None], [3, 5]),
        ("ABCDA", [None, 5, 5, 5, None], [5]),
        ("XYVYX", [None, 5, 4, 5, None], [4, 5]),
        ("AAB", [None, None, None], []),
        (["A", None, "A"], [None, 3, None], [3]),
    ],
)
def test_reverts(spark, contents, by, reverts):
    assert labels(spark, page(contents)) == (by, reverts)


def test_reach_and_age(spark):
    by, reverts = labels(spark, page(["A", "B", *[f"C{i}" for i in range(15)], "A"]))
    assert by[1] is None and by[2] == 18 and reverts == [18]
    assert labels(spark, page("ABA", gaps={2: 91})) == ([None, None, None], [3])
    rows = page("ABACA")
    random.Random(0).shuffle(rows)
    assert labels(spark, rows)[1] == [3, 5]


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_large_page_equals_brute_force(spark, shard_rows):
    r = random.Random(5)
    rows = [(7, r.randrange(10**6), T0 + timedelta(hours=r.randrange(24 * 200)), r.choice([None, *"abcdefghijkl", str(r.randrange(200))]), "u", None, 1) for _ in range(1200)]
    rows = list({x[1]: x for x in rows}.values())
    own = sorted(rows, key=lambda x: x[1])
    last, restored = {}, []
    for i, x in enumerate(own):
        restored.append(last.get(x[3]) if x[3] else None)
        if x[3]:
            last[x[3]] = i
    revert = [s is not None and s != i - 1 for i, s in enumerate(restored)]
    want = {}
    for i, x in enumerate(own):
        hits = [j for j in range(i + 1, min(i + 16, len(own))) if revert[j] and restored[j] < i and own[j][2] - x[2] <= timedelta(days=90)]
        want[x[1]] = (revert[i], own[hits[0]][1] if hits else None)
    got = {x.revision_id: (x.is_revert, x.reverted_by_revision_id) for x in label_reverts(spark.createDataFrame(rows, LOG), shard_rows=shard_rows).collect()}
    assert got == want


def history(spark, seed):
    r = random.Random(seed)
    rows, rev = [], 0
    for day in range(150):
        if r.random() < 0.4:
            for _ in range(r.choice([1, 1, 2, 9])):
                rev += 1
                rows.append((1, rev, T0 + timedelta(days=day, minutes=rev % 1400), r.choice([*"abc", str(rev)]), r.choice(["Alice", "Bob", "10.0.0.1", "FooBot", None]), None, r.choice([None, rev])))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_features_read_only_the_past(spark, seed):
    rows = history(spark, seed)
    days = [date(2026, 2, 1), date(2026, 3, 15), date(2026, 5, 20)]
    asked = spark.createDataFrame([(1, d) for d in days], "page_id bigint, date date")

    def features(own):
        lab = label_reverts(spark.createDataFrame(own, LOG))
        return {x.date: tuple(x) for x in A.features(A.with_bursts(A.daily_activity(lab)), lab, asked).collect()}

    whole = features(rows)
    for d in days:
        assert features([x for x in rows if x[2] < datetime(d.year, d.month, d.day)])[d] == whole[d]


def test_mass_editors_count_pages_strictly(spark):
    rows = [(p, p * 10, T0, f"s{p}", "busy", None, 1) for p in range(4)] + [(p, p * 10 + 1, T0, f"t{p}", "calm", None, 1) for p in range(3)] + [(9, 99, T0, "z", "SomeBot", None, 1)]
    got = A.mass_editor_days(label_reverts(spark.createDataFrame(rows, LOG)), 3).collect()
    assert [(x.user_text, x.pages) for x in got] == [("busy", 4)]


def test_co_bursts_leave_out_the_own_page(spark):
    d = date(2026, 1, 10)
    daily = spark.createDataFrame([(p, d, n, True, False) for p, n in ((1, 1), (2, 2), (3, 3))], "page_id bigint, day date, editors bigint, is_burst boolean, is_burst_excl_mass boolean")
    rows = spark.createDataFrame([(2, d + timedelta(1), True, 2), (1, d + timedelta(1), True, 1), (5, d + timedelta(1), False, 9), (2, d, True, 2)], "page_id bigint, date date, is_burst_1d boolean, editors_1d bigint")
    got = {(x.page_id, x.date): (x.co_burst_1d, x.co_burst_multi_editor_1d) for x in A.with_co_bursts(rows, A.co_bursts(daily)).collect()}
    assert got[2, d + timedelta(1)] == (2, 1) and got[1, d + timedelta(1)] == (2, 2) and got[5, d + timedelta(1)] == (3, 2) and got[2, d] == (-1, -1)


def test_neighbor_bursts(spark):
    day = lambda n: date(2026, 1, n)
    a, b, c, d = 1, 2, 3, 4
    edges = spark.createDataFrame([(a, b), (c, b), (b, d)], "src bigint, dst bigint")
    bursts = spark.createDataFrame([(a, day(10), 1), (c, day(10), 2), (b, day(12), 1)], "page_id bigint, day date, editors bigint")
    asked = spark.createDataFrame([(b, day(11)), (b, day(10)), (a, day(13))], "page_id bigint, date date")
    got = {(x.page_id, x.date): x for x in L.neighbor_bursts(edges, bursts, asked).collect()}
    x = got[b, day(11)]
    assert (x.in_bursting_1d, x.in_multi_1d, x.in_share_1d) == (2, 1, 1.0)
    assert got[b, day(10)].in_bursting_1d == 0 and got[a, day(13)].out_bursting_1d == 1


def test_link_graph(spark):
    pages = spark.createDataFrame([(1, "A", False), (2, "B", False), (3, "C", False), (4, "R1", True), (5, "R2", True), (6, "Loop", True), (7, "G", False)], "page_id bigint, title string, is_redirect boolean")
    redirects = spark.createDataFrame([(4, "C"), (5, "R1"), (6, "Loop"), (5, "Nowhere")], "page_id bigint, title string")
    targets = spark.createDataFrame([(10, "B"), (11, "R2"), (12, "Loop"), (13, "Red link"), (14, "G"), (15, "A")], "target_id bigint, title string")
    links = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 13), (3, 14), (3, 14), (4, 10), (1, 15)], "src bigint, target_id bigint")
    assert {tuple(x) for x in L.link_graph(pages, redirects, targets, links).collect()} == {(1, 2), (1, 3), (3, 7)}
    keep = spark.createDataFrame([(7,)], "page_id bigint")
    assert {tuple(x) for x in L.link_graph(pages, redirects, targets, links, keep).collect()} == {(3, 7)}


def test_day_metrics(spark):
    d1, d2 = date(2026, 1, 1), date(2026, 1, 2)
    rows = spark.createDataFrame([(d1, 1, 0.9, True), (d1, 2, 0.8, False), (d1, 3, 0.7, True), (d1, 4, 0.6, False), (d2, 1, 0.5, False)], "date date, page_id bigint, score double, y boolean")
    got = {x.date: x for x in R.day_metrics(rows).collect()}
    assert got[d1].precision_100 == 0.02 and got[d1].recall_1000 == 1 and got[d1].average_precision == round((1 + 2 / 3) / 2, 6)
    assert got[d2].precision_100 == 0 and got[d2].recall_1000 is None and got[d2].average_precision is None


def test_paired_difference(spark):
    days = [date(2026, 1, n) for n in (1, 2, 3)]
    a = spark.createDataFrame(list(zip(days, [0.1, 0.2, None])), "date date, m double")
    b = spark.createDataFrame(list(zip(days, [0.2, 0.1, 0.5])), "date date, m double")
    assert tuple(R.paired_difference(a, b, "m").first()) == (0.0, 0.1, 1, 1, 2)


def test_splits_and_samples(spark):
    s = P.time_splits(date(2026, 4, 2), 365, 365, 1825, 90)
    assert (s["test"].end - s["test"].start).days == 364 and (s["test"].start - s["validation"].end).days == 91
    assert [x.day.day for x in P.day_grid(spark, date(2026, 1, 1), date(2026, 1, 29), 14).collect()] == [1, 15, 29]
    ids = spark.range(20000)
    got = {x.id for x in ids.filter(P.sampled(ids.id, 0.2)).collect()}
    assert got == {i for i in range(20000) if i * 2654435761 % 2**32 < int(0.2 * 2**32)}


@pytest.mark.parametrize("seed", [0, 1])
def test_features_of_every_day_against_brute_force(spark, seed):
    lab = label_reverts(spark.createDataFrame(history(spark, seed), LOG)).localCheckpoint()
    daily = A.with_bursts(A.daily_activity(lab)).localCheckpoint()
    days = [date(2025, 12, 31) + timedelta(days=i) for i in range(200)]
    asked = spark.createDataFrame([(p, d, i) for p in (1, 2) for i, d in enumerate(days)], "page_id bigint, date date, n int")
    got = {(x.page_id, x.date): x for x in A.features(daily, lab, asked, carried=("n",)).collect()}
    edits = [(x.day, x.user_text) for x in A.with_channel(lab).filter("channel = 'edits'").collect()]
    acts = {x.day: x for x in daily.collect()}
    week = {(x.page_id, x.date): x.editors_7d for x in A.editors_in_week(lab, asked.select("page_id", F.col("date").alias("day"))).collect()}
    assert len(got) == 400 and len(week) > 50
    for (p, d), x in got.items():
        ago = lambda a, b, c: sum(int(getattr(acts[d - timedelta(days=k)], c)) for k in range(a, b + 1) if p == 1 and d - timedelta(days=k) in acts)  # noqa: B023, E731
        assert x.n == days.index(d) and x.editors_7d == week.get((p, d), 0) == len({u for day, u in edits if u and p == 1 and 1 <= (d - day).days <= 7})
        assert [x.edits_1d, x.edits_7d, x.edits_30d, x.edits_365d, x.edits_lag7, x.edits_lag14] == [ago(a, b, "edits") for a, b in ((1, 1), (1, 7), (1, 30), (1, 365), (7, 7), (14, 14))]
        assert [x.editors_1d, x.editors_lag7, x.reverts_7d, x.reverted_edits_7d, x.bot_edits_30d, x.burst_days_30d] == [ago(1, 1, "editors"), ago(7, 7, "editors"), ago(1, 7, "reverts"), ago(1, 7, "reverted_edits"), ago(1, 30, "bot_edits"), ago(1, 30, "is_burst")]


def test_no_asked_day_is_spelled_out_and_broadcast(spark, tmp_path):
    """Asked pages in a small file made a broadcast of seven rows each in the driver: 203 MB at 0.02 GB in l5_model."""
    lab = label_reverts(spark.createDataFrame(history(spark, 0), LOG)).localCheckpoint()
    daily = A.with_bursts(A.daily_activity(lab)).localCheckpoint()
    spark.range(100_000).selectExpr("id AS page_id", "DATE'2026-05-01' AS date").write.parquet(path := str(tmp_path / "asked"))
    out = A.features(daily, lab, spark.read.parquet(path))
    assert out.count() == 100_000
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence" not in text and "Join" not in text


def test_rankings_in_one_pass_equal_each_alone(spark):
    r = random.Random(5)
    rows = [(date(2026, 5, 1 + i % 3), i * 7 + 2**33 * (i % 2), i % 3 < 2 and r.random() < 0.2, r.choice([None, 0, 0, 1, 2, 9]), r.choice([None, 0.5, -1.0, 3.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "date date, page_id bigint, y boolean, a bigint, b double").repartition(5)
    got = {(x.ranking, x.date): tuple(x)[2:] for x in R.ranking_metrics(df, {"one": ["b"], "two": ["a", "b"], "none": []}, (10, 2000), (100,)).collect()}
    place = {k: i for i, k in enumerate(sorted({(x[3] is not None, x[3] or 0, x[4] is not None, x[4] or 0) for x in rows}))}
    score = spark.createDataFrame([(x[1], float(place[x[3] is not None, x[3] or 0, x[4] is not None, x[4] or 0])) for x in rows], "page_id bigint, two double")
    alone = df.join(score, "page_id").withColumns({"one": F.col("b"), "none": F.lit(1.0)})
    want = {(n, x.date): tuple(x)[1:] for n in ("one", "two", "none") for x in R.day_metrics(alone.select("date", "page_id", F.col(n).alias("score"), "y"), (10, 2000), (100,)).collect()}
    assert got == want and len(got) == 9 and got["two", date(2026, 5, 3)] == (0.0, 0.0, None, None)

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import selection
from palimpsest.operators.revisions import first_delivery, tag_key, title_key

SCHEMA = "page_id bigint, revision_id bigint, sha1 string, fetched_at timestamp_ntz, _shard int, n string"
T0 = datetime(2026, 6, 1)


def rows_of(seed: int, n: int = 1500):
    r = random.Random(seed)
    out = []
    for i in range(n):
        page = r.choice([1, 1, 1, 2, 3, None, r.randrange(50)])
        out.append((page, r.randrange(10**9) * r.choice([1, 1, -1]), r.choice(["a", "a", "b", "c", None, str(r.randrange(30))]), T0 + timedelta(minutes=r.randrange(9999)), i, "x"))
    out += [(p, v, "zz", T0 + timedelta(days=30), s, n) for p, v, _, _, s, n in r.sample(out, 200)] + r.sample(out, 50)
    r.shuffle(out)
    return out


def brute(rows):
    first = {}
    for page, rev, sha, at, *_ in rows:
        key = (at is None, at or T0, page is not None, page or 0, sha is not None, sha or "")
        if rev is not None and (rev not in first or key < first[rev][0]):
            first[rev] = (key, page, sha)
    pages = {}
    for rev, (_, page, sha) in first.items():
        if page is not None:
            pages.setdefault(page, []).append((rev, sha))
    found = set()
    for page, own in pages.items():
        seen = {}
        for i, (rev, sha) in enumerate(sorted(own)):
            if sha is not None:
                if sha in seen and seen[sha] != i - 1:
                    found.add((page, rev))
                seen[sha] = i
    return found, {p: sorted(r for r, _ in v) for p, v in pages.items()}


@pytest.mark.parametrize("shard_rows", [7, 100, 100_000])
def test_restored_contents(spark, shard_rows):
    rows = rows_of(shard_rows)
    got = [tuple(r) for r in selection.restored_contents(spark.createDataFrame(rows, SCHEMA), shard_rows=shard_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)[0]


def test_restored_contents_of_one_page_with_one_content(spark):
    rows = [(5, i, "same" if i % 2 else None, T0, 0, "") for i in range(400)]
    assert {tuple(r) for r in selection.restored_contents(spark.createDataFrame(rows, SCHEMA), shard_rows=16).collect()} == brute(rows)[0]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert selection.restored_contents(empty).count() == 0
    assert selection.key_quantiles(empty, "page_id", "revision_id", [0.5]).count() == 0


@pytest.mark.parametrize("shard_rows", [5, 10_000])
def test_key_quantiles(spark, shard_rows):
    rows = [(p, v) for p, v, *_ in rows_of(3)] + [(9, None), (None, 4), (8, 2**62), (8, -(2**62))] + [(7, 1)] * 40
    values = {}
    for p, v in rows:
        if p is not None and v is not None:
            values.setdefault(p, []).append(v)
    want = {(p, q, sorted(v)[max(1, -(-len(v) * int(q * 100) // 100)) - 1]) for p, v in values.items() for q in (0.0, 0.25, 0.5, 1.0)}
    got = selection.key_quantiles(spark.createDataFrame(rows, "page_id bigint, v bigint"), "page_id", "v", [0.0, 0.25, 0.5, 1.0], shard_rows=shard_rows)
    assert {tuple(r) for r in got.collect()} == want


def test_select_by_weight(spark):
    df = spark.createDataFrame([(1, v, w) for v, w in [(5, 2), (1, 3), (9, 4), (3, 0)]], "k bigint, v bigint, w bigint")
    found = selection.select_ranks(df, "k", "v", [(1, n) for n in (1, 3, 4, 9)], 1, 9, bits=2, weight="w")
    assert found == {(1, 1): (1, 0, 3), (1, 3): (1, 0, 3), (1, 4): (5, 3, 5), (1, 9): (9, 5, 9)}


def test_first_delivery_keeps_nulls_and_ignores_order(spark):
    rows = [(1, 7, None, T0, 0, ""), (2, 7, "b", T0 + timedelta(1), 0, ""), (3, 8, "c", None, 0, ""), (4, 8, "d", T0, 0, ""), (5, None, "e", T0, 0, "")]
    got = {tuple(r) for r in first_delivery(spark.createDataFrame(rows, SCHEMA), ["page_id", "sha1"]).collect()}
    assert got == {(7, 1, None), (8, 4, "d")}


def test_keys(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("A_b  c_", " Mobile EDIT ")], "a string, b string").select(title_key(F.col("a")), tag_key(F.col("b"))).first()
    assert tuple(row) == ("A b c", "mobile edit")


@pytest.mark.parametrize("n, largest", [(3, None), (1500, None), (1500, 4000), (5000, 3000)])
def test_first_rows_of_large_groups(spark, monkeypatch, n, largest):
    from palimpsest.operators import firsts

    monkeypatch.setattr(firsts, "RANK_ROWS", 300)
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'b' WHEN id % 6 < 5 THEN 'a' END AS g", "id * 7919 % 6007 AS s")
    got = firsts.first_rows(df, ["g"], [F.desc("s")], n, "rank", largest).collect()
    by = {}
    for g, s in df.collect():
        by.setdefault(g, []).append(s)
    assert {tuple(r) for r in got} == {(g, s, i + 1) for g, own in by.items() for i, s in enumerate(sorted(own, reverse=True)[:n])}

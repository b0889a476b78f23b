"""Queries without SQL, over the smallest tables: their rows against plain Python over the same texts."""

import hashlib
import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from palimpsest.functions import changes, dates, markup

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    import duckdb

    path = Path(DATA) / "documents.parquet"
    return duckdb.execute(f"SELECT doc_id, text, source, page_id, day FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}') WHERE text IS NOT NULL").fetchall()


@pytest.fixture(scope="module")
def pairs(docs):
    held = {}
    for doc_id, text, _, page_id, day in sorted(docs):
        if page_id is not None and day is not None:
            held.setdefault((page_id, day), []).append(text)
    return {k: (v[0], v[-1]) for k, v in held.items() if len(v) > 1}


def plain(value):
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


OF_TEXT = {
    "t4_plain_text": ("plain", lambda t, d: markup.plain_text(t), False),
    "t5_prose": ("pieces", lambda t, d: markup.prose(t), False),
    "t10_lead": ("lead", lambda t, d: markup.lead(t), False),
    "t12_kinds": ("kinds", lambda t, d: [k for k in changes.KINDS if k in changes.kinds_of(t, set())], False),
    "t16_snippet": ("snippet", lambda t, d: changes.snippet([t]), False),
    "d1_mark_dates": ("marked", dates.mark, True),
    "d5_dated_lines": ("n", lambda t, d: len(dates.dated_lines(t, d)), True),
    "d7_weekdays": ("text", dates.fix_weekdays, True),
}
OF_PAIR = {
    "t2_word_diff": lambda a, b: changes.word_diff(a, b),
    "t3_line_diff": lambda a, b: changes.line_diff(a, b),
    "t15_day_change": lambda a, b: changes.day_change(a, b),
    "t14_new_spans": lambda a, b: dict(zip(("spans", "inserted_chars", "removed_chars"), ([s for _, s in changes.new_spans(a, b)[0]], *changes.new_spans(a, b)[1:]))),
    "r8_joined_spans": lambda a, b: {"added": " … ".join(changes.word_diff(a, b)["inserted"]), "gone": " … ".join(changes.word_diff(a, b)["removed"])},
}
APART = {"w20_without_repeats", "t13_span_sections", "t17_edit_context", "a26_best_threshold", "l5_model", "l10_daily_model"}


@pytest.mark.parametrize("name", sorted(OF_TEXT))
def test_of_text(spark, docs, name):
    column, function, dated = OF_TEXT[name]
    want = {doc_id: function(text, day) for doc_id, text, *_, day in docs if day is not None or not dated}
    got = {r["doc_id"]: plain(r[column]) for r in entry.queries()[name](spark, DATA).collect()}
    assert got == want and len(got) > 50


@pytest.mark.parametrize("name", sorted(OF_PAIR))
def test_of_pair(spark, pairs, name):
    got = {(r["page_id"], r["day"]): {k: v for k, v in plain(r).items() if k not in ("page_id", "day")} for r in entry.queries()[name](spark, DATA).collect()}
    assert got == {k: OF_PAIR[name](a, b) for k, (a, b) in pairs.items()}


def test_spans_and_contexts(spark, pairs):
    spans = sorted((r["page_id"], str(r["day"]), r["span"], tuple(r["sections"])) for r in entry.queries()["t13_span_sections"](spark, DATA).collect())
    want = [(p, str(d), s, tuple(changes.span_sections(markup.Outline(b), at, s))) for (p, d), (a, b) in pairs.items() for at, s in changes.new_spans(a, b)[0]]
    assert spans == sorted(want)
    contexts = {(r["page_id"], r["day"]): (r["section"], r["context"]) for r in entry.queries()["t17_edit_context"](spark, DATA).collect()}
    assert contexts == {k: changes.edit_context(a, changes.word_diff(a, b)["first_offset"]) for k, (a, b) in pairs.items() if changes.word_diff(a, b)["first_offset"] is not None}


def test_repeats_and_budget(spark, docs):
    groups = {}
    for doc_id, text, source, _, day in sorted(docs):
        if day is not None:
            groups.setdefault("|".join(x for x in (str(day), source) if x is not None), []).append(set(text.lower().split()))
    want = {}
    for key, texts in groups.items():
        kept = []
        for own in texts:
            if all((len(own & k) / len(own | k) if own | k else 1.0) < 0.8 for k in kept):
                kept.append(own)
        want[key] = (len(kept), len(texts))
    assert {r["grp"]: (r["kept"], r["n"]) for r in entry.queries()["w20_without_repeats"](spark, DATA).collect()} == want
    for r, text in zip(sorted(entry.queries()["w21_within_budget"](spark, DATA).collect()), [t for _, t, *_ in sorted(docs)]):
        used, n = 0, 0
        for s in (s.strip(" ") for s in re.split(r"(?<=[.!?])[ \t\r\n\f\x0b]+", text)):
            if len(s) >= 25 and used + len(s) <= 450:
                used, n = used + len(s), n + 1
        assert (r["n"], r["chars"]) == (n, used)


def test_hashes(spark):
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    rows = entry.queries()["pred_p5_base36_hashes"](spark, DATA).collect()
    import duckdb

    path = Path(DATA) / "revisions.parquet"
    given = dict(duckdb.execute(f"SELECT revision_id, arg_min(coalesce(sha1, ''), fetched_at) FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}') GROUP BY revision_id").fetchall())
    assert len(rows) > 50
    for r in rows:
        n, out = int(hashlib.sha1(given[r["revision_id"]].encode()).hexdigest(), 16), ""
        while n:
            n, x = divmod(n, 36)
            out = digits[x] + out
        assert r["hash"] == out.rjust(31, "0")


def test_daily_features_equal_those_of_the_whole_log(spark):
    from palimpsest.operators import activity as A
    from palimpsest.operators.labels import label_reverts
    from palimpsest.plans import activity as Q
    from palimpsest.plans.pipelines import DAY

    got = {tuple(r) for r in entry.queries()["l8_daily_features"](spark, DATA).collect()}
    log = Q.log(spark, DATA).filter(f"ts < TIMESTAMP_NTZ'{DAY} 00:00:00'")
    labels = label_reverts(log)
    daily = A.with_bursts(A.daily_activity(labels, 10**9))
    asked = log.filter("ts >= TIMESTAMP_NTZ'2026-07-15 00:00:00'").selectExpr("page_id", f"DATE'{DAY}' AS date").distinct()
    want = {tuple(r) for r in A.features(daily, labels, asked).select("page_id", "date", "edits_1d", "edits_7d", "edits_30d", "editors_7d", "burst_days_30d").collect()}
    assert got == want and len(got) > 20


def test_daily_model(spark):
    rows = {r["ranking"]: r for r in entry.queries()["l10_daily_model"](spark, DATA).collect()}
    assert set(rows) == {"model", "edits_yesterday"} and all(0 <= r["precision_10"] <= 1 and (r["average_precision"] is None or 0 <= r["average_precision"] <= 1) for r in rows.values())


def test_nothing_else_lacks_sql():
    core = {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not re.match(r"p[6-9]_", n)}
    assert core == set(OF_TEXT) | set(OF_PAIR) | APART

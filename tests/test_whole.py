"""That queries do the whole of their job: small cases that shorter ones get wrong."""

import random
import re
from datetime import date, datetime

from pyspark.sql import functions as F

from palimpsest.functions import changes
from palimpsest.functions import names as N
from palimpsest.functions import text as X
from palimpsest.operators import bitsliced
from palimpsest.operators import model as M
from palimpsest.operators import panel as P
from palimpsest.plans import pipelines, ranking
from palimpsest.sources import dumps


def test_wide_features_has_all_types_and_pages(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "WIDE_ROWS", 2)
    at = datetime(2026, 7, 1)
    tags = [" Mobile edit", "rare tag", "rare tag", "a b", "a_b", None, "later tag"]
    rows = [(1, 1, tags[0], at, "u", True), (2, 2, tags[1], at, "u", False), (3, 2, tags[2], datetime(2026, 7, 2), "v", None), (4, 2, tags[3], at, None, True), (5, 3, tags[4], at, "w", False), (6, 4, None, at, "w", False), (7, 5, tags[6], datetime(2026, 7, 15), "w", False), (8, 6, None, None, "w", False)]
    log = spark.createDataFrame([(*r, at) for r in rows], "revision_id bigint, page_id bigint, change_tag string, timestamp timestamp_ntz, user_text string, is_anon boolean, fetched_at timestamp_ntz")
    out = bitsliced.wide_features(log, "2026-07-15")
    got = {r["page_id"]: r.asDict() for r in out.collect()}
    assert len(out.columns) == 1 + 4 * 5 and set(got) == {1, 2, 3, 4}
    filled = {p: {k: v for k, v in r.items() if k != "page_id" and v not in (0, None)} for p, r in got.items()}
    assert filled[1] == {"mobile_edit_n_edits": 1, "mobile_edit_n_anon": 1, "mobile_edit_n_editors": 1, "mobile_edit_last_edit_at": at}
    assert filled[2] == {"rare_tag_n_edits": 2, "rare_tag_n_editors": 2, "rare_tag_last_edit_at": datetime(2026, 7, 2), "a b_n_edits": 1, "a b_n_anon": 1, "a b_last_edit_at": at}
    assert filled[3] == {"a_b_n_edits": 1, "a_b_n_editors": 1, "a_b_last_edit_at": at} and filled[4] == {}
    assert got[4]["later_tag_n_edits"] == 0 and got[4]["later_tag_last_edit_at"] is None


def test_names_stand_in_texts_as_whole_words(spark):
    titles = ["Noreth_Glacier", "Mercury_(planet)", "(Sic)_transit", "Ünalur", "abc", "?!?!?", "Geography_of_Renduna_(series_300)", "Noreth", "St. Noreth–Glacier", None]
    texts = ["At Noreth Glacier.", "Noreth_Glacier", "Mercury (planet)", "Mercury (planet)s", "mercury; [[Mercury|x]]", "Mercurys Mercury", "so (Sic) transit", "so(Sic) transit", "(Sic) transit", "xÜnalur", "Ünalur", "abc abc", "a ?!?!? b", "?!?!?", "a?!?!?b", "a?!?!?", "no Geography of Renduna", "Geography of  Renduna", "St. Noreth–Glacier", "", "St. Noreth-Glacier Noreth GlacierX Noreth Glacier"]
    names = N.titles_names(spark.createDataFrame([(t,) for t in titles], "title string")).drop("title").distinct()
    rows = N.spots(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), names)
    got = {(r["id"], r["name"]) for r in rows.join(names.drop("hashes"), "key").filter(N.fits()).collect()}
    want = {(i, n) for i, text in enumerate(texts) for t in titles for n in N.names_of(t) if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text)}
    assert got == want and len(want) > 15


def test_evaluation_has_every_page(spark):
    rows = [(1, date(2026, 7, 1), 1), (1, date(2026, 8, 1), 2), (2, date(2026, 7, 31), 0), (2, date(2026, 8, 2), 0), (3, date(2026, 8, 1), 5)]
    got = P.evaluation_panel(spark.createDataFrame(rows, "page_id bigint, day date, kept_edits bigint"), [date(2026, 8, 1), date(2026, 8, 2)])
    a, b = date(2026, 8, 1), date(2026, 8, 2)
    assert {tuple(r) for r in got.select("page_id", "date", "y").collect()} == {(1, a, True), (1, b, False), (2, a, False), (2, b, False), (3, b, False)}


def test_fit_weighs_rows(spark):
    rows = spark.range(400).select(*[F.lit(1).alias(c) for c in M.FEATURES], (F.col("id") % 3 > 0).alias("y"), (F.col("id") >= 300).alias("late"), F.when(F.col("id") % 3 > 0, 1.0).otherwise(50.0).alias("w"))
    score = lambda weight: M.score(M.fit(rows, "late", 2, weight=weight), rows).first()["score"]
    assert score("w") < 0.5 < score(None)


def test_thresholds_ascend_on_mean_jaccard(spark):
    r, grid = random.Random(5), [i / 20 for i in range(1, 20)]
    p = {i: [r.choice([0.04, 0.12, 0.3, 0.62, 0.8, 0.97]) for _ in range(3)] for i in range(40)}
    did = {i: [x > 0.1 * (k + 1) ** 2 and r.random() < 0.9 for k, x in enumerate(own)] for i, own in p.items()}

    def mean(at):
        pairs = [([x >= t for x, t in zip(p[i], at)], did[i]) for i in p]
        both, union = ([sum(f(x, y) for x, y in zip(s, d)) for s, d in pairs] for f in (lambda x, y: x and y, lambda x, y: x or y))
        return sum(b / u if u else 1.0 for b, u in zip(both, union)) / len(p)

    want = [0.5] * 3
    best = mean(want)
    for _ in range(3):
        for j in range(3):
            for t in grid:
                trial = [*want[:j], t, *want[j + 1 :]]
                if mean(trial) > best + 1e-12:
                    best, want = mean(trial), trial
    rows = spark.createDataFrame([(i, k, p[i][k], did[i][k]) for i in p for k in range(3)], "id bigint, kind int, p double, did boolean")
    got = sorted(map(tuple, X.best_thresholds(rows, grid).collect()))
    assert got == [(k, t, round(best, 6)) for k, t in enumerate(want)] and any(not 0.4 <= t <= 0.6 for t in want)


def test_sentences_that_name_the_page_come_first(spark):
    queries = spark.createDataFrame([(1, 7, "Noreth_(river)", "harbour lighthouse ferry"), (2, 8, "Noreth", "harbour")], "id bigint, page_id bigint, title string, text string")
    sentences = ["A harbour with lighthouse and ferry.", "Then Noreth was seen by few.", "Noreths do not count at all.", "The harbour of Noreth (river) is old.", "One harbour alone.", *(f"Old harbour and lighthouse {'x' * i}." for i in range(4, 14))]
    candidates = spark.createDataFrame([(7, i, s) for i, s in enumerate(sentences)], "page_id bigint, sentence_id bigint, sentence string")
    frequency = spark.createDataFrame([(w, 1.0, True) for w in ("harbour", "lighthouse", "ferry")], "word string, idf double, content boolean")
    got = sorted((r["rank"], r["id"], r["sentence_id"], r["shared"]) for r in X.relevant_sentences(queries, candidates, frequency).collect())
    assert got[:3] == [(1, 1, 3, 1), (2, 1, 1, 0), (3, 1, 0, 3)] and len(got) == 8 and all(x[3] == 2 for x in got[3:])


def test_snippet_reads_whole_spans():
    text = "| a = 1\n" * 3000 + "|\n" + "The longest piece of prose stands at the end."
    assert len(text) > 20_000 and changes.snippet([text]) == "The longest piece of prose stands at the end."


def test_no_rows_are_left_out_by_id(spark, tmp_path):
    d, at, later = str(tmp_path), datetime(2026, 7, 1), datetime(2026, 7, 2)
    log = [(350, 1, 0, "u", 5, "h", "t", at), (350, 1, 0, "v", 5, "h", "t", later), (77, 2, 0, "u", 6, "h", None, at), (14, 3, 0, "u", 6, "h", None, at), (13, 4, 1, "u", 6, "h", None, at)]
    schema = "revision_id bigint, page_id bigint, namespace int, user_text string, byte_size bigint, sha1 string, change_tag string, fetched_at timestamp_ntz"
    rows = spark.createDataFrame(log, schema).withColumns({"timestamp": F.lit(at), "is_bot": F.lit(False), "is_anon": F.lit(False), "page_title": F.lit("p"), "parent_id": F.lit(0).cast("bigint")})
    rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).write.parquet(f"{d}/revisions.parquet")
    spark.createDataFrame([(1, date(2026, 6, 1)), (2, date(2026, 6, 3)), (3, date(2026, 6, 4))], "page_id bigint, date date").write.parquet(f"{d}/forecast_days.parquet")
    assert ranking.j17_source_differences(spark, d).first().asDict() == {"shared": 4, "only_a": 0, "only_b": 0, "user_text_differs": 1, "byte_size_differs": 0, "sha1_differs": 0, "change_tag_differs": 0}
    missing = {r["day"] for r in ranking.s14_missing_days(spark, d).collect()}
    assert len(missing) == 80 - 3 and date(2026, 6, 2) in missing and not missing & {date(2026, 6, 1), date(2026, 6, 3), date(2026, 6, 4)}
    assert sorted(r["revision_id"] for r in pipelines.s2_history_lines(spark, d).collect()) == [14, 77, 350, 350]


def test_history_lines_leaves_out_other_namespaces_and_deleted(spark, tmp_path):
    def line(i, namespace, deleted):
        at = {"entity": "revision", "type": "create", "namespace": namespace, "deleted": deleted, "revision_id": str(i), "page_id": "1"}
        fields = {dumps.PLACE[k]: v for k, v in at.items()}
        return "\t".join(fields.get(i, "") for i in range(dumps.WIDTH))

    (tmp_path / "x.tsv").write_text("\n".join([line(1, "0", "false"), line(2, "1", "false"), line(3, "0", "true"), line(4, "", "false"), line(7, "0", "")]) + "\n")
    assert sorted(r["revision_id"] for r in dumps.history_lines(spark, str(tmp_path / "x.tsv")).collect()) == [1, 7]


def test_source_differences_counts_rows_of_one_source(spark):
    from palimpsest.operators import history_joins as H

    a, b = (spark.createDataFrame(x, "k bigint, v string") for x in ([(50, "x"), (2, None), (3, "y")], [(2, None), (3, "z"), (100, "w")]))
    assert H.source_differences(a, b, "k", ["v"]).first().asDict() == {"shared": 2, "only_a": 1, "only_b": 1, "v_differs": 1}

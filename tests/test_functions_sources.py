from datetime import date, datetime

import pytest

from palimpsest.functions import changes, dates, markup
from palimpsest.sources import dumps, sinks


def test_plain_text():
    assert markup.plain_text("'''A''' is a [[town|city]] in [[France]].<ref>x {{cite}}</ref> {{Infobox|a={{b}}}}[[File:x.jpg|thumb|A [[cap]]]]") == "A is a city in France."
    assert markup.plain_text("== Title ==\n* one &amp; two\n{| class=x\n| cell\n|}\nend") == "Title one & two end"
    assert markup.plain_text("tail of a note</ref> text") == "text"
    assert markup.plain_text("text {{never closed") == "text"
    assert markup.plain_text(None) == "" and markup.plain_text("[[" * 5000 + "x") is not None
    assert markup.prose("name=value | this is a sentence | 1 2 3 4") == ["this is a sentence"]


def test_headings_and_sections():
    text = "lead\n== One ==\na\n=== Two ===\nb"
    assert [(n, t) for _, n, t in markup.headings(text)] == [(2, "One"), (3, "Two")]
    assert markup.section_at(text, 0) == "(lead)" and markup.section_at(text, len(text)) == "Two"


def test_word_diff():
    d = changes.word_diff("The town lies north.\n", "The town lies north. It has a mill.\n")
    assert d["inserted"] == ["It has a mill."] and d["removed"] == []
    assert changes.word_diff("a  b", "a b")["inserted"] == []
    assert changes.word_diff(None, "new page")["inserted"] == ["new page"]
    assert changes.line_diff("a\nb", "a\nc") == {"added": ["c"], "gone": ["b"]}


def test_day_change():
    old = "Lead text of the page here.\n== Career ==\nShe wrote her first book in the spring of that year.\n== Legacy ==\nEvery school bears that name nowadays, proudly.\n"
    new = "Lead text of the page here.\n== Career ==\nShe wrote her first book in the spring of that year. It later won several notable prizes abroad.<ref>x</ref>\n== Results ==\n{|\n|-\n| 1 || 2\n|}\n"
    got = changes.day_change(old, new)
    assert got["kinds"] == ["new section", "prose", "removals", "references", "table"]
    assert "Career" in got["sections"] and "Results" in got["sections"]
    assert changes.day_change("a\nb\n", "b\na\n")["kinds"] == []


@pytest.mark.parametrize(
    "text, marked",
    [
        ("24 September to 3 October 2026", "24 September to 3 October 2026 [under way, ends in 7 days]"),
        ("on October 4", "on October 4 [in 8 days]"),
        ("16–22 September 2026", "16–22 September 2026 [ended 4 days ago]"),
        ("September 24–27, 2026", "September 24–27, 2026 [under way, ends tomorrow]"),
        ("30 February", "30 February"),
        ("3 January", "3 January [in about 3 months]"),
    ],
)
def test_mark_dates(text, marked):
    assert dates.mark(text, date(2026, 9, 26)) == marked


def test_fix_weekdays():
    assert dates.fix_weekdays("Monday, 26 September 2026 and Sunday 27 September", date(2026, 9, 20)) == "Saturday, 26 September 2026 and Sunday 27 September"


def test_sql_rows():
    line = rb"(1,'a,(b)\'',NULL),(2,'c\\',1.5e-3);".rstrip(b";")
    assert list(dumps.parse_rows(line, 3)) == [(b"1", rb"a,(b)\'", None), (b"2", rb"c\\", b"1.5e-3")]
    for bad in (b"(1,0xFF)", b"(1,2)(3,4)", b"(1,2,3)", b"1,2"):
        with pytest.raises(ValueError):
            list(dumps.parse_rows(bad, 2))


def test_sql_dump_layouts(spark, tmp_path):
    dumps.register(spark)
    head = "CREATE TABLE `t` (\n  `id` int,\n  `title` varbinary(9)\n) ENGINE=x;\n"
    (tmp_path / "a.sql").write_text(head + "INSERT INTO `t` VALUES (1,'A'),(2,NULL);\nINSERT INTO `t` VALUES (3,'C');\n")
    (tmp_path / "b.sql").write_text(head + "INSERT INTO `t` VALUES\n(4,'D'),\n(5,'E');\n")
    rows = spark.read.format("sqldump").schema("title binary, id bigint").load(str(tmp_path)).collect()
    assert {(r.id, None if r.title is None else bytes(r.title)) for r in rows} == {(1, b"A"), (2, None), (3, b"C"), (4, b"D"), (5, b"E")}


@pytest.mark.parametrize("split", [7, 40, 100, 1 << 20])
def test_sql_dump_splits(spark, tmp_path, split):
    dumps.register(spark)
    head = "CREATE TABLE `t` (\n  `id` int,\n  `n` int,\n  `title` varbinary(9)\n);\n"
    (tmp_path / "a.sql").write_text(head + "".join(f"INSERT INTO `t` VALUES ({i},{i * 2},'T{i}'),({i + 1},NULL,'x,(\\'y');\n" for i in range(0, 60, 2)))
    import gzip

    with gzip.open(tmp_path / "b.sql.gz", "wt") as file:
        file.write(head.replace("  `title` varbinary(9)\n", "  `other` int\n") + "INSERT INTO `t` VALUES (100,1,2),(101,-3,4);\n")
    read = spark.read.format("sqldump").option("split", split).schema("n bigint, id bigint").load(str(tmp_path)).collect()
    assert sorted((r.id, r.n) for r in read) == sorted([(i, i * 2) for i in range(0, 60, 2)] + [(i + 1, None) for i in range(0, 60, 2)] + [(100, 1), (101, -3)], key=lambda x: x[0])
    if split == 40:
        titles = spark.read.format("sqldump").option("split", split).schema("title binary, id bigint").load(str(tmp_path / "a.sql")).collect()
        assert {(r.id, bytes(r.title)) for r in titles if r.id < 4} == {(0, b"T0"), (1, rb"x,(\'y"), (2, b"T2"), (3, rb"x,(\'y")}


def test_integer_rows():
    import numpy as np

    assert np.array_equal(dumps.parse_integers(b"(1,-2),(3,4);", 2), [[1, -2], [3, 4]]) and np.array_equal(dumps.parse_integers(b"(1),(2)", 1), [[1], [2]])
    assert all(dumps.parse_integers(x, 2) is None for x in (b"(1,NULL)", b"(1,'a')", b"(1,2)(3,4)", b"(1,2,3)", b"(1,2),", b""))


def test_history_line_width(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("too\tfew\n")
    with pytest.raises(Exception, match="expected 78 fields"):
        dumps.history_lines(spark, str(tmp_path / "x.tsv")).collect()


def test_base36(spark):
    from palimpsest.functions.arrow import sha1_base36

    rows = spark.createDataFrame([("0" * 40,), ("ff",), (None,), ("not hex",)], "h string")
    assert [r[0] for r in rows.select(sha1_base36("h")).collect()] == ["0" * 31, "0" * 29 + "73", None, None]


def test_live_changes(spark):
    schema = "type string, ns int, title string, pageid bigint, revid bigint, old_revid bigint, user string, anon boolean, temp boolean, bot boolean, userhidden boolean, newlen bigint, ts timestamp_ntz, sha1 string, sha1hidden boolean"
    at = datetime(2026, 9, 1, 12)
    rows = [("edit", 0, "A b", 1, 10, 9, "u", None, None, None, None, 5, at, "ff", None), ("new", 0, "C", 2, 11, 0, "v", None, True, None, True, 5, at, "ff", True), ("log", 0, "C", 2, 12, 0, "v", None, None, None, None, 5, at, None, None), ("edit", 1, "C", 2, 13, 0, "v", None, None, None, None, 5, at, None, None), ("edit", 0, "C", 2, 14, 0, "v", None, None, None, None, 5, datetime(2026, 9, 2), None, None)]
    from pyspark.sql import functions as F

    moment = lambda x: F.lit(x).cast("timestamp_ntz")
    got = {r.revision_id: r for r in dumps.live_changes(spark.createDataFrame(rows, schema), moment("2026-09-01"), moment("2026-09-02")).collect()}
    assert set(got) == {10, 11} and got[10].page_title == "A_b" and got[10].sha1.endswith("73") and got[10].page_created is None
    assert got[11].user_text is None and got[11].sha1 is None and got[11].is_anon and got[11].page_created == at


def test_fetch_by_batches(spark):
    got = dumps.fetch_by_batches(spark.range(7).withColumnRenamed("id", "revision_id"), lambda ids: {i: f"t{i}" for i in ids if i != 3}, 3).collect()
    assert {tuple(r) for r in got} == {(i, None if i == 3 else f"t{i}") for i in range(7)}


def test_append_missing_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k bigint, v string")
    for _ in range(2):
        sinks.append_missing(rows, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_length_batches():
    from palimpsest.functions.batches import length_batches

    assert length_batches([5, 1, 9, 2, 2], 2, 10) == [[1, 3], [4, 0], [2]]
    assert length_batches([], 2, 10) == []


def test_without_repeats(spark):
    from palimpsest.functions.batches import without_repeats

    rows = [("d", 1, "a b c d e"), ("d", 2, "a b c d e"), ("d", 3, "x y"), ("e", 1, "a b c d e"), ("d", 4, None), ("d", 5, "")]
    got = {(r.grp, r.n): r.kept for r in without_repeats(spark.createDataFrame(rows, "grp string, n bigint, text string")).collect()}
    assert got == {("d", 1): True, ("d", 2): False, ("d", 3): True, ("e", 1): True, ("d", 4): True, ("d", 5): False}


def test_dated_lines():
    text = "played on 24 September 2026\nnothing\n24–26 September 2026 final\nplayed on 24 September 2026\non 24 October 2026"
    assert dates.dated_lines(text, date(2026, 9, 24)) == ["played on 24 September 2026", "24–26 September 2026 final"]
    assert dates.dated_lines(None, date(2026, 9, 24)) == []


def test_budget_and_cut(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions import text as X

    row = spark.createDataFrame([(["aaaa", "bbbbbbbb", "cc"], "one  two three")], "a array<string>, t string").select(X.within_budget(F.col("a"), 6).alias("a"), X.cut(F.col("t"), 9).alias("t")).first()
    assert row.a == ["aaaa", "cc"] and row.t == "one two …"


def test_empty_texts_everywhere(spark):
    from palimpsest.functions import arrow as U

    rows = spark.createDataFrame([(None, None, None), ("", "x", date(2026, 1, 1))], "a string, b string, d date")
    out = rows.select(U.plain_text("a"), U.prose("a"), U.lead("a"), U.word_diff("a", "b"), U.line_diff("a", "b"), U.day_change("a", "b"), U.mark_dates("a", "d"), U.dated_lines("a", "d"), U.fix_weekdays("a", "d"), U.snippet("a"), U.kinds_of("a")).collect()
    assert len(out) == 2

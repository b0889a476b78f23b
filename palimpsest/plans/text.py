"""Queries on texts, forecasts, dates and stories, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import arrow as U
from palimpsest.functions import names as N
from palimpsest.functions import text as X
from palimpsest.operators.revisions import first_delivery
from palimpsest.plans import activity as Q
from palimpsest.shared import table, write_shared

DAY = "2026-08-01"
SECTION = "Expected: ([^\n]*)"


def docs(spark, d):
    return table(spark, d, "documents").filter(F.col("text").isNotNull())


def pairs(spark, d):
    """The first and last text of each page and day."""
    own = docs(spark, d).filter("page_id IS NOT NULL AND day IS NOT NULL")
    return own.groupBy("page_id", "day").agg(F.min_by("text", "doc_id").alias("old"), F.max_by("text", "doc_id").alias("new"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def t1_pieces(spark, d):
    own = X.pieces(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(own).cast("bigint").alias("n"), (F.array_join(own, "") == F.col("text")).alias("same"))


def t6_sentences(spark, d):
    own = X.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(own).cast("bigint").alias("n"), F.try_element_at(own, F.lit(1)).alias("first"))


def t7_words(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.words(F.col("text"))).cast("bigint").alias("n"))


def a18_document_frequency(spark, d):
    return X.document_frequency(docs(spark, d))


def k5_relevant_sentences(spark, d):
    """Sentences of the page's other texts for each outlook, those that name its page first."""
    own = docs(spark, d).filter("page_id IS NOT NULL")
    queries = own.filter("source = 'outlook'").select(F.col("doc_id").alias("id"), "page_id", F.trim(F.regexp_extract("text", "Page: ([^\n]*)", 1)).alias("title"), "text")
    parts = own.filter("source <> 'outlook'").select("page_id", "doc_id", F.posexplode(X.sentences(F.col("text"))).alias("n", "sentence"))
    candidates = parts.select("page_id", (F.col("doc_id") * 100000 + F.col("n")).alias("sentence_id"), "sentence")
    found = X.relevant_sentences(queries, candidates, write_shared(X.document_frequency(docs(spark, d)), "df"))
    return found.select("id", "sentence_id", "shared", "score", F.col("rank").cast("bigint").alias("rank"))


def w21_within_budget(spark, d):
    own = X.within_budget(X.sentences(F.col("text")), 450)
    return docs(spark, d).select("doc_id", F.size(own).cast("bigint").alias("n"), F.length(F.array_join(own, "")).cast("bigint").alias("chars"))


def u6_word_jaccard(spark, d):
    return pairs(spark, d).select("page_id", "day", F.round(X.jaccard(X.words(F.col("old")), X.words(F.col("new"))), 6).alias("jaccard"))


def u7_shown_words(spark, d):
    a, b = X.words(F.col("old")), X.words(F.col("new"))
    return pairs(spark, d).select("page_id", "day", F.round(F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)), 6).alias("share"))


def t8_names_page(spark, d):
    """How many of the names of the pages' titles each text holds as whole words, linked or not."""
    titles = table(spark, d, "titles").filter("title IS NOT NULL").select("title").distinct()
    names = write_shared(N.titles_names(titles).drop("title").distinct(), "names")
    spots = N.spots(docs(spark, d).select("doc_id", "text"), names)
    return spots.join(names.drop("hashes"), "key").filter(N.fits()).groupBy("doc_id").agg(F.count_distinct("name").alias("names"))


def _headings(spark, d):
    level = F.length(F.regexp_extract("line", "^(={2,6})[^=]", 1))
    own = X.lines(docs(spark, d)).withColumn("level", level).filter("level > 0").withColumn("closed", F.length(F.regexp_extract("line", r"[^=](={2,6})\s*$", 1)))
    return own.filter("closed = level").select("doc_id", "n", "level", F.trim(F.regexp_replace("line", r"^=+|=+\s*$", "")).alias("title"))


def t9_headings(spark, d):
    return _headings(spark, d).select("doc_id", F.col("n").cast("bigint").alias("n"), F.col("level").cast("bigint").alias("level"), "title")


def t11_sections(spark, d):
    """The lines and characters of each section of each text."""
    from pyspark.sql import Window as W

    marks = _headings(spark, d).select("doc_id", "n", "title")
    own = X.lines(docs(spark, d)).join(marks, ["doc_id", "n"], "left")
    section = F.coalesce(F.last("title", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("n")), F.lit("(lead)"))
    return own.withColumn("section", section).filter("title IS NULL").groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


def t18_cut(spark, d):
    return docs(spark, d).select("doc_id", X.cut(F.col("text"), 120).alias("cut"))


def t28_title_key(spark, d):
    return table(spark, d, "titles").select("revision_id", "date", F.translate("title_then", "_", " ").alias("title"))


def w19_news_items(spark, d):
    return X.news_items(docs(spark, d).filter("source = 'current_events'")).withColumn("n", F.col("n").cast("bigint"))


def _forecasts(spark, d):
    own = docs(spark, d).filter("source = 'outlook' AND page_id IS NOT NULL")
    named = F.array_distinct(F.filter(F.transform(F.split(F.regexp_extract("text", SECTION, 1), ";"), lambda s: F.trim(s)), lambda s: s != ""))
    return own.select(F.col("doc_id").alias("id"), "page_id", F.slice(named, 1, 3).alias("named"))


def _changed(spark, d):
    """Of each page the sections of its articles with their characters, largest first."""
    own = docs(spark, d).filter("source = 'article' AND page_id IS NOT NULL").select("doc_id", "page_id")
    by = t11_sections(spark, d).join(own, "doc_id").groupBy("page_id", "section").agg(F.sum("chars").alias("chars"))
    packed = F.array_sort(F.collect_list(F.struct((-F.col("chars")).alias("c"), F.col("section").alias("s"))))
    return by.groupBy("page_id").agg(packed.alias("p")).select("page_id", F.transform("p", lambda x: x["s"]).alias("changed"), F.transform("p", lambda x: -x["c"]).alias("chars"))


def k3_main_sections(spark, d):
    return _changed(spark, d).select("page_id", F.array_join(X.main_sections(F.col("changed"), F.col("chars"), 3), "|").alias("main"))


def a23_forecast_scores(spark, d):
    return X.forecast_scores(_forecasts(spark, d).join(_changed(spark, d), "page_id"))


def a23_forecast_summary(spark, d):
    s = a23_forecast_scores(spark, d)
    return s.agg(*[F.round(F.avg(c), 6).alias(c) for c in s.columns if c != "id"], F.count(F.lit(1)).alias("n"))


def a24_common_kinds(spark, d):
    """Kinds that a tenth of forecasts list, by threshold."""
    own = _marginals(spark, d).filter("p >= 0.5")
    n = _forecasts(spark, d).count()
    return own.groupBy(F.col("kind").cast("bigint").alias("kind")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0.1 * n)


def _marginals(spark, d):
    own = _forecasts(spark, d).select("id")
    lines_ = own.select("id", F.explode(F.sequence(F.lit(0), F.lit(511))).alias("mask")).withColumn("logprob", -((F.col("id") * 7 + F.col("mask") * 13) % 101) / 20)
    return X.kind_marginals(lines_, 9)


def a25_kind_marginals(spark, d):
    return _marginals(spark, d).withColumn("kind", F.col("kind").cast("bigint"))


def a26_best_threshold(spark, d):
    """Coordinate ascent on the mean Jaccard of the kinds."""
    own = _marginals(spark, d).withColumn("did", (F.col("id") + F.col("kind")) % 3 == 0)
    return X.best_thresholds(own, [i / 20 for i in range(1, 20)]).withColumn("kind", F.col("kind").cast("bigint"))


def a27_weighted_mean(spark, d):
    """Distinct words for each character of a source's texts, weighted by their characters, and pooled over languages."""
    size = F.length("text")
    rows = docs(spark, d).filter("source IS NOT NULL AND lang IS NOT NULL").filter(size > 0).select("source", "lang", size.alias("w"), (F.size(X.words(F.col("text"))) / size).alias("v"))
    runs = rows.groupBy("source", "lang").agg(F.sum(F.col("v") * F.col("w")).alias("vw"), F.sum("w").alias("w"))
    return runs.groupBy("source").agg(F.round(F.sum("vw") / F.sum("w"), 6).alias("weighted"), F.round(F.avg(F.col("vw") / F.col("w")), 6).alias("pooled"))


def a33_agreement(spark, d):
    """How often two deliveries of a revision agree, field by field."""
    fields = ["user_text", "byte_size", "sha1", "is_minor"]
    own = table(spark, d, "revisions").filter("revision_id IS NOT NULL").groupBy("revision_id").agg(F.min(F.struct("fetched_at", *fields)).alias("a"), F.max(F.struct("fetched_at", *fields)).alias("b")).filter("a.fetched_at < b.fetched_at")
    return own.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).cast("double")), 6).alias(c) for c in fields], F.round(F.avg(F.abs(F.col("a.byte_size") - F.col("b.byte_size"))), 4).alias("byte_size_off"))


def pred_p15_calendar_titles(spark, d):
    month = "January|February|March|April|May|June|July|August|September|October|November|December"
    return docs(spark, d).select("doc_id", F.trim(F.regexp_extract("text", "Page: ([^\n]*)", 1)).alias("title")).filter("title <> ''").select("doc_id", F.col("title").rlike(f"^({month})[ _][0-9]{{1,2}}$").alias("calendar"))


def d2_nearest_year(spark, d):
    near = F.lit("2026-01-15").cast("date")
    return table(spark, d, "forecast_days").select("page_id", "date", X.nearest_year(F.month("date"), F.dayofmonth("date"), near).alias("nearest"))


def d3_relative_days(spark, d):
    """When the day of a text falls, and when a span from it falls, seen from a day."""
    ahead = F.datediff(F.lit(DAY).cast("date"), F.col("day")) * F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-7)
    until = ahead + (F.col("doc_id") % 9).cast("int")
    return docs(spark, d).filter("day IS NOT NULL").select("doc_id", X.relative_day(ahead).alias("phrase"), X.relative_span(ahead, until).alias("span"))


def d4_past_year(spark, d):
    """The latest year a title names, if all are before the row's; a season's second year counts."""
    found = F.regexp_extract_all(F.translate("title", "_", " "), F.lit(r"\b(?:1[0-9]{3}|20[0-9]{2})(?:[–-][0-9]{2})?\b"), F.lit(0))
    years = F.transform(found, lambda y: F.when(F.length(y) > 4, F.concat(F.substring(y, 1, 2), F.substring(y, -2, 2))).otherwise(y).cast("bigint"))
    firsts = F.transform(found, lambda y: F.substring(y, 1, 4).cast("bigint"))
    rows = table(spark, d, "titles").select("revision_id", "date", F.array_max(F.concat(years, firsts)).alias("y"))
    return rows.withColumn("past_year", F.when(F.col("y") < F.year("date"), F.col("y"))).drop("y")


def d8_known_at(spark, d):
    moment = F.col("date").cast("timestamp_ntz") - F.expr("INTERVAL 1 SECOND")
    return table(spark, d, "forecast_days").select("page_id", "date", moment.alias("known_at"))


def d10_months(spark, d):
    return spark.range(1).select(F.explode(F.expr("sequence(DATE'2023-11-01', DATE'2026-08-01', INTERVAL 1 MONTH)")).alias("m")).select(F.substring(F.col("m").cast("string"), 1, 7).alias("month"))


def s8_page_as_of(spark, d):
    """The last revision of each page before a moment."""
    own = first_delivery(table(spark, d, "revisions"), ["page_id", "timestamp"]).filter("page_id IS NOT NULL AND timestamp < TIMESTAMP_NTZ'2026-07-10 12:00:00'")
    return own.groupBy("page_id").agg(F.max(F.struct("timestamp", "revision_id"))["revision_id"].alias("revision_id"))


def m10_json(spark, d):
    """Rows through JSON and back."""
    schema = "page_id bigint, date date, editors int"
    own = table(spark, d, "burst_days").distinct().select(F.to_json(F.struct("page_id", "date", "editors")).alias("j"))
    return own.select(F.from_json("j", schema).alias("r")).select("r.*")


def t2_word_diff(spark, d):
    w = U.word_diff("old", "new")
    return pairs(spark, d).select("page_id", "day", w.alias("w")).select("page_id", "day", "w.*")


def t3_line_diff(spark, d):
    return pairs(spark, d).select("page_id", "day", U.line_diff("old", "new").alias("w")).select("page_id", "day", "w.*")


def t4_plain_text(spark, d):
    return docs(spark, d).select("doc_id", U.plain_text("text").alias("plain"))


def t5_prose(spark, d):
    return docs(spark, d).select("doc_id", U.prose("text").alias("pieces"))


def t10_lead(spark, d):
    return docs(spark, d).select("doc_id", U.lead("text").alias("lead"))


def t15_day_change(spark, d):
    return pairs(spark, d).select("page_id", "day", U.day_change("old", "new").alias("w")).select("page_id", "day", "w.*")


def d1_mark_dates(spark, d):
    return docs(spark, d).filter("day IS NOT NULL").select("doc_id", U.mark_dates("text", "day").alias("marked"))


def pred_p5_base36_hashes(spark, d):
    digest = F.sha1(F.col("sha1").cast("binary"))
    return Q.log(spark, d).filter("sha1 IS NOT NULL").select("revision_id", U.sha1_base36(digest).alias("hash"))


QUERIES = {f.__name__: f for f in (t1_pieces, t6_sentences, t7_words, a18_document_frequency, k5_relevant_sentences, w21_within_budget, u6_word_jaccard, u7_shown_words, t8_names_page, t9_headings, t11_sections, t18_cut, t28_title_key, w19_news_items, k3_main_sections, a23_forecast_scores, a23_forecast_summary, a24_common_kinds, a25_kind_marginals, a26_best_threshold, a27_weighted_mean, a33_agreement, pred_p15_calendar_titles, d2_nearest_year, d3_relative_days, d4_past_year, d8_known_at, d10_months, s8_page_as_of, m10_json, t2_word_diff, t3_line_diff, t4_plain_text, t5_prose, t10_lead, t15_day_change, d1_mark_dates, pred_p5_base36_hashes)}

_D = "WITH t AS (SELECT * FROM documents WHERE text IS NOT NULL)"
_SENT = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \\t\\r\\n\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 25)"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z][a-z''-]{{3,}}'))"
_PAIRS = _D + ", p AS (SELECT page_id, day, arg_min(text, doc_id) AS old, arg_max(text, doc_id) AS new FROM t WHERE page_id IS NOT NULL AND day IS NOT NULL GROUP BY ALL HAVING count(*) > 1), w AS (SELECT page_id, day, " + _WORDS.format("old") + " AS a, " + _WORDS.format("new") + " AS b FROM p), x AS (SELECT *, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM w)"
_DF = _D + ", n AS (SELECT count(*) AS n FROM t), df AS (SELECT word, count(*) AS df FROM (SELECT unnest(" + _WORDS.format("text") + ") AS word FROM t) GROUP BY word), fr AS (SELECT word, df, round(ln(1 + n / (1 + df)::DOUBLE), 6) AS idf, df < 0.02 * n AS content FROM df, n)"
_LINES = _D + ", ll AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS n, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM t))"
_HEAD = _LINES + ", hd AS (SELECT doc_id, n, length(regexp_extract(line, '^(={2,6})[^=]', 1)) AS level, trim(regexp_replace(line, '^=+|=+\\s*$', '', 'g'), ' ') AS title, length(regexp_extract(line, '[^=](={2,6})\\s*$', 1)) AS closed FROM ll), h AS (SELECT doc_id, n, level, title FROM hd WHERE level > 0 AND closed = level)"
_SEC = _HEAD + ", s0 AS (SELECT l.doc_id, l.line, h.title, coalesce(last_value(h.title IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.n), '(lead)') AS section FROM ll l LEFT JOIN h USING (doc_id, n)), se AS (SELECT doc_id, section, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM s0 WHERE title IS NULL GROUP BY ALL)"
_NEWS = _LINES + """, b0 AS (SELECT doc_id, n, regexp_extract(line, '^''''''(.*?)''''''\\s*$', 1) AS category, regexp_extract(line, '^(\\*+)\\s*(.*)$', 1) AS stars, regexp_extract(line, '^(\\*+)\\s*(.*)$', 2) AS body FROM ll WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'current_events')),
    b1 AS (SELECT *, trim(regexp_replace(regexp_replace(body, '\\[https?://[^\\]]*\\]', '', 'g'), '\\[\\[(?:[^\\[\\]|]*\\|)?([^\\[\\]]*)\\]\\]', '\\1', 'g')) AS label, stars <> '' AND coalesce(lead(length(stars)) OVER (PARTITION BY doc_id ORDER BY n), 0) > length(stars) AS topic_line FROM b0 WHERE category <> '' OR stars <> ''),
    b2 AS (SELECT *, coalesce(last_value(nullif(category, '') IGNORE NULLS) OVER w, '') AS c, coalesce(CASE WHEN length(stars) > 1 THEN last_value(CASE WHEN topic_line THEN label WHEN category <> '' THEN '' END IGNORE NULLS) OVER w END, '') AS tp FROM b1 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    nw AS (SELECT b2.doc_id, n, c AS category, tp AS topic, label AS sentence, day FROM b2 JOIN documents USING (doc_id) WHERE stars <> '' AND NOT topic_line AND label <> '')"""
_FC = ", f0 AS (SELECT doc_id AS id, page_id, list_filter(list_transform(string_split(regexp_extract(text, 'Expected: ([^\\n]*)', 1), ';'), lambda s: trim(s)), lambda s: s <> '') AS a FROM t WHERE source = 'outlook' AND page_id IS NOT NULL), fc AS (SELECT id, page_id, list_filter(a, lambda s, i: list_position(a, s) = i)[1:3] AS named FROM f0)"
_CH = ", c0 AS (SELECT t.page_id, section, CAST(sum(chars) AS BIGINT) AS chars FROM se JOIN t USING (doc_id) WHERE t.source = 'article' AND t.page_id IS NOT NULL GROUP BY ALL), ch AS (SELECT page_id, list(section ORDER BY chars DESC, section) AS changed FROM c0 GROUP BY page_id)"
_SCORE = _SEC + _FC + _CH + ", sc AS (SELECT id, round(CASE WHEN len(named) > 0 THEN len(list_intersect(named, changed)) / len(named)::DOUBLE END, 6) AS section_precision, CASE WHEN len(changed) > 0 THEN list_contains(named, changed[1])::INT::DOUBLE END AS main_section_hit, round(len(list_intersect(named, changed)) / len(list_distinct(list_concat(named, changed)))::DOUBLE, 6) AS jaccard FROM fc JOIN ch USING (page_id))"
_KM = _D + _FC + ", li AS (SELECT id, mask, exp(-((id * 7 + mask * 13) % 101) / 20.0) AS p FROM fc, (SELECT unnest(range(512)) AS mask)), km AS (SELECT id, kind, round(sum(CASE WHEN (mask >> kind) & 1 = 1 THEN p ELSE 0 END) / sum(p), 6) AS p FROM li, (SELECT unnest(range(9)) AS kind) GROUP BY ALL)"
_FAR = "CASE WHEN abs(k) <= 60 THEN abs(k) || ' days' WHEN abs(k) < 365 THEN 'about ' || CAST(round(abs(k) / 30.4) AS INT) || ' months' WHEN round(abs(k) / 365.25) = 1 THEN 'about a year' ELSE 'about ' || CAST(round(abs(k) / 365.25) AS INT) || ' years' END"
_AT = f"CASE WHEN k = 0 THEN 'today' WHEN k = 1 THEN 'tomorrow' WHEN k = -1 THEN 'yesterday' WHEN k > 0 THEN 'in ' || {_FAR} ELSE {_FAR} || ' ago' END"
#: 160 bits as two halves, divided by 36 step by step.
_HALF = "list_reduce(list_transform(range({0}, {1}), lambda i: strpos('0123456789abcdef', substring(d, i::INT, 1))::HUGEINT - 1), lambda a, v: a * 16 + v)"
_NEXT = "((a.hi % 36) * 1208925819614629174706176::HUGEINT + a.lo)"
_BASE36 = ", k AS (SELECT revision_id, sha1(sha1) AS d FROM o WHERE sha1 IS NOT NULL), n AS (SELECT revision_id, " + _HALF.format(1, 21) + " AS hi, " + _HALF.format(21, 41) + " AS lo FROM k), z AS (SELECT revision_id, list_reduce(list_prepend({'hi': hi, 'lo': lo, 's': ''}, list_transform(range(31), lambda i: {'hi': 0::HUGEINT, 'lo': 0::HUGEINT, 's': ''})), lambda a, v: {'hi': a.hi // 36, 'lo': " + _NEXT + " // 36, 's': substring('0123456789abcdefghijklmnopqrstuvwxyz', (" + _NEXT + " % 36)::INT + 1, 1) || a.s}) AS r FROM n)"

SQL = {
    "t1_pieces": _D + " SELECT doc_id, len(regexp_extract_all(text, '[ \\t\\r\\n\\f\\x0B]+|[^ \\t\\r\\n\\f\\x0B]+')) AS n, true AS same FROM t",
    "t6_sentences": _D + ", s AS (SELECT doc_id, " + _SENT.format("text") + " AS a FROM t) SELECT doc_id, len(a) AS n, a[1] AS first FROM s",
    "t7_words": _D + " SELECT doc_id, len(" + _WORDS.format("text") + ") AS n FROM t",
    "a18_document_frequency": _DF + " SELECT * FROM fr",
    "k5_relevant_sentences": _DF + ", q0 AS (SELECT doc_id AS id, page_id, text, trim(regexp_extract(text, 'Page: ([^\\n]*)', 1)) AS title FROM t WHERE source = 'outlook' AND page_id IS NOT NULL), q AS (SELECT id, page_id, unnest(" + _WORDS.format("text") + ") AS word FROM q0), c0 AS (SELECT page_id, doc_id, generate_subscripts(a, 1) - 1 AS n, unnest(a) AS sentence FROM (SELECT page_id, doc_id, " + _SENT.format("text") + " AS a FROM t WHERE source <> 'outlook' AND page_id IS NOT NULL)), cs AS (SELECT page_id, doc_id * 100000 + n AS sentence_id, sentence FROM c0), c AS (SELECT page_id, sentence_id, len(" + _WORDS.format("sentence") + ") AS size, unnest(" + _WORDS.format("sentence") + ") AS word FROM cs),"
    " m AS (SELECT id, sentence_id, count(*) AS shared, round(sum(idf) / sqrt(any_value(size) + 1), 4) AS score FROM q JOIN fr USING (word) JOIN c USING (page_id, word) WHERE content GROUP BY ALL),"
    " nm AS (SELECT DISTINCT id, page_id, name FROM (SELECT id, page_id, replace(title, '_', ' ') AS name FROM q0 UNION ALL SELECT id, page_id, regexp_replace(replace(title, '_', ' '), '[ \\t\\n\\r\\f\\v]*\\([^)]*\\)$', '') FROM q0) WHERE length(name) >= 4), h AS MATERIALIZED (SELECT id, sentence_id, sentence, name FROM nm JOIN cs USING (page_id) WHERE contains(sentence, name)), na AS (SELECT DISTINCT id, sentence_id, true AS named FROM h WHERE regexp_matches(sentence, '(^|[^\\pL\\pN_])' || regexp_escape(name) || '($|[^\\pL\\pN_])')),"
    " b AS (SELECT id, sentence_id, coalesce(shared, 0) AS shared, coalesce(score, 0) AS score, coalesce(named, false) AS named FROM m FULL JOIN na USING (id, sentence_id)) SELECT id, sentence_id, shared, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY named DESC, score DESC, sentence_id) AS rank FROM b WHERE named OR shared >= 2) WHERE rank <= 8",
    "w21_within_budget": _D + ", s AS (SELECT doc_id, list_reduce(list_prepend({'l': 0, 'used': 0, 'n': 0}, list_transform(" + _SENT.format("text") + ", lambda s: {'l': length(s)::INT, 'used': 0, 'n': 0})), lambda a, x: {'l': 0, 'used': a.used + CASE WHEN a.used + x.l <= 450 THEN x.l ELSE 0 END, 'n': a.n + CASE WHEN a.used + x.l <= 450 THEN 1 ELSE 0 END}) AS r FROM t) SELECT doc_id, r.n::BIGINT AS n, r.used::BIGINT AS chars FROM s",
    "u6_word_jaccard": _PAIRS + " SELECT page_id, day, round(CASE WHEN u = 0 THEN 1 ELSE i / u::DOUBLE END, 6) AS jaccard FROM x",
    "u7_shown_words": _PAIRS + " SELECT page_id, day, round(CASE WHEN len(b) > 0 THEN i / len(b)::DOUBLE END, 6) AS share FROM x",
    "t8_names_page": _D + ", tt AS (SELECT DISTINCT replace(title, '_', ' ') AS full_name FROM titles WHERE title IS NOT NULL), nm AS (SELECT DISTINCT name FROM (SELECT full_name AS name FROM tt UNION ALL SELECT regexp_replace(full_name, '[ \\t\\n\\r\\f\\v]*\\([^)]*\\)$', '') FROM tt) WHERE length(name) >= 4)"
    ", h AS MATERIALIZED (SELECT doc_id, text, name FROM t, nm WHERE contains(text, name)) SELECT doc_id, count(*) AS names FROM h WHERE regexp_matches(text, '(^|[^\\pL\\pN_])' || regexp_escape(name) || '($|[^\\pL\\pN_])') GROUP BY doc_id",
    "t9_headings": _HEAD + " SELECT doc_id, n, level, title FROM h",
    "t11_sections": _SEC + " SELECT * FROM se",
    "t18_cut": _D + ", f AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')) AS x FROM t) SELECT doc_id, CASE WHEN length(x) <= 120 THEN x ELSE regexp_replace(substring(x, 1, 120), ' [^ ]*$', '') || ' …' END AS cut FROM f",
    "t28_title_key": "SELECT revision_id, date, replace(title_then, '_', ' ') AS title FROM titles",
    "w19_news_items": _NEWS + " SELECT doc_id, n, category, topic, sentence FROM nw",
    "k3_main_sections": _SEC + _CH + " SELECT page_id, array_to_string(changed[1:3], '|') AS main FROM ch",
    "a23_forecast_scores": _SCORE + " SELECT * FROM sc",
    "a23_forecast_summary": _SCORE + " SELECT round(avg(section_precision), 6) AS section_precision, round(avg(main_section_hit), 6) AS main_section_hit, round(avg(jaccard), 6) AS jaccard, count(*) AS n FROM sc",
    "a24_common_kinds": _KM + " SELECT kind, count(*) AS n FROM km WHERE p >= 0.5 GROUP BY kind HAVING count(*) > 0.1 * (SELECT count(*) FROM fc)",
    "a25_kind_marginals": _KM + " SELECT * FROM km",
    "a27_weighted_mean": _D + ", v AS (SELECT source, lang, length(text) AS w, len(" + _WORDS.format("text") + ") AS n FROM t WHERE source IS NOT NULL AND lang IS NOT NULL AND length(text) > 0), r AS (SELECT source, lang, sum(n)::DOUBLE AS vw, sum(w)::DOUBLE AS w FROM v GROUP BY ALL) SELECT source, round(sum(vw) / sum(w), 6) AS weighted, round(avg(vw / w), 6) AS pooled FROM r GROUP BY source",
    "a33_agreement": "WITH a AS (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY fetched_at) AS i, row_number() OVER (PARTITION BY revision_id ORDER BY fetched_at DESC) AS j FROM revisions WHERE revision_id IS NOT NULL) SELECT count(*) AS n, " + ", ".join(f"round(avg((x.{c} IS NOT DISTINCT FROM y.{c})::INT), 6) AS {c}" for c in ("user_text", "byte_size", "sha1", "is_minor")) + ", round(avg(abs(x.byte_size - y.byte_size)), 4) AS byte_size_off FROM a x JOIN a y ON x.revision_id = y.revision_id AND x.i = 1 AND y.j = 1 AND x.fetched_at < y.fetched_at",
    "pred_p15_calendar_titles": _D + ", y AS (SELECT doc_id, trim(regexp_extract(text, 'Page: ([^\\n]*)', 1)) AS title FROM t) SELECT doc_id, regexp_matches(title, '^(January|February|March|April|May|June|July|August|September|October|November|December)[ _][0-9]{1,2}$') AS calendar FROM y WHERE title <> ''",
    "d2_nearest_year": "WITH c AS (SELECT page_id, date, try_cast(y || strftime(date, '-%m-%d') AS DATE) AS x FROM forecast_days, (SELECT unnest([2025, 2026, 2027]) AS y)) SELECT page_id, date, arg_min(x, (abs(x - DATE '2026-01-15'), x)) AS nearest FROM c GROUP BY ALL",
    "d3_relative_days": _D + f", z AS (SELECT doc_id, (DATE '{DAY}' - day) * CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -7 END AS k, doc_id % 9 AS m FROM t WHERE day IS NOT NULL), y AS (SELECT doc_id, k, k + m AS e, {_AT} AS phrase FROM z), x AS (SELECT doc_id, e, phrase, k AS b FROM y), w AS (SELECT doc_id, b, phrase, e AS k FROM x) SELECT doc_id, phrase, CASE WHEN b = k THEN phrase WHEN b > 0 THEN 'starts ' || phrase WHEN k < 0 THEN 'ended ' || {_AT} WHEN b = 0 THEN 'starts today, ends ' || {_AT} ELSE 'under way, ends ' || {_AT} END AS span FROM w",
    "d4_past_year": "WITH y AS (SELECT revision_id, date, regexp_extract_all(replace(title, '_', ' '), '\\b(?:1[0-9]{3}|20[0-9]{2})(?:[–-][0-9]{2})?\\b') AS a FROM titles), z AS (SELECT revision_id, date, list_max(list_concat(list_transform(a, lambda s: CAST(left(s, 4) AS BIGINT)), list_transform(a, lambda s: CAST(CASE WHEN length(s) > 4 THEN left(s, 2) || right(s, 2) ELSE s END AS BIGINT)))) AS y FROM y) SELECT revision_id, date, CASE WHEN y < year(date) THEN y END AS past_year FROM z",
    "d8_known_at": "SELECT page_id, date, CAST(date AS TIMESTAMP) - INTERVAL 1 SECOND AS known_at FROM forecast_days",
    "d10_months": "SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2026-08-01', INTERVAL 1 MONTH)) AS m)",
    "s8_page_as_of": Q.REVISION + " SELECT page_id, arg_max(revision_id, (timestamp, revision_id)) AS revision_id FROM r WHERE page_id IS NOT NULL AND timestamp < TIMESTAMP '2026-07-10 12:00:00' GROUP BY page_id",
    "pred_p5_base36_hashes": Q.LOG + _BASE36 + " SELECT revision_id, r.s AS hash FROM z",
    "m10_json": "SELECT page_id, date, editors FROM (SELECT DISTINCT * FROM burst_days)",
}

"""Queries on news lists, section candidates, steps of a job and parts of forecasts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import arrow as U
from palimpsest.functions import news as N
from palimpsest.functions.changes import BETWEEN, KINDS
from palimpsest.jobs import Step, run_steps
from palimpsest.plans import text as X_
from palimpsest.plans.text import DAY
from palimpsest.shared import table, write_shared
from palimpsest.sources import dumps

WEEK, RECENT = 60, 30  # the tables are thin: reports of two months stand for a week's


def _reports(spark, d):
    return N.news_reports(table(spark, d, "documents").filter("source = 'current_events' AND text IS NOT NULL"))


def r16_portal_items(spark, d):
    """The cleaned reports of the news lists, with their paths."""
    return _reports(spark, d).select("doc_id", "n", "category", F.array_join("topics", N.BETWEEN).alias("topics"), "sentence")


def t30_split_items(spark, d):
    """Reports as one line and split again."""
    line = F.concat_ws(N.BETWEEN, F.nullif("category", F.lit("")), F.nullif(F.array_join("topics", N.BETWEEN), F.lit("")), "sentence")
    parts = F.split(line, N.BETWEEN)
    return _reports(spark, d).select("doc_id", "n", F.element_at(parts, -1).alias("sentence"), F.size(parts).cast("bigint").alias("parts"))


def a31_stories(spark, d):
    return N.stories(N.story_reports(_reports(spark, d), DAY, WEEK), DAY, RECENT)


def l15_story_blocks(spark, d):
    return N.story_blocks(write_shared(N.story_reports(_reports(spark, d), DAY, WEEK), "reports"), DAY, RECENT)


def l17_reports_between(spark, d):
    return N.reports_of(_reports(spark, d), "2026-07-01", "2026-07-31").groupBy("topic").agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("day").alias("days"))


def _titles(spark, d):
    """Of each article the lead and its headings, in order and each once."""
    heads = X_.t9_headings(spark, d).filter("title <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "title"))).alias("h"))
    own = X_.docs(spark, d).filter("source = 'article'").select("doc_id").join(heads, "doc_id", "left")
    titles = F.coalesce(F.transform("h", lambda x: x["title"]), F.array().cast("array<string>"))
    return own.select("doc_id", F.array_distinct(F.concat(F.array(F.lit("(lead)")), titles)).alias("candidates"))


def m6_section_candidates(spark, d):
    """What a forecast of sections can begin with: each candidate followed by another one or by the end of the line."""
    ends = F.flatten(F.transform("candidates", lambda s: F.array(F.concat(F.lit(" "), s, F.lit(";")), F.concat(F.lit(" "), s, F.lit("\n")))))
    return _titles(spark, d).select("doc_id", F.size("candidates").cast("bigint").alias("candidates"), F.array_join(ends, "|").alias("continuations"))


def m7_trie(spark, d):
    """The continuations' words as a tree in which shared beginnings are one node: each node with its parent, depth and the sequences through it."""
    words = _titles(spark, d).select(F.explode("candidates").alias("c")).select(F.split("c", " +").alias("w"))
    nodes = words.select(F.explode(F.transform("w", lambda x, i: F.slice("w", 1, i + 1))).alias("path")).groupBy(F.array_join("path", " ").alias("node"), F.size("path").alias("depth")).agg(F.count(F.lit(1)).alias("sequences"))
    return nodes.select("node", F.when(F.col("depth") > 1, F.regexp_replace("node", " [^ ]*$", "")).alias("parent"), F.col("depth").cast("bigint").alias("depth"), "sequences")


def l12_tree_scores(spark, d):
    """Each candidate's log-probability in the tree of all, summed along its nodes by joins, and its loss for each word. A node's probability is its share of its parent's sequences."""
    tree = write_shared(m7_trie(spark, d), "tree")
    roots = tree.filter("depth = 1").agg(F.sum("sequences")).first()[0] or 0
    parents = tree.select(F.col("node").alias("parent"), F.col("sequences").alias("of"))
    steps = tree.join(parents, "parent", "left").select("node", F.log(F.col("sequences") / F.coalesce("of", F.lit(roots))).alias("logprob"))
    words = _titles(spark, d).select(F.explode("candidates").alias("candidate")).distinct().withColumn("w", F.split("candidate", " +"))
    paths = words.select("candidate", F.size("w").alias("n"), F.explode(F.transform("w", lambda x, i: F.array_join(F.slice("w", 1, i + 1), " "))).alias("node"))
    out = paths.join(steps, "node").groupBy("candidate", "n").agg(F.sum("logprob").alias("logprob"))
    return out.select("candidate", F.round("logprob", 6).alias("logprob"), F.round(-F.col("logprob") / F.col("n"), 6).alias("loss"))


def m5_kind_lines(spark, d):
    """Every set of kinds that a forecast can list, as its line."""
    names = F.array(*[F.when(F.expr(f"(shiftright(id, {i}) & 1) = 1"), F.lit(k)) for i, k in enumerate(KINDS)])
    line = F.array_join(F.array_compact(names), ", ")
    return spark.range(1 << len(KINDS)).select(F.col("id").alias("mask"), F.concat(F.lit(" "), F.when(line == "", "none").otherwise(line), F.lit("\n")).alias("line"))


def _headers(spark, d):
    """Forecasts as the two lines they are written in: sections as named, kinds by threshold."""
    kinds = X_._marginals(spark, d).filter("p >= 0.5").groupBy("id").agg(F.array_sort(F.collect_list("kind")).alias("k"))
    name = F.array(*map(F.lit, KINDS))
    listed = F.array_join(F.transform("k", lambda i: name[i]), ", ")
    rows = X_._forecasts(spark, d).select("id", "named").join(kinds, "id", "left")
    none = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "none").otherwise(c)
    return rows.select("id", F.concat(F.lit("Sections: "), none(F.array_join("named", "; ")), F.lit("\nKinds: "), none(listed), F.lit("\n")).alias("header"))


def t19_headers(spark, d):
    return _headers(spark, d)


def t20_parsed_headers(spark, d):
    """The sections and kinds of headers: up to three distinct sections, known kinds in their order."""
    field = lambda key: F.regexp_extract("header", rf"(?m)^{key}:[ ]*(.*)$", 1)
    parts = lambda key, sep: F.filter(F.transform(F.split(field(key), sep), lambda s: F.trim(s)), lambda s: (s != "") & (s != "none"))
    sections = F.slice(F.array_distinct(parts("Sections", ";")), 1, 3)
    kinds = F.array_intersect(F.array(*map(F.lit, KINDS)), parts("Kinds", ","))
    return _headers(spark, d).select("id", F.array_join(sections, "|").alias("sections"), F.array_join(kinds, "|").alias("kinds"))


def t13_span_sections(spark, d):
    """The sections that the inserted spans of page-days go into; moved text is left out."""
    spans = X_.pairs(spark, d).select("page_id", "day", F.explode(U.span_sections("old", "new")).alias("s"))
    return spans.select("page_id", "day", "s.span", "s.sections")


def t14_new_spans(spark, d):
    return X_.pairs(spark, d).select("page_id", "day", U.new_spans("old", "new").alias("s")).select("page_id", "day", "s.*")


def t17_edit_context(spark, d):
    """Where the first change of each page-day lies: its section and the text around it."""
    first = U.word_diff("old", "new")["first_offset"]
    rows = X_.pairs(spark, d).withColumn("offset", first).filter("offset IS NOT NULL")
    return rows.select("page_id", "day", U.edit_context("old", "offset").alias("c")).select("page_id", "day", "c.*")


def r8_joined_spans(spark, d):
    """Inserted and removed text of page-days on one line each."""
    rows = X_.pairs(spark, d).select("page_id", "day", U.word_diff("old", "new").alias("w"))
    return rows.select("page_id", "day", F.array_join("w.inserted", BETWEEN).alias("added"), F.array_join("w.removed", BETWEEN).alias("gone"))


def s6_fetched_texts(spark, d):
    """Texts of the titles' revisions, fetched by an injected client in batches; a revision that the client lacks has none."""
    ids = table(spark, d, "titles").select("revision_id").dropna().distinct()
    return dumps.fetch_by_batches(ids, lambda asked: {i: f"text of revision {i}" for i in asked if i > 0}, 50)


def l11_daily_steps(spark, d):
    """The day's steps, one of which fails: those that need it are skipped, the others run."""
    bursts = table(spark, d, "burst_days")
    steps = [
        Step("inputs", lambda done: bursts.count()),
        Step("ranking", lambda done: bursts.filter("editors IS NOT NULL").count(), ("inputs",)),
        Step("broken", lambda done: bursts.select("no_such_column").count(), ("inputs",)),
        Step("report", lambda done: done["broken"], ("broken", "ranking")),
        Step("score", lambda done: bursts.filter("is_burst").count(), ("ranking",)),
    ]
    return spark.createDataFrame([(r.name, r.state) for r in run_steps(steps)], "step string, state string")


_NAMES = (r16_portal_items, t30_split_items, a31_stories, l15_story_blocks, l17_reports_between, m6_section_candidates, m7_trie, l12_tree_scores, m5_kind_lines, t19_headers, t20_parsed_headers, t13_span_sections, t14_new_spans, t17_edit_context, r8_joined_spans, s6_fetched_texts, l11_daily_steps)
QUERIES = {f.__name__: f for f in _NAMES}

_CLEAN = "trim(regexp_replace(replace(replace(regexp_replace(regexp_replace({0}, '\\[https?://[^\\]]*\\]', '', 'g'), '\\[\\[(?:[^\\[\\]|]*\\|)?([^\\[\\]]*)\\]\\]', '\\1', 'g'), '''''''', ''), '''''', ''), ' {{2,}}', ' ', 'g'), ' ')"
_REPORTS = X_._LINES + f""", k0 AS (SELECT doc_id, n, CASE WHEN regexp_matches(line, '^''''''(.*?)''''''\\s*$') THEN 0 ELSE length(regexp_extract(line, '^(\\*+)', 1)) END AS depth, CASE WHEN regexp_matches(line, '^''''''(.*?)''''''\\s*$') THEN regexp_extract(line, '^''''''(.*?)''''''\\s*$', 1) ELSE regexp_extract(line, '^\\*+\\s*(.*)$', 1) END AS said
        FROM ll WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'current_events') AND (starts_with(line, '*') OR regexp_matches(line, '^''''''(.*?)''''''\\s*$'))),
    k1 AS (SELECT doc_id, n, depth, {_CLEAN.format('said')} AS said, depth > 0 AND coalesce(lead(depth) OVER (PARTITION BY doc_id ORDER BY n), 0) > depth AS topic, coalesce(max(CASE WHEN depth = 0 THEN n END) OVER (PARTITION BY doc_id ORDER BY n), -1) AS since FROM k0),
    k2 AS (SELECT doc_id, n, depth, since, said AS sentence FROM k1 WHERE depth > 0 AND NOT topic AND said <> ''),
    k3 AS (SELECT i.doc_id, i.n, list(t.said ORDER BY t.n) AS topics FROM k2 i JOIN k1 t ON t.doc_id = i.doc_id AND t.topic AND t.n < i.n AND t.n > i.since AND t.depth < i.depth AND NOT EXISTS (SELECT 1 FROM k1 b WHERE b.doc_id = i.doc_id AND b.n > t.n AND b.n < i.n AND b.depth <= t.depth) GROUP BY ALL),
    rp AS (SELECT i.doc_id, documents.day, i.n, coalesce(c.said, '') AS category, coalesce(topics, []) AS topics, sentence FROM k2 i JOIN documents USING (doc_id) LEFT JOIN k3 USING (doc_id, n) LEFT JOIN k1 c ON c.doc_id = i.doc_id AND c.n = i.since)"""
_STORY = _REPORTS + f""", wk AS (SELECT *, row_number() OVER () AS id FROM rp WHERE len(topics) > 0 AND day < DATE '{DAY}' AND day >= DATE '{DAY}' - {WEEK}), ft AS (SELECT DISTINCT topics[1] AS story FROM wk),
    ch AS (SELECT id, max(pos) AS pos FROM (SELECT id, generate_subscripts(topics, 1) AS pos, unnest(topics) AS story FROM wk) JOIN ft USING (story) GROUP BY id),
    sr AS (SELECT topics[pos] AS story, day, array_to_string(list_append(topics[pos + 1:], sentence), ' › ') AS report, min(category) AS category FROM wk JOIN ch USING (id) GROUP BY ALL),
    md AS (SELECT story, category, row_number() OVER (PARTITION BY story ORDER BY count(*) DESC, category) AS i FROM sr GROUP BY story, category),
    st AS (SELECT sr.story, count(*) AS reports, count(*) FILTER (day >= DATE '{DAY}' - {RECENT}) AS recent, max(day) AS latest, any_value(md.category) AS category FROM sr JOIN md ON md.story = sr.story AND md.i = 1 GROUP BY sr.story HAVING count(*) FILTER (day >= DATE '{DAY}' - {RECENT}) > 0)"""
_SAY = lambda c: f"(CASE WHEN {c} = DATE '{DAY}' THEN 'today' WHEN {c} = DATE '{DAY}' - 1 THEN 'yesterday' ELSE " + X_._FAR.replace("k", f"(DATE '{DAY}' - {c})") + " || ' ago' END)"
_TITLES = X_._HEAD + ", tl AS (SELECT t.doc_id, list_filter(a, lambda s, i: list_position(a, s) = i) AS c FROM t JOIN (SELECT t.doc_id, list_concat(['(lead)'], coalesce(list(h.title ORDER BY h.n) FILTER (h.title IS NOT NULL AND h.title <> ''), [])) AS a FROM t LEFT JOIN h USING (doc_id) GROUP BY t.doc_id) USING (doc_id) WHERE t.source = 'article')"
_KIND = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
_HEADER = X_._KM + f", kl AS (SELECT id, list({_KIND} ORDER BY kind) AS k FROM km WHERE p >= 0.5 GROUP BY id), hh AS (SELECT id, named, coalesce(k, []) AS k FROM fc LEFT JOIN kl USING (id))"

SQL = {
    "r16_portal_items": _REPORTS + " SELECT doc_id, n, category, array_to_string(topics, ' › ') AS topics, sentence FROM rp",
    "t30_split_items": _REPORTS + ", s AS (SELECT doc_id, n, string_split(concat_ws(' › ', nullif(category, ''), nullif(array_to_string(topics, ' › '), ''), sentence), ' › ') AS a FROM rp) SELECT doc_id, n, a[-1] AS sentence, len(a) AS parts FROM s",
    "a31_stories": _STORY + " SELECT * FROM st",
    "l15_story_blocks": _STORY + f", ln AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY day DESC, report DESC) AS i FROM sr), bl AS (SELECT story, string_agg('[' || {_SAY('day')} || '] ' || substring(report, 1, 300), chr(10) ORDER BY i DESC) AS lines FROM ln WHERE i <= 6 GROUP BY story) SELECT story, story || ' (' || category || '): ' || reports || ' reports, the latest ' || {_SAY('latest')} || chr(10) || lines AS block FROM st JOIN bl USING (story)",
    "l17_reports_between": _REPORTS + ", u AS (SELECT DISTINCT topic, day, array_to_string(list_append(topics[list_position(topics, topic) + 1:], sentence), ' › ') AS report FROM (SELECT day, topics, sentence, unnest(list_distinct(topics)) AS topic FROM rp WHERE day BETWEEN DATE '2026-07-01' AND DATE '2026-07-31') WHERE topic <> '') SELECT topic, count(*) AS reports, count(DISTINCT day) AS days FROM u GROUP BY topic",
    "m6_section_candidates": _TITLES + " SELECT doc_id, len(c) AS candidates, array_to_string(list_transform(c, lambda s: ' ' || s || ';|' || ' ' || s || chr(10)), '|') AS continuations FROM tl",
    "m7_trie": _TITLES + ", w AS (SELECT regexp_split_to_array(s, ' +') AS a FROM (SELECT unnest(c) AS s FROM tl)), p AS (SELECT array_to_string(a[1:i], ' ') AS node, i AS depth FROM (SELECT a, unnest(range(1, len(a) + 1)) AS i FROM w)) SELECT node, CASE WHEN depth > 1 THEN regexp_replace(node, ' [^ ]*$', '') END AS parent, depth, count(*) AS sequences FROM p GROUP BY ALL",
    "l12_tree_scores": _TITLES + ", w AS (SELECT array_to_string(regexp_split_to_array(s, ' +'), ' ') AS c, s, len(regexp_split_to_array(s, ' +')) AS n FROM (SELECT unnest(c) AS s FROM tl)), k AS (SELECT DISTINCT s, c, n FROM w), l AS (SELECT s, n, ln((SELECT count(*) FROM w WHERE w.c = k.c OR starts_with(w.c, k.c || ' ')) / (SELECT count(*) FROM w)::DOUBLE) AS logprob FROM k) SELECT s AS candidate, round(logprob, 6) AS logprob, round(-logprob / n, 6) AS loss FROM l",
    "m5_kind_lines": f"SELECT mask, ' ' || coalesce(nullif(array_to_string(list_filter([{', '.join(f'CASE WHEN (mask >> {i}) & 1 = 1 THEN {chr(39)}{k}{chr(39)} END' for i, k in enumerate(KINDS))}], lambda x: x IS NOT NULL), ', '), ''), 'none') || chr(10) AS line FROM (SELECT unnest(range(512)) AS mask)",
    "t19_headers": _HEADER + " SELECT id, 'Sections: ' || coalesce(nullif(array_to_string(named, '; '), ''), 'none') || chr(10) || 'Kinds: ' || coalesce(nullif(array_to_string(k, ', '), ''), 'none') || chr(10) AS header FROM hh",
    "t20_parsed_headers": _HEADER + " SELECT id, array_to_string(named, '|') AS sections, array_to_string(k, '|') AS kinds FROM hh",
    "s6_fetched_texts": "SELECT DISTINCT revision_id, CASE WHEN revision_id > 0 THEN 'text of revision ' || revision_id END AS text FROM titles WHERE revision_id IS NOT NULL",
    "l11_daily_steps": "SELECT * FROM (VALUES ('inputs', 'done'), ('ranking', 'done'), ('broken', 'failed'), ('report', 'skipped'), ('score', 'done')) AS v(step, state)",
}

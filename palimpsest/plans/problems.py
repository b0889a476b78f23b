"""The pN_ queries of the general problems, over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import asof, bitsliced, history, rolling, selection
from palimpsest.operators.revisions import first_delivery
from palimpsest.shared import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return selection.restored_contents(table(spark, d, "revisions"))


def p1_quantiles(spark: SparkSession, d: str) -> DataFrame:
    log = first_delivery(table(spark, d, "revisions"), ["page_id"])
    return selection.key_quantiles(log, "page_id", "revision_id", [0.25, 0.5, 0.75])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return bitsliced.wrong_features(table(spark, d, "revisions"), table(spark, d, "page_features"))


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per page as of a day with the features of every type of the log."""
    return bitsliced.wide_features(table(spark, d, "revisions"), "2026-07-15")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return asof.titles_not_known(table(spark, d, "revisions"), table(spark, d, "titles"), table(spark, d, "forecast_days"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.wrong_totals(table(spark, d, "revisions"), table(spark, d, "burst_days"), table(spark, d, "trailing_totals"))


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages of edits and burst editors over the 7 and 30 days before each published page-day."""
    found = rolling.trailing_totals(table(spark, d, "revisions"), table(spark, d, "burst_days"), table(spark, d, "trailing_totals"))
    return found.withColumnsRenamed({"entity": "page_id", "day": "date"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.changed_titles(table(spark, d, "revisions"))


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    h = history.title_history(table(spark, d, "revisions"))
    return h.select(F.col("entity").alias("page_id"), F.col("payload").alias("title"), "valid_from", "valid_to", F.col("first_tie").alias("first_revision_id"), F.col("last_tie").alias("last_revision_id"), F.col("n_updates").alias("n_revisions"))


QUERIES = {f.__name__: f for f in (p1_found, p1_quantiles, p2_found, p2_features, p3_found, p4_found, p4_totals, p5_found, p5_history)}

#: A revision: of its deliveries the first.
REVISION = "WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY fetched_at NULLS LAST) AS nth FROM revisions WHERE revision_id IS NOT NULL) WHERE nth = 1)"
_TITLE = "trim(regexp_replace({0}, '[ _]+', ' ', 'g'))"

SQL = {
    "p1_found": REVISION + """, o AS (SELECT page_id, revision_id, sha1, row_number() OVER (PARTITION BY page_id ORDER BY revision_id) AS n FROM r WHERE page_id IS NOT NULL),
        e AS (SELECT *, lag(n) OVER (PARTITION BY page_id, sha1 ORDER BY n) AS m FROM o WHERE sha1 IS NOT NULL)
        SELECT page_id, revision_id FROM e WHERE m IS NOT NULL AND m <> n - 1""",
    "p1_quantiles": REVISION + """, o AS (SELECT page_id, revision_id, row_number() OVER (PARTITION BY page_id ORDER BY revision_id) AS i, count(*) OVER (PARTITION BY page_id) AS n FROM r WHERE page_id IS NOT NULL),
        q AS (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS probability)
        SELECT page_id, probability, revision_id FROM o, q WHERE i = greatest(1, ceil(round(probability * n, 9)))""",
    "p2_found": REVISION + """, e AS (SELECT page_id, lower(trim(change_tag)) AS tag, timestamp, user_text, is_anon FROM r),
        f AS (SELECT p.page_id, p.change_tag, any_value(p.n_edits) AS ge, any_value(p.n_anon) AS ga, any_value(p.n_editors) AS gu, any_value(p.last_edit_at) AS gl, count(e.timestamp) AS n_edits,
            coalesce(sum(CASE WHEN e.is_anon THEN 1 ELSE 0 END), 0) AS n_anon, count(DISTINCT e.user_text) AS n_editors, max(e.timestamp) AS last_edit_at
            FROM page_features p LEFT JOIN e ON e.page_id = p.page_id AND e.tag = lower(trim(p.change_tag)) AND e.timestamp < CAST(p.as_of AS TIMESTAMP) GROUP BY p.page_id, p.change_tag)
        SELECT page_id, change_tag FROM f WHERE ge IS DISTINCT FROM n_edits OR ga IS DISTINCT FROM n_anon OR gu IS DISTINCT FROM n_editors OR gl IS DISTINCT FROM last_edit_at""",
    "p2_features": "SELECT * FROM (PIVOT (" + REVISION + """, e AS (SELECT page_id, lower(trim(change_tag)) AS tag, timestamp, user_text, is_anon FROM r),
        t AS (SELECT tag, replace(tag, ' ', '_') AS short, count(*) OVER (PARTITION BY replace(tag, ' ', '_')) AS n FROM (SELECT DISTINCT tag FROM e WHERE page_id IS NOT NULL AND timestamp IS NOT NULL AND tag IS NOT NULL)),
        p AS (SELECT DISTINCT page_id FROM e WHERE page_id IS NOT NULL AND timestamp < TIMESTAMP '2026-07-15')
        SELECT p.page_id, CASE WHEN t.n = 1 THEN t.short ELSE t.tag END AS tag, e.timestamp, e.user_text, e.is_anon FROM p CROSS JOIN t LEFT JOIN e ON e.page_id = p.page_id AND e.tag = t.tag AND e.timestamp < TIMESTAMP '2026-07-15')
        ON tag USING count(timestamp) AS n_edits, count(*) FILTER (is_anon) AS n_anon, count(DISTINCT user_text) AS n_editors, max(timestamp) AS last_edit_at GROUP BY page_id)""",
    "p3_found": REVISION + f""", v AS (SELECT DISTINCT r.page_id, t.date AS known, r.timestamp AS valid, t.revision_id, t.title_then FROM titles t JOIN r USING (revision_id) WHERE t.title_then IS NOT NULL AND r.page_id IS NOT NULL),
        k AS (SELECT f.page_id, f.date, f.page_title, v.title_then, row_number() OVER (PARTITION BY f.page_id, f.date ORDER BY v.valid DESC NULLS LAST, v.revision_id DESC) AS i
            FROM forecast_days f LEFT JOIN v ON v.page_id = f.page_id AND v.known < f.date AND v.valid < CAST(f.date AS TIMESTAMP) WHERE f.page_title IS NOT NULL)
        SELECT page_id, strftime(date, '%Y-%m-%d') AS day FROM k WHERE i = 1 AND {_TITLE.format('page_title')} IS DISTINCT FROM {_TITLE.format('title_then')}""",
    "p4_found": REVISION + """, e AS (SELECT page_id, CAST(timestamp AS DATE) AS day, count(*) AS n FROM r WHERE page_id IS NOT NULL GROUP BY ALL),
        b AS (SELECT page_id, date AS day, sum(coalesce(editors, 0)) AS n FROM (SELECT DISTINCT * FROM burst_days) GROUP BY ALL),
        t AS (SELECT *, coalesce((SELECT sum(n) FROM e WHERE e.page_id = p.page_id AND e.day BETWEEN p.date - 7 AND p.date - 1), 0) AS e7, coalesce((SELECT sum(n) FROM e WHERE e.page_id = p.page_id AND e.day BETWEEN p.date - 30 AND p.date - 1), 0) AS e30,
            coalesce((SELECT sum(n) FROM b WHERE b.page_id = p.page_id AND b.day BETWEEN p.date - 7 AND p.date - 1), 0) AS b7, coalesce((SELECT sum(n) FROM b WHERE b.page_id = p.page_id AND b.day BETWEEN p.date - 30 AND p.date - 1), 0) AS b30 FROM trailing_totals p)
        SELECT page_id, strftime(date, '%Y-%m-%d') AS day FROM t WHERE edits_7d IS DISTINCT FROM e7 OR edits_30d IS DISTINCT FROM e30 OR burst_editors_7d IS DISTINCT FROM b7 OR burst_editors_30d IS DISTINCT FROM b30
            OR coalesce(abs(avg_edits_7d - e7 / 7.0) > 0.001, true) OR coalesce(abs(avg_edits_30d - e30 / 30.0) > 0.001, true)""",
    "p4_totals": REVISION + """, e AS (SELECT page_id, CAST(timestamp AS DATE) AS day, count(*) AS n FROM r WHERE page_id IS NOT NULL GROUP BY ALL), b AS (SELECT page_id, date AS day, sum(coalesce(editors, 0)) AS n FROM (SELECT DISTINCT * FROM burst_days) GROUP BY ALL),
        t AS (SELECT page_id, date, """ + ", ".join(f"CAST(coalesce((SELECT sum(n) FROM {s} WHERE {s}.page_id = p.page_id AND {s}.day BETWEEN p.date - {k} AND p.date - 1), 0) AS BIGINT) AS {m}_{k}d" for s, m in (("e", "edits"), ("b", "burst_editors")) for k in (7, 30)) + """ FROM trailing_totals p)
        SELECT *, """ + ", ".join(f"{m}_{k}d / {k}.0::DOUBLE AS avg_{m}_{k}d" for m in ("edits", "burst_editors") for k in (7, 30)) + " FROM t",
    "p5_found": REVISION + f""", t AS (SELECT page_id, revision_id, timestamp, {_TITLE.format('page_title')} AS title FROM r WHERE page_id IS NOT NULL AND page_title IS NOT NULL),
        c AS (SELECT *, CASE WHEN title IS DISTINCT FROM lag(title) OVER w THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY page_id ORDER BY timestamp, revision_id)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY timestamp, revision_id) AS v FROM c),
        h AS (SELECT page_id, v, arg_min(revision_id, (timestamp, revision_id)) AS first_revision_id, arg_max(revision_id, (timestamp, revision_id)) AS last_revision_id FROM g GROUP BY ALL)
        SELECT page_id, first_revision_id, last_revision_id FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM h) WHERE n >= 2""",
    "p5_history": REVISION + f""", t AS (SELECT page_id, revision_id, timestamp, {_TITLE.format('page_title')} AS title FROM r WHERE page_id IS NOT NULL AND page_title IS NOT NULL),
        c AS (SELECT *, CASE WHEN title IS DISTINCT FROM lag(title) OVER w THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY page_id ORDER BY timestamp, revision_id)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY timestamp, revision_id) AS v FROM c),
        h AS (SELECT page_id, v, any_value(title) AS title, min(timestamp) AS valid_from, arg_min(revision_id, (timestamp, revision_id)) AS first_revision_id, arg_max(revision_id, (timestamp, revision_id)) AS last_revision_id, count(*) AS n_revisions FROM g GROUP BY ALL)
        SELECT page_id, title, valid_from, lead(valid_from) OVER (PARTITION BY page_id ORDER BY v) AS valid_to, first_revision_id, last_revision_id, n_revisions FROM h""",
}

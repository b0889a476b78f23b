"""Queries on labels, activity, bursts and features, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import activity as A
from palimpsest.operators.labels import is_bot, label_reverts, revision_log
from palimpsest.plans.problems import REVISION
from palimpsest.shared import table, write_shared

MASS = 4


def log(spark: SparkSession, d: str) -> DataFrame:
    return revision_log(table(spark, d, "revisions"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return label_reverts(log(spark, d))


def kept_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels for queries that read them more than once."""
    return write_shared(labels(spark, d), "labels")


def bursts(spark: SparkSession, d: str) -> DataFrame:
    return A.with_bursts(A.daily_activity(kept_labels(spark, d), MASS))


def w1_previous_same_content(spark, d):
    return labels(spark, d).filter("is_revert").select("page_id", "revision_id", "restored_revision_id")


def w2_is_revert(spark, d):
    return labels(spark, d).groupBy("page_id").agg(F.sum(F.col("is_revert").cast("bigint")).alias("reverts"), F.count(F.lit(1)).alias("revisions"))


def w3_reverted_by(spark, d):
    return labels(spark, d).filter("is_reverted").select("page_id", "revision_id", "reverted_by_revision_id")


def a1_daily_channels(spark, d):
    return A.daily_activity(kept_labels(spark, d), MASS).select("page_id", "day", *A.CHANNELS, "kept_edits")


def a2_editors(spark, d):
    return A.daily_activity(kept_labels(spark, d), MASS).select("page_id", "day", "editors", "editors_excl_mass")


def a4_editor_days(spark, d):
    return A.editor_days(labels(spark, d))


def a5_mass_editor_days(spark, d):
    return A.mass_editor_days(labels(spark, d), MASS)


def a6_live_mass_editors(spark, d):
    own = log(spark, d).filter(~is_bot() & F.col("user_text").isNotNull())
    return own.groupBy(F.to_date("ts").alias("day"), "user_text").agg(F.count_distinct("page_id").alias("pages")).filter(F.col("pages") > MASS)


def w6_burst_z(spark, d):
    return bursts(spark, d).select("page_id", "day", "edits", F.round("burst_z", 6).alias("burst_z"))


def w7_burst_days(spark, d):
    return bursts(spark, d).filter("is_burst").select("page_id", "day", "edits", "editors")


def w8_burst_days_excl_mass(spark, d):
    return bursts(spark, d).filter("is_burst_excl_mass").select("page_id", "day")


def u3_burst_union(spark, d):
    return bursts(spark, d).filter("is_burst OR is_burst_excl_mass").select("page_id", "day", "is_burst", "is_burst_excl_mass")


def a7_co_bursts(spark, d):
    return A.co_bursts(bursts(spark, d))


def a9_site_totals(spark, d):
    return A.site_totals(A.daily_activity(kept_labels(spark, d), MASS))


def a10_first_day(spark, d):
    day = F.to_date("ts")
    return log(spark, d).groupBy("page_id").agg(F.min(day).alias("first_day"), F.count_distinct(day).alias("active_days"))


def a11_created_day(spark, d):
    fallback = F.to_date(F.lit("2023-06-01"))
    first = F.min(F.to_date("ts"))
    created = F.to_date(F.min_by("page_created", F.when(F.col("page_created").isNotNull(), F.col("revision_id"))))
    return log(spark, d).groupBy("page_id").agg(F.least(F.coalesce(created, fallback), first).alias("created_day"))


def a12_size_at_end_of_day(spark, d):
    return A.daily_activity(kept_labels(spark, d), MASS).select("page_id", "day", "byte_size_eod").filter("byte_size_eod IS NOT NULL")


def a13_page_summary(spark, d):
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return log(spark, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("edits"), share(is_bot()).alias("bot_share"), share(F.col("is_anon")).alias("anon_share"), F.max_by("page_title", "revision_id").alias("title"))


def a17_label_stats(spark, d):
    n = lambda c: F.count_if(c)
    return labels(spark, d).agg(F.count(F.lit(1)).alias("revisions"), n(F.col("is_revert")).alias("reverts"), n(F.col("is_reverted")).alias("reverted"), n(F.col("is_revert") & F.col("is_reverted")).alias("both"))


def _features(spark, d):
    own = kept_labels(spark, d)
    daily = write_shared(A.with_bursts(A.daily_activity(own, MASS)), "daily")
    return own, daily, A.features(daily, own, table(spark, d, "forecast_days"))


def w10_features(spark, d):
    return _features(spark, d)[2]


def w12_editors_7d(spark, d):
    pairs = table(spark, d, "forecast_days").select("page_id", F.col("date").alias("day")).distinct()
    return A.editors_in_week(kept_labels(spark, d), pairs)


def j6_co_burst_columns(spark, d):
    _, daily, rows = _features(spark, d)
    return A.with_co_bursts(rows, A.co_bursts(daily)).select("page_id", "date", "co_burst_1d", "co_burst_multi_editor_1d")


def j7_site_context(spark, d):
    _, daily, rows = _features(spark, d)
    return A.with_context(rows, A.site_totals(daily)).select("page_id", "date", F.col("day_of_week").cast("bigint").alias("day_of_week"), "site_edits_1d")


QUERIES = {f.__name__: f for f in (w1_previous_same_content, w2_is_revert, w3_reverted_by, a1_daily_channels, a2_editors, a4_editor_days, a5_mass_editor_days, a6_live_mass_editors, w6_burst_z, w7_burst_days, w8_burst_days_excl_mass, u3_burst_union, a7_co_bursts, a9_site_totals, a10_first_day, a11_created_day, a12_size_at_end_of_day, a13_page_summary, a17_label_stats, w10_features, w12_editors_7d, j6_co_burst_columns, j7_site_context)}

LOG = REVISION + """, o AS (SELECT page_id, revision_id, parent_id, timestamp AS ts, CAST(timestamp AS DATE) AS day, user_text, coalesce(is_bot, contains(lower(user_text), 'bot'), false) AS bot, is_anon, byte_size, sha1, page_created,
    trim(regexp_replace(page_title, '[ _]+', ' ', 'g')) AS page_title, row_number() OVER (PARTITION BY page_id ORDER BY revision_id) AS rn FROM r WHERE page_id IS NOT NULL AND namespace = 0)"""
LABELS = LOG + """, pv AS (SELECT *, CASE WHEN sha1 IS NOT NULL THEN lag(rn) OVER (PARTITION BY page_id, sha1 ORDER BY rn) END AS restored FROM o),
    q AS (SELECT *, coalesce(restored <> rn - 1, false) AS is_revert FROM pv),
    cv AS (SELECT i.page_id, i.rn, min(j.rn) AS by_rn FROM q i JOIN q j ON i.page_id = j.page_id AND j.is_revert AND j.rn BETWEEN i.rn + 1 AND i.rn + 15 AND j.restored < i.rn AND j.ts - i.ts <= INTERVAL 90 DAY GROUP BY ALL),
    l AS (SELECT q.*, b.revision_id AS by_id, b.rn IS NOT NULL AS is_reverted, CASE WHEN q.is_revert THEN 'reverts' WHEN q.bot THEN 'bot_edits' WHEN b.day <= q.day THEN 'reverted_edits' ELSE 'edits' END AS channel
        FROM q LEFT JOIN cv USING (page_id, rn) LEFT JOIN q b ON b.page_id = q.page_id AND b.rn = cv.by_rn)"""
_MASS = f"mass AS (SELECT user_text, day, count(DISTINCT page_id) AS pages FROM l WHERE NOT is_revert AND NOT bot AND user_text IS NOT NULL GROUP BY ALL HAVING count(DISTINCT page_id) > {MASS})"
DAILY = LABELS + f""", {_MASS}, da AS (SELECT l.page_id, l.day, count(*) FILTER (channel = 'edits') AS edits, count(*) FILTER (channel = 'reverted_edits') AS reverted_edits, count(*) FILTER (channel = 'reverts') AS reverts, count(*) FILTER (channel = 'bot_edits') AS bot_edits,
    count(*) FILTER (channel IN ('edits', 'reverted_edits') AND NOT is_reverted) AS kept_edits, count(DISTINCT l.user_text) FILTER (channel = 'edits' AND l.user_text <> '') AS editors, count(DISTINCT l.user_text) FILTER (channel = 'edits' AND l.user_text <> '' AND mass.pages IS NULL) AS editors_excl_mass,
    count(*) FILTER (channel = 'edits' AND mass.pages IS NOT NULL) AS mass_edits, arg_max(byte_size, revision_id) FILTER (byte_size IS NOT NULL) AS byte_size_eod FROM l LEFT JOIN mass ON mass.user_text = l.user_text AND mass.day = l.day GROUP BY ALL)"""
_Z = "(({0}) - CASE WHEN n > 0 THEN s{1} / n ELSE 0 END) / greatest(sqrt(greatest(CASE WHEN n > 0 THEN q{1} / n - (s{1} / n) * (s{1} / n) ELSE 0 END, 0)), 1.0)"
BURSTS = DAILY + f""", wi AS (SELECT *, least(90, day - min(day) OVER (PARTITION BY page_id))::DOUBLE AS n, coalesce(sum(edits) OVER b, 0)::DOUBLE AS s1, coalesce(sum(edits * edits) OVER b, 0)::DOUBLE AS q1,
    coalesce(sum(edits - mass_edits) OVER b, 0)::DOUBLE AS s2, coalesce(sum((edits - mass_edits) * (edits - mass_edits)) OVER b, 0)::DOUBLE AS q2 FROM da WINDOW b AS (PARTITION BY page_id ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
    bz AS (SELECT *, {_Z.format('edits', 1)} AS burst_z, {_Z.format('edits - mass_edits', 2)} AS human_z FROM wi),
    bu AS (SELECT *, edits >= 2 AND burst_z >= 3 AS is_burst, edits - mass_edits >= 2 AND human_z >= 3 AS is_burst_excl_mass FROM bz)"""
_SUM = "coalesce((SELECT CAST(sum({0}) AS BIGINT) FROM bu WHERE bu.page_id = f.page_id AND bu.day BETWEEN f.date - {1} AND f.date - {2}), 0)"
S = _SUM.format
FEATURES = BURSTS + f""", fd AS (SELECT page_id, min(day) AS first_day FROM da GROUP BY ALL), f0 AS (SELECT DISTINCT page_id, date FROM forecast_days),
    f1 AS (SELECT f.page_id, f.date, f.date - fd.first_day AS page_age_days, (SELECT arg_max(byte_size_eod, day) FROM da WHERE da.page_id = f.page_id AND da.day < f.date AND byte_size_eod IS NOT NULL) AS page_bytes,
    f.date - (SELECT max(day) FROM da WHERE da.page_id = f.page_id AND da.day < f.date AND edits > 0) AS days_since_last_edit,
    {', '.join(S('edits', k, 1) + f' AS edits_{k}d' for k in (1, 7, 30, 365))}, {S('editors', 1, 1)} AS editors_1d, {S('reverted_edits', 7, 1)} AS reverted_edits_7d, {S('reverts', 7, 1)} AS reverts_7d, {S('bot_edits', 30, 1)} AS bot_edits_30d,
    {S('edits', 91, 2)}::DOUBLE AS s1, {S('edits * edits', 91, 2)}::DOUBLE AS q1, greatest(least(90, f.date - fd.first_day - 1), 0)::DOUBLE AS n0, {S('is_burst::INT', 1, 1)} > 0 AS is_burst_1d, {S('is_burst::INT', 30, 1)} AS burst_days_30d,
    {S('edits', 7, 7)} AS edits_lag7, {S('edits', 14, 14)} AS edits_lag14, {S('editors', 7, 7)} AS editors_lag7, {S('is_burst::INT', 7, 7)} > 0 AS is_burst_lag7, {S('is_burst::INT', 14, 14)} > 0 AS is_burst_lag14,
    (SELECT count(DISTINCT user_text) FROM l WHERE l.page_id = f.page_id AND channel = 'edits' AND user_text <> '' AND l.day BETWEEN f.date - 7 AND f.date - 1) AS editors_7d FROM f0 f LEFT JOIN fd USING (page_id)),
    ft AS (SELECT * EXCLUDE (s1, q1, n0, n), round({_Z.format('edits_1d', 1)}, 6) AS burst_z_1d FROM (SELECT *, coalesce(n0, 0) AS n FROM f1))"""

SQL = {
    "w1_previous_same_content": LABELS + " SELECT l.page_id, l.revision_id, b.revision_id AS restored_revision_id FROM l JOIN o b ON b.page_id = l.page_id AND b.rn = l.restored WHERE l.is_revert",
    "w2_is_revert": LABELS + " SELECT page_id, count(*) FILTER (is_revert) AS reverts, count(*) AS revisions FROM l GROUP BY page_id",
    "w3_reverted_by": LABELS + " SELECT page_id, revision_id, by_id AS reverted_by_revision_id FROM l WHERE is_reverted",
    "a1_daily_channels": DAILY + " SELECT page_id, day, edits, reverted_edits, reverts, bot_edits, kept_edits FROM da",
    "a2_editors": DAILY + " SELECT page_id, day, editors, editors_excl_mass FROM da",
    "a4_editor_days": LABELS + " SELECT user_text, day, count(DISTINCT page_id) AS pages FROM l WHERE NOT is_revert AND NOT bot AND user_text IS NOT NULL GROUP BY ALL",
    "a5_mass_editor_days": LABELS + f", {_MASS} SELECT * FROM mass",
    "a6_live_mass_editors": LOG + f" SELECT day, user_text, count(DISTINCT page_id) AS pages FROM o WHERE NOT bot AND user_text IS NOT NULL GROUP BY ALL HAVING count(DISTINCT page_id) > {MASS}",
    "w6_burst_z": BURSTS + " SELECT page_id, day, edits, round(burst_z, 6) AS burst_z FROM bu",
    "w7_burst_days": BURSTS + " SELECT page_id, day, edits, editors FROM bu WHERE is_burst",
    "w8_burst_days_excl_mass": BURSTS + " SELECT page_id, day FROM bu WHERE is_burst_excl_mass",
    "u3_burst_union": BURSTS + " SELECT page_id, day, is_burst, is_burst_excl_mass FROM bu WHERE is_burst OR is_burst_excl_mass",
    "a7_co_bursts": BURSTS + " SELECT day, count(*) FILTER (is_burst) AS pages, count(*) FILTER (is_burst AND editors >= 2) AS multi_editor, count(*) FILTER (is_burst_excl_mass) AS pages_excl_mass FROM bu WHERE is_burst OR is_burst_excl_mass GROUP BY day",
    "a9_site_totals": DAILY + " SELECT day, CAST(sum(edits) AS BIGINT) AS edits FROM da GROUP BY day",
    "a10_first_day": LOG + " SELECT page_id, min(day) AS first_day, count(DISTINCT day) AS active_days FROM o GROUP BY page_id",
    "a11_created_day": LOG + " SELECT page_id, least(coalesce(CAST(arg_min(page_created, revision_id) FILTER (page_created IS NOT NULL) AS DATE), DATE '2023-06-01'), min(day)) AS created_day FROM o GROUP BY page_id",
    "a12_size_at_end_of_day": DAILY + " SELECT page_id, day, byte_size_eod FROM da WHERE byte_size_eod IS NOT NULL",
    "a13_page_summary": LOG + " SELECT page_id, count(*) AS edits, round(avg(bot::INT), 6) AS bot_share, round(avg(is_anon::INT), 6) AS anon_share, arg_max_null(page_title, revision_id) AS title FROM o GROUP BY page_id",
    "a17_label_stats": LABELS + " SELECT count(*) AS revisions, count(*) FILTER (is_revert) AS reverts, count(*) FILTER (is_reverted) AS reverted, count(*) FILTER (is_revert AND is_reverted) AS both FROM l",
    "w10_features": FEATURES + " SELECT * FROM ft",
    "w12_editors_7d": FEATURES + " SELECT page_id, date, editors_7d FROM ft WHERE editors_7d > 0",
    "j6_co_burst_columns": FEATURES + ", cb AS (SELECT day, count(*) AS pages, count(*) FILTER (editors >= 2) AS multi FROM bu WHERE is_burst GROUP BY day) SELECT page_id, date, coalesce(pages, 0) - is_burst_1d::BIGINT AS co_burst_1d, coalesce(multi, 0) - (is_burst_1d AND editors_1d >= 2)::BIGINT AS co_burst_multi_editor_1d FROM ft LEFT JOIN cb ON cb.day = ft.date - 1",
    "j7_site_context": DAILY + ", st AS (SELECT day, CAST(sum(edits) AS BIGINT) AS edits FROM da GROUP BY day) SELECT page_id, date, isodow(date) - 1 AS day_of_week, coalesce(edits, 0) AS site_edits_1d FROM (SELECT DISTINCT page_id, date FROM forecast_days) f LEFT JOIN st ON st.day = f.date - 1",
}

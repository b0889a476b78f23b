"""Queries on operators that the others use only as parts, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import arrow as U
from palimpsest.functions import text as X
from palimpsest.functions.batches import without_repeats
from palimpsest.functions import names as N
from palimpsest.operators.firsts import first_rows
from palimpsest.operators.labels import is_bot
from palimpsest.operators.revisions import first_delivery
from palimpsest.plans import activity as Q
from palimpsest.plans import ranking as G
from palimpsest.plans import text as X_
from palimpsest.shared import keep, shared_dir, table, write_shared
from palimpsest.sources import dumps, sinks

DAY = "2026-08-01"


def pred_p1_mainspace(spark, d):
    return table(spark, d, "revisions").filter("namespace = 0 AND page_id IS NOT NULL").groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


def pred_p2_timestamps(spark, d):
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss'.0'")
    return table(spark, d, "revisions").select("revision_id", F.to_timestamp_ntz(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts")).distinct()


def pred_p3_bots(spark, d):
    return Q.log(spark, d).filter(is_bot()).groupBy("user_text").agg(F.count(F.lit(1)).alias("n"))


def pred_p4_anonymous(spark, d):
    temporary = F.coalesce(F.col("user_text").rlike("^~2[0-9]{3}-"), F.lit(False))
    return Q.log(spark, d).groupBy((F.col("is_anon") | temporary).alias("anonymous")).agg(F.count(F.lit(1)).alias("n"))


def pred_p6_days(spark, d):
    return Q.log(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def pred_p7_window(spark, d):
    return table(spark, d, "burst_days").filter(F.col("date").between("2026-07-01", "2026-07-14")).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def j8_mass_membership(spark, d):
    own = Q.kept_labels(spark, d)
    from palimpsest.operators import activity as A

    mass = A.mass_editor_days(own, Q.MASS).select("user_text", "day", F.lit(True).alias("mass"))
    rows = own.withColumn("day", F.to_date("ts")).join(mass, ["user_text", "day"], "left")
    return rows.groupBy("day").agg(F.count_if("mass").alias("mass"), F.count(F.lit(1)).alias("n"))


def j20_agreement(spark, d):
    """Two sources' flags of the same page-days, published and computed from the log: how many agree, by day."""
    given = table(spark, d, "burst_days").filter("is_burst IS NOT NULL").groupBy("page_id", F.col("date").alias("day")).agg(F.bool_or("is_burst").alias("given"))
    both = given.join(Q.bursts(spark, d).select("page_id", "day", "is_burst"), ["page_id", "day"])
    return both.groupBy("day").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("given") == F.col("is_burst")).alias("same"))


def w4_window_sums(spark, d):
    return Q._features(spark, d)[2].select("page_id", "date", "edits_7d", "edits_30d", "edits_365d")


def w5_last_active_day(spark, d):
    return Q._features(spark, d)[2].select("page_id", "date", "days_since_last_edit")


def w9_neighbor_burst_days(spark, d):
    return G.j5_neighbor_bursts(spark, d).select("page_id", "date", "in_bursting_7d", "out_bursting_7d")


def w11_size_before(spark, d):
    return Q._features(spark, d)[2].select("page_id", "date", "page_bytes")


def w13_weekday_lags(spark, d):
    return Q._features(spark, d)[2].select("page_id", "date", "edits_lag7", "edits_lag14", "editors_lag7", "is_burst_lag7", "is_burst_lag14")


def w15_cumulative_hits(spark, d):
    return G.w14_ranked(spark, d).groupBy("date").agg(F.max("hits").alias("hits"), F.min(F.when(F.col("hits") > 0, F.col("rank"))).alias("first_hit"))


def w20_without_repeats(spark, d):
    """Of each day and source the texts unlike every one kept before."""
    own = X_.docs(spark, d).filter("day IS NOT NULL").select(F.concat_ws("|", F.col("day").cast("string"), "source").alias("grp"), F.col("doc_id").alias("n"), "text")
    return without_repeats(own).groupBy("grp").agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("n"))


def k4_top_neighbors(spark, d):
    return G.j12_bursting_neighbors(spark, d).groupBy("page_id", "date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbor"))), lambda x: x["neighbor"].cast("string")), ",").alias("neighbors"))


def k6_longest_sentence(spark, d):
    parts = F.transform(X.sentences(F.col("text")), lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s")))
    return X_.docs(spark, d).select("doc_id", F.array_max(parts)["s"].alias("longest"))


def k7_daily_selection(spark, d):
    """Of each date ten page-days by rank: first those of the one class, then up to three of the other where room is left."""
    rows = G.scored(spark, d).filter("score IS NOT NULL")
    best = first_rows(rows, ["date", "y"], [F.desc("score"), F.col("page_id").asc()], 10, "i")
    first = F.count_if(~F.col("y")).over(W.partitionBy("date"))  # twenty rows a date at most
    return best.withColumn("room", F.least(F.lit(3), 10 - first)).filter("NOT y OR i <= room").select("date", "page_id", "score", "y")


def a8_totals_again(spark, d):
    """Co-burst totals of two halves of the pages, added up."""
    day = Q.bursts(spark, d).filter("is_burst").groupBy("day", (F.col("page_id") % 2).alias("half")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("editors") >= 2).alias("multi_editor"))
    return day.groupBy("day").agg(F.sum("pages").alias("pages"), F.sum("multi_editor").alias("multi_editor"))


def a30_invented_sections(spark, d):
    """Named sections that the page doesn't have, the forty commonest."""
    both = X_._forecasts(spark, d).join(X_._changed(spark, d), "page_id").select(F.explode(F.array_except("named", "changed")).alias("section"))
    return both.groupBy("section").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "section").limit(40)


def a30_validity(spark, d):
    """The shares of forecasts that name any section, and of named sections that the page doesn't have."""
    both = X_._forecasts(spark, d).join(X_._changed(spark, d), "page_id")
    invented, named = F.size(F.array_except("named", "changed")), F.size("named")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((named > 0).cast("double")), 6).alias("parsed"), F.round(F.sum(invented) / F.sum(named), 6).alias("invented"))


def d5_dated_lines(spark, d):
    return X_.docs(spark, d).filter("day IS NOT NULL").select("doc_id", F.size(U.dated_lines("text", "day")).alias("n"))


def d6_nearest_mark(spark, d):
    """Each page-day with a forecast snapped to the nearest burst day of its page within 14 days, the later on a tie; null without one."""
    marks = table(spark, d, "burst_days").filter("is_burst").select("page_id", F.col("date").alias("mark")).distinct()
    asked = table(spark, d, "forecast_days").select("page_id", "date")
    days = asked.select("page_id", "date", F.explode(F.sequence(F.date_sub("date", 14), F.date_add("date", 14))).alias("mark"))
    hits = days.join(marks, ["page_id", "mark"]).groupBy("page_id", "date").agg(F.min_by(F.col("mark"), F.struct(F.abs(F.datediff("mark", "date")), -F.unix_date("mark"))).alias("mark"))
    return asked.join(hits, ["page_id", "date"], "left")


def d7_weekdays(spark, d):
    return X_.docs(spark, d).filter("day IS NOT NULL").select("doc_id", U.fix_weekdays("text", "day").alias("text"))


def d9_weekday(spark, d):
    return table(spark, d, "burst_days").groupBy(F.weekday("date").cast("bigint").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


def integer_dump(spark, d) -> str:
    """Writes three columns of integers as a dump of statements and returns its folder."""
    row = F.concat(F.lit("("), F.concat_ws(",", "l_orderkey", "l_partkey", "l_suppkey"), F.lit(")"))
    path = f"{shared_dir(spark)}/palimpsest-dump-{uuid.uuid4().hex}"
    dumps.write_statements(table(spark, d, "lineitem").select(row.alias("row")), "l", {"o": "int", "p": "int", "s": "int"}, path)
    return path


def s4_integer_dump(spark, d):
    dumps.register(spark)
    return spark.read.format("sqldump").schema("p bigint, o bigint").load(integer_dump(spark, d)).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("orders"))


def s9_page_as_known(spark, d):
    """The last revision of each page at a moment whose user isn't hidden."""
    own = first_delivery(table(spark, d, "revisions"), ["page_id", "timestamp", "user_text"]).filter("page_id IS NOT NULL AND user_text IS NOT NULL AND timestamp <= TIMESTAMP_NTZ'2026-07-20 23:59:59'")
    return own.groupBy("page_id").agg(F.max(F.struct("timestamp", "revision_id"))["revision_id"].alias("revision_id"))


def s11_pruned_scan(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 45 AND l_returnflag = 'R'").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


def s12_atomic_write(spark, d):
    """A table replaced at one path, each time by one written whole beside it."""
    rows = table(spark, d, "burst_days").distinct()
    path = keep(spark, f"{shared_dir(spark)}/palimpsest-sink-{uuid.uuid4().hex}")
    sinks.replace(rows.withColumn("editors", F.lit(0)), path)
    sinks.replace(rows, path, most_rows=1000)
    return spark.read.parquet(path)


def j19_attached(spark, d):
    """Marks attached to reports by day and text; a report without a mark keeps null. The marks are those of the reports' page-days."""
    marks = table(spark, d, "documents").filter("text IS NOT NULL AND day IS NOT NULL AND n_chars IS NOT NULL").groupBy("day", "text").agg(F.max("n_chars").alias("mark"))
    rows = X_.docs(spark, d).select("doc_id", "day", "text")
    return rows.join(marks, ["day", "text"], "left").select("doc_id", "mark")


def j21_evidence(spark, d):
    """Of each forecast the named sections that its page has, with their characters, in the order named."""
    own = X_._forecasts(spark, d).select("id", "page_id", F.posexplode("named").alias("i", "section"))
    held = X_._changed(spark, d).select("page_id", F.explode(F.arrays_zip("changed", "chars")).alias("z")).select("page_id", F.col("z.changed").alias("section"), F.col("z.chars").alias("chars"))
    packed = F.array_sort(F.collect_list(F.struct("i", F.concat_ws(":", "section", "chars").alias("t"))))
    return own.join(held, ["page_id", "section"]).groupBy("id").agg(F.array_join(F.transform(packed, lambda x: x["t"]), "|").alias("evidence"))


def t12_kinds(spark, d):
    return X_.docs(spark, d).select("doc_id", U.kinds_of("text").alias("kinds"))


def t16_snippet(spark, d):
    return X_.docs(spark, d).select("doc_id", U.snippet("text").alias("snippet"))


def t19_trigger_text(spark, d):
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("none"))
    return table(spark, d, "trailing_totals").select("page_id", "date", F.concat(F.lit("Edits in 7 days: "), c("edits_7d"), F.lit("; in 30 days: "), c("edits_30d"), F.lit(".")).alias("line"))


def t27_title_in_text(spark, d):
    """Whether a text names, in whole words, a title filed under the day before; texts of days without titles are left out."""
    titles = table(spark, d, "titles").filter("title IS NOT NULL").select("title", F.date_add("date", 1).alias("day")).distinct()
    names = write_shared(N.titles_names(titles), "names").filter("name = translate(title, '_', ' ')").drop("title")
    texts = X_.docs(spark, d).select("doc_id", "day", "text").join(titles.select("day").distinct(), "day", "left_semi")
    hits = N.spots(texts, names).join(names.drop("hashes").distinct(), ["day", "key"]).filter(N.fits()).select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return texts.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.col("_hit").isNotNull().alias("named"))


def r9_kinds_by_threshold(spark, d):
    return X_._marginals(spark, d).filter("p >= 0.5").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("kind")), lambda k: k.cast("string")), ",").alias("kinds"))


_NAMES = (pred_p1_mainspace, pred_p2_timestamps, pred_p3_bots, pred_p4_anonymous, pred_p6_days, pred_p7_window, j8_mass_membership, j20_agreement, w4_window_sums, w5_last_active_day, w9_neighbor_burst_days, w11_size_before, w13_weekday_lags, w15_cumulative_hits, w20_without_repeats, k4_top_neighbors, k6_longest_sentence, k7_daily_selection, a8_totals_again, a30_invented_sections, a30_validity, d5_dated_lines, d6_nearest_mark, d7_weekdays, d9_weekday, s4_integer_dump, s9_page_as_known, s11_pruned_scan, s12_atomic_write, j19_attached, j21_evidence, t12_kinds, t16_snippet, t19_trigger_text, t27_title_in_text, r9_kinds_by_threshold)
QUERIES = {f.__name__: f for f in _NAMES}

_L, _F, _N, _P = Q.LOG, Q.FEATURES, X_._NEWS, X_._PAIRS
SQL = {
    "pred_p1_mainspace": "SELECT namespace, count(*) AS n FROM revisions WHERE namespace = 0 AND page_id IS NOT NULL GROUP BY namespace",
    "pred_p2_timestamps": "SELECT DISTINCT revision_id, timestamp AS ts FROM revisions",
    "pred_p3_bots": _L + " SELECT user_text, count(*) AS n FROM o WHERE bot GROUP BY user_text",
    "pred_p4_anonymous": _L + " SELECT is_anon OR coalesce(regexp_matches(user_text, '^~2[0-9]{3}-'), false) AS anonymous, count(*) AS n FROM o GROUP BY ALL",
    "pred_p6_days": _L + " SELECT day, count(*) AS n FROM o GROUP BY day",
    "pred_p7_window": "SELECT date, count(*) AS n FROM burst_days WHERE date BETWEEN DATE '2026-07-01' AND DATE '2026-07-14' GROUP BY date",
    "j8_mass_membership": Q.LABELS + f", {Q._MASS} SELECT l.day, count(*) FILTER (mass.pages IS NOT NULL) AS mass, count(*) AS n FROM l LEFT JOIN mass ON mass.user_text = l.user_text AND mass.day = l.day GROUP BY l.day",
    "j20_agreement": Q.BURSTS + ", g AS (SELECT page_id, date AS day, bool_or(is_burst) AS given FROM burst_days WHERE is_burst IS NOT NULL GROUP BY ALL) SELECT day, count(*) AS pairs, count(*) FILTER (given = is_burst) AS same FROM g JOIN bu USING (page_id, day) GROUP BY day",
    "w4_window_sums": _F + " SELECT page_id, date, edits_7d, edits_30d, edits_365d FROM ft",
    "w5_last_active_day": _F + " SELECT page_id, date, days_since_last_edit FROM ft",
    "w9_neighbor_burst_days": G._NEAR + " SELECT page_id, date, in_bursting_7d, out_bursting_7d FROM n",
    "w11_size_before": _F + " SELECT page_id, date, page_bytes FROM ft",
    "w13_weekday_lags": _F + " SELECT page_id, date, edits_lag7, edits_lag14, editors_lag7, is_burst_lag7, is_burst_lag14 FROM ft",
    "w15_cumulative_hits": G._SCORED + " SELECT date, max(hits) AS hits, min(rank) FILTER (hits > 0) AS first_hit FROM rk GROUP BY date",
    "k4_top_neighbors": G.SQL["j12_bursting_neighbors"].replace(" SELECT * FROM h WHERE rank <= 8", " SELECT page_id, date, string_agg(CAST(neighbor AS VARCHAR), ',' ORDER BY rank) AS neighbors FROM h WHERE rank <= 8 GROUP BY ALL"),
    "k6_longest_sentence": X_._D + ", s AS (SELECT doc_id, " + X_._SENT.format("text") + " AS a FROM t), m AS (SELECT doc_id, a, list_max(list_transform(a, lambda s: length(s))) AS n FROM s) SELECT doc_id, list_filter(a, lambda s: length(s) = n)[1] AS longest FROM m",
    "k7_daily_selection": G._SCORED + ", b AS (SELECT *, row_number() OVER (PARTITION BY date, y ORDER BY score DESC, page_id) AS i FROM sc WHERE score IS NOT NULL), c AS (SELECT *, count(*) FILTER (NOT y) OVER (PARTITION BY date) AS f FROM b WHERE i <= 10) SELECT date, page_id, score, y FROM c WHERE NOT y OR i <= least(3, 10 - f)",
    "a8_totals_again": Q.BURSTS + " SELECT day, count(*) AS pages, count(*) FILTER (editors >= 2) AS multi_editor FROM bu WHERE is_burst GROUP BY day",
    "a30_invented_sections": X_._SCORE + " SELECT section, count(*) AS n FROM (SELECT unnest(list_filter(named, lambda s: NOT list_contains(changed, s))) AS section FROM fc JOIN ch USING (page_id)) GROUP BY section ORDER BY n DESC, section LIMIT 40",
    "a30_validity": X_._SCORE + ", v AS (SELECT named, list_filter(named, lambda s: NOT list_contains(changed, s)) AS i FROM fc JOIN ch USING (page_id)) SELECT count(*) AS n, round(avg((len(named) > 0)::INT), 6) AS parsed, round(sum(len(i)) / sum(len(named))::DOUBLE, 6) AS invented FROM v",
    "d6_nearest_mark": "SELECT f.page_id, f.date, (SELECT arg_min(b.date, (abs(b.date - f.date), -(b.date - DATE '1970-01-01'))) FROM burst_days b WHERE b.is_burst AND b.page_id = f.page_id AND abs(b.date - f.date) <= 14) AS mark FROM forecast_days f",
    "d9_weekday": "SELECT isodow(date) - 1 AS weekday, count(*) AS n FROM burst_days GROUP BY ALL",
    "s4_integer_dump": "SELECT l_partkey AS p, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders FROM lineitem GROUP BY ALL",
    "s9_page_as_known": Q.REVISION + " SELECT page_id, arg_max(revision_id, (timestamp, revision_id)) AS revision_id FROM r WHERE page_id IS NOT NULL AND user_text IS NOT NULL AND timestamp <= TIMESTAMP '2026-07-20 23:59:59' GROUP BY page_id",
    "s11_pruned_scan": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' GROUP BY l_linenumber",
    "s12_atomic_write": "SELECT DISTINCT * FROM burst_days",
    "j19_attached": X_._D + ", m AS (SELECT day, text, max(n_chars) AS mark FROM t WHERE day IS NOT NULL AND n_chars IS NOT NULL GROUP BY ALL) SELECT t.doc_id, m.mark FROM t LEFT JOIN m ON m.day = t.day AND m.text = t.text",
    "j21_evidence": X_._SCORE + ", nm AS (SELECT id, page_id, generate_subscripts(named, 1) AS i, unnest(named) AS section FROM fc) SELECT id, string_agg(section || ':' || chars, '|' ORDER BY i) AS evidence FROM nm JOIN c0 USING (page_id, section) GROUP BY id",
    "t19_trigger_text": "SELECT page_id, date, 'Edits in 7 days: ' || coalesce(CAST(edits_7d AS VARCHAR), 'none') || '; in 30 days: ' || coalesce(CAST(edits_30d AS VARCHAR), 'none') || '.' AS line FROM trailing_totals",
    "t27_title_in_text": X_._D + ", tt AS (SELECT DISTINCT date + 1 AS day, replace(title, '_', ' ') AS name FROM titles WHERE title IS NOT NULL), h AS MATERIALIZED (SELECT doc_id, text, name FROM t JOIN tt USING (day) WHERE length(name) >= 4 AND contains(text, name)), n AS (SELECT DISTINCT doc_id FROM h WHERE regexp_matches(text, '(^|[^\\pL\\pN_])' || regexp_escape(name) || '($|[^\\pL\\pN_])')) SELECT doc_id, doc_id IN (SELECT doc_id FROM n) AS named FROM t WHERE day IN (SELECT day FROM tt)",
    "r9_kinds_by_threshold": X_._KM + " SELECT id, string_agg(CAST(kind AS VARCHAR), ',' ORDER BY kind) AS kinds FROM km WHERE p >= 0.5 GROUP BY id",
}

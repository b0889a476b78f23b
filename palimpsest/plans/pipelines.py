"""Queries on sources, sinks, streams, models and the daily job, and their SQL. Dumps are written from the tables, then read."""

from __future__ import annotations

import uuid
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import functions as F

from palimpsest.operators import activity as A
from palimpsest.operators import model as M
from palimpsest.operators import panel as P
from palimpsest.operators import ranking as R
from palimpsest.plans import activity as Q
from palimpsest.plans.ranking import _MET, H32
from palimpsest.shared import shared_dir, table, write_shared
from palimpsest.sources import dumps, sinks
from palimpsest.streaming import daily as S

DAY = date(2026, 8, 1)


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/palimpsest-dump-{uuid.uuid4().hex}"


def s1_page_xml(spark, d):
    rows = Q.log(spark, d).filter("page_title IS NOT NULL")
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    user = F.when(F.col("user_text").isNull(), "<contributor deleted='deleted'/>").when(F.col("is_anon"), F.concat(F.lit("<contributor><ip>"), escape(F.col("user_text")), F.lit("</ip></contributor>"))).otherwise(F.concat(F.lit("<contributor><username>"), escape(F.col("user_text")), F.lit("</username><id>7</id></contributor>")))
    one = F.concat(F.lit("<page><title>"), escape(F.col("page_title")), F.lit("</title><ns>0</ns><id>"), F.col("page_id"), F.lit("</id><revision><id>"), F.col("revision_id"), F.lit("</id><timestamp>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</timestamp>"), user, F.lit("<text bytes='"), F.coalesce(F.col("byte_size"), F.lit(0)), F.lit("'/><sha1>"), F.coalesce("sha1", F.lit("")), F.lit("</sha1></revision></page>"))
    dumps.write_lines(rows.select(one.alias("line")), path := _folder(spark), ["<mediawiki>"], ["</mediawiki>"])
    return dumps.page_xml(spark, path).select("page_id", "page_title", "revision_id", "ts", "user_text", "byte_size")


def history_dump(spark, d) -> str:
    """Writes the log as a history dump and returns its folder."""
    rows = table(spark, d, "revisions").filter("page_id IS NOT NULL")
    values = {"entity": F.lit("revision"), "type": F.lit("create"), "ts": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.S"), "user_text": F.col("user_text"), "bot_by": F.when(F.col("is_bot"), "name,group"), "anonymous": F.col("is_anon").cast("string"), "page_id": F.col("page_id").cast("string"), "page_title": F.col("page_title"), "namespace": F.col("namespace").cast("string"), "revision_id": F.col("revision_id").cast("string"), "parent_id": F.col("parent_id").cast("string"), "byte_size": F.col("byte_size").cast("string"), "sha1": F.col("sha1"), "deleted": F.lit("false")}
    at = {dumps.PLACE[k]: v for k, v in values.items()}
    line = F.concat_ws("\t", *[F.coalesce(at[i], F.lit("")) if i in at else F.lit("") for i in range(dumps.WIDTH)])
    rows.select(line.alias("value")).repartition(spark.sparkContext.defaultParallelism).write.option("compression", "bzip2").text(path := _folder(spark))
    return path


def s2_history_lines(spark, d):
    return dumps.history_lines(spark, history_dump(spark, d)).select("page_id", "revision_id", "parent_id", "ts", "user_text", "is_anon", "is_bot", "byte_size", "sha1")


def s3_sql_dump(spark, d):
    dumps.register(spark)
    quoted = F.concat(F.lit("'"), F.replace(F.replace("c_name", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    row = F.concat(F.lit("("), F.col("c_custkey"), F.lit(","), quoted, F.lit(","), F.when(F.col("c_nationkey") == 0, "NULL").otherwise(F.col("c_nationkey").cast("string")), F.lit(")"))
    dumps.write_statements(table(spark, d, "customer").select(row.alias("row")), "customer", {"id": "int", "name": "varbinary(255)", "nation": "int"}, path := _folder(spark))
    return spark.read.format("sqldump").schema("id bigint, name binary, nation bigint").load(path).select("id", F.col("name").cast("string").alias("name"), "nation")


def s5_live_changes(spark, d):
    """A feed as JSON, made of the revisions."""
    rows = table(spark, d, "revisions").filter("page_id IS NOT NULL")
    feed = rows.select(F.when(F.coalesce("parent_id", F.lit(0)) == 0, "new").when(F.col("page_title").isNull(), "log").otherwise("edit").alias("type"), F.col("namespace").alias("ns"), F.col("page_title").alias("title"), F.col("page_id").alias("pageid"), F.col("revision_id").alias("revid"), F.col("parent_id").alias("old_revid"), F.col("user_text").alias("user"), F.col("is_anon").alias("anon"), F.lit(False).alias("temp"), F.col("is_bot").alias("bot"), F.col("user_text").isNull().alias("userhidden"), F.col("byte_size").alias("newlen"), F.col("timestamp").alias("ts"), F.lit(None).cast("string").alias("sha1"), F.lit(True).alias("sha1hidden"))
    feed.write.json(path := _folder(spark))
    back = spark.read.schema(feed.schema).json(path)
    moment = lambda x: F.lit(x).cast("timestamp_ntz")
    return dumps.live_changes(back, moment("2026-07-07"), moment("2026-07-09")).select("page_id", "revision_id", "ts", "user_text", "is_anon", "is_bot", "page_created")


def s13_month_buckets(spark, d):
    sinks.write_by_month(Q.log(spark, d), path := _folder(spark), buckets=8)
    return spark.read.parquet(path).filter("month = '2026-07'").groupBy("month", F.col("bucket").cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def s15_append_missing(spark, d):
    rows = table(spark, d, "burst_days").distinct()
    path = _folder(spark)
    for part in (rows.filter("date < '2026-07-10'"), rows.filter("date >= '2026-07-01'"), rows):
        sinks.append_missing(part, path, ["page_id", "date"])
    return spark.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def s16_json_sink(spark, d):
    rows = table(spark, d, "forecast_days")
    rows.write.json(path := _folder(spark))
    return spark.read.schema(rows.schema).json(path)


def x1_daily_stream(spark, d):
    return S.replay(spark, d).select("day", "revisions")


def l8_daily_features(spark, d):
    own = write_shared(Q.log(spark, d), "log")
    return M.daily_features(own, own.filter(F.col("ts") >= F.lit("2026-07-15").cast("timestamp_ntz")), "2026-07-15", str(DAY), 30, Q.MASS).select("page_id", "date", "edits_1d", "edits_7d", "edits_30d", "editors_7d", "burst_days_30d")


def l9_daily_outcomes(spark, d):
    return M.daily_outcomes(Q.bursts(spark, d), DAY)


def l5_model(spark, d):
    """Trees fitted on a weighted sample of the earlier page-days, and the baselines, ranking every page on the later days: their measures by day."""
    own = Q.kept_labels(spark, d)
    daily = write_shared(A.with_bursts(A.daily_activity(own, Q.MASS)), "daily")
    panel = P.panel(daily, date(2026, 8, 15), 0.02, date(2026, 8, 15)).filter("date < '2026-08-01'")
    asked = P.evaluation_panel(daily, [DAY + timedelta(days=i) for i in range(15)])
    both = panel.select("page_id", "date", "y", "sample_weight", F.lit(True).alias("fitted")).unionByName(asked.withColumns({"sample_weight": F.lit(None).cast("double"), "fitted": F.lit(False)}))
    known = write_shared(A.features(daily, own, both, carried=("y", "sample_weight", "fitted")), "known", "fitted")
    early = known.filter("fitted").withColumn("late", F.col("date") >= "2026-07-22")
    rows = known.filter("NOT fitted").withColumn("recency", -F.col("days_since_last_edit"))
    rankings = {"model": ["score"], **R.BASELINES}
    needed = dict.fromkeys(k for keys in rankings.values() for k in keys)
    scored = write_shared(M.score(M.fit(early, "late", rounds=10, weight="sample_weight"), rows).select("date", "page_id", "y", *needed), "scored")
    return R.ranking_metrics(scored, rankings, (10, 100), (100,))


def l10_daily_score(spark, d):
    """The ranking by edits of the day before against the outcomes of each day."""
    _, daily, _ = Q._features(spark, d)
    hits = daily.filter("is_burst_excl_mass AND editors_excl_mass >= 2").select("page_id", F.col("day").alias("date")).withColumn("y", F.lit(True))
    before = daily.filter("edits > 0").select("page_id", F.date_add("day", 1).alias("date"), F.col("edits").alias("score"))
    scored = before.join(hits, ["page_id", "date"], "left").withColumn("y", F.coalesce("y", F.lit(False)))
    return R.day_metrics(scored, (10, 100), ())


def l10_daily_model(spark, d):
    """A model of bursts fitted on a bounded sample of the pages of earlier days ranks every page of the day with a revision in the month before; its measures beside the ranking by edits of the day before.

    The sample (documented, of labelled rows): all bursts of the ten days before and one of twenty of the other page-days.
    """
    own = Q.kept_labels(spark, d)
    daily = write_shared(A.with_bursts(A.daily_activity(own, Q.MASS)), "daily")
    hits = daily.filter("is_burst_excl_mass AND editors_excl_mass >= 2").select("page_id", F.col("day").alias("date"), F.lit(True).alias("y"))
    pages = lambda day: daily.filter((F.col("day") < F.lit(day)) & (F.col("day") >= F.lit(day - timedelta(days=30)))).select("page_id").distinct().withColumn("date", F.lit(day))
    labelled = lambda rows: rows.join(hits, ["page_id", "date"], "left").withColumn("y", F.coalesce("y", F.lit(False)))
    earlier = labelled(reduce(lambda a, b: a.unionByName(b), [pages(DAY - timedelta(days=i)) for i in range(1, 11)]))
    drawn = earlier.filter(F.col("y") | (P.hash_share(F.col("page_id") * 31 + F.unix_date("date")) < P.SPAN // 20))
    train = write_shared(A.features(daily, own, drawn).join(drawn, ["page_id", "date"]).withColumns({"late": F.col("date") >= F.lit(DAY - timedelta(days=3)), "w": F.when(F.col("y"), 1.0).otherwise(20.0)}), "train")
    asked = labelled(pages(DAY))
    rows = write_shared(A.features(daily, own, asked).join(asked, ["page_id", "date"]), "day")
    model = M.score(M.fit(train, "late", rounds=8, weight="w"), rows).select("date", "page_id", "score", "y")
    before = rows.select("date", "page_id", F.col("edits_1d").cast("double").alias("score"), "y")
    parts = [R.day_metrics(x, (10, 100), (100,)).select(F.lit(n).alias("ranking"), "*") for n, x in (("model", model), ("edits_yesterday", before))]
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (s1_page_xml, s2_history_lines, s3_sql_dump, s5_live_changes, s13_month_buckets, s15_append_missing, s16_json_sink, x1_daily_stream, l8_daily_features, l9_daily_outcomes, l5_model, l10_daily_score, l10_daily_model)}

_S = "(SELECT CAST(sum({0}) AS BIGINT) FROM bu WHERE bu.page_id = ca.page_id AND bu.day BETWEEN DATE '2026-08-01' - {1} AND DATE '2026-07-31')"
SQL = {
    "s1_page_xml": Q.LOG + " SELECT page_id, page_title, revision_id, ts, user_text, coalesce(byte_size, 0) AS byte_size FROM o WHERE page_title IS NOT NULL",
    "s2_history_lines": "SELECT page_id, revision_id, parent_id, timestamp AS ts, user_text, is_anon, is_bot, byte_size, sha1 FROM revisions WHERE page_id IS NOT NULL AND namespace = 0",
    "s3_sql_dump": "SELECT c_custkey AS id, c_name AS name, CAST(nullif(c_nationkey, 0) AS BIGINT) AS nation FROM customer",
    "s5_live_changes": "SELECT page_id, revision_id, timestamp AS ts, user_text, coalesce(is_anon, false) AS is_anon, coalesce(is_bot, false) AS is_bot, CASE WHEN coalesce(parent_id, 0) = 0 THEN timestamp END AS page_created FROM revisions WHERE page_id IS NOT NULL AND namespace = 0 AND (coalesce(parent_id, 0) = 0 OR page_title IS NOT NULL) AND timestamp >= TIMESTAMP '2026-07-07' AND timestamp < TIMESTAMP '2026-07-09'",
    "s13_month_buckets": Q.LOG + " SELECT '2026-07' AS month, page_id % 8 AS bucket, count(*) AS n FROM o WHERE strftime(ts, '%Y-%m') = '2026-07' GROUP BY ALL",
    "s15_append_missing": "SELECT date, count(*) AS n FROM (SELECT DISTINCT page_id, date FROM burst_days) GROUP BY date",
    "s16_json_sink": "SELECT * FROM forecast_days",
    "x1_daily_stream": "WITH r AS (SELECT revision_id, min(timestamp) AS t FROM revisions GROUP BY ALL) SELECT CAST(t AS DATE) AS day, count(*) AS revisions FROM r GROUP BY ALL",
    "l8_daily_features": Q.BURSTS + f", ca AS (SELECT DISTINCT page_id FROM o WHERE ts >= TIMESTAMP '2026-07-15' AND ts < TIMESTAMP '{DAY}') SELECT page_id, DATE '{DAY}' AS date, " + ", ".join(f"coalesce({_S.format('edits', k)}, 0) AS edits_{k}d" for k in (1, 7, 30)) + f", (SELECT count(DISTINCT user_text) FROM l WHERE l.page_id = ca.page_id AND channel = 'edits' AND user_text <> '' AND l.day BETWEEN DATE '{DAY}' - 7 AND DATE '{DAY}' - 1) AS editors_7d, coalesce({_S.format('is_burst::INT', 30)}, 0) AS burst_days_30d FROM ca",
    "l10_daily_score": Q.BURSTS + ", sc AS (SELECT b.page_id, b.day + 1 AS date, b.edits AS score, coalesce(h.is_burst_excl_mass AND h.editors_excl_mass >= 2, false) AS y FROM bu b LEFT JOIN bu h ON h.page_id = b.page_id AND h.day = b.day + 1 WHERE b.edits > 0), rk AS (SELECT *, row_number() OVER w AS rank, CAST(sum(y::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hits FROM sc WINDOW w AS (PARTITION BY date ORDER BY score DESC NULLS LAST, " + H32.format("page_id") + ", page_id)), " + _MET((10, 100), ()) + " SELECT * FROM dm",
    "l9_daily_outcomes": Q.BURSTS + f" SELECT page_id, day, editors_excl_mass FROM bu WHERE day = DATE '{DAY}' AND is_burst_excl_mass AND editors_excl_mass >= 2",
}

"""Queries on links, panels, rankings, samples and histories, and their SQL."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import functions as F

from palimpsest.operators import activity as A
from palimpsest.operators import history_joins as H
from palimpsest.operators import links as L
from palimpsest.operators import panel as P
from palimpsest.operators import ranking as R
from palimpsest.operators.labels import is_bot
from palimpsest.operators.revisions import first_delivery
from palimpsest.operators.rolling import rolling_totals
from palimpsest.plans import activity as Q
from palimpsest.plans.problems import REVISION
from palimpsest.shared import keep, shared_dir, table, write_shared
from palimpsest.sources import sinks

LAST, FINAL = date(2026, 8, 10), date(2026, 7, 31)
DAYS = [date(2026, 7, 5) + timedelta(days=7 * i) for i in range(5)]
CUT, DAY = "2026-07-15", "2026-08-01"


def links(spark, d):
    """A link graph over page ids, from the order lines: the driver's tables hold no links."""
    rows = table(spark, d, "lineitem")
    return rows.select((F.col("l_partkey") * 3 + 10000000).cast("bigint").alias("src"), (F.col("l_suppkey") * 31 + F.col("l_linenumber") + 10000000).cast("bigint").alias("dst")).filter("src <> dst").distinct()


def wiki(spark, d):
    """Page, redirect, link-target and link tables, from customers and orders."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("page_id"), F.col("c_name").alias("title"), (F.col("c_custkey") % 7 == 0).alias("is_redirect"))
    name = lambda k: F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    redirects = c.filter("is_redirect").select("page_id", name(F.col("page_id") + F.when(F.col("page_id") % 5 == 0, 0).otherwise(F.col("page_id") % 11 + 3)).alias("title"))
    targets = c.select((F.col("page_id") + 500000).alias("target_id"), "title")
    found = table(spark, d, "orders").select(F.col("o_custkey").cast("bigint").alias("src"), (F.col("o_orderkey") % 1700 + 500001).cast("bigint").alias("target_id"))
    return c, redirects, targets, found


def burst_days(spark, d):
    rows = table(spark, d, "burst_days").filter("is_burst").distinct()
    return rows.groupBy("page_id", F.col("date").alias("day")).agg(F.max("editors").alias("editors"))


def scored(spark, d, score="editors"):
    """Published page-days ranked by a count of editors; positive if they burst."""
    rows = table(spark, d, "burst_days").distinct()
    return rows.groupBy("date", "page_id").agg(F.max(score).cast("bigint").alias("score"), F.bool_or("is_burst").alias("y"))


def j2_link_targets(spark, d):
    c, r, t, _ = wiki(spark, d)
    return L.link_targets(c, r, t)


def j3_redirects(spark, d):
    c, r, _, _ = wiki(spark, d)
    return L.resolve_redirects(c, r)


def j4_link_graph(spark, d):
    return L.link_graph(*wiki(spark, d))


def j4_link_graph_kept(spark, d):
    c, r, t, f = wiki(spark, d)
    return L.link_graph(c, r, t, f, c.filter("page_id % 10 = 0"))


def u2_distinct_edges(spark, d):
    return links(spark, d)


def a16_degrees(spark, d):
    return L.degrees(links(spark, d))


def j5_neighbor_bursts(spark, d):
    asked = table(spark, d, "burst_days").select("page_id", "date").distinct()
    return L.neighbor_bursts(links(spark, d), burst_days(spark, d), asked)


def j12_bursting_neighbors(spark, d):
    asked = table(spark, d, "burst_days").select("page_id", "date")
    return L.bursting_neighbors(links(spark, d), burst_days(spark, d), asked).select("page_id", "date", "neighbor", F.col("rank").cast("bigint").alias("rank"))


def _daily(spark, d):
    own = Q.kept_labels(spark, d)
    return own, write_shared(A.daily_activity(own, Q.MASS), "daily")


def l1_panel(spark, d):
    return P.panel(_daily(spark, d)[1], LAST, 0.05, FINAL)


def l2_evaluation_days(spark, d):
    firsts = Q.log(spark, d).groupBy("page_id").agg(F.min(F.to_date("ts")).alias("first_day"))
    return P.evaluation_days(firsts, DAYS)


def l4_baselines(spark, d):
    return R.baseline_scores(Q._features(spark, d)[2])


def w16_lexicographic_rank(spark, d):
    rows = table(spark, d, "burst_days").distinct().filter("editors IS NOT NULL")
    return R.lexicographic_rank(rows, ["editors", "editors_excl_mass"]).select("date", "page_id", F.col("score").cast("bigint").alias("score"))


def w14_ranked(spark, d):
    return R.ranked(scored(spark, d)).select("date", "page_id", F.col("rank").cast("bigint").alias("rank"), "hits")


def a19_day_metrics(spark, d):
    return R.day_metrics(scored(spark, d), (10, 100), (10, 100))


def a20_macro_average(spark, d):
    return R.macro_average(a19_day_metrics(spark, d))


def a21_paired_difference(spark, d):
    a, b = (R.day_metrics(scored(spark, d, s), (10,), (10,)) for s in ("editors", "editors_excl_mass"))
    return R.paired_difference(a, b, "average_precision")


def a22_precision_table(spark, d):
    return R.day_metrics(scored(spark, d), (10, 50, 100, 1000), ())


def a35_lift(spark, d):
    """The share of page-days with a bursting neighbor, and their rate of bursts against all."""
    asked = table(spark, d, "burst_days").distinct().groupBy("page_id", "date").agg(F.bool_or("is_burst").alias("y"))
    rows = asked.join(L.neighbor_bursts(links(spark, d), burst_days(spark, d), asked), ["page_id", "date"])
    near, y = (F.col("in_bursting_1d") + F.col("out_bursting_1d")) > 0, F.col("y").cast("double")
    return rows.agg(F.round(F.avg(near.cast("double")), 6).alias("share"), F.round(F.avg(F.when(near, y)) / F.avg(y), 6).alias("lift"))


def k2_global_top(spark, d):
    return scored(spark, d).filter("score IS NOT NULL").orderBy(F.desc("score"), "date", "page_id").limit(100).select("date", "page_id", "score")


def k8_top_co_burst_days(spark, d):
    return burst_days(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "day").limit(10)


def k9_newest_day(spark, d):
    return table(spark, d, "burst_days").agg(F.max("date").alias("newest"))


def w18_top_and_others(spark, d):
    return P.top_and_others(scored(spark, d).filter("score IS NOT NULL"), 10, 5).select("date", "page_id", "score", "selection")


def w17_first_kept(spark, d):
    own = Q.labels(spark, d).filter(~is_bot() & ~F.col("is_revert") & ~F.col("is_reverted"))
    first = own.groupBy("page_id", F.to_date("ts").alias("date")).agg(F.min(F.struct("revision_id", "parent_id")).alias("f"))
    return first.select("page_id", "date", "f.revision_id", "f.parent_id")


def j1_selected_first_kept(spark, d):
    return table(spark, d, "forecast_days").select("page_id", "date").join(w17_first_kept(spark, d), ["page_id", "date"])


def j10_day_bounds(spark, d):
    return H.day_bounds(Q.labels(spark, d), table(spark, d, "forecast_days"))


def j11_neighbor_day_bounds(spark, d):
    parent = F.min(F.struct("revision_id", "parent_id"))["parent_id"]
    return Q.log(spark, d).groupBy("page_id", F.to_date("ts").alias("day")).agg(F.nullif(parent, F.lit(0)).alias("first_parent"), F.max("revision_id").alias("last_revision"))


def j13_merged_history(spark, d):
    own = write_shared(Q.log(spark, d), "log")
    return H.merged_history(own, own.filter(F.col("ts") >= F.lit(CUT).cast("timestamp_ntz")), CUT, DAY, 30).select("page_id", "revision_id")


def j14_titles_then(spark, d):
    """Each forecast day's title as it was at the page's last revision before the day, else the title shown."""
    then = table(spark, d, "titles").filter("title_then IS NOT NULL").groupBy("revision_id").agg(F.max("title_then").alias("title_then"))
    asked = table(spark, d, "forecast_days").select("page_id", "date", "page_title")
    bounds = H.day_bounds(Q.labels(spark, d), asked).select("page_id", "date", F.col("prompt_id").alias("revision_id"))
    rows = asked.join(bounds, ["page_id", "date"], "left").join(then, "revision_id", "left")
    return rows.select("page_id", "date", "revision_id", F.coalesce("title_then", "page_title").alias("title"))


def j15_changes_by_day(spark, d):
    """Of each forecast day the titles filed under the day before, and the number of rows filed under its page's own."""
    rows = table(spark, d, "titles").distinct().filter("title IS NOT NULL").groupBy(F.date_add("date", 1).alias("date"), F.translate("title", "_", " ").alias("name")).agg(F.count(F.lit(1)).alias("own"))
    titles = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n_titles"))
    asked = table(spark, d, "forecast_days").select("page_id", "date", F.translate("page_title", "_", " ").alias("name"))
    both = asked.join(rows, ["date", "name"], "left").join(titles, "date", "left")
    return both.select("page_id", "date", F.coalesce("n_titles", F.lit(0)).cast("bigint").alias("n_titles"), "own")


def j16_titles_at_revisions(spark, d):
    wanted = table(spark, d, "titles").select("revision_id").distinct()
    return Q.log(spark, d).join(wanted, "revision_id", "left_semi").select("revision_id", "page_title")


def j17_source_differences(spark, d):
    """First deliveries against last ones."""
    rows = table(spark, d, "revisions")
    fields = ["user_text", "byte_size", "sha1", "change_tag"]
    pick = lambda f: rows.groupBy("revision_id").agg(f(F.struct("fetched_at", *fields)).alias("v")).select("revision_id", *[F.col(f"v.{c}").alias(c) for c in fields])
    return H.source_differences(pick(F.min), pick(F.max), "revision_id", fields)


def j18_rank_agreement(spark, d):
    """Published totals of 30 days against those computed from the log: how the pages' ranks of each date agree, and the pages among the first 20 of both."""
    given = table(spark, d, "trailing_totals").select(F.col("page_id").alias("entity"), F.col("date").alias("day"), "edits_30d").filter("edits_30d IS NOT NULL")
    asked = given.select("entity", "day", F.col("edits_30d").alias("published"))
    days = first_delivery(table(spark, d, "revisions"), ["page_id", "timestamp"]).filter("page_id IS NOT NULL")
    daily = days.groupBy(F.col("page_id").alias("entity"), F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("edits"))
    rows = write_shared(rolling_totals(daily, asked, ["edits"], (30,)), "totals")
    place = lambda rows, c, name: R.positions(rows, "day", [F.desc(c), F.col("entity").asc()], {}).withColumnRenamed("rank", name)
    both = place(place(rows, "published", "a"), "edits_30d", "b")
    return both.groupBy(F.col("day").alias("date")).agg(F.round(F.corr("a", "b"), 6).alias("correlation"), F.count_if((F.col("a") <= 20) & (F.col("b") <= 20)).alias("top_20"), F.count_if(F.col("published") != F.col("edits_30d")).alias("differs"))


def pred_p10_hash_sample(spark, d):
    return Q.log(spark, d).filter(P.sampled(F.col("page_id"), 0.2)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def pred_p11_day_sample(spark, d):
    days = Q.log(spark, d).select("page_id", F.to_date("ts").alias("day")).distinct()
    return days.filter(P.day_draw(7) < int(0.1 * P.SPAN))


def pred_p8_day_grid(spark, d):
    return P.day_grid(spark, date(2026, 6, 1), date(2026, 8, 19), 7)


def pred_p9_time_splits(spark, d):
    spans = P.time_splits(date(2026, 8, 19), 20, 15, 20, 5)
    name = F.coalesce(*[F.when(s.holds("date"), n) for n, s in spans.items()])
    return table(spark, d, "burst_days").distinct().withColumn("split", name).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def pred_p18_burst_labels(spark, d):
    own = burst_days(spark, d).select("page_id", F.col("day").alias("date"), F.lit(True).alias("hit"))
    return table(spark, d, "forecast_days").join(own, ["page_id", "date"], "left").select("page_id", "date", F.col("hit").isNotNull().alias("y"))


def pred_p19_group_masks(spark, d):
    rows = scored(spark, d)
    groups = F.array_compact(F.array(F.lit("all"), F.when(F.col("score") >= 5, "top"), F.when(F.col("y"), "burst")))
    return rows.select(F.explode(groups).alias("group"), "score").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("editors"))


def a14_strata(spark, d):
    own = burst_days(spark, d).select("page_id").distinct().withColumn("b", F.lit(True))
    counts = Q.log(spark, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(own, "page_id", "left").select("page_id", P.edit_bucket(F.col("n")).alias("bucket"), F.col("b").isNotNull().alias("had_burst"))


def a15_stratified_sample(spark, d):
    return P.stratified_sample(a14_strata(spark, d), ["bucket", "had_burst"], 25)


def u1_union_all(spark, d):
    a = table(spark, d, "burst_days").select("page_id", "date", "editors")
    b = table(spark, d, "forecast_days").select("page_id", "date", "page_title")
    return a.unionByName(b, allowMissingColumns=True)


def u4_common_pages(spark, d):
    return table(spark, d, "burst_days").select("page_id").intersect(table(spark, d, "forecast_days").select("page_id"))


def u5_missing_pages(spark, d):
    return table(spark, d, "trailing_totals").select("page_id").distinct().join(table(spark, d, "forecast_days").select("page_id"), "page_id", "left_anti")


def j22_still_to_fetch(spark, d):
    """Titles' revisions that the log doesn't hold, and those without a title however often they were fetched."""
    rows = table(spark, d, "titles").select("revision_id", F.col("title_then").isNull().alias("again")).distinct()
    have = table(spark, d, "revisions").select("revision_id").distinct().withColumn("h", F.lit(True))
    return rows.join(have, "revision_id", "left").filter("again OR h IS NULL").select("revision_id", "again")


def s14_missing_days(spark, d):
    return H.require_days(table(spark, d, "forecast_days").select(F.col("date").alias("day")), "2026-06-01", "2026-08-19")


def s18_prune(spark, d):
    """A table with a folder for each day, of which those of more than 14 days before the newest are removed."""
    path = keep(spark, f"{shared_dir(spark)}/palimpsest-prune-{uuid.uuid4().hex}")
    table(spark, d, "burst_days").repartition("date").write.partitionBy("date").parquet(path)
    sinks.prune_days(spark, path, 14)
    return spark.read.parquet(path).groupBy(F.col("date").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def a28_percentiles(spark, d):
    rows = table(spark, d, "burst_days").distinct().filter("editors IS NOT NULL")
    return rows.groupBy("date").agg(*[F.percentile("editors", p / 100).alias(f"p{p}") for p in (25, 50, 75, 90)])


def a29_value_counts(spark, d):
    return table(spark, d, "titles").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def k1_page_order(spark, d):
    """The place of each revision in its page by time, then id."""
    own = Q.log(spark, d).select("page_id", "revision_id", "ts")
    return R.positions(own, "page_id", [F.col("ts").asc(), F.col("revision_id").asc()], {}).select("page_id", "revision_id", F.col("rank").alias("n"))


QUERIES = {f.__name__: f for f in (j2_link_targets, j3_redirects, j4_link_graph, j4_link_graph_kept, u2_distinct_edges, a16_degrees, j5_neighbor_bursts, j12_bursting_neighbors, l1_panel, l2_evaluation_days, l4_baselines, w16_lexicographic_rank, w14_ranked, a19_day_metrics, a20_macro_average, a21_paired_difference, a22_precision_table, a35_lift, k2_global_top, k8_top_co_burst_days, k9_newest_day, w18_top_and_others, w17_first_kept, j1_selected_first_kept, j10_day_bounds, j11_neighbor_day_bounds, j13_merged_history, j14_titles_then, j15_changes_by_day, j16_titles_at_revisions, j17_source_differences, j18_rank_agreement, pred_p10_hash_sample, pred_p11_day_sample, pred_p8_day_grid, pred_p9_time_splits, pred_p18_burst_labels, pred_p19_group_masks, a14_strata, a15_stratified_sample, u1_union_all, u4_common_pages, u5_missing_pages, j22_still_to_fetch, s14_missing_days, s18_prune, a28_percentiles, a29_value_counts, k1_page_order)}

H32 = "((({0}) % 4294967296) * 2654435761::HUGEINT % 4294967296)"
_WIKI = """WITH c AS (SELECT c_custkey AS page_id, c_name AS title, c_custkey % 7 = 0 AS red FROM customer), rd AS (SELECT page_id, 'Customer#' || lpad(CAST(page_id + CASE WHEN page_id % 5 = 0 THEN 0 ELSE page_id % 11 + 3 END AS VARCHAR), 9, '0') AS title FROM c WHERE red),
    d1 AS (SELECT rd.page_id, c.page_id AS target, c.red FROM rd JOIN c USING (title)), rs AS (SELECT DISTINCT a.page_id, CASE WHEN NOT a.red THEN a.target WHEN NOT b.red THEN b.target END AS target FROM d1 a LEFT JOIN d1 b ON b.page_id = a.target),
    ok AS (SELECT * FROM rs WHERE target IS NOT NULL AND target <> page_id), lt AS (SELECT c.page_id + 500000 AS target_id, CASE WHEN red THEN ok.target ELSE c.page_id END AS page_id FROM c LEFT JOIN ok USING (page_id) WHERE NOT red OR ok.target IS NOT NULL),
    g AS (SELECT DISTINCT o_custkey AS src, lt.page_id AS dst FROM orders JOIN lt ON lt.target_id = o_orderkey % 1700 + 500001 WHERE o_custkey <> lt.page_id AND o_custkey % 7 <> 0)"""
_LINKS = "WITH e AS (SELECT DISTINCT l_partkey * 3 + 10000000 AS src, l_suppkey * 31 + l_linenumber + 10000000 AS dst FROM lineitem WHERE l_partkey * 3 <> l_suppkey * 31 + l_linenumber), bd AS (SELECT page_id, date AS day, max(editors) AS editors FROM burst_days WHERE is_burst GROUP BY ALL)"
_DEG = "dg AS (SELECT page_id, CAST(sum(i) AS BIGINT) AS in_links, CAST(sum(o) AS BIGINT) AS out_links FROM (SELECT src AS page_id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY page_id)"
_NEAR = _LINKS + f""", {_DEG}, f AS (SELECT DISTINCT page_id, date FROM burst_days), i AS (SELECT dst AS page_id, day, count(*) AS n, count(*) FILTER (editors >= 2) AS m FROM bd JOIN e ON e.src = bd.page_id GROUP BY ALL), o AS (SELECT src AS page_id, day, count(*) AS n, count(*) FILTER (editors >= 2) AS m FROM bd JOIN e ON e.dst = bd.page_id GROUP BY ALL),
    n AS (SELECT f.page_id, f.date, {', '.join(f"coalesce((SELECT CAST(sum({m}) AS BIGINT) FROM {t} WHERE {t}.page_id = f.page_id AND {t}.day BETWEEN f.date - {k} AND f.date - 1), 0) AS {a}" for t, m, k, a in (("i", "n", 1, "in_bursting_1d"), ("o", "n", 1, "out_bursting_1d"), ("i", "n", 7, "in_bursting_7d"), ("o", "n", 7, "out_bursting_7d"), ("i", "m", 1, "in_multi_1d"), ("o", "m", 1, "out_multi_1d")))},
    coalesce(in_links, 0) AS in_links, coalesce(out_links, 0) AS out_links FROM f LEFT JOIN dg USING (page_id))"""
_SC = "sc AS (SELECT date, page_id, CAST(max({0}) AS BIGINT) AS score, bool_or(is_burst) AS y FROM burst_days GROUP BY ALL), rk AS (SELECT *, row_number() OVER w AS rank, CAST(sum(y::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hits FROM sc WINDOW w AS (PARTITION BY date ORDER BY score DESC NULLS LAST, " + H32.format("page_id") + ", page_id))"
_MET = lambda ps, rs: "dm AS (SELECT date, " + ", ".join([f"round(count(*) FILTER (y AND rank <= {k}) / {k}::DOUBLE, 6) AS precision_{k}" for k in ps] + [f"round(CASE WHEN count(*) FILTER (y) > 0 THEN count(*) FILTER (y AND rank <= {k}) / (count(*) FILTER (y))::DOUBLE END, 6) AS recall_{k}" for k in rs]) + ", round(avg(CASE WHEN y THEN hits / rank::DOUBLE END), 6) AS average_precision FROM rk GROUP BY date)"
_SCORED = "WITH " + _SC.format("editors")
_DRAW = H32.format(H32.format("page_id") + " + (day - DATE '1970-01-01') * 40503 + {0}")
_D = "DATE '{0}'"
_STRATA = Q.LOG + ", ct AS (SELECT page_id, count(*) AS n FROM o GROUP BY page_id), sa AS (SELECT page_id, CASE WHEN n < 5 THEN 'low' WHEN n < 25 THEN 'medium' ELSE 'high' END AS bucket, page_id IN (SELECT page_id FROM burst_days WHERE is_burst) AS had_burst FROM ct)"

SQL = {
    "j2_link_targets": _WIKI + " SELECT target_id, page_id FROM lt",
    "j3_redirects": _WIKI + " SELECT page_id, target FROM ok",
    "j4_link_graph": _WIKI + " SELECT src, dst FROM g",
    "j4_link_graph_kept": _WIKI + " SELECT src, dst FROM g WHERE src % 10 = 0 OR dst % 10 = 0",
    "u2_distinct_edges": _LINKS + " SELECT src, dst FROM e",
    "a16_degrees": _LINKS + f", {_DEG} SELECT * FROM dg",
    "j5_neighbor_bursts": _NEAR + " SELECT *, round(in_bursting_1d / greatest(in_links, 1)::DOUBLE, 6) AS in_share_1d, round(out_bursting_1d / greatest(out_links, 1)::DOUBLE, 6) AS out_share_1d FROM n",
    "j12_bursting_neighbors": _LINKS + ", u AS (SELECT src AS page_id, dst AS neighbor FROM e UNION SELECT dst, src FROM e), h AS (SELECT f.page_id, f.date, u.neighbor, row_number() OVER (PARTITION BY f.page_id, f.date ORDER BY bd.editors DESC NULLS LAST, u.neighbor DESC) AS rank FROM (SELECT DISTINCT page_id, date FROM burst_days) f JOIN u USING (page_id) JOIN bd ON bd.page_id = u.neighbor AND bd.day = f.date - 1) SELECT * FROM h WHERE rank <= 8",
    "l1_panel": Q.DAILY + f""", fi AS (SELECT page_id, min(day) AS first_day FROM da GROUP BY page_id), bl AS (SELECT page_id, first_day, unnest(range(0, CAST(floor((DATE '{LAST}' - first_day - 1) / 20.0) AS BIGINT) + 1)) AS b FROM fi WHERE first_day < DATE '{LAST}'),
        dr AS (SELECT page_id, first_day + CAST(b * 20 + 1 + floor({H32.format(H32.format('page_id') + ' + b * 40503')} * 20 / 4294967296.0) AS INT) AS day FROM bl),
        pa AS (SELECT da.page_id, da.day, da.kept_edits FROM da JOIN fi USING (page_id) WHERE kept_edits > 0 AND da.day > first_day AND da.day <= DATE '{LAST}' UNION ALL SELECT page_id, day, 0 FROM dr WHERE day <= DATE '{LAST}' AND (page_id, day) NOT IN (SELECT (page_id, day) FROM da WHERE kept_edits > 0))
        SELECT page_id, day AS date, kept_edits > 0 AS y, kept_edits, CASE WHEN kept_edits > 0 THEN 1.0 ELSE 20.0 END::DOUBLE AS sample_weight, day <= DATE '{FINAL}' AS label_is_final FROM pa""",
    "l2_evaluation_days": Q.LOG + ", fi AS (SELECT page_id, min(day) AS first_day FROM o GROUP BY page_id), ev AS (SELECT unnest([" + ", ".join(f"DATE '{x}'" for x in DAYS) + "]) AS date) SELECT page_id, date FROM fi, ev WHERE date > first_day",
    "l4_baselines": Q.FEATURES + " " + " UNION ALL ".join(f"SELECT page_id, date, '{n}' AS baseline, dense_rank() OVER (PARTITION BY date ORDER BY {', '.join(('-days_since_last_edit' if k == 'recency' else k) + ' NULLS FIRST' for k in ks)}) - 1 AS score FROM ft" for n, ks in R.BASELINES.items()),
    "w16_lexicographic_rank": "SELECT date, page_id, dense_rank() OVER (PARTITION BY date ORDER BY editors, editors_excl_mass NULLS FIRST) - 1 AS score FROM (SELECT DISTINCT * FROM burst_days) WHERE editors IS NOT NULL",
    "w14_ranked": _SCORED + " SELECT date, page_id, rank, hits FROM rk",
    "a19_day_metrics": _SCORED + ", " + _MET((10, 100), (10, 100)) + " SELECT * FROM dm",
    "a20_macro_average": _SCORED + ", " + _MET((10, 100), (10, 100)) + " SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("precision_10", "precision_100", "recall_10", "recall_100", "average_precision")) + " FROM dm",
    "a21_paired_difference": "WITH a AS (" + _SCORED + ", " + _MET((10,), (10,)) + " SELECT * FROM dm), b AS (WITH " + _SC.format("editors_excl_mass") + ", " + _MET((10,), (10,)) + " SELECT * FROM dm), x AS (SELECT b.average_precision - a.average_precision AS d FROM a JOIN b USING (date)) SELECT round(avg(d), 6) AS mean, round(stddev_samp(d) / sqrt(count(d)), 6) AS se, count(*) FILTER (d > 0) AS days_better, count(*) FILTER (d < 0) AS days_worse, count(d) AS days FROM x",
    "a22_precision_table": _SCORED + ", " + _MET((10, 50, 100, 1000), ()) + " SELECT * FROM dm",
    "a35_lift": _NEAR + ", x AS (SELECT n.*, y FROM n JOIN (SELECT page_id, date, bool_or(is_burst) AS y FROM burst_days GROUP BY ALL) USING (page_id, date)) SELECT round(avg((in_bursting_1d + out_bursting_1d > 0)::INT), 6) AS share, round(avg(y::INT) FILTER (in_bursting_1d + out_bursting_1d > 0) / avg(y::INT), 6) AS lift FROM x",
    "k2_global_top": _SCORED + " SELECT date, page_id, score FROM sc WHERE score IS NOT NULL ORDER BY score DESC, date, page_id LIMIT 100",
    "k8_top_co_burst_days": _LINKS + " SELECT day, count(*) AS pages FROM bd GROUP BY day ORDER BY pages DESC, day LIMIT 10",
    "k9_newest_day": "SELECT max(date) AS newest FROM burst_days",
    "w18_top_and_others": _SCORED + f", s1 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, page_id) AS i FROM sc WHERE score IS NOT NULL), s2 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {H32.format('page_id')}, page_id) AS j FROM s1 WHERE i > 10) SELECT date, page_id, score, 'top' AS selection FROM s1 WHERE i <= 10 UNION ALL SELECT date, page_id, score, 'random' FROM s2 WHERE j <= 5",
    "w17_first_kept": Q.LABELS + ", k AS (SELECT page_id, day AS date, arg_min_null(parent_id, revision_id) AS parent_id, min(revision_id) AS revision_id FROM l WHERE NOT bot AND NOT is_revert AND NOT is_reverted GROUP BY ALL) SELECT page_id, date, revision_id, parent_id FROM k",
    "j1_selected_first_kept": Q.LABELS + ", k AS (SELECT page_id, day AS date, arg_min_null(parent_id, revision_id) AS parent_id, min(revision_id) AS revision_id FROM l WHERE NOT bot AND NOT is_revert AND NOT is_reverted GROUP BY ALL) SELECT page_id, date, revision_id, parent_id FROM k JOIN (SELECT page_id, date FROM forecast_days) USING (page_id, date)",
    "j10_day_bounds": Q.LABELS + " SELECT f.page_id, f.date, arg_max(revision_id, (ts, revision_id)) FILTER (day < f.date - 1) AS start_id, arg_max(revision_id, (ts, revision_id)) FILTER (day < f.date) AS prompt_id, arg_max(revision_id, (ts, revision_id)) FILTER (day = f.date AND NOT is_reverted) AS end_id, count(*) FILTER (day = f.date) AS edits_on_day FROM (SELECT DISTINCT page_id, date FROM forecast_days) f LEFT JOIN l USING (page_id) GROUP BY ALL",
    "j11_neighbor_day_bounds": Q.LOG + " SELECT page_id, day, nullif(arg_min_null(parent_id, revision_id), 0) AS first_parent, max(revision_id) AS last_revision FROM o GROUP BY ALL",
    "j13_merged_history": Q.LOG + f", ca AS (SELECT DISTINCT page_id FROM o WHERE ts >= TIMESTAMP '{CUT}' AND ts < TIMESTAMP '{DAY}' AND ts >= TIMESTAMP '{DAY}' - INTERVAL 30 DAY) SELECT page_id, revision_id FROM o WHERE ts < TIMESTAMP '{DAY}' AND page_id IN (SELECT page_id FROM ca)",
    "j14_titles_then": Q.LABELS + ", b AS (SELECT f.page_id, f.date, arg_max(revision_id, (ts, revision_id)) FILTER (day < f.date) AS revision_id FROM (SELECT DISTINCT page_id, date FROM forecast_days) f LEFT JOIN l USING (page_id) GROUP BY ALL), th AS (SELECT revision_id, max(title_then) AS title_then FROM titles GROUP BY revision_id) SELECT f.page_id, f.date, b.revision_id, coalesce(th.title_then, f.page_title) AS title FROM forecast_days f JOIN b USING (page_id, date) LEFT JOIN th ON th.revision_id = b.revision_id",
    "j15_changes_by_day": "WITH t AS (SELECT date + 1 AS date, replace(title, '_', ' ') AS title, count(*) AS n FROM (SELECT DISTINCT * FROM titles) WHERE title IS NOT NULL GROUP BY ALL) SELECT f.page_id, f.date, (SELECT count(*) FROM t WHERE t.date = f.date) AS n_titles, (SELECT n FROM t WHERE t.date = f.date AND t.title = replace(f.page_title, '_', ' ')) AS own FROM forecast_days f",
    "j16_titles_at_revisions": Q.LOG + " SELECT revision_id, page_title FROM o WHERE revision_id IN (SELECT revision_id FROM titles)",
    "j17_source_differences": "WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY fetched_at) AS i FROM revisions) WHERE i = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY fetched_at DESC) AS i FROM revisions) WHERE i = 1) SELECT count(*) FILTER (a.revision_id = b.revision_id) AS shared, count(*) FILTER (b.revision_id IS NULL) AS only_a, count(*) FILTER (a.revision_id IS NULL) AS only_b, "
    + ", ".join(f"count(*) FILTER (a.revision_id = b.revision_id AND a.{c} IS DISTINCT FROM b.{c}) AS {c}_differs" for c in ("user_text", "byte_size", "sha1", "change_tag")) + " FROM a FULL JOIN b ON a.revision_id = b.revision_id",
    "j18_rank_agreement": REVISION + ", e AS (SELECT page_id, CAST(timestamp AS DATE) AS day, count(*) AS n FROM r WHERE page_id IS NOT NULL GROUP BY ALL), c AS (SELECT p.date, p.page_id, p.edits_30d AS published, coalesce((SELECT sum(n) FROM e WHERE e.page_id = p.page_id AND e.day BETWEEN p.date - 30 AND p.date - 1), 0) AS computed FROM trailing_totals p WHERE edits_30d IS NOT NULL), x AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY published DESC, page_id) AS a, row_number() OVER (PARTITION BY date ORDER BY computed DESC, page_id) AS b FROM c) SELECT date, round(corr(a, b), 6) AS correlation, count(*) FILTER (a <= 20 AND b <= 20) AS top_20, count(*) FILTER (published <> computed) AS differs FROM x GROUP BY date",
    "pred_p10_hash_sample": Q.LOG + f" SELECT page_id, count(*) AS n FROM o WHERE {H32.format('page_id')} < {int(0.2 * P.SPAN)} GROUP BY page_id",
    "pred_p11_day_sample": Q.LOG + f" SELECT DISTINCT page_id, day FROM o WHERE {_DRAW.format(7)} < {int(0.1 * P.SPAN)}",
    "pred_p8_day_grid": "SELECT CAST(unnest(generate_series(DATE '2026-06-01', DATE '2026-08-19', INTERVAL 7 DAY)) AS DATE) AS day",
    "pred_p9_time_splits": "SELECT CASE WHEN date BETWEEN DATE '2026-07-31' AND DATE '2026-08-19' THEN 'test' WHEN date BETWEEN DATE '2026-07-11' AND DATE '2026-07-25' THEN 'validation' WHEN date BETWEEN DATE '2026-06-16' AND DATE '2026-07-05' THEN 'train' END AS split, count(*) AS n FROM (SELECT DISTINCT * FROM burst_days) GROUP BY ALL",
    "pred_p18_burst_labels": "SELECT page_id, date, (page_id, date) IN (SELECT (page_id, date) FROM burst_days WHERE is_burst) AS y FROM forecast_days",
    "pred_p19_group_masks": _SCORED + ", g AS (SELECT 'all' AS grp, score FROM sc UNION ALL SELECT 'top', score FROM sc WHERE score >= 5 UNION ALL SELECT 'burst', score FROM sc WHERE y) SELECT grp AS \"group\", count(*) AS n, CAST(sum(score) AS BIGINT) AS editors FROM g GROUP BY grp",
    "a14_strata": _STRATA + " SELECT * FROM sa",
    "a15_stratified_sample": _STRATA + f" SELECT page_id, bucket, had_burst FROM (SELECT *, row_number() OVER (PARTITION BY bucket, had_burst ORDER BY {H32.format('page_id')}, page_id) AS i FROM sa) WHERE i <= 25",
    "u1_union_all": "SELECT page_id, date, editors, page_title FROM (SELECT page_id, date, editors, NULL::VARCHAR AS page_title FROM burst_days UNION ALL SELECT page_id, date, NULL, page_title FROM forecast_days)",
    "u4_common_pages": "SELECT page_id FROM burst_days INTERSECT SELECT page_id FROM forecast_days",
    "u5_missing_pages": "SELECT page_id FROM trailing_totals EXCEPT SELECT page_id FROM forecast_days",
    "j22_still_to_fetch": "SELECT DISTINCT revision_id, title_then IS NULL AS again FROM titles WHERE title_then IS NULL OR revision_id NOT IN (SELECT revision_id FROM revisions WHERE revision_id IS NOT NULL)",
    "s14_missing_days": "SELECT CAST(day AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '2026-06-01', DATE '2026-08-19', INTERVAL 1 DAY)) AS day) WHERE CAST(day AS DATE) NOT IN (SELECT date FROM forecast_days)",
    "s18_prune": "SELECT date, count(*) AS n FROM burst_days WHERE date >= (SELECT max(date) FROM burst_days) - 14 GROUP BY date",
    "a28_percentiles": "SELECT date, " + ", ".join(f"quantile_cont(editors, 0.{p})::DOUBLE AS p{p}" for p in (25, 50, 75, 90)) + " FROM (SELECT DISTINCT * FROM burst_days) WHERE editors IS NOT NULL GROUP BY date",
    "a29_value_counts": "SELECT kind, count(*) AS n FROM titles GROUP BY kind",
    "k1_page_order": Q.LOG + " SELECT page_id, revision_id, row_number() OVER (PARTITION BY page_id ORDER BY ts, revision_id) AS n FROM o",
}

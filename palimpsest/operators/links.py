"""The link graph from page, redirect, link-target and link tables, and bursts of linked pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.firsts import first_rows


def resolve_redirects(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """(page_id, target) of redirects that lead within two steps to a page that is none and isn't itself.

    ``pages``: page_id, title, is_redirect. ``redirects``: page_id, title of the target. Two equi-joins, no recursion.
    """
    ids = pages.select(F.col("page_id").alias("target"), "title", F.col("is_redirect").alias("onward"))
    sources = pages.filter("is_redirect").select("page_id")
    direct = redirects.join(sources, "page_id", "left_semi").join(ids, "title").select("page_id", "target", "onward")
    second = direct.select(F.col("page_id").alias("target"), F.col("target").alias("target2"), F.col("onward").alias("onward2"))
    both = direct.join(second, "target", "left")
    final = F.when(~F.col("onward"), F.col("target")).when(~F.col("onward2"), F.col("target2"))
    return both.select("page_id", final.alias("target")).filter(F.col("target").isNotNull() & (F.col("target") != F.col("page_id"))).distinct()


def link_targets(pages: DataFrame, redirects: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, page_id): the page that a link target leads to, through redirects; targets that lead nowhere are left out."""
    resolved = resolve_redirects(pages, redirects).withColumnRenamed("target", "final")
    named = targets.join(pages.select("page_id", "title", "is_redirect"), "title").join(resolved, "page_id", "left")
    final = F.when(F.col("is_redirect"), F.col("final")).otherwise(F.col("page_id"))
    return named.select("target_id", final.alias("page_id")).filter(F.col("page_id").isNotNull())


def link_graph(pages: DataFrame, redirects: DataFrame, targets: DataFrame, links: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Unique (src, dst), without links from redirects, to nowhere or to itself; with ``keep`` those with a kept end."""
    found = link_targets(pages, redirects, targets)
    edges = links.join(found, "target_id").select("src", F.col("page_id").alias("dst")).filter("src <> dst")
    edges = edges.join(pages.filter("is_redirect").select(F.col("page_id").alias("src")), "src", "left_anti")
    if keep is not None:
        kept = keep.select(F.col("page_id").alias("src"), F.lit(True).alias("_s")).distinct()
        ends = keep.select(F.col("page_id").alias("dst"), F.lit(True).alias("_d")).distinct()
        edges = edges.join(kept, "src", "left").join(ends, "dst", "left").filter("_s OR _d").select("src", "dst")
    return edges.distinct()


def degrees(edges: DataFrame) -> DataFrame:
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    ends = edges.select(F.col("src").alias("page_id"), zero.alias("i"), one.alias("o")).unionByName(edges.select(F.col("dst").alias("page_id"), one.alias("i"), zero.alias("o")))
    return ends.groupBy("page_id").agg(F.sum("i").alias("in_links"), F.sum("o").alias("out_links"))


def neighbor_bursts(edges: DataFrame, bursts: DataFrame, asked: DataFrame) -> DataFrame:
    """Burst-days of linked pages before each asked (page_id, date): on the day before, in the week before, and their share.

    ``bursts``: page_id, day, editors of bursting page-days. A burst counts for the "in" side of every page it links to and the
    "out" side of every page that links to it. Bursts meet the edges by equality and are summed by page and day; only then do
    calendar frames run. Only edges of asked pages take part.
    """
    multi = (F.col("editors") >= 2).cast("bigint")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    pages = asked.select("page_id").distinct()
    into, out_of = (edges.join(pages.withColumnRenamed("page_id", c), c, "left_semi").select(F.col("src").alias("_s"), F.col("dst").alias("_t")) for c in ("dst", "src"))
    incoming = bursts.join(into, F.col("page_id") == F.col("_s")).select(F.col("_t").alias("page_id"), "day", one.alias("i"), multi.alias("im"), zero.alias("o"), zero.alias("om"))
    outgoing = bursts.join(out_of, F.col("page_id") == F.col("_t")).select(F.col("_s").alias("page_id"), "day", zero.alias("i"), zero.alias("im"), one.alias("o"), multi.alias("om"))
    measures = ["i", "im", "o", "om"]
    hits = incoming.unionByName(outgoing).groupBy("page_id", "day").agg(*[F.sum(m).alias(m) for m in measures]).withColumn("ask", F.lit(False))
    asks = asked.select("page_id", F.col("date").alias("day")).distinct().select("page_id", "day", *[zero.alias(m) for m in measures], F.lit(True).alias("ask"))
    page = W.partitionBy("page_id").orderBy(F.unix_date("day"))
    total = lambda m, k: F.coalesce(F.sum(m).over(page.rangeBetween(-k, -1)), zero)
    out = hits.unionByName(asks).select("page_id", F.col("day").alias("date"), "ask", total("i", 1).alias("in_bursting_1d"), total("o", 1).alias("out_bursting_1d"), total("i", 7).alias("in_bursting_7d"), total("o", 7).alias("out_bursting_7d"), total("im", 1).alias("in_multi_1d"), total("om", 1).alias("out_multi_1d")).filter("ask").drop("ask")
    out = out.join(degrees(edges), "page_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("in_links", "out_links")})
    share = lambda s: F.round(F.col(f"{s}_bursting_1d") / F.greatest(F.col(f"{s}_links"), F.lit(1)), 6).alias(f"{s}_share_1d")
    return out.select("*", share("in"), share("out"))


def bursting_neighbors(edges: DataFrame, bursts: DataFrame, asked: DataFrame, n: int = 8) -> DataFrame:
    """Up to ``n`` linked pages in either direction that burst on the day before, most editors first, the higher page_id first on a tie."""
    wanted = asked.select("page_id", "date").distinct()
    both = edges.select(F.col("src").alias("page_id"), F.col("dst").alias("neighbor")).unionByName(edges.select(F.col("dst").alias("page_id"), F.col("src").alias("neighbor"))).distinct()
    own = both.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    near = bursts.select(F.col("page_id").alias("neighbor"), F.date_add("day", 1).alias("date"), "editors").join(own, "neighbor")  # bursts first: they are few
    hits = near.join(wanted, ["page_id", "date"], "left_semi")
    return first_rows(hits, ["page_id", "date"], [F.desc("editors"), F.desc("neighbor")], n, "rank")

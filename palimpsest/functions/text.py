"""Text and array expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import names
from palimpsest.operators.firsts import first_rows
from palimpsest.shared import write_shared

SPACE = r" \t\r\n\f\x0B"


def pieces(text: Column) -> Column:
    """Runs of white space and of other characters; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(f"[{SPACE}]+|[^{SPACE}]+"), F.lit(0))


def sentences(text: Column, least: int = 25) -> Column:
    parts = F.transform(F.split(text, r"(?<=[.!?])[ \t\r\n\f\x0B]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= least)


def words(text: Column) -> Column:
    """Distinct lower-case words of four letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]{3,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cut(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most), " [^ ]*$", ""), F.lit(" …")))


def within_budget(parts: Column, budget: int) -> Column:
    """The strings of an array that fit one after the other; one that doesn't is passed over and later ones still tried."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        fits = acc.used + F.length(s) <= budget
        return F.struct(F.when(fits, acc.used + F.length(s)).otherwise(acc.used).alias("used"), F.when(fits, F.array_append(acc.kept, s)).otherwise(acc.kept).alias("kept"))

    return F.aggregate(parts, start, step, lambda acc: acc.kept)


def main_sections(sections: Column, chars: Column, k: int) -> Column:
    """The k sections with most characters; the earlier on a tie."""
    indexed = F.transform(F.arrays_zip(sections.alias("s"), chars.alias("c")), lambda x, i: F.struct((-x["c"]).alias("n"), i.alias("i"), x["s"].alias("s")))
    return F.transform(F.slice(F.array_sort(indexed), 1, k), lambda x: x["s"])


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n, line) of every line of every text."""
    return docs.filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def document_frequency(docs: DataFrame, most: float = 0.02) -> DataFrame:
    """Of each word the texts that hold it, ln(1 + n / (1 + df)), and whether it is rare enough to tell contents apart."""
    n = docs.count()
    df = docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.select("word", "df", F.round(F.log(1 + n / (1 + F.col("df"))), 6).alias("idf"), (F.col("df") < most * n).alias("content"))


def relevant_sentences(queries: DataFrame, candidates: DataFrame, frequency: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """Of each query (id, page_id, title, text) the sentences (page_id, sentence_id, sentence) of its page that name the title or share content words, named ones first, then best first.

    Only rare words and the words of titles join, so no common word brings all sentences of a page together; each task passes on
    ``most`` of a query.
    """
    rare = frequency.filter("content").select("word", "idf")
    asked = queries.select("id", "page_id", F.explode(words(F.col("text"))).alias("word")).join(rare, "word")
    held = candidates.select("page_id", "sentence_id", F.size(words(F.col("sentence"))).alias("size"), F.explode(words(F.col("sentence"))).alias("word"))
    shared = asked.join(held, ["page_id", "word"]).groupBy("id", "sentence_id").agg(F.count(F.lit(1)).alias("shared"), F.round(F.sum("idf") / F.sqrt(F.first("size") + 1), 4).alias("score"))
    titles = write_shared(names.titles_names(queries.select("id", "page_id", "title")), "names")
    spots = names.spots(candidates.select("page_id", "sentence_id", F.col("sentence").alias("text")), titles)
    named = spots.join(titles.drop("hashes"), ["page_id", "key"]).filter(names.fits()).select("id", "sentence_id", F.lit(True).alias("named")).distinct()
    both = shared.join(named, ["id", "sentence_id"], "full").na.fill(0, ["shared", "score"]).na.fill(False, ["named"]).filter(F.col("named") | (F.col("shared") >= least))
    return first_rows(both, ["id"], [F.desc("named"), F.desc("score"), F.col("sentence_id").asc()], most, "rank")


def news_items(docs: DataFrame) -> DataFrame:
    """(doc_id, n, category, topic, sentence) of nested bullet lists under bold categories.

    A bullet is a topic if the next bullet lies deeper, else a sentence under the last topic above it. Windows run over the lines
    of one text.
    """
    row = lines(docs).select("doc_id", "n", F.regexp_extract("line", r"^'''(.*?)'''\s*$", 1).alias("category"), F.regexp_extract("line", r"^(\*+)\s*(.*)$", 1).alias("stars"), F.regexp_extract("line", r"^(\*+)\s*(.*)$", 2).alias("body"))
    row = row.filter("category <> '' OR stars <> ''")
    text = W.partitionBy("doc_id").orderBy("n")
    depth = F.length("stars")
    below = F.when(F.col("stars") != "", F.coalesce(F.lead(depth).over(text), F.lit(0)) > depth)
    label = F.regexp_replace(F.regexp_replace("body", r"\[https?://[^\]]*\]", ""), r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", "$1")
    row = row.withColumns({"topic_line": F.coalesce(below, F.lit(False)), "label": F.trim(label)})
    seen = text.rowsBetween(W.unboundedPreceding, 0)
    category = F.last(F.when(F.col("category") != "", F.col("category")), ignorenulls=True).over(seen)
    topic = F.last(F.when(F.col("topic_line"), F.col("label")).when(F.col("category") != "", F.lit("")), ignorenulls=True).over(seen)
    out = row.withColumns({"_c": F.coalesce(category, F.lit("")), "_t": F.coalesce(F.when(depth > 1, topic), F.lit(""))})
    return out.filter("stars <> '' AND NOT topic_line AND label <> ''").select("doc_id", "n", F.col("_c").alias("category"), F.col("_t").alias("topic"), F.col("label").alias("sentence"))


def forecast_scores(forecasts: DataFrame) -> DataFrame:
    """Of each (id, named, changed, chars) section_precision, main_section_hit and jaccard; null where nothing is named or changed."""
    named, changed = F.array_distinct(F.slice("named", 1, 3)), F.col("changed")
    main = F.try_element_at(main_sections(changed, F.col("chars"), 1), F.lit(1))
    return forecasts.select("id", F.round(F.when(F.size(named) > 0, F.size(F.array_intersect(named, changed)) / F.size(named)), 6).alias("section_precision"), F.when(main.isNotNull(), F.array_contains(named, main).cast("double")).alias("main_section_hit"), F.round(jaccard(F.col("named"), changed), 6).alias("jaccard"))


def kind_marginals(lines_: DataFrame, kinds: int) -> DataFrame:
    """Of each (id, mask, logprob) how likely each kind is listed: (id, kind, p), over the lines given."""
    p = F.exp("logprob")
    spread = lines_.select("id", p.alias("p"), "mask", F.explode(F.sequence(F.lit(0), F.lit(kinds - 1))).alias("kind"))
    holds = F.expr("(shiftright(mask, kind) & 1) = 1")
    return spread.groupBy("id", "kind").agg(F.round(F.sum(F.when(holds, F.col("p")).otherwise(0.0)) / F.sum("p"), 6).alias("p"))


def best_thresholds(marginals: DataFrame, grid: list[float], rounds: int = 3) -> DataFrame:
    """Of each kind the threshold that, with the others', gives the highest mean Jaccard of the kinds with ``p >= t`` and those that ``did``.

    Coordinate ascent from 0.5 over (id, kind, p, did): in each round the kinds in order, each by one aggregate over all of ``grid``;
    a threshold moves only if that raises the mean. Adds that mean. Ids without said or done kinds count as 1.
    """
    kinds = sorted(r["kind"] for r in marginals.select("kind").distinct().collect())
    packed = marginals.groupBy("id").pivot("kind", kinds).agg(F.first("p").alias("p"), F.first("did").alias("did"))
    rows = write_shared(packed.select(*[F.coalesce(f"{k}_{c}", F.lit(z)).alias(f"{c}_{i}") for i, k in enumerate(kinds) for c, z in (("p", 0.0), ("did", False))]), "kinds")
    at = [0.5] * len(kinds)
    count = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))

    def means(j: int, tried: list[float]) -> list[float]:
        rest = [(F.col(f"p_{i}") >= at[i], F.col(f"did_{i}")) for i in range(len(kinds)) if i != j]
        ready = rows.select(F.col(f"p_{j}").alias("p"), F.col(f"did_{j}").alias("did"), count(s & d for s, d in rest).alias("both"), count(s | d for s, d in rest).alias("union"))
        each = ready.select("did", "both", "union", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col("p") >= t).alias("said")) for i, t in enumerate(tried)])).alias("x"))
        both, union = F.col("both") + (F.col("x.said") & F.col("did")).cast("int"), F.col("union") + (F.col("x.said") | F.col("did")).cast("int")
        found = each.groupBy("x.i").agg(F.avg(F.when(union > 0, both / union).otherwise(1.0)).alias("mean")).collect()
        return [r["mean"] for r in sorted(found, key=lambda r: r["i"])]

    best = means(0, [at[0]])[0] if kinds else None
    for _ in range(rounds if best is not None else 0):
        for j in range(len(kinds)):
            for t, mean in zip(grid, means(j, grid)):
                if mean > best + 1e-12:
                    best, at[j] = mean, t
    schema = T.StructType([marginals.schema["kind"], T.StructField("threshold", T.DoubleType()), T.StructField("jaccard", T.DoubleType())])
    return marginals.sparkSession.createDataFrame([(k, t, None if best is None else round(best, 6)) for k, t in zip(kinds, at)], schema)


def relative_day(days: Column) -> Column:
    """When a day falls that is so many days ahead."""
    n = F.abs(days)
    far = F.when(n <= 60, F.concat(n.cast("string"), F.lit(" days"))).when(n < 365, F.concat(F.lit("about "), F.round(n / 30.4).cast("int").cast("string"), F.lit(" months"))).when(F.round(n / 365.25) == 1, "about a year").otherwise(F.concat(F.lit("about "), F.round(n / 365.25).cast("int").cast("string"), F.lit(" years")))
    return F.when(days == 0, "today").when(days == 1, "tomorrow").when(days == -1, "yesterday").when(days > 0, F.concat(F.lit("in "), far)).otherwise(F.concat(far, F.lit(" ago")))


def relative_span(first: Column, last: Column) -> Column:
    """When a span of days falls whose ends are so many days ahead."""
    told = F.when(first > 0, F.concat(F.lit("starts "), relative_day(first))).when(last < 0, F.concat(F.lit("ended "), relative_day(last)))
    told = told.when(first == 0, F.concat(F.lit("starts today, ends "), relative_day(last))).otherwise(F.concat(F.lit("under way, ends "), relative_day(last)))
    return F.when(first == last, relative_day(first)).otherwise(told)


def nearest_year(month: Column, day: Column, near: Column) -> Column:
    """The date of that month and day nearest ``near``; null if none exists in the three years around it."""
    years = F.sequence(F.year(near) - 1, F.year(near) + 1)
    dates = F.filter(F.transform(years, lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day))), lambda d: d.isNotNull())
    return F.array_min(F.transform(dates, lambda d: F.struct(F.abs(F.datediff(d, near)).alias("n"), d.alias("d"))))["d"]

"""News lists: nested bullets under bold categories, whose inner bullets are topics and whose leaves are reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import relative_day

#: Parts of a report's path, side by side.
BETWEEN = " › "
_CATEGORY = re.compile(r"'''(.*?)'''\s*$")
_BULLET = re.compile(r"(\*+)\s*(.*)$")
_SOURCE = re.compile(r"\[https?://[^\]]*\]")
_LABEL = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]")


def clean(line: str) -> str:
    """A line without the links to its sources and without emphasis, links as their labels."""
    return re.sub(" {2,}", " ", _LABEL.sub(r"\1", _SOURCE.sub("", line)).replace("'''", "").replace("''", "")).strip(" ")


def reports(text: str | None) -> list[tuple[int, str, list[str], str]]:
    """(line, category, topics from the outermost, sentence) of each report. A bullet with a deeper one after it is a topic."""
    marks: list[tuple[int, int, str]] = []  # line, depth (0: a category), text
    for n, line in enumerate((text or "").split("\n")):
        if category := _CATEGORY.match(line):
            marks.append((n, 0, category[1]))
        elif bullet := _BULLET.match(line):
            marks.append((n, len(bullet[1]), bullet[2]))
    out, category, over = [], "", []
    for (n, depth, said), (_, below, _) in zip(marks, [*marks[1:], (0, 0, "")]):
        while over and over[-1][0] >= max(depth, 1):
            over.pop()
        if not depth:
            category, over = clean(said), []
        elif below > depth:
            over.append((depth, clean(said)))
        elif sentence := clean(said):
            out.append((n, category, [topic for _, topic in over], sentence))
    return out


def news_reports(docs: DataFrame) -> DataFrame:
    """The reports of every text (doc_id, day, text): doc_id, day, n, category, topics, sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, text in enumerate(batch.column(2).to_pylist()) for r in reports(text)]
            at, n, category, topics, sentence = zip(*rows) if rows else [[]] * 5
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(n, pa.int64()), pa.array(category, pa.string()), pa.array(topics, pa.list_(pa.string())), pa.array(sentence, pa.string())], names=["doc_id", "day", "n", "category", "topics", "sentence"])

    return docs.select("doc_id", "day", "text").mapInArrow(run, "doc_id bigint, day date, n bigint, category string, topics array<string>, sentence string")


def _rest(topics: Column, at: Column, sentence: Column) -> Column:
    """What a report says below its ``at``-th topic."""
    return F.array_join(F.array_append(F.slice(topics, at + 1, F.size(topics)), sentence), BETWEEN)


def story_reports(rows: DataFrame, day: str, week: int = 7) -> DataFrame:
    """The reports of the ``week`` before ``day`` by story: story, day, category, report; each report once.

    A report belongs to the deepest of its topics that the week also lists as an outermost one; one without topics to none.
    """
    d = F.lit(day).cast("date")
    own = rows.filter((F.size("topics") > 0) & (F.col("day") < d) & (F.col("day") >= F.date_sub(d, week))).withColumn("_id", F.monotonically_increasing_id())
    firsts = own.select(F.col("topics")[0].alias("story")).distinct()
    spread = own.select("_id", F.posexplode("topics").alias("at", "story")).join(firsts, "story")
    chosen = spread.groupBy("_id").agg(F.max(F.struct("at", "story")).alias("s"))
    both = own.select("_id", "day", "category", "topics", "sentence").join(chosen, "_id")
    return both.select(F.col("s.story").alias("story"), "day", "category", _rest(F.col("topics"), F.col("s.at") + 1, F.col("sentence")).alias("report")).groupBy("story", "day", "report").agg(F.min("category").alias("category"))


def stories(found: DataFrame, day: str, recent: int = 2) -> DataFrame:
    """Of each story its reports, those of the last days, the latest day and the commonest category; stories without a recent report are left out."""
    since = F.date_sub(F.lit(day).cast("date"), recent)
    out = found.groupBy("story").agg(F.count(F.lit(1)).alias("reports"), F.count_if(F.col("day") >= since).alias("recent"), F.max("day").alias("latest"), F.mode("category", True).alias("category"))
    return out.filter("recent > 0")


def story_blocks(found: DataFrame, day: str, recent: int = 2, shown: int = 6, most: int = 300) -> DataFrame:
    """Each story as a text: its name, category and number of reports, and its ``shown`` latest reports, each up to ``most`` characters, with their days relative to ``day``."""
    ahead = lambda c: relative_day(F.datediff(F.col(c), F.lit(day).cast("date")))
    order = W.partitionBy("story").orderBy(F.desc("day"), F.desc("report"))
    lines = found.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= shown)
    lines = lines.groupBy("story").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_i")).alias("i"), F.concat(F.lit("["), ahead("day"), F.lit("] "), F.substring("report", 1, most)).alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    head = F.concat(F.col("story"), F.lit(" ("), F.col("category"), F.lit("): "), F.col("reports"), F.lit(" reports, the latest "), ahead("latest"))
    return stories(found, day, recent).join(lines, "story").select("story", F.concat(head, F.lit("\n"), F.col("lines")).alias("block"))


def reports_of(rows: DataFrame, first: str, last: str) -> DataFrame:
    """The reports between two days of every topic that stands anywhere in their path: topic, day, report."""
    own = rows.filter(F.col("day").between(first, last)).withColumn("_topics", F.array_distinct("topics"))
    spread = own.select("day", "topics", "sentence", F.explode("_topics").alias("topic")).filter("topic <> ''")
    return spread.select("topic", "day", _rest(F.col("topics"), F.array_position("topics", F.col("topic")).cast("int"), F.col("sentence")).alias("report")).distinct()

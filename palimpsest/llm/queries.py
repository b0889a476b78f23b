"""The pN_ queries of the problems on texts and groups of items, over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import mixing, stuffing, tokens, topn
from palimpsest.shared import table

TOP = 20


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    top = topn.top_per_group(table(spark, d, "burst_days"), "date", "page_id", "editors", TOP)
    return top.select(F.col("date").cast("string").alias("day"), "page_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, d, "documents")))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix_sources(mixing.document_sizes(table(spark, d, "documents"), targets), targets)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"))


def p9_shapes(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.common_shapes(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_found, p7_ids, p7_decoded, p8_mix, p8_shares, p9_found, p9_shapes)}

SQL = {
    "p6_found": f"""WITH b AS (SELECT DISTINCT * FROM burst_days WHERE editors IS NOT NULL)
        SELECT strftime(date, '%Y-%m-%d') AS day, page_id FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY editors DESC, page_id) AS i FROM b) WHERE i <= {TOP}""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}

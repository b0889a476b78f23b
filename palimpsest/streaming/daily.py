"""Daily activity from a stream of revision files: late and repeated deliveries, and batches that may run again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.shared import shared_dir


#: How late a delivery may be; a setting of the stream, longer than any delay of the feed.
LATE = "120 days"


def revision_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 4) -> DataFrame:
    """New Parquet files below ``path`` as a stream, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily_counts(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Revisions and editors of each day, updated as rows come in.

    Rows up to ``late`` older than the newest one seen by an earlier batch count, and repeated deliveries among them once; older
    ones are no longer counted, as for them a day is closed. The state holds one row for each revision and day of that span, so
    ``late`` sets its size; a day closed too early is counted again by ``replay`` over the files.
    """
    own = stream.filter("revision_id IS NOT NULL AND timestamp IS NOT NULL").withColumn("at", F.col("timestamp").cast("timestamp")).withWatermark("at", late)
    once = own.dropDuplicatesWithinWatermark(["revision_id"])
    return once.groupBy(F.window("at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("revisions"), F.approx_count_distinct("user_text").alias("editors"))


def run_daily(stream: DataFrame, out: str, checkpoint: str, late: str = LATE) -> None:
    """Runs what there is and stops. Every batch's days are written under its number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        days = batch.select(F.to_date("w.start").alias("day"), "revisions", "editors", F.lit(number).alias("batch"))
        days.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    daily_counts(stream, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The last count of each day."""
    rows = spark.read.schema("day date, revisions bigint, editors bigint").option("recursiveFileLookup", "true").parquet(out).withColumn("n", F.regexp_extract(F.input_file_name(), "batch=([0-9]+)", 1))
    return rows.groupBy("day").agg(F.max_by("revisions", "n").alias("revisions"), F.max_by("editors", "n").alias("editors"))


def replay(spark: SparkSession, sf_dir: str, table: str = "revisions") -> DataFrame:
    """The table's files as a stream, run to its end."""
    folder = f"{shared_dir(spark)}/palimpsest-stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    source = path if os.path.isdir(path) else f"{sf_dir}/{table}.parquet*"
    run_daily(revision_stream(spark, source, schema), f"{folder}/out", f"{folder}/checkpoint")
    return latest_counts(spark, f"{folder}/out")

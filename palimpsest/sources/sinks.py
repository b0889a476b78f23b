"""Sinks: bucketed and partitioned tables, appends of what is missing, retention."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 128


def write_by_month(df: DataFrame, path: str, time: str = "ts", key: str = "page_id", buckets: int = BUCKETS) -> None:
    """Month directories with files by key bucket. Only the months of ``df`` are replaced, when all its files are written."""
    placed = df.withColumns({"month": F.date_format(time, "yyyy-MM"), "bucket": F.pmod(F.col(key), F.lit(buckets)).cast("int")})
    placed.repartition("month", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "bucket").parquet(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Adds the rows whose keys the table at ``path`` doesn't hold; run again, it adds nothing."""
    spark = df.sparkSession
    try:
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    df.dropDuplicates(keys).write.mode("append").parquet(path)


def replace(df: DataFrame, path: str, most_rows: int | None = None) -> None:
    """Replace the table at ``path`` by ``df``: written beside it first and put in its place when whole, so a write that breaks off changes nothing.

    ``most_rows``: rows of a file.
    """
    spark = df.sparkSession
    beside, before = f"{path}-new-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    new, target, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path, before))
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        writer = df.write.option("maxRecordsPerFile", most_rows) if most_rows else df.write
        writer.parquet(beside)
        if system.exists(target):
            system.rename(target, old)
        if not system.rename(new, target):
            system.rename(old, target)
            raise OSError(f"could not put {beside} in place")
    finally:
        system.delete(new, True)
    system.delete(old, True)


def prune_days(spark: SparkSession, path: str, days: int, column: str = "date") -> list[str]:
    """Remove the day folders of a table that are more than ``days`` days older than its newest one; returns their days."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = {f.getPath().getName().partition("=")[2]: f.getPath() for f in system.listStatus(root) if f.getPath().getName().startswith(f"{column}=")}
    known = {date.fromisoformat(d): p for d, p in folders.items() if d[:1].isdigit()}
    oldest = max(known, default=date.max) - timedelta(days=days)
    old = [d for d in sorted(known) if d < oldest]
    for day in old:
        system.delete(known[day], True)
    return [str(d) for d in old]

"""Intermediate tables in the folder that all executors share, and session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def write_shared(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and return it as a scan.

    Cuts the lineage: a lost executor re-reads files instead of re-running the stages before. The files are removed when
    the driver's Python ends, or by ``clear``. ``by``: a column of few values that gets a folder for each; a filter on it reads its
    folders only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    keep(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> str:
    """Remember a path to be removed by ``clear`` or at the end."""
    if not _WRITTEN:
        atexit.register(clear, spark)
    _WRITTEN.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Remove the tables written so far; only when no result that reads them is still to be computed."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def arrow_path(path: str) -> str:
    """A path as Arrow's file systems name it, for reading in tasks."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path.removeprefix("file:")
    return path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Spark resolves it."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return arrow_path(own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Boosted trees that rank page-days, and the daily job."""

from __future__ import annotations

from datetime import date

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import activity as A
from palimpsest.operators.history_joins import merged_history
from palimpsest.operators.labels import label_reverts

FEATURES = ["page_age_days", "page_bytes", "days_since_last_edit", "edits_1d", "edits_7d", "edits_30d", "edits_365d", "editors_1d", "editors_7d", "reverted_edits_7d", "reverts_7d", "bot_edits_30d", "burst_z_1d", "is_burst_1d", "burst_days_30d", "edits_lag7", "edits_lag14", "editors_lag7", "is_burst_lag7", "is_burst_lag14"]
MAY_LACK = ["page_age_days", "page_bytes", "days_since_last_edit"]


def matrix(rows: DataFrame) -> DataFrame:
    """Adds the vector of features: flags as 0 and 1, a lacking value as -1 beside a column that says so."""
    numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in FEATURES}
    lacks = {f"no_{c}": F.col(c).isNull().cast("double") for c in MAY_LACK}
    ready = rows.select("*", *[v.alias(f"x_{k}") for k, v in (numbers | lacks).items()])
    names = [f"x_{k}" for k in numbers | lacks]
    return VectorAssembler(inputCols=names, outputCol="vector").transform(ready).drop(*names)


def fit(rows: DataFrame, validation: str, rounds: int = 20, seed: int = 0, weight: str | None = None):
    """Boosted trees on ``rows`` with y; those with the boolean column ``validation`` decide when to stop. ``weight``: a column of the rows' weights."""
    ready = matrix(rows).withColumn("label", F.col("y").cast("double"))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", validationIndicatorCol=validation, maxIter=rounds, maxDepth=4, seed=seed)
    return (trees.setWeightCol(weight) if weight else trees).fit(ready)


def score(model, rows: DataFrame) -> DataFrame:
    return model.transform(matrix(rows)).withColumn("score", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def daily_features(archive: DataFrame, live: DataFrame, until: str, day: str, lookback: int = 30, mass_pages: int = A.MASS_PAGES) -> DataFrame:
    """The features of ``day`` for pages edited in the days before it, from the archive up to ``until`` and the live rows before the day."""
    labels = label_reverts(merged_history(archive, live, until, day, lookback))
    daily = A.with_bursts(A.daily_activity(labels, mass_pages))
    asked = labels.select("page_id").distinct().withColumn("date", F.lit(day).cast("date"))
    return A.features(daily, labels, asked)


def daily_outcomes(daily: DataFrame, day: date) -> DataFrame:
    """Pages that burst on ``day`` without mass editors and with two editors or more."""
    return daily.filter((F.col("day") == F.lit(day)) & F.col("is_burst_excl_mass") & (F.col("editors_excl_mass") >= 2)).select("page_id", "day", "editors_excl_mass")

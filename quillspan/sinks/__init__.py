"""Tables as CSV files, matrices and JSON manifests, in a stated order."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The order of the rows of a table; others are ordered by their first columns as they come.
ORDER = {
    "session_metrics": ("session_id",),
    "target_behavior_metrics": ("session_id",),
    "ml_session_features": ("session_id",),
    "session_transition_metrics": ("session_id",),
    "selection_metrics": ("session_id", "selection_event_num", "selection_id"),
    "request_outcomes": ("session_id", "request_event_num"),
}


def write_csv(tables: dict[str, DataFrame], folder: str, *, may_be_empty: tuple[str, ...] = ()) -> None:
    """Each table as a folder of CSV files with a header, ordered over its files where ORDER names it; null is the empty field.

    A table without rows is an error, as nothing was computed, but for those named.
    """
    for name, df in tables.items():
        if name not in may_be_empty and df.isEmpty():
            raise ValueError(f"{name} has no rows")
        rows = df.orderBy(*ORDER[name]) if name in ORDER else df
        rows.write.mode("overwrite").option("header", True).option("emptyValue", '""').csv(f"{folder}/{name}.csv")


def matrix(long: DataFrame, row: str, column: str, value: str, labels: list[str], *, missing: str = "") -> DataFrame:
    """(row, column, value) as a matrix of text: a row per label in their order; what is null or not finite is `missing`."""
    text = F.when(F.col(value).isNull() | F.isnan(F.col(value).cast("double")) | (F.abs(F.col(value).cast("double")) == float("inf")), F.lit(missing)).otherwise(F.col(value).cast("string"))
    wide = long.withColumn("__t", text).groupBy(row).pivot(column, labels).agg(F.first("__t"))
    place = F.array_position(F.array(*map(F.lit, labels)), F.col(row))
    return wide.na.fill(missing, labels).orderBy(place)


def write_matrix(long: DataFrame, row: str, column: str, value: str, labels: list[str], path: str, *, missing: str = "") -> None:
    """The matrix as one CSV file (labels by labels) in a folder."""
    matrix(long, row, column, value, labels, missing=missing).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(spark: SparkSession, content: dict[str, Any], path: str) -> None:
    """A manifest as one JSON text in a folder, written where Spark can write."""
    spark.createDataFrame([(json.dumps(content, indent=2),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])

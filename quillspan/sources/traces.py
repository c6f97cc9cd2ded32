"""The event table of the star schema seen as writing traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, event_num, timestamp_ms, event_name, source and k, a pure projection of `events`."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", "suggestion-get").when(kind == "view", "suggestion-open").when(kind == "purchase", "suggestion-select")
        .when(kind == "error", "suggestion-close").when(F.col("event_id") % 2 == 1, "text-insert").otherwise("text-delete")
    )
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("event_num"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("timestamp_ms"), name.alias("event_name"),
        F.when(k % 3 == 0, "user").when(k % 3 == 1, "api").otherwise("system").alias("source"), k.alias("k"), "value",
    )


TRACE_SQL = """
t AS (
  SELECT user_id AS session_id, event_id AS event_num, epoch_us(ts) // 1000 AS timestamp_ms,
    CASE event_type WHEN 'click' THEN 'suggestion-get' WHEN 'view' THEN 'suggestion-open' WHEN 'purchase' THEN 'suggestion-select'
      WHEN 'error' THEN 'suggestion-close' ELSE CASE WHEN event_id % 2 = 1 THEN 'text-insert' ELSE 'text-delete' END END AS event_name,
    CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'api' ELSE 'system' END AS source,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value
  FROM events
)"""

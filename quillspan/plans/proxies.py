"""Selection and session tables made of the event traces by plain aggregates, in the shape of the metric tables, and the same in SQL.

Feature and prediction operators run over them where their results are compared with SQL, which cannot replay deltas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import STATES, safe_ratio
from ..operators import requests, stats


def selection_table(t: DataFrame) -> DataFrame:
    """Every select of a request as a selection that was inserted, in the columns of the selection metrics."""
    s = requests.selection_proxies(t).join(requests.first_in_window(t).select("session_id", "window_id", "request_num", "request_ts", "open_ts"), ["session_id", "window_id"])
    return s.select(
        "session_id", F.concat_ws(":", F.col("session_id").cast("string"), F.col("event_num").cast("string")).alias("selection_id"), F.col("request_num").alias("request_event_num"), F.col("event_num").alias("selection_event_num"),
        F.col("event_num").alias("insert_event_num"), (F.col("inserted") % 5).alias("selected_index"), F.col("inserted").alias("inserted_chars"), F.col("outcome").alias("adoption_outcome"),
        (F.col("timestamp_ms") - F.col("request_ts")).alias("request_to_selection_ms"), (F.col("timestamp_ms") - F.col("open_ts")).alias("open_to_selection_ms"),
    )


SELECTION_TABLE_SQL = """
sx AS (SELECT s.session_id, s.session_id || ':' || s.event_num AS selection_id, request_num AS request_event_num, s.event_num AS selection_event_num, s.event_num AS insert_event_num, inserted % 5 AS selected_index,
  inserted AS inserted_chars, outcome AS adoption_outcome, timestamp_ms - request_ts AS request_to_selection_ms, timestamp_ms - open_ts AS open_to_selection_ms FROM s JOIN f USING (session_id, window_id))"""


def session_table(t: DataFrame) -> DataFrame:
    """The columns of the session metrics that features are made of, a row per session of the traces."""
    c = F.col
    is_ = lambda name: c("event_name") == name
    put = lambda source: is_("text-insert") & (c("source") == source)
    first = F.min(F.when(put("api"), c("event_num"))).over(Window.partitionBy("session_id"))
    own = t.withColumn("first", first).groupBy("session_id").agg(
        *[F.coalesce(F.sum(F.when(put(s), c("k"))), F.lit(0)).alias(n) for s, n in (("api", "final_ai_chars"), ("user", "final_human_chars"))],
        F.coalesce(F.sum(F.when(put("user") & (c("first").isNull() | (c("event_num") < c("first"))), c("k"))), F.lit(0)).alias("before"), F.when(F.count("*") >= 2, F.max("timestamp_ms") - F.min("timestamp_ms")).alias("session_duration_ms"),
    )
    windows = requests.request_windows(t).groupBy("session_id", "window_id").agg(F.count_if(is_("suggestion-open")).alias("opens"), F.count_if(is_("suggestion-select")).alias("selects"), F.count_if(is_("suggestion-close")).alias("closes"))
    asked = windows.groupBy("session_id").agg(F.count("*").alias("suggestion_requests"), F.sum("selects").alias("suggestion_selections"), F.count_if((c("closes") > 0) & (c("selects") == 0)).alias("dismissed_episodes"), F.sum(F.greatest(c("opens") - 1, F.lit(0))).alias("suggestion_reopens"), F.count_if(c("selects") > 1).alias("multi_selection_episodes"))
    latency = lambda name: F.median(F.when(c(name) >= 0, c(name))).alias(f"median_{name}")
    chosen = selection_table(t).groupBy("session_id").agg(latency("request_to_selection_ms"), latency("open_to_selection_ms"), *[F.count_if(c("adoption_outcome") == s).alias(n) for s, n in zip(STATES[:2], ("direct_adoptions", "modified_adoptions"), strict=True)])
    kept = requests.selection_proxies(t).groupBy("session_id").agg(F.sum("inserted").alias("ai_inserted_chars"), F.sum("surviving").alias("ai_surviving_chars"))
    bursts = stats.burstiness(t.where(is_("suggestion-get"))).withColumnRenamed("burstiness", "consultation_burstiness")
    out = own.join(asked, "session_id", "left").join(chosen, "session_id", "left").join(kept, "session_id", "left").join(bursts, "session_id", "left")
    counts = ("suggestion_requests", "suggestion_selections", "dismissed_episodes", "suggestion_reopens", "multi_selection_episodes", "direct_adoptions", "modified_adoptions", "ai_inserted_chars", "ai_surviving_chars")
    out = out.na.fill(0, list(counts)).withColumn("authored_text_chars", c("final_ai_chars") + c("final_human_chars"))
    return out.select(
        "session_id", "authored_text_chars", safe_ratio("final_ai_chars", "authored_text_chars").alias("ai_share"), *counts, safe_ratio("before", "final_human_chars").alias("human_generation_before_ai_ratio"),
        (safe_ratio("suggestion_requests", "authored_text_chars") * 1000.0).alias("consultation_density_per_1000_authored_chars"), "median_request_to_selection_ms", "median_open_to_selection_ms", "consultation_burstiness", "session_duration_ms",
    )


SESSION_TABLE_SQL = """
own AS (SELECT session_id, coalesce(sum(k) FILTER (put AND source = 'api'), 0)::BIGINT AS ai, coalesce(sum(k) FILTER (put AND source = 'user'), 0)::BIGINT AS human,
  coalesce(sum(k) FILTER (put AND source = 'user' AND (first_api IS NULL OR event_num < first_api)), 0)::BIGINT AS before_ai, CASE WHEN count(*) >= 2 THEN max(timestamp_ms) - min(timestamp_ms) END AS session_duration_ms
  FROM (SELECT *, event_name = 'text-insert' AS put, min(event_num) FILTER (event_name = 'text-insert' AND source = 'api') OVER (PARTITION BY session_id) AS first_api FROM t) GROUP BY session_id),
wn AS (SELECT session_id, window_id, count(*) FILTER (event_name = 'suggestion-open') AS opens, count(*) FILTER (event_name = 'suggestion-select') AS selects, count(*) FILTER (event_name = 'suggestion-close') AS closes FROM w GROUP BY ALL),
asked AS (SELECT session_id, count(*) AS suggestion_requests, sum(selects)::BIGINT AS suggestion_selections, count(*) FILTER (closes > 0 AND selects = 0) AS dismissed_episodes, sum(greatest(opens - 1, 0))::BIGINT AS suggestion_reopens, count(*) FILTER (selects > 1) AS multi_selection_episodes FROM wn GROUP BY session_id),
chosen AS (SELECT session_id, median(request_to_selection_ms) FILTER (request_to_selection_ms >= 0) AS median_request_to_selection_ms, median(open_to_selection_ms) FILTER (open_to_selection_ms >= 0) AS median_open_to_selection_ms,
  count(*) FILTER (adoption_outcome = 'direct_adoption') AS direct_adoptions, count(*) FILTER (adoption_outcome = 'modified_adoption') AS modified_adoptions FROM sx GROUP BY session_id),
kept AS (SELECT session_id, sum(inserted)::BIGINT AS ai_inserted_chars, sum(surviving)::BIGINT AS ai_surviving_chars FROM s GROUP BY session_id),
gaps AS (SELECT session_id, count(*) AS n, stddev_pop(gap) AS sd, avg(gap) AS mean FROM (SELECT session_id, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY timestamp_ms) AS gap FROM t WHERE event_name = 'suggestion-get') WHERE gap IS NOT NULL GROUP BY session_id),
se AS (SELECT own.*, ai + human AS authored_text_chars, CASE WHEN ai + human > 0 THEN ai::DOUBLE / (ai + human) ELSE 0.0 END AS ai_share, CASE WHEN human > 0 THEN before_ai::DOUBLE / human ELSE 0.0 END AS human_generation_before_ai_ratio,
  coalesce(suggestion_requests, 0) AS suggestion_requests, coalesce(suggestion_selections, 0) AS suggestion_selections, coalesce(dismissed_episodes, 0) AS dismissed_episodes, coalesce(suggestion_reopens, 0) AS suggestion_reopens, coalesce(multi_selection_episodes, 0) AS multi_selection_episodes,
  coalesce(direct_adoptions, 0) AS direct_adoptions, coalesce(modified_adoptions, 0) AS modified_adoptions, coalesce(ai_inserted_chars, 0) AS ai_inserted_chars, coalesce(ai_surviving_chars, 0) AS ai_surviving_chars,
  CASE WHEN ai + human > 0 THEN coalesce(suggestion_requests, 0)::DOUBLE / (ai + human) * 1000 ELSE 0.0 END AS density, median_request_to_selection_ms, median_open_to_selection_ms,
  CASE WHEN n >= 2 THEN CASE WHEN sd + mean <> 0 THEN (sd - mean) / (sd + mean) ELSE 0.0 END END AS burst
  FROM own LEFT JOIN asked USING (session_id) LEFT JOIN chosen USING (session_id) LEFT JOIN kept USING (session_id) LEFT JOIN gaps USING (session_id)),
fs AS (SELECT session_id, ln(1 + authored_text_chars::DOUBLE) AS log_authored_text_chars, ai_share, CASE WHEN ai_inserted_chars > 0 THEN ai_surviving_chars::DOUBLE / ai_inserted_chars END AS ai_retention_ratio, human_generation_before_ai_ratio,
  suggestion_selections::DOUBLE / nullif(suggestion_requests, 0) AS selections_per_request, dismissed_episodes::DOUBLE / nullif(suggestion_requests, 0) AS dismissal_rate, suggestion_reopens::DOUBLE / nullif(suggestion_requests, 0) AS reopen_rate,
  multi_selection_episodes::DOUBLE / nullif(suggestion_requests, 0) AS multi_selection_rate, density AS consultation_density_per_1000_authored_chars, ln(1 + median_request_to_selection_ms) AS log_median_request_to_selection_ms, ln(1 + median_open_to_selection_ms) AS log_median_open_to_selection_ms,
  burst AS consultation_burstiness, ln(1 + session_duration_ms::DOUBLE) AS log_session_duration_ms, direct_adoptions::DOUBLE / nullif(suggestion_selections, 0) AS direct_adoption_share, modified_adoptions::DOUBLE / nullif(suggestion_selections, 0) AS modified_adoption_share FROM se)"""

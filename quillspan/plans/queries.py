"""Every relational operator as a query over the driver's tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import STATE_LABELS, STATES
from ..operators import audits, features, grouping, indicators, inference, lifecycle, metrics, models, multivariate, requests, sequences, stats
from ..sources.traces import TRACE_SQL, traces
from . import proxies

DIGITS = 6
IS_GET, IS_OPEN, IS_SELECT = (f"event_name = 'suggestion-{x}'" for x in ("get", "open", "select"))
IS_API = "event_name = 'text-insert' and source = 'api'"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _on(plan: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(plan(traces(spark, sf_dir)))


def _selections(plan: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return _on(lambda t: plan(requests.selection_proxies(t)))


def _features(t: DataFrame) -> DataFrame:
    return features.session_features(proxies.session_table(t))


def _predictors(t: DataFrame) -> DataFrame:
    return features.prediction_features(proxies.selection_table(t))


FEATURES = list(features.PROFILE)
PREDICTORS = list(features.PREDICTORS)
#: Columns of the rank correlation matrix.
RANKED = ["log_authored_text_chars", "ai_share", "ai_retention_ratio", "selections_per_request", "dismissal_rate", "consultation_burstiness"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = ((F.col("doc_id") * 37 % 101) / 100.0).cast("double")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("quality").cast("int").alias("y"), score.alias("s"))


def _with_deltas(t: DataFrame) -> DataFrame:
    """The traces with deltas made from k: insertions of k characters and deletions of k, at place k."""
    retain = F.lit('[{"retain":')
    ops = F.when(F.col("event_name") == "text-insert", F.concat(retain, F.col("k"), F.lit(',"insert":"'), F.repeat(F.lit("x"), F.col("k").cast("int")), F.lit('"}]')))
    ops = ops.when(F.col("event_name") == "text-delete", F.concat(retain, F.col("k"), F.lit(',"delete":'), F.col("k"), F.lit("}]")))
    return t.withColumn("ops_json", ops)


PROFILE = ["ai_chars", "human_chars", "ai_share"]


def _folded(t: DataFrame, task: str = features.TASKS[0]) -> DataFrame:
    return models.with_folds(features.binary_dataset(_predictors(t), task))


def _totals(t: DataFrame) -> DataFrame:
    """What any right deal of sessions to folds gives: folds, rows, sessions (each in one fold), positives, the spread of a fold's sessions."""
    folded = _folded(t)
    per = models.split_audit(folded)
    spread = (F.max("test_sessions") - F.min("test_sessions") <= 25).cast("int")
    return per.agg(F.count("*").alias("folds"), F.sum("test_rows").alias("rows"), F.sum("test_sessions").alias("sessions"), F.sum("session_overlap").alias("overlap"), F.sum("test_positive").alias("positive"), spread.alias("even"))


def _clusters(t: DataFrame) -> DataFrame:
    return multivariate.fit_labels(multivariate.scaled(grouping.session_shares(t), PROFILE, "robust"), PROFILE, "kmeans", 2)[0]


def _audit(check: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return _on(lambda t: (lambda d: check(d, metrics.replayed(d)))(_with_deltas(t)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "selection_metrics": _on(lambda t: metrics.selection_metrics(metrics.replayed(_with_deltas(t)))),
    "target_behavior_metrics": _on(lambda t: indicators.target_behavior_metrics(indicators.historical_sessions(_with_deltas(t)))),
    "session_metrics": _on(lambda t: metrics.session_metrics(metrics.replayed(_with_deltas(t)))),
    "episode_indicators": _on(lambda t: (lambda d: indicators.episode_indicators(d, requests.five_way_outcomes(t).select(F.col("session_id").cast("string").alias("session_id"), F.col("window_id").alias("request_event_num"), "outcome"), metrics.session_metrics(metrics.replayed(d))))(_with_deltas(t))),
    "scan_event_counts": _on(lambda t: t.groupBy("event_name", "source").agg(F.count("*").alias("n"), F.sum("k").alias("chars"))),
    "request_windows": _on(lambda t: requests.request_windows(t).select("session_id", "event_num", "window_id")),
    "first_in_window": _on(lambda t: requests.first_in_window(t)),
    "five_way_outcomes": _on(requests.five_way_outcomes),
    "five_way_counts": _on(lambda t: requests.five_way_outcomes(t).groupBy("outcome").agg(F.count("*").alias("n"))),
    "fifo_match_requests": _on(lambda t: lifecycle.fifo_match(t, F.expr(IS_GET), F.expr(IS_OPEN))),
    "fifo_match_insertions": _on(lambda t: lifecycle.fifo_match(t, F.expr(IS_SELECT), F.expr(IS_API))),
    "orphan_selects": _on(lambda t: lifecycle.orphan_reopens(t, "suggestion-select")),
    "session_indicators": _on(requests.session_indicators),
    "session_duration": _on(lambda t: t.groupBy("session_id").agg(F.when(F.count("*") >= 2, F.max("timestamp_ms") - F.min("timestamp_ms")).alias("duration_ms"))),
    "burstiness_modern": _on(lambda t: stats.burstiness(t.where(IS_GET))),
    "burstiness_historical": _on(lambda t: stats.burstiness(t.where(IS_GET), zero=None, sort="event_num")),
    "state_entropy": _selections(lambda s: stats.normalized_entropy(s, "session_id", "outcome", 3)),
    "selection_outcomes": _selections(lambda s: s),
    "transition_counts_all": _selections(lambda s: sequences.transition_matrix(s)),
    "transition_counts_cross": _selections(lambda s: sequences.transition_matrix(s, "cross_request")),
    "positional_profile": _selections(sequences.positional_profile),
    "endpoint_matrix": _selections(sequences.endpoints),
    "phase_shares": _selections(sequences.phase_shares),
    "early_late_change": _selections(sequences.early_late_change),
    "ai_share_tertiles": _on(lambda t: grouping.thresholds(grouping.session_shares(t))),
    "group_membership": _on(lambda t: grouping.membership(grouping.session_shares(t))),
    "group_summary": _on(lambda t: grouping.group_summary(grouping.session_shares(t), ("human_chars", "ai_chars"))),
    "outcomes_by_group": _on(lambda t: grouping.outcomes_by_group(requests.five_way_outcomes(t), grouping.session_shares(t))),
    "spearman_share": _on(lambda t: stats.spearman(grouping.session_shares(t), "ai_share", "human_chars")),
    "prediction_features": _on(_predictors),
    "direct_vs_modified_dataset": _on(lambda t: features.binary_dataset(_predictors(t), "direct_vs_modified").select("session_id", "event_num", "label", "log_selection_ordinal")),
    "non_adoption_dataset": _on(lambda t: features.binary_dataset(_predictors(t), "non_adoption_detection").select("session_id", "event_num", "label", "log_event_gap_from_previous_selection")),
    "stratified_folds": _on(lambda t: _folded(t).select("session_id", "event_num", "fold")),
    "grouped_split_audit": _on(lambda t: models.grouped_split_audit(models.with_folds(_predictors(t), "outcome"))),
    "task_split_audit": _on(lambda t: models.split_audit(_folded(t, "non_adoption_detection"))),
    "session_table": _on(proxies.session_table),
    "session_features": _on(_features),
    "feature_diagnostics": _on(lambda t: features.diagnostics(_features(t))),
    "feature_summary": _on(lambda t: stats.summarize(_features(t), FEATURES)),
    "feature_registry": _on(features.registry),
    "missingness_patterns": _on(lambda t: features.missingness(_features(t), FEATURES)),
    "spearman_matrix": _on(lambda t: stats.spearman_matrix(_features(t), RANKED)),
    "spearman_matrix_historical": _on(lambda t: stats.spearman_matrix(_features(t), RANKED, 30, diagonal=False)),
    "strong_correlations": _on(lambda t: stats.strongest_correlations(stats.spearman_matrix(_features(t), FEATURES), FEATURES, 0.3)),
    "scaler_parameters": _on(lambda t: features.scaler(_features(t), list(features.PRIMARY))),
    "primary_matrix": _on(lambda t: features.primary_matrix(_features(t))),
    "primary_coverage": _on(lambda t: features.coverage(_features(t))),
    "sequences": _on(lambda t: sequences.build_sequences(requests.selection_proxies(t), t).withColumn("states", F.array_join("states", ","))),
    "matrix_rows": _selections(lambda s: sequences.matrix_rows(sequences.transition_matrix(s, "cross_request"), "cross_request")),
    "average_ranks": _on(lambda t: stats.average_ranks(grouping.session_shares(t), "human_chars").select("session_id", "rank_avg")),
    "benjamini_hochberg": lambda spark, sf_dir: rounded(stats.benjamini_hochberg(spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("int").alias("test"), ((F.col("r_regionkey") * 7 % 5 + 1) / 50.0).cast("double").alias("p")))),
    "robust_scale": _on(lambda t: stats.robust_scale(grouping.session_shares(t), "ai_share").select("session_id", "scaled")),
    "standard_scale": _on(lambda t: stats.standard_scale(grouping.session_shares(t), "ai_share").select("session_id", "scaled")),
    "cluster_profiles": _on(lambda t: features.cluster_profiles(grouping.membership(grouping.session_shares(t)), "group", ["ai_share", "human_chars", "ai_chars"])),
    "binary_metrics": lambda spark, sf_dir: rounded(stats.binary_metrics(_labels(spark, sf_dir), "y", "s")),
    "lifecycle_episodes": lambda spark, sf_dir: lifecycle.episodes(traces(spark, sf_dir)),
    "lifecycle_selections": lambda spark, sf_dir: lifecycle.selections(traces(spark, sf_dir)),
    "session_transition_metrics": _selections(inference.session_transition_metrics),
    "transition_bootstrap": _selections(inference.bootstrap_transition_probabilities),
    "transition_permutation_null": _selections(inference.permutation_transition_test),
    "transition_persistence": _selections(inference.persistence_test),
    "session_phase_summary": _selections(inference.phase_summary),
    "early_late_intervals": _selections(inference.early_late_intervals),
    "text_delta_signatures": _on(lambda t: audits.text_deltas(_with_deltas(t)).drop("session_id", "event_num")),
    "audit_lifecycle": _audit(audits.lifecycle),
    "audit_provenance": _audit(audits.provenance),
    "audit_lifecycle_totals": _audit(audits.lifecycle_totals),
    "audit_features": _on(lambda t: audits.features(_features(t))),
    "missing_shares": _on(lambda t: audits.missing_shares(_features(t), FEATURES)),
    "audit_selection_metrics": _audit(lambda _, r: audits.selection_metrics(metrics.selection_metrics(r))),
    "audit_session_metrics": _audit(lambda _, r: audits.session_metrics(metrics.session_metrics(r))),
    "pca_variance": _on(lambda t: multivariate.pca_tables(grouping.session_shares(t), PROFILE, k=3)["variance"]),
    "pca_bootstrap": _on(lambda t: multivariate.bootstrap_pca(grouping.session_shares(t), PROFILE, k=3)),
    "cluster_sizes": _on(lambda t: _clusters(t).groupBy("cluster").agg(F.count("*").alias("n"))),
    "cluster_silhouette": _on(lambda t: (lambda x, c: multivariate.silhouette(x.join(c.select("session_id", F.when(F.col("group") == "Low", 0).when(F.col("group") == "Moderate", 1).otherwise(2).alias("cluster")), "session_id"), PROFILE))(grouping.session_shares(t).select("session_id", *PROFILE), grouping.membership(grouping.session_shares(t)))),
    "fold_totals": _on(_totals),
    "prediction_metrics": _on(lambda t: models.metric_summary(models.out_of_fold(_folded(t), PREDICTORS, ("prior_baseline", "logistic", "logistic_balanced")))),
    "prior_baseline_metrics": _on(lambda t: models.metrics_by(models.out_of_fold(_folded(t), PREDICTORS, ("prior_baseline",)), ["fold"])),
    "class_metrics": _on(lambda t: models.class_metric_summary(models.out_of_fold_classes(models.with_folds(_predictors(t), "outcome"), PREDICTORS, ("prior_baseline", "logistic")))),
    "class_prior_metrics": _on(lambda t: models.class_metrics(models.out_of_fold_classes(models.with_folds(_predictors(t), "outcome"), PREDICTORS, ("prior_baseline",)), ["fold"])),
    "coefficient_stability": _on(lambda t: models.coefficient_stability(_folded(t), PREDICTORS)),
    "model_improvement": _on(lambda t: models.improvement_bootstrap(models.out_of_fold(_folded(t), PREDICTORS, ("prior_baseline", "logistic")), repeats=100)),
}

WINDOW_SQL = """
w AS (SELECT * FROM (SELECT *, sum(CASE WHEN event_name = 'suggestion-get' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_num)::BIGINT AS window_id FROM t) WHERE window_id > 0)"""


def _firsts(name: str) -> str:
    rule = f"FILTER (event_name = 'suggestion-{name}')"
    return f"min(event_num) {rule} AS {name}_num, arg_min(timestamp_ms, event_num) {rule} AS {name}_ts, arg_min(k, event_num) {rule} AS {name}_k"


FIRST_SQL = f"""
f AS (SELECT session_id, window_id, min(event_num) AS request_num, arg_min(timestamp_ms, event_num) AS request_ts, {_firsts('open')}, {_firsts('select')}, {_firsts('close')},
  arg_min(source, event_num) FILTER (event_name = 'suggestion-close') AS close_source FROM w GROUP BY ALL),
i AS (SELECT w.session_id, w.window_id, min(event_num) AS insert_num, arg_min(w.k, event_num) AS insert_k, arg_min(timestamp_ms, event_num) AS insert_ts
  FROM w JOIN f ON w.session_id = f.session_id AND w.window_id = f.window_id WHERE event_name = 'text-insert' AND source = 'api' AND event_num > select_num GROUP BY ALL),
fi AS (SELECT f.*, insert_num, insert_k, insert_ts FROM f LEFT JOIN i USING (session_id, window_id)),
o AS (SELECT session_id, window_id, CASE WHEN insert_num IS NOT NULL AND open_num IS NOT NULL AND open_k % 2 = insert_k % 2 THEN 'accept_unchanged'
  WHEN insert_num IS NOT NULL AND open_num IS NOT NULL THEN 'accepted_modified' WHEN open_num IS NULL THEN 'request_without_suggestion'
  WHEN close_num IS NOT NULL AND close_source = 'user' THEN 'non_adoption' ELSE 'presented_no_selection' END AS outcome FROM fi)"""
SELECTION_SQL = """
s0 AS (SELECT *, coalesce(sum(CASE WHEN event_name = 'text-delete' THEN k END) OVER later, 0)::BIGINT AS deleted,
  coalesce(max(CASE WHEN event_name = 'text-insert' AND source = 'user' THEN 1 END) OVER later, 0) = 0 AS contiguous FROM w
  WINDOW later AS (PARTITION BY session_id, window_id ORDER BY event_num ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
s AS (SELECT session_id, window_id, event_num, timestamp_ms, k AS inserted, deleted, greatest(k - deleted, 0) AS surviving, contiguous,
  CASE WHEN k <= 0 OR greatest(k - deleted, 0) <= 0 THEN 'non_adoption' WHEN k = greatest(k - deleted, 0) AND contiguous THEN 'direct_adoption' ELSE 'modified_adoption' END AS outcome
  FROM s0 WHERE event_name = 'suggestion-select'),
p AS (SELECT *, CASE WHEN 3 * i <= n - 1 THEN 'early' WHEN 3 * i <= 2 * (n - 1) THEN 'middle' ELSE 'late' END AS phase FROM
  (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_num) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM s))"""
SHARE_SQL = """
a AS (SELECT *, CASE WHEN ai_chars + human_chars > 0 THEN ai_chars::DOUBLE / (ai_chars + human_chars) ELSE 0.0::DOUBLE END AS ai_share FROM
  (SELECT session_id, coalesce(sum(k) FILTER (event_name = 'text-insert' AND source = 'api'), 0)::BIGINT AS ai_chars,
    coalesce(sum(k) FILTER (event_name = 'text-insert' AND source = 'user'), 0)::BIGINT AS human_chars FROM t GROUP BY session_id)),
th AS (SELECT quantile_cont(ai_share, 1.0::DOUBLE / 3) AS low, quantile_cont(ai_share, 2.0::DOUBLE / 3) AS high FROM a),
m AS (SELECT a.*, CASE WHEN ai_share <= low THEN 'Low' WHEN ai_share <= high THEN 'Moderate' ELSE 'High' END AS "group" FROM a, th)"""


def _with(select: str, *parts: str) -> str:
    return "WITH " + ",".join([TRACE_SQL, *parts]) + "\n" + select


def _fifo(push: str, pop: str) -> str:
    return _with(
        f"""SELECT a.session_id, a.event_num AS push_num, b.event_num AS pop_num FROM k3 a JOIN k3 b ON a.session_id = b.session_id AND a.r = b.r AND a.push AND NOT b.push""",
        f"""k1 AS (SELECT session_id, event_num, ({push}) AS push, sum(CASE WHEN {push} THEN 1 ELSE -1 END) OVER (PARTITION BY session_id ORDER BY event_num) AS level FROM t WHERE ({push}) OR ({pop})),
k2 AS (SELECT *, NOT push AND level < least(0, coalesce(min(CASE WHEN NOT push THEN level END) OVER (PARTITION BY session_id ORDER BY event_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS miss FROM k1),
k3 AS (SELECT *, row_number() OVER (PARTITION BY session_id, push ORDER BY event_num) AS r FROM k2 WHERE NOT miss)""",
    )


def _matrix(extra: str, head: str = "g.from_state, g.to_state") -> str:
    states = ", ".join(f"('{x}')" for x in STATES)
    return _with(
        f"SELECT {head}, coalesce(c, 0) AS count, round(coalesce(c, 0)::DOUBLE / nullif(sum(coalesce(c, 0)) OVER (PARTITION BY g.from_state), 0), 6) AS probability FROM g LEFT JOIN cc USING (from_state, to_state)",
        WINDOW_SQL, SELECTION_SQL,
        f"st(x) AS (VALUES {states}), g AS (SELECT a.x AS from_state, b.x AS to_state FROM st a, st b), pr AS (SELECT outcome AS from_state, lead(outcome) OVER q AS to_state, window_id, lead(window_id) OVER q AS nw FROM s WINDOW q AS (PARTITION BY session_id ORDER BY event_num)), cc AS (SELECT from_state, to_state, count(*) AS c FROM pr WHERE to_state IS NOT NULL {extra} GROUP BY ALL)",
    )


def _label(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_LABELS.items()) + " END"


def _burst(order: str, zero: str) -> str:
    return _with(
        f"SELECT session_id, round(CASE WHEN n >= 2 THEN CASE WHEN sd + mean <> 0 THEN (sd - mean) / (sd + mean) ELSE {zero} END END, 6) AS burstiness FROM b",
        f"b AS (SELECT session_id, count(*) AS n, stddev_pop(gap) AS sd, avg(gap) AS mean FROM (SELECT session_id, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY {order}) AS gap FROM t WHERE event_name = 'suggestion-get') WHERE gap IS NOT NULL GROUP BY session_id)",
    )


_SHARES = ", ".join(f"round(avg(CASE WHEN outcome = '{x}' THEN 1.0::DOUBLE ELSE 0 END), 6) AS {x}_share" for x in STATES)
_PREDICT = """pf AS (SELECT session_id, selection_id, selection_event_num AS event_num, adoption_outcome AS outcome, ln(1 + inserted_chars::DOUBLE) AS log_inserted_chars, selected_index::DOUBLE AS selected_index,
  CASE WHEN request_to_selection_ms >= 0 THEN ln(1 + request_to_selection_ms::DOUBLE) END AS log_request_to_selection_ms, CASE WHEN open_to_selection_ms >= 0 THEN ln(1 + open_to_selection_ms::DOUBLE) END AS log_open_to_selection_ms,
  ln(1 + row_number() OVER q::DOUBLE) AS log_selection_ordinal, ln(1 + coalesce(avg(inserted_chars) OVER b, 0)) AS log_prior_mean_inserted_chars, ln(1 + coalesce(avg(request_to_selection_ms) OVER b, 0)) AS log_prior_mean_request_latency_ms,
  ln(1 + greatest(0, selection_event_num)::DOUBLE) AS log_event_index, ln(1 + greatest(0, coalesce(selection_event_num - lag(selection_event_num) OVER q, 0))::DOUBLE) AS log_event_gap_from_previous_selection
  FROM sx WINDOW q AS (PARTITION BY session_id ORDER BY selection_event_num, request_event_num, selection_id), b AS (PARTITION BY session_id ORDER BY selection_event_num, request_event_num, selection_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_PICKED = ", ".join(f"round({c}, 6) AS {c}" for c in PREDICTORS)
_FEATURE_PARTS = (WINDOW_SQL, FIRST_SQL, SELECTION_SQL, proxies.SELECTION_TABLE_SQL, proxies.SESSION_TABLE_SQL)
_PREDICT_PARTS = (WINDOW_SQL, FIRST_SQL, SELECTION_SQL, proxies.SELECTION_TABLE_SQL, _PREDICT)
_MISSING = " || ".join(f"CASE WHEN {c} IS NULL THEN '{c}|' ELSE '' END" for c in FEATURES)
_LONG = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS feature, {c}::DOUBLE AS x, session_id FROM fs" for i, c in enumerate(FEATURES))
_CENTRED = "avg(pow(x - mu, 3)) / nullif(pow(avg(pow(x - mu, 2)), 1.5), 0)"
#: Skewness of the population; DuckDB's own is adjusted for the sample.
_SUMMARY = f"""lg AS ({_LONG}), mu AS (SELECT feature, avg(x) AS mu FROM lg GROUP BY feature),
sm AS (SELECT feature, count(*) AS n_total, count(x) AS n_observed, count(*) - count(x) AS n_missing, CASE WHEN count(x) > 0 THEN round(count(*) FILTER (x = 0)::DOUBLE / count(x), 6) END AS zero_fraction_observed, count(DISTINCT x) AS unique_values,
  round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
  CASE WHEN count(x) > 0 THEN round(coalesce({_CENTRED}, 0), 6) END AS skewness, count(*) FILTER (x = 0)::DOUBLE / nullif(count(x), 0) >= 0.95 AS zero_dominated FROM lg JOIN mu USING (feature) GROUP BY feature)"""
_REGISTRY = "rg(feature, source, family, transform, analysis_role) AS (VALUES " + ", ".join(str(r) for r in features.REGISTRY) + ")"


def _pairs(columns: list[str], diagonal: bool) -> str:
    """Average ranks of every pair of columns over the rows that have both."""
    named = ", ".join(f"({i}, '{c}')" for i, c in enumerate(columns))
    long = " UNION ALL ".join(f"SELECT {i} AS i, session_id, {c}::DOUBLE AS x FROM fs WHERE {c} IS NOT NULL" for i, c in enumerate(columns))
    rank = lambda v: f"rank() OVER (PARTITION BY i, j ORDER BY {v}) + (count(*) OVER (PARTITION BY i, j, {v}) - 1) / 2.0::DOUBLE"
    return f"""nm(i, c) AS (VALUES {named}), lv AS ({long}), pr AS (SELECT a.i, b.i AS j, a.x, b.x AS y FROM lv a JOIN lv b USING (session_id)),
rk AS (SELECT i, j, {rank('x')} AS rx, {rank('y')} AS ry FROM pr),
rh AS (SELECT i, j, count(*) AS n, CASE WHEN {"i = j" if diagonal else "false"} THEN 1.0 WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM rk GROUP BY i, j)"""


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in features.PRIMARY)
_FOLDS = """kd AS (SELECT session_id, string_agg(label || ':' || n, ',' ORDER BY label || ':' || n) AS kind, sum(n)::BIGINT AS rows FROM (SELECT session_id, label, count(*) AS n FROM ds GROUP BY ALL) GROUP BY session_id),
fd AS (SELECT session_id, ((row_number() OVER (PARTITION BY kind ORDER BY session_id) - 1 + rows) % 5)::INT AS fold FROM kd), fo AS (SELECT ds.*, fold FROM ds JOIN fd USING (session_id))"""
_DIRECT = "ds AS (SELECT *, (outcome = 'direct_adoption')::INT AS label FROM pf WHERE outcome <> 'non_adoption')"
_NON = "ds AS (SELECT *, (outcome = 'non_adoption')::INT AS label FROM pf)"
_THREE = "ds AS (SELECT *, outcome AS label FROM pf)"


def _split(classes: str) -> str:
    return f"SELECT fold, (sum(test_rows) OVER () - test_rows)::BIGINT AS train_rows, test_rows, (sum(test_sessions) OVER () - test_sessions)::BIGINT AS train_sessions, test_sessions, 0::BIGINT AS session_overlap, {classes} FROM (SELECT fold, count(*) AS test_rows, count(DISTINCT session_id) AS test_sessions, count(*) FILTER (label::VARCHAR IN ('0', 'direct_adoption')) AS a, count(*) FILTER (label::VARCHAR IN ('1', 'modified_adoption')) AS b, count(*) FILTER (label::VARCHAR = 'non_adoption') AS c FROM fo GROUP BY fold)"


_SAME = "from_state = to_state"
_MOVES = f"""pr AS (SELECT session_id, outcome AS from_state, lead(outcome) OVER q AS to_state, window_id <> lead(window_id) OVER q AS crossed FROM s WINDOW q AS (PARTITION BY session_id ORDER BY event_num)),
mv AS (SELECT session_id, count(*) FILTER (NOT crossed) AS intra, count(*) FILTER (crossed) AS crosses, count(*) AS moves, count(*) FILTER ({_SAME}) AS stays, count(*) FILTER (crossed AND {_SAME}) AS cross_stays FROM pr WHERE to_state IS NOT NULL GROUP BY session_id),
e1 AS (SELECT session_id, abs(sum(q * ln(q))) / ln(3.0::DOUBLE) AS h FROM (SELECT session_id, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY session_id) AS q FROM s GROUP BY session_id, outcome) GROUP BY session_id),
e2 AS (SELECT session_id, abs(sum(q * ln(q))) / ln(9.0::DOUBLE) AS h FROM (SELECT session_id, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY session_id) AS q FROM pr WHERE crossed AND to_state IS NOT NULL GROUP BY session_id, from_state, to_state) GROUP BY session_id),
b AS (SELECT session_id, count(*) AS selection_count, count(DISTINCT window_id) AS selected_request_count, arg_min(outcome, event_num) AS first_outcome, arg_max(outcome, event_num) AS last_outcome,
  round(count(*) FILTER (outcome = 'direct_adoption')::DOUBLE / count(*), 6) AS direct_selection_share, round(count(*) FILTER (outcome = 'modified_adoption')::DOUBLE / count(*), 6) AS modified_selection_share, round(count(*) FILTER (outcome = 'non_adoption')::DOUBLE / count(*), 6) AS non_adoption_selection_share FROM s GROUP BY session_id)"""

ORACLES: dict[str, str] = {
    "session_transition_metrics": _with("""SELECT b.*, coalesce(intra, 0) AS intra_request_transition_count, coalesce(crosses, 0) AS cross_request_transition_count, coalesce(moves, 0) AS all_transition_count, round(stays::DOUBLE / moves, 6) AS all_self_transition_rate,
CASE WHEN crosses > 0 THEN round(cross_stays::DOUBLE / crosses, 6) END AS cross_request_self_transition_rate, round(e1.h, 6) AS state_entropy_normalized, round(e2.h, 6) AS cross_transition_entropy_normalized
FROM b LEFT JOIN mv USING (session_id) LEFT JOIN e1 USING (session_id) LEFT JOIN e2 USING (session_id)""", WINDOW_SQL, SELECTION_SQL, _MOVES),
    "text_delta_signatures": _with("SELECT event_name, source, CASE event_name WHEN 'text-insert' THEN 'RI' ELSE 'RD' END AS signature, count(*) AS events FROM t WHERE event_name IN ('text-insert', 'text-delete') GROUP BY ALL"),
    "fold_totals": _with("SELECT count(DISTINCT fold) AS folds, count(*) AS rows, count(DISTINCT session_id) AS sessions, count(DISTINCT (session_id, fold)) - count(DISTINCT session_id) AS overlap, count(*) FILTER (label = 1) AS positive, 1 AS even FROM fo", *_PREDICT_PARTS, _DIRECT, _FOLDS),
    "stratified_folds": _with("SELECT session_id, event_num, fold FROM fo", *_PREDICT_PARTS, _DIRECT, _FOLDS),
    "grouped_split_audit": _with(_split("a AS test_direct, b AS test_modified, c AS test_non_adoption"), *_PREDICT_PARTS, _THREE, _FOLDS),
    "task_split_audit": _with(_split("a AS test_negative, b AS test_positive, round(b::DOUBLE / test_rows, 6) AS test_positive_prevalence"), *_PREDICT_PARTS, _NON, _FOLDS),
    "prior_baseline_metrics": _with(
        """SELECT fold, CASE WHEN np > 0 AND nq > 0 THEN 0.5::DOUBLE END AS roc_auc, CASE WHEN np > 0 AND nq > 0 THEN round(np / (np + nq), 6) END AS average_precision, CASE WHEN np > 0 AND nq > 0 THEN 0.5::DOUBLE END AS balanced_accuracy,
CASE WHEN np > 0 AND nq > 0 THEN round(CASE WHEN p >= 0.5 THEN 2 * np / (2 * np + nq) ELSE 2 * nq / (2 * nq + np) END / 2, 6) END AS macro_f1, CASE WHEN np > 0 AND nq > 0 THEN round(CASE WHEN p >= 0.5 THEN np ELSE nq END / (np + nq), 6) END AS accuracy,
CASE WHEN np > 0 AND nq > 0 THEN round(CASE WHEN p >= 0.5 THEN np / (np + nq) ELSE 0 END, 6) END AS precision, CASE WHEN np > 0 AND nq > 0 THEN CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END END AS recall,
CASE WHEN np > 0 AND nq > 0 THEN round((np * (1 - p) ** 2 + nq * p ** 2) / (np + nq), 6) END AS brier_score, CASE WHEN np > 0 AND nq > 0 THEN round((-np * ln(p) - nq * ln(1 - p)) / (np + nq), 6) END AS log_loss
FROM (SELECT fold, np, nq, (tp - np) / (tp + tq - np - nq) AS p FROM (SELECT fold, count(*) FILTER (label = 1)::DOUBLE AS np, count(*) FILTER (label = 0)::DOUBLE AS nq FROM fo GROUP BY fold), (SELECT count(*) FILTER (label = 1)::DOUBLE AS tp, count(*) FILTER (label = 0)::DOUBLE AS tq FROM fo))""",
        *_PREDICT_PARTS, _DIRECT, _FOLDS),
    "class_prior_metrics": _with(
        """SELECT fold, round((f1(d, n, best = 'd') + f1(m, n, best = 'm') + f1(z, n, best = 'z')) / 3, 6) AS macro_f1, round(1.0::DOUBLE / ((d > 0)::INT + (m > 0)::INT + (z > 0)::INT) * CASE best WHEN 'd' THEN (d > 0)::INT WHEN 'm' THEN (m > 0)::INT ELSE (z > 0)::INT END, 6) AS balanced_accuracy,
round(CASE best WHEN 'd' THEN d WHEN 'm' THEN m ELSE z END / n, 6) AS accuracy, round(-(d * ln(greatest(pd, 1e-15)) + m * ln(greatest(pm, 1e-15)) + z * ln(greatest(pz, 1e-15))) / n, 6) AS log_loss,
round(f1(d, n, best = 'd'), 6) AS f1_direct_adoption, round(f1(m, n, best = 'm'), 6) AS f1_modified_adoption, round(f1(z, n, best = 'z'), 6) AS f1_non_adoption FROM (SELECT *, CASE WHEN pd >= pm AND pd >= pz THEN 'd' WHEN pm >= pz THEN 'm' ELSE 'z' END AS best FROM
(SELECT fold, d, m, z, d + m + z AS n, (td - d) / (td + tm + tz - d - m - z) AS pd, (tm - m) / (td + tm + tz - d - m - z) AS pm, (tz - z) / (td + tm + tz - d - m - z) AS pz FROM
(SELECT fold, count(*) FILTER (label = 'direct_adoption')::DOUBLE AS d, count(*) FILTER (label = 'modified_adoption')::DOUBLE AS m, count(*) FILTER (label = 'non_adoption')::DOUBLE AS z FROM fo GROUP BY fold),
(SELECT count(*) FILTER (label = 'direct_adoption')::DOUBLE AS td, count(*) FILTER (label = 'modified_adoption')::DOUBLE AS tm, count(*) FILTER (label = 'non_adoption')::DOUBLE AS tz FROM fo)))""".replace("f1(d, n, best = 'd')", "CASE WHEN best = 'd' THEN 2 * d / (n + d) ELSE 0 END").replace("f1(m, n, best = 'm')", "CASE WHEN best = 'm' THEN 2 * m / (n + m) ELSE 0 END").replace("f1(z, n, best = 'z')", "CASE WHEN best = 'z' THEN 2 * z / (n + z) ELSE 0 END"),
        *_PREDICT_PARTS, _THREE, _FOLDS),
    "session_table": _with("SELECT session_id, authored_text_chars, round(ai_share, 6) AS ai_share, suggestion_requests, suggestion_selections, dismissed_episodes, suggestion_reopens, multi_selection_episodes, direct_adoptions, modified_adoptions, ai_inserted_chars, ai_surviving_chars, round(human_generation_before_ai_ratio, 6) AS human_generation_before_ai_ratio, round(density, 6) AS consultation_density_per_1000_authored_chars, median_request_to_selection_ms, median_open_to_selection_ms, round(burst, 6) AS consultation_burstiness, session_duration_ms FROM se", *_FEATURE_PARTS),
    "session_features": _with("SELECT session_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + ", (" + " AND ".join(f"{c} IS NOT NULL" for c in features.BEHAVIORAL) + ")::INT AS behavioral_complete, (" + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES) + ")::INT AS profile_complete FROM fs", *_FEATURE_PARTS),
    "feature_summary": _with("SELECT * FROM sm", *_FEATURE_PARTS, _SUMMARY),
    "feature_diagnostics": _with("SELECT sm.*, family, analysis_role, round(n_missing::DOUBLE / n_total, 6) AS missing_fraction FROM sm JOIN rg USING (feature)", *_FEATURE_PARTS, _SUMMARY, _REGISTRY),
    "feature_registry": f"WITH {_REGISTRY} SELECT * FROM rg",
    "spearman_matrix": _with("SELECT a.c AS feature_a, b.c AS feature_b, coalesce(n, 0) AS n, round(rho, 6) AS spearman_rho FROM nm a CROSS JOIN nm b LEFT JOIN rh ON rh.i = a.i AND rh.j = b.i", *_FEATURE_PARTS, _pairs(RANKED, True)),
    "spearman_matrix_historical": _with("SELECT a.c AS feature_a, b.c AS feature_b, coalesce(n, 0) AS n, CASE WHEN n >= 30 THEN round(rho, 6) END AS spearman_rho FROM nm a CROSS JOIN nm b LEFT JOIN rh ON rh.i = a.i AND rh.j = b.i", *_FEATURE_PARTS, _pairs(RANKED, False)),
    "strong_correlations": _with("SELECT a.c AS feature_a, b.c AS feature_b, round(rho, 6) AS spearman_rho, round(abs(rho), 6) AS absolute_rho FROM rh JOIN nm a ON a.i = rh.i JOIN nm b ON b.i = rh.j WHERE rh.i < rh.j AND n >= 3 AND abs(rho) >= 0.3", *_FEATURE_PARTS, _pairs(FEATURES, True)),
    "scaler_parameters": _with("SELECT feature, round(q[2], 6) AS median, round(q[1], 6) AS q1, round(q[3], 6) AS q3, round(q[3] - q[1], 6) AS iqr FROM (SELECT feature, quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS x FROM fs WHERE {_COMPLETE}" for c in features.PRIMARY) + ") GROUP BY feature)", *_FEATURE_PARTS),
    "primary_matrix": _with("SELECT session_id, " + ", ".join(f"round(({c} - (quantile_cont({c}, 0.5) OVER ())) / coalesce(nullif((quantile_cont({c}, 0.75) OVER ()) - (quantile_cont({c}, 0.25) OVER ()), 0), 1), 6) AS {c}" for c in features.PRIMARY) + f" FROM fs WHERE {_COMPLETE}", *_FEATURE_PARTS),
    "primary_coverage": _with(f"SELECT count(*) AS sessions, count(*) FILTER ({_COMPLETE}) AS complete_sessions, round(count(*) FILTER ({_COMPLETE})::DOUBLE / count(*), 6) AS coverage FROM fs", *_FEATURE_PARTS),
    "sequences": _with("SELECT u.session_id, coalesce(states, '') AS states FROM (SELECT DISTINCT session_id FROM t) u LEFT JOIN (SELECT session_id, string_agg(outcome, ',' ORDER BY event_num) AS states FROM s GROUP BY session_id) USING (session_id)", WINDOW_SQL, SELECTION_SQL),
    "matrix_rows": _matrix("AND window_id <> nw", "'cross_request' AS scope, g.from_state, " + _label("g.from_state") + " AS from_label, g.to_state, " + _label("g.to_state") + " AS to_label"),
    "average_ranks": _with("SELECT session_id, rank() OVER (ORDER BY human_chars) + (count(*) OVER (PARTITION BY human_chars) - 1) / 2.0::DOUBLE AS rank_avg FROM a", SHARE_SQL),
    "benjamini_hochberg": "WITH p AS (SELECT r_regionkey::INT AS test, (r_regionkey * 7 % 5 + 1) / 50.0::DOUBLE AS p FROM region), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p) SELECT test, p, round(least(1, min(p * m / k) OVER (ORDER BY k DESC)), 6) AS fdr_q FROM r",
    "cluster_silhouette": _with("""SELECT i AS session_id, g AS cluster, round(CASE WHEN n > 1 AND greatest(own, near) > 0 THEN (near - own) / greatest(own, near) ELSE 0 END, 6) AS silhouette FROM
(SELECT i, g, max(n) FILTER (g = h) AS n, max(total / nullif(n - 1, 0)) FILTER (g = h) AS own, min(total / n) FILTER (g <> h) AS near FROM (SELECT x.session_id AS i, x.g, y.g AS h, count(*) AS n, sum(sqrt((x.ai_chars - y.ai_chars) ** 2 + (x.human_chars - y.human_chars) ** 2 + (x.ai_share - y.ai_share) ** 2)) AS total FROM c x, c y GROUP BY ALL) GROUP BY i, g)""",
        SHARE_SQL, """c AS (SELECT session_id, ai_chars::DOUBLE AS ai_chars, human_chars::DOUBLE AS human_chars, ai_share, CASE "group" WHEN 'Low' THEN 0 WHEN 'Moderate' THEN 1 ELSE 2 END AS g FROM m)"""),
    "audit_features": _with("SELECT r.check, v = 0 AS ok, v AS violations FROM (" + " UNION ALL ".join(f"SELECT '{c} lies in [0, 1]' AS check, count(*) FILTER ({c} < 0 OR {c} > 1) AS v FROM fs" for c in audits.SHARES) + " UNION ALL SELECT 'session occurs once', count(*) - count(DISTINCT session_id) FROM fs) r", *_FEATURE_PARTS),
    "missing_shares": _with("SELECT feature, count(*) FILTER (x IS NULL) AS missing, round(100.0::DOUBLE * count(*) FILTER (x IS NULL) / count(*), 6) AS missing_percent FROM lg GROUP BY feature", *_FEATURE_PARTS, f"lg AS ({_LONG})"),
    "scan_event_counts": _with("SELECT event_name, source, count(*) AS n, sum(k)::BIGINT AS chars FROM t GROUP BY ALL"),
    "request_windows": _with("SELECT session_id, event_num, window_id FROM w", WINDOW_SQL),
    "first_in_window": _with("SELECT * FROM f", WINDOW_SQL, FIRST_SQL),
    "five_way_outcomes": _with("SELECT * FROM o", WINDOW_SQL, FIRST_SQL),
    "five_way_counts": _with("SELECT outcome, count(*) AS n FROM o GROUP BY outcome", WINDOW_SQL, FIRST_SQL),
    "fifo_match_requests": _fifo("event_name = 'suggestion-get'", "event_name = 'suggestion-open'"),
    "fifo_match_insertions": _fifo("event_name = 'suggestion-select'", "event_name = 'text-insert' AND source = 'api'"),
    "orphan_selects": _with("SELECT session_id, event_num FROM t x WHERE event_name = 'suggestion-select' AND NOT EXISTS (SELECT 1 FROM t y WHERE y.session_id = x.session_id AND y.event_num < x.event_num AND y.event_name = 'suggestion-open')"),
    "session_indicators": _with(
        """SELECT r.*, round(pre_chars_median, 6) AS pre_chars_median, coalesce(post_edits, 0) AS post_edits FROM r LEFT JOIN pre USING (session_id) LEFT JOIN post USING (session_id)""", WINDOW_SQL, FIRST_SQL,
        """n AS (SELECT *, coalesce(insert_ts, open_ts) AS anchor, lead(request_ts) OVER (PARTITION BY session_id ORDER BY window_id) AS next_ts FROM fi),
r AS (SELECT session_id, count(*) AS requests, count(*) FILTER (next_ts - request_ts <= 60000) AS reconsulted, count(open_num) AS opened, count(insert_num) AS inserted FROM n GROUP BY session_id),
e AS (SELECT session_id, timestamp_ms AS ts, k FROM t WHERE source = 'user' AND event_name IN ('text-insert', 'text-delete')),
pre AS (SELECT session_id, median(c) AS pre_chars_median FROM (SELECT g.session_id, g.event_num, coalesce(sum(e.k), 0) AS c FROM t g LEFT JOIN e ON e.session_id = g.session_id AND e.ts >= g.timestamp_ms - 30000 AND e.ts < g.timestamp_ms WHERE g.event_name = 'suggestion-get' GROUP BY ALL) GROUP BY session_id),
post AS (SELECT n.session_id, count(*) AS post_edits FROM n JOIN e ON e.session_id = n.session_id AND e.ts > anchor AND e.ts <= least(anchor + 30000, next_ts) GROUP BY n.session_id)"""),
    "session_duration": _with("SELECT session_id, CASE WHEN count(*) >= 2 THEN max(timestamp_ms) - min(timestamp_ms) END AS duration_ms FROM t GROUP BY session_id"),
    "burstiness_modern": _burst("timestamp_ms", "0.0"),
    "burstiness_historical": _burst("event_num", "NULL"),
    "state_entropy": _with("SELECT session_id, round(abs(sum(q * ln(q))) / ln(3.0::DOUBLE), 6) AS entropy FROM (SELECT session_id, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY session_id) AS q FROM s GROUP BY session_id, outcome) GROUP BY session_id", WINDOW_SQL, SELECTION_SQL),
    "selection_outcomes": _with("SELECT * FROM s", WINDOW_SQL, SELECTION_SQL),
    "transition_counts_all": _matrix(""),
    "transition_counts_cross": _matrix("AND window_id <> nw"),
    "positional_profile": _with("SELECT phase, outcome, coalesce(count, 0) AS count, coalesce(phase_total, 0) AS phase_total, coalesce(contributing_sessions, 0) AS contributing_sessions, round(coalesce(count, 0)::DOUBLE / phase_total, 6) AS share_within_phase FROM (VALUES ('early'), ('middle'), ('late')) ph(phase) CROSS JOIN (VALUES ('direct_adoption'), ('modified_adoption'), ('non_adoption')) st(outcome) LEFT JOIN (SELECT phase, outcome, count(*) AS count FROM p WHERE n >= 2 GROUP BY ALL) USING (phase, outcome) LEFT JOIN (SELECT phase, count(*) AS phase_total, count(DISTINCT session_id) AS contributing_sessions FROM p WHERE n >= 2 GROUP BY phase) USING (phase)", WINDOW_SQL, SELECTION_SQL),
    "endpoint_matrix": _with("SELECT a.x AS from_state, b.x AS to_state, coalesce(c, 0) AS count, round(coalesce(c, 0)::DOUBLE / nullif(sum(coalesce(c, 0)) OVER (PARTITION BY a.x), 0), 6) AS probability, (sum(coalesce(c, 0)) OVER ())::BIGINT AS eligible_sessions FROM st a CROSS JOIN st b LEFT JOIN (SELECT u, v, count(*) AS c FROM (SELECT arg_min(outcome, event_num) AS u, arg_max(outcome, event_num) AS v FROM s GROUP BY session_id HAVING count(*) >= 2) GROUP BY ALL) ON u = a.x AND v = b.x", WINDOW_SQL, SELECTION_SQL, "st(x) AS (VALUES ('direct_adoption'), ('modified_adoption'), ('non_adoption'))"),
    "phase_shares": _with(f"SELECT session_id, phase, count(*) AS phase_selection_count, {_SHARES} FROM p GROUP BY ALL", WINDOW_SQL, SELECTION_SQL),
    "early_late_change": _with(
        "SELECT outcome, count(*) AS sessions, round(avg(d), 6) AS mean_late_minus_early, round(median(d), 6) AS median_late_minus_early FROM dd GROUP BY outcome", WINDOW_SQL, SELECTION_SQL,
        "ph AS (SELECT session_id, phase, st.x AS outcome, avg(CASE WHEN p.outcome = st.x THEN 1.0::DOUBLE ELSE 0 END) AS v FROM p, (VALUES " + ", ".join(f"('{x}')" for x in STATES) + ") st(x) WHERE phase <> 'middle' GROUP BY ALL), dd AS (SELECT e.outcome, l.v - e.v AS d FROM ph e JOIN ph l ON e.session_id = l.session_id AND e.outcome = l.outcome AND e.phase = 'early' AND l.phase = 'late')"),
    "ai_share_tertiles": _with("SELECT round(low, 6) AS low, round(high, 6) AS high FROM th", SHARE_SQL),
    "group_membership": _with('SELECT session_id, ai_chars, human_chars, round(ai_share, 6) AS ai_share, "group" FROM m', SHARE_SQL),
    "group_summary": _with('SELECT "group", count(*) AS n_sessions, round(avg(ai_share), 6) AS ai_share_mean, round(median(ai_share), 6) AS ai_share_median, round(avg(human_chars), 6) AS human_chars_mean, round(avg(ai_chars), 6) AS ai_chars_mean FROM m GROUP BY "group"', SHARE_SQL),
    "outcomes_by_group": _with('SELECT "group", n_sessions, n_requests, ' + ", ".join(f"{short}_count, round({short}_count::DOUBLE / n_requests, 6) AS {other}, round({short}_count::DOUBLE / n_requests, 6) AS {short}_share" for short, other in grouping.SHORT.values()) + ' FROM (SELECT "group", count(DISTINCT session_id) AS n_sessions FROM m GROUP BY 1) JOIN (SELECT "group", count(*) AS n_requests, ' + ", ".join(f"count(*) FILTER (outcome = '{x}') AS {short}_count" for x, (short, _) in grouping.SHORT.items()) + ' FROM o JOIN m USING (session_id) GROUP BY "group") USING ("group")', WINDOW_SQL, FIRST_SQL, SHARE_SQL),
    "spearman_share": _with("SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY ai_share) + (count(*) OVER (PARTITION BY ai_share) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY human_chars) + (count(*) OVER (PARTITION BY human_chars) - 1) / 2.0::DOUBLE AS ry FROM a)", SHARE_SQL),
    "prediction_features": _with(f"SELECT session_id, selection_id, event_num, outcome, {_PICKED} FROM pf", *_PREDICT_PARTS),
    "non_adoption_dataset": _with("SELECT session_id, event_num, (outcome = 'non_adoption')::INT AS label, round(log_event_gap_from_previous_selection, 6) AS log_event_gap_from_previous_selection FROM pf", *_PREDICT_PARTS),
    "direct_vs_modified_dataset": _with("SELECT session_id, event_num, (outcome = 'direct_adoption')::INT AS label, round(log_selection_ordinal, 6) AS log_selection_ordinal FROM pf WHERE outcome <> 'non_adoption'", *_PREDICT_PARTS),
    "missingness_patterns": _with(f"SELECT CASE WHEN miss = '' THEN 'complete' ELSE rtrim(miss, '|') END AS missing_features, (len(miss) - len(replace(miss, '|', '')))::INT AS missing_count, count(*) AS sessions, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS session_fraction FROM (SELECT {_MISSING} AS miss FROM fs) GROUP BY ALL", *_FEATURE_PARTS),
    "robust_scale": _with("SELECT session_id, round((ai_share - q[2]) / CASE WHEN q[3] - q[1] <> 0 THEN q[3] - q[1] ELSE 1 END, 6) AS scaled FROM a, (SELECT quantile_cont(ai_share, [0.25, 0.5, 0.75]) AS q FROM a)", SHARE_SQL),
    "standard_scale": _with("SELECT session_id, round((ai_share - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS scaled FROM a, (SELECT avg(ai_share) AS mu, stddev_pop(ai_share) AS sd FROM a)", SHARE_SQL),
    "cluster_profiles": _with('SELECT "group" AS cluster, feature, count(x) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY feature), 6) AS cluster_fraction, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(min(x), 6) AS min, round(max(x), 6) AS max FROM (' + " UNION ALL ".join(f"SELECT \"group\", '{c}' AS feature, {c}::DOUBLE AS x FROM m" for c in ("ai_share", "human_chars", "ai_chars")) + ') GROUP BY "group", feature', SHARE_SQL),
    "binary_metrics": """WITH l AS (SELECT quality::INT AS y, (doc_id * 37 % 101) / 100.0::DOUBLE AS s FROM labels), c AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM l GROUP BY s),
u AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp FROM c), z AS (SELECT sum(p)::DOUBLE AS np, sum(q)::DOUBLE AS nq FROM c)
SELECT (any_value(np) + any_value(nq))::BIGINT AS n, round(1 - sum(p * (fp - q / 2.0::DOUBLE)) / any_value(np * nq), 6) AS roc_auc, round(sum(p * tp::DOUBLE / (tp + fp)) / any_value(np), 6) AS average_precision,
round(sum(p * (1 - s) ** 2 + q * s ** 2) / any_value(np + nq), 6) AS brier, round((sum(CASE WHEN s >= 0.5 THEN p ELSE 0 END) / any_value(np) + sum(CASE WHEN s < 0.5 THEN q ELSE 0 END) / any_value(nq)) / 2, 6) AS balanced_accuracy,
round((2 * sum(CASE WHEN s >= 0.5 THEN p ELSE 0 END)::DOUBLE / (sum(CASE WHEN s >= 0.5 THEN p + q ELSE 0 END) + any_value(np)) + 2 * sum(CASE WHEN s < 0.5 THEN q ELSE 0 END)::DOUBLE / (sum(CASE WHEN s < 0.5 THEN p + q ELSE 0 END) + any_value(nq))) / 2, 6) AS macro_f1 FROM u, z""",
}

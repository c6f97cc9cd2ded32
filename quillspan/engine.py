"""Session logs to tables: reconstruction, exports, analysis, audits and release checks as functions over Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.exprs import INDICATOR_LABELS
from .operators import audits, features, grouping, indicators, inference, metrics, models, multivariate, release, requests, sequences, stats
from .sources.jsonl import bad_lines, read_sessions

LAYERS = ("modern", "target", "features")
AUDITS = ("text-deltas", "lifecycle", "provenance", "metrics", "features")
#: What each task is explained with (fixed values).
EXPLAINED = {"direct_vs_modified": "boosted_trees", "non_adoption_detection": "logistic"}


def load(spark: SparkSession, path: str, pattern: str = "*.jsonl", without: DataFrame | None = None) -> DataFrame:
    """The events of all logs, but for files named in without (path)."""
    events = read_sessions(spark, path, pattern, without)
    return events.withColumn("ops_json", metrics.ops_of(events["text_delta"]))


def reconstruct(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """The events of the files that can be read, and the quarantine: path, line and error of the lines that keep the others out."""
    bad = bad_lines(spark, path, pattern)
    return load(spark, path, pattern, bad), bad


def summary(events: DataFrame) -> DataFrame:
    """One row: sessions, events, requests, opens, selections, closes."""
    count = lambda name: F.count_if(F.col("event_name") == f"suggestion-{name}").alias(f"{name}s")
    return events.agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("events"), *[count(n) for n in ("get", "open", "reopen", "select", "close")])


def selections_of(selection_metrics: DataFrame) -> DataFrame:
    """The selection table in the shape that sequences and inference take."""
    return selection_metrics.select("session_id", F.col("selection_event_num").alias("event_num"), F.col("request_event_num").alias("window_id"), F.col("adoption_outcome").alias("outcome"))


def export(events: DataFrame, layer: str) -> dict[str, DataFrame]:
    """The tables of a layer: modern (selection and session metrics), target (historical indicators and outcomes) or features."""
    if layer == "modern":
        sessions = metrics.replayed(events)
        return {"selection_metrics": metrics.selection_metrics(sessions), "session_metrics": metrics.session_metrics(sessions)}
    if layer == "target":
        return {"target_behavior_metrics": indicators.target_behavior_metrics(indicators.historical_sessions(events)), "request_outcomes": requests.request_outcomes(events)}
    if layer == "features":
        return {"ml_session_features": features.session_features(metrics.session_metrics(metrics.replayed(events)))}
    raise ValueError(f"unknown layer {layer}")


def analyze_groups(target: DataFrame, request_outcomes: DataFrame) -> dict[str, DataFrame]:
    """The historical tables: thresholds, memberships, groups, outcomes by group, rank correlations of the ten indicators with their sample sizes."""
    shares = target.withColumn("ai_share", F.col("ai_contribution"))
    names = list(INDICATOR_LABELS)
    matrix = stats.spearman_matrix(target, names, 30, diagonal=False)
    return {
        "ai_share_thresholds": grouping.thresholds(shares), "ai_share_groups": grouping.membership(shares.select("session_id", "ai_share")),
        "target_behavior_by_ai_share": grouping.group_summary(target, tuple(n for n in names if n != "ai_contribution"), "ai_contribution"),
        "target_outcomes_by_ai_share": grouping.outcomes_by_group(request_outcomes, shares.select("session_id", "ai_share")),
        "target_behavior_correlations": matrix.select("feature_a", "feature_b", "spearman_rho"), "target_behavior_sample_sizes": matrix.select("feature_a", "feature_b", "n"),
    }


def analyze_transitions(selection_metrics: DataFrame) -> dict[str, DataFrame]:
    """The transition and phase tables of selections."""
    s = selections_of(selection_metrics)
    out: dict[str, DataFrame] = {}
    for scope in ("all", "cross_request"):
        out |= {f"transition_matrix_{scope}": sequences.matrix_rows(sequences.transition_matrix(s, scope), scope), f"transition_bootstrap_{scope}": inference.bootstrap_transition_probabilities(s, scope), f"transition_permutation_null_{scope}": inference.permutation_transition_test(s, scope), f"transition_persistence_{scope}": inference.persistence_test(s, scope)}
    return out | {
        "session_transition_metrics": inference.session_transition_metrics(s), "positional_outcomes": sequences.positional_profile(s), "endpoint_matrix": sequences.endpoints(s),
        "session_phase_shares": sequences.phase_shares(s), "session_weighted_phase_summary": inference.phase_summary(s), "early_late_change": inference.early_late_intervals(s),
    }


def analyze_features(session_features: DataFrame) -> dict[str, DataFrame]:
    """Diagnostics of the session features and the matrix that clustering takes, raw and scaled."""
    names = list(features.PROFILE)
    matrix = stats.spearman_matrix(session_features, names)
    complete = multivariate.complete(session_features, list(features.PRIMARY)).select("session_id", *features.PRIMARY)
    further = {f"scaled_{name}": features.primary_matrix(session_features, columns) for name, columns in features.SENSITIVITY.items()}
    return further | {
        "feature_diagnostics": features.diagnostics(session_features), "missingness_patterns": features.missingness(session_features, names), "feature_spearman": matrix.select("feature_a", "feature_b", "spearman_rho"),
        "feature_pairwise_n": matrix.select("feature_a", "feature_b", "n"), "strong_correlations": stats.strongest_correlations(matrix, names), "primary_cluster_raw": complete, "primary_cluster_scaled": features.primary_matrix(session_features),
        "scaler_parameters": features.scaler(session_features, list(features.PRIMARY)),
    }


def manifests(session_features: DataFrame) -> dict[str, dict]:
    """The feature registry, and what the primary matrix holds and is scaled by."""
    rows = session_features.agg(F.count("*").alias("n"), F.sum("behavioral_complete").alias("b"), F.sum("profile_complete").alias("p")).first()
    cover, scale = features.coverage(session_features).first(), features.scaler(session_features, list(features.PRIMARY)).collect()  # a row per feature
    return {
        "ml_session_features_manifest": {
            "rows": rows["n"], "behavioral_complete_rows": rows["b"], "profile_complete_rows": rows["p"], "behavioral_features": list(features.BEHAVIORAL), "profile_features": list(features.PROFILE),
            "features": [dict(zip(("name", "source", "family", "transform", "leakage_role"), r, strict=True)) for r in features.REGISTRY],
        },
        "primary_cluster_manifest": {
            "total_sessions": cover["sessions"], "included_sessions": cover["complete_sessions"], "excluded_sessions": cover["sessions"] - cover["complete_sessions"], "coverage": cover["coverage"] or 0.0, "feature_count": len(features.PRIMARY), "features": list(features.PRIMARY),
            "scaling": "median/IQR robust scaling", "scaler_parameters": {r["feature"]: {k: r[k] for k in ("median", "q1", "q3", "iqr")} for r in scale}, "sensitivity_feature_sets": {k: list(v) for k, v in features.SENSITIVITY.items()},
        },
    }


def analyze_clusters(session_features: DataFrame, ks: range = range(2, 9), repeats: int = 40) -> dict[str, DataFrame]:
    """Clusterings over k and algorithms with their profiles, their dependence on features, scaling and algorithm, and components."""
    names = list(features.PRIMARY)
    scaled = features.primary_matrix(session_features).cache()
    assigned = scaled.select("session_id")
    profiles = []
    for algorithm in ("kmeans", "ward", "gmm"):
        for k in ks:
            labels, _ = multivariate.fit_labels(scaled, names, algorithm, k)
            column = f"{algorithm}_k{k}"
            assigned = assigned.join(labels.withColumnRenamed("cluster", column), "session_id")
            raw = session_features.join(labels, "session_id")
            profiles.append(features.cluster_profiles(raw, "cluster", list(features.PROFILE)).select(F.lit(column).alias("solution"), "*"))
    drops = [multivariate.feature_drop(scaled, names, k) for k in (2, 4)]
    further = {n: list(c) for n, c in features.SENSITIVITY.items()}
    return {
        "cluster_evaluation": multivariate.evaluate_clusters(scaled, names, ks, repeats=repeats), "candidate_assignments": assigned, "cluster_profiles": reduce(DataFrame.unionByName, profiles), "feature_drop_robustness": reduce(DataFrame.unionByName, drops),
        **multivariate.sensitivity(session_features, names, further), **{f"pca_{n}": d for n, d in multivariate.dimension_tables(session_features, names).items()},
    }


def analyze_prediction(selection_metrics: DataFrame, models_: tuple[str, ...] = models.MODELS, folds: int = 5, iterations: int = 250, repeats: int = 1000, shuffles: int = 20) -> dict[str, DataFrame]:
    """Prediction of all three outcomes and of both binary tasks: metrics, predictions, audits, importance, coefficients and improvement over the baseline."""
    rows, names = features.prediction_features(selection_metrics).cache(), list(features.PREDICTORS)
    three = models.with_folds(rows, "outcome", folds=folds).cache()
    oof = models.out_of_fold_classes(three, names, models_, folds, iterations)
    spark = rows.sparkSession
    out = {"model_metrics": models.class_metric_summary(oof), "oof_predictions": oof, "grouped_cv_audit": models.grouped_split_audit(three), "feature_manifest": spark.createDataFrame([(i, n) for i, n in enumerate(names)], "position int, feature string")}
    parts: dict[str, list[DataFrame]] = {}
    for task in features.TASKS:
        data = models.with_folds(features.binary_dataset(rows, task), folds=folds).cache()
        predicted = models.out_of_fold(data, names, models_, folds, iterations).cache()
        found = {"binary_task_metrics": models.metric_summary(predicted), "binary_task_oof_predictions": predicted, "binary_task_cv_audit": models.split_audit(data), "model_improvement_bootstrap": models.improvement_bootstrap(predicted, repeats=repeats)}
        importance = models.permutation_importance(data, names, EXPLAINED[task], folds, shuffles, iterations)
        found |= {"permutation_importance_folds": importance, "permutation_importance_summary": models.importance_summary(importance)}
        found |= {"logistic_coefficient_folds": models.coefficient_folds(data, names, folds=folds), "logistic_coefficient_summary": models.coefficient_stability(data, names, folds=folds)}
        for name, df in found.items():
            parts.setdefault(name, []).append(df.select(F.lit(task).alias("task"), "*"))
    return out | {name: reduce(DataFrame.unionByName, dfs) for name, dfs in parts.items()}


def analyze(selection_metrics: DataFrame, session_metrics: DataFrame, target: DataFrame, request_outcomes: DataFrame) -> dict[str, DataFrame]:
    """Groups, transitions and features: all that needs no fitted model."""
    return analyze_groups(target, request_outcomes) | analyze_transitions(selection_metrics) | analyze_features(features.session_features(session_metrics))


def audit(events: DataFrame, name: str) -> DataFrame:
    if name == "text-deltas":
        return audits.top_signatures(events)
    sessions = metrics.replayed(events)
    if name == "lifecycle":
        return audits.lifecycle(events, sessions)
    if name == "provenance":
        return audits.provenance(events, sessions)
    if name == "metrics":
        return audits.selection_metrics(metrics.selection_metrics(sessions)).unionByName(audits.session_metrics(metrics.session_metrics(sessions)))
    if name == "features":
        return audits.features(features.session_features(metrics.session_metrics(sessions)))
    raise ValueError(f"unknown audit {name}")


def validate(tables: dict[str, DataFrame], expected: dict = release.EXPECTED) -> DataFrame:
    return release.validate(tables, expected)


def read_csv(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}.csv")

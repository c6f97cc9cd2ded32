"""Features of sessions and of selections at the time their text is inserted, and the preparation of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import STATES, finite, log1p, ratio
from . import multivariate, stats

#: Session features: name, source columns, family, transform, role (fixed values).
REGISTRY = (
    ("log_authored_text_chars", "authored_text_chars", "scale", "log1p", "predictor"),
    ("ai_share", "ai_share", "authorship", "identity", "predictor"),
    ("ai_retention_ratio", "ai_surviving_chars/ai_inserted_chars", "retention", "identity", "predictor"),
    ("human_generation_before_ai_ratio", "human_generation_before_ai_ratio", "authorship", "identity", "predictor"),
    ("selections_per_request", "suggestion_selections/suggestion_requests", "consultation", "identity", "predictor"),
    ("dismissal_rate", "dismissed_episodes/suggestion_requests", "consultation", "identity", "predictor"),
    ("reopen_rate", "suggestion_reopens/suggestion_requests", "consultation", "identity", "predictor"),
    ("multi_selection_rate", "multi_selection_episodes/suggestion_requests", "consultation", "identity", "predictor"),
    ("consultation_density_per_1000_authored_chars", "consultation_density_per_1000_authored_chars", "consultation", "identity", "predictor"),
    ("log_median_request_to_selection_ms", "median_request_to_selection_ms", "timing", "log1p", "predictor"),
    ("log_median_open_to_selection_ms", "median_open_to_selection_ms", "timing", "log1p", "predictor"),
    ("consultation_burstiness", "consultation_burstiness", "timing", "identity", "predictor"),
    ("log_session_duration_ms", "session_duration_ms", "scale", "log1p", "predictor"),
    ("direct_adoption_share", "direct_adoptions/suggestion_selections", "response_use", "identity", "outcome_profile"),
    ("modified_adoption_share", "modified_adoptions/suggestion_selections", "response_use", "identity", "outcome_profile"),
)
PROFILE = tuple(r[0] for r in REGISTRY)
BEHAVIORAL = tuple(r[0] for r in REGISTRY if r[4] == "predictor")
#: Features of the clustering, and further sets that it is compared with (fixed values).
PRIMARY = ("log_authored_text_chars", "ai_share", "ai_retention_ratio", "human_generation_before_ai_ratio", "selections_per_request", "log_median_open_to_selection_ms", "consultation_burstiness", "log_session_duration_ms")
SENSITIVITY = {"with_consultation_density": (*PRIMARY, "consultation_density_per_1000_authored_chars"), "with_dismissal_rate": (*PRIMARY, "dismissal_rate"), "with_direct_adoption": (*PRIMARY, "direct_adoption_share")}
#: What is known when a selection's text is inserted (fixed values).
PREDICTORS = (
    "log_inserted_chars", "selected_index", "log_request_to_selection_ms", "log_open_to_selection_ms", "log_selection_ordinal", "log_prior_mean_inserted_chars",
    "log_prior_mean_request_latency_ms", "log_event_index", "log_event_gap_from_previous_selection",
)


def session_features(sessions: DataFrame) -> DataFrame:
    """session_id, the 15 features of REGISTRY, behavioral_complete and profile_complete, from session metrics.

    Ratios without a denominator, logarithms of negative numbers and what is missing, NaN or
    infinite are null; a session is complete where no feature of the list is null.
    """

    def value(source: str, transform: str) -> Column:
        if "/" in source:
            return ratio(*source.split("/"))
        return log1p(F.col(source)) if transform == "log1p" else finite(F.col(source).cast("double"))

    out = sessions.select("session_id", *[value(source, transform).alias(name) for name, source, _, transform, _ in REGISTRY])
    whole = lambda names: F.forall(F.array(*[F.col(n).isNotNull() for n in names]), lambda x: x).cast("int")
    return out.withColumns({"behavioral_complete": whole(BEHAVIORAL), "profile_complete": whole(PROFILE)})


def prediction_features(selections: DataFrame) -> DataFrame:
    """session_id, selection_id, event_num, outcome and the nine PREDICTORS of every selection that was inserted.

    selections: as of `metrics.selection_metrics`. All come from what is known by then: the
    selection itself, and means over strictly earlier selections of the session (0 for the first). A
    negative or missing open latency is null; the gap is in event numbers, at least 0.
    """
    c = F.col
    own = Window.partitionBy("session_id").orderBy("selection_event_num", "request_event_num", "selection_id")
    prior = own.rowsBetween(Window.unboundedPreceding, -1)
    mean = lambda name: F.coalesce(F.avg(name).over(prior), F.lit(0.0))
    gap = F.greatest(F.lit(0), F.coalesce(c("selection_event_num") - F.lag("selection_event_num").over(own), F.lit(0)))
    values = (
        log1p("inserted_chars"), c("selected_index").cast("double"), log1p("request_to_selection_ms"), log1p("open_to_selection_ms"), F.log1p(F.row_number().over(own)), F.log1p(mean("inserted_chars")),
        F.log1p(mean("request_to_selection_ms")), F.log1p(F.greatest(F.lit(0), c("selection_event_num"))), F.log1p(gap),
    )
    return selections.where("insert_event_num is not null").select("session_id", "selection_id", c("selection_event_num").alias("event_num"), c("adoption_outcome").alias("outcome"), *[v.alias(n) for n, v in zip(PREDICTORS, values, strict=True)])


TASKS = ("direct_vs_modified", "non_adoption_detection")


def binary_dataset(features: DataFrame, task: str) -> DataFrame:
    """The rows of a task with label 0 or 1: direct against modified adoption (others drop out), or non-adoption against all."""
    if task == TASKS[0]:
        return features.where(F.col("outcome") != STATES[2]).withColumn("label", (F.col("outcome") == STATES[0]).cast("int"))
    if task == TASKS[1]:
        return features.withColumn("label", (F.col("outcome") == STATES[2]).cast("int"))
    raise ValueError(f"unknown task {task}")


def registry(df: DataFrame) -> DataFrame:
    """The feature registry as a table."""
    return df.sparkSession.createDataFrame(REGISTRY, "feature string, source string, family string, transform string, analysis_role string")


def diagnostics(features: DataFrame) -> DataFrame:
    """The 18 columns of every session feature: what it is, and how its values lie."""
    found = stats.summarize(features, list(PROFILE))
    named = found.join(registry(features).select("feature", "family", "analysis_role"), "feature")
    missing = F.when(F.col("n_total") > 0, F.col("n_missing") / F.col("n_total")).alias("missing_fraction")
    return named.select("feature", "family", "analysis_role", "n_total", "n_observed", "n_missing", missing, *found.columns[4:])


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Which features are missing together (complete: none), how many, in how many sessions; the commonest first, ties by name."""
    gone = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    pattern = F.when(F.size(gone) > 0, F.array_join(gone, "|")).otherwise("complete")
    per = df.select(pattern.alias("missing_features"), F.size(gone).alias("missing_count")).groupBy("missing_features", "missing_count").agg(F.count("*").alias("sessions"))
    total = F.sum("sessions").over(Window.partitionBy(F.lit(1)))  # a row per pattern
    return per.withColumn("session_fraction", F.col("sessions") / total).orderBy(F.col("sessions").desc(), "missing_features")


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, median, q1, q3 and iqr of the complete rows: what `primary_matrix` scales by."""
    long = multivariate.complete(df, columns).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select("f.*")
    q = long.groupBy("feature").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("feature", F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def primary_matrix(df: DataFrame, columns: tuple[str, ...] = PRIMARY) -> DataFrame:
    """session_id and the columns of the complete sessions, scaled by median and iqr (a zero iqr only centres)."""
    names = list(columns)
    return multivariate.scaled(multivariate.complete(df, names).select("session_id", *names), names, "robust")


def coverage(df: DataFrame, columns: tuple[str, ...] = PRIMARY) -> DataFrame:
    """One row: sessions, complete sessions and their share."""
    whole = F.forall(F.array(*[finite(F.col(c).cast("double")).isNotNull() for c in columns]), lambda x: x)
    return df.agg(F.count("*").alias("sessions"), F.count_if(whole).alias("complete_sessions")).withColumn("coverage", F.when(F.col("sessions") > 0, F.col("complete_sessions") / F.col("sessions")))


def cluster_profiles(assigned: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Per cluster and feature: n, the cluster's share of all rows, mean, median, min, max."""
    long = assigned.select(F.col(cluster).alias("cluster"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select("cluster", "f.*")
    per = long.groupBy("cluster", "feature").agg(F.count("x").alias("n"), F.count("*").alias("rows"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.min("x").alias("min"), F.max("x").alias("max"))
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy("feature"))  # a row per cluster
    return per.select("cluster", "feature", "n", share.alias("cluster_fraction"), "mean", "median", "min", "max")

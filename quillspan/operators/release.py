"""Release checks: the tables of a whole run against frozen counts and against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import OUTCOMES, STATES
from .audits import _unique, broken, frozen
from .features import PREDICTORS
from .grouping import SHORT

#: Counts of the published corpus (fixed values).
EXPECTED = {
    "sessions": 1447,
    "selections": 12812,
    "requests": 18103,
    "adoption": {"direct_adoption": 7833, "modified_adoption": 4754, "non_adoption": 225},
    "outcomes": {"accept_unchanged": 12427, "accepted_modified": 364, "non_adoption": 3205, "presented_no_selection": 878, "request_without_suggestion": 1229},
    "group_outcomes": {
        "Low": {"direct": 1437, "modified": 82, "non_adoption": 712, "no_selection": 153, "no_suggestion": 406},
        "Moderate": {"direct": 3514, "modified": 195, "non_adoption": 955, "no_selection": 321, "no_suggestion": 385},
        "High": {"direct": 7476, "modified": 87, "non_adoption": 1538, "no_selection": 404, "no_suggestion": 438},
    },
    "cross_transitions": {
        "direct_adoption": {"direct_adoption": 4897, "modified_adoption": 2090, "non_adoption": 63},
        "modified_adoption": {"direct_adoption": 2126, "modified_adoption": 1938, "non_adoption": 87},
        "non_adoption": {"direct_adoption": 72, "modified_adoption": 92, "non_adoption": 35},
    },
    "all_transitions": 11421,
    "endpoint_sessions": 1332,
}
#: How far sums of shares may be from 1 (fixed value).
TOLERANCE = 1e-12
CHECKS = ("raw", "metrics", "target", "analysis", "figures", "features", "temporal", "prediction")
#: Tables that a check needs.
NEEDS = {
    "raw": ("sessions",),
    "metrics": ("session_metrics", "selection_metrics"),
    "target": ("target_behavior_metrics", "request_outcomes"),
    "analysis": ("target_behavior_correlations", "target_outcomes_by_ai_share"),
    "figures": ("ai_share_response_outcomes", "trace_indicator_correlations"),
    "features": ("ml_session_features", "feature_spearman", "missingness_patterns", "primary_cluster_scaled"),
    "temporal": ("transition_matrix_cross_request", "transition_matrix_all", "endpoint_matrix", "early_late_change"),
    "prediction": ("model_metrics", "binary_task_metrics", "feature_manifest", "model_improvement_bootstrap"),
}


def _rows(name: str, df: DataFrame, expected: int) -> DataFrame:
    return frozen(df.agg(F.count("*").alias("v")).withColumn("k", F.lit(name)), "k", "v", {name: expected})


def _counts(df: DataFrame, column: str, expected: dict[str, int], name: str) -> DataFrame:
    """The counts of a column's values are these, and there are no other values."""
    seen = df.groupBy(F.concat(F.lit(f"{name}: "), F.col(column)).alias("k")).agg(F.count("*").alias("v"))
    known = broken(df, {f"{name}: no other values": F.col(column).isin(*expected)})
    return frozen(seen, "k", "v", {f"{name}: {k}": v for k, v in expected.items()}).unionByName(known)


def _sums_to_one(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    total: Column = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return broken(df, {name: F.abs(total - 1) <= TOLERANCE})


def check(name: str, tables: dict[str, DataFrame], expected: dict = EXPECTED) -> DataFrame:
    """Rows (check, ok, violations) of one of CHECKS."""
    absent = [t for t in NEEDS[name] if t not in tables]
    if absent:
        raise KeyError(f"{name} needs {', '.join(absent)}")
    t, c = tables, F.col
    if name == "raw":
        parts = [_rows("raw sessions", t["sessions"].select("session_id").distinct(), expected["sessions"])]
    elif name == "metrics":
        m, s = t["session_metrics"], t["selection_metrics"]
        parts = [
            _rows("session metric rows", m, expected["sessions"]), _rows("selection metric rows", s, expected["selections"]), _unique("session metric ids", m, ["session_id"]), _unique("selection metric ids", s, ["session_id", "selection_id"]),
            _counts(s, "adoption_outcome", expected["adoption"], "adoption"),
            broken(m, {"ai_share lies in [0, 1]": c("ai_share").between(0, 1), "authored = ai + human": c("authored_text_chars") == c("final_ai_chars") + c("final_human_chars"), "adoptions add up": c("direct_adoptions") + c("modified_adoptions") + c("non_adoptions") == c("suggestion_selections")}),
            broken(s, {"inserted = surviving + deleted": c("inserted_chars") == c("surviving_chars") + c("deleted_chars")}),
        ]
    elif name == "target":
        parts = [_rows("target session rows", t["target_behavior_metrics"], expected["sessions"]), _rows("request rows", t["request_outcomes"], expected["requests"]), _counts(t["request_outcomes"], "outcome", expected["outcomes"], "outcome")]
    elif name == "analysis":
        g = t["target_outcomes_by_ai_share"]
        cells = g.select(F.inline(F.array(*[F.struct(F.concat(c("group"), F.lit(f": {SHORT[o][0]}")).alias("k"), c(f"{SHORT[o][0]}_count").alias("v")) for o in OUTCOMES])))
        matrix = t["target_behavior_correlations"]
        both = matrix.alias("a").join(matrix.alias("b"), (c("a.feature_a") == c("b.feature_b")) & (c("a.feature_b") == c("b.feature_a")))
        parts = [
            _rows("groups", g, 3), frozen(cells, "k", "v", {f"{group}: {o}": n for group, own in expected["group_outcomes"].items() for o, n in own.items()}),
            _sums_to_one(g, "shares of a group add up to 1", [f"{SHORT[o][0]}_share" for o in OUTCOMES]), _rows("indicators correlated", matrix.select("feature_a").distinct(), 10),
            broken(both, {"correlations are symmetric": c("a.spearman_rho").eqNullSafe(c("b.spearman_rho")) | (F.abs(c("a.spearman_rho") - c("b.spearman_rho")) <= TOLERANCE)}),
            broken(matrix, {"correlations lie in [-1, 1]": c("spearman_rho").isNull() | c("spearman_rho").between(-1 - TOLERANCE, 1 + TOLERANCE)}),
        ]
    elif name == "figures":
        parts = [_rows("bars", t["ai_share_response_outcomes"], 15), _rows("cells of the heat map", t["trace_indicator_correlations"], 100)]
    elif name == "features":
        f = t["ml_session_features"]
        parts = [_rows("feature rows", f, expected["sessions"]), _unique("feature ids", f, ["session_id"]), frozen(t["missingness_patterns"].agg(F.sum("sessions").alias("v")).withColumn("k", F.lit("sessions over patterns")), "k", "v", {"sessions over patterns": expected["sessions"]}), _unique("matrix ids", t["primary_cluster_scaled"], ["session_id"]), broken(t["feature_spearman"].where("feature_a = feature_b"), {"diagonal is 1": c("spearman_rho") == 1.0})]
    elif name == "temporal":
        cross, every, ends = t["transition_matrix_cross_request"], t["transition_matrix_all"], t["endpoint_matrix"]
        cells = cross.select(F.concat_ws(" > ", "from_state", "to_state").alias("k"), c("count").alias("v"))
        total = lambda df, k: df.agg(F.sum("count").alias("v")).withColumn("k", F.lit(k))
        wanted = expected["cross_transitions"]
        parts = [
            frozen(cells, "k", "v", {f"{a} > {b}": n for a, own in wanted.items() for b, n in own.items()}), frozen(total(cross, "cross-request transitions"), "k", "v", {"cross-request transitions": sum(sum(own.values()) for own in wanted.values())}),
            frozen(total(every, "all transitions"), "k", "v", {"all transitions": expected["all_transitions"]}), frozen(total(ends, "endpoint sessions"), "k", "v", {"endpoint sessions": expected["endpoint_sessions"]}),
            broken(cross.groupBy("from_state").agg(F.sum("probability").alias("p")), {"rows of probabilities add up to 1": c("p").isNull() | (F.abs(c("p") - 1) <= 1e-9)}), _rows("changes from early to late", t["early_late_change"], len(STATES)),
        ]
    elif name == "prediction":
        known = broken(t["feature_manifest"], {"predictors are those known at insertion": c("feature").isin(*PREDICTORS)})
        bounded = {"areas lie in [0, 1]": ~c("metric").isin("roc_auc", "average_precision", "balanced_accuracy", "macro_f1", "accuracy") | c("mean").isNull() | c("mean").between(0, 1)}
        parts = [_rows("predictors", t["feature_manifest"], len(PREDICTORS)), known, broken(t["model_metrics"], bounded), broken(t["binary_task_metrics"], bounded), broken(t["model_improvement_bootstrap"], {"intervals are ordered": c("ci_2_5").isNull() | (c("ci_2_5") <= c("ci_97_5"))})]
    else:
        raise ValueError(f"unknown check {name}")
    return reduce(DataFrame.unionByName, parts).select(F.lit(name).alias("part"), "check", "ok", "violations")


def validate(tables: dict[str, DataFrame], expected: dict = EXPECTED) -> DataFrame:
    """All checks: part, check, ok, violations."""
    return reduce(DataFrame.unionByName, [check(name, tables, expected) for name in CHECKS])

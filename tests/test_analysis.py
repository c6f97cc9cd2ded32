"""Resampling, multivariate operators, prediction, audits and the command line against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.__main__ import main
from quillspan.functions.exprs import STATES
from quillspan.operators import audits, inference, metrics, models, multivariate, requests
from tests.test_metrics import events, line, sessions  # noqa: F401

D, M, N = STATES


@pytest.fixture(scope="module")
def chosen(spark):
    rows = [("s1", 10, 1, D), ("s1", 11, 1, M), ("s1", 20, 2, D), ("s2", 5, 1, D), ("s2", 9, 2, D)]
    return spark.createDataFrame(rows, "session_id string, event_num long, window_id long, outcome string")


def test_poisson_weights(spark):
    w = spark.range(200_000).select(inference.poisson_weight(inference.uniform(F.lit(1), "id")).alias("w")).agg(F.avg("w"), F.var_pop("w"), F.avg((F.col("w") == 0).cast("double"))).first()
    assert w[0] == pytest.approx(1, abs=0.01) and w[1] == pytest.approx(1, abs=0.03) and w[2] == pytest.approx(math.exp(-1), abs=0.01)


def test_transition_bootstrap(spark, chosen):
    rows = {(r.from_state, r.to_state): r for r in inference.bootstrap_transition_probabilities(chosen, repeats=200).collect()}
    assert len(rows) == 9 and rows[D, M]["count"] == 1 and rows[D, D].probability == 0.5
    assert rows[N, D].probability is None and rows[N, D].valid_bootstrap_draws == 0
    assert 0 <= rows[D, D].ci_2_5 <= rows[D, D].ci_97_5 <= 1
    assert inference.bootstrap_transition_probabilities(chosen.where("false"), repeats=3).count() == 0


def test_permutation_keeps_request_places(chosen):
    same = {(r.from_state, r.to_state): r for r in inference.permutation_transition_test(chosen, "cross_request", repeats=300).collect()}
    assert sum(r.observed_count for r in same.values()) == 2 and same[M, D].observed_count == 1 and same[D, D].observed_count == 1
    one = inference.persistence_test(chosen, "all", repeats=300).first()
    assert one.observed_self_transition_rate == pytest.approx(1 / 3)
    # of the three orders of s1 with M in the middle, first or last, one has no equal neighbours
    assert one.null_mean_self_transition_rate == pytest.approx((1 + 2 / 3) / 3, abs=0.08)


def test_pca_agrees_with_numpy(spark):
    x = np.random.default_rng(3).normal(size=(60, 3)) @ np.array([[2, 1, 0], [0, 1, 0.3], [0, 0, 0.5]])
    df = spark.createDataFrame([(f"s{i}", *map(float, r)) for i, r in enumerate(x)] + [("none", None, 1.0, 2.0)], "session_id string, a double, b double, c double")
    parts, ratio = multivariate.fit_pca(df, ["a", "b", "c"], 3)
    _, s, vt = np.linalg.svd(x - x.mean(0))
    assert np.allclose(ratio, s**2 / (s**2).sum()) and np.allclose(np.abs((parts * vt).sum(1)), 1)
    assert multivariate.component_alignment(parts, -parts[[1, 0, 2]]) == [(1, pytest.approx(1)), (0, pytest.approx(1)), (2, pytest.approx(1))]
    assert np.allclose(multivariate.subspace_cosines(parts[:2], parts[[1, 0]]), 1)
    assert multivariate.bootstrap_pca(df, ["a", "b", "c"], k=2, repeats=20).where("mean_absolute_cosine > 0.7").count() == 2


@pytest.mark.parametrize("algorithm", ["kmeans", "gmm", "ward"])
def test_clusters_of_two_clouds(spark, algorithm):
    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal(-2, 0.25, (30, 2)), rng.normal(2, 0.25, (30, 2))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "session_id long, a double, b double")
    labels, extra = multivariate.fit_labels(df, ["a", "b"], algorithm, 2, starts=1)
    truth = df.select("session_id", (F.col("session_id") >= 30).cast("int").alias("cluster"))
    assert multivariate.adjusted_rand(labels, truth) == 1.0
    quality = multivariate.cluster_quality(df, labels, ["a", "b"])
    assert quality["silhouette"] > 0.8 and quality["davies_bouldin"] < 0.3 and quality["min_cluster_size"] == 30
    assert bool(extra) == (algorithm == "gmm")


@pytest.fixture(scope="module")
def known(spark):
    """Positive rows have a high x but for noise; a missing value is filled in."""
    rng = np.random.default_rng(5)
    rows = [(f"s{i}", j, float(rng.normal(2 * ((i + j) % 2), 0.7)) if i else None, float(rng.normal()), (i + j) % 2) for i in range(40) for j in range(4)]
    return models.with_folds(spark.createDataFrame(rows, "session_id string, event_num long, x double, noise double, label int"), folds=2).cache()


def test_prediction(known):
    audit = models.split_audit(known).collect()
    assert [r.session_overlap for r in audit] == [0, 0] and sum(r.test_rows for r in audit) == 160
    oof = models.out_of_fold(known, ["x", "noise"], folds=2, iterations=5).cache()
    assert oof.count() == 4 * 160
    found = {(r.model, r.metric): r["mean"] for r in models.metric_summary(oof).collect()}
    assert found["prior_baseline", "roc_auc"] == 0.5 and found["logistic", "roc_auc"] > 0.9 and found["boosted_trees", "roc_auc"] > 0.85
    gain = models.improvement_bootstrap(oof, repeats=40).where("candidate_model = 'logistic' and metric = 'roc_auc'").first()
    assert gain.ci_2_5 > 0.2 and gain.bootstrap_p < 0.1
    drop = {r.feature: r.mean_importance for r in models.permutation_importance(known, ["x", "noise"], folds=2, repeats=2).where("metric = 'roc_auc' and fold = 0").collect()}
    assert drop["x"] > 0.2 > abs(drop["noise"])
    weights = {r.feature: r for r in models.coefficient_stability(known, ["x", "noise"], folds=2).collect()}
    assert weights["x"].direction == "positive" and weights["x"].sign_consistency == 1


def counted(df):
    """The rows as they are, and how many have been computed so far."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_predictions_compute_their_rows_once(known):
    rows, seen = counted(known)
    oof = models.out_of_fold(rows, ["x", "noise"], ("prior_baseline", "logistic", "logistic_balanced"), folds=2)
    assert models.metric_summary(oof).count() == 27
    assert seen.value == 160


def test_improvement_draws_its_weights_from_rows_computed_once(known):
    oof = models.out_of_fold(known, ["x", "noise"], ("prior_baseline", "logistic"), folds=2)
    want = models.improvement_bootstrap(oof, repeats=3).orderBy("metric").collect()
    bare, seen = counted(oof)
    assert models.bootstrap_metrics(bare, 3).count() == 2 * 4 * 9
    assert seen.value <= 2 * 320  # once for the marks of the parts, once for the rows themselves
    assert [r.metric for r in want] == sorted(models.METRICS)


def test_metrics_against_pairs(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 50), np.round(rng.random(50), 1)
    row = models.metrics_by(spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p, strict=True)], "model string, actual int, positive_probability double"), ["model"]).first()
    wins = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
    assert row.roc_auc == pytest.approx(wins) and row.accuracy == pytest.approx(((p >= 0.5) == y).mean()) and row.brier_score == pytest.approx(((p - y) ** 2).mean())


def test_exchange_keeps_values(known):
    mixed = models.exchanged(known, ["x", "noise"], 2).cache()
    assert mixed.count() == 5 * known.count()
    value = lambda df: sorted(r.noise for r in df.select("noise").collect())
    for repeat in (1, 2):
        own = mixed.where(f"feature = 'noise' and repeat = {repeat}")
        assert value(own) == value(known)
        assert own.join(known, ["session_id", "event_num", "noise"]).count() < 20
        assert own.select("session_id", "event_num", "x").exceptAll(known.select("session_id", "event_num", "x")).count() == 0


def test_request_outcomes(spark, events, tmp_path):  # noqa: F811
    rows = {r.request_id: r for r in requests.request_outcomes(events).collect()}
    assert rows["golden:request:0001"].outcome == "accept_unchanged" and rows["golden:request:0001"].selection_count == 1
    assert {rows[f"asks:request:000{i}"].outcome for i in (1, 2, 3)} == {"request_without_suggestion"}


def test_audits(spark, events, sessions):  # noqa: F811
    assert all(r.ok for r in audits.lifecycle(events, sessions).collect())
    assert all(r.ok for r in audits.selection_metrics(metrics.selection_metrics(sessions)).collect())
    assert all(r.ok for r in audits.session_metrics(metrics.session_metrics(sessions)).collect())
    bad = audits.selection_metrics(metrics.selection_metrics(sessions).withColumn("deleted_chars", F.lit(99)))
    assert {r.check for r in bad.where("not ok").collect()} == {"inserted = surviving + deleted"}
    assert {r.signature: r.events for r in audits.top_signatures(events).collect()} == {"R,I": 3, "R,D": 1}
    held = audits.frozen(spark.createDataFrame([("a", 1.0)], "k string, v double"), "k", "v", {"a": 1.0, "b": 2.0})
    assert {r.check: r.ok for r in held.collect()} == {"a": True, "b": False}


def test_command_line(spark, tmp_path, capsys):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "one.jsonl").write_text("\n".join([line(1, 5, "user", "suggestion-get"), line(2, 9, "api", "suggestion-open")]))
    assert main(["reconstruct", str(logs), "--summary"], spark) == 0
    assert "'gets': 1" in capsys.readouterr().out
    assert main(["audit", str(logs)], spark) == 0
    assert main(["export", str(logs), "--layer", "target", "--out", str(tmp_path / "out")], spark) == 0
    row = spark.read.option("header", True).csv(str(tmp_path / "out/processed/request_outcomes.csv")).first()
    assert row.outcome == "presented_no_selection" and row.request_id == "one:request:0001"

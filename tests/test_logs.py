"""Simulated logs end to end: reading, quarantine, audits, tables, manifests, figures, checks and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan import engine, figures, sinks
from quillspan.__main__ import main
from quillspan.functions import exprs
from quillspan.operators import audits, features, indicators, lifecycle, metrics, release, requests
from quillspan.sources import jsonl, tables

from . import logs


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("sessions")
    return out, logs.write(out, 40)


@pytest.fixture(scope="module")
def events(spark, folder):
    return engine.load(spark, str(folder[0])).cache()


@pytest.fixture(scope="module")
def sessions(events):
    return metrics.replayed(events).cache()


def test_replay_gives_the_text(sessions, folder):
    assert {r.session_id: r.final_text for r in sessions.collect()} == folder[1]


@pytest.mark.parametrize("name", engine.AUDITS)
def test_audits_hold(events, name):
    rows = engine.audit(events, name).collect()
    assert rows and all(r["ok"] for r in rows if "ok" in r)


def test_provenance_audit_finds_faults(spark, events, sessions):
    """An api insertion that belongs to no selection, and a replay with anomalies."""
    alone = events.where("session_id = 's001'").limit(1).withColumns({"event_name": F.lit("text-insert"), "source": F.lit("api"), "event_num": F.lit(99_999).cast("long"), "ops_json": F.lit('[{"retain":100000},{"insert":"zz"}]')})
    both = events.unionByName(alone)
    broken = {r.check for r in audits.provenance(both, metrics.replayed(both)).collect() if not r.ok}
    assert broken == {"api insertion without selection", "characters of api insertions are those of selections", "no anomalies"}
    assert [(r.kind, r.anomalies) for r in audits.anomalies(metrics.replayed(both)).collect()] == [("retain past the end", 1)]
    assert audits.deleted_by_origin(sessions).where("origin = 'ai'").first().deleted_chars > 0


def test_signatures(spark):
    cases = {
        '[{"retain":1},{"insert":"x"}]': "R,I",
        '[{"retain":1,"insert":"x","attributes":{}}]': "RIA",
        '[{"delete":1,"what":2}]': "DO",
        '[{}, 7, "a"]': "?,<bigint>,<string>",
        "null": "",
        '{"a":1}': "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "ops_json string")
    assert {r.ops_json: r.s for r in df.select("ops_json", audits.signature().alias("s")).collect()} == cases


def test_delta_tables(events):
    found = audits.delta_tables(events)
    assert {r.signature for r in found["signatures"].collect()} >= {"R,I", "R,D"}
    assert {(r.key, r.type) for r in found["value_types"].collect()} == {("retain", "bigint"), ("insert", "string"), ("delete", "bigint")}
    assert found["unusual"].count() == 0 and found["signatures_by_event"].count() >= 2 and found["examples"].count() >= 2 and found["operation_keys"].count() == 3


def test_lifecycle_projections(events):
    episodes, selections = lifecycle.episodes(events), lifecycle.selections(events)
    assert episodes.count() == events.where("event_name = 'suggestion-get'").count()
    assert selections.where("was_inserted and insert_end - insert_start = length(inserted_text) and selected_text = inserted_text").count() == selections.count() == events.where("event_name = 'suggestion-select'").count()
    totals = audits.lifecycle_totals(events, metrics.replayed(events)).first()
    assert totals.most_selections == 2 and totals.multi_selection_episodes > 0 and totals.reopens_taken == totals.reopens


def test_request_outcomes_cover_all(events):
    found = {r.outcome: r["count"] for r in requests.request_outcomes(events).groupBy("outcome").count().collect()}
    assert set(found) == {"accept_unchanged", "non_adoption", "presented_no_selection", "request_without_suggestion"}


def test_episode_indicators(spark, tmp_path):
    """By hand: two shown requests, one dismissed, edits and answers after each open."""
    line = lambda n, t, name, source, **more: json.dumps({"eventNum": n, "eventName": name, "eventSource": source, "eventTimestamp": t, **more})
    typed = {"textDelta": {"ops": [{"insert": "x"}]}}
    events = [
        line(0, 0, "suggestion-get", "user"), line(1, 1000, "suggestion-open", "api"), line(2, 3000, "suggestion-close", "user"), line(3, 5000, "text-insert", "user", **typed), line(4, 31_000, "text-insert", "user", **typed),
        line(5, 31_001, "text-insert", "user", **typed), line(6, 50_000, "suggestion-get", "user"), line(7, 50_500, "suggestion-open", "api"), line(8, 51_500, "text-insert", "user", **typed), line(9, 200_000, "suggestion-get", "user"),
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(events))
    loaded = engine.load(spark, str(tmp_path))
    row = indicators.episode_indicators(loaded, requests.request_outcomes(loaded), metrics.session_metrics(metrics.replayed(loaded))).first()
    assert (row.non_adoption, row.post_ai_editing, row.reconsultation, row.response_latency, row.transition_entropy) == (0.5, 1.5, 0.5, 1.5, 0.0)


def test_modified_outcome(spark, tmp_path):
    """What is inserted differs from the candidate shown at the place of the hover index; a close by the user without a selection."""
    line = lambda n, name, source, **more: json.dumps({"eventNum": n, "eventName": name, "eventSource": source, "eventTimestamp": n, **more})
    shown = [{"index": 7, "original": "alpha"}, {"index": 3, "original": "beta"}]
    events = [
        line(0, "suggestion-get", "user"), line(1, "suggestion-open", "api", currentSuggestions=shown), line(2, "suggestion-select", "user", currentHoverIndex=1), line(3, "text-insert", "api", textDelta={"ops": [{"insert": "  "}]}),
        line(4, "text-insert", "api", textDelta={"ops": [{"insert": " beta! "}]}), line(5, "suggestion-get", "user"), line(6, "suggestion-open", "api", currentSuggestions=shown), line(7, "suggestion-close", "user"),
        line(8, "suggestion-get", "user"), line(9, "suggestion-open", "api", currentSuggestions=shown), line(10, "suggestion-select", "user", currentHoverIndex=1), line(11, "text-insert", "api", textDelta={"ops": [{"insert": " beta "}]}),
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(events))
    found = requests.request_outcomes(engine.load(spark, str(tmp_path))).orderBy("request_event_num").collect()
    assert [r.outcome for r in found] == ["accepted_modified", "non_adoption", "accept_unchanged"]


def test_blank_lines_and_quarantine(spark, tmp_path, capsys):
    good = json.dumps({"eventNum": 1, "eventName": "suggestion-get", "eventTimestamp": 5})
    (tmp_path / "good.jsonl").write_text(f"\t\n{good}\n \t \n\n")
    assert engine.load(spark, str(tmp_path)).count() == 1
    (tmp_path / "bad.jsonl").write_text(f"{good}\n\n{{broken\n{good}\n")
    with pytest.raises(Exception, match="invalid JSON"):
        engine.load(spark, str(tmp_path)).collect()
    (tmp_path / "short.jsonl").write_text(good.replace("eventNum", "num") + "\n")
    bad = sorted((r.path.rsplit("/", 1)[1], r.line, r.error) for r in jsonl.bad_lines(spark, str(tmp_path)).collect())
    assert bad == [("bad.jsonl", 3, "invalid JSON"), ("short.jsonl", 1, "eventNum is missing")]
    assert main(["reconstruct", str(tmp_path), "--summary"], spark) == 1
    said = capsys.readouterr().out
    assert "'sessions': 1" in said and "bad.jsonl:3: invalid JSON" in said
    with pytest.raises(FileNotFoundError):
        engine.load(spark, str(tmp_path), "*.json")


def test_line_orders_equal_events(spark, tmp_path):
    """Equal numbers and times keep the order of the log."""
    line = lambda piece: json.dumps({"eventNum": 1, "eventName": "text-insert", "eventSource": "user", "eventTimestamp": 5, "textDelta": {"ops": [{"insert": piece}]}})
    (tmp_path / "a.jsonl").write_text("\n".join(line(x) for x in "abcdefgh"))
    assert metrics.replayed(engine.load(spark, str(tmp_path)).repartition(5)).first().final_text == "hgfedcba"


def test_spellings(spark):
    words = ["Accept-Unchanged", " direct adoption ", "accepted_unchanged", "accepted modified", "accept_modified", "MODIFIED_ADOPTION", "non-adoption", "no selection", "presented_no_selection", "no_suggestion", "request_without_presented_suggestion", "request without suggestion"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(exprs.normalized_outcome("w")).collect()]
    assert got == ["accept_unchanged"] * 3 + ["accepted_modified"] * 3 + ["non_adoption"] + ["presented_no_selection"] * 2 + ["request_without_suggestion"] * 3
    with pytest.raises(Exception, match="unknown request outcome"):
        spark.createDataFrame([("other",)], "w string").select(exprs.normalized_outcome("w")).collect()


def test_numbers_of_text(spark):
    words = [" 1.5 ", "", "None", "nan", "N/A", "inf", None, "-2e3", "7"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(exprs.optional_double("w")).collect()] == [1.5, None, None, None, None, None, None, -2000.0, 7.0]
    assert [r[0] for r in df.where("w <> 'N/A' or w is null").select(exprs.optional_int("w")).collect()] == [1, None, None, None, None, None, -2000, 7]


def test_insertion_span(spark):
    cases = {
        '[{"retain":272},{"insert":"ab"}]': ("ab", 272, 274),
        '[{"insert":"x"},{"delete":3},{"retain":2},{"insert":"yz"}]': ("xyz", 0, 3),
        '[{"retain":-4},{"insert":{"image":1}},{"insert":"q"}]': ("q", 0, 1),
        '[{"delete":2}]': None,
        "7": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "ops_json string")
    assert {r.ops_json: r.p and tuple(r.p) for r in df.select("ops_json", requests.insertion().alias("p")).collect()} == cases


@pytest.mark.parametrize(
    ("rows", "error"),
    [
        ("session_id,outcome\na,direct-adoption\nb,no selection\n", None),
        ("session_id\na\n", "lacks outcome"),
        ("session_id,outcome\n", "is empty"),
        ("session_id,outcome\na,what\n", "unknown request outcome"),
        ("session_id,outcome\n,non_adoption\n", "session_id is missing"),
    ],
)
def test_checked_outcomes(spark, tmp_path, rows, error):
    (tmp_path / "t.csv").write_text(rows)
    if error:
        with pytest.raises(Exception, match=error):
            tables.read_table(spark, str(tmp_path / "t.csv"), "request_outcomes").collect()
    else:
        assert [r.outcome for r in tables.read_table(spark, str(tmp_path / "t.csv"), "request_outcomes").collect()] == ["accept_unchanged", "presented_no_selection"]


def test_checked_ranges_and_keys(spark):
    names = ["session_id", "ai_contribution", *tables.INDICATORS]
    row = lambda i, share: (i, share, *["" for _ in tables.INDICATORS])
    df = lambda rows: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    contract = tables.CONTRACTS["behavior_metrics"]
    assert tables.checked(df([row("a", "0.5"), row("b", "1")]), contract, "t").count() == 2
    for rows, error in (([row("a", "1.5")], "outside"), ([row("a", "nan")], "ai_contribution is missing"), ([row("a", "1"), row("a", "0")], "repeats a")):
        with pytest.raises(Exception, match=error):
            tables.checked(df(rows), contract, "t").collect()


@pytest.fixture(scope="module")
def reproduced(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    assert main(["reproduce", str(folder[0]), "--out", str(out)], spark) == 0
    return out


def test_reproduced_tables(spark, reproduced, folder):
    read = lambda path: spark.read.option("header", True).option("inferSchema", True).csv(str(reproduced / path))
    sessions = read("processed/session_metrics.csv")
    assert [r.session_id for r in sessions.select("session_id").collect()] == sorted(folder[1])
    table = read("processed/ml_session_features.csv")
    assert len(table.columns) == 18 and table.count() == 40
    first = table.where("session_id = 's000'").first()
    assert first.selections_per_request is None and first.behavioral_complete == 0
    manifest = sinks.read_json(spark, str(reproduced / "analysis/ml_session_features_manifest.json"))
    assert manifest["rows"] == 40 and manifest["behavioral_complete_rows"] == table.agg(F.sum("behavioral_complete")).first()[0]
    scaled = read("analysis/primary_cluster_scaled.csv")
    assert sinks.read_json(spark, str(reproduced / "analysis/primary_cluster_manifest.json"))["included_sessions"] == scaled.count() > 0
    labels = list(exprs.INDICATOR_LABELS)
    square = tables.read_square(spark, str(reproduced / "analysis/target_behavior_correlation_matrix.csv"), labels)
    assert square.count() == 10
    with pytest.raises(ValueError, match="does not name"):
        tables.read_square(spark, str(reproduced / "analysis/target_behavior_correlation_matrix.csv"), labels[::-1])
    bars = read("figures/ai_share_response_outcomes.csv").groupBy("group").agg(F.sum("percent").alias("p")).collect()
    assert len(bars) == 3 and all(abs(r.p - 100) < 1e-6 for r in bars)
    assert read("figures/trace_indicator_correlations.csv").count() == 100


def test_figures_refuse_wrong_shares(spark):
    names = [short for short, _ in engine.grouping.SHORT.values()]
    rows = [(g, *[0.2] * 4, 0.2 if g != "High" else 0.1) for g in ("Low", "Moderate", "High")]
    with pytest.raises(ValueError, match="add up"):
        figures.outcome_shares(spark.createDataFrame(rows, "group string, " + ", ".join(f"{n}_share double" for n in names)))
    with pytest.raises(ValueError, match="groups are"):
        figures.outcome_shares(spark.createDataFrame(rows[:2], "group string, " + ", ".join(f"{n}_share double" for n in names)))


def test_empty_tables_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="has no rows"):
        sinks.write_csv({"t": spark.createDataFrame([], "a int")}, str(tmp_path))


def test_release_checks(spark, events):
    """The frozen counts of these logs hold, and a wrong one is found."""
    made = {}
    for layer in engine.LAYERS:
        made |= {n: d.cache() for n, d in engine.export(events, layer).items()}
    made |= engine.analyze(made["selection_metrics"], made["session_metrics"], made["target_behavior_metrics"], made["request_outcomes"])
    selections, cells = made["selection_metrics"], made["transition_matrix_cross_request"].collect()
    tally = lambda df, c: {r[c]: r["count"] for r in df.groupBy(c).count().collect()}
    groups = {r["group"]: {short: r[f"{short}_count"] for short, _ in engine.grouping.SHORT.values()} for r in made["target_outcomes_by_ai_share"].collect()}
    expected = {
        "sessions": 40, "selections": selections.count(), "requests": made["request_outcomes"].count(), "adoption": tally(selections, "adoption_outcome"), "outcomes": tally(made["request_outcomes"], "outcome"), "group_outcomes": groups,
        "cross_transitions": {a: {r.to_state: r["count"] for r in cells if r.from_state == a} for a in exprs.STATES}, "all_transitions": made["transition_matrix_all"].agg(F.sum("count")).first()[0], "endpoint_sessions": made["endpoint_matrix"].first().eligible_sessions,
    }
    made["sessions"] = made["session_metrics"].select("session_id")
    for name in ("raw", "metrics", "target", "analysis", "features", "temporal"):
        assert [r for r in release.check(name, made, expected).collect() if not r.ok] == [], name
    wrong = [r for r in release.check("metrics", made, expected | {"selections": 7}).collect() if not r.ok]
    assert [r.check for r in wrong] == ["selection metric rows"]
    with pytest.raises(KeyError, match="model_metrics"):
        release.check("prediction", made, expected)


def test_prediction_tables(spark, events):
    selections = metrics.selection_metrics(metrics.replayed(events)).cache()
    found = engine.analyze_prediction(selections, ("prior_baseline", "logistic"), folds=2, repeats=40, shuffles=2, iterations=2)
    assert len(found) == 12
    assert found["oof_predictions"].count() == 2 * selections.count()
    assert found["grouped_cv_audit"].agg(F.sum("session_overlap")).first()[0] == 0
    sums = found["oof_predictions"].select((F.col("p_direct_adoption") + F.col("p_modified_adoption") + F.col("p_non_adoption")).alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-9 for r in sums)
    gains = found["model_improvement_bootstrap"].collect()
    assert {(r.task, r.metric) for r in gains} == {(t, m) for t in features.TASKS for m in engine.models.METRICS}
    assert all(r.valid_bootstrap_draws <= 40 and (r.ci_2_5 is None or r.ci_2_5 <= r.ci_97_5) for r in gains)
    assert {r.metric for r in found["model_metrics"].collect()} == set(engine.models.CLASS_METRICS)

"""Selection and session metrics of a golden session, and of sessions with little in them."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.operators import indicators, metrics
from quillspan.sources.jsonl import read_sessions


def line(num, ts, source, name, ops=None, **more):
    return json.dumps({"eventNum": num, "eventTimestamp": ts, "eventSource": source, "eventName": name, "textDelta": {"ops": ops} if ops else "", **more})


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    golden = [
        line(0, 1000, "system", "system-initialize", currentDoc="ABCD"),
        line(1, 2000, "user", "text-insert", [{"retain": 4}, {"insert": "hello "}]),
        line(2, 3000, "user", "suggestion-get"),
        line(3, 3500, "api", "suggestion-open", currentSuggestions=[{"index": 0, "original": "foo"}, {"index": 1, "original": "bar baz"}]),
        line(4, 5000, "user", "suggestion-select", currentHoverIndex=1),
        line(5, 5001, "api", "suggestion-close"),
        line(6, 5002, "api", "text-insert", [{"retain": 10}, {"insert": "bar baz"}]),
        line(7, 6000, "user", "text-insert", [{"retain": 13}, {"insert": "X"}]),
        line(8, 7000, "user", "text-delete", [{"retain": 16}, {"delete": 1}]),
    ]
    (folder / "golden.jsonl").write_text("\n".join(golden) + "\n")
    (folder / "still.jsonl").write_text(line(1, 5, "user", "cursor-forward") + "\n")
    requests = [line(n, t, "user", "suggestion-get") for n, t in enumerate((0, 10, 40))]
    (folder / "asks.jsonl").write_text("\n".join(requests) + "\n")
    events = read_sessions(spark, str(folder))
    return events.withColumn("ops_json", metrics.ops_of(events["text_delta"]))


@pytest.fixture(scope="module")
def sessions(events):
    return metrics.replayed(events).cache()


def test_selection_metrics(sessions):
    (row,) = [r.asDict() for r in metrics.selection_metrics(sessions).collect()]
    assert row == {
        "session_id": "golden", "request_id": "golden:request:0001", "selection_id": "golden:request:0001:selection:01", "request_event_num": 2, "selection_event_num": 4, "insert_event_num": 6,
        "selected_index": 1, "inserted_chars": 7, "surviving_chars": 6, "deleted_chars": 1, "retention_ratio": 6 / 7, "deletion_ratio": 1 / 7, "final_span_start": 10, "final_span_end": 17,
        "final_span_units": 7, "intervening_units": 1, "survives_contiguously": False, "adoption_outcome": "modified_adoption", "request_to_selection_ms": 2000, "open_to_selection_ms": 1500,
    }


def test_session_metrics(sessions):
    out = metrics.session_metrics(sessions)
    assert len(out.columns) == 37
    rows = {r.session_id: r for r in out.collect()}
    g = rows["golden"]
    assert (g.final_text_chars, g.final_ai_chars, g.final_human_chars, g.final_system_chars, g.final_other_chars, g.authored_text_chars) == (17, 6, 7, 4, 0, 13)
    assert (g.ai_share, g.document_ai_share, g.human_generation_before_ai_ratio) == (6 / 13, 6 / 17, 6 / 7)
    assert g.consultation_density_per_1000_authored_chars == pytest.approx(1000 / 13)
    assert (g.session_duration_ms, g.consultation_burstiness, g.dismissed_episodes, g.modified_adoptions, g.modified_adoption_share) == (6000, None, 0, 1, 1.0)
    assert (g.median_request_to_selection_ms, g.mean_request_to_selection_ms, g.median_open_to_selection_ms) == (2000.0, 2000.0, 1500.0)
    s = rows["still"]
    assert (s.final_text_chars, s.ai_share, s.selection_rate, s.session_duration_ms, s.median_open_to_selection_ms) == (0, 0.0, 0.0, None, None)
    a = rows["asks"]
    assert (a.suggestion_requests, a.suggestion_opens, a.selection_rate) == (3, 0, 0.0)
    assert a.consultation_burstiness == pytest.approx((10 - 20) / (10 + 20))


def test_target_behavior_metrics(events):
    rows = {r.session_id: r.asDict() for r in indicators.target_behavior_metrics(indicators.historical_sessions(events)).collect()}
    assert rows["golden"] == {
        "session_id": "golden", "human_generation_before_ai": 6.0, "consultation_density": 10.0, "ai_contribution": 0.5, "ai_retention": 6 / 7, "non_adoption": 0.0,
        "post_ai_editing": 2.0, "reconsultation": None, "response_latency": 1.5, "transition_entropy": None, "consultation_burstiness": None,
    }
    assert rows["still"]["ai_contribution"] == rows["still"]["non_adoption"] == 0.0 and rows["still"]["consultation_density"] is None
    assert rows["asks"]["reconsultation"] == 1.0 and rows["asks"]["consultation_burstiness"] == pytest.approx((10 - 20) / (10 + 20))


def test_transition_entropy(spark):
    got = [r[0] for r in spark.createDataFrame([(["a", "b", "a", "b", "b"],), (["a", "a", "a"],), (["a"],), ([],)], "s array<string>").select(indicators.transition_entropy(F.col("s"))).collect()]
    # pairs ab, ba, ab, bb
    assert got == [pytest.approx(1.5 / 1.584962500721156), 0.0, None, None]

"""Golden sessions of the replay kernels."""

import random

from quillspan.operators import lifecycle, provenance


def ev(num, ts, source, name, **more):
    return {"event_num": num, "timestamp_ms": ts, "source": source, "event_name": name, **more}


def test_modified_adoption():
    events = [
        ev(0, 1000, "system", "system-initialize", current_doc="ABCD"),
        ev(1, 2000, "user", "text-insert", ops=[{"retain": 4}, {"insert": "hello "}]),
        ev(2, 3000, "user", "suggestion-get"),
        ev(3, 3500, "api", "suggestion-open", candidates=[{"index": 0, "trimmed": "foo"}, {"index": 1, "trimmed": "bar baz"}]),
        ev(4, 5000, "user", "suggestion-select", hover_index=1),
        ev(5, 5001, "api", "suggestion-close"),
        ev(6, 5002, "api", "text-insert", ops=[{"retain": 10}, {"insert": "bar baz"}], inserted_text="bar baz"),
        ev(7, 6000, "user", "text-insert", ops=[{"retain": 13}, {"insert": "X"}]),
        ev(8, 7000, "user", "text-delete", ops=[{"retain": 16}, {"delete": 1}]),
    ]
    episodes, selections = lifecycle.replay("s", events)
    assert len(episodes) == 1 and not episodes[0]["was_dismissed"]
    (s,) = selections
    assert s["selected_text"] == "bar baz" and s["insert_event_num"] == 6
    assert (s["request_to_selection_ms"], s["open_to_selection_ms"]) == (2000, 1500)
    doc = provenance.replay_document(events, {6: s["selection_id"]})
    assert doc.survivors(s["selection_id"]) == {"inserted_chars": 7, "surviving_chars": 6, "deleted_chars": 1, "final_span_start": 10, "final_span_end": 17, "final_span_units": 7, "intervening_units": 1, "survives_contiguously": False}
    assert (doc.chars(), doc.chars(lambda x: x[0] == "human"), doc.chars(lambda x: x[0] == "system")) == (17, 7, 4)


def test_overlap_and_reopen():
    names = ["get", "get", "open", "close", "open", "select", "close", None, "reopen", "select", None]
    order = [ev(1, 1, "user", "suggestion-get"), ev(2, 2, "api", "suggestion-open"), ev(3, 3, "user", "suggestion-get"), ev(4, 4, "user", "suggestion-close"), ev(5, 5, "api", "suggestion-open"), ev(6, 6, "user", "suggestion-select"), ev(7, 7, "api", "suggestion-close"), ev(8, 8, "api", "text-insert"), ev(9, 9, "user", "suggestion-reopen"), ev(10, 10, "user", "suggestion-select"), ev(11, 11, "api", "text-insert")]
    assert len(names) == len(order)
    episodes, selections = lifecycle.replay("s", order)
    assert episodes[0]["was_dismissed"] and episodes[0]["open_event_num"] == 2
    assert episodes[1]["reopens"] == 1
    assert [(s["selection_id"][-2:], s["selection_event_num"], s["insert_event_num"]) for s in selections] == [("01", 6, 8), ("02", 10, 11)]


def test_orphan_reopen_and_second_open():
    assert lifecycle.replay("s", [ev(1, 1, "user", "suggestion-reopen")]) == ([], [])
    episodes, _ = lifecycle.replay("s", [ev(1, 1, "user", "suggestion-get"), ev(2, 2, "api", "suggestion-open"), ev(3, 3, "api", "suggestion-open")])
    assert [e["open_event_num"] for e in episodes] == [3]


def replayed(doc, ops):
    return provenance.replay_document([ev(0, 0, "system", "system-initialize", current_doc=doc), ev(1, 1, "user", "text-insert", ops=ops)], {})


def test_delta_anomalies():
    out = replayed("abc", [{"retain": 10}, {"insert": "z"}])
    assert "".join(s[4] for s in out.spans) == "abcz" and out.anomalies == ["retain past the end"]
    out = replayed("abc", [{"delete": 9}])
    assert out.length == 0 and out.anomalies == ["delete past the end"]
    out = replayed("abc", [{"retain": "1", "insert": "q"}])
    assert out.chars() == 3 and out.anomalies == ["bad retain"]
    out = replayed("abc", [{"insert": {"image": "u"}}])
    assert (out.length, out.chars()) == (4, 3)


def test_spans_agree_with_characters():
    rng = random.Random(3)
    for _ in range(300):
        chars = list("hello world")
        events = [ev(0, 0, "system", "system-initialize", current_doc="hello world")]
        for n in range(1, 15):
            at, cut = rng.randrange(0, len(chars) + 3), rng.randrange(0, 4)
            text = "xyz"[: rng.randrange(0, 4)]
            events.append(ev(n, n, "user", "text-insert", ops=[{"retain": at}, {"insert": text}, {"delete": cut}]))
            at = min(at, len(chars))
            chars[at:at] = text
            del chars[at + len(text) : at + len(text) + cut]
        assert "".join(s[4] for s in provenance.replay_document(events, {}).spans) == "".join(chars)


def test_read_sessions(spark, tmp_path):
    from quillspan.sources.jsonl import read_sessions

    (tmp_path / "one.jsonl").write_text('{"eventNum": "3", "eventName": "suggestion-open", "eventTimestamp": 5, "eventSource": "API", "currentSuggestions": [{"index": 4, "original": " hi "}, 7], "textDelta": "", "currentDoc": ""}\n')
    (row,) = read_sessions(spark, str(tmp_path)).drop("text_delta", "cursor_range").collect()
    assert (row.session_id, row.event_num, row.source, row.current_doc) == ("one", 3, "api", None)
    assert [(c["index"], c["trimmed"]) for c in row.candidates] == [(4, "hi")]

"""Selection and session metrics: one replay per session, then column expressions over its results."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import STATES, adoption, safe_ratio
from . import lifecycle, provenance
from .sessions import over_sessions

LONGS = lambda names: [(n, pa.int64()) for n in names.split()]
EPISODE = pa.struct([("request_id", pa.string()), *LONGS("request_event_num request_ts open_event_num selections reopens"), ("was_dismissed", pa.bool_())])
SELECTION = pa.struct(
    [("request_id", pa.string()), ("selection_id", pa.string())]
    + LONGS("request_event_num selection_event_num insert_event_num selected_index inserted_chars surviving_chars deleted_chars final_span_start final_span_end final_span_units intervening_units")
    + [("survives_contiguously", pa.bool_()), *LONGS("request_to_selection_ms open_to_selection_ms")]
)
REPLAYED = pa.schema(
    [("session_id", pa.string()), *LONGS("final_text_chars final_ai_chars final_human_chars final_system_chars human_inserted_chars human_chars_before_first_ai session_duration_ms anomalies")]
    + [("anomaly_kinds", pa.list_(pa.string())), ("deleted_by_origin", pa.map_(pa.string(), pa.int64())), ("final_text", pa.string())]
    + [("episodes", pa.list_(EPISODE)), ("selections", pa.list_(SELECTION))]
)


def ops_of(text_delta: Column) -> Column:
    """The operations of a delta variant as JSON text; null where it has none."""
    return F.to_json(F.try_variant_get(text_delta, "$.ops", "variant"))


def inserted_text(ops: Any) -> str | None:
    """The string insertions of a delta joined; null if there are none."""
    pieces = [o["insert"] for o in ops if isinstance(o, dict) and isinstance(o.get("insert"), str)] if isinstance(ops, list) else []
    return "".join(pieces) if pieces else None


def replay_session(session_id: str, events: list[dict[str, Any]]) -> dict[str, Any]:
    """Lifecycle and provenance of one session; events in order of (event_num, timestamp_ms), deltas in ops_json."""
    for e in events:
        e["ops"] = json.loads(e["ops_json"]) if e.get("ops_json") else None
        e["inserted_text"] = inserted_text(e["ops"])
    episodes, selections = lifecycle.replay(session_id, events)
    doc = provenance.replay_document(events, {s["insert_event_num"]: s["selection_id"] for s in selections if s["insert_event_num"] is not None})
    human = [(e["event_num"], len(e["inserted_text"] or "")) for e in events if e["event_name"] == "text-insert" and e["source"] == "user"]
    first = min((s["insert_event_num"] for s in selections if s["insert_event_num"] is not None), default=None)
    stamps = [e["timestamp_ms"] for e in events]
    return {
        "session_id": session_id,
        "final_text_chars": doc.chars(),
        "final_ai_chars": doc.chars(lambda s: s[1] is not None),
        "final_human_chars": doc.chars(lambda s: s[1] is None and s[0] == "human"),
        "final_system_chars": doc.chars(lambda s: s[1] is None and s[0] == "system"),
        "human_inserted_chars": sum(n for _, n in human),
        "human_chars_before_first_ai": sum(n for num, n in human if first is None or num < first),
        "session_duration_ms": max(stamps) - min(stamps) if len(stamps) > 1 else None,
        "anomalies": len(doc.anomalies),
        "anomaly_kinds": doc.anomalies,
        "deleted_by_origin": list(doc.deleted.items()),
        "final_text": "".join(s[4] for s in doc.spans if not s[2]),
        "episodes": episodes,
        "selections": [s | doc.survivors(s["selection_id"]) for s in selections],
    }


def replayed(events: DataFrame) -> DataFrame:
    """A row per session: its episodes, its selections with what became of their text, the final composition and text,
    characters deleted by origin (a selection's id, or human, system and the like) and the anomalies.

    events: session_id, event_num, timestamp_ms, event_name, source, ops_json and, if at hand, current_doc, candidates,
    hover_index, suggestion_index. One shuffle by session; deltas of other than text events are not sent.
    """
    have = set(events.columns)
    further = [c for c in ("current_doc", "candidates", "hover_index", "suggestion_index") if c in have]
    ops = F.when(F.col("event_name").isin("text-insert", "text-delete"), F.col("ops_json")).alias("ops_json")
    return over_sessions(events, ["event_num", "timestamp_ms", "event_name", "source", ops, *further], replay_session, REPLAYED)


def selection_metrics(sessions: DataFrame) -> DataFrame:
    """The 20 columns of every selection, from `replayed`."""
    s = sessions.select("session_id", F.inline("selections"))
    return s.select(
        "session_id", "request_id", "selection_id", "request_event_num", "selection_event_num", "insert_event_num", "selected_index", "inserted_chars", "surviving_chars", "deleted_chars",
        safe_ratio("surviving_chars", "inserted_chars").alias("retention_ratio"), safe_ratio("deleted_chars", "inserted_chars").alias("deletion_ratio"),
        "final_span_start", "final_span_end", "final_span_units", "intervening_units", "survives_contiguously",
        adoption("inserted_chars", "surviving_chars", "survives_contiguously").alias("adoption_outcome"), "request_to_selection_ms", "open_to_selection_ms",
    )


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _how_many(array: str, rule: Any) -> Column:
    return F.size(F.filter(array, lambda x: F.coalesce(rule(x), F.lit(False)))).cast("bigint")


def _median(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(sorted_values, low) + F.get(sorted_values, high)) / 2)


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def burstiness(stamps: Column) -> Column:
    """(sigma - mean) / (sigma + mean) of the gaps between sorted stamps; null under three stamps, 0 if all gaps are 0."""
    ordered = F.array_sort(stamps)
    gaps = F.zip_with(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))), lambda b, a: (b - a).cast("double"))
    mean = _mean(gaps)
    sigma = F.sqrt(_mean(F.transform(gaps, lambda g: (g - mean) * (g - mean))))
    return F.when(F.size(gaps) >= 2, F.when(sigma + mean == 0, 0.0).otherwise((sigma - mean) / (sigma + mean)))


def session_metrics(sessions: DataFrame) -> DataFrame:
    """The 37 columns of every session, from `replayed`: expressions over its arrays, no further shuffle."""
    outcome = lambda s: adoption(s["inserted_chars"], s["surviving_chars"], s["survives_contiguously"])
    summed = lambda field: _total(F.transform("selections", lambda s: s[field]))
    latencies = lambda field: F.array_sort(F.filter(F.transform("selections", lambda s: s[field]), lambda x: x >= 0))
    counted = sessions.select(
        "*", (F.col("final_ai_chars") + F.col("final_human_chars")).alias("authored_text_chars"),
        (F.col("final_text_chars") - F.col("final_ai_chars") - F.col("final_human_chars") - F.col("final_system_chars")).alias("final_other_chars"),
        summed("inserted_chars").alias("ai_inserted_chars"), summed("surviving_chars").alias("ai_surviving_chars"), summed("deleted_chars").alias("ai_deleted_chars"),
        F.size("episodes").cast("bigint").alias("suggestion_requests"), _how_many("episodes", lambda e: e["open_event_num"].isNotNull()).alias("suggestion_opens"),
        _total(F.transform("episodes", lambda e: e["reopens"])).alias("suggestion_reopens"), F.size("selections").cast("bigint").alias("suggestion_selections"),
        _how_many("selections", lambda s: s["insert_event_num"].isNotNull()).alias("suggestion_insertions"), _how_many("episodes", lambda e: e["was_dismissed"]).alias("dismissed_episodes"),
        _how_many("episodes", lambda e: e["selections"] > 1).alias("multi_selection_episodes"),
        *[_how_many("selections", lambda s, state=state: outcome(s) == state).alias(name) for state, name in zip(STATES, ("direct_adoptions", "modified_adoptions", "non_adoptions"), strict=True)],
        latencies("request_to_selection_ms").alias("from_request"), latencies("open_to_selection_ms").alias("from_open"),
    )
    return counted.select(
        "session_id", "final_text_chars", "final_ai_chars", "final_human_chars", "final_system_chars", "final_other_chars", "authored_text_chars",
        safe_ratio("final_ai_chars", "authored_text_chars").alias("ai_share"), safe_ratio("final_ai_chars", "final_text_chars").alias("document_ai_share"),
        "ai_inserted_chars", "ai_surviving_chars", "ai_deleted_chars",
        safe_ratio("ai_surviving_chars", "ai_inserted_chars").alias("ai_retention_ratio"), safe_ratio("ai_deleted_chars", "ai_inserted_chars").alias("ai_deletion_ratio"),
        "suggestion_requests", "suggestion_opens", "suggestion_reopens", "suggestion_selections", "suggestion_insertions", "dismissed_episodes", "multi_selection_episodes",
        safe_ratio("suggestion_selections", "suggestion_requests").alias("selection_rate"), "direct_adoptions", "modified_adoptions", "non_adoptions",
        *[safe_ratio(f"{k}s", "suggestion_selections").alias(f"{k}_share") for k in ("direct_adoption", "modified_adoption", "non_adoption")],
        "human_inserted_chars", "human_chars_before_first_ai", safe_ratio("human_chars_before_first_ai", "human_inserted_chars").alias("human_generation_before_ai_ratio"),
        (safe_ratio("suggestion_requests", "authored_text_chars") * 1000.0).alias("consultation_density_per_1000_authored_chars"),
        _median(F.col("from_request")).alias("median_request_to_selection_ms"), _median(F.col("from_open")).alias("median_open_to_selection_ms"),
        _mean(F.col("from_request")).alias("mean_request_to_selection_ms"), burstiness(F.transform("episodes", lambda e: e["request_ts"])).alias("consultation_burstiness"), "session_duration_ms",
    )

"""The ten historical session indicators: request windows and interval retention of one session at a time, then expressions.

These rules are those of the historical path and differ from the session metrics on purpose: no clamping of
deltas, null (never 0) where most denominators are missing, windows from request to request.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import POST_MS, PRE_MS, RECONSULT_MS, response_use
from .lifecycle import replay
from .metrics import _mean, _median, inserted_text
from .sessions import over_sessions

#: What counts as an answer of the user to a shown suggestion (fixed values).
ANSWERS = frozenset(("suggestion-select", "suggestion-close", "text-insert", "text-delete", "cursor-forward", "cursor-backward"))
EDITS = ("text-insert", "text-delete")

EPISODE = pa.struct(
    [(n, pa.int64()) for n in ("request_event_num", "request_ts", "open_ts", "select_event_num", "insert_event_num", "ai_chars", "pre_generation", "post_edits")]
    + [("retention", pa.float64()), ("latency_s", pa.float64())]
)
SESSION = pa.schema([("session_id", pa.string()), ("human_chars", pa.int64()), ("duration_s", pa.float64()), ("episodes", pa.list_(EPISODE))])


def retained(events: list[dict[str, Any]], owner: dict[int, int]) -> dict[int, int]:
    """Characters left at the end of each insertion in owner (event_num -> number of its episode)."""
    spans: list[tuple[int, int, int]] = []  # start, end, episode
    for event in events:
        mine, cursor = owner.get(event["event_num"]), 0
        for op in event["ops"] or ():
            if not isinstance(op, dict):
                continue
            cursor += int(op.get("retain") or 0)
            piece = op.get("insert")
            if isinstance(piece, str):
                n, moved = len(piece), []
                for a, b, k in spans:
                    if a < cursor < b:
                        moved += [(a, cursor, k), (cursor + n, b + n, k)]
                    else:
                        moved.append((a + n, b + n, k) if cursor <= a else (a, b, k))
                spans = moved
                if mine is not None and n:
                    spans.append((cursor, cursor + n, mine))
                cursor += n
            gone = int(op.get("delete") or 0)
            if gone > 0:
                cut = lambda x: x if x <= cursor else max(cursor, x - gone)  # noqa: B023, E731
                spans = [(cut(a), cut(b), k) for a, b, k in spans if cut(a) < cut(b)]
    left = dict.fromkeys(owner.values(), 0)
    for a, b, k in spans:
        left[k] += b - a
    return left


def windows(events: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """An episode per request, up to the next one; events in order of event_num, deltas in ops."""
    starts = [i for i, e in enumerate(events) if e["event_name"] == "suggestion-get"]
    edits = sorted((e["timestamp_ms"], len(inserted_text(e["ops"]) or "") if e["event_name"] == "text-insert" else 0) for e in events if e["source"] == "user" and e["event_name"] in EDITS)
    stamps, typed = [t for t, _ in edits], [0, *accumulate(n for _, n in edits)]
    out = []
    for start, end in zip(starts, [*starts[1:], len(events)], strict=False):  # one end too many without requests
        own, request = events[start:end], events[start]
        first: Callable[[Any], dict | None] = lambda rule, own=own: next((e for e in own if rule(e)), None)
        opened, chosen = (first(lambda e, name=name: e["event_name"] == name) for name in ("suggestion-open", "suggestion-select"))
        put = answer = None
        if chosen:
            put = first(lambda e: e["event_name"] == "text-insert" and e["source"] == "api" and e["event_num"] > chosen["event_num"])  # noqa: B023
        if opened:
            answer = first(lambda e: e["source"] == "user" and e["timestamp_ms"] >= opened["timestamp_ms"] and e["event_name"] in ANSWERS)  # noqa: B023
        asked = request["timestamp_ms"]
        # a stamp of 0 is as good as none, as in the original rules
        anchor = (put and put["timestamp_ms"]) or (opened and opened["timestamp_ms"])
        until = None if anchor is None else min(anchor + POST_MS, events[end]["timestamp_ms"] if end < len(events) else anchor + POST_MS)
        out.append({
            "request_event_num": request["event_num"], "request_ts": asked, "open_ts": opened and opened["timestamp_ms"], "select_event_num": chosen and chosen["event_num"],
            "insert_event_num": put and put["event_num"], "ai_chars": len(inserted_text(put["ops"]) or "") if put else 0,
            "pre_generation": typed[bisect_left(stamps, asked)] - typed[bisect_left(stamps, asked - PRE_MS)],
            "post_edits": 0 if anchor is None else max(0, bisect_right(stamps, until) - bisect_right(stamps, anchor)),
            "retention": None, "latency_s": (answer["timestamp_ms"] - opened["timestamp_ms"]) / 1000 if answer else None,
        })
    left = retained(events, {e["insert_event_num"]: k for k, e in enumerate(out) if e["insert_event_num"] is not None})
    for k, n in left.items():
        out[k]["retention"] = n / out[k]["ai_chars"] if out[k]["ai_chars"] else None
    return out


def historical_sessions(events: DataFrame) -> DataFrame:
    """A row per session with its historical episodes. events: session_id, event_num, timestamp_ms, event_name, source, ops_json."""

    def run(session_id: str, rows: list[dict[str, Any]]) -> dict[str, Any]:
        for e in rows:
            ops = json.loads(e["ops_json"]) if e["ops_json"] else None
            e["ops"] = ops if isinstance(ops, list) else None
        stamps = [e["timestamp_ms"] for e in rows]
        human = sum(len(inserted_text(e["ops"]) or "") for e in rows if e["event_name"] == "text-insert" and e["source"] == "user")
        return {"session_id": session_id, "human_chars": human, "duration_s": (max(stamps) - min(stamps)) / 1000 if len(stamps) > 1 else None, "episodes": windows(rows)}

    return over_sessions(events, ["event_num", "timestamp_ms", "event_name", "source", "ops_json"], run, SESSION)


def _use(e: Column) -> Column:
    return response_use(e["open_ts"].isNotNull(), e["select_event_num"].isNotNull() & e["insert_event_num"].isNotNull(), e["retention"])


def transition_entropy(states: Column) -> Column:
    """Entropy of the pairs of neighbouring states over its greatest value for as many kinds of pairs; null under two states, 0 for one kind."""
    head = lambda start: F.slice(states, F.lit(start), F.greatest(F.size(states) - 1, F.lit(0)))
    pairs = F.zip_with(head(1), head(2), lambda a, b: F.concat_ws("|", a, b))
    kinds = F.array_distinct(pairs)
    share = lambda kind: F.size(F.filter(pairs, lambda p: p == kind)) / F.size(pairs)
    entropy = F.aggregate(F.transform(kinds, lambda kind: -share(kind) * F.log2(share(kind))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(states) >= 2, F.when(F.size(kinds) > 1, entropy / F.log2(F.size(kinds))).otherwise(0.0))


def target_behavior_metrics(sessions: DataFrame) -> DataFrame:
    """session_id and the ten indicators, from `historical_sessions`; what is undefined is null."""
    shown, n = F.filter("episodes", lambda e: e["open_ts"].isNotNull()), F.size("episodes")
    s = sessions.select("*", shown.alias("shown"), F.transform("episodes", lambda e: e["request_ts"]).alias("asked"), n.alias("n"), F.transform(shown, _use).alias("states"))
    ai = F.aggregate(F.transform("episodes", lambda e: e["ai_chars"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    gaps = F.zip_with(F.slice("asked", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))), F.slice("asked", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0))), lambda b, a: (b - a) / 1000.0)
    s = s.withColumn("gaps", gaps).withColumn("mu", _mean(F.col("gaps"))).withColumn("sigma", F.sqrt(_mean(F.transform("gaps", lambda g: (g - F.col("mu")) * (g - F.col("mu"))))))
    middle = lambda array, field: _median(F.array_sort(F.filter(F.transform(array, lambda e: e[field]), lambda x: x.isNotNull())))
    kept = F.filter(F.transform(F.filter("shown", lambda e: e["insert_event_num"].isNotNull()), lambda e: e["retention"]), lambda x: x.isNotNull())
    return s.select(
        "session_id",
        middle("episodes", "pre_generation").alias("human_generation_before_ai"),
        F.when(F.col("duration_s") > 0, F.col("n") / (F.col("duration_s") / 60.0)).alias("consultation_density"),
        (ai / F.greatest(F.col("human_chars") + ai, F.lit(1))).alias("ai_contribution"),
        _mean(kept).alias("ai_retention"),
        (F.size(F.filter("states", lambda x: x == "Non-Adoption")) / F.greatest(F.size("states"), F.lit(1))).alias("non_adoption"),
        middle("shown", "post_edits").alias("post_ai_editing"),
        _mean(F.transform("gaps", lambda g: F.when(g <= RECONSULT_MS / 1000.0, 1.0).otherwise(0.0))).alias("reconsultation"),
        middle("shown", "latency_s").alias("response_latency"),
        transition_entropy(F.col("states")).alias("transition_entropy"),
        F.when((F.size("gaps") >= 2) & (F.col("sigma") + F.col("mu") > 0), (F.col("sigma") - F.col("mu")) / (F.col("sigma") + F.col("mu"))).alias("consultation_burstiness"),
    )


EPISODE_ANSWERS = pa.schema([("session_id", pa.string()), ("post_edits", pa.list_(pa.int64())), ("latencies_s", pa.list_(pa.float64())), ("gaps_ms", pa.list_(pa.int64()))])


def episode_answers(session_id: str, events: list[dict[str, Any]]) -> dict[str, Any]:
    """By reconstructed episodes: edits after each open, up to the next request; seconds from an open to the first answer; gaps between requests."""
    found, _ = replay(session_id, events)
    at = {e["event_num"]: e["timestamp_ms"] for e in events}
    stamps = sorted(e["timestamp_ms"] for e in events if e["source"] == "user" and e["event_name"] in EDITS)
    answers = [e for e in events if e["source"] == "user" and e["event_name"] in ANSWERS]
    in_time = sorted(found, key=lambda e: (e["request_ts"], e["request_event_num"]))
    edits, waits = [], []
    for e, after in zip(in_time, [*in_time[1:], None], strict=False):
        if e["open_event_num"] is not None:
            anchor = at[e["open_event_num"]]
            until = anchor + POST_MS if after is None else min(anchor + POST_MS, after["request_ts"])
            edits.append(max(0, bisect_right(stamps, until) - bisect_right(stamps, anchor)))
    in_order = sorted(found, key=lambda e: e["request_event_num"])
    for e, after in zip(in_order, [*in_order[1:], None], strict=False):
        if e["open_event_num"] is not None:
            opened = at[e["open_event_num"]]
            end = float("inf") if after is None else after["request_event_num"]
            answer = next((x["timestamp_ms"] for x in answers if e["open_event_num"] <= x["event_num"] < end and x["timestamp_ms"] >= opened), None)
            if answer is not None:
                waits.append((answer - opened) / 1000)
    return {"session_id": session_id, "post_edits": edits, "latencies_s": waits, "gaps_ms": [b["request_ts"] - a["request_ts"] for a, b in zip(in_time, in_time[1:], strict=False)]}


def episode_indicators(events: DataFrame, request_outcomes: DataFrame, session_metrics: DataFrame) -> DataFrame:
    """The ten indicators over reconstructed episodes instead of request windows: a second variant beside `target_behavior_metrics`.

    Five come from the session metrics as they are; what is undefined is null. States are the
    outcomes of requests that showed something; edits are counted from the open, never from the insertion.
    """
    per = over_sessions(events, ["event_num", "timestamp_ms", "event_name", "source"], episode_answers, EPISODE_ANSWERS)
    shown = request_outcomes.where(F.col("outcome") != "request_without_suggestion")
    states = shown.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("request_event_num", "outcome"))), lambda x: x["outcome"]).alias("states"))
    own = session_metrics.select(
        "session_id", F.col("human_generation_before_ai_ratio").alias("human_generation_before_ai"), F.col("consultation_density_per_1000_authored_chars").alias("consultation_density"),
        F.col("ai_share").alias("ai_contribution"), F.col("ai_retention_ratio").alias("ai_retention"), "consultation_burstiness",
    )
    s = own.join(per, "session_id").join(states, "session_id", "left").withColumn("states", F.coalesce("states", F.array().cast("array<string>")))
    return s.select(
        "session_id", "human_generation_before_ai", "consultation_density", "ai_contribution", "ai_retention",
        F.when(F.size("states") > 0, F.size(F.filter("states", lambda x: x == "non_adoption")) / F.size("states")).alias("non_adoption"),
        _median(F.array_sort("post_edits")).alias("post_ai_editing"), _mean(F.transform("gaps_ms", lambda g: F.when(g <= RECONSULT_MS, 1.0).otherwise(0.0))).alias("reconsultation"),
        _median(F.array_sort("latencies_s")).alias("response_latency"), transition_entropy(F.col("states")).alias("transition_entropy"), "consultation_burstiness",
    )

"""Suggestion lifecycles: exact replay of a session's events, and window forms of its regular parts."""

from __future__ import annotations

from collections import deque
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .requests import insertion
from .sessions import over_sessions

LIFECYCLE = ("suggestion-get", "suggestion-open", "suggestion-reopen", "suggestion-select", "suggestion-close")
_LONGS = lambda names: [(n, pa.int64()) for n in names.split()]
EPISODE = pa.struct([("request_id", pa.string()), *_LONGS("request_event_num request_ts open_event_num open_ts request_to_open_ms n_candidates selections insertions closes reopens"), ("was_dismissed", pa.bool_())])
SELECTION = pa.struct(
    [("request_id", pa.string()), *_LONGS("request_event_num"), ("selection_id", pa.string()), *_LONGS("selection_event_num selected_index"), ("selected_text", pa.string())]
    + [*_LONGS("request_to_selection_ms open_to_selection_ms insert_event_num insert_ts"), ("inserted_text", pa.string()), *_LONGS("insert_start insert_end close_event_num"), ("was_inserted", pa.bool_())]
)
REPLAYED = pa.schema([("session_id", pa.string()), ("episodes", pa.list_(EPISODE)), ("selections", pa.list_(SELECTION))])


def replay(session_id: str, events: list[dict[str, Any]]) -> tuple[list[dict], list[dict]]:
    """Episodes and selections of one session, events in order of (event_num, timestamp_ms)."""
    episodes: list[dict] = []
    selections: list[dict] = []
    waiting: deque[dict] = deque()
    inserting: deque[dict] = deque()
    active = shown = None
    newest = lambda rule: next((e for e in reversed(episodes) if rule(e)), None)
    for event in events:
        name, num, ts = event["event_name"], event["event_num"], event["timestamp_ms"]
        if name == "suggestion-get":
            own = {"session_id": session_id, "request_id": f"{session_id}:request:{len(episodes) + 1:04d}", "request_event_num": num, "request_ts": ts, "open_event_num": None, "open_ts": None, "request_to_open_ms": None, "candidates": [], "mine": [], "closes": 0, "reopens": 0, "was_dismissed": False}
            episodes.append(own)
            waiting.append(own)
        elif name == "suggestion-open":
            if waiting:
                active = waiting.popleft()
            elif active is None:
                active = newest(lambda e: e["open_event_num"] is None)
            if active is not None:
                active.update(open_event_num=num, open_ts=ts, request_to_open_ms=ts - active["request_ts"])
                active["candidates"] = event.get("candidates") or active["candidates"]
                shown = active
        elif name == "suggestion-reopen":
            target = shown or newest(lambda e: e["open_event_num"] is not None)
            if target is not None:
                active = target
                target["reopens"] += 1
        elif name == "suggestion-select":
            if active is None:
                active = newest(lambda e: e["open_event_num"] is not None and not e["was_dismissed"])
            if active is None:
                continue
            index = event.get("hover_index")
            index = event.get("suggestion_index") if index is None else index
            text = next((c["trimmed"] for c in active["candidates"] if c["index"] == index), None)
            chosen = {
                "session_id": session_id, "request_id": active["request_id"], "request_event_num": active["request_event_num"],
                "selection_id": f"{active['request_id']}:selection:{len(active['mine']) + 1:02d}", "selection_event_num": num, "selected_index": index, "selected_text": text,
                "request_to_selection_ms": ts - active["request_ts"], "open_to_selection_ms": None if active["open_ts"] is None else ts - active["open_ts"],
                "insert_event_num": None, "insert_ts": None, "inserted_text": None, "insert_start": None, "insert_end": None, "was_inserted": False, "close_event_num": None, "episode": active,
            }
            active["mine"].append(chosen)
            selections.append(chosen)
            inserting.append(chosen)
        elif name == "suggestion-close" and active is not None:
            active["closes"] += 1
            if active["mine"]:
                last = active["mine"][-1]
                last["close_event_num"] = num if last["close_event_num"] is None else last["close_event_num"]
            else:
                active["was_dismissed"] = True
            shown, active = active, None
        elif name == "text-insert" and event.get("source") == "api" and inserting:
            chosen = inserting.popleft()
            span = event.get("insert_span") or {}
            chosen.update(insert_event_num=num, insert_ts=ts, inserted_text=event.get("inserted_text"), insert_start=span.get("start"), insert_end=span.get("end"), was_inserted=event.get("inserted_text") is not None)
            shown = chosen["episode"]
    rows = [{**{k: e[k] for k in ("session_id", "request_id", "request_event_num", "request_ts", "open_event_num", "open_ts", "request_to_open_ms", "closes", "reopens", "was_dismissed")}, "n_candidates": len(e["candidates"]), "selections": len(e["mine"]), "insertions": sum(s["insert_event_num"] is not None for s in e["mine"])} for e in episodes]
    return rows, [{k: v for k, v in s.items() if k != "episode"} for s in selections]


def replayed(events: DataFrame) -> DataFrame:
    """A row per session: its episodes and its selections. Only lifecycle events and api insertions reach Python.

    events: session_id, event_num, timestamp_ms, event_name, source and, if at hand, ops_json, candidates, hover_index
    and suggestion_index. Sessions without any of these events have no row.
    """
    insertion_ = (F.col("event_name") == "text-insert") & (F.col("source") == "api")
    used = events.where(F.col("event_name").isin(*LIFECYCLE) | insertion_)
    columns = ["event_num", "timestamp_ms", "event_name", "source", *[c for c in ("candidates", "hover_index", "suggestion_index") if c in events.columns]]
    if "ops_json" in events.columns:
        columns.append(F.when(insertion_, insertion()).alias("put"))

    def run(session_id: str, rows: list[dict[str, Any]]) -> dict[str, Any]:
        episodes_, selections_ = replay(session_id, [r | {"inserted_text": (r.get("put") or {}).get("text"), "insert_span": r.get("put")} for r in rows])
        return {"session_id": session_id, "episodes": episodes_, "selections": selections_}

    return over_sessions(used, columns, run, REPLAYED)


def episodes(events: DataFrame) -> DataFrame:
    return replayed(events).select("session_id", F.inline("episodes"))


def selections(events: DataFrame) -> DataFrame:
    return replayed(events).select("session_id", F.inline("selections"))


def fifo_match(events: DataFrame, push: Column, pop: Column) -> DataFrame:
    """Each pop with the push it takes from the session's queue, without replay: session_id, push_num, pop_num.

    The queue's length is a prefix sum reflected at zero: a pop misses where the running sum
    falls below all it has been before; the k-th pop that does not miss takes the k-th push.
    """
    order = Window.partitionBy("session_id").orderBy("event_num")
    step = F.when(push, 1).when(pop, -1).otherwise(0)
    marked = events.where(push | pop).select("session_id", "event_num", push.alias("push"), step.alias("step")).withColumn("level", F.sum("step").over(order))
    floor = F.least(F.lit(0), F.coalesce(F.min(F.when(~F.col("push"), F.col("level"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    marked = marked.withColumn("miss", ~F.col("push") & (F.col("level") < floor)).where("not miss")
    marked = marked.withColumn("k", F.row_number().over(Window.partitionBy("session_id", "push").orderBy("event_num")))
    num = lambda rule: F.max(F.when(rule, F.col("event_num")))
    pairs = marked.groupBy("session_id", "k").agg(num(F.col("push")).alias("push_num"), num(~F.col("push")).alias("pop_num"))
    return pairs.where("push_num is not null and pop_num is not null").drop("k")


def orphan_reopens(events: DataFrame, reopen: str = "suggestion-reopen") -> DataFrame:
    """Reopens (or what stands for them) before any open of their session."""
    before = Window.partitionBy("session_id").orderBy("event_num").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.max(F.when(F.col("event_name") == "suggestion-open", 1)).over(before)
    return events.withColumn("opened", opened).where((F.col("event_name") == reopen) & F.col("opened").isNull()).select("session_id", "event_num")

"""Functions of whole sessions: one shuffle by session, events sorted by Spark, many sessions in a Python call."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: Rows of a result that are sent back together.
ROWS_AT_ONCE = 500


def ordered(events: DataFrame) -> list[str]:
    """The columns that order the events of a session: number, time, and where it is at hand the line in the log."""
    return ["event_num", "timestamp_ms", *(["line"] if "line" in events.columns else [])]


def over_sessions(events: DataFrame, columns: list, function: Callable[[str, list[dict[str, Any]]], dict[str, Any]], schema: pa.Schema) -> DataFrame:
    """A row per session: function(session_id, events in order), from the columns given beside session_id.

    A task holds the events of one session at a time.
    """
    order = ordered(events)
    # what only orders is dropped before Python
    kept = events.select(F.col("session_id").cast("string").alias("session_id"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], *columns)
    dealt = kept.repartition("session_id").sortWithinPartitions("session_id", *[f"__o{i}" for i in range(len(order))]).drop(*[f"__o{i}" for i in range(len(order))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict[str, Any]] = []
        key, held = None, []
        for batch in batches:
            for session, rows in groupby(batch.to_pylist(), key=lambda r: r["session_id"]):
                if held and session != key:
                    done.append(function(key, held))
                    held = []
                key = session
                held.extend(rows)
            while len(done) >= ROWS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(done[:ROWS_AT_ONCE], schema)
                del done[:ROWS_AT_ONCE]
        if held:
            done.append(function(key, held))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return dealt.mapInArrow(run, from_arrow_schema(schema))

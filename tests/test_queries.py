"""Every query that has SQL gives the rows of its SQL."""

import duckdb
import pytest

from quillspan.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def cells(rows):
    return sorted(tuple(sorted((k, "" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)) for k, v in r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "labels", "region"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(ORACLES[name]).to_arrow_table().to_pylist()
    got = QUERIES[name](spark, DATA).toArrow().to_pylist()
    assert want
    assert cells(got) == cells(want)


def test_replay_runs(spark):
    assert QUERIES["lifecycle_episodes"](spark, DATA).count() > 0
    assert QUERIES["feature_summary"](spark, DATA).count() == 15


def test_metrics_of_traces(spark):
    """What the replayed metrics share with plain aggregates of the events agrees with them."""
    con = duckdb.connect()
    events = f"'{DATA}/events.parquet'"
    want = dict(con.execute(f"SELECT user_id::VARCHAR, count(*) FILTER (event_type = 'click') FROM {events} GROUP BY 1").fetchall())
    sessions = QUERIES["session_metrics"](spark, DATA).collect()
    assert {r.session_id: r.suggestion_requests for r in sessions} == want
    selections = QUERIES["selection_metrics"](spark, DATA).collect()
    assert len(selections) == sum(r.suggestion_selections for r in sessions) > 0
    assert sum(r.surviving_chars for r in selections) == sum(r.final_ai_chars for r in sessions)
    assert all(r.inserted_chars == r.surviving_chars + r.deleted_chars for r in selections)

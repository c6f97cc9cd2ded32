"""Outcome sequences within sessions: transitions, phases and endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import STATE_LABELS, STATES, labelled, phase


def _keys() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("event_num")


def transitions(selections: DataFrame, scope: str = "all") -> DataFrame:
    """Adjacent pairs of outcomes; cross_request drops pairs within a request without linking anew."""
    pairs = selections.select("session_id", "event_num", "window_id", F.col("outcome").alias("from_state"), F.lead("outcome").over(_keys()).alias("to_state"), F.lead("window_id").over(_keys()).alias("next_window")).where("to_state is not null")
    return pairs.where("window_id <> next_window") if scope == "cross_request" else pairs


def _grid(df: DataFrame, first: str, left: tuple[str, ...]) -> DataFrame:
    return df.sparkSession.createDataFrame([(a, b) for a in left for b in STATES], f"{first} string, {'to_state' if first == 'from_state' else 'outcome'} string")


def _completed(counts: DataFrame) -> DataFrame:
    """All nine cells with count and row probability (null for an empty row)."""
    full = _grid(counts, "from_state", STATES).join(counts, ["from_state", "to_state"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy("from_state"))
    return full.withColumn("probability", F.when(total > 0, F.col("count") / total))


def transition_matrix(selections: DataFrame, scope: str = "all") -> DataFrame:
    """All state pairs with count and row probability (null for an empty row)."""
    return _completed(transitions(selections, scope).groupBy("from_state", "to_state").agg(F.count("*").alias("count")))


def matrix_rows(matrix: DataFrame, scope: str) -> DataFrame:
    """A transition matrix in its written form: scope, both states with their labels, count, probability."""
    return matrix.select(F.lit(scope).alias("scope"), "from_state", labelled("from_state", STATE_LABELS).alias("from_label"), "to_state", labelled("to_state", STATE_LABELS).alias("to_label"), "count", "probability")


def build_sequences(selections: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id and its outcomes in order (array), empty for a session without selections; a selection of an unknown session fails the job."""
    own = selections.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_num", "window_id", "outcome"))), lambda x: x["outcome"]).alias("states"))
    known = sessions.select("session_id").distinct().withColumn("known", F.lit(True))
    both = known.join(own, "session_id", "full")
    named = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("selections of an unknown session: "), F.col("session_id").cast("string")))).otherwise(F.col("session_id"))
    return both.select(named.alias("session_id"), F.coalesce("states", F.array().cast("array<string>")).alias("states"))


PHASES = ("early", "middle", "late")


def positional_profile(selections: DataFrame) -> DataFrame:
    """phase, outcome, count, phase_total, contributing sessions and share, of sessions with two selections or more; all nine cells."""
    own = Window.partitionBy("session_id")
    placed = selections.withColumn("i", F.row_number().over(_keys()) - 1).withColumn("n", F.count("*").over(own)).where("n >= 2").withColumn("phase", phase("i", "n"))
    by = placed.groupBy("phase", "outcome").agg(F.count("*").alias("count"))
    totals = placed.groupBy("phase").agg(F.count("*").alias("phase_total"), F.countDistinct("session_id").alias("contributing_sessions"))
    full = _grid(by, "phase", PHASES).join(by, ["phase", "outcome"], "left").join(totals, "phase", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return full.select("phase", "outcome", zero("count"), zero("phase_total"), zero("contributing_sessions"), F.when(F.col("phase_total") > 0, F.coalesce("count", F.lit(0)) / F.col("phase_total")).alias("share_within_phase"))


def endpoints(selections: DataFrame) -> DataFrame:
    """First to last outcome over sessions with two selections or more: all nine cells with row probability and the number of such sessions."""
    ends = selections.groupBy("session_id").agg(F.count("*").alias("n"), F.min_by("outcome", "event_num").alias("from_state"), F.max_by("outcome", "event_num").alias("to_state")).where("n >= 2")
    cells = _completed(ends.groupBy("from_state", "to_state").agg(F.count("*").alias("count")))
    return cells.withColumn("eligible_sessions", F.sum("count").over(Window.partitionBy(F.lit(1))))  # nine rows


def phase_shares(selections: DataFrame) -> DataFrame:
    own = Window.partitionBy("session_id")
    placed = selections.withColumn("i", F.row_number().over(_keys()) - 1).withColumn("n", F.count("*").over(own)).withColumn("phase", phase("i", "n"))
    shares = [F.avg(F.when(F.col("outcome") == s, 1.0).otherwise(0.0)).alias(f"{s}_share") for s in STATES]
    return placed.groupBy("session_id", "phase").agg(F.count("*").alias("phase_selection_count"), *shares)


def early_late_change(selections: DataFrame) -> DataFrame:
    """Paired late minus early shares, by outcome, over sessions that have both phases."""
    shares = phase_shares(selections).where("phase <> 'middle'")
    both = shares.groupBy("session_id").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("phase") == "late", F.col(f"{s}_share")).otherwise(-F.col(f"{s}_share"))).alias(s) for s in STATES]).where("n = 2")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(s).alias("outcome"), F.col(s).alias("d")) for s in STATES])).alias("x")).select("x.*")
    return long.groupBy("outcome").agg(F.count("*").alias("sessions"), F.avg("d").alias("mean_late_minus_early"), F.median("d").alias("median_late_minus_early"))

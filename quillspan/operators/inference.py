"""Resampling over sessions: bootstrap intervals and the permutation test of transitions.

Sessions are resampled with weights instead of a list of drawn sessions: a session counts in a
repeat as often as a Poisson variable with mean 1, read off a hash of seed, repeat and session
(Poisson bootstrap). So no repeat needs the whole table in one place, a task that runs again
draws the same weights, and the work is one partial aggregation over rows times repeats. The
number of sessions of a repeat varies around the true one, unlike in a draw of fixed size; the
statistics here are ratios and means, which that leaves alike up to terms of 1 / sessions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import STATES
from .sequences import phase_shares, transitions
from .stats import benjamini_hochberg, normalized_entropy

SEED = 42
CELLS = [(a, b) for a in STATES for b in STATES]
UNIT = 1 << 52


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(UNIT)) / F.lit(float(UNIT))


def poisson_weight(u: Column) -> Column:
    """The Poisson(1) variable at the quantile u, up to 17."""
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(17)]
    return reduce(lambda rest, k: F.when(u < steps[k], k).otherwise(rest), reversed(range(17)), F.lit(17))


def resampled(df: DataFrame, session: str, repeats: int, seed: int = SEED) -> DataFrame:
    """Every row once per repeat that draws its session, with its weight."""
    each = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return each.withColumn("weight", poisson_weight(uniform(F.lit(seed), "repeat", session))).where("weight > 0")


def interval(column: str, low: float = 0.025, high: float = 0.975) -> list[Column]:
    return [F.percentile(column, F.lit(low)).alias("ci_2_5"), F.percentile(column, F.lit(high)).alias("ci_97_5")]


def _cells(counts: dict[tuple[str, str], Column]) -> Column:
    """An array with from_state, to_state, count and row probability (null for an empty row) of all nine cells."""
    total = {a: reduce(lambda x, y: x + y, [counts[a, b] for b in STATES]) for a in STATES}
    return F.array(*[F.struct(F.lit(a).alias("from_state"), F.lit(b).alias("to_state"), counts[a, b].alias("count"), F.when(total[a] > 0, counts[a, b] / total[a]).alias("probability")) for a, b in CELLS])


def _name(cell: tuple[str, str]) -> str:
    return f"c{CELLS.index(cell)}"


def bootstrap_transition_probabilities(selections: DataFrame, scope: str = "all", repeats: int = 500, seed: int = SEED) -> DataFrame:
    """Per cell: scope, count, probability, bootstrap_mean, ci_2_5, ci_97_5, valid_bootstrap_draws, bootstrap_repeats.

    Pairs are first counted per session, so a repeat sees nine numbers of a session. A repeat in
    which a row of the matrix is empty gives no draw for that row. No pairs: no rows.
    """
    pairs = transitions(selections, scope)
    per = pairs.groupBy("session_id").agg(*[F.count_if((F.col("from_state") == a) & (F.col("to_state") == b)).alias(_name((a, b))) for a, b in CELLS])
    observed = per.agg(*[F.sum(_name(c)).alias(_name(c)) for c in CELLS]).where(F.col("c0").isNotNull())
    drawn = resampled(per, "session_id", repeats, seed).groupBy("repeat").agg(*[F.sum(F.col(_name(c)) * F.col("weight")).alias(_name(c)) for c in CELLS])
    flat = lambda df: df.select(F.inline(_cells({c: F.col(_name(c)) for c in CELLS})))
    spread = flat(drawn).groupBy("from_state", "to_state").agg(F.avg("probability").alias("bootstrap_mean"), *interval("probability"), F.count("probability").alias("valid_bootstrap_draws"))
    joined = flat(observed).join(F.broadcast(spread), ["from_state", "to_state"], "left")  # nine rows
    return joined.select(F.lit(scope).alias("scope"), "*", F.lit(repeats).alias("bootstrap_repeats"))


def bootstrap_means(df: DataFrame, value: str, by: list[str], session: str = "session_id", repeats: int = 1000, seed: int = SEED) -> DataFrame:
    """Per group: sessions, mean, median, ci_2_5, ci_97_5, bootstrap_repeats, of a table with one value per group and session."""
    present = df.where(F.col(value).isNotNull())
    observed = present.groupBy(*by).agg(F.count("*").alias("sessions"), F.avg(value).alias("mean"), F.median(value).alias("median"))
    drawn = resampled(present, session, repeats, seed).groupBy(*by, "repeat").agg((F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias("draw"))
    spread = drawn.groupBy(*by).agg(*interval("draw"))
    return observed.join(spread, by, "left").withColumn("bootstrap_repeats", F.lit(repeats))


def _long(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(s).alias("outcome"), F.col(f"{s}_share").alias("share")) for s in STATES])))


def phase_summary(selections: DataFrame, repeats: int = 1000, seed: int = SEED) -> DataFrame:
    """Per phase and outcome: sessions, the mean and median of session shares, and the interval of the mean."""
    out = bootstrap_means(_long(phase_shares(selections), ["session_id", "phase"]), "share", ["phase", "outcome"], repeats=repeats, seed=seed)
    return out.withColumnsRenamed({"mean": "mean_session_share", "median": "median_session_share"})


def early_late_intervals(selections: DataFrame, repeats: int = 1000, seed: int = SEED) -> DataFrame:
    """Late minus early shares by outcome with intervals, over sessions that have both phases."""
    shares = _long(phase_shares(selections).where("phase <> 'middle'"), ["session_id", "phase"])
    change = shares.groupBy("session_id", "outcome").agg(F.count("*").alias("n"), F.sum(F.when(F.col("phase") == "late", F.col("share")).otherwise(-F.col("share"))).alias("change")).where("n = 2")
    out = bootstrap_means(change, "change", ["outcome"], repeats=repeats, seed=seed)
    return out.withColumnsRenamed({"mean": "mean_late_minus_early", "median": "median_late_minus_early"})


def two_sided_p(at_least: Column, at_most: Column, draws: Column) -> Column:
    """Twice the smaller tail, the observation counted with the draws, at most 1."""
    tail = lambda n: (1 + n) / (draws + 1)
    return F.least(F.lit(1.0), 2 * F.least(tail(at_least), tail(at_most)))


def _permuted(selections: DataFrame, repeats: int, scope: str, seed: int) -> DataFrame:
    """Counts of the nine cells per repeat; repeat 0 is the sequence as it was.

    A session's states are put in the order of a hash of repeat and place; which neighbours
    belong to one request is fixed by place, as it was.
    """
    own: WindowSpec = Window.partitionBy("session_id").orderBy("event_num")
    rows = selections.select("session_id", "event_num", "outcome", "window_id", (F.row_number().over(own)).alias("i"))
    per = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("i", "outcome", "window_id"))).alias("items")).where(F.size("items") > 1)
    each = per.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats))))
    order = lambda x: F.struct(F.when(F.col("repeat") == 0, x["i"].cast("long")).otherwise(F.xxhash64(F.lit(seed), F.col("repeat"), F.col("session_id"), x["i"])).alias("h"), x["i"].alias("i"), x["outcome"].alias("outcome"))
    each = each.withColumn("mixed", F.array_sort(F.transform("items", order)))
    last = F.size("items") - 1
    both = F.zip_with(F.slice("mixed", F.lit(1), last), F.slice("mixed", F.lit(2), last), lambda a, b: F.struct(a["outcome"].alias("a"), b["outcome"].alias("b")))
    cross = F.zip_with(F.slice("items", F.lit(1), last), F.slice("items", F.lit(2), last), lambda a, b: a["window_id"] != b["window_id"])
    pairs = F.zip_with(both, cross, lambda p, c: F.struct(p["a"].alias("a"), p["b"].alias("b"), c.alias("cross")))
    rule = (lambda p: p["cross"]) if scope == "cross_request" else (lambda p: F.lit(True))
    each = each.select("repeat", F.filter(pairs, rule).alias("pairs"))
    in_cell = lambda cell: lambda p: (p["a"] == cell[0]) & (p["b"] == cell[1])
    counts = [F.sum(F.size(F.filter("pairs", in_cell(c)))).alias(_name(c)) for c in CELLS]
    return each.groupBy("repeat").agg(*counts)


def _against_null(values: DataFrame, by: list[str]) -> DataFrame:
    """Columns repeat and value: what repeat 0 gives against all others, which are null-free where value is not null."""
    here = F.max(F.when(F.col("repeat") == 0, F.col("value"))).over(Window.partitionBy(*by))
    null = F.when(F.col("repeat") > 0, F.col("value"))
    out = values.withColumn("observed", here).withColumn("null", null).groupBy(*by).agg(
        F.first("observed").alias("observed"), F.avg("null").alias("null_mean"), F.percentile("null", F.lit(0.025)).alias("null_ci_2_5"), F.percentile("null", F.lit(0.975)).alias("null_ci_97_5"),
        F.count_if(F.col("null") >= F.col("observed")).alias("above"), F.count_if(F.col("null") <= F.col("observed")).alias("below"), F.count("null").alias("draws"),
    )
    defined = F.col("observed").isNotNull() & (F.col("draws") > 0)
    stated = [F.when(defined, F.col(c)).alias(c) for c in ("null_mean", "null_ci_2_5", "null_ci_97_5")]
    return out.select(*by, "observed", *stated, F.when(defined, two_sided_p(F.col("above"), F.col("below"), F.col("draws"))).otherwise(1.0).alias("permutation_p"))


def permutation_transition_test(selections: DataFrame, scope: str = "cross_request", repeats: int = 1000, seed: int = SEED) -> DataFrame:
    """Per cell: the observed row probability against shuffles within sessions, two-sided p and its q over the nine cells."""
    cells = _permuted(selections, repeats, scope, seed).select("repeat", F.inline(_cells({c: F.col(_name(c)) for c in CELLS})))
    tested = _against_null(cells.withColumn("value", F.col("probability")).withColumn("observed_count", F.max(F.when(F.col("repeat") == 0, F.col("count"))).over(Window.partitionBy("from_state", "to_state"))), ["from_state", "to_state", "observed_count"])
    out = tested.select(
        F.lit(scope).alias("scope"), "from_state", "to_state", "observed_count", F.col("observed").alias("observed_probability"), F.col("null_mean").alias("null_mean_probability"),
        (F.col("observed") - F.col("null_mean")).alias("difference_from_null"), F.when(F.col("null_mean") > 0, F.col("observed") / F.col("null_mean")).alias("probability_ratio"),
        "null_ci_2_5", "null_ci_97_5", "permutation_p", F.lit(repeats).alias("permutation_repeats"),
    )
    return benjamini_hochberg(out, "permutation_p")


def persistence_test(selections: DataFrame, scope: str = "cross_request", repeats: int = 1000, seed: int = SEED) -> DataFrame:
    """The share of transitions that stay in their state against shuffles within sessions: one row."""
    counts = _permuted(selections, repeats, scope, seed)
    total = reduce(lambda x, y: x + y, [F.col(_name(c)) for c in CELLS])
    stay = reduce(lambda x, y: x + y, [F.col(_name((s, s))) for s in STATES])
    tested = _against_null(counts.select(F.lit(scope).alias("scope"), "repeat", F.when(total > 0, stay / total).alias("value")), ["scope"])
    return tested.select(
        "scope", F.col("observed").alias("observed_self_transition_rate"), F.col("null_mean").alias("null_mean_self_transition_rate"), (F.col("observed") - F.col("null_mean")).alias("difference_from_null"),
        "null_ci_2_5", "null_ci_97_5", "permutation_p", F.lit(repeats).alias("permutation_repeats"),
    )


def session_transition_metrics(selections: DataFrame) -> DataFrame:
    """The 15 columns of every session with a selection; rates and entropies without pairs are null."""
    pairs = transitions(selections)
    cross, same = F.col("window_id") != F.col("next_window"), F.col("from_state") == F.col("to_state")
    moves = pairs.groupBy("session_id").agg(F.count_if(~cross).alias("intra"), F.count_if(cross).alias("cross"), F.count("*").alias("all"), F.count_if(same).alias("same"), F.count_if(same & cross).alias("cross_same"))
    share = lambda s: F.avg((F.col("outcome") == s).cast("double"))
    base = selections.groupBy("session_id").agg(
        F.count("*").alias("selection_count"), F.countDistinct("window_id").alias("selected_request_count"), share(STATES[0]).alias("direct_selection_share"), share(STATES[1]).alias("modified_selection_share"),
        share(STATES[2]).alias("non_adoption_selection_share"), F.min_by("outcome", "event_num").alias("first_outcome"), F.max_by("outcome", "event_num").alias("last_outcome"),
    )
    states = normalized_entropy(selections, "session_id", "outcome", len(STATES)).withColumnRenamed("entropy", "state_entropy_normalized")
    kinds = normalized_entropy(pairs.where(cross).withColumn("kind", F.concat_ws(">", "from_state", "to_state")), "session_id", "kind", len(CELLS)).withColumnRenamed("entropy", "cross_transition_entropy_normalized")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    return base.join(moves, "session_id", "left").join(states, "session_id", "left").join(kinds, "session_id", "left").select(
        "session_id", "selection_count", "selected_request_count", count("intra").alias("intra_request_transition_count"), count("cross").alias("cross_request_transition_count"), count("all").alias("all_transition_count"),
        F.when(F.col("all") > 0, F.col("same") / F.col("all")).alias("all_self_transition_rate"), F.when(F.col("cross") > 0, F.col("cross_same") / F.col("cross")).alias("cross_request_self_transition_rate"),
        "state_entropy_normalized", "cross_transition_entropy_normalized", "direct_selection_share", "modified_selection_share", "non_adoption_selection_share", "first_outcome", "last_outcome",
    )

"""Statistical kernels: ranks, correlation, burstiness, entropy, adjusted p-values, scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite


#: Parts into which the distinct values of a group are cut by their size, each summed by itself.
PARTS = 64


def running(counts: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """Adds before_<c> for each of sums: what the rows of the same group with smaller values hold of c.

    counts: one row per group and value. The values of a group are cut into parts at approximate
    quantiles; each part is ordered by itself and the parts' sums are added up before them, so no
    task orders a whole group.
    """
    marks = counts.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], 1000))).alias("__marks"))
    parted = counts.alias("c").join(marks.alias("m"), _same(by)).select("c.*", F.size(F.filter("m.__marks", lambda x: x < F.col(f"c.{value}"))).alias("__part"))
    totals = parted.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS rows
    totals = totals.select(*by, "__part", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums])
    own = Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = parted.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"before_{c}") for c in sums])
    both = inside.alias("c").join(totals.alias("m"), _same([*by, "__part"]))
    return both.select(*[F.col(f"c.{c}").alias(c) for c in counts.columns], *[(F.col(f"c.before_{c}") + F.col(f"m.__{c}")).alias(f"before_{c}") for c in sums])


def _same(by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in by], F.lit(True))


def average_ranks(df: DataFrame, column: str, alias: str = "rank_avg", by: list[str] | None = None) -> DataFrame:
    """Ranks from 1 within groups, ties share their mean. Equal values are counted first, so only distinct values are ordered."""
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    ranks = running(counts, by, column, ["__n"]).select(*by, column, (F.col("before___n") + (F.col("__n") + 1) / 2).alias(alias))
    return df.alias("c").join(ranks.alias("m"), _same([*by, column])).select("c.*", f"m.{alias}")


def _rho(least: int) -> Column:
    varied = (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0)
    cov = F.avg(F.col("rx") * F.col("ry")) - F.avg("rx") * F.avg("ry")
    return F.when((F.count("*") >= least) & varied, F.try_divide(cov, F.stddev_pop("rx") * F.stddev_pop("ry")))


def spearman(df: DataFrame, a: str, b: str, least: int = 3) -> DataFrame:
    """One row: n and rho over rows where both are present; null for too few rows or no variance."""
    both = df.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    ranked = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
    return ranked.agg(F.count("*").alias("n"), _rho(least).alias("rho"))


def spearman_matrix(df: DataFrame, columns: list[str], least: int = 3, *, diagonal: bool = True) -> DataFrame:
    """feature_a, feature_b, n and spearman_rho of every two columns, both ways round, over the rows that have both.

    Null for fewer than `least` rows or no variance; with `diagonal` a column's rho with itself
    is 1 whatever its rows, else it is computed like the others. One pass over all pairs.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i if not diagonal else i + 1, len(columns))]
    value = lambda c: finite(F.col(c).cast("double"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), value(columns[i]).alias("x"), value(columns[j]).alias("y")) for i, j in pairs])).alias("p")).select("p.*").where("x is not null and y is not null")
    ranked = average_ranks(average_ranks(long, "x", "rx", ["i", "j"]), "y", "ry", ["i", "j"])
    found = ranked.groupBy("i", "j").agg(F.count("*").alias("n"), _rho(least).alias("rho"))
    grid = df.sparkSession.createDataFrame([(i, j, a, b) for i, a in enumerate(columns) for j, b in enumerate(columns)], "i int, j int, feature_a string, feature_b string")
    own = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), value(c).alias("x")) for i, c in enumerate(columns)])).alias("p")).groupBy("p.i").agg(F.count("p.x").alias("own_n"))
    lower = grid.withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))
    out = lower.join(found.select(F.col("i").alias("lo"), F.col("j").alias("hi"), "n", "rho"), ["lo", "hi"], "left").join(own, "i", "left")
    same = (F.col("lo") == F.col("hi")) & F.lit(diagonal)
    return out.select("feature_a", "feature_b", F.when(same, F.coalesce("own_n", F.lit(0))).otherwise(F.coalesce("n", F.lit(0))).alias("n"), F.when(same, 1.0).otherwise(F.col("rho")).alias("spearman_rho"))


def strongest_correlations(matrix: DataFrame, columns: list[str], least: float = 0.7) -> DataFrame:
    """feature_a, feature_b, spearman_rho, absolute_rho of the pairs (each once, in the order of columns) from `least` on, the strongest first."""
    place = lambda c: F.array_position(F.array(*map(F.lit, columns)), F.col(c))
    strong = matrix.where((place("feature_a") < place("feature_b")) & (F.abs("spearman_rho") >= least))
    return strong.select("feature_a", "feature_b", "spearman_rho", F.abs("spearman_rho").alias("absolute_rho")).orderBy(F.col("absolute_rho").desc(), "feature_a", "feature_b")


def burstiness(events: DataFrame, time: str = "timestamp_ms", *, zero: float | None = 0.0, sort: str | None = None) -> DataFrame:
    """(sd - mean) / (sd + mean) of the gaps per session; needs three times; zero: the value for no gaps at all.

    The session form sorts times and gives 0; the historical form keeps request order (sort) and gives null.
    """
    gap = F.col(time) - F.lag(time).over(Window.partitionBy("session_id").orderBy(sort or time))
    gaps = events.withColumn("gap", gap).where("gap is not null").groupBy("session_id").agg(F.count("*").alias("n"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("mean"))
    value = F.when(F.col("sd") + F.col("mean") != 0, (F.col("sd") - F.col("mean")) / F.col("sd").__add__(F.col("mean"))).otherwise(F.lit(zero).cast("double"))
    return gaps.select("session_id", F.when(F.col("n") >= 2, value).alias("burstiness"))


def normalized_entropy(df: DataFrame, key: str, state: str, categories: int) -> DataFrame:
    """Natural entropy of states per key over ln(categories)."""
    counts = df.groupBy(key, state).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(key))
    return counts.withColumn("p", p).groupBy(key).agg((F.abs(F.sum(F.col("p") * F.ln("p"))) / F.ln(F.lit(float(categories)))).alias("entropy"))


def benjamini_hochberg(df: DataFrame, p: str = "p") -> DataFrame:
    """q-values of a table of tests (a few hundred rows)."""
    w = Window.orderBy(F.col(p))
    ranked = df.withColumn("__r", F.row_number().over(w)).withColumn("__m", F.count("*").over(Window.partitionBy()))
    back = Window.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("fdr_q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__r")).over(back))).drop("__r", "__m")


def summarize(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per feature: counts, missing, zeros, quartiles, mean, population deviation and skewness. One pass, one grouped aggregate."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select("f.*")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy("feature").agg(F.count("*").alias("n_total"), F.count("x").alias("n_observed"), F.count_if(F.col("x") == 0).alias("zeros"), F.countDistinct("x").alias("unique_values"), F.min("x").alias("min"), q.alias("q"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.when(F.count("x") > 0, F.when(F.stddev_pop("x") > 0, F.skewness("x")).otherwise(0.0)).alias("skewness"))
    zero = F.when(F.col("n_observed") > 0, F.col("zeros") / F.col("n_observed"))
    return out.select("feature", "n_total", "n_observed", (F.col("n_total") - F.col("n_observed")).alias("n_missing"), zero.alias("zero_fraction_observed"), "unique_values", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", "mean", "std", "skewness", (zero >= 0.95).alias("zero_dominated"))


def robust_scale(df: DataFrame, column: str, alias: str = "scaled") -> DataFrame:
    """(x - median) / iqr; a zero iqr only centres."""
    stats = df.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"))
    iqr = F.col("__q")[2] - F.col("__q")[0]
    return df.crossJoin(F.broadcast(stats)).withColumn(alias, (F.col(column) - F.col("__q")[1]) / F.when(iqr != 0, iqr).otherwise(1.0)).drop("__q")


def standard_scale(df: DataFrame, column: str, alias: str = "scaled") -> DataFrame:
    stats = df.agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    return df.crossJoin(F.broadcast(stats)).withColumn(alias, (F.col(column) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).drop("__m", "__s")


def binary_metrics(df: DataFrame, actual: str, score: str) -> DataFrame:
    """One row: n, roc_auc, average_precision, brier, balanced_accuracy and macro_f1 at 0.5; null where a class is missing.

    Rows are first counted by distinct score, so only those are ordered.
    """
    by = df.groupBy((-F.col(score)).alias("down")).agg(F.count_if(F.col(actual) == 1).alias("p"), F.count_if(F.col(actual) == 0).alias("q"))
    cum = running(by, [], "down", ["p", "q"]).withColumn("s", -F.col("down")).withColumn("tp", F.col("before_p") + F.col("p")).withColumn("fp", F.col("before_q") + F.col("q"))
    hit = lambda c, rule: F.sum(F.when(rule, F.col(c)).otherwise(0))
    rows = cum.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"), F.sum(F.col("p") * (F.col("fp") - F.col("q") / 2)).alias("worse"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"), F.sum(F.col("p") * (1 - F.col("s")) ** 2 + F.col("q") * F.col("s") ** 2).alias("b"), hit("p", F.col("s") >= 0.5).alias("tpos"), hit("q", F.col("s") < 0.5).alias("tneg"))
    both = (F.col("np") > 0) & (F.col("nq") > 0)
    f1 = lambda right, of, other: F.coalesce(F.try_divide(2 * F.col(right), F.col(of) + F.col(other)), F.lit(0.0))
    rows = rows.withColumn("said_p", F.col("tpos") + F.col("nq") - F.col("tneg")).withColumn("said_q", F.col("tneg") + F.col("np") - F.col("tpos"))
    return rows.select((F.col("np") + F.col("nq")).alias("n"), F.when(both, 1 - F.col("worse") / (F.col("np") * F.col("nq"))).alias("roc_auc"), F.when(both, F.col("ap") / F.col("np")).alias("average_precision"), (F.col("b") / (F.col("np") + F.col("nq"))).alias("brier"), F.when(both, (F.col("tpos") / F.col("np") + F.col("tneg") / F.col("nq")) / 2).alias("balanced_accuracy"), F.when(both, (f1("tpos", "said_p", "np") + f1("tneg", "said_q", "nq")) / 2).alias("macro_f1"))

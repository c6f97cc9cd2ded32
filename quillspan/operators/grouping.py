"""Sessions by tertiles of their AI share, and what the groups look like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import OUTCOMES, safe_ratio, share_group


def session_shares(trace: DataFrame) -> DataFrame:
    """ai_chars, human_chars and ai_share of each session's insertions."""
    chars = lambda source: F.coalesce(F.sum(F.when((F.col("event_name") == "text-insert") & (F.col("source") == source), F.col("k"))), F.lit(0))
    sums = trace.groupBy("session_id").agg(chars("api").alias("ai_chars"), chars("user").alias("human_chars"))
    return sums.withColumn("ai_share", safe_ratio("ai_chars", F.col("ai_chars") + F.col("human_chars")))


def thresholds(shares: DataFrame) -> DataFrame:
    """Tertiles with linear interpolation."""
    q = shares.agg(F.percentile("ai_share", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    return q.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def membership(shares: DataFrame) -> DataFrame:
    return shares.crossJoin(F.broadcast(thresholds(shares))).withColumn("group", share_group("ai_share", F.col("low"), F.col("high"))).drop("low", "high")


GROUPS = ("Low", "Moderate", "High")


def group_summary(df: DataFrame, measures: tuple[str, ...], share: str = "ai_share") -> DataFrame:
    """A row per group: n_sessions, mean and median of the share, and the mean of each measure over the rows that have it.

    df: a row per session with share and measures. A group without sessions fails the job.
    """
    per = membership(df.withColumn("ai_share", F.col(share))).groupBy("group").agg(F.count("*").alias("n_sessions"), F.avg("ai_share").alias(f"{share}_mean"), F.median("ai_share").alias(f"{share}_median"), *[F.avg(m).alias(f"{m}_mean") for m in measures])
    grid = df.sparkSession.createDataFrame([(g,) for g in GROUPS], "group string")
    full = grid.join(per, "group", "left")
    return full.withColumn("n_sessions", F.when(F.col("n_sessions").isNull(), F.raise_error(F.concat(F.lit("no session in group "), F.col("group")))).otherwise(F.col("n_sessions")))


#: Names of the outcomes in the table by groups: count, share, and the share's second name (fixed values).
SHORT = {"accept_unchanged": ("direct", "direct_adoption"), "accepted_modified": ("modified", "modified_adoption"), "non_adoption": ("non_adoption", "non_adoption"), "presented_no_selection": ("no_selection", "no_selection"), "request_without_suggestion": ("no_suggestion", "no_suggestion")}


def outcomes_by_group(outcomes: DataFrame, shares: DataFrame) -> DataFrame:
    """group, n_sessions, n_requests, the count of every outcome and its share, under two names each; a request without a session fails the job."""
    members = membership(shares).select("session_id", "group")
    joined = outcomes.join(members, "session_id", "left")
    joined = joined.withColumn("group", F.when(F.col("group").isNull(), F.raise_error(F.lit("a request has no session"))).otherwise(F.col("group")))
    per = joined.groupBy("group").agg(F.count("*").alias("n_requests"), *[F.count_if(F.col("outcome") == o).alias(f"{SHORT[o][0]}_count") for o in OUTCOMES])
    full = members.groupBy("group").agg(F.count("*").alias("n_sessions")).join(per, "group", "left").na.fill(0)
    share = lambda o: safe_ratio(f"{SHORT[o][0]}_count", "n_requests")
    return full.select("group", "n_sessions", "n_requests", *[f"{SHORT[o][0]}_count" for o in OUTCOMES], *[share(o).alias(SHORT[o][1]) for o in OUTCOMES], *[share(o).alias(f"{SHORT[o][0]}_share") for o in OUTCOMES])

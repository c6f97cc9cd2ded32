"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its source's target over the source's size. Their
prefix sums within the source, shifted by one random offset, cross an integer boundary
as often as the document is emitted. The prefix sums are taken in two steps, so that no
task holds a whole source: documents are ranked inside small groups (source, size band,
hash), and the groups' counts are summed before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

#: Documents in a group that is ranked by itself.
GROUP_ROWS = 10_000
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> source, source_size and target, the words that each source should give: shares by
    weight, none above cap times its size, the excess reshared by weight.

    Sources are taken by code point, null last; the weights repeat in that order. Each round of resharing is an
    aggregate over the sources, of which there may be any number.
    """
    if totals.isEmpty():
        return totals.select("source", "source_size", F.lit(0.0).alias("target"))
    # the place in the order: that within a range of sources, after the sources of the ranges before
    ranged = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranged = written(ranged.select("source", "source_size", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "sources")
    ranges = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    ordered = ranged.join(ranges, "range").withColumn("place", F.col("before") + F.col("at")).select("source", "source_size", weight.cast("double").alias("weight"))
    limit = cap * F.col("source_size")
    # once a source is at its limit it stays there: left and weight of the others fall round by round
    total = ordered.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    left, open_weight, full = share * total["s"], total["w"], 0.0
    ceiling = -1.0  # limit / weight up to which sources are full
    while open_weight > 0:
        rate = left / open_weight
        over = ordered.where((limit / F.col("weight") > ceiling) & (limit / F.col("weight") <= rate)).agg(F.sum(limit).alias("s"), F.sum("weight").alias("w")).first()
        if over["w"] is None:
            break
        ceiling, left, open_weight = rate, left - over["s"], open_weight - over["w"]
    rate = left / open_weight if open_weight > 0 else 0.0
    return ordered.select("source", "source_size", F.when(limit / F.col("weight") <= ceiling, limit).otherwise(F.lit(rate) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, cap: float = 2.0, seed: int = 20240607) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken (copies times size).

    copies is 0, 1 or 2 (cap, rounded up): within a source the expected copies are equal, and
    documents of like sizes follow each other, so the words taken come near the target.
    The order depends on doc_id, size and seed alone, so reruns agree. Null and empty texts
    have size 0 and come out like others; a null source is a source of its own; rows that
    repeat an id are separate documents. An empty table gives an empty result.
    """
    base = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    small = written(base.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    totals = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, share, weights, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    strata = max(1, -(-small.count() // GROUP_ROWS))
    band = F.when(F.col("size") <= 0, 0).otherwise(F.floor(4 * F.log2(F.col("size").cast("double"))) + 1).cast("int")
    ranked = small.withColumn("band", band).withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("stratum", F.pmod("hash", F.lit(strata)))
    key = ["source", "band", "stratum"]
    groups = ranked.groupBy(*key).agg(F.count("*").alias("n"))
    bands = groups.groupBy("source", "band").agg(F.sum("n").alias("n"))
    before = lambda *part: Window.partitionBy("source", *part)
    bands = bands.withColumn("of_band", F.sum("n").over(before().orderBy("band").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    groups = groups.withColumn("of_group", F.sum("n").over(before("band").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    starts = groups.alias("g").join(bands.alias("b"), [F.col(f"g.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("source", "band")]).select(*[F.col(f"g.{c}").alias(c) for c in key], (F.coalesce("g.of_group", F.lit(0)) + F.coalesce("b.of_band", F.lit(0))).alias("start"))
    # a group's rank needs only the group; rows that agree in all columns are alike
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("size", "hash", "doc_id"))
    ranked = ranked.withColumn("rank", rank - 1)
    placed = ranked.alias("r").join(starts.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in key]).select("r.doc_id", "r.source", "r.size", (F.col("s.start") + F.col("r.rank")).alias("place"))
    # one row per source, unhinted: Spark weighs its size
    placed = placed.alias("p").join(plan.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "t.source_size", "t.target", "t.rate")
    offset = ((seed * 2654435761) % 2**32) / 2**32
    copies = (F.floor((F.col("place") + 1) * F.col("rate") + offset) - F.floor(F.col("place") * F.col("rate") + offset)).cast("long")
    return placed.withColumn("copies", copies).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (its own columns only).

    Rows that agree in id, source and size are told apart by their place among equals, so that
    each gets copies of its own; only such rows are ordered. Texts are shuffled once. An empty
    table gives an empty result.
    """
    key = ["doc_id", "source", "size"]
    mix = written(mix_sources(docs, id_col, text_col, source_col, **options).select(*key, "copies"), "mix")
    alike = written(mix.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").select(*key), "alike")
    same = lambda a, b: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{y}")) for x, y in b_columns]
    own = docs.withColumn("__size", word_count(F.col(f"`{text_col}`")))
    b_columns = [(f"`{id_col}`", "doc_id"), (f"`{source_col}`", "source"), ("__size", "size")]
    columns = [F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    copied = lambda df: df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("m.copies")))).select(*columns)
    kept = mix.where("copies > 0")
    if alike.isEmpty():
        return copied(own.alias("d").join(kept.alias("m"), same("d", "m")))
    single = kept.alias("k").join(alike.alias("a"), [F.col(f"k.{c}").eqNullSafe(F.col(f"a.{c}")) for c in key], "left_anti")
    out = copied(own.alias("d").join(single.alias("m"), same("d", "m")))
    nth = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    mixed = mix.alias("k").join(alike.alias("a"), [F.col(f"k.{c}").eqNullSafe(F.col(f"a.{c}")) for c in key], "left_semi").withColumn("nth", nth(key, [F.col("copies").desc()])).where("copies > 0")
    twins = own.alias("d").join(alike.alias("a"), same("d", "a"), "left_semi").withColumn("__nth", nth([f"`{id_col}`", f"`{source_col}`", "__size"], [F.xxhash64(f"`{text_col}`"), f"`{text_col}`"]))
    return out.unionByName(copied(twins.alias("d").join(mixed.alias("m"), [*same("d", "m"), F.col("d.__nth") == F.col("m.nth")])))

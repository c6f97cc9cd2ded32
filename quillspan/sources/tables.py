"""Tables written earlier, read again with checks: required columns, typed values, ranges, unique keys, no empty table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import MISSING, normalized_outcome, optional_double, optional_int, required


@dataclass(frozen=True)
class Contract:
    """columns: name -> text, double, double?, long, long? or outcome (a question mark allows missing values); key: columns that
    no two rows share; within: bounds of a column; missing: what stands for a missing number."""

    columns: dict[str, str]
    key: tuple[str, ...] = ()
    within: dict[str, tuple[float, float]] = field(default_factory=dict)
    missing: tuple[str, ...] = MISSING


INDICATORS = ("human_generation_before_ai", "consultation_density", "ai_retention", "non_adoption", "post_ai_editing", "reconsultation", "response_latency", "transition_entropy", "consultation_burstiness")
CONTRACTS = {
    "behavior_metrics": Contract({"session_id": "text", "ai_contribution": "double", **dict.fromkeys(INDICATORS, "double?")}, ("session_id",), {"ai_contribution": (0, 1)}),
    "request_outcomes": Contract({"session_id": "text", "outcome": "outcome"}),
    "selections": Contract({"session_id": "text", "selection_id": "text", "request_event_num": "long", "selection_event_num": "long", "adoption_outcome": "text"}, ("session_id", "selection_id")),
    "sessions": Contract({"session_id": "text"}, ("session_id",)),
    "insertions": Contract(
        {"session_id": "text", "selection_id": "text", "request_event_num": "long", "selection_event_num": "long", "inserted_chars": "double", "selected_index": "long", "request_to_selection_ms": "double", "open_to_selection_ms": "double?", "adoption_outcome": "text"},
        ("session_id", "selection_id"), missing=("",),
    ),
    "predictions": Contract({"task": "text", "model": "text", "session_id": "text", "selection_id": "text", "actual": "long", "positive_probability": "double"}, ("task", "model", "session_id", "selection_id"), {"positive_probability": (0, 1), "actual": (0, 1)}),
}


def checked(df: DataFrame, contract: Contract, name: str) -> DataFrame:
    """The contract's columns of a table of text, typed; what breaks it fails at once (columns, empty) or in the job (values, keys)."""
    absent = [c for c in contract.columns if c not in df.columns]
    if absent:
        raise ValueError(f"{name} lacks {', '.join(absent)}")
    if df.isEmpty():
        raise ValueError(f"{name} is empty")

    def typed(column: str, kind: str) -> Column:
        raw = F.col(f"`{column}`")
        if kind == "text":
            return required(F.nullif(raw, F.lit("")), column)
        if kind == "outcome":
            return normalized_outcome(raw)
        value = optional_int(raw) if kind.startswith("long") else optional_double(raw, contract.missing)
        if column in contract.within:
            low, high = contract.within[column]
            value = F.when(value.between(low, high) | value.isNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"{column} lies outside [{low}, {high}]: "), raw)).cast("double"))
        return value if kind.endswith("?") else required(value, column)

    out = df.select(*[typed(c, kind).alias(c) for c, kind in contract.columns.items()])
    if contract.key:
        twice = out.groupBy(*contract.key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{name} repeats {', '.join(str(twice[0][k]) for k in contract.key)}")
    return out


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The CSV table at path under the contract of that name."""
    return checked(spark.read.option("header", True).csv(path), CONTRACTS[name], name)


def read_matrix(spark: SparkSession, path: str, columns: list[str] | None = None, key: str = "session_id") -> DataFrame:
    """A CSV matrix: unique keys, then numbers (all of them present) in the columns given, or in all others."""
    df = spark.read.option("header", True).csv(path)
    names = columns or [c for c in df.columns if c != key]
    return checked(df, Contract({key: "text", **dict.fromkeys(names, "double")}, (key,)), path)


def read_square(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """A square matrix whose header and rows name exactly the labels, in their order; missing numbers are null."""
    df = spark.read.option("header", True).csv(path)
    first, *rest = df.columns
    rows = df.collect()  # labels by labels
    if rest != labels or [r[first] for r in rows] != labels:
        raise ValueError(f"{path} does not name {', '.join(labels)} in this order")
    place = F.array_position(F.array(*map(F.lit, labels)), F.col(f"`{first}`"))
    return df.select(F.col(f"`{first}`").alias("label"), *[optional_double(F.col(f"`{c}`")).alias(c) for c in labels]).orderBy(place)

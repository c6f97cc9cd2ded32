"""Session logs: one JSON object per line, one file per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANDIDATES = "array<struct<index:bigint,original:string,trimmed:string,probability:double>>"


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, line and value of every line that is not blank; line ascends within a file but counts the lines of others too.

    It is made of the place of the file's split and the row's place in the scan, so nothing is shuffled for it.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    if not lines.inputFiles():
        raise FileNotFoundError(f"no {pattern} under {path}")
    # rows of a split have ascending ids; splits of a file ascend with their start
    place = F.array(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return lines.select(F.col("_metadata.file_path").alias("path"), place.alias("line"), "value").where(F.col("value").rlike(r"(?U)\S"))


def bad_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, line (from 1, blank ones counted) and error of the lines that cannot be read: a quarantine list.

    Only files that hold such lines are numbered.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    placed = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    parsed = F.try_parse_json("value")
    has = lambda name, kind: F.try_variant_get(parsed, f"$.{name}", kind).isNotNull()
    error = F.when(parsed.isNull(), "invalid JSON").when(~has("eventNum", "bigint"), "eventNum is missing").when(~has("eventName", "string"), "eventName is missing").when(~has("eventTimestamp", "bigint"), "eventTimestamp is missing")
    placed = placed.withColumn("error", F.when(F.col("value").rlike(r"(?U)\S"), error)).drop("value")
    broken = placed.where("error is not null").select("path").distinct()
    numbered = placed.join(broken, "path", "left_semi").withColumn("line", F.row_number().over(Window.partitionBy("path").orderBy("split", "row")))
    return numbered.where("error is not null").select("path", "line", "error")


def read_sessions(spark: SparkSession, path: str, pattern: str = "*.jsonl", without: DataFrame | None = None) -> DataFrame:
    """Events of all matching files under path, one row each; line ascends within a file (it orders equal event numbers and times).

    Blank lines are skipped, a line that is no JSON fails the job with its file and text (`bad_lines` numbers
    such lines; the files named in without, a table with their path, are left out). session_id is the file's stem. eventNum, eventName and eventTimestamp are required (a
    missing one fails the job); other fields are null where blank or of another type. An
    unknown source is 'unknown'. text_delta and cursor_range stay variants.
    """
    raw = read_lines(spark, path, pattern)
    raw = raw if without is None else raw.join(without.select("path").distinct(), "path", "left_anti")
    failed = F.raise_error(F.concat("path", F.lit(": invalid JSON: "), F.substring("value", 1, 80)))
    raw = raw.select("line", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("session_id"), F.coalesce(F.try_parse_json("value"), failed).alias("v"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    need = lambda name, kind: F.when(get(name, kind).isNull(), F.raise_error(F.lit(f"{name} is missing"))).otherwise(get(name, kind))
    source = F.lower(get("eventSource", "string"))
    text = lambda name: F.when(get(name, "string") != "", get(name, "string"))
    listed = F.filter(F.coalesce(F.try_variant_get("v", "$.currentSuggestions", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.schema_of_variant(c).startswith("OBJECT"))
    field = lambda c, name, kind: F.try_variant_get(c, f"$.{name}", kind)
    original = lambda c: F.coalesce(field(c, "original", "string"), F.lit(""))
    trimmed = lambda c: F.coalesce(field(c, "trimmed", "string"), F.regexp_replace(F.regexp_replace(original(c), r"(?U)^\s+", ""), r"(?U)\s+$", ""))
    candidate = lambda c: F.struct(F.when(field(c, "index", "bigint").isNull(), F.raise_error(F.lit("index is missing"))).otherwise(field(c, "index", "bigint")).alias("index"), original(c).alias("original"), trimmed(c).alias("trimmed"), field(c, "probability", "double").alias("probability"))
    return raw.select(
        "session_id",
        "line",
        need("eventNum", "bigint").cast("long").alias("event_num"),
        need("eventName", "string").alias("event_name"),
        need("eventTimestamp", "bigint").cast("long").alias("timestamp_ms"),
        F.when(source.isin("user", "api", "system"), source).otherwise("unknown").alias("source"),
        get("currentCursor", "bigint").alias("current_cursor"),
        F.try_variant_get("v", "$.cursorRange", "variant").alias("cursor_range"),
        F.try_variant_get("v", "$.textDelta", "variant").alias("text_delta"),
        text("currentDoc").alias("current_doc"),
        F.transform(listed, candidate).alias("candidates"),
        get("currentSuggestionIndex", "bigint").alias("suggestion_index"),
        get("currentHoverIndex", "bigint").alias("hover_index"),
    )

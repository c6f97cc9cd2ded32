"""Audits: checks of what was reconstructed against the events it came from.

A check is a row (check, ok, violations); violations counts the rows that break it. An audit of an
empty table passes. Every check is one aggregate, a join or an anti-join; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import orphan_reopens
from .requests import delta_lengths


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows (check, ok, violations) of rules that hold of every row; a rule that is null counts as broken. One pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), (F.col(name) == 0).alias("ok"), F.col(name).alias("violations")) for name in rules])))


def _missing(name: str, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return broken(left.select(*keys).join(right.select(*keys).distinct(), keys, "left_anti").withColumn("absent", F.lit(False)), {name: F.col("absent")})


def _unique(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    return broken(df.groupBy(*keys).agg(F.count("*").alias("n")), {name: F.col("n") == 1})


#: Keys of an operation and the letters that stand for them (fixed values).
LETTERS = (("retain", "R"), ("insert", "I"), ("delete", "D"), ("attributes", "A"))


def signature(ops_json: str | Column = "ops_json") -> Column:
    """The signatures of a delta's operations, joined by commas: the letters of all their keys, O for any other key, ? for none.

    What is no object goes by its type in angle brackets; a delta without a list of operations is empty.
    """
    ops = F.coalesce(F.try_variant_get(F.try_parse_json(ops_json), "$", "array<variant>"), F.array().cast("array<variant>"))
    keys = lambda o: F.coalesce(F.map_keys(F.try_variant_get(o, "$", "map<string,variant>")), F.array().cast("array<string>"))
    known = F.array(*[F.lit(k) for k, _ in LETTERS])
    letters = lambda ks: F.concat(*[F.when(F.array_contains(ks, k), letter).otherwise("") for k, letter in LETTERS], F.when(F.size(F.array_except(ks, known)) > 0, "O").otherwise(""))
    of = lambda o: F.when(F.schema_of_variant(o).startswith("OBJECT"), F.coalesce(F.nullif(letters(keys(o)), F.lit("")), F.lit("?"))).otherwise(F.concat(F.lit("<"), F.lower(F.schema_of_variant(o)), F.lit(">")))
    return F.array_join(F.transform(ops, of), ",")


def text_deltas(events: DataFrame) -> DataFrame:
    """Text events by name, source and signature, with how many and the first example."""
    texts = events.where(F.col("event_name").isin("text-insert", "text-delete"))
    return texts.groupBy("event_name", "source", signature().alias("signature")).agg(F.count("*").alias("events"), F.min(F.struct("session_id", "event_num")).alias("example")).select("event_name", "source", "signature", "events", "example.*")


def top_signatures(events: DataFrame, k: int = 20) -> DataFrame:
    """The k commonest signatures, ties by name: a report."""
    return text_deltas(events).groupBy("signature").agg(F.sum("events").alias("events")).orderBy(F.col("events").desc(), "signature").limit(k)


def delta_tables(events: DataFrame) -> dict[str, DataFrame]:
    """The report on text deltas: signatures (20), signatures by event (30), examples (15), keys of operations, types of their values, and unusual events (30)."""
    texts = events.where(F.col("event_name").isin("text-insert", "text-delete")).withColumn("signature", signature())
    per = texts.groupBy("event_name", "signature").agg(F.count("*").alias("events"))
    ops = texts.select("session_id", "event_num", "event_name", "signature", F.explode(F.try_variant_get(F.try_parse_json("ops_json"), "$", "array<variant>")).alias("op"))
    fields = ops.select("*", F.explode(F.try_variant_get("op", "$", "map<string,variant>")).alias("key", "value"))
    kind = F.lower(F.regexp_extract(F.schema_of_variant("value"), r"^([A-Z]+)", 1))
    preview = F.when(F.schema_of_variant("value") == "STRING", F.concat(F.substring(F.try_variant_get("value", "$", "string"), 1, 120), F.when(F.length(F.try_variant_get("value", "$", "string")) > 120, F.lit("...")).otherwise(""))).otherwise(F.schema_of_variant("value"))
    usual = F.array(F.lit("R,I"), F.lit("R,D"), F.lit("I"), F.lit("D"))
    first = per.select("signature").distinct().join(texts.groupBy("signature").agg(F.count("*").alias("events"), F.min(F.struct("session_id", "event_num", "event_name", "ops_json")).alias("e")), "signature")
    return {
        "signatures": top_signatures(events),
        "signatures_by_event": per.orderBy(F.col("events").desc(), "event_name", "signature").limit(30),
        "examples": first.orderBy(F.col("events").desc(), "signature").limit(15).select("signature", "events", "e.session_id", "e.event_num", "e.event_name", F.substring("e.ops_json", 1, 120).alias("preview")),
        "operation_keys": fields.groupBy("key").agg(F.count("*").alias("operations")).orderBy(F.col("operations").desc(), "key"),
        "value_types": fields.groupBy("key", kind.alias("type")).agg(F.count("*").alias("operations"), F.min(preview).alias("example")).orderBy("key", "type"),
        "unusual": texts.where(~F.array_contains(usual, F.col("signature"))).select("session_id", "event_num", "event_name", "signature").orderBy("session_id", "event_num").limit(30),
    }


def lifecycle(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests and selections of the reconstruction (`metrics.replayed`) against the events."""
    episodes = sessions.select(F.col("session_id"), F.inline("episodes"))
    selections = sessions.select(F.col("session_id"), F.inline("selections"))
    named = lambda name, alias: events.where(F.col("event_name") == name).select(F.col("session_id").cast("string").alias("session_id"), F.col("event_num").alias(alias))
    gets, selects = named("suggestion-get", "request_event_num"), named("suggestion-select", "selection_event_num")
    keys = ["session_id", "selection_event_num"]
    parts = [
        _missing("request without episode", gets, episodes, ["session_id", "request_event_num"]),
        _missing("episode without request", episodes, gets, ["session_id", "request_event_num"]),
        _missing("select without selection", selects, selections, keys),
        _missing("selection without select", selections, selects, keys),
        _unique("selection occurs once", selections, keys),
        _unique("episode occurs once", episodes, ["session_id", "request_event_num"]),
        broken(selections, {"selection was inserted": F.col("insert_event_num").isNotNull()}),
        _reopens_accounted(events, episodes),
        broken(orphan_reopens(events).withColumn("orphan", F.lit(False)), {"reopen follows an open": F.col("orphan")}),
    ]
    return reduce(DataFrame.unionByName, parts)


def _reopens_accounted(events: DataFrame, episodes: DataFrame) -> DataFrame:
    """Reopens of the episodes and those before any open make up the reopens of a session."""
    named = lambda df, alias: df.groupBy(F.col("session_id").cast("string").alias("session_id")).agg(F.count("*").alias(alias))
    raw, orphan = named(events.where(F.col("event_name") == "suggestion-reopen"), "raw"), named(orphan_reopens(events), "orphan")
    both = raw.join(orphan, "session_id", "full").join(episodes.groupBy("session_id").agg(F.sum("reopens").alias("taken")), "session_id", "full").na.fill(0, ["raw", "orphan", "taken"])
    return broken(both, {"reopens are accounted for": F.col("raw") == F.col("orphan") + F.col("taken")})


def lifecycle_totals(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: requests, selections, reopens, orphan reopens, episodes of several selections and the most selections of one."""
    raw = events.agg(*[F.count_if(F.col("event_name") == f"suggestion-{n}").alias(f"{n}s") for n in ("get", "open", "reopen", "select", "close")])
    own = sessions.select(F.inline("episodes")).agg(F.count("*").alias("episodes"), F.sum("selections").alias("selections"), F.sum("reopens").alias("reopens_taken"), F.count_if(F.col("was_dismissed")).alias("dismissed"), F.count_if(F.col("selections") > 1).alias("multi_selection_episodes"), F.max("selections").alias("most_selections"))
    return raw.crossJoin(own).crossJoin(orphan_reopens(events).agg(F.count("*").alias("orphan_reopens")))


def provenance(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The replayed text against its events: every api insertion belongs to one selection, characters are neither lost nor made.

    Works on `metrics.replayed`. The number of characters inserted by api events is taken from the events themselves.
    """
    put = events.where((F.col("event_name") == "text-insert") & (F.col("source") == "api")).select(F.col("session_id").cast("string").alias("session_id"), F.col("event_num").alias("insert_event_num"), delta_lengths()["inserted"].alias("raw_chars"))
    selections = sessions.select("session_id", F.inline("selections"))
    inserted = selections.where("insert_event_num is not null")
    keys = ["session_id", "insert_event_num"]
    raw = put.groupBy("session_id").agg(F.sum("raw_chars").alias("raw"))
    own = selections.groupBy("session_id").agg(*[F.sum(f"{n}_chars").alias(n) for n in ("inserted", "surviving", "deleted")])
    both = sessions.select("session_id", "final_text_chars", "final_ai_chars", "final_human_chars", "final_system_chars", "final_text", "anomalies").join(raw, "session_id", "left").join(own, "session_id", "left").na.fill(0, ["raw", "inserted", "surviving", "deleted"])
    c = F.col
    parts = [
        _missing("api insertion without selection", put, inserted, keys),
        _missing("selection without api insertion", inserted, put, keys),
        _unique("api insertion belongs to one selection", inserted, keys),
        broken(put.join(inserted.select(*keys, "inserted_chars"), keys), {"selection has its insertion's characters": c("raw_chars") == c("inserted_chars")}),
        broken(selections, {"selection: inserted = surviving + deleted": c("inserted_chars") == c("surviving_chars") + c("deleted_chars")}),
        broken(both, {
            "characters of api insertions are those of selections": c("raw") == c("inserted"),
            "session: inserted = surviving + deleted": c("inserted") == c("surviving") + c("deleted"),
            "surviving characters are in the text": c("surviving") == c("final_ai_chars"),
            "origins lie within the text": c("final_ai_chars") + c("final_human_chars") + c("final_system_chars") <= c("final_text_chars"),
            "text has its characters": F.length("final_text") == c("final_text_chars"),
            "no anomalies": c("anomalies") == 0,
        }),
    ]
    return reduce(DataFrame.unionByName, parts)


def anomalies(sessions: DataFrame) -> DataFrame:
    """Kinds of anomalies of the replay with how many, in how many sessions, and the first such session."""
    return sessions.select("session_id", F.explode("anomaly_kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("anomalies"), F.countDistinct("session_id").alias("sessions"), F.min("session_id").alias("example"))


def deleted_by_origin(sessions: DataFrame) -> DataFrame:
    """Characters deleted of the text of each origin: ai for selections, else human, system and the like."""
    ids = sessions.select("session_id", F.explode("deleted_by_origin").alias("origin", "chars"))
    return ids.groupBy(F.when(F.col("origin").contains(":selection:"), "ai").otherwise(F.col("origin")).alias("origin")).agg(F.sum("chars").alias("deleted_chars"))


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-12


def selection_metrics(selections: DataFrame) -> DataFrame:
    """Meaning and bounds of `metrics.selection_metrics`."""
    c = F.col
    direct, gone = c("adoption_outcome") == "direct_adoption", c("adoption_outcome") == "non_adoption"
    rules = {
        "inserted = surviving + deleted": c("inserted_chars") == c("surviving_chars") + c("deleted_chars"),
        "ratios lie in [0, 1]": c("retention_ratio").between(0, 1) & c("deletion_ratio").between(0, 1),
        "direct adoption keeps all": ~direct | ((c("deleted_chars") == 0) & c("survives_contiguously")),
        "non-adoption keeps nothing": ~gone | (c("surviving_chars") == 0),
        "modified adoption keeps something": (c("adoption_outcome") != "modified_adoption") | (c("surviving_chars") > 0),
        "latencies are not negative": (F.coalesce("request_to_selection_ms", F.lit(0)) >= 0) & (F.coalesce("open_to_selection_ms", F.lit(0)) >= 0),
    }
    return broken(selections, rules).unionByName(_unique("selection id occurs once", selections, ["selection_id"]))


def session_metrics(sessions: DataFrame) -> DataFrame:
    """Partitions and bounds of `metrics.session_metrics`."""
    c = F.col
    parts = c("final_ai_chars") + c("final_human_chars") + c("final_system_chars") + c("final_other_chars")
    shares = ("ai_share", "document_ai_share")
    rules = {
        "origins add up to the text": c("final_text_chars") == parts,
        "authored = ai + human": c("authored_text_chars") == c("final_ai_chars") + c("final_human_chars"),
        "ai inserted = surviving + deleted": c("ai_inserted_chars") == c("ai_surviving_chars") + c("ai_deleted_chars"),
        "ai surviving is in the text": c("ai_surviving_chars") == c("final_ai_chars"),
        "adoptions add up to selections": c("direct_adoptions") + c("modified_adoptions") + c("non_adoptions") == c("suggestion_selections"),
        "shares lie in [0, 1]": reduce(lambda a, b: a & b, [c(s).between(0, 1) for s in shares]),
        "shares of outcomes add up to 1": (c("suggestion_selections") == 0) | _close(c("direct_adoption_share") + c("modified_adoption_share") + c("non_adoption_share"), F.lit(1.0)),
    }
    return broken(sessions, rules).unionByName(_unique("session occurs once", sessions, ["session_id"]))


#: Features that lie in [0, 1] (fixed values).
SHARES = ("ai_share", "ai_retention_ratio", "human_generation_before_ai_ratio", "dismissal_rate", "multi_selection_rate", "direct_adoption_share", "modified_adoption_share")


def features(table: DataFrame, shares: tuple[str, ...] = SHARES, sessions: int | None = None) -> DataFrame:
    """Unique sessions, columns that are null or lie in [0, 1] and, where it is given, the number of sessions."""
    rules = {f"{s} lies in [0, 1]": F.col(s).isNull() | F.col(s).between(0, 1) for s in shares}
    out = broken(table, rules).unionByName(_unique("session occurs once", table, ["session_id"]))
    return out if sessions is None else out.unionByName(frozen(table.agg(F.count("*").alias("v")).withColumn("k", F.lit("sessions")), "k", "v", {"sessions": sessions}))


def missing_shares(table: DataFrame, columns: list[str]) -> DataFrame:
    """feature, missing and its percentage of the rows."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNull().alias("gone")) for c in columns])).alias("f")).select("f.*")
    return long.groupBy("feature").agg(F.count_if("gone").alias("missing"), (100 * F.avg(F.col("gone").cast("int"))).alias("missing_percent"))


def frozen(df: DataFrame, key: str, value: str, expected: dict[str, float], tolerance: float = 1e-12) -> DataFrame:
    """A release check: the values by key against frozen ones; what is missing or further away than tolerance is broken."""
    want = df.sparkSession.createDataFrame([(k, float(v)) for k, v in expected.items()], "frozen_key string, frozen_value double")
    both = want.join(df.select(F.col(key).alias("frozen_key"), F.col(value).cast("double").alias("found")), "frozen_key", "left")
    near = F.coalesce(F.abs(F.col("found") - F.col("frozen_value")) <= tolerance, F.lit(False))
    return both.select(F.col("frozen_key").alias("check"), near.alias("ok"), F.when(near, 0).otherwise(1).cast("long").alias("violations"))

"""Historical request windows, five-way outcomes and session indicators, all as windows and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import POST_MS, PRE_MS, RECONSULT_MS, adoption, strip

def _order() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("event_num")


def request_windows(trace: DataFrame) -> DataFrame:
    """Rows with window_id: the number of requests so far; what comes before the first request is dropped."""
    return trace.withColumn("window_id", F.sum(F.when(F.col("event_name") == "suggestion-get", 1).otherwise(0)).over(_order())).where("window_id > 0")


def _first(what: Column, rule: Column) -> Column:
    return F.min_by(F.when(rule, what), F.when(rule, F.col("event_num")))


def _first_aggregates() -> list[Column]:
    is_ = lambda name: F.col("event_name") == name
    aggregates = [F.min("event_num").alias("request_num"), F.min_by("timestamp_ms", "event_num").alias("request_ts")]
    for short in ("open", "select", "close"):
        rule = is_(f"suggestion-{short}")
        aggregates += [F.min(F.when(rule, F.col("event_num"))).alias(f"{short}_num"), _first(F.col("timestamp_ms"), rule).alias(f"{short}_ts"), _first(F.col("k"), rule).alias(f"{short}_k")]
    return [*aggregates, _first(F.col("source"), is_("suggestion-close")).alias("close_source")]


def first_in_window(trace: DataFrame) -> DataFrame:
    """Per request: numbers, times and k of its first open, select and close."""
    return request_windows(trace).groupBy("session_id", "window_id").agg(*_first_aggregates())


def with_insertion(trace: DataFrame) -> DataFrame:
    """first_in_window with the first api insertion after the first select: number, k and time; one shuffle."""
    rows = request_windows(trace)
    own = Window.partitionBy("session_id", "window_id").orderBy("event_num").rowsBetween(Window.unboundedPreceding, -1)
    selected = F.max(F.when(F.col("event_name") == "suggestion-select", 1)).over(own)
    put = (F.col("event_name") == "text-insert") & (F.col("source") == "api") & (selected == 1)
    rows = rows.withColumn("put", F.coalesce(put, F.lit(False)))
    num = F.min(F.when(F.col("put"), F.col("event_num"))).alias("insert_num")
    return rows.groupBy("session_id", "window_id").agg(*_first_aggregates(), num, _first(F.col("k"), F.col("put")).alias("insert_k"), _first(F.col("timestamp_ms"), F.col("put")).alias("insert_ts"))


def five_way_outcomes(trace: DataFrame) -> DataFrame:
    """session_id, window_id and outcome; the text equality of real logs is stood in for by the parity of k."""
    same = F.col("open_k") % 2 == F.col("insert_k") % 2
    outcome = (
        F.when(F.col("insert_num").isNotNull() & F.col("open_num").isNotNull() & same, "accept_unchanged")
        .when(F.col("insert_num").isNotNull() & F.col("open_num").isNotNull(), "accepted_modified")
        .when(F.col("open_num").isNull(), "request_without_suggestion")
        .when((F.col("close_num").isNotNull()) & (F.col("close_source") == "user"), "non_adoption")
        .otherwise("presented_no_selection")
    )
    return with_insertion(trace).select("session_id", "window_id", outcome.alias("outcome"))


def selection_proxies(trace: DataFrame) -> DataFrame:
    """One row per select inside a window: inserted k, deleted k of later deletions, survivors, contiguity and outcome."""
    later = Window.partitionBy("session_id", "window_id").orderBy("event_num").rowsBetween(1, Window.unboundedFollowing)
    rows = request_windows(trace)
    gone = F.coalesce(F.sum(F.when(F.col("event_name") == "text-delete", F.col("k"))).over(later), F.lit(0))
    touched = F.coalesce(F.max(F.when((F.col("event_name") == "text-insert") & (F.col("source") == "user"), 1)).over(later), F.lit(0))
    rows = rows.withColumn("deleted", gone).withColumn("contiguous", touched == 0).where("event_name = 'suggestion-select'")
    rows = rows.select("session_id", "window_id", "event_num", "timestamp_ms", F.col("k").alias("inserted"), "deleted", F.greatest(F.col("k") - F.col("deleted"), F.lit(0)).alias("surviving"), "contiguous")
    return rows.withColumn("outcome", adoption("inserted", "surviving", "contiguous"))


def session_indicators(trace: DataFrame) -> DataFrame:
    """Per session: requests, user characters in the 30 s before requests, edits after answers, reconsultation within 60 s.

    How many edits lie between two times is the difference of two running counts, so edits and
    requests are never paired: the ends of the requests' spans are laid among the edits in order of time.
    """
    edit = (F.col("source") == "user") & F.col("event_name").isin("text-insert", "text-delete")
    before = Window.partitionBy("session_id").orderBy("timestamp_ms").rangeBetween(-PRE_MS, -1)
    pre = trace.withColumn("pre_chars", F.coalesce(F.sum(F.when(edit, F.col("k"))).over(before), F.lit(0))).where("event_name = 'suggestion-get'").groupBy("session_id").agg(F.median("pre_chars").alias("pre_chars_median"))
    per = with_insertion(trace).withColumn("next_ts", F.lead("request_ts").over(Window.partitionBy("session_id").orderBy("window_id")))
    per = per.withColumn("anchor", F.coalesce("insert_ts", "open_ts")).withColumn("limit", F.least(F.col("anchor") + POST_MS, F.col("next_ts")))
    again = per.groupBy("session_id").agg(F.count("*").alias("requests"), F.count_if(F.col("next_ts") - F.col("request_ts") <= RECONSULT_MS).alias("reconsulted"), F.count("open_num").alias("opened"), F.count("insert_num").alias("inserted"))
    # +1 for each edit up to the limit, -1 for each up to the anchor, of spans that are not empty
    marks = per.where("limit > anchor").select("session_id", F.inline(F.array(F.struct(F.col("limit").alias("ts"), F.lit(1).alias("sign")), F.struct(F.col("anchor").alias("ts"), F.lit(-1).alias("sign")))))
    edits = trace.where(edit).select("session_id", F.col("timestamp_ms").alias("ts"), F.lit(0).alias("sign"))
    upto = F.count_if(F.col("sign") == 0).over(Window.partitionBy("session_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    post = edits.unionByName(marks).withColumn("seen", upto).where("sign <> 0").groupBy("session_id").agg(F.sum(F.col("sign") * F.col("seen")).alias("post_edits"))
    return again.join(pre, "session_id", "left").join(post, "session_id", "left").withColumn("post_edits", F.coalesce("post_edits", F.lit(0)))


def inserted_text(ops_json: str | Column = "ops_json") -> Column:
    """The string insertions of a delta joined, without Python; empty if there are none (embeds don't count)."""
    ops = F.coalesce(F.try_variant_get(F.try_parse_json(ops_json), "$", "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda o: F.schema_of_variant(F.try_variant_get(o, "$.insert", "variant")) == "STRING"
    return F.array_join(F.transform(F.filter(ops, kind), lambda o: F.try_variant_get(o, "$.insert", "string")), "")


def insertion(ops_json: str | Column = "ops_json") -> Column:
    """struct<text, start, end> of a delta's string insertions, joined; null if there are none.

    Retained characters and insertions move the place, deletions don't; end is start plus the
    length of the text even where its pieces lie apart.
    """
    ops = F.coalesce(F.try_variant_get(F.try_parse_json(ops_json), "$", "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda o, name: F.schema_of_variant(F.try_variant_get(o, f"$.{name}", "variant"))
    retain = lambda o: F.when(kind(o, "retain") == "BIGINT", F.greatest(F.try_variant_get(o, "$.retain", "bigint"), F.lit(0))).otherwise(F.lit(0))
    piece = lambda o: F.when(kind(o, "insert") == "STRING", F.try_variant_get(o, "$.insert", "string"))
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("start"), F.lit("").alias("text"))

    def step(acc: Column, op: Column) -> Column:
        at = acc["at"] + F.coalesce(retain(op), F.lit(0))
        return F.struct((at + F.coalesce(F.length(piece(op)), F.lit(0))).alias("at"), F.when(piece(op).isNotNull(), F.coalesce(acc["start"], at)).otherwise(acc["start"]).alias("start"), F.concat(acc["text"], F.coalesce(piece(op), F.lit(""))).alias("text"))

    return F.aggregate(ops, none, step, lambda acc: F.when(acc["start"].isNotNull(), F.struct(acc["text"].alias("text"), acc["start"].alias("start"), (acc["start"] + F.length(acc["text"])).alias("end"))))


def delta_lengths(ops_json: str | Column = "ops_json") -> Column:
    """struct<inserted, deleted>: characters of string insertions, and characters deleted, of a delta."""
    ops = F.coalesce(F.try_variant_get(F.try_parse_json(ops_json), "$", "array<variant>"), F.array().cast("array<variant>"))
    gone = F.transform(ops, lambda o: F.greatest(F.coalesce(F.try_variant_get(o, "$.delete", "bigint"), F.lit(0)), F.lit(0)))
    return F.struct(F.length(inserted_text(ops_json)).cast("bigint").alias("inserted"), F.aggregate(gone, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("deleted"))


def request_outcomes(events: DataFrame) -> DataFrame:
    """Per request of real logs: session_id, request_id, request_event_num, open_event_num, selection_count (0 or 1), outcome.

    events: as of `metrics.replayed`, with candidates and hover_index. The selected text is the
    candidate of the window's first open at the hover index of its first select (counted from 0);
    it is compared to the stripped text of the first api insertion after that select that is not
    blank. A select without such an insertion is judged by open and close, as if there were none.
    """
    name, num = F.col("event_name"), F.col("event_num")
    used = events.where(name.isin("suggestion-get", "suggestion-open", "suggestion-select", "suggestion-close") | ((name == "text-insert") & (F.col("source") == "api")))
    text = F.when(name == "text-insert", strip(inserted_text()))
    windows = request_windows(used.select(F.col("session_id").cast("string").alias("session_id"), "event_num", "event_name", "source", "candidates", "hover_index", text.alias("text")))
    own = Window.partitionBy("session_id", "window_id").orderBy("event_num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen_at = F.min(F.when(name == "suggestion-select", num)).over(own)
    after = windows.withColumn("is_insertion", F.coalesce((name == "text-insert") & (F.col("text") != "") & (num > chosen_at), F.lit(False)))
    is_ = lambda short: name == f"suggestion-{short}"
    per = after.groupBy("session_id", "window_id").agg(
        F.min("event_num").alias("request_event_num"), F.min(F.when(is_("open"), num)).alias("open_event_num"), _first(F.col("candidates"), is_("open")).alias("shown"), F.count_if(is_("select")).alias("selects"),
        F.min_by(F.struct("hover_index"), F.when(is_("select"), num)).alias("hover"), _first(F.col("source"), is_("close")).alias("close_source"), _first(F.col("text"), F.col("is_insertion")).alias("inserted"),
    )
    index = F.col("hover.hover_index")
    selected = F.when((index >= 0) & (index < F.size("shown")), F.try_element_at("shown", (index + 1).cast("int")))
    selected = F.coalesce(F.when(selected["trimmed"] != "", selected["trimmed"]), selected["original"])
    outcome = (
        F.when(F.col("inserted").isNotNull() & F.coalesce(selected == F.col("inserted"), F.lit(False)), "accept_unchanged")
        .when(F.col("inserted").isNotNull(), "accepted_modified").when(F.col("open_event_num").isNull(), "request_without_suggestion")
        .when(F.coalesce(F.col("close_source") == "user", F.lit(False)), "non_adoption").otherwise("presented_no_selection")
    )
    request_id = F.concat("session_id", F.lit(":request:"), F.format_string("%04d", F.col("window_id")))
    return per.select("session_id", request_id.alias("request_id"), "request_event_num", "open_event_num", F.least("selects", F.lit(1)).cast("int").alias("selection_count"), outcome.alias("outcome"))

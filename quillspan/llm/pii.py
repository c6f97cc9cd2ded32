"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the spans of four base patterns (e-mail, IP, payment card, phone). Instances are
the seeds as a whole, and elsewhere each token that holds a digit or an at sign and each run
of digit groups. The one and the two words before an instance, or the text's start, are its
lexical patterns. Over the graph of patterns and instances Spark scores in turn: a pattern by
the kinds of its known instances (unknown ones are unlabelled, not wrong), an instance by its
best pattern and by how its characters suit the seeds of that kind. Instances of high score
become known until none is new, and the spans that no base pattern covers are added.

The base patterns are written so that Java's matcher neither recurses nor goes back over a
long run: possessive repeats, and a start that is the run's first character or the end of
the last match (where leftmost matching would start as well).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGIT_RUN = r"[0-9][0-9 -]*[0-9]"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPACES = r"\x20\x09-\x0D"
#: A token that may be an identifier: a run without white space that holds a digit or an at sign.
TOKEN = rf"(?<![^{SPACES}])[^{SPACES}0-9@]*+[0-9@][^{SPACES}]*+"
#: Digit groups with single spaces between them, like (743) 555-3824.
GROUP = r"[+(]*+[0-9][0-9().+/-]*+(?![\p{L}@])"
GROUPS = rf"(?<![^{SPACES}:=]){GROUP}(?:\x20{GROUP})++"
#: What is cut off a token: a label and punctuation before it, punctuation behind it.
LEAD = r"^(?:\p{L}++[:=]++)?[^\p{L}0-9@+]*+"
TAIL = r"(?<![^\p{L}0-9])[^\p{L}0-9]++\z"
#: Code points before an instance that its words are taken from; of a word that is longer the last ones stand for it.
CONTEXT = 64
#: Fewest distinct known instances of a pattern, the least share of one kind among them, and the least score of a new instance.
SUPPORT, CONFIDENCE, SCORE = 5, 0.9, 0.9

SPAN = "struct<kind:string,start:int,end:int>"
INSTANCE = "struct<kind:string,start:int,end:int,token:string,context:string>"


def _last(text: Column) -> Column:
    return F.substring(text, -CONTEXT, CONTEXT)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, text, context>> of a pattern's matches: the pieces between them give their places (code points); context is the text's last CONTEXT code points before the match."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(pieces.alias("before"), found.alias("text"))
    empty = F.array().cast("array<struct<start:int,text:string,context:string>>")
    context = lambda acc, p: _last(F.concat(acc["tail"], p["before"]))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["before"]) + F.coalesce(F.length(p["text"]), F.lit(0))).alias("at"),
        _last(F.concat(context(acc, p), F.coalesce(p["text"], F.lit("")))).alias("tail"),
        F.when(p["text"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(p["before"])).alias("start"), p["text"].alias("text"), context(acc, p).alias("context"))))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), empty.alias("out"))
    return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(pairs, start, step, lambda acc: acc["out"]))


def _spans(kind: str, matches: Column) -> Column:
    return F.transform(matches, lambda m: _instance(F.lit(kind), m["start"], m["text"], m["context"]))


def _instance(kind: Column, start: Column, token: Column, context: Column) -> Column:
    return F.struct(kind.alias("kind"), start.cast("int").alias("start"), (start + F.length(token)).cast("int").alias("end"), token.alias("token"), context.alias("context"))


def _luhn(digits: Column) -> Column:
    size = F.length(digits)
    place = F.sequence(F.lit(1), size)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when((size - i) % 2 == 1, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return F.aggregate(F.transform(place, doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(text: Column) -> Column:
    return F.translate(text, " ().+-", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind, in order: array<struct<kind, start, end, token, context>>."""
    none = F.array().cast(f"array<{INSTANCE}>")
    ip_ok = lambda m: m["text"].rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    # digits with single separators: the parts of a run between two or more separators
    parts = F.flatten(F.transform(_matches(text, DIGIT_RUN), lambda run: F.transform(_matches(run["text"], r"(?:[^ -]|(?<![ -])[ -](?![ -]))++"), lambda m: F.struct((run["start"] + m["start"]).alias("start"), m["text"].alias("text"), _last(F.concat(run["context"], m["context"])).alias("context")))))
    card_ok = lambda m: F.length(_digits(m["text"])).between(16, 19)
    cards = F.filter(F.filter(parts, card_ok), lambda m: _luhn(_digits(m["text"])))
    phones = F.filter(_matches(text, PHONE), lambda m: F.length(_digits(m["text"])).between(8, 15))
    return {
        "email": F.when(F.contains(text, F.lit("@")), _spans("email", _matches(text, EMAIL))).otherwise(none),
        "ip": F.when(text.rlike(IP), _spans("ip", F.filter(_matches(text, IP), ip_ok))).otherwise(none),
        "card": F.when(text.rlike(r"[0-9][0-9 -]{14}"), _spans("card", cards)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), _spans("phone", phones)).otherwise(none),
    }


def _shape(token: Column) -> Column:
    """The token with runs of letters and digits folded: a@a.a, 9-9, a9."""
    return F.regexp_replace(F.regexp_replace(token, r"\p{L}+", "a"), "[0-9]+", "9")


def _instances(text: Column) -> Column:
    """Like the base spans, without kind: the tokens and digit groups that may be identifiers, trimmed of outer punctuation."""
    inner = lambda m: F.regexp_replace(m["text"], LEAD, "")
    cut = lambda m: F.length(m["text"]) - F.length(inner(m))
    none = F.lit(None).cast("string")
    tokens = F.transform(_matches(text, TOKEN), lambda m: _instance(none, m["start"] + cut(m), F.regexp_replace(inner(m), TAIL, ""), _last(F.concat(m["context"], F.substring(m["text"], F.lit(1), cut(m))))))
    groups = F.transform(_matches(text, GROUPS), lambda m: _instance(none, m["start"], F.regexp_replace(m["text"], r"(?<=[0-9])[^0-9]++\z", ""), m["context"]))
    return F.filter(F.concat(tokens, groups), lambda m: m["token"].rlike("[0-9@]"))


def _patterns(start: Column, context: Column) -> Column:
    """The last word and the last two words before an instance; ^ stands for the text's start, and a word with a digit or an at sign for its shape."""
    words = F.filter(F.split(F.lower(context), rf"[{SPACES}]+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}0-9@]+|[^\p{L}0-9@]+$", "")
    words = F.transform(words, lambda w: F.when(bare(w) == "", w).when(w.rlike("[0-9@]"), _shape(bare(w))).otherwise(bare(w)))
    words = F.when(start <= CONTEXT, F.concat(F.array(F.lit("^")), words)).otherwise(words)
    few = lambda n: F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - (n - 1)), F.lit(n)), " ")
    return F.filter(F.array_distinct(F.array(few(1), few(2))), lambda p: p != "")


def _overlaps(span: Column, other: Column) -> Column:
    return (span["start"] < other["end"]) & (other["start"] < span["end"])


def _features(token: Column) -> Column:
    """What a token's characters say of its kind, whatever their order: at sign, letters, points and number of digits."""
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    bucket = sum(((digits >= n).cast("int") for n in (1, 4, 7, 9, 12, 16, 20)), F.lit(0))
    points = F.least(F.length(F.regexp_replace(token, r"[^.]", "")), F.lit(3))
    letters = token.rlike(r"\p{L}").cast("int")
    return F.array(*[F.concat(F.lit(name), value.cast("string")) for name, value in (("at", F.contains(token, F.lit("@")).cast("int")), ("letters", letters), ("points", points), ("digits", bucket))])


def _suits(tokens: DataFrame) -> dict[str, dict[str, float]]:
    """For each kind, the log ratio of a feature's share among the seeds of the kind and among all tokens, smoothed by one."""
    rows = tokens.withColumn("feature", F.explode(F.concat(F.array(F.lit("")), _features(F.col("token"))))).groupBy("kind", "feature").agg(F.count("*").alias("n")).collect()
    sizes = {"at": 2, "letters": 2, "points": 4, "digits": 8}
    share = lambda n, total, feature: (n + 1) / (total + sizes[feature.rstrip("0123456789")])
    of = lambda feature, *kinds: sum(r["n"] for r in rows if r["feature"] == feature and (not kinds or r["kind"] in kinds))
    every = [f"{name}{i}" for name, size in sizes.items() for i in range(size)]
    return {kind: {f: math.log(share(of(f, kind), of("", kind), f) / share(of(f), of(""), f)) for f in every} for kind in KINDS}


def _known(instances: DataFrame) -> DataFrame:
    """(token, kind) pairs, seeds and what the bootstrap over the pattern-instance graph discovers.

    instances: token, pattern and kind (of the base span that it is, else null). Each distinct
    (pattern, token) edge counts once, so copies of a document add nothing. A pattern is of a kind if at
    least SUPPORT of its known tokens and a share of CONFIDENCE of them are, and the kind is no rarer
    after it than among all tokens; its confidence is hits / (known + 1). The odds of a token are those of
    its best pattern times the ratios by which its features are commoner among the kind's seeds.
    """
    edges = written(instances.groupBy("pattern", "token").agg(F.max("kind").alias("kind")), "edges")
    tokens = written(edges.groupBy("token").agg(F.max("kind").alias("kind")), "tokens")
    suits = _suits(tokens)
    weight = F.create_map(*[F.lit(x) for kind, of in suits.items() for f, v in of.items() for x in (f"{kind} {f}", v)])
    suit = F.aggregate(_features(F.col("token")), F.lit(0.0), lambda a, f: a + weight[F.concat_ws(" ", "kind", f)])
    found, total = tokens.where("kind is not null"), tokens.count()
    while total:
        base = {r["kind"]: r["count"] / total for r in found.groupBy("kind").count().collect()}
        if not base:
            break
        labelled = edges.select("pattern", "token").join(found, "token", "left")
        scored = labelled.groupBy("pattern").agg(F.count("*").alias("n"), F.count("kind").alias("labelled"), F.mode("kind", True).alias("kind"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
        scored = scored.withColumn("hits", F.greatest(*[F.col(f"n_{k}") for k in KINDS]))
        usual = F.create_map(*[F.lit(x) for kind, share in base.items() for x in (kind, share)])[F.col("kind")]
        good = scored.where((F.col("hits") >= SUPPORT) & (F.col("hits") >= CONFIDENCE * F.col("labelled")) & (F.col("hits") >= usual * F.col("n"))).select("pattern", "kind", F.log(F.col("hits") / (F.col("labelled") + 1 - F.col("hits"))).alias("odds"))
        best = edges.select("pattern", "token").join(good, "pattern").join(found.select("token"), "token", "left_anti").groupBy("token", "kind").agg(F.max("odds").alias("odds"))
        best = best.withColumn("odds", F.col("odds") + suit).where(F.col("odds") >= math.log(SCORE / (1 - SCORE)))
        more = written(best.groupBy("token").agg(F.max_by("kind", F.struct("odds", "kind")).alias("kind")), "more")
        if more.isEmpty():
            break
        found = written(found.unionByName(more), "known")
    return found


def _row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for an id and a text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key and spans: array<struct<kind, start, end>> of code points (end exclusive), base and added, and base.

    Spans are ordered by kind (as listed in KINDS), then start. Added spans never overlap a
    base span. A null or empty text has none; one row per distinct (doc_id, text) of the
    input is kept apart by row_key, repeated rows come out repeated. An empty table gives
    an empty result.
    """
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    spans = base_spans(F.col("text"))
    scanned = base.select("doc_id", _row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.concat(*[spans[k] for k in KINDS]).alias("seeds"), F.when(F.col("text").rlike("[0-9@]"), _instances(F.col("text"))).otherwise(F.array().cast(f"array<{INSTANCE}>")).alias("instances"))
    scanned = written(scanned, "pii")
    other = F.filter("instances", lambda m: ~F.exists("seeds", lambda b: _overlaps(m, b)))
    cells = scanned.select("row_key", F.explode(F.concat("seeds", other)).alias("m")).select("row_key", "m.*")
    scanned = scanned.withColumn("base", F.transform("seeds", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    edges = cells.select("token", "kind", F.explode(_patterns(F.col("start"), F.col("context"))).alias("pattern"))
    new = _known(edges)
    added = cells.where("kind is null").select("row_key", "start", "end", "token").distinct().join(new, "token")
    # of digit groups and a token in them the longer
    before = Window.partitionBy("row_key").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("reached", F.max("end").over(before)).where(F.coalesce(F.col("end") > F.col("reached"), F.lit(True))).groupBy("row_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    out = scanned.select("doc_id", "row_key", "base").join(added, "row_key", "left")
    every = F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
    order = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int").alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.transform(F.array_sort(F.transform(every, order)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select("doc_id", "row_key", "base", every.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with every span of personal data replaced by its kind in angle brackets; other texts stay as they are."""
    found = find_pii(docs, id_col, text_col).where(F.size("spans") > 0).groupBy("row_key").agg(F.first("spans").alias("__spans"))
    text = F.col(f"`{text_col}`")
    # spans may overlap across kinds: they are taken in order of start, and what is behind a masked end is left out
    by_start = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))).alias("out"), s["end"].alias("at")))
    masked = F.aggregate(by_start, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    keyed = docs.withColumn("__row", _row_key(F.col(f"`{id_col}`"), text))
    joined = keyed.join(found, F.col("__row") == F.col("row_key"), "left")
    return joined.select(*[F.when(F.col("__spans").isNotNull(), masked).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])

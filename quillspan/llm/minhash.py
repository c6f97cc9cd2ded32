"""MinHash near-dedup with BagMinHash signatures of weighted shingle sets.

A document is the multiset of its runs of five words; documents are near duplicates if
their weighted Jaccard similarity is THRESHOLD or more. Every shingle owns Poisson
processes, one for the weights [0, 1), one for [1, 2), one for [2, 4) and so on, whose rates
are the widths of these intervals. A point has a time, a weight in its interval and one of
the signature's places; a document of weight w sees the points whose weight is below w,
and each place keeps its earliest point. Equal places have the weighted Jaccard
similarity as probability. Points come in order of time, and a process stops once it is
later than all places of its document, so long documents need little more than one point
for each shingle.

Signatures are cut into bands; documents that share a band are linked to the band's least
document and the link is verified on the whole multisets. What verified links have not
joined, but some band has brought together, is then verified as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, give_back, gram_hashes, mix, over_batches, pick, small_batches, word_hashes, written

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
PLACES = BANDS * ROWS
#: Documents and shingles of a block of a band.
BLOCK_DOCS, BLOCK_SHINGLES = 1_000, 400_000
#: Shingles whose signatures are made together.
BATCH_SHINGLES = 100_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words (given by their hashes), one per place; a shorter text is one run of all its words."""
    return gram_hashes(words, min(WORDS, len(words))) if len(words) else words


def shingled(texts: pa.Array) -> list[np.ndarray]:
    """The shingles of each text."""
    hashes, bounds = word_hashes(texts)
    return [shingles(hashes[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of hashes, exactly."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    values, place = np.unique(both, return_inverse=True)
    x = np.bincount(place[: len(a)], minlength=len(values))
    y = np.bincount(place[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(documents: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """BagMinHash signatures (documents x places, uint32) of multisets of hashes; empty ones have zeros."""
    size = np.array([len(d) for d in documents], np.int64)
    if not size.sum():
        return np.zeros((len(documents), places), np.uint32)
    doc, value = np.repeat(np.arange(len(documents)), size), np.concatenate(documents)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    at = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]))
    weight = np.diff(np.concatenate([at, [len(value)]]))
    doc, value = doc[at], value[at]
    # one process per shingle and weight interval: [0, 1), then [2**(l-1), 2**l)
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1
    own = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(own)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.where(level == 0, 1, low).astype(np.float64)
    weight, doc = weight[own], doc[own]
    state = mix(value[own] + _GOLD * (level + 1).astype(np.uint64))
    time = np.zeros(len(doc))
    best, name = np.full((len(documents), places), np.inf), np.zeros((len(documents), places), np.uint64)
    flat_best, flat_name = best.ravel(), name.ravel()
    while len(doc):
        state = mix(state + _GOLD)
        time = time - np.log(_uniform(state)) / rate
        detail = mix(state ^ np.uint64(0xD1B54A32D192ED03))
        # a point's weight is uniform in its interval
        seen = low + _uniform(mix(detail)) * rate < weight
        slot = doc * places + (detail % np.uint64(places)).astype(np.int64)
        hit = np.flatnonzero(seen)
        hit = hit[time[hit] < flat_best[slot[hit]]]
        hit = hit[np.lexsort((time[hit], slot[hit]))]
        hit = hit[np.concatenate([[True], slot[hit][1:] != slot[hit][:-1]])] if len(hit) else hit
        flat_best[slot[hit]], flat_name[slot[hit]] = time[hit], detail[hit]
        stay = time < best.max(axis=1)[doc]
        doc, weight, state, time, low, rate = (x[stay] for x in (doc, weight, state, time, low, rate))
    out = (mix(name) >> np.uint64(32)).astype(np.uint32)
    out[size == 0] = 0
    return out


def _together(sets: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The sets in parts of few shingles; a large set is a part of its own."""
    part: list[np.ndarray] = []
    held = 0
    for one in sets:
        if part and held + len(one) > BATCH_SHINGLES:
            yield part
            part, held = [], 0
        part.append(one)
        held += len(one)
    if part:
        yield part


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, text_key, n (shingles) and signature (PLACES uint32)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n", pa.int64()), ("signature", pa.binary())])

    def run(batch: pa.RecordBatch) -> dict:
        sets = shingled(batch["text"])
        blobs = [s.tobytes() for part in _together(sets) for s in signatures(part)]
        return {"doc_id": batch["doc_id"], "text_key": batch["text_key"], "n": [len(s) for s in sets], "signature": blobs}

    keyed = docs.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"), "text")
    return keyed.mapInArrow(over_batches(run, schema), "doc_id long, text_key binary, n long, signature binary")


def _bands(signed: DataFrame) -> DataFrame:
    """doc_id, its number of shingles and the hash of each band."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("band", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict:
        table = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32).reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), table.shape[:2]).copy()
        for r in range(ROWS):
            key = mix(key * _GOLD + table[:, :, r])
        return {"doc_id": np.repeat(batch["doc_id"].to_numpy(), BANDS), "n": np.repeat(batch["n"].to_numpy(), BANDS), "band": key.astype(np.int64).ravel()}

    return signed.select("doc_id", "n", "signature").mapInArrow(over_batches(run, schema), "doc_id long, n long, band long")


def _bags(texts: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and bag, the sorted hashes of its shingles (uint64)."""
    schema = pa.schema([("doc_id", pa.int64()), ("bag", pa.binary())])

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"].to_pylist(), "bag": [np.sort(s).tobytes() for s in shingled(batch["text"])]}

    return texts.select("doc_id", "text").mapInArrow(over_batches(run, schema), "doc_id long, bag binary")


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose documents' multisets are alike; bags hold one row per id."""
    left = pairs.join(bags.select(F.col("doc_id").alias("b"), F.col("bag").alias("bag_b")), "b")
    both = left.join(bags.select(F.col("doc_id").alias("a"), F.col("bag").alias("bag_a")), "a")
    # the sizes alone bound the similarity
    sizes = F.least(F.octet_length("bag_a"), F.octet_length("bag_b")) >= threshold * F.greatest(F.octet_length("bag_a"), F.octet_length("bag_b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (c.to_pylist() for c in (batch["bag_a"], batch["bag_b"]))
            keep = pa.array([similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= threshold for p, q in zip(x, y, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep).cast(schema)
        give_back()

    return both.where(sizes).select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long")


def joining_links(bags: list[np.ndarray], group: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (places in bags) of similar multisets, left to right, that join what group and earlier links have not.

    One multiset is held against all its partners at once, over ranks of the hashes.
    """
    size = np.array([len(b) for b in bags], np.int64)
    values, rank = np.unique(np.concatenate(bags), return_inverse=True)
    entry, count = np.unique(np.repeat(np.arange(len(bags)), size) * len(values) + rank, return_counts=True)
    owner, rank = np.divmod(entry, len(values))
    at = np.searchsorted(owner, np.arange(len(bags) + 1))
    group, seen, links = group.copy(), np.zeros(len(values), np.int64), []
    for u in np.flatnonzero(left):
        to = right & (group != group[u]) & (np.minimum(size, size[u]) >= threshold * np.maximum(size, size[u]))
        if left[u] and right[u]:
            to[: u + 1] = False  # within a block each pair once
        to = np.flatnonzero(to)
        if not len(to):
            continue
        own = slice(at[u], at[u + 1])
        seen[rank[own]] = count[own]
        length = at[to + 1] - at[to]
        first = np.cumsum(length) - length
        pick_ = np.arange(length.sum()) + np.repeat(at[to] - first, length)
        both = np.add.reduceat(np.minimum(seen[rank[pick_]], count[pick_]), first)
        seen[rank[own]] = 0
        for v in to[both >= threshold * (size[u] + size[to] - both)]:
            if group[v] != group[u]:
                links.append((int(u), int(v)))
                group[group == group[v]] = group[u]
    return links


def _linked_in_bands(labelled: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(band, doc_id, n, root) -> links (a, b) that join unlike roots of a band.

    A band with roots of one kind needs nothing; of bands that hold the same documents one
    is looked at. A large band is cut into blocks by a hash of the id, and every two blocks
    meet in a task, so memory is bounded and a hot band is spread over many tasks.
    """
    marks = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"x{k}") for k in range(2)]
    kept = labelled.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("k"), F.sum("n").alias("t"), *marks).where("r0 <> r1")
    kept = kept.groupBy("x0", "x1", "k", "t").agg(F.min("band").alias("band"))
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK_DOCS, F.col("t") / BLOCK_SHINGLES)).cast("int")
    rows = labelled.join(kept.select("band", blocks.alias("blocks")), "band").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("doc_id", "root", "band", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(bags, "doc_id").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "doc_id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(held: list[tuple]) -> list[tuple[int, int]]:
        docs, roots, own, i, j, bags = zip(*held, strict=True)
        if len(set(roots)) == 1:
            return []
        own = np.array(own)
        found = joining_links([np.frombuffer(b, np.uint64) for b in bags], np.unique(roots, return_inverse=True)[1], own == i[0], own == j[0], threshold)
        return [(docs[u], docs[v]) for u, v in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def table(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], schema=schema)

        for batch in batches:
            found = []
            for band, *row in zip(*(batch[c].to_pylist() for c in ("band", "doc_id", "root", "own", "i", "j", "bag")), strict=True):
                now = (band, row[3], row[4])
                if now != key:
                    found += links(held) if held else []
                    key, held = now, []
                held.append(tuple(row))
            yield table(found)
        if held:
            yield table(links(held))
        give_back()

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least id of the same text), component_id (least id that links reach) and kept (it is the least itself).

    Words are `[^\\x20\\x09-\\x0D]+` of whole texts. A text of one to four words is one run; texts
    without words and null texts are alone, each in its own class, unless their id repeats. Rows
    that repeat an id are one document if their texts agree; else each row is matched and the id
    keeps the least component of them. Null ids come out alone. An empty table gives an empty result.
    """
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    small_batches(docs.sparkSession)
    real = base.where("doc_id is not null and text is not null")
    signed = written(sign(real), "signed")
    members = signed.where("n > 0")
    first = written(members.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")), "first")
    # a text goes by its least id, or by a number in the order of these where texts share one
    clash = not first.groupBy("doc_id").count().where("count > 1").isEmpty()
    first = first.withColumn("class_id", F.col("doc_id"))
    if clash:
        first = written(first.orderBy("doc_id", "text_key").withColumn("doc_id", F.monotonically_increasing_id()), "first")
    bands = _bands(first)
    shared = bands.groupBy("band").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    bands = written(bands.join(shared.drop("n"), "band").select("band", "doc_id", "n", "low"), "bands")
    pairs = bands.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    # only texts that share a band are looked at again
    need = first.join(bands.select("doc_id").distinct(), "doc_id", "left_semi").select("class_id", "text_key", "doc_id")
    texts = real.withColumnRenamed("doc_id", "class_id").join(need, "class_id").where(F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("text_key"))
    texts = texts.groupBy("doc_id").agg(F.first("text").alias("text")) if _repeats(signed) else texts
    bags = written(_bags(texts), "bags")
    links = written(_verified(pairs, bags, threshold), "links")
    roots = components(links)
    labelled = bands.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    more = written(_linked_in_bands(written(labelled, "labelled"), bags, threshold), "links")
    if not more.isEmpty():
        roots = components(links.union(more))
    classes = members.select("text_key", F.col("doc_id").alias("id")).join(first.select("text_key", F.col("doc_id").alias("node"), "class_id"), "text_key")
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if clash:
        named = named.join(first.select(F.col("doc_id").alias("root"), F.col("class_id").alias("least")), "root").withColumn("root", F.col("least"))
    named = named.groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.min("root").alias("component_id"))
    out = base.select("doc_id").join(named, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _repeats(signed: DataFrame) -> bool:
    """Whether some row of an id and a text is repeated."""
    return not signed.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

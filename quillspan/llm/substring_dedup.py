"""Substring dedup by repeated-phrase automata.

Passages that recur are confirmed first, compiled into sharded Aho-Corasick
automata over word numbers, and every document is streamed through the automaton
of its shard, which locates every occurrence.

The documents are dealt into chunks by a hash of doc_id and text; a chunk is also a shard of
the automata. Chunks talk by messages, so no hot passage meets in one task:

1. keys: each window of 13 words is named by its least 6-word hash (a minimiser, so
   equal windows have equal names); a chunk sends each name once, with its least doc_id.
2. reduce: names in two or more documents are confirmed. The chunk of the first
   document is told who asks for the passage; the others that the name recurs.
3. passages: the first document's chunk sends the confirmed passages to each asking chunk. What more
   than HOT chunks ask for goes to one chunk of each group of chunks, which passes it on to its group.
4. locate: a chunk compiles the passages it got, as blocks of 7 words at every seventh
   word (13 words always hold one whole block), streams its documents through the
   automaton and extends each hit, word by word, to the whole common run.

A window may share its name with an earlier document that lacks the window itself.
Such windows stay unresolved and go through the same four steps once more, named by
the hash of all 13 words. What is located has been compared word by word; a 64-bit
collision could only hide a window (about 1e-19 for each pair of windows).
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from functools import cached_property
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, coded_words, gram_hashes, hashes_of, pick, text_bytes

WINDOW = 13
GRAM = 6
BLOCK = (WINDOW + 1) // 2
#: Bytes of text in a chunk, the fewest chunks, and askers from which a passage is passed on by groups.
CHUNK_BYTES, LEAST_CHUNKS, HOT = 8 << 20, 64, 256

MESSAGE = pa.schema([("to", pa.int32()), ("kind", pa.string()), ("src", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("texts", pa.list_(pa.binary()))])
MESSAGE_SQL = "to int, kind string, src int, a binary, b binary, c binary, texts array<binary>"
RESULT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _messages(rows: list[tuple]) -> pa.Table:
    names = MESSAGE.names
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], MESSAGE.field(i).type) for i in range(len(names))], schema=MESSAGE)


def _u64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


class Chunk:
    """The documents of a chunk in order of doc_id: words, their hashes and the place of each document."""

    def __init__(self, table: pa.Table, *, hashed: bool = True, read: bool = True) -> None:
        """hashed: with the numbers of all words; read: with the places of words at all."""
        ids = table["doc_id"].combine_chunks().fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
        texts = pc.fill_null(table["text"].combine_chunks(), "")
        # by id, then text; the order of equal rows is all the same
        order = pc.sort_indices(pa.table({"i": pa.array(ids), "t": texts}), [("i", "ascending"), ("t", "ascending")])
        self.ids = ids[order.to_numpy()].astype(np.int64)
        self.null = pc.is_null(table["doc_id"].combine_chunks()).take(order).to_pylist() if (ids == NULL_ID).any() else None
        self.texts = texts.take(order)
        if not read:
            return
        if hashed:
            self.distinct, self.codes, self.start = coded_words(self.texts)
        else:
            self.start = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)

    @cached_property
    def words(self) -> list[list[bytes]]:
        return [t.split() for t in text_bytes(self.texts)]

    def hashes(self) -> np.ndarray:
        return hashes_of(self.distinct)[self.codes]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Place of every window in the joined words, and its document's place in the chunk."""
        n = np.maximum(np.diff(self.start) - WINDOW + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.empty(0, np.int64)
        return np.arange(n.sum()) - np.repeat(first, n) + np.repeat(self.start[:-1], n), doc

    def names(self, hashes: np.ndarray) -> np.ndarray:
        """For each place in the joined words, the least of the 6-word hashes of the window that starts there."""
        low = gram_hashes(hashes, GRAM)
        width, want = 1, WINDOW - GRAM + 1
        while width < want:
            step = min(width, want - width)
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
            width += step
        return low


def _key_messages(values: np.ndarray, docs: np.ndarray, ids: np.ndarray, chunk: int, n_chunks: int, kind: str) -> list[tuple]:
    """One row per bucket: its names in the chunk, the least doc_id of each, and whether more documents of the chunk have it."""
    if not len(values):
        return []
    order = np.argsort(values, kind="stable")  # documents ascend, so the first of a name is its least
    values, docs = values[order], docs[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(values)]]) - 1
    names, first = values[at], ids[docs[at]]
    more = first != ids[docs[last]]
    bucket = ((names >> np.uint64(20)) % np.uint64(n_chunks)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_chunks + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)):
        part = order[cuts[b] : cuts[b + 1]]
        low = first[part]
        small = low.astype(np.uint32) if len(low) and low.min() >= 0 and low.max() < 2**32 else low
        rows.append((int(b), kind, chunk, names[part].tobytes(), small.tobytes(), np.packbits(more[part]).tobytes(), None))
    return rows


def _reduce(table: pa.Table, kind: str, group: int, hot: int) -> pa.Table:
    """Confirms the names that two or more documents have; passes rows of other kinds on.

    Asks name the asking chunk, or for names that more than `hot` chunks ask for -1 - the number of its group.
    """
    rows = table.to_pylist()
    out = [tuple(r[n] for n in MESSAGE.names) for r in rows if r["kind"] not in ("key", "key2")]
    rows = [r for r in rows if r["kind"] == kind]
    if not rows:
        return _messages(out)
    names = np.concatenate([_u64(r["a"]) for r in rows])
    sizes = [len(r["a"]) // 8 for r in rows]
    first = np.concatenate([np.frombuffer(r["b"], np.uint32 if len(r["b"]) == 4 * n else np.int64).astype(np.int64) for r, n in zip(rows, sizes, strict=True)])
    more = np.concatenate([np.unpackbits(np.frombuffer(r["c"], np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)])
    chunk = np.repeat(np.array([r["src"] for r in rows], np.int32), sizes)
    order = np.lexsort((first, names))
    names, first, more, chunk = names[order], first[order], more[order], chunk[order]
    at = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    count = np.diff(np.concatenate([at, [len(names)]]))
    keep = np.repeat((count > 1) | (np.add.reduceat(more, at) > 0), count)
    origin = np.repeat(chunk[at], count)
    lead = np.zeros(len(names), bool)
    lead[at] = True
    asks = keep & (~lead | (more > 0))  # the first chunk asks itself only if it has more such documents
    crowded = np.repeat(np.add.reduceat(asks.astype(np.int64), at) > hot, count)
    asker = np.where(crowded, -1 - chunk // group, chunk).astype(np.int32)
    # a group asks once
    order = np.lexsort((asker, names))
    again = np.zeros(len(names), bool)
    again[order[1:]] = (names[order[1:]] == names[order[:-1]]) & (asker[order[1:]] == asker[order[:-1]]) & asks[order[1:]] & asks[order[:-1]]
    for what, rule, to, payload in (("seen", keep, chunk, None), ("ask", asks & ~again, origin, asker)):
        picked = np.flatnonzero(rule)
        picked = picked[np.argsort(to[picked], kind="stable")]
        targets, starts = np.unique(to[picked], return_index=True)
        for t, part in zip(targets, np.split(picked, starts[1:]), strict=True):
            out.append((int(t), what, -1, names[part].tobytes(), payload[part].tobytes() if payload is not None else None, None, None))
    return _messages(out)


def _gather(mail: pa.Table, kind: str, column: str = "a") -> list[bytes]:
    return [x for k, x in zip(mail["kind"].to_pylist(), mail[column].to_pylist(), strict=True) if k == kind]


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _first_holders(values: np.ndarray, docs: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Windows whose name the mail asks of this chunk, in the chunk's first document that has it."""
    hit = np.flatnonzero(_member(values, wanted))
    if not len(hit):
        return hit
    order = hit[np.argsort(values[hit], kind="stable")]
    at = np.flatnonzero(np.concatenate([[True], values[order][1:] != values[order][:-1]]))
    low = np.repeat(ids[docs[order[at]]], np.diff(np.concatenate([at, [len(order)]])))
    return np.sort(order[ids[docs[order]] == low])


def _passages(key: int, docs: pa.Table, mail: pa.Table, full: bool, group: int) -> pa.Table:
    """Sends each asking chunk, or the first chunk of each asking group, the runs of words that it asks for."""
    out = [tuple(r[n] for n in MESSAGE.names) for r in mail.to_pylist() if r["kind"] in (("cov",) if full else ("seen", "ask"))]
    asked = np.concatenate([_u64(x) for x in _gather(mail, "ask")] or [np.empty(0, np.uint64)])
    if not len(asked) or not docs.num_rows:
        return _messages(out)
    by = np.concatenate([np.frombuffer(x, np.int32) for x in _gather(mail, "ask", "b")])
    order = np.lexsort((by, asked))
    asked, by = asked[order], by[order]
    if full:
        # the first document of a window is never explained by an earlier one: its windows are among the open ones
        chunk = Chunk(docs, read=False)
        values, doc, at = (np.frombuffer(b"".join(_gather(mail, "open", c)), t) for c, t in (("a", np.uint64), ("b", np.int64), ("c", np.int64)))
    else:
        chunk = Chunk(docs)
        place, doc = chunk.windows()
        values, at = chunk.names(chunk.hashes())[place], place - chunk.start[doc]
    held = _first_holders(values, doc, chunk.ids, np.unique(asked))
    lo, hi = np.searchsorted(asked, values[held], "left"), np.searchsorted(asked, values[held], "right")
    count = hi - lo
    # (window, asking chunk) for every ask
    which = np.repeat(held, count)
    asker = by[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    order = np.lexsort((which, asker))
    which, asker = which[order], asker[order]
    split: dict[int, list[bytes]] = {}  # only documents that are asked for
    apart = (np.diff(at[which]) != 1) | (np.diff(asker) != 0) | (np.diff(doc[which]) != 0)
    cut = np.flatnonzero(np.concatenate([[True], apart])) if len(which) else np.empty(0, np.int64)
    ends = np.concatenate([cut[1:], [len(which)]]) - 1 if len(which) else cut
    sent: dict[int, tuple[list[int], list[bytes]]] = defaultdict(lambda: ([], []))
    for s, e in zip(cut.tolist(), ends.tolist(), strict=True):
        d = int(doc[which[s]])
        if d not in split:
            split[d] = chunk.texts[d].as_py().encode().split()
        ids, texts = sent[int(asker[s])]
        ids.append(int(chunk.ids[d]))
        texts.append(b" ".join(split[d][int(at[which[s]]) : int(at[which[e]]) + WINDOW]))
    out += [(c if c >= 0 else (-1 - c) * group, "pass" if c >= 0 else "relay", key, np.array(ids, np.int64).tobytes(), None, None, texts) for c, (ids, texts) in sent.items()]
    return _messages(out)


def _relay(key: int, mail: pa.Table, group: int, n_chunks: int) -> pa.Table:
    """Passes what is meant for a group on to each of its chunks; whoever did not ask finds the passage nowhere."""
    meant = pc.equal(mail["kind"], "relay")
    own = mail.filter(pc.invert(meant))
    rows = mail.filter(meant).to_pylist()
    copies = [(to, "pass", r["src"], r["a"], None, None, r["texts"]) for r in rows for to in range(key, min(key + group, n_chunks))]
    return pa.concat_tables([own.select(MESSAGE.names).cast(MESSAGE), _messages(copies)])


#: Words compared at once where a match is extended.
STRIDE = 32


class Shard:
    """The Aho-Corasick automaton of a chunk's passages, over numbers of words.

    A node of the automaton looks through its children in turn, so a word is spelt as digits
    of its number in base 64, every digit's place with letters of its own: no node has more
    than 64 children, and a match can only start at a word. Words of no passage are number 0.
    """

    def __init__(self, mail: pa.Table) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.found: list[list[tuple[int, str, int]]] = []
        blocks: dict[str, int] = {}
        first: dict[bytes, int] = {}
        for kind, ids, texts in zip(mail["kind"].to_pylist(), mail["a"].to_pylist(), mail["texts"].to_pylist(), strict=True):
            if kind == "pass":
                for origin, text in zip(np.frombuffer(ids, np.int64).tolist(), texts, strict=True):
                    first[text] = min(origin, first.get(text, origin))
        words = {w for text in first for w in text.split(b" ")}
        self.code = {w: k for k, w in enumerate(sorted(words), 1)}
        self.digits = size = 1
        while 64**self.digits <= len(words):
            self.digits = size = size + 1
        for text, origin in sorted(first.items(), key=lambda x: x[1]):
            own = self.spell(text.split(b" "))
            around: set[str] = set()
            for at in range(0, len(own) // size - BLOCK + 1, BLOCK):
                # a passage that repeats itself needs each block once for each neighbourhood
                near = own[max(0, at - WINDOW) * size : (at + BLOCK + WINDOW) * size]
                if len(near) == (BLOCK + 2 * WINDOW) * size:
                    if near in around:
                        continue
                    around.add(near)
                block = own[at * size : (at + BLOCK) * size]
                if block not in blocks:
                    blocks[block] = len(self.found)
                    self.automaton.add_word(block, len(self.found))
                    self.found.append([])
                self.found[blocks[block]].append((origin, own, at))
        if self.found:
            self.automaton.make_automaton()

    def letters(self, words: list[bytes]) -> np.ndarray:
        """The code points that spell each word (words x digits)."""
        number = np.fromiter(map(self.code.get, words, repeat(0)), np.int64, len(words))
        return np.stack([0x100 + 64 * d + (number >> (6 * d)) % 64 for d in reversed(range(self.digits))], axis=1).astype("<u4")

    def spell(self, words: list[bytes]) -> str:
        return self.letters(words).tobytes().decode("utf-32-le")

    def locate(self, doc_id: int, spelt: str) -> np.ndarray:
        """Which windows of a document, its words spelt, also start in a passage of a document with a smaller id."""
        size = self.digits
        n = len(spelt) // size
        located = bytearray(max(0, n - WINDOW + 1))
        if not located or not self.found:
            return np.frombuffer(located, np.uint8).astype(bool)
        need = WINDOW - BLOCK
        for end, block in self.automaton.iter(spelt):
            at = (end + 1) // size - BLOCK
            first, past = max(0, at - need), min(at + 1, len(located))
            if located.find(0, first, past) < 0:
                continue
            for origin, own, offset in self.found[block]:
                if origin >= doc_id:  # they ascend
                    break
                low = at - _common(spelt, at * size, own, offset * size, -size)
                high = at + BLOCK + _common(spelt, (at + BLOCK) * size, own, (offset + BLOCK) * size, size)
                if high - low >= WINDOW:
                    located[low : high - WINDOW + 1] = b"\1" * (high - low - WINDOW + 1)
                    if located.find(0, first, past) < 0:
                        break
        return np.frombuffer(located, np.uint8).astype(bool)


def _common(a: str, i: int, b: str, j: int, size: int) -> int:
    """How many words of `size` letters two spelt texts share from places i and j on; to the left for a negative size."""
    if size < 0:
        limit, step = min(i, j), -size * STRIDE
        k = 0
        while k + step <= limit and a[i - k - step : i - k] == b[j - k - step : j - k]:
            k += step
        while k - size <= limit and a[i - k + size : i - k] == b[j - k + size : j - k]:
            k -= size
        return k // -size
    limit, step = min(len(a) - i, len(b) - j), size * STRIDE
    k = 0
    while k + step <= limit and a[i + k : i + k + step] == b[j + k : j + k + step]:
        k += step
    while k + size <= limit and a[i + k : i + k + size] == b[j + k : j + k + size]:
        k += size
    return k // size


def _locate(key: int, docs: pa.Table, mail: pa.Table, n_chunks: int) -> pa.Table:
    """Locates the passages; the windows whose name recurs but that no passage explains are named anew, by all their words."""
    if not docs.num_rows or not mail.num_rows:
        return _messages([])
    chunk, shard = Chunk(docs), Shard(mail)
    seen = np.unique(np.concatenate([_u64(x) for x in _gather(mail, "seen")] or [np.empty(0, np.uint64)]))
    asked = np.unique(np.concatenate([_u64(x) for x in _gather(mail, "ask")] or [np.empty(0, np.uint64)]))
    place, doc = chunk.windows()
    letters, start = shard.letters(chunk.distinct), chunk.start.tolist()
    spelt = (letters[chunk.codes[a:b]].tobytes().decode("utf-32-le") for a, b in zip(start, start[1:], strict=False))
    located = np.concatenate([shard.locate(int(i), text) for i, text in zip(chunk.ids, spelt, strict=True)] or [np.zeros(0, bool)])
    hashes = chunk.hashes()
    values = chunk.names(hashes)[place]
    first = np.zeros(len(values), bool)
    first[_first_holders(values, doc, chunk.ids, asked)] = True
    open_ = np.flatnonzero(_member(values, seen) & ~located & ~first)
    whole = gram_hashes(hashes, WINDOW)[place[open_]]
    out = [(key, "cov", key, np.packbits(located).tobytes(), None, None, None)]
    # a note to itself: where the open windows are (document, word), so that the text need not be read anew
    out.append((key, "open", key, whole.tobytes(), doc[open_].astype(np.int64).tobytes(), (place[open_] - chunk.start[doc[open_]]).astype(np.int64).tobytes(), None))
    out += _key_messages(whole, doc[open_], chunk.ids, key, n_chunks, "key2")
    return _messages(out)


def _finish(docs: pa.Table, mail: pa.Table, with_text: bool) -> pa.Table:
    chunk = Chunk(docs, hashed=False)
    place, _ = chunk.windows()
    located = np.zeros(len(place), bool)
    for blob in _gather(mail, "cov"):
        located |= np.unpackbits(np.frombuffer(blob, np.uint8), count=len(place)).astype(bool)
    if "pass" in set(mail["kind"].to_pylist()):
        shard = Shard(mail)
        located |= np.concatenate([shard.locate(int(i), shard.spell(w)) for i, w in zip(chunk.ids, chunk.words, strict=True)])
    total = int(chunk.start[-1])
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, place[located], 1)
    np.add.at(edge, place[located] + WINDOW, -1)
    removed = np.cumsum(edge[:-1]) > 0
    columns: dict[str, list] = {n: [] for n in RESULT.names}
    for k, words in enumerate(chunk.words):
        gone = removed[chunk.start[k] : chunk.start[k + 1]]
        kept = b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        columns["row"].append(k)
        columns["doc_id"].append(None if chunk.null and chunk.null[k] else int(chunk.ids[k]))
        columns["n_words"].append(len(words))
        columns["n_removed"].append(int(gone.sum()))
        columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        columns["kept_text"].append(kept.decode("utf-8", "replace") if with_text else None)
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in RESULT], schema=RESULT)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, with_text: bool = True, chunk_bytes: int = CHUNK_BYTES, least_chunks: int = LEAST_CHUNKS, hot: int = HOT) -> DataFrame:
    """Removes from each document the words of every 13-word window that starts in a document with a smaller id.

    Words are `[^\\x20\\x09-\\x0D]+`, taken from whole texts; a null or empty text has none.
    Returns doc_id, n_words, n_removed, kept_sha256 and, with with_text, kept_text (the kept
    words joined by one space). One row per input row: rows that repeat an id are separate
    documents, none smaller than the other; a null id is larger than every id. An empty
    table gives an empty result; other columns of the input are not read.
    """
    spark = docs.sparkSession
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = int(max(least_chunks, -(-n_bytes // chunk_bytes)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_chunks // 2)
    # rows of one id may lie in several chunks: what a chunk's first document lacks is settled by the second round
    base = base.withColumn("to", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int")).repartition(parts, "to")

    def keys(key: tuple, table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        place, doc = chunk.windows()
        values = chunk.names(chunk.hashes())[place]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
        return _messages(_key_messages(values[new], doc[new], chunk.ids, key[0].as_py(), n_chunks, "key"))

    def both(function, schema: str, frame: DataFrame) -> DataFrame:  # noqa: ANN001
        return base.groupBy("to").cogroup(frame.groupBy("to")).applyInArrow(function, schema)

    group = math.isqrt(n_chunks - 1) + 1

    def passages(full: bool, mail: DataFrame) -> DataFrame:
        sent = both(lambda key, table, mail: _passages(key[0].as_py(), table, mail, full, group), MESSAGE_SQL, mail).repartition(parts, "to")
        if n_chunks <= hot:  # no name can have so many askers
            return sent
        return sent.groupBy("to").applyInArrow(lambda key, mail: _relay(key[0].as_py(), mail, group, n_chunks), MESSAGE_SQL).repartition(parts, "to")

    def reduce_(kind: str):  # noqa: ANN202
        return lambda key, table: _reduce(table, kind, group, hot)

    mail = base.groupBy("to").applyInArrow(keys, MESSAGE_SQL).repartition(parts, "to")
    mail = mail.groupBy("to").applyInArrow(reduce_("key"), MESSAGE_SQL).repartition(parts, "to")
    mail = passages(False, mail)
    mail = both(lambda key, table, mail: _locate(key[0].as_py(), table, mail, n_chunks), MESSAGE_SQL, mail).repartition(parts, "to")
    mail = mail.groupBy("to").applyInArrow(reduce_("key2"), MESSAGE_SQL).repartition(parts, "to")
    mail = passages(True, mail)
    out = both(lambda key, table, mail: _finish(table, mail, with_text), "row long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string", mail)
    return out.drop("row", *([] if with_text else ["kept_text"]))

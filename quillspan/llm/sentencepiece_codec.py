"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A word's symbols lie in one flat numpy array with those of many other words. A round
takes the least pair rank of every word (a segmented minimum), merges all leftmost
non-overlapping pairs of that rank at once, compacts the arrays and repeats until no
pair remains. Should a later round of a word meet a lower rank than one that it merged
in several places, one merge could have changed another; such words are done again
with one merge a round, which is the library's own order.

Text is cut where no piece of the model can cross (before a space mark that follows
another character, and at line ends), so that equal words are merged once.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lexicon, joined, over_batches, pick, small_batches, split_words, use_cache

SPACE = "▁"
#: Words merged together: their arrays stay in the processor's cache.
WORDS_AT_ONCE = 8_000
_NONE = np.iinfo(np.int32).max


class Codec:
    """Encodes and decodes like the library does with this model (no begin or end ids, no sampling)."""

    def __init__(self, model_path: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = {self.pieces[i]: i for i in range(n) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.byte_id = [byte_ids.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)]
        self.id_of = {self.pieces[i]: i for i in normal}
        # rank: 0 for the highest score; equal scores have equal ranks
        scores = np.array([sp.get_score(i) for i in normal])
        _, rank = np.unique(-scores, return_inverse=True)
        pairs: dict[int, tuple[int, int]] = {}
        self.stride = n + 0x110000
        chars = {x for i in normal for x in self.pieces[i]}
        symbol = {**{c: n + ord(c) for c in chars}, **self.id_of}
        for i, r in zip(normal, rank.tolist(), strict=True):
            piece = self.pieces[i]
            for k in range(1, len(piece)):
                a, b = symbol.get(piece[:k]), symbol.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * self.stride + b] = (r, i)
        self._build_table(pairs)
        self.char_symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        for c in chars:
            if c in self.id_of:
                self.char_symbol[ord(c)] = self.id_of[c]
        inner = {c for i in normal if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        crossing = any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal)
        # a cut before a space mark, around a line end or between a letter and a stop is safe only if no piece crosses it
        line = "" if "\n" in inner else "\n"
        stops = "".join(c for c in ".," if not any(re.search(rf"[a-zA-ZÀ-ɏ][{c}]|[{c}][{SPACE}]", self.pieces[i]) for i in normal))
        word = rf"{SPACE}*[a-zA-ZÀ-ɏ]+(?=[{stops}])|" if stops else ""
        self.cut = None if crossing else re.compile(rf"{word}[{stops}]+(?=[{SPACE}{line}]|$)|" * bool(stops) + (rf"{line}+|" if line else "") + rf"{SPACE}*[^{SPACE}{line}]+|{SPACE}+")
        self.n = n
        self.pieces_ids = Lexicon(self._piece_ids)
        self.decimal = pa.array([f"{i}," for i in range(n)], pa.large_string())
        self.id_bytes = [x.replace(SPACE, " ").encode() for x in self.pieces]
        for b, i in enumerate(self.byte_id):
            if i != sp.unk_id():
                self.id_bytes[i] = bytes([b])
        self.byte_text = pa.array(self.id_bytes, pa.large_binary())
        self.plain = np.ones(n, bool)
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i):
                self.plain[i] = False

    def _build_table(self, pairs: dict[int, tuple[int, int]]) -> None:
        """A hash table of the pairs with linear probing; the last slots are spare, so that probes need not wrap."""
        self.shift = np.uint64(64 - max(10, (4 * len(pairs)).bit_length()))
        keys = np.array(list(pairs), np.int64)
        size = (1 << (64 - int(self.shift))) + 64
        self.keys, self.ranks, self.merged = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        for key, slot in zip(keys.tolist(), self._slot(keys).tolist(), strict=True):
            while self.keys[slot] != -1:
                slot += 1
            self.keys[slot] = key
            self.ranks[slot], self.merged[slot] = pairs[key]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.stride + right
        slot = self._slot(key)
        held = self.keys[slot]
        ask = np.flatnonzero((held != key) & (held != -1))
        while len(ask):
            slot[ask] += 1
            held = self.keys[slot[ask]]
            ask = ask[(held != key[ask]) & (held != -1)]
        # an empty slot holds no rank
        return self.ranks[slot], self.merged[slot]

    def merge_words(self, words: list[str], *, one_by_one: bool = False) -> list[list[int]]:
        """The symbols of each word after all merges, as ids."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, word = self.char_symbol[codes], np.repeat(np.arange(len(words)), lengths)
        out: list[list[int]] = [[] for _ in words]
        last = np.full(len(words), -1, np.int32)  # the highest rank merged in several places
        again: set[int] = set()
        rank = piece = None
        while len(symbols):
            joined = word[:-1] == word[1:]
            if rank is None:
                rank, piece = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int64)
                at = np.flatnonzero(joined)
                rank[at], piece[at] = self._pairs(symbols[at], symbols[at + 1])
            starts = np.flatnonzero(np.concatenate([[True], ~joined]))
            low = np.minimum.reduceat(rank, starts)
            owner, size = word[starts], np.diff(np.concatenate([starts, [len(symbols)]]))
            done = low == _NONE
            if done.any():
                for w, s, k in zip(owner[done].tolist(), starts[done].tolist(), size[done].tolist(), strict=True):
                    out[w] = symbols[s : s + k].tolist()
                stay = np.repeat(~done, size)
                symbols, word, rank, piece = symbols[stay], word[stay], rank[stay], piece[stay]
                if not len(symbols):
                    break
                owner, size, low = owner[~done], size[~done], low[~done]
                starts = np.cumsum(size) - size
            back = low < last[owner]
            if back.any():
                again.update(owner[back].tolist())
            least = np.repeat(low, size)
            hit = np.flatnonzero(rank == least)
            if one_by_one:
                hit = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])]
            else:
                # in a run of touching pairs every second one merges, from the left
                fresh = np.concatenate([[True], (np.diff(hit) != 1) | (word[hit][1:] != word[hit][:-1])])
                first = hit[np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))]
                hit = hit[(hit - first) % 2 == 0]
                many = np.bincount(np.searchsorted(starts, hit, "right") - 1, minlength=len(owner)) > 1
                last[owner[many]] = np.maximum(last[owner[many]], low[many])
            symbols[hit] = piece[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            touched = np.zeros(len(symbols), bool)
            touched[hit] = True
            touched[np.maximum(hit - 1, 0)] = True
            symbols, word, rank, piece, touched = symbols[keep], word[keep], rank[keep], piece[keep], touched[keep]
            # the pair that ends in a merged symbol starts one to its left
            at = np.flatnonzero(touched)
            at = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
            rank[at] = _NONE
            at = at[at < len(symbols) - 1]
            at = at[word[at] == word[at + 1]]
            rank[at], piece[at] = self._pairs(symbols[at], symbols[at + 1])
        if again:
            redo = sorted(again)
            for w, ids in zip(redo, self.merge_words([words[i] for i in redo], one_by_one=True), strict=True):
                out[w] = ids
            return out if one_by_one else [self._ids(x) if i not in again else x for i, x in enumerate(out)]
        return [self._ids(x) for x in out]

    def _ids(self, symbols: list[int]) -> list[int]:
        if not symbols or max(symbols) < self.n:
            return symbols
        return [i for s in symbols for i in ([s] if s < self.n else [self.byte_id[b] for b in chr(s - self.n).encode("utf-8", "surrogatepass")])]

    def words(self, text: str) -> list[str]:
        """The parts of a text, its spaces marked, that merges never leave."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return self.cut.findall(text) if self.cut else [text]

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids (little-endian int32) of space-delimited pieces, each behind a space."""
        cut = [self.words(p) if p else [SPACE] for p in pieces]
        new = sorted({w for words in cut for w in words}, key=len)
        ids: dict[str, bytes] = {}
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            ids.update(zip(part, (np.array(x, "<i4").tobytes() for x in self.merge_words(part)), strict=True))
        return [ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words]) for words in cut]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each whole text; a null or empty text has none."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        # spaces that touch, or a space mark in the text itself, would join pieces
        odd = pc.match_substring_regex(texts, f"  |^ | $|{SPACE}") if self.cut else full
        plain = np.flatnonzero(pc.and_not(full, pc.fill_null(odd, False)).to_numpy(zero_copy_only=False))
        if len(plain):
            distinct, codes, bounds = split_words(texts.take(pa.array(plain)))
            for k, ids in zip(plain.tolist(), joined(self.pieces_ids(distinct.to_pylist()), codes, bounds), strict=True):
                out[k] = np.frombuffer(ids, "<i4")
        for k in np.flatnonzero(pc.and_(full, pc.fill_null(odd, False)).to_numpy(zero_copy_only=False)).tolist():
            words = self.words(texts[k].as_py())
            new = list(dict.fromkeys(words))
            ids = {w: x for at in range(0, len(new), WORDS_AT_ONCE) for w, x in zip(new[at : at + WORDS_AT_ONCE], self.merge_words(new[at : at + WORDS_AT_ONCE]), strict=True)}
            out[k] = np.fromiter(chain.from_iterable(map(ids.__getitem__, words)), np.int32)
        return out

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        if not len(ids):
            return b""
        _, places, data = self.decimal.take(pa.array(ids)).buffers()
        return memoryview(data)[: int(np.frombuffer(places, np.int64)[len(ids)]) - 1]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; what is not plain pieces or valid bytes is left to the library."""
        if not len(ids):
            return ""
        ids = np.asarray(ids, np.int64)
        if not self.plain[ids].all():
            return self.library.decode(ids.tolist())
        _, places, data = self.byte_text.take(pa.array(ids)).buffers()
        try:
            text = bytes(memoryview(data)[: int(np.frombuffer(places, np.int64)[len(ids)])]).decode()
        except UnicodeDecodeError:
            return self.library.decode(ids.tolist())
        return text[1:] if self.pieces[ids[0]].startswith(SPACE) else text


@lru_cache(maxsize=2)
def _codec(model_path: str) -> Codec:
    return Codec(model_path)


def codec(model_path: str) -> Codec:
    use_cache("pieces", _codec.cache_clear)
    return _codec(model_path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, n_tokens and the outputs asked for: ids (array), decoded (text), ids_sha256, decoded_sha256.

    One row per input row, repeated rows included, in no stated order. A null or empty text
    encodes to no ids and decodes to an empty text; a null id stays null. Whole texts are
    encoded whatever their length. Other columns of the input are not read.
    """
    kinds = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    sql = {"ids": "array<int>"}
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((o, kinds[o]) for o in outputs)])

    def run(batch: pa.RecordBatch) -> dict:
        tool = codec(model_path)
        out: dict[str, list] = {f.name: [] for f in schema}
        out["doc_id"] = batch["doc_id"]
        for ids in tool.encode(batch["text"]):
            out["n_tokens"].append(len(ids))
            if "ids" in out:
                out["ids"].append(ids)
            if "ids_sha256" in out:
                out["ids_sha256"].append(hashlib.sha256(tool.listed(ids)).hexdigest())
            if "decoded" in out or "decoded_sha256" in out:
                text = tool.decode(ids)
                if "decoded" in out:
                    out["decoded"].append(text)
                if "decoded_sha256" in out:
                    out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
        return out

    small_batches(docs.sparkSession)
    columns = ", ".join(f"{f.name} {sql.get(f.name, 'long' if f.type == pa.int64() else 'string')}" for f in schema)
    return pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(over_batches(run, schema), columns)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that its ids stand for; null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batch: pa.RecordBatch) -> dict:
        tool = codec(model_path)
        return {"doc_id": batch["doc_id"].to_pylist(), "text": [tool.decode(x or []) for x in batch["ids"].to_pylist()]}

    return pick(encoded, doc_id=id_col, ids=ids_col).mapInArrow(over_batches(run, schema), "doc_id long, text string")

"""Language ID by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read the bytes of a text, one from each end; from both states
every position is labelled, and a document's probabilities are the means over all of its
positions. Long texts are read in windows of WINDOW bytes, each with CONTEXT bytes on
either side that only warm up the states: states run on across words, every byte is
labelled once, and texts of any length take bounded memory. The network is trained in
numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import give_back, pick, slices, small_batches

#: The most documents a language is learned from, the most for all languages together, and the characters taken of each.
DOCS_PER_LANGUAGE, DOCS, EXCERPT = 400, 40_000, 4_000
#: Languages up to which their shares of the sample, a short row each, are broadcast.
BROADCAST_LANGUAGES = 100_000
#: Bytes that a window labels, and those on either side that it reads besides.
WINDOW, CONTEXT = 512, 24
#: Windows that are read together, and the most label values held for them.
WINDOWS_AT_ONCE, VALUES_AT_ONCE = 1024, 1 << 23
#: Bytes of a text in training, and the units of either direction.
TRAIN_BYTES, HIDDEN = 80, 12
UNKNOWN = "und"


def _reversed(a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each column (T x B or more) read from its own end; what lies behind a column's size stays in place."""
    t = np.arange(len(a))[:, None]
    return a[np.where(t < size, size - 1 - t, t), np.arange(a.shape[1])]


@dataclass
class Network:
    """Weights: for each direction, byte inputs (256 x 3H), recurrent (H x 3H); output (2H x L) and its bias."""

    labels: list[str]
    wx: list[np.ndarray]
    wh: list[np.ndarray]
    wo: np.ndarray
    bo: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
        return cls(labels, [small(256, 3 * hidden) for _ in "fb"], [small(hidden, 3 * hidden) for _ in "fb"], small(2 * hidden, len(labels)), np.zeros(len(labels), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.wx, *self.wh, self.wo, self.bo]

    def states(self, text: np.ndarray, way: int) -> tuple[np.ndarray, list]:
        """States (T x B x H) of one direction over bytes (T x B) in the order of reading, and what backpropagation needs."""
        wx, wh = self.wx[way], self.wh[way]
        hidden = len(wh)
        h, out, kept = np.zeros((text.shape[1], hidden), wh.dtype), np.empty((*text.shape, hidden), wh.dtype), []
        for t, row in enumerate(text):
            x, u = wx[row], h @ wh
            gates = 0.5 * np.tanh(0.5 * (x[:, : 2 * hidden] + u[:, : 2 * hidden])) + 0.5
            z, r, uc = gates[:, :hidden], gates[:, hidden:], u[:, 2 * hidden :]
            c = np.tanh(x[:, 2 * hidden :] + r * uc)
            kept.append((h, z, r, c, uc))
            h = out[t] = h + z * (c - h)
        return out, kept

    def gradients(self, text: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of the positions and its gradients, by backpropagation through time."""
        hidden, mask = self.wh[0].shape[0], np.arange(len(text))[:, None] < size
        read = [text, _reversed(text, size)]
        runs = [self.states(read[way], way) for way in (0, 1)]
        both = np.concatenate([runs[0][0], _reversed(runs[1][0], size)], axis=2)
        logits = both @ self.wo + self.bo
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        n = mask.sum()
        hot = np.eye(len(self.labels), dtype=self.wo.dtype)[label]
        loss = float(-(np.log((p * hot[None]).sum(axis=2) + 1e-9) * mask).sum() / n)
        d = ((p - hot[None]) * mask[:, :, None] / n).astype(self.wo.dtype)
        d_wo, d_bo = np.tensordot(both, d, ([0, 1], [0, 1])), d.sum(axis=(0, 1))
        d_both = d @ self.wo.T
        d_wx, d_wh = [], []
        order = [np.argsort(x, axis=None, kind="stable") for x in read]
        for way, d_out in ((0, d_both[:, :, :hidden]), (1, _reversed(d_both[:, :, hidden:], size))):
            wh = self.wh[way]
            d_h, d_x, own = np.zeros((text.shape[1], hidden), wh.dtype), np.empty((*text.shape, 3 * hidden), wh.dtype), np.zeros_like(wh)
            for t in range(len(text) - 1, -1, -1):
                h, z, r, c, uc = runs[way][1][t]
                d_new = d_h + d_out[t]
                d_c = d_new * z * (1 - c * c)
                d_x[t] = np.concatenate([d_new * (c - h) * z * (1 - z), d_c * uc * r * (1 - r), d_c], axis=1)
                d_u = d_x[t].copy()
                d_u[:, 2 * hidden :] *= r
                own += h.T @ d_u
                d_h = d_new * (1 - z) + d_u @ wh.T
            bytes_ = read[way].ravel()[order[way]]
            starts = np.flatnonzero(np.concatenate([[True], bytes_[1:] != bytes_[:-1]]))
            inputs = np.zeros_like(self.wx[way])
            inputs[bytes_[starts]] = np.add.reduceat(d_x.reshape(-1, 3 * hidden)[order[way]], starts, axis=0)
            d_wx.append(inputs)
            d_wh.append(own)
        return loss, [*d_wx, *d_wh, d_wo, d_bo]

    def label(self, text: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The probabilities of every position (T x B x L); those behind a column's size mean nothing.

        Both directions step at once, each column from its own first and last byte.
        """
        steps, many = text.shape
        hidden, classes = self.wh[0].shape[0], len(self.labels)
        # update, reset and candidate apart (3 x 2 directions), so that each is one run of memory; halved where a gate is half a tanh
        half = np.array([0.5, 0.5, 1], np.float32)[:, None, None, None]
        cut = lambda ws: np.ascontiguousarray(np.stack(ws).reshape(2, -1, 3, hidden).transpose(2, 0, 1, 3) * half)
        wx, wh = cut(self.wx), cut(self.wh)
        wo = np.stack([self.wo[:hidden], self.wo[hidden:]])
        read = [text, _reversed(text, size)]
        x, u = np.empty((3, 2, many, hidden), np.float32), np.empty((3, 2, many, hidden), np.float32)
        h, c = np.zeros((2, many, hidden), np.float32), np.empty((2, many, hidden), np.float32)
        logits = np.empty((steps, 2, many, classes), np.float32)
        gates, (z, r, uc), xc = u[:2], u, x[2]
        for t in range(steps):
            for way in (0, 1):
                place = read[way][t].astype(np.intp)
                for k in range(3):
                    np.take(wx[k, way], place, axis=0, out=x[k, way], mode="clip")
            np.matmul(h, wh, out=u)
            gates += x[:2]
            np.tanh(gates, out=gates)
            gates += 1
            # gates are twice themselves here
            np.multiply(r, uc, out=c)
            c *= 0.5
            c += xc
            np.tanh(c, out=c)
            c -= h
            c *= z
            c *= 0.5
            h += c
            np.matmul(h, wo, out=logits[t])
        back = _reversed(logits[:, 1], size)
        # a label after the other, so that no sum runs over a few neighbours
        p = np.empty((classes, steps, many), np.float32)
        for k in range(classes):
            np.add(logits[:, 0, :, k], back[:, :, k], out=p[k])
            p[k] += self.bo[k]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p.transpose(1, 2, 0)


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (T x B) of some texts, filled up with zeros, and their sizes."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(w.ljust(int(size.max()), b"\0") for w in texts), np.uint8).reshape(len(texts), -1).T, size


def train(samples: dict[str, list[bytes]], *, hidden: int = HIDDEN, steps: int = 400, batch: int = 128, seed: int = 11) -> Network:
    """Learns to label positions of texts by language (Adam; each batch holds the languages evenly)."""
    labels = sorted(samples)
    rng = np.random.default_rng(seed)
    texts = [[t for t in samples[lang] if t] or [b"?"] for lang in labels]
    net = Network.fresh(labels, hidden, seed)
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1 if len(labels) > 1 else 1):
        label = rng.integers(0, len(labels), batch)
        chosen = []
        for k in label:
            text = texts[k][int(rng.integers(len(texts[k])))]
            at = int(rng.integers(max(1, len(text) - TRAIN_BYTES + 1)))
            chosen.append(text[at : at + int(rng.integers(8, TRAIN_BYTES + 1))])
        _, grads = net.gradients(*packed(chosen), label)
        rate = 0.01 * (1 - 0.9 * step / steps)
        for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def pooled(net: Network, texts: pa.Array) -> np.ndarray:
    """Mean probabilities over all bytes of each text (zeros if it has none)."""
    whole = pc.fill_null(texts.cast(pa.binary()), b"")
    _, places, data = whole.buffers()
    ends = np.frombuffer(places, np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    length = np.diff(ends)
    count = -(-length // WINDOW)
    owner = np.repeat(np.arange(len(length)), count)
    low = ends[:-1][owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    high = np.minimum(low + WINDOW, ends[1:][owner])
    start, stop = np.maximum(low - CONTEXT, ends[:-1][owner]), np.minimum(high + CONTEXT, ends[1:][owner])
    sums = np.zeros((len(length), len(net.labels)))
    order = np.argsort(stop - start, kind="stable")
    at = 0
    while at < len(order):
        some = order[at : at + WINDOWS_AT_ONCE]
        some = some[: max(16, VALUES_AT_ONCE // (len(net.labels) * int((stop - start)[some].max())))]
        at += len(some)
        size = (stop - start)[some]
        t = np.arange(size.max())[:, None]
        p = net.label(raw[np.minimum(start[some] + t, stop[some] - 1)], size)
        inside = (t >= (low - start)[some]) & (t < (high - start)[some])
        whole = inside.astype(np.float32)
        np.add.at(sums, owner[some], np.stack([np.einsum("tb,tb->b", p[:, :, k], whole, dtype=np.float64) for k in range(p.shape[2])], axis=1))
    return sums / np.maximum(length, 1)[:, None]


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = DOCS_PER_LANGUAGE, most_docs: int = DOCS, excerpt: int = EXCERPT) -> Network:
    """Trains on a bounded sample: about per_language documents of each language that have a letter (fewer where all
    languages together would have more than most_docs, but at least eight), chosen by a hash of the id among those
    that aren't held out (crc32 of the id as text, mod 3, is 1), and of each at most `excerpt` characters from a
    place that the hash draws.

    Every language is learned. Rows without a language, id or text teach nothing; without any other
    row the network knows no language, and all documents come out as `und`.
    """
    base = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null and doc_id is not null")
    base = base.where(~held_out()).where(F.col("lang") != UNKNOWN)
    counts = {r["lang"]: r["count"] for r in base.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return Network.fresh([], 4, 0)
    spark = docs.sparkSession
    want = max(8, min(per_language, most_docs // len(counts)))
    shares = spark.createDataFrame([(k, min(1.0, want / n)) for k, n in counts.items()], "lang string, share double")
    shares = F.broadcast(shares) if len(counts) <= BROADCAST_LANGUAGES else shares
    chance = (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    h = F.xxhash64(F.lit(8), "doc_id")
    place = F.pmod(h, F.greatest(F.length("text") - excerpt, F.lit(0)) + 1).cast("int") + 1
    rows = base.join(shares, "lang").where(chance < F.col("share")).where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.substring("text", place, F.lit(excerpt)).alias("text"), h.alias("h"), "doc_id")
    rows = rows.orderBy("h", "doc_id", "lang", "text").limit(2 * want * len(counts)).collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["doc_id"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return train(samples) if samples else Network.fresh([], 4, 0)


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predicted(net: Network, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each whole text and its pooled probability; `und` and 0 without a letter."""
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not net.labels:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    p = pooled(net, texts)
    best = p.argmax(axis=1)
    score = np.clip(p[np.arange(len(p)), best], 0, 1) * letters
    return [net.labels[k] if known else UNKNOWN for k, known in zip(best.tolist(), letters.tolist(), strict=True)], score


def identify_languages(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every whole text; `und` and 0 where it is null or has no letter.

    One row per input row; a null id is never held out. Only the text is read to predict.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, score = predicted(net, part["text"])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(lang, pa.string()), pa.array(score)], schema=RESULT)
        give_back()

    small_batches(docs.sparkSession)
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", held_out())
    return base.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows as they are, with a struct `__language` (lang_pred, score) beside them."""
    small_batches(docs.sparkSession)
    schema = StructType([*docs.schema.fields, StructField("__language", StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                lang, score = predicted(net, part.column(place))
                found = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "__language"])
        give_back()

    return docs.mapInArrow(run, schema)

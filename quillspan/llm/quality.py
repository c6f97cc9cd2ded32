"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation
maximisation over the counts of vote patterns of all documents estimates each labeller's
accuracy without any gold label, under Beta priors that the counts outweigh; the posteriors
of the patterns then label a bounded sample, on which a linear scorer over hashed words and
shape features is trained. It scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, give_back, pick, slices, small_batches, text_bytes, use_cache, written

#: Slots of hashed words, and documents that the scorer is trained on.
SLOTS, TRAINED_ON = 1 << 15, 4000
#: Abuse that no good text is full of (fixed values).
ABUSE = frozenset(b"idiot idiots scum moron morons pathetic disgusting worthless clown clowns filthy stupid vermin trash loser losers".split())
LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
EDGES = b".,;:!?\"'()[]{}<>*#%&$"


def shape(text: bytes, words: list[bytes]) -> list[float]:
    """Shape features of a text, none of which depends on its language."""
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * 9
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = size - len(text.translate(None, MARKS))
    upper = size - len(text.translate(None, LETTERS[26:]))
    lower = size - len(text.translate(None, LETTERS[:26]))
    digits = size - len(text.translate(None, b"0123456789"))
    bare = sum(not w.translate(None, MARKS) for w in words if len(w) < 4)
    abuse = sum(w.strip(EDGES).lower() in ABUSE for w in words)
    return [marks / size, upper / max(1, upper + lower), digits / size, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(words)) / n, (size - n) / n, abuse / n, bare / n, float(n)]


def votes(features: list[float]) -> list[int]:
    """Each labeller's vote: 1 good, 0 bad, -1 none."""
    marks, upper, digits, lines, repeats, length, abuse, bare, n = features

    def by(value: float, good: float, bad: float) -> int:
        return 1 if value <= good else 0 if value >= bad else -1

    return [
        by(marks, 0.05, 0.1),
        by(upper, 0.1, 0.35) if n >= 5 else -1,
        by(digits, 0.05, 0.25),
        by(lines, 0.1, 0.5),
        by(repeats, 0.6, 0.75) if n >= 50 else -1,
        1 if 3 <= length <= 12 else 0 if length < 2 or length > 20 else -1,
        by(abuse, 0.0, 0.01) if n >= 20 else -1,
        by(bare, 0.05, 0.2),
        1 if n >= 40 else 0 if n < 2 else -1,
    ]


LABELLERS = 9
#: Priors of the label model: mean share of bad votes on good texts, on a labeller's own kind of bad text and on other
#: kinds; mean share of good texts; and how many documents each prior weighs, as a share of all.
FALSE_ALARM, CAUGHT, OVERLAP, GOOD, PRIOR_WEIGHT = 0.005, 0.8, 0.05, 0.8, 0.02


@dataclass
class LabelModel:
    """Classes: good texts, then a kind of bad text for each labeller. Their shares, and P(bad vote | class) by labeller."""

    shares: np.ndarray
    table: np.ndarray

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """P(class) for vote rows; a labeller that says nothing tells nothing."""
        bad, good = (patterns == 0).astype(float), (patterns == 1).astype(float)
        odds = np.log(self.shares) + bad @ np.log(self.table.T) + good @ np.log1p(-self.table.T)
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) for vote rows."""
        return self.classes(patterns)[:, 0] if len(patterns) else np.empty(0)

    def rates(self) -> np.ndarray:
        """Each labeller's share of bad votes on good texts, and on bad ones of all kinds."""
        kinds = self.shares[1:] / self.shares[1:].sum()
        return np.stack([self.table[0], kinds @ self.table[1:]])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, *, weight: float = PRIOR_WEIGHT) -> LabelModel:
    """Expectation maximisation over vote patterns and their counts, to the posterior mode under Beta and Dirichlet priors.

    Each labeller looks for one kind of bad text, and labellers overlap: a text of one kind
    may be voted bad by the labellers of others too. So bad texts are a mixture of as many
    kinds as there are labellers; with one class for all of them, votes of those that look for
    other kinds would outvote the one that sees it. The priors say that labellers are
    precise; they weigh as much as a share `weight` of the documents, at every size, and no rate
    is bounded.
    """
    total, kinds = max(1.0, float(counts.sum())), patterns.shape[1]
    means = np.concatenate([np.full((1, kinds), FALSE_ALARM), np.where(np.eye(kinds, dtype=bool), CAUGHT, OVERLAP)])
    shares = np.concatenate([[GOOD], np.full(kinds, (1 - GOOD) / kinds)])
    own = weight * total * shares
    model = LabelModel(shares, means)
    bad, told = (patterns == 0).astype(float), (patterns >= 0).astype(float)
    for _ in range(rounds):
        held = model.classes(patterns) * counts[:, None]
        table = (held.T @ bad + own[:, None] * means) / (held.T @ told + own[:, None])
        moved = np.abs(table - model.table).max()
        model = LabelModel((held.sum(axis=0) + own) / (total + own.sum()), table)
        if moved < 1e-7:
            break
    return model


class Slots(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.strip(EDGES).lower()) % SLOTS
        return value


SLOT = Slots()
N_SHAPE = 8


def _inputs(features: list[float], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words, and the shape inputs in [0, 1]."""
    marks, upper, digits, lines, repeats, length, abuse, bare, n = features
    shaped = np.array([min(1, 5 * marks), upper, min(1, 3 * digits), lines, repeats, min(1, 50 * abuse), bare, 1 / (1 + n / 10)])
    return np.fromiter(map(SLOT.__getitem__, words), np.int64, len(words)), shaped


def _sparse(features: list[float], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's inputs: shares of the slots, shape, bias."""
    slots, shaped = _inputs(features, words)
    place, count = np.unique(slots, return_counts=True)
    return np.concatenate([place, np.arange(SLOTS, SLOTS + N_SHAPE + 1)]), np.concatenate([count / max(1, len(words)), shaped, [1.0]])


def train(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, *, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Weights of the linear scorer (SLOTS, then shape, then bias) from places and values: logistic loss on soft labels, AdaGrad."""
    rng = np.random.default_rng(seed)
    weights, seen = np.zeros(SLOTS + N_SHAPE + 1), np.full(SLOTS + N_SHAPE + 1, 1e-6)
    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            at, x = rows[k]
            p = 1 / (1 + np.exp(-np.clip(weights[at] @ x, -30, 30)))
            grad = (p - label[k]) * x + 1e-5 * weights[at]
            seen[at] += grad * grad
            weights[at] -= 0.2 * grad / np.sqrt(seen[at])
    return weights


def _vote_code(votes_: list[int]) -> int:
    code = 0
    for v in votes_:
        code = code * 3 + v + 1
    return code


def _patterns(codes: list[int]) -> np.ndarray:
    return np.array([[c // 3 ** (LABELLERS - 1 - k) % 3 - 1 for k in range(LABELLERS)] for c in codes]).reshape(-1, LABELLERS)


def classify_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, trained_on: int = TRAINED_ON, keep_from: float = 0.5) -> DataFrame:
    """doc_id, score (probability of good, 0 to 1), weak_label (the label model's posterior) and kept (score >= keep_from).

    The vote patterns of all documents are counted; the scorer is trained on at most trained_on
    distinct documents, chosen by a hash of id and text. Null and empty texts have score 0 and are not kept.
    Rows that repeat an id are scored each by itself; null ids are scored too. An empty table
    gives an empty result.
    """
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    small_batches(docs.sparkSession)
    voted_schema = pa.schema([("h", pa.int64()), ("code", pa.int32())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codes = [_vote_code(votes(shape(t, t.split()))) for t in text_bytes(part["text"])]
                yield pa.RecordBatch.from_arrays([part["h"], pa.array(codes, pa.int32())], schema=voted_schema)

    h = F.xxhash64(F.lit(21), "doc_id", "text")
    voted = written(base.select(h.alias("h"), "text").mapInArrow(vote, "h long, code int"), "votes")
    counts = voted.groupBy("code").count().collect()  # at most 3**LABELLERS patterns
    spark = docs.sparkSession
    if not counts:
        return spark.createDataFrame([], "doc_id long, score double, weak_label double, kept boolean")
    codes = sorted((r["code"], r["count"]) for r in counts)
    patterns, n = _patterns([c for c, _ in codes]), np.array([k for _, k in codes], float)
    model = estimate(patterns, n)
    least = voted.select("h").orderBy("h").limit(trained_on).agg(F.max("h")).first()[0]
    sparse_schema = pa.schema([("h", pa.int64()), ("code", pa.int32()), ("place", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cut = [(t, t.split()) for t in text_bytes(part["text"])]
                shapes = [shape(t, words) for t, words in cut]
                rows = [_sparse(f, words) for f, (_, words) in zip(shapes, cut, strict=True)]
                yield pa.RecordBatch.from_arrays([part["h"], pa.array([_vote_code(votes(f)) for f in shapes], pa.int32()), pa.array([p for p, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float64()))], schema=sparse_schema)

    # whole texts become at most SLOTS shares each on the executors; rows of one hash are the same row's copies
    sample = base.withColumn("h", h).where(F.col("h") <= least).select("h", "text").groupBy("h").agg(F.first("text").alias("text"))
    sample = sorted(sample.mapInArrow(inputs, "h long, code int, place array<int>, value array<double>").collect(), key=lambda r: r["h"])
    label = model.posterior(_patterns([r["code"] for r in sample]))
    weights = train([(np.array(r["place"]), np.array(r["value"])) for r in sample], label)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("weak_label", pa.float64()), ("kept", pa.bool_())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache("slots", SLOT.clear)
        for batch in batches:
            for part in slices(batch):
                scores, voted = [], []
                for t in text_bytes(part["text"]):
                    words = t.split()
                    features = shape(t, words)
                    voted.append(votes(features))
                    if not words:
                        scores.append(0.0)
                        continue
                    slots, shaped = _inputs(features, words)
                    z = weights[slots].sum() / len(words) + weights[SLOTS:-1] @ shaped + weights[-1]
                    scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
                weak = model.posterior(np.array(voted).reshape(-1, LABELLERS))
                s = np.array(scores)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(s), pa.array(weak), pa.array(s >= keep_from)], schema=schema)
        give_back()

    return base.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, weak_label double, kept boolean")

"""The training-data operators against brute force on small tables with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspan.llm import ann, embedding_dedup, language_id, minhash, mixing, pii, quality, sentencepiece_codec, substring_dedup, token_files

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["für", "+1 (222) 333-4444", "a@b.co", "1.2.3.4", "x\ny", "😀"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 90))) for _ in range(20)]
    out = []
    for i in range(90):
        text = rng.choice(base)
        part = text.split(" ")
        if rng.random() < 0.6:
            part[rng.randrange(len(part))] = rng.choice(words)
        out.append((i, " ".join(part), f"s{i % 4}" if i % 7 else None))
    return [*out, (100, None, "s1"), (101, "", "s1"), (102, "  \n ", None), (103, "w1 " * 4000, "s2"), (None, base[0], "s0"), (5, base[1], "s0"), (104, "one two", "s3")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # further columns whose names the operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("to", F.lit(1)).withColumn("n", F.lit("x")).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))


def empty(docs):
    return docs.where("false")


def words_of(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("hot", [1, 256])
def test_substring_dedup(docs, rows, hot):
    key = lambda i: 2**63 if i is None else i
    first = {}
    for i, t, _ in rows:
        w = words_of(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, 2**63), key(i))
    want = []
    for i, t, _ in rows:
        w = words_of(t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < key(i) for j in range(k, k + 13)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    got = [tuple(r) for r in substring_dedup.dedup_substrings(docs, with_text=False, least_chunks=7, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 100
    assert substring_dedup.dedup_substrings(empty(docs)).count() == 0


def test_common_words():
    rng = random.Random(3)
    for _ in range(3000):
        size = rng.randrange(1, 4)
        a, b = (["".join(rng.choice("xy") * size for _ in range(1)) for _ in range(rng.randrange(90))] for _ in range(2))
        if rng.random() < 0.7:
            b = a[: rng.randrange(len(a) + 1)] + b
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        if rng.random() < 0.7:
            j = min(i, len(b))
        right = next((k for k in range(99) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k]), 0)
        left = next((k for k in range(99) if i - k <= 0 or j - k <= 0 or a[i - k - 1] != b[j - k - 1]), 0)
        assert substring_dedup._common("".join(a), i * size, "".join(b), j * size, size) == right
        assert substring_dedup._common("".join(a), i * size, "".join(b), j * size, -size) == left


def test_sentencepiece(docs, rows, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_codec.encode_documents(docs, PIECES, outputs=("ids", "decoded", "ids_sha256"))
    want = sorted((str(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got.collect()) == want
    assert sentencepiece_codec.decode_documents(got, PIECES).where("text <> ''").count() == sum(bool(x[2]) for x in want)
    tool, rng = sentencepiece_codec.codec(PIECES), random.Random(2)
    texts = ["".join(rng.choice("ab the\n\t  .,▁é😀ß\r-=") for _ in range(rng.randrange(50))) for _ in range(2000)]
    assert [x.tolist() for x in tool.encode(pa.array(texts))] == library.encode(texts)
    # a memory that holds next to nothing changes no result
    monkeypatch.setattr(tool.pieces_ids, "most", 300)
    assert [x.tolist() for x in tool.encode(pa.array(texts))] == library.encode(texts)
    assert sentencepiece_codec.encode_documents(empty(docs), PIECES).count() == 0


def test_language(docs, rows):
    net = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.identify_languages(docs, net).collect()}
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].score == 0
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert language_id.identify_languages(empty(docs), language_id.learn(empty(docs))).count() == 0


def test_every_language_is_learned(spark):
    """Forty languages, each of its own letters, three documents each."""
    rows = [(i, chr(0x4E00 + 50 * (i % 40)) * 5 + f" {i}", f"l{i % 40}") for i in range(160) if zlib.crc32(str(i).encode()) % 3 != 1]
    net = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.labels == sorted({lang for _, _, lang in rows})


def test_language_windows():
    """A long text is labelled as one window would label it, but for the states' start; every byte counts once."""
    net = language_id.train({"a": [b"abcd efgh " * 20], "b": [b"stuv wxyz " * 20]}, steps=60)
    text = b"abcd efgh " * 300 + b"stuv wxyz " * 100
    whole = net.label(*language_id.packed([text])).mean(axis=(0, 1))
    got = language_id.pooled(net, pa.array([text.decode(), None, "", "abcd", "x" * 700]))
    assert np.abs(got[0] - whole).max() < 0.02 and np.abs(got[0] - [0.75, 0.25]).max() < 0.1
    assert (got[1:3] == 0).all() and np.abs(got[3:].sum(axis=1) - 1).max() < 1e-5
    alone = language_id.pooled(net, pa.array(["abcd"]))
    assert np.abs(alone[0] - got[3]).max() < 1e-6


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.identify_languages(docs, language_id.learn(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0


def test_gradients():
    net = language_id.Network.fresh(["a", "b", "c"], 4, 1)
    net.wx, net.wh, net.wo, net.bo = [w.astype(np.float64) for w in net.wx], [w.astype(np.float64) for w in net.wh], net.wo.astype(np.float64), net.bo.astype(np.float64)
    text, mask = language_id.packed([b"hello", b"hi", b"w"])
    _, grads = net.gradients(text, mask, np.array([0, 1, 2]))
    # the quick form for prediction gives the same probabilities
    loss = -np.mean([np.log(net.label(text, mask)[t, k, k]) for k, n in enumerate(mask) for t in range(n)])
    assert abs(loss - net.gradients(text, mask, np.array([0, 1, 2]))[0]) < 1e-4
    for w, g in zip(net.weights(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 1e-2
        up = net.gradients(text, mask, np.array([0, 1, 2]))[0]
        w[at] -= 2e-2
        down = net.gradients(text, mask, np.array([0, 1, 2]))[0]
        w[at] += 1e-2
        assert abs((up - down) / 2e-2 - g[at]) < 2e-3


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 16))
    x = np.concatenate([centre[rng.integers(0, 30, 150)] + rng.normal(scale=0.12, size=(150, 16)), centre[:3], centre[:3]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [])]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(1))


def test_embedding_dedup(vectors):
    x, table = vectors
    z = x / np.linalg.norm(x, axis=1)[:, None]
    near = z @ z.T >= 0.95
    root = list(range(len(x)))
    for _ in range(len(x)):
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(x))]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, tile_points=7).collect()}
    assert len(got) == len(x) + 5
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, root[i], root[i] == i)
    assert got[902].n_links == 0 and got[902].kept
    assert embedding_dedup.near_duplicates(table.where("false")).count() == 0


def test_embedding_dedup_edges(spark):
    """Repeated and null ids, unlike lengths, values that single floats don't hold."""
    rows = [(1, [1.0, 0.1, 0.0]), (1, [0.0, 0.0, 1.0]), (2, [1.0, 0.1]), (3, [2.0, 0.2, 0.0]), (None, [1.0, 0.1, 0.0]), (4, [0.0, 1e-300, 1e300]), (5, [1.0, 0.1 + 1e-12, 1e-9]), (6, [3.0, 0.3])]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert [(i, c, k) for i, _, c, k in got] == [("1", 1, True), ("1", 1, True), ("2", 2, True), ("3", 1, False), ("4", 1, False), ("5", 1, False), ("6", 2, False), ("None", None, True)]
    assert sum(n for _, n, _, _ in got) == 2 * (3 + 1 + 1)  # three alike, and two pairs


@pytest.mark.parametrize("tile", [3, 50])
def test_embedding_dedup_in_tiles(spark, tile):
    """A crowd of near copies beside a few vectors: each tile of owners meets each tile of guests."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=8) + rng.normal(scale=0.2, size=(120, 8)), rng.normal(size=(60, 8))])
    z = x / np.linalg.norm(x, axis=1)[:, None]
    near = z @ z.T >= 0.95
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), tile_points=tile).collect()}
    assert [got[i] for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()


def shuffled(spark):
    """Bytes that all stages so far wrote for shuffles."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_embedding_dedup_sends_no_copies(spark):
    """What is shuffled grows with the vectors, not with the cells and tiles in which they are met."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x[:100] + np.float32(0.01)]))], "vec_id long, embedding array<float>")
    before = shuffled(spark)
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(table, tile_points=400).collect()}
    assert got == {i: i % 2000 for i in range(2100)}
    assert shuffled(spark) - before < 3 * x.nbytes


def test_neighbours(vectors):
    x, table = vectors
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, pivots=32).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    right = 0
    for q, found in got.items():
        found.sort()
        score = x @ x[q]
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in found)
        want = sorted((-score[j], j) for j in range(len(x)) if j != q)[:20]
        right += len({v for _, v, _ in found} & {j for _, j in want})
    assert len(got) == 8 and right >= 0.9 * 160
    assert ann.search(table.where("false"), F.lit(True)).count() == 0


def test_neighbours_of_unlike_lengths(spark):
    """Each length has an index of its own; where 20 others exist 20 are found, also by a query far from all others."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8 if i % 5 else 5).tolist()) for i in range(300)] + [(2000 + i, rng.normal(size=3).tolist()) for i in range(3)]
    rows += [(4000, [1e-3] + [0.0] * 7), (4020, [3.0, 1.0]), (None, [1.0] * 8), (5000, None), (6000, [None] * 8)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, pivots=16, posted=2, radius=0.5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    held = [(i, v) for i, v in rows if i is not None and v and v[0] is not None]
    for q, v in held:
        others = [(i, w) for i, w in held if i != q and len(w) == len(v)]
        if q % 20 == 0:
            found = sorted(got.get(q, []))
            assert [r for r, _, _ in found] == list(range(1, min(20, len(others)) + 1))
            assert all(abs(s - float(np.dot(v, dict(others)[i]))) < 1e-12 for _, i, s in found)
    assert 4020 not in got and len(got[2000]) == 2


def test_neighbours_ties(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(100)]
    got = sorted((r.rank, r.vec_id) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 40).collect())
    assert got == [(k + 1, 2 * k) for k in range(20)]


def test_footrule():
    rng = np.random.default_rng(0)
    pivots = rng.normal(size=(200, 6))
    x = rng.normal(size=(40, 6))
    ranks = ann.permutation_ranks(x, pivots / np.linalg.norm(pivots, axis=1)[:, None])
    assert (np.sort(ranks, axis=1) == np.arange(200)).all()
    assert [r.argmin() for r in ranks] == [(pivots @ v / np.linalg.norm(pivots, axis=1)).argmax() for v in x]
    for own in ranks:
        assert ann.footrule(ranks, own).tolist() == [sum(abs(int(a) - int(b)) for a, b in zip(r, own, strict=True)) for r in ranks]


def copied(spark, noise):
    """The embeddings of sf0.1, a third of whose rows are copies of one vector, with so much noise."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    rng = np.random.default_rng(5)
    group = rng.random(len(x)) < 1 / 3
    x[group] = x[7] + rng.normal(scale=noise, size=(group.sum(), x.shape[1])) if noise else x[7]
    return ids, x, group, spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("noise", [0, 0.02])
def test_neighbours_beside_copies(spark, noise):
    ids, x, group, table = copied(spark, noise)
    asked = [int(i) for i in ids if i % 40 == 0]
    got = {}
    for r in ann.search(table, F.col("vec_id") % 40 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == asked
    right = {True: [], False: []}
    for q, found in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        assert [k for k, _, _ in sorted(found)] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        least = np.sort((x @ x[at])[ids != q])[-20]
        right[bool(group[at])].append(np.mean([s >= least - 1e-9 for _, _, s in found]))
    print("recall outside and inside the group", np.mean(right[False]), np.mean(right[True]))
    assert np.mean(right[False]) >= 0.95 and np.mean(right[True]) >= 0.95


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    rows = [(i % 40, v.tolist()) for i, v in enumerate(x)] + [(i, x[3].tolist()) for i in range(50, 90)] * 2
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 7 == 3, k=10, pivots=8, posted=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in {i for i, _ in rows if i % 7 == 3}:
        best = {}
        for a, v in rows:
            for b, w in rows:
                if a == q != b:
                    best[b] = max(best.get(b, -1e9), float((np.array(v) * np.array(w)).sum()))
        want = sorted((-s, b) for b, s in best.items())[:10]
        assert [v for _, v, _ in sorted(got[q])] == [b for _, b in want]


def test_label_model_recovers_accuracies():
    """Simulated labellers: kinds of bad text, each caught by its own labeller and at times by others; no labeller sees the labels."""
    rng = np.random.default_rng(4)
    n, good, k = 60_000, 0.75, 9
    alarm = np.array([0.0, 0.002, 0.01, 0.004, 0.005, 0.0, 0.008, 0.001, 0.003])
    caught = np.where(np.eye(k, dtype=bool), rng.uniform(0.7, 0.95, (k, k)), rng.choice([0.0, 0.02, 0.3], (k, k)))
    label = rng.random(n) < good
    chance = np.where(label[:, None], alarm, caught[rng.integers(0, k, n)])
    votes_ = (rng.random((n, k)) >= chance).astype(int)
    votes_[rng.random((n, k)) < 0.1] = -1
    patterns, counts = np.unique(votes_, axis=0, return_counts=True)
    for scale in (1, 1000):  # alike at every size
        model = quality.estimate(patterns, counts * float(scale))
        assert abs(model.shares[0] - good) < 0.03
        on_good, on_bad = model.rates()
        assert np.abs(on_good - alarm).max() < 0.01 and np.abs(on_bad - caught.mean(axis=0)).max() < 0.05
    assert ((model.posterior(votes_) >= 0.5) == label).mean() > 0.95


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[label].sum() - label.sum() * (label.sum() + 1) / 2) / (label.sum() * (~label).sum())


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify_quality(docs).join(labels, "doc_id").collect()
    good = np.array([r.quality == 1 and r.toxic == 0 for r in got])
    value = auc(np.array([r.score for r in got]), good)
    kept = np.array([r.kept for r in got])
    low, toxic = np.array([r.quality == 0 for r in got]), np.array([r.quality == 1 and r.toxic == 1 for r in got])
    print("AUC", value, "clean kept", kept[good].mean(), "low rejected", 1 - kept[low].mean(), "toxic rejected", 1 - kept[toxic].mean())
    # of toxic texts only those that hold abuse can be told
    assert value > 0.9 and kept[good].mean() > 0.97 and kept[low].mean() < 0.1 and kept[toxic].mean() < 0.5


def test_quality(spark, docs):
    bad = [(i, "### $$$ %%% " * 20, None) for i in range(200, 215)]
    more = docs.select("doc_id", "text", "source").union(spark.createDataFrame(bad, "doc_id long, text string, source string"))
    got = {r.doc_id: r for r in quality.classify_quality(more).collect()}
    assert not got[100].kept and not got[101].kept
    assert sum(got[i].kept for i, *_ in bad) <= 1
    assert all(0 <= r.score <= 1 for r in got.values())
    assert quality.classify_quality(empty(docs)).count() == 0


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(3)).collect()))
    assert sorted(r["size"] for r in got) == sorted(len(words_of(t)) for _, t, _ in rows)
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r["size"] for r in got)
    goal = {r.source: r.target for r in got}
    assert abs(sum(goal.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    assert mixing.emit_mixture(docs).count() == sum(r.copies for r in got)
    assert mixing.mix_sources(empty(docs)).count() == 0


def plain_targets(sizes, share=1.5, weights=(3, 1, 2), cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_ = {}, list(order)
    while open_:
        left = share * sum(sizes.values()) - sum(out.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        out |= {s: cap * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    return out


def test_mixing_targets(spark):
    rng = random.Random(2)
    cases = [{"a": 10, "b": 10, None: 100}, {"a": 0, "b": 5}, {"a": 0}, {"é": 3, "Z": 9, "a": 4, "": 2, None: 0}]
    cases += [{f"s{i}": rng.choice([0, 1, 5, 50, 1000]) for i in range(rng.randrange(1, 30))} for _ in range(6)]
    for sizes in cases:
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixing_takes_near_its_targets(spark):
    """By plain systematic sampling in the operator's order: copies of a document differ from its expectation by less than one."""
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.choice([1, 2, 5, 40, 300])), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        target, size = own[0].target, sum(r["size"] for r in own)
        assert size == own[0].source_size and abs(sum(r.taken for r in own) - target) <= 0.03 * target + 300
        assert {r.copies for r in own} <= {int(target / size), int(target / size) + 1}
        # equal sizes follow each other: the copies of each size come within one of their share
        for k in {r["size"] for r in own}:
            like = [r.copies for r in own if r["size"] == k]
            assert abs(sum(like) - len(like) * target / size) <= 1.0001


def test_mixture_of_repeated_rows(spark):
    rows = [(1, f"x{k} y", "a") for k in range(30)] + [(None, "p q r", None)] * 9 + [(2, "x y z", "a"), (3, None, "b"), (4, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("m", F.lit(1)).withColumn("copies", F.lit(2))
    assert Counter(r.doc_id for r in mixing.emit_mixture(docs).collect()) == Counter({i: n for i, n in ((r.doc_id, r.n) for r in mixing.mix_sources(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()) if n})
    assert mixing.emit_mixture(empty(docs)).count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark, docs, rows):
    rng = random.Random(3)
    parts = list("ab.@%+- ()0123456789") + ["é", "😀", "a@b.c", "1.2.3.4", "+1 (222) 333-4444", "4539 1488 0343 6467", "--"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(1500)] + [(2000, None), (2001, ""), (2002, "1 " * 20000), (2003, "7" * 50000), (2004, "x@b" + ".c" * 20000)]
    got = pii.find_pii(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()
    assert len(got) == len(texts)
    want = {i: spans(t or "") for i, t in texts if i != 2003}
    assert [r for r in got if r.doc_id in want and r.s != want[r.doc_id]] == []
    masked = pii.mask_pii(docs).collect()
    assert len(masked) == len(rows) and not any("a@b.co" in (r.text or "") for r in masked)
    assert pii.find_pii(empty(docs)).count() == 0


def payment_cards(n, rng):
    """n numbers of 16 digits in groups of four that pass the check, and one that doesn't."""
    out = []
    while len(out) < n + 1:
        d = "".join(rng.choice("0123456789") for _ in range(16))
        if luhn(d) == (len(out) < n):
            out.append(" ".join(d[i : i + 4] for i in range(0, 16, 4)))
    return out


def found_by_context(spark, texts):
    """Each text with the spans that no base pattern covers, as (kind, text)."""
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {texts[r.doc_id]: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if s not in r.base] for r in rows}


@pytest.mark.parametrize("form", ["pay by card {} today", "Email: a1@b.com Card: {}", "{}", "😀 card:{}."])
def test_pii_spans_are_instances(spark, form):
    cards = payment_cards(12, random.Random(6))
    got = found_by_context(spark, [form.format(c) for c in cards])
    assert [x for x in got.values() if x] == [[("card", cards[-1])]]


def test_pii_patterns(spark):
    text = "Phone: a1@b.com b@c.d at x"
    got = spark.createDataFrame([(text,)], "t string").select(F.transform(pii._instances(F.col("t")), lambda m: F.struct(m["token"], pii._patterns(m["start"], m["context"])))).first()[0]
    assert [tuple(x) for x in got] == [("a1@b.com", ["phone", "^ phone"]), ("b@c.d", ["a9@a.a", "phone a9@a.a"])]


def test_pii_discovers_by_context(spark):
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    seeds = [f"please call +1-555-{digits(3)}-{digits(4)} now" for _ in range(20)] + [f"write to {word()}@{word()}.com today" for _ in range(20)]
    hidden = [("phone", f"555-{digits(3)}-{digits(4)}", "please call {} now") for _ in range(20)] + [("email", f"{word()}@{word()}", "write to {} today") for _ in range(20)]
    # a context that only what is found holds: known in the second round
    chained = [("phone", hidden[i][1], "reach me under {} ok") for i in range(8)] + [("phone", f"(555) {digits(3)}-{digits(4)}", "reach me under {} ok")]
    other = [f"the {word()} cost {digits(2)} in {rng.randrange(1900, 2020)} for {digits(3)} of them" for _ in range(150)] + [f"please call {i} people" for i in range(2, 8)]
    planted = {form.format(x): (kind, x) for kind, x, form in hidden + chained}
    got = found_by_context(spark, seeds + list(planted) + other)
    assert {t: x for t, x in got.items() if x} == {t: [x] for t, x in planted.items()}


@pytest.mark.parametrize("block", [3, 1000])
def test_minhash(docs, rows, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    sets = [(i, Counter(tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)) if (w := words_of(t)) else Counter()) for i, t, _ in rows if i is not None]
    root = {i: i for i, _ in sets}
    for _ in range(len(sets)):
        new = {i: min([root[i], *[root[j] for j, b in sets for k, a in sets if k == i and a and sum((a & b).values()) >= 0.8 * sum((a | b).values())]]) for i in root}
        if new == root:
            break
        root = new
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == root
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_minhash_unlike_texts_of_an_id(spark):
    rng = random.Random(9)
    a, b, c, d = ([f"{x}{rng.randrange(10**6)}" for _ in range(80)] for x in "abcd")
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (7, near(b)), (3, " ".join(b)), (4, " ".join(c)), (4, " ".join(d)), (9, " ".join(d)), (8, near(d)), (5, near(c)), (6, " ".join(d[::-1]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 7: 1, 3: 1, 4: 4, 9: 4, 8: 4, 5: 4, 6: 6}
    # here no two texts have the same least id, but 2 holds two texts
    rows = [(1, " ".join(a)), (2, " ".join(a)), (2, " ".join(b)), (7, near(b))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 7: 2}


def test_links_within_bands(spark, monkeypatch):
    """All documents in one band, no links yet: blocks find what all pairs find."""
    rng = random.Random(7)
    base = [[rng.randrange(300) for _ in range(60)] for _ in range(6)]
    bags = {i: Counter(rng.randrange(300) if rng.random() < 0.06 else v for v in rng.choice(base)) for i in range(40)}
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    labelled = spark.createDataFrame([(b, i, 60, i) for b in (1, 2) for i in bags], "band long, doc_id long, n long, root long")
    table = spark.createDataFrame([(i, np.sort(np.array(list(c.elements()), np.uint64)).tobytes()) for i, c in bags.items()], "doc_id long, bag binary")
    got = {i: i for i in bags}
    want = dict(got)

    def join(root, a, b):
        x, y = sorted((root[a], root[b]))
        root.update({k: x for k, v in root.items() if v == y})

    for r in minhash._linked_in_bands(labelled, table, 0.8).collect():
        assert sum((bags[r.a] & bags[r.b]).values()) >= 0.8 * sum((bags[r.a] | bags[r.b]).values())
        join(got, r.a, r.b)
    for a in bags:
        for b in bags:
            if a < b and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                join(want, a, b)
    assert got == want and 1 < len(set(want.values())) < 40


def test_bagminhash_estimates():
    rng, error = random.Random(1), []
    for _ in range(30):
        a = Counter({rng.randrange(400): rng.randrange(1, 9) for _ in range(100)})
        b = Counter({k: v if rng.random() < 0.7 else rng.randrange(0, 9) for k, v in a.items()})
        bags = [minhash.mix(np.array([k for k, n in c.items() for _ in range(n)], np.uint64)) for c in (a, b)]
        s = minhash.signatures(bags, 512)
        error.append((s[0] == s[1]).mean() - minhash.similarity(*bags))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.05


def test_token_files(spark, docs, rows):
    tokenizer = Tokenizer.from_file(BYTES)
    folder, files = token_files.write_token_files(docs, BYTES, file_bytes=4000)
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, folder, files).collect()), key=lambda r: r[1])
    start, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert files.count() > 1 and files.agg(F.max("n_ids")).first()[0] < 2 * 4000 + 8000
    folder, files = token_files.write_token_files(empty(docs), BYTES)
    assert token_files.read_token_files(spark, folder, files).count() == 0


def test_token_ids_are_the_librarys():
    rng, tool, library = random.Random(6), token_files.encoder(BYTES), Tokenizer.from_file(BYTES)
    parts = [*"ab the\n\t  .,é😀ß\r-=1  '", "<|endoftext|>", "don't", "\x1c", "\x85", "\u3000", "<|", "\uffff", "x.\nY", "é,\n.z", "\n\xa0q", "5. ", "b.\n\n", "Ω. "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(5000)]
    texts += [" ".join(rng.choice(["a\nb", "<|endoftext|>", "x.", "don't", "12a", "\nq", "z\n", "w.\nQ", "\uffff", ".,", "o.\n\"R", "7.\n8."]) for _ in range(rng.randrange(8))) for _ in range(2000)]
    texts += [None, "", "a <|endoftext|> b", "word " * 50_000 + "end"]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tool.encode(pa.array(texts))] == want
    assert want[-2][1] == 220 and 50256 in want[-2]


@pytest.mark.parametrize("ids", [[None] * 300, [7] * 300])
def test_token_files_of_one_id(spark, ids):
    """A third of all rows may share an id or have none: they lie in several files, and every place is taken once."""
    table = spark.createDataFrame([(i, f"text {k} " * 20) for k, i in enumerate(ids)], "doc_id long, text string")
    folder, files = token_files.write_token_files(table, BYTES, file_bytes=6000)
    got = sorted(tuple(r)[1:3] for r in token_files.read_token_files(spark, folder, files).collect())
    assert files.count() > 4 and [a for a, _ in got] == [sum(n for _, n in got[:k]) for k in range(300)]


def test_token_reader_reads_one_frame(tmp_path):
    path = tmp_path / "a.qstk"
    rng = np.random.default_rng(1)
    bodies = [rng.integers(0, 50000, n, dtype="<u4").tobytes() for n in (5, 0, 3000, 10, 700)]
    with path.open("wb") as f:
        token_files.write_tokens(f, enumerate(bodies), frame_ids=600)
    with path.open("rb") as f:
        reader = token_files.TokenReader(f)
        assert reader.document(3).tobytes() == bodies[3] and reader.frames_read == 1
        assert [reader.document(i).tobytes() for i in range(5)] == bodies
    damaged = bytearray(path.read_bytes())
    damaged[40] ^= 1
    path.write_bytes(damaged)
    with path.open("rb") as f, pytest.raises(Exception):  # noqa: B017
        token_files.TokenReader(f).document(0)


def test_labels_of_positions_follow_the_states():
    """What labels a position is the softmax of both directions' states, laid out with a label after the other."""
    rng = np.random.default_rng(3)
    net = language_id.Network.fresh(["a", "b", "c"], 5, 1)
    net.bo += rng.normal(size=3).astype(np.float32)
    text, size = language_id.packed([bytes(rng.integers(0, 256, n, np.uint8)) for n in (1, 7, 30, 30)])
    got = net.label(text, size)
    back = language_id._reversed(net.states(language_id._reversed(text, size), 1)[0], size)
    logits = np.concatenate([net.states(text, 0)[0], back], axis=2) @ net.wo + net.bo
    want = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
    for column, n in enumerate(size):
        assert np.allclose(got[:n, column], want[:n, column], atol=1e-5)
    assert all(got[:, :, k].flags.c_contiguous for k in range(3))

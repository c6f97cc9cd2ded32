"""Every stage of the corpus pipeline against plain Python, on nulls, empty, repeated and very long texts, and on an empty table."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quillspan.llm import common, minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = {"aa": [f"kat{i}" for i in range(80)], "bb": [f"zum{i}" for i in range(80)]}
    out = []
    for i in range(80):
        lang = "aa" if i % 2 else "bb"
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(30, 90)))
        out.append([i, text + (f" call +1 (222) 333-44{i:02d} or u{i}@mail.org" if i % 5 == 0 else ""), lang if i % 7 else None, f"s{i % 3}" if i % 11 else None])
    out += [[100 + i, out[i][1], out[i][2], out[i][3]] for i in range(0, 20, 3)]  # copies
    out += [[200, out[3][1] + " end", "aa", "s0"], [300, None, "aa", "s1"], [301, "", None, "s1"], [302, "12 34 !", None, None], [303, "kat1 zum2 " * 6000, "aa", "s2"], [None, "no id at all here", "aa", "s2"], [5, "another text under a number in use", "bb", "s0"], [5, "another text under a number in use", "bb", "s0"]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def staged(spark, rows):
    docs, out = spark.createDataFrame(rows, SCHEMA), {}
    for name, stage in pipeline.STAGES:
        out[name] = (docs, common.written(stage(spark, docs, ""), f"test-{name}"))
        docs = out[name][1]
    return out


def key(r):
    return (r.doc_id, r.text, r.source)


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "minhash_near_dedup", "pii", "mixing", "sentencepiece"]


def test_language_stage(staged):
    docs, kept = staged["language_id"]
    assert kept.columns == docs.columns
    want = Counter((r.doc_id, r.text, r.source, r.n_chars) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    assert Counter((r.doc_id, r.text, r.source, r.n_chars) for r in kept.collect()) == want
    given = {(r.doc_id, r.text): r.lang for r in docs.collect() if r.lang}
    assert all(r.lang == given.get((r.doc_id, r.text), r.lang) and r.lang in ("aa", "bb") for r in kept.collect())


def test_near_dedup_stage(staged):
    docs, kept = staged["minhash_near_dedup"]
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in minhash.near_duplicates(docs).collect() if not r.kept}
    assert gone == {100, 103, 106, 109, 112, 115, 118, 200}
    assert Counter(map(key, kept.collect())) == Counter(key(r) for r in docs.collect() if r.doc_id not in gone)


def test_pii_stage(staged):
    docs, masked = staged["pii"]
    assert masked.columns == docs.columns and masked.count() == docs.count()
    texts = {(r.doc_id, r.source): r.text for r in masked.collect() if r.doc_id is not None and r.doc_id % 5 == 0 and r.doc_id < 80 and r.doc_id != 5}
    for r in docs.collect():
        if (r.doc_id, r.source) in texts:
            clean = r.text.rsplit(" call ", 1)[0]
            assert texts[r.doc_id, r.source] == f"{clean} call <PHONE> or <EMAIL>"
    assert all(r.n_chars == len(r.text) for r in masked.collect())


def test_mixing_stage(staged):
    docs, mixed = staged["mixing"]
    assert mixed.columns == docs.columns
    before, after = Counter(map(key, docs.collect())), Counter(map(key, mixed.collect()))
    assert all(n <= 2 * before[k] for k, n in after.items())
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(size(mixed.collect()) / size(docs.collect()) - 1.5) < 0.35


def test_encoding_stage(staged):
    docs, coded = staged["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text)
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in coded.collect()) == want


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stage_on_empty_table(spark, rows, name):
    docs = spark.createDataFrame(rows, SCHEMA).where("false")
    out = dict(pipeline.STAGES)[name](spark, docs, "")
    assert out.count() == 0 and (name == "sentencepiece" or out.columns == docs.columns)


def test_run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    found = pipeline.run(spark, str(tmp_path))
    assert found.count() > 60 and set(found.columns) == {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"}

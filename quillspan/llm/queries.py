"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embedding_dedup, language_id, minhash, mixing, pii, quality, sentencepiece_codec, substring_dedup, token_files

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), with_text=False)


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(_table(spark, sf_dir, "documents"), PIECES, outputs=("ids_sha256", "decoded_sha256"))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify_languages(docs, language_id.learn(docs))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def quality_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_table(spark, sf_dir, "documents"))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = token_files.write_token_files(_table(spark, sf_dir, "documents"), BYTES, end_id=2)
    return token_files.read_token_files(spark, folder, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring,
        "op2_sentencepiece": sentencepiece,
        "op3_language_id": language,
        "op4_embedding_dedup": embeddings,
        "op5_quality": quality_,
        "op6_mixing": mixture,
        "op7_neighbours": neighbours,
        "op8_pii": personal_data,
        "op9_minhash": near_documents,
        "op10_token_files": tokens,
    }


def oracle_sql() -> dict[str, str]:
    """Only where SQL computes the same rows and columns."""
    return {"op1_substring_dedup": SUBSTRING_SQL, "op4_embedding_dedup": EMBEDDING_SQL, "op9_minhash": NEAR_SQL}


#: Window sequences by their words; the first document of each; the words that a later window covers.
SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), n AS (SELECT doc_id, words, len(words)::BIGINT AS n FROM w
), win AS (
  SELECT doc_id, p, md5(array_to_string(words[p:p + 12], ' ')) AS k FROM (SELECT doc_id, words, unnest(range(1, n - 11)) AS p FROM n WHERE n >= 13)
), first AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k
), hit AS (SELECT win.doc_id, win.p FROM win JOIN first USING (k) WHERE first.d < win.doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM hit
), g AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id
), kept AS (
  SELECT n.doc_id, n.n, coalesce(len(g.qs), 0)::BIGINT AS n_removed,
         CASE WHEN g.qs IS NULL THEN n.words ELSE list_filter(list_transform(n.words, lambda x, i: CASE WHEN list_contains(g.qs, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END AS words
  FROM n LEFT JOIN g USING (doc_id)
)
SELECT doc_id, n AS n_words, n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept
"""

#: All pairs by cosine, then everything that links reach.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (SELECT DISTINCT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
), c AS (SELECT node, min(root) AS root FROM r GROUP BY node
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id
"""

#: Multisets of five-word runs, all pairs that share one, then everything that links reach.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, md5(array_to_string(words[p:p + least(5, len(words)) - 1], ' ')) AS k FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p FROM w WHERE len(words) > 0)
), c AS (SELECT doc_id, k, count(*) AS n FROM g GROUP BY ALL
), t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
), s AS (SELECT x, y FROM p JOIN t u ON u.doc_id = x JOIN t v ON v.doc_id = y WHERE m >= 0.8 * (u.n + v.n - m)
), l AS (SELECT x AS a, y AS b FROM s UNION ALL SELECT y, x FROM s
), r AS (SELECT DISTINCT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
), f AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, CASE WHEN len(words) > 0 THEN min(doc_id) OVER (PARTITION BY text, len(words) > 0) ELSE doc_id END AS class_id, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM w LEFT JOIN f ON f.node = doc_id
"""

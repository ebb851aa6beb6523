"""The queries of the corpus operators over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embedding_dedup, language_id, license_scan, packing, quality, toxicity, warc
from .common import labelled_sample, read_table, remainder
from .jaccard_join import ngram_jaccard_components

#: The vocabulary files of the public tokenizers.
WORD_BPE, BYTE_BPE, BYTE_RANKS = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = labelled_sample(docs, read_table(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 3) != 1, per_class={1: 1500, 0: 3000})
    scored = toxicity.score_toxicity(docs, toxicity.learn(rows))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = labelled_sample(docs, read_table(spark, sf_dir, "labels"), "quality", remainder("doc_id", 5) != 0, per_class={1: 1500, 0: 1500})
    scored = quality.score_quality(docs, quality.learn(rows))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs, remainder("doc_id", 4) != 2)
    out = language_id.predict_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license", "coverage", "n_found")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, BYTE_BPE, BYTE_RANKS)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(generate_series(1, len(t) - 4), lambda i: array_to_string(t[i:i + 4], ' '))
    WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 80 * (x.n + y.n - p.k)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) n ON n.a = e.vec_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) c ON c.a = e.vec_id
"""

OP6_SQL = r"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
r AS (SELECT d, n, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY 1, 2)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN r.m <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN r.m <> p.page_id THEN r.m END AS refers_to
FROM p LEFT JOIN r USING (d, n)
"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_bpe, op4_ngram_jaccard, op5_nearest, op6_warc, op7_language_id, op8_license_scan, op9_packing, op10_embedding_dedup)}
ORACLES = {
    "op6_warc": OP6_SQL,
    "op10_embedding_dedup": OP10_SQL,
    "op4_ngram_jaccard": OP4_SQL,
}

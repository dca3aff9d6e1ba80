"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classify, embeddings, jaccard, packing, pii, secret_scan, substrings
from .common import new_path


def tokenizer_path() -> str:
    """The vocabulary file: TOKENIZER_FILE, or the installed public one."""
    import public_tokenizers

    return os.environ.get("TOKENIZER_FILE") or public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classify.fit_quality(documents, table(spark, sf_dir, "labels"))
    scored = classify.quality_scores(documents, model)
    return scored.select("doc_id", classify.held_out().alias("held_out"), "score", (F.col("score") >= classify.ACCEPT).cast("int").alias("predicted"))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = classify.fit_language(documents.select("doc_id", "text", "lang"))
    found = classify.predict_language(documents.select("doc_id", "text"), model)
    return found.select("doc_id", classify.held_out().alias("held_out"), "lang_pred", "score")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.checksums(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of versions pass through a stored ledger; together they are all documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "ledger")
    late = F.coalesce(F.xxhash64("doc_id") % 2 == 0, F.lit(False))
    secret_scan.update_ledger(documents.where(~late), path)
    ledger = secret_scan.update_ledger(documents.where(late), path)
    return secret_scan.findings(documents, ledger, ["doc_id"])


def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality,
    "op2_language": language,
    "op3_packing": packed,
    "op4_secrets": secrets,
    "op5_ngram_jaccard": ngram_join,
    "op6_bpe": bpe_codec,
    "op7_embedding_dedup": embedding_dedup,
    "op8_pii": personal_data,
    "op9_substring_dedup": repeats,
    "op10_topk": search,
    "pipeline": pipeline,
}

_COMPONENTS = """
  reach(a, b) AS (
    SELECT a, b FROM links
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"""

ORACLE_SQL: dict[str, str] = {
    "op4_secrets": secret_scan.oracle_sql(),
    "op8_pii": pii.oracle_sql(),
    "op5_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] END) AS sh FROM w),
  x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
  links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM x p JOIN x q ON p.g = q.g AND p.doc_id <> q.doc_id
    AND 100 * p.n >= 90 * q.n AND 100 * q.n >= 90 * p.n
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),{_COMPONENTS}
SELECT s.doc_id, len(sh) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = s.doc_id""",
    "op7_embedding_dedup": f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM e p JOIN e q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.v, q.v) >= 0.9),{_COMPONENTS}
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, coalesce(m, e.vec_id) >= e.vec_id AS kept
FROM e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = e.vec_id""",
    "op9_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
  low AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
  gone AS (SELECT DISTINCT win.doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN low USING (h) WHERE first < win.doc_id),
  words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
  kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.k) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY words.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op10_topk": """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
  r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}

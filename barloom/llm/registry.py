"""The thin ``opN_`` queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, langid, linededup, media, neardup, packing, pii, quality, topk, toxicity
from barloom.llm.common import is_held_out, materialize, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, threshold=80)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = materialize(pii.annotate(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "_base", "_wide"), "spans")
    model = pii.train(found)
    counts = [pii.count_of(k, F.col("_base")).alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(pii.spans_text(F.array_sort("_base")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.spans_text(pii.all_spans(model)).alias("spans"))


def op8_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.probe_ogg(media.to_ogg(table(spark, sf_dir, "documents")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict_languages(docs, langid.train(docs), ["doc_id"])
    return found.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_line_dedup": op5_line_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pii": op7_pii,
    "op8_media_ogg": op8_media_ogg,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_language_id": op10_language_id,
}

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op4_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL
),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op5_line_dedup": f"""
WITH line AS (
  SELECT doc_id, pos, parts[pos] AS line,
         trim(translate(parts[pos], '{_UPPER}', '{_LOWER}'), {_WHITE}) AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
),
hot AS (
  SELECT k, max(doc_id) AS last_doc FROM line WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
),
judged AS (
  SELECT l.doc_id, l.pos, l.line, h.k IS NOT NULL AND l.doc_id <> h.last_doc AS gone
  FROM line l LEFT JOIN hot h ON l.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
}

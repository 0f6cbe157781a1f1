"""The corpus operators' registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import langid
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .lm_scoring import lm_scores
from .mixing import mix, mix_sql
from .packing import pack_documents
from .pii import pseudonymise
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .topk import exact_topk

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(_documents(spark, sf_dir))
    columns = [F.col(f"mix_{c}").alias(c) for c in ("source", "lang", "topic", "tokens")]
    rounded = [F.round(f"mix_{c}", 9).alias(c) for c in ("weight", "probability")]
    return found.select("doc_id", *columns, *rounded, F.col("mix_kept").alias("kept"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_documents(spark, sf_dir), keep_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the corpus owner's: spark.loomstream.pii.key (or LOOMSTREAM_PII_KEY); for trials there is a default."""
    key = spark.conf.get("spark.loomstream.pii.key", None) or os.environ.get("LOOMSTREAM_PII_KEY") or "trial"
    return pseudonymise(_documents(spark, sf_dir), key=key)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    model = langid.train(docs.where(remainder != 0))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), digest_all=True)


OP9_SQL = r"""
WITH norm AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), grouped AS (
  SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM norm
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_mixing": op2_mixing,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_pii": op7_pii,
        "op8_language_id": op8_language_id,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op2_mixing": mix_sql(), "op9_exact_dedup": OP9_SQL}

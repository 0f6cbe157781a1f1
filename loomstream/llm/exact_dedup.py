"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, joinable, select_as, text_or_empty

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), WHITE, " ")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest_all: bool = False) -> DataFrame:
    """One row a row of docs: doc_id, keep_id, group_size, kept, and with digest_all text_sha256.

    Texts are equal when they are identical after each run of ASCII white space is replaced by one space.  One scan
    gives each row's length and prefix hash.  Rows whose length no other row has are done; of the rest, those whose
    (length, prefix hash) no other row has are done; only for the survivors full hashes (SHA-256) are compared.  With
    digest_all, for callers that return every digest anyway, the digest is taken in that one scan; otherwise the
    contents of the survivors alone are read again.

    Of equal texts the row with the smallest id stays (null ids last); of repeated rows with one id, one stays.  Null
    text equals empty text.  No rows give no rows; further columns of docs are ignored.  Group counts are aggregated
    before they are shuffled, so a group may hold any share of the rows; the lists of sizes, prefixes and groups that
    recur are broadcast if they are short, so that no size is one task's.
    """
    text = select_as(docs, doc_id=id_col, text=text_col).select("doc_id", normalised().alias("norm"))
    digest = F.unhex(F.sha2("norm", 256))
    size, head = F.octet_length("norm").alias("size"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head")
    rows = checkpoint(text.select("doc_id", size, head, *([digest.alias("digest")] if digest_all else [])))
    same_size = joinable(rows.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size"))
    by_size = rows.join(same_size, "size", "left_semi")
    same_head = joinable(by_size.groupBy("size", "head").agg(F.count("*").alias("n")).where("n > 1").select("size", "head"))
    by_head = by_size.join(same_head, ["size", "head"], "left_semi")
    if digest_all:
        full = by_head
    else:
        ids = by_head.select("doc_id").distinct().withColumnRenamed("doc_id", "id").hint("shuffle_hash")
        read = text.join(ids, text["doc_id"].eqNullSafe(ids["id"]), "left_semi").select("doc_id", size, head, digest.alias("digest"))
        full = checkpoint(read.join(same_head, ["size", "head"], "left_semi"))
    key = ["size", "head", "digest"]
    groups = joinable(full.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    single = rows if digest_all else rows.join(same_head, ["size", "head"], "left_anti").withColumn("digest", F.lit(None).cast("binary"))
    every = single if digest_all else single.unionByName(full)
    copies = every.groupBy("doc_id", *key).agg(F.count("*").cast("int").alias("copies"))
    out = copies.join(groups, key, "left").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"),
        *([F.lower(F.hex("digest")).alias("text_sha256")] if digest_all else []),
    )

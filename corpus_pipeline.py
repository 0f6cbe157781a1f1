"""The corpus pipeline: documents to packed training sequences, each stage on all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstream.llm import langid
from loomstream.llm.common import checkpoint, ensure_checkpoint_dir, free_name, without, written
from loomstream.llm.exact_dedup import exact_dedup, normalised
from loomstream.llm.jaccard_join import jaccard_components
from loomstream.llm.mixing import mix
from loomstream.llm.packing import pack_documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language of the labelled ones is recognised go.

    A text's language is recognised when it has letters, one language is more likely than not, and at least the
    floor of its words is known (fitted on all labelled texts, see langid.floor_of).  Null and empty texts go; if no
    row has both text and language all go.  Rows are judged one by one: repeated rows stay or go together, ties between
    languages are no reason to go, no rows give no rows, and all columns stay as they are, whatever their names.
    """
    names = [free_name(docs, c) for c in ("lang_pred", "score", "known")]
    model = langid.train(docs)
    found = langid.predict(docs, model, names=names)
    if model is None:
        return docs.limit(0)
    found = written(found)
    pred, score, known = (F.col(c) for c in names)
    floor = langid.floor_of(found.where("text IS NOT NULL AND lang IS NOT NULL"), names[2])
    return found.where((pred != "und") & (score >= 0.5) & (known >= floor)).select(*(F.col(f"`{c}`") for c in docs.columns))


def _once(docs: DataFrame, repeated: DataFrame, hash_: Column) -> DataFrame:
    """docs with one row of each id and hash, if repeated has rows (no shuffle otherwise)."""
    if repeated.isEmpty():
        return docs
    name = free_name(docs, "hash")
    return docs.withColumn(name, hash_).dropDuplicates(["doc_id", name]).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays (null ids last), one of rows repeated with their id.

    Texts are equal but for runs of white space; null counts as empty.  No rows give no rows; further columns stay.
    """
    found = checkpoint(exact_dedup(docs, digest_all=True))
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    digest = F.sha2(normalised(), 256)
    kept = without(docs, gone, {"doc_id": docs["doc_id"], "text_sha256": digest})
    return _once(kept, found.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")), digest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 80 % shared five-word shingles join, the one with the smallest id stays.

    Null ids come last; of several texts under the smallest id the one with the smallest hash stays, of repeated rows
    one.  Texts without words link with nothing and stay.  No rows give no rows; further columns stay.
    """
    found = checkpoint(jaccard_components(docs))
    linked = found.where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    # Rows of a component are reduced to one for each set before they meet.
    first = linked.groupBy("component", "set_id").agg(F.min(order).alias("first")).groupBy("component").agg(F.min("first").alias("first"), F.count("*").alias("sets"))
    copies = linked.groupBy("doc_id", "text_hash", "component").agg(F.count("*").alias("n"))
    several = checkpoint(linked.groupBy("component", "set_id").agg(F.count("*").alias("n")).groupBy("component").agg(F.sum("n").alias("n")).where("n > 1").select("component"))
    grouped = copies.join(several, "component", "left_semi")
    staying = first.join(several, "component", "left_semi").select(F.col("first.id").alias("stay_id"), F.col("first.hash").alias("stay_hash"), F.col("component").alias("of"))
    match = grouped["component"].eqNullSafe(staying["of"]) & grouped["doc_id"].eqNullSafe(staying["stay_id"]) & (grouped["text_hash"] == staying["stay_hash"])
    gone = grouped.join(staying, match, "left_anti")
    text_hash = F.xxhash64("text")
    kept = without(docs, gone, {"doc_id": docs["doc_id"], "text_hash": text_hash})
    return _once(kept, copies.where("n > 1"), text_hash)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic near their tempered shares; four of five tokens stay.

    The draw is fixed by the id: repeated rows and rows without id fall alike.  Null source and language are
    categories; a null or empty text is one token.  No rows give no rows; further columns stay.
    """
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return mix(docs, budget=0.8, prefix=prefix).where(f"`{prefix}kept`").select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2,048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.  Null and empty texts are pieces of one token, repeated rows are packed each, no rows give no rows."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: The first, third and last stages (a trained model, components, a heuristic search) have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read by the next."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:  # what the stage before left has been read
            path(last).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(last), True)
        last = f"{folder}/{name}"
    return docs

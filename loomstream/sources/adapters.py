"""Event logs in the canonical form from Parquet files of that form, or from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstream.schema import RAW_TRANSFERS

NETWORK, TOKEN, CHAIN = "demo-net", "0x" + "ab" * 20, 8453


def read_transfers(spark: SparkSession, *paths: str) -> DataFrame:
    """Canonical transfers from Parquet files, folders or globs."""
    return spark.read.schema(RAW_TRANSFERS).parquet(*paths)


def address(c: Column) -> Column:
    return F.format_string("0x%040x", c.cast("long"))


def _canonical(df: DataFrame, source: str) -> DataFrame:
    return df.select(
        F.concat("transaction_hash", F.lit("-"), F.col("log_index").cast("string")).alias("event_id"),
        "block_number", "block_timestamp", "transaction_hash", "log_index", F.lit(TOKEN).alias("token_address"), "from_address", "to_address",
        F.round(F.col("amount") * 1000000).cast("long").alias("raw_amount"), "amount", (F.col("from_address") == F.col("to_address")).alias("is_self_transfer"),
        F.lit(CHAIN).cast("long").alias("chain_id"), F.lit(NETWORK).alias("network"), F.lit(source).alias("source"), "ingested_at",
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table: user to the number k of the event's properties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _canonical(
        e.select(
            F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("transaction_hash"), F.lit(0).cast("long").alias("log_index"), F.col("event_id").alias("block_number"), F.col("ts").alias("block_timestamp"),
            address(F.col("user_id")).alias("from_address"), address(F.get_json_object("props", "$.k")).alias("to_address"), F.col("value").alias("amount"), F.col("ts").alias("ingested_at"),
        ),
        "events",
    )


def orders_log(spark: SparkSession, sf_dir: str, *, before: str | None = None) -> DataFrame:
    """Order lines: customer to supplier at the ship date; keys recur, the latest ship date wins.  With before, only
    lines shipped before that day."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if before:
        lines = lines.where(F.col("l_shipdate") < F.lit(before).cast("timestamp_ntz"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return _canonical(
        both.select(
            F.col("l_orderkey").cast("string").alias("transaction_hash"), F.col("l_linenumber").cast("long").alias("log_index"), F.col("l_orderkey").alias("block_number"), F.col("l_shipdate").alias("block_timestamp"),
            address(F.col("o_custkey")).alias("from_address"), address(F.col("l_suppkey")).alias("to_address"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("ingested_at"),
        ),
        "orders",
    )

"""Raw transfer logs, as a node returns them, decoded to canonical transfers by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstream.functions.scalar import hex_long, normalised_address, topic_address, units
from loomstream.schema import RAW_TRANSFERS

RAW_LOGS = "address string, blockNumber string, logIndex string, transactionHash string, topics array<string>, data string, blockTimestamp string, removed boolean"


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """Logs from files of one JSON object a line."""
    return spark.read.schema(RAW_LOGS).json(list(paths))


def _refuse(bad: Column, message: str) -> Column:
    """A condition that all rows meet: a bad one is an error.  As a filter it is never pruned."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)


def decode_logs(logs: DataFrame) -> DataFrame:
    """One row a log.  Topics other than three and logs that the chain took back are errors; block_timestamp may be null."""
    sound = logs.where(_refuse(F.coalesce(F.size("topics"), F.lit(0)) != 3, "a transfer has three topics")).where(_refuse(F.coalesce(F.col("removed"), F.lit(False)), "removed log"))
    return sound.select(
        hex_long(F.col("blockNumber")).alias("block_number"), F.timestamp_seconds(hex_long(F.col("blockTimestamp"))).alias("block_timestamp"), F.lower("transactionHash").alias("transaction_hash"), hex_long(F.col("logIndex")).alias("log_index"),
        normalised_address(F.col("address")).alias("token_address"), topic_address(F.col("topics")[1]).alias("from_address"), topic_address(F.col("topics")[2]).alias("to_address"), hex_long(F.col("data")).alias("raw_amount"),
    )


def transfers(decoded: DataFrame, *, chain_id: int, network: str, source: str, token: str | None = None, decimals: int = 6) -> DataFrame:
    """Decoded logs as canonical transfers; a log without time, or of another token than the one asked for, is an error."""
    rows = decoded.where(_refuse(F.col("block_timestamp").isNull(), "log without block timestamp"))
    if token is not None:
        rows = rows.where(_refuse(~F.col("token_address").eqNullSafe(F.lit(token.lower())), "log of another token"))
    more = {
        "event_id": F.concat("transaction_hash", F.lit("-"), F.col("log_index").cast("string")),
        "amount": units(F.col("raw_amount"), decimals),
        "is_self_transfer": F.col("from_address") == F.col("to_address"),
        "chain_id": F.lit(chain_id).cast("long"),
        "network": F.lit(network),
        "source": F.lit(source),
        "ingested_at": F.current_timestamp(),
    }
    return rows.withColumns(more).select(*RAW_TRANSFERS.fieldNames())

"""Staging: one row an event, then one row a participant of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstream.schema import STAGED_COLUMNS

KEY = ["transaction_hash", "log_index"]


class DuplicateEventsError(ValueError):
    """Events that were said to be disjoint share a key."""


def _project(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "event_id": F.concat("transaction_hash", F.lit("-"), F.col("log_index").cast("string")),
            **{c: F.lower(c) for c in ("token_address", "from_address", "to_address")},
            "is_self_transfer": F.lower("from_address") == F.lower("to_address"),
        }
    ).select(*STAGED_COLUMNS)


def stage_dedup(raw: DataFrame) -> DataFrame:
    """The latest row of each key by ingestion time; ties fall by the remaining fields, so reruns agree."""
    latest = Window.partitionBy(*KEY).orderBy(*(F.desc(c) for c in ("ingested_at", "raw_amount", "from_address", "to_address", "block_number", "block_timestamp")))
    return _project(raw.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth"))


def stage_disjoint(raw: DataFrame, *, check: bool = True) -> DataFrame:
    """The same without a shuffle for input whose keys are unique; check counts keys and raises if they are not."""
    if check and not raw.groupBy(*KEY).count().where("count > 1").isEmpty():
        raise DuplicateEventsError("events of the disjoint build share (transaction_hash, log_index)")
    return _project(raw)


def wallet_legs(staged: DataFrame) -> DataFrame:
    """Two rows an event, its sender's and its receiver's, from one scan."""
    leg = lambda own, other, name: F.struct(F.col(own).alias("wallet_address"), F.col(other).alias("counterparty_address"), F.lit(name).alias("direction"))
    both = F.explode(F.array(leg("from_address", "to_address", "SEND"), leg("to_address", "from_address", "RECEIVE"))).alias("leg")
    return staged.select("event_id", "block_timestamp", "transaction_hash", both, "amount", "is_self_transfer").select("event_id", "block_timestamp", "transaction_hash", "leg.*", "amount", "is_self_transfer")


def qualifying(df: DataFrame) -> DataFrame:
    """Rows that metrics count: transfers to oneself are kept in staging but measure no activity."""
    return df.where(~F.col("is_self_transfer"))

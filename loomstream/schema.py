"""Schemas of the event log and its derived streams."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

S, L, D, B, T = StringType(), LongType(), DoubleType(), BooleanType(), TimestampType()

RAW_TRANSFERS = StructType(
    [
        StructField(n, t)
        for n, t in [
            ("event_id", S), ("block_number", L), ("block_timestamp", T), ("transaction_hash", S), ("log_index", L), ("token_address", S), ("from_address", S), ("to_address", S),
            ("raw_amount", L), ("amount", D), ("is_self_transfer", B), ("chain_id", L), ("network", S), ("source", S), ("ingested_at", T),
        ]
    ]
)
STAGED_COLUMNS = [f.name for f in RAW_TRANSFERS if f.name != "ingested_at"]

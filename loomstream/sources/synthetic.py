"""Synthetic transfers, made on the executors; every draw is fixed by the seed and the event's or wallet's number."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstream.schema import RAW_TRANSFERS

from .adapters import CHAIN, NETWORK, TOKEN


@dataclass(frozen=True)
class SyntheticConfig:
    seed: int = 42
    n_wallets: int = 1500
    n_days: int = 45
    start_date: str = "2026-06-01"
    events_per_day: int = 900
    self_transfer_rate: float = 0.01
    pareto_shape: float = 1.4
    mean_log_amount: float = 3.5
    sd_log_amount: float = 1.8


def synthetic_transfers(spark: SparkSession, config: SyntheticConfig | None = None) -> DataFrame:
    """Canonical transfers of n_days: about events_per_day a day (Poisson by its normal limit), senders and receivers by
    heavy-tailed weights among the wallets whose first day has come, log-normal amounts, some transfers to oneself.

    A wallet's number is drawn by the inverse of the Pareto tail, wallets are numbered by weight and spread over the
    days by a hash, so no table of weights is joined and any number of events is made in parallel.
    """
    c = config or SyntheticConfig()

    def u(name: str, *of: Column) -> Column:
        """A number in (0, 1)."""
        return (F.pmod(F.xxhash64(F.lit(f"{c.seed}:{name}"), *of), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    normal = lambda name, *of: F.sqrt(-2 * F.log(u(f"{name} r", *of))) * F.cos(u(f"{name} a", *of) * (2 * math.pi))
    days = spark.range(c.n_days).select(F.col("id").alias("day"))
    many = F.greatest(F.lit(0), F.round(c.events_per_day + math.sqrt(c.events_per_day) * normal("events", F.col("day")))).cast("int")
    rows = days.withColumn("nth", F.explode(F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))))
    at = [F.col("day"), F.col("nth")]
    born = lambda w: F.floor(u("first day", w) * c.n_days)

    def wallet(name: str) -> Column:
        """Of eight draws the first wallet whose first day has come; wallet 0 is there from the start."""
        draws = [F.floor(c.n_wallets * F.pow(u(f"{name} {k}", *at), F.lit(c.pareto_shape * 2))) for k in range(8)]
        return F.coalesce(*(F.when(born(w) <= F.col("day"), w) for w in draws), F.lit(0)).cast("long")

    sender = wallet("sender")
    address = lambda w: F.concat(F.lit("0x"), F.substring(F.sha2(F.concat(F.lit(f"{c.seed}:wallet:"), w.cast("string")), 256), 1, 40))
    rows = rows.withColumn("_from", sender).withColumn("_to", F.when(u("self", *at) < c.self_transfer_rate, F.col("_from")).otherwise(wallet("receiver")))
    raw = F.greatest(F.lit(1), F.floor(F.exp(c.mean_log_amount + c.sd_log_amount * normal("amount", *at)) * 1_000_000)).cast("long")
    second = F.floor(u("second", *at) * 86_400).cast("int")
    when = F.lit(c.start_date).cast("timestamp") + F.make_dt_interval(F.col("day").cast("int"), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))
    hash_ = F.concat(F.lit("0x"), F.sha2(F.concat_ws(":", F.lit(str(c.seed)), *at), 256))
    values = {
        "event_id": F.concat(hash_, F.lit("-0")),
        "block_number": F.lit(20_000_000) + F.col("day") * 43_200 + F.floor(second / 2),
        "block_timestamp": when,
        "transaction_hash": hash_,
        "log_index": F.lit(0),
        "token_address": F.lit(TOKEN),
        "from_address": address(F.col("_from")),
        "to_address": address(F.col("_to")),
        "raw_amount": raw,
        "amount": raw / 1_000_000,
        "is_self_transfer": F.col("_from") == F.col("_to"),
        "chain_id": F.lit(CHAIN),
        "network": F.lit(NETWORK),
        "source": F.lit("synthetic"),
        "ingested_at": when,
    }
    return rows.select(*(values[f.name].cast(f.dataType).alias(f.name) for f in RAW_TRANSFERS))

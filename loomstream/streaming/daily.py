"""Daily activity of wallets over a stream of canonical transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstream.operators.staging import KEY, qualifying, stage_disjoint, wallet_legs


def daily_activity(stream: DataFrame, *, late: str = "1 day") -> DataFrame:
    """wallet_address, activity_date, n_events, sent and received, written when a day is over and `late` has passed.

    Of events with one key the first to arrive within `late` counts (a batch takes the last ingested); later rows are
    dropped, and with them their keys' state.  State grows with the wallets of the days still open.  Null keys are keys
    like others; transfers to oneself measure no activity; a stream without rows gives none.
    """
    fresh = stream.withWatermark("block_timestamp", late).dropDuplicatesWithinWatermark(KEY)
    legs = wallet_legs(qualifying(stage_disjoint(fresh, check=False)))
    of_way = lambda way: F.sum(F.when(F.col("direction") == way, F.col("amount")).otherwise(0.0))
    days = legs.groupBy(F.window("block_timestamp", "1 day").alias("of"), "wallet_address").agg(F.count("*").alias("n_events"), of_way("SEND").alias("sent"), of_way("RECEIVE").alias("received"))
    return days.select("wallet_address", F.to_date("of.start").alias("activity_date"), "n_events", "sent", "received")

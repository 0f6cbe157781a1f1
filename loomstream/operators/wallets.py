"""Models at the grain of a wallet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstream.functions.scalar import day, steady_sum, week

from .staging import qualifying


def first_seen(legs: DataFrame) -> DataFrame:
    at = qualifying(legs).groupBy("wallet_address").agg(F.min("block_timestamp").alias("first_seen_at"))
    return at.select("wallet_address", "first_seen_at", day(F.col("first_seen_at")).alias("first_seen_date"), week(F.col("first_seen_at")).alias("first_seen_week"))


def daily_activity(legs: DataFrame) -> DataFrame:
    rows = qualifying(legs).select("wallet_address", day(F.col("block_timestamp")).alias("activity_date"), "amount")
    return rows.groupBy("wallet_address", "activity_date").agg(F.count("*").alias("event_count"), steady_sum(F.col("amount")).alias("gross_amount"))


def activity_weeks(daily: DataFrame) -> DataFrame:
    return daily.select("wallet_address", week(F.col("activity_date")).alias("activity_week")).distinct()


def gap_days(daily: DataFrame) -> DataFrame:
    """daily with the days since the wallet's last active day; null on its first."""
    before = F.lag("activity_date").over(Window.partitionBy("wallet_address").orderBy("activity_date"))
    return daily.withColumn("gap_days", F.datediff("activity_date", before).cast("long"))


def lifecycle(daily: DataFrame, first: DataFrame) -> DataFrame:
    """The gaps are taken by a window over the rows that are then grouped by the same key: one shuffle, no self-join."""
    totals = gap_days(daily).groupBy("wallet_address").agg(
        F.min("activity_date").alias("first_active_date"),
        F.max("activity_date").alias("last_active_date"),
        F.count("*").alias("active_days"),
        F.sum("event_count").alias("total_events"),
        steady_sum(F.col("gross_amount")).alias("total_amount"),
        F.avg("gap_days").alias("avg_days_between_active_days"),
    )
    return first.select("wallet_address", "first_seen_at", "first_seen_week").join(totals, "wallet_address")


def funnel_flags(daily: DataFrame, first: DataFrame, *, soon: int = 7, late: int = 30) -> DataFrame:
    """Days are aggregated to a row a wallet before the join, so it never multiplies rows."""
    totals = daily.groupBy("wallet_address").agg(F.sum("event_count").alias("events"), F.count("*").alias("days"), F.max("activity_date").alias("last"))
    after = lambda c, n: F.col(c) + F.expr(f"INTERVAL {int(n)} DAYS")
    flag = lambda test: F.when(test, 1).otherwise(0)
    return first.join(totals, "wallet_address").select(
        "wallet_address",
        "first_seen_at",
        after("first_seen_at", soon).alias(f"eligible_at_{soon}d"),
        after("first_seen_at", late).alias(f"eligible_at_{late}d"),
        flag(F.col("events") >= 2).alias("has_second_event"),
        flag(F.col("days") >= 2).alias("active_second_distinct_day"),
        flag(F.col("last") >= after("first_seen_date", soon)).alias(f"active_after_{soon}d"),
        flag(F.col("last") >= after("first_seen_date", late)).alias(f"active_after_{late}d"),
    )


def activation(daily: DataFrame, first: DataFrame, *, days: int = 7, least: int = 2) -> DataFrame:
    """Distinct active days in the first `days` days counted from midnight of the first one."""
    f, d = first.alias("f"), daily.select("wallet_address", "activity_date").alias("d")
    inside = (F.col("d.activity_date") >= F.col("f.first_seen_date")) & (F.col("d.activity_date") < F.col("f.first_seen_date") + F.expr(f"INTERVAL {int(days)} DAYS"))
    joined = f.join(d, (F.col("f.wallet_address") == F.col("d.wallet_address")) & inside, "left")
    counted = joined.groupBy("f.wallet_address", "f.first_seen_at").agg(F.countDistinct("d.activity_date").alias(f"distinct_days_in_first_{days}d"))
    return counted.withColumn("is_activated", F.col(f"distinct_days_in_first_{days}d") >= least)

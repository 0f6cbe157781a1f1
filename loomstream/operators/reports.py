"""Report queries over staged events and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstream.functions.scalar import share, week

from .analytics import summary_retention
from .staging import qualifying


def top_wallet_share(life: DataFrame, tops: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """The volume shares of the largest wallets; only max(tops) rows meet in one task."""
    largest = life.select("total_amount").orderBy(F.desc("total_amount")).limit(max(tops)).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("total_amount"))))
    part = largest.agg(*(F.sum(F.when(F.col("rn") <= n, F.col("total_amount"))).alias(f"_{n}") for n in tops))
    return part.crossJoin(F.broadcast(life.agg(F.sum("total_amount").alias("whole")))).select(*(share(F.col(f"_{n}"), F.col("whole")).alias(f"top{n}_share") for n in tops))


def value_histogram(staged: DataFrame, *, per_decade: int = 4) -> DataFrame:
    rows = qualifying(staged).where("amount > 0")
    bin_ = F.pow(F.lit(10.0), F.floor(F.log10("amount") * per_decade) / per_decade)
    return rows.groupBy(bin_.alias("bin_start")).agg(F.count("*").alias("transfers"))


def dust_caveats(staged: DataFrame) -> DataFrame:
    return qualifying(staged).agg(
        F.count("*").alias("qualifying_events"),
        F.count_if(F.col("amount") == 0).alias("zero_amount_events"),
        F.count_if(F.col("amount") < 1).alias("under_one_events"),
        F.countDistinct("from_address").alias("sender_wallets"),
    )


def wallets_moving(staged: DataFrame, least: float = 1.0) -> DataFrame:
    rows = qualifying(staged).where(F.col("amount") >= least)
    return rows.select(F.col("from_address").alias("w")).union(rows.select("to_address")).distinct().agg(F.count("*").alias("wallets"))


def multi_transfer_transactions(staged: DataFrame) -> DataFrame:
    per = staged.groupBy("transaction_hash").agg(F.count("*").alias("n"))
    many = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return per.agg(F.count("*").alias("transactions"), many.alias("events_in_multi"), share(many, F.sum("n")).alias("multi_share"), F.max("n").alias("max_events"))


def days_per_week(daily_metrics: DataFrame) -> DataFrame:
    return daily_metrics.groupBy(week(F.col("activity_date")).alias("activity_week")).agg(F.count("*").alias("days_covered"))


def cohort_shares(cells: DataFrame) -> DataFrame:
    sizes = cells.select("cohort_week", "cohort_size").distinct()
    whole = Window.partitionBy()
    return sizes.select("cohort_week", (F.col("cohort_week") == F.min("cohort_week").over(whole)).alias("opening"), "cohort_size", share(F.col("cohort_size"), F.sum("cohort_size").over(whole)).alias("share_of_all_wallets"))


def immature_cells_by_offset(cells: DataFrame) -> DataFrame:
    return cells.groupBy("week_offset").agg(F.count_if(~F.col("is_mature")).alias("immature_cells"))


def max_mature_offset(cells: DataFrame) -> DataFrame:
    return cells.where("is_mature").agg(F.max("week_offset").alias("max_offset"), (F.max("week_offset") >= 1).alias("weekly_retention_measurable"))


def pooled_retention(cells: DataFrame) -> DataFrame:
    return summary_retention(cells, (1, 2, 4))


def activated_share(active: DataFrame) -> DataFrame:
    return active.agg(F.avg(F.when(F.col("is_activated"), 1.0).otherwise(0.0).cast("double")).alias("activated_share"))


def high_volume_wallets(segments: DataFrame) -> DataFrame:
    return segments.agg(F.count_if(F.col("volume_segment") == "high_volume").alias("high_volume_wallets"))


def wallet_extremes(life: DataFrame) -> DataFrame:
    return life.agg(F.max("total_events").alias("max_events"), F.max("active_days").alias("max_active_days"), F.count_if(F.col("total_events") == 1).alias("one_event_wallets"))


def anomaly_counts(found: DataFrame) -> DataFrame:
    return found.agg(F.countDistinct("activity_date").alias("days_observed"), F.count("rolling_mad").alias("evaluable_metric_days"), F.countDistinct("metric_name").alias("metrics"), F.count_if(F.col("is_anomaly")).alias("flagged"))


def daily_active_range(daily_metrics: DataFrame) -> DataFrame:
    return daily_metrics.agg(F.min("active_wallets").alias("min_active"), F.median("active_wallets").alias("median_active"), F.max("active_wallets").alias("max_active"))

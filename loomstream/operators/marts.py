"""Marts: activity, segments, retention, concentration, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstream.functions.quantiles import exact_quantiles
from loomstream.functions.ranks import ntile_of, with_rank
from loomstream.functions.scalar import day, share, steady_sum, week, weeks_between

from .staging import qualifying, wallet_legs

METRICS = ["active_wallets", "transfer_count", "total_volume", "median_amount"]


def _activity(staged: DataFrame, active: DataFrame, name: str, period: Column, quantiles: dict[str, float]) -> DataFrame:
    rows = qualifying(staged).select(period.alias(name), "amount")
    tx = rows.groupBy(name).agg(F.count("*").alias("transfer_count"), steady_sum(F.col("amount")).alias("total_volume"))
    ranks = exact_quantiles(rows, [name], "amount", {"median_amount": 0.5, **quantiles}).drop("n")
    return tx.join(ranks, name, "left").join(active, name).select(name, "transfer_count", "active_wallets", "total_volume", "median_amount", *quantiles)


def daily_metrics(staged: DataFrame, daily: DataFrame) -> DataFrame:
    # A wallet has one row a day, so its rows are counted without a distinct.
    active = daily.groupBy("activity_date").agg(F.count("wallet_address").alias("active_wallets"))
    return _activity(staged, active, "activity_date", day(F.col("block_timestamp")), {"p90_amount": 0.9, "p99_amount": 0.99})


def weekly_metrics(staged: DataFrame, weeks: DataFrame) -> DataFrame:
    active = weeks.groupBy("activity_week").agg(F.count("wallet_address").alias("active_wallets"))
    return _activity(staged, active, "activity_week", week(F.col("block_timestamp")), {})


def segment_cutoffs(life: DataFrame) -> DataFrame:
    events = exact_quantiles(life, [], "total_events", {"p50_events": 0.5, "p90_events": 0.9}).drop("n")
    return events.crossJoin(F.broadcast(exact_quantiles(life, [], "total_amount", {"p90_amount": 0.9}).drop("n")))


def wallet_segments(life: DataFrame) -> DataFrame:
    events = F.col("total_events")
    frequency = F.when(events == 1, "one_time").when(events <= F.col("p50_events"), "occasional").when(events <= F.col("p90_events"), "repeat").otherwise("high_frequency")
    volume = F.when(F.col("total_amount") >= F.col("p90_amount"), "high_volume").otherwise("standard_volume")
    one_row = F.broadcast(segment_cutoffs(life))
    return life.crossJoin(one_row).select("wallet_address", "total_events", "total_amount", "active_days", frequency.alias("frequency_segment"), volume.alias("volume_segment"))


def observed_end(staged: DataFrame) -> DataFrame:
    """One row: the end of the last observed day, of all events."""
    return staged.agg((day(F.max("block_timestamp")) + F.expr("INTERVAL 1 DAY")).alias("observed_end"))


def retention_cohorts(staged: DataFrame, first: DataFrame, weeks: DataFrame, *, dense: bool = False) -> DataFrame:
    """Cells of (cohort week, offset).  A cell is mature when its whole week is observed; offset 0 always is.

    Only cells with a returning wallet are given; dense adds the empty cells up to the last observed week.
    """
    cohort = first.select("wallet_address", F.col("first_seen_week").alias("cohort_week"))
    sizes = cohort.groupBy("cohort_week").agg(F.count("*").alias("cohort_size"))
    cells = cohort.join(weeks, "wallet_address").withColumn("week_offset", weeks_between(F.col("cohort_week"), F.col("activity_week"))).where("week_offset >= 0")
    retained = cells.groupBy("cohort_week", "week_offset").agg(F.count("*").alias("retained_wallets"))
    bound = F.broadcast(observed_end(staged))
    out = sizes.join(retained, "cohort_week").crossJoin(bound)
    if dense:
        last = weeks_between(F.col("cohort_week"), week(F.col("observed_end") - F.expr("INTERVAL 1 DAY")))
        every = sizes.crossJoin(bound).withColumn("week_offset", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        out = every.join(retained, ["cohort_week", "week_offset"], "left").withColumn("retained_wallets", F.coalesce("retained_wallets", F.lit(0)))
    end = F.col("cohort_week") + (F.col("week_offset") + 1).cast("int") * F.expr("INTERVAL '7' DAY")
    rate = F.round(share(F.col("retained_wallets"), F.col("cohort_size")), 4)
    return out.select("cohort_week", "cohort_size", "week_offset", "retained_wallets", rate.alias("retention_rate"), ((F.col("week_offset") == 0) | (end <= F.col("observed_end"))).alias("is_mature"))


def concentration(life: DataFrame) -> DataFrame:
    """One row: Gini coefficient and top shares of wallets with a positive amount, from ranks dealt by ranges."""
    base = life.where("total_amount > 0").select("wallet_address", "total_amount", "total_events")
    top = lambda column, rank, above: share(F.sum(F.when(ntile_of(F.col(rank), F.col("n"), 100) > above, F.col(column)).otherwise(0)), F.sum(column))
    by_amount = with_rank(base, "total_amount", "amount_rank")
    by_events = with_rank(base, "total_events", "event_rank")
    gini = F.try_divide(F.sum((2 * F.col("amount_rank") - F.col("n") - 1) * F.col("total_amount")), F.max("n") * F.sum("total_amount"))
    volume = by_amount.agg(gini.alias("gini_coefficient"), top("total_amount", "amount_rank", 99).alias("top1pct_volume_share"), top("total_amount", "amount_rank", 90).alias("top10pct_volume_share"))
    events = by_events.agg(top("total_events", "event_rank", 90).alias("top10pct_transaction_share"))
    return volume.crossJoin(F.broadcast(events))


def concentration_by_week(staged: DataFrame) -> DataFrame:
    """The share of each week's volume that its own top tenth of wallets holds."""
    rows = qualifying(wallet_legs(staged)).select(week(F.col("block_timestamp")).alias("activity_week"), "wallet_address", "amount")
    by_wallet = rows.groupBy("activity_week", "wallet_address").agg(F.sum("amount").alias("wallet_amount"))
    ranked = with_rank(by_wallet, "wallet_amount", "rank", within="activity_week")
    top = F.sum(F.when(ntile_of(F.col("rank"), F.col("n"), 10) == 10, F.col("wallet_amount")).otherwise(0))
    return ranked.groupBy("activity_week").agg(share(top, F.sum("wallet_amount")).alias("top10pct_volume_share"))


def unpivot_metrics(daily: DataFrame) -> DataFrame:
    """One row a metric and day; null values are left out."""
    wide = daily.select("activity_date", *(F.col(m).cast("double").alias(m) for m in METRICS))
    return wide.unpivot("activity_date", METRICS, "metric_name", "metric_value").where("metric_value IS NOT NULL")


def anomalies(daily: DataFrame, *, window: int = 7, threshold: float = 3.5, strict: bool = False) -> DataFrame:
    """Robust z-scores against the median and the median absolute deviation of the days before.

    Medians need `window` earlier days; the deviation's median takes the deviations there are in its window, so it
    starts one day after the first deviation.  strict asks for a full window of deviations, too.
    """
    by_day = Window.partitionBy("metric_name").orderBy("activity_date")
    before = by_day.rowsBetween(-window, -1)
    out = unpivot_metrics(daily).withColumn("_row", F.row_number().over(by_day))
    out = out.withColumn("rolling_median", F.when(F.col("_row") > window, F.percentile("metric_value", 0.5).over(before)))
    out = out.withColumn("_dev", F.abs(F.col("metric_value") - F.col("rolling_median")))
    enough = (F.col("_row") > window) & ((F.count("_dev").over(before) == window) if strict else F.lit(True))
    out = out.withColumn("rolling_mad", F.when(enough, F.percentile("_dev", 0.5).over(before)))
    z = F.when(F.col("rolling_mad") != 0, F.try_divide(0.6745 * (F.col("metric_value") - F.col("rolling_median")), F.col("rolling_mad")))
    out = out.withColumn("robust_z_score", z)
    flagged = F.coalesce((F.col("rolling_mad") > 0) & (F.abs("robust_z_score") > threshold), F.lit(False))
    return out.select("metric_name", "activity_date", "metric_value", "rolling_median", "rolling_mad", "robust_z_score", flagged.alias("is_anomaly"))

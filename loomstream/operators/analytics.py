"""Analytics over the marts: every function takes and returns DataFrames (one row for a summary)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstream.functions.quantiles import exact_quantiles
from loomstream.functions.ranks import with_rank
from loomstream.functions.scalar import share, weeks_between

from .marts import anomalies, observed_end
from .staging import qualifying


def dataset_overview(staged: DataFrame, first: DataFrame) -> DataFrame:
    counts = staged.agg(
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("network")), ", ").alias("networks"),
        F.count("*").alias("raw_events"),
        F.count_if(F.col("is_self_transfer")).alias("self_transfer_events"),
        F.count_if(~F.col("is_self_transfer")).alias("qualifying_events"),
        F.min("block_number").alias("min_block"),
        F.max("block_number").alias("max_block"),
        F.min("block_timestamp").alias("first_event_at"),
        F.max("block_timestamp").alias("last_event_at"),
    )
    anyone = staged.select(F.explode(F.array("from_address", "to_address")).alias("w")).distinct().agg(F.count("*").alias("distinct_wallets_any_event"))
    return counts.crossJoin(anyone).crossJoin(first.agg(F.count("*").alias("distinct_wallets_qualifying")))


def retention_matrix(cells: DataFrame, offsets: Sequence[int] | None = None) -> DataFrame:
    """One row a cohort, one column an offset; cells that are not mature, or not there, are null."""
    offsets = list(offsets) if offsets is not None else sorted(r[0] for r in cells.select("week_offset").distinct().collect())
    return cells.where("is_mature").groupBy("cohort_week").pivot("week_offset", offsets).agg(F.first("retention_rate")).join(cells.select("cohort_week").distinct(), "cohort_week", "right")


def summary_retention(cells: DataFrame, offsets: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """Pooled rates over mature cells; an offset without any has a null rate, not zero."""
    wanted = cells.sparkSession.createDataFrame([(int(o),) for o in offsets], "week_offset long")
    pooled = cells.where("is_mature").groupBy("week_offset").agg(F.count("*").alias("c"), F.sum("cohort_size").alias("s"), F.sum("retained_wallets").alias("r"))
    out = wanted.join(pooled, "week_offset", "left")
    return out.select("week_offset", F.coalesce("c", F.lit(0)).cast("long").alias("mature_cohorts"), F.coalesce("s", F.lit(0)).cast("long").alias("total_cohort_wallets"), share(F.col("r"), F.col("s")).alias("avg_retention_rate"))


def cohort_sizes(cells: DataFrame) -> DataFrame:
    return cells.select("cohort_week", "cohort_size").distinct().orderBy("cohort_week")


@dataclass
class ActivationComparison:
    """Return rates of activated and other wallets of mature cohorts."""

    activated_wallets: int
    non_activated_wallets: int
    activated_return_rate: float | None
    non_activated_return_rate: float | None
    lift_ratio: float | None
    week_offset: int
    mature_only: bool
    opening_cohort_excluded: bool


def activation_vs_retention(staged: DataFrame, first: DataFrame, weeks: DataFrame, active: DataFrame, *, week_offset: int = 4, exclude_opening_cohort: bool = False) -> DataFrame:
    """One row: wallets and return rates of both groups, and their ratio.  A cohort counts when the end of its target
    week is observed (also at offset 0)."""
    cohort = first.select("wallet_address", F.col("first_seen_week").alias("cohort_week"))
    if exclude_opening_cohort:
        opening = first.agg(F.min("first_seen_week").alias("opening"))
        cohort = cohort.crossJoin(F.broadcast(opening)).where("cohort_week > opening").drop("opening")
    due = F.col("cohort_week") + F.expr(f"INTERVAL {7 * (int(week_offset) + 1)} DAYS")
    mature = cohort.crossJoin(F.broadcast(observed_end(staged))).where(due <= F.col("observed_end"))
    back = weeks.select("wallet_address", "activity_week")
    returned = mature.join(back, "wallet_address").where(weeks_between(F.col("cohort_week"), F.col("activity_week")) == week_offset).select("wallet_address", F.lit(1).alias("returned"))
    rows = mature.join(active.select("wallet_address", "is_activated"), "wallet_address").join(returned, "wallet_address", "left")
    n = lambda yes: F.count_if(F.col("is_activated") == yes)
    r = lambda yes: F.count_if((F.col("is_activated") == yes) & F.col("returned").isNotNull())
    out = rows.agg(n(True).alias("activated_wallets"), n(False).alias("non_activated_wallets"), r(True).alias("_a"), r(False).alias("_b"))
    out = out.withColumn("activated_return_rate", share(F.col("_a"), F.col("activated_wallets"))).withColumn("non_activated_return_rate", share(F.col("_b"), F.col("non_activated_wallets")))
    return out.withColumn("lift_ratio", F.try_divide("activated_return_rate", "non_activated_return_rate")).drop("_a", "_b").withColumn("week_offset", F.lit(week_offset)).withColumn("opening_cohort_excluded", F.lit(exclude_opening_cohort))


def activation_comparison(row_of: DataFrame) -> ActivationComparison:
    row = row_of.first().asDict()
    return ActivationComparison(mature_only=True, **row)


def funnel_conversion(staged: DataFrame, funnel: DataFrame) -> DataFrame:
    """Five stages; the last two count a wallet once its window has elapsed."""
    bound = F.broadcast(staged.agg(F.max("block_timestamp").alias("max_observed")))
    due = lambda d: F.col(f"eligible_at_{d}d") <= F.col("max_observed")
    flag = lambda c: F.coalesce(F.sum(c), F.lit(0))
    total = F.count("*")
    one = funnel.crossJoin(bound).agg(
        F.array(
            *(
                F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), n.cast("long").alias("wallets"), of.cast("long").alias("eligible_denominator"))
                for i, (name, n, of) in enumerate(
                    [
                        ("first_event", total, total),
                        ("second_event", flag("has_second_event"), total),
                        ("active_second_distinct_day", flag("active_second_distinct_day"), total),
                        ("active_after_7d", flag(F.when(due(7), F.col("active_after_7d"))), F.count_if(due(7))),
                        ("active_after_30d", flag(F.when(due(30), F.col("active_after_30d"))), F.count_if(due(30))),
                    ]
                )
            )
        ).alias("stages")
    )
    rows = one.select(F.explode("stages").alias("s")).select("s.*").orderBy("step").drop("step")
    return rows.withColumn("conversion_rate", share(F.col("wallets"), F.col("eligible_denominator")))


def segment_distribution(segments: DataFrame) -> DataFrame:
    out = segments.groupBy("frequency_segment").agg(F.count("*").alias("wallets"), F.sum("total_events").alias("total_events"), F.sum("total_amount").alias("total_amount"))
    return out.orderBy(F.desc("total_events"))


def segment_shares(segments: DataFrame) -> DataFrame:
    by = segment_distribution(segments)
    whole = Window.partitionBy()
    shares = {"wallet_share": "wallets", "event_share": "total_events", "volume_share": "total_amount"}
    return by.withColumns({k: share(F.col(c), F.sum(c).over(whole)) for k, c in shares.items()})


def engagement_summary(life: DataFrame) -> DataFrame:
    one = life.agg(F.avg("total_events").alias("avg_events_per_wallet"), F.avg("active_days").alias("avg_active_days"), share(F.count_if(F.col("total_events") > 1), F.count("*")).alias("repeat_rate"))
    for c, name in (("total_events", "median_events_per_wallet"), ("active_days", "median_active_days")):
        one = one.join(exact_quantiles(life, [], c, {name: 0.5}).drop("n"), how="left")
    return one.select("avg_events_per_wallet", "median_events_per_wallet", "avg_active_days", "median_active_days", "repeat_rate")


def value_distribution(staged: DataFrame) -> DataFrame:
    rows = qualifying(staged).select("amount")
    q = exact_quantiles(rows, [], "amount", {f"p{p}_amount": p / 100 for p in (10, 50, 90, 99)}).drop("n")
    one = rows.agg(F.avg("amount").alias("mean_amount"), F.max("amount").alias("max_amount")).join(q, how="left")
    return one.select(F.col("p50_amount").alias("median_amount"), "mean_amount", *q.columns, "max_amount")


def lorenz_curve(life: DataFrame, n_points: int = 100) -> DataFrame:
    """Cumulative shares of wallets and volume at up to n_points evenly spaced ranks."""
    base = life.where("total_amount > 0").select("total_amount")
    ranked = with_rank(base, "total_amount", "rank")
    # Running sums by a coarse bucket of ranks, then within the bucket: no task holds all wallets.
    ranked = ranked.withColumn("bucket", F.floor((F.col("rank") - 1) * 1024 / F.col("n")))
    sums = ranked.groupBy("bucket").agg(F.sum("total_amount").alias("s"))
    before = sums.select("bucket", F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"), F.sum("s").over(Window.partitionBy()).alias("whole"))
    within = F.sum("total_amount").over(Window.partitionBy("bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    m = F.least(F.lit(n_points), F.col("n"))
    spaced = ranked.withColumn("within", within).join(F.broadcast(before), "bucket")
    place = F.col("rank") - 1
    # place is floor(i * (n - 1) / (m - 1)) for some i.
    i = F.ceil(F.try_divide(place * (m - 1), F.col("n") - 1))
    chosen = F.when(F.col("n") == 1, F.lit(True)).otherwise(F.when(m == 1, place == 0).otherwise(F.floor(F.try_divide(i * (F.col("n") - 1), m - 1)) == place))
    return spaced.where(chosen).select(share(F.col("rank"), F.col("n")).alias("cumulative_wallet_share"), share(F.col("before") + F.col("within"), F.col("whole")).alias("cumulative_volume_share"))


def gini_coefficient(values: DataFrame, column: str) -> float:
    """Of the positive values; 0 without any."""
    ranked = with_rank(values.where(F.col(column) > 0).select(F.col(column).cast("double").alias("v")), "v", "rank")
    return ranked.agg(F.try_divide(F.sum((2 * F.col("rank") - F.col("n") - 1) * F.col("v")), F.max("n") * F.sum("v"))).first()[0] or 0.0


def robust_z_scores(series: DataFrame, order: str, value: str, *, window: int = 7) -> DataFrame:
    """series (one row a period) with rolling median, rolling MAD and robust z; both need full windows."""
    before = Window.orderBy(order).rowsBetween(-window, -1)
    full = lambda c: F.when(F.count(c).over(before) == window, F.percentile(c, 0.5).over(before))
    out = series.withColumn("rolling_median", full(value)).withColumn("_dev", F.abs(F.col(value) - F.col("rolling_median")))
    out = out.withColumn("rolling_mad", full("_dev"))
    return out.withColumn("robust_z_score", F.when(F.col("rolling_mad") != 0, 0.6745 * (F.col(value) - F.col("rolling_median")) / F.col("rolling_mad"))).drop("_dev")


def detect_anomalies(series: DataFrame, order: str, value: str, *, window: int = 7, threshold: float = 3.5) -> DataFrame:
    out = robust_z_scores(series, order, value, window=window)
    return out.withColumn("is_anomaly", F.coalesce((F.col("rolling_mad") > 0) & (F.abs("robust_z_score") > threshold), F.lit(False)))


def strict_anomalies(daily: DataFrame) -> DataFrame:
    return anomalies(daily, strict=True)

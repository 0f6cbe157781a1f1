"""Reconciliation: marts computed again from the raw events by another route, and compared row by row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstream.functions.ranks import with_rank
from loomstream.functions.scalar import day, week

from .marts import METRICS, unpivot_metrics

TOLERANCE = 1e-9


def raw_legs(raw: DataFrame) -> DataFrame:
    """(w, t, a): two rows for each raw event between two addresses."""
    ok = raw.where(F.lower("from_address") != F.lower("to_address"))
    side = lambda c: ok.select(F.lower(c).alias("w"), F.col("block_timestamp").alias("t"), F.col("amount").alias("a"))
    return side("from_address").unionByName(side("to_address"))


def _off(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b)) > TOLERANCE * F.greatest(F.lit(1.0), F.abs(F.col(b)))


def _mismatches(joined: DataFrame, test: Column) -> DataFrame:
    return joined.agg(F.count_if(F.coalesce(test, F.lit(False))).alias("mismatches"))


def row_counts(raw: DataFrame, staged: DataFrame) -> DataFrame:
    """1 unless raw rows, distinct raw keys and staged rows are as many; so raw with repeated keys is a mismatch."""
    keys = raw.select("transaction_hash", "log_index").distinct()
    one = raw.agg(F.count("*").alias("r")).crossJoin(staged.agg(F.count("*").alias("s"))).crossJoin(keys.agg(F.count("*").alias("k")))
    return one.select(((F.col("r") != F.col("s")) | (F.col("r") != F.col("k"))).cast("long").alias("mismatches"))


def self_flag(raw: DataFrame) -> DataFrame:
    return _mismatches(raw, F.col("is_self_transfer") != (F.lower("from_address") == F.lower("to_address")))


def activity(raw: DataFrame, mart: DataFrame, key: str) -> DataFrame:
    """Daily or weekly metrics: counts, volume, median and active wallets of each period."""
    period = (day if key == "activity_date" else week)(F.col("t"))
    ok = raw.where(F.lower("from_address") != F.lower("to_address")).select(F.col("block_timestamp").alias("t"), "amount")
    ref = ok.groupBy(period.alias("d")).agg(F.count("*").alias("n"), F.sum("amount").alias("v"), F.median("amount").alias("med"))
    who = raw_legs(raw).groupBy(period.alias("dw")).agg(F.countDistinct("w").alias("aw"))
    joined = mart.join(ref, F.col(key) == F.col("d"), "full_outer").join(who, F.col("d") == F.col("dw"), "full_outer")
    test = F.col(key).isNull() | F.col("d").isNull() | (F.col("transfer_count") != F.col("n")) | (F.col("active_wallets") != F.col("aw")) | _off("total_volume", "v") | (F.col("median_amount") != F.col("med"))
    return _mismatches(joined, test)


def wallet_totals(raw: DataFrame, life: DataFrame) -> DataFrame:
    ref = raw_legs(raw).groupBy("w").agg(F.count("*").alias("n"), F.sum("a").alias("s"), F.min("t").alias("first_t"))
    joined = life.join(ref, F.col("wallet_address") == F.col("w"), "full_outer")
    test = F.col("wallet_address").isNull() | F.col("w").isNull() | (F.col("total_events") != F.col("n")) | _off("total_amount", "s") | (F.col("first_seen_at") != F.col("first_t"))
    return _mismatches(joined, test)


def retention_cells(raw: DataFrame, cells: DataFrame) -> DataFrame:
    """The observed end is that of events between two addresses here."""
    weeks = raw_legs(raw).select("w", week(F.col("t")).alias("wk")).distinct()
    first = weeks.groupBy("w").agg(F.min("wk").alias("c"))
    sizes = first.groupBy("c").agg(F.count("*").alias("size"))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    ref = first.join(weeks, "w").groupBy("c", F.floor((seconds("wk") - seconds("c")) / 604800).cast("long").alias("off")).agg(F.count("*").alias("retained"))
    end = raw.where(F.lower("from_address") != F.lower("to_address")).agg((day(F.max("block_timestamp")) + F.expr("INTERVAL 1 DAY")).alias("end"))
    closes = F.col("c") + (F.col("off") + 1).cast("int") * F.expr("INTERVAL '7' DAY")
    ref = ref.join(sizes, "c").crossJoin(F.broadcast(end)).withColumn("mature", (F.col("off") == 0) | (closes <= F.col("end")))
    joined = cells.join(ref, (F.col("cohort_week") == F.col("c")) & (F.col("week_offset") == F.col("off")), "full_outer")
    test = F.col("cohort_week").isNull() | F.col("c").isNull() | (F.col("retained_wallets") != F.col("retained")) | (F.col("cohort_size") != F.col("size")) | (F.col("is_mature") != F.col("mature"))
    return _mismatches(joined, test)


def concentration(raw: DataFrame, mart: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Gini as the mean difference of ranked amounts, and top shares cut at the rank where the buckets begin, both from
    a histogram of equal amounts instead of ranks of wallets."""
    amounts = raw_legs(raw).groupBy("w").agg(F.sum("a").alias("s")).where("s > 0")
    # The last rank of equal amounts ends them, whichever of them has it.
    ranked = with_rank(amounts.select("s"), "s", "rank")
    h = ranked.groupBy("s").agg(F.count("*").alias("m"), F.max("rank").alias("last"), F.max("n").alias("n"))
    rank_sum = F.col("m") * (2 * F.col("last") - F.col("m") + 1) / 2
    start = lambda b: F.floor(F.col("n") / 100) * b + F.least(F.col("n") % 100, F.lit(b))
    above = lambda b: F.greatest(F.lit(0), F.least(F.col("m"), F.col("last") - start(b))) * F.col("s")
    total = F.sum(F.col("m") * F.col("s"))
    ref = h.agg(
        F.try_divide(F.sum((2 * rank_sum - F.col("m") * (F.col("n") + 1)) * F.col("s")), F.max("n") * total).alias("g"),
        F.try_divide(F.sum(above(99)), total).alias("t1"),
        F.try_divide(F.sum(above(90)), total).alias("t10"),
    )
    off = lambda a, b: (F.abs(F.col(a) - F.col(b)) > tolerance).cast("long")
    return mart.crossJoin(ref).select((off("gini_coefficient", "g") + off("top1pct_volume_share", "t1") + off("top10pct_volume_share", "t10")).alias("mismatches"))


def _rolling_twin(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("activity_date")
    before = pdf["metric_value"].shift(1)
    median = before.rolling(7, min_periods=7).median()
    mad = (pdf["metric_value"] - median).abs().shift(1).rolling(7, min_periods=1).median()
    z = 0.6745 * (pdf["metric_value"] - median) / mad.where(mad > 0)
    return pd.DataFrame({"metric_name": pdf["metric_name"], "activity_date": pdf["activity_date"], "z": z, "flag": z.abs() > 3.5})


def anomalies(daily: DataFrame, found: DataFrame) -> DataFrame:
    """Flags and scores against a pandas twin of each metric's series (one row a day)."""
    series = unpivot_metrics(daily)
    twin = series.groupBy("metric_name").applyInPandas(_rolling_twin, "metric_name string, activity_date timestamp_ntz, z double, flag boolean")
    joined = found.join(twin, ["metric_name", "activity_date"], "full_outer")
    z_off = F.abs(F.col("robust_z_score") - F.col("z")) > 1e-6 * F.greatest(F.lit(1.0), F.abs("z"))
    return _mismatches(joined, F.col("is_anomaly").isNull() | F.col("flag").isNull() | (F.col("is_anomaly") != F.col("flag")) | F.coalesce(z_off, F.lit(False)))


def sampled_wallets(life: DataFrame, k: int = 2000) -> DataFrame:
    """The heaviest k/2 wallets and k/2 chosen by a hash."""
    heavy = life.orderBy(F.desc("total_events"), "wallet_address").limit(k // 2).select("wallet_address")
    other = life.orderBy(F.sha2("wallet_address", 256), "wallet_address").limit(k - k // 2).select("wallet_address")
    return heavy.union(other).distinct()


def _wallet_twin(pdf: pd.DataFrame) -> pd.DataFrame:
    days = pdf["t"].dt.floor("D")
    first, distinct = days.min(), days.drop_duplicates()
    soon = int((distinct < first + pd.Timedelta(days=7)).sum())
    return pd.DataFrame(
        {
            "w": [pdf["w"].iloc[0]], "soon": [soon], "second": [int(len(pdf) >= 2)], "second_day": [int(len(distinct) >= 2)],
            "after7": [int(distinct.max() >= first + pd.Timedelta(days=7))], "after30": [int(distinct.max() >= first + pd.Timedelta(days=30))],
        }
    )


def wallet_sample(raw: DataFrame, life: DataFrame, funnel: DataFrame, active: DataFrame, k: int = 2000) -> DataFrame:
    """Activation and funnel flags of sampled wallets, derived again from their raw events in pandas."""
    sample = sampled_wallets(life, k).withColumnRenamed("wallet_address", "w")
    twin = raw_legs(raw).join(F.broadcast(sample), "w", "left_semi").select("w", "t").groupBy("w").applyInPandas(_wallet_twin, "w string, soon long, second long, second_day long, after7 long, after30 long")
    marts = funnel.join(active.select("wallet_address", "distinct_days_in_first_7d"), "wallet_address").join(sample, F.col("wallet_address") == F.col("w"), "left_semi")
    joined = twin.join(marts, F.col("w") == F.col("wallet_address"), "full_outer")
    pairs = [("distinct_days_in_first_7d", "soon"), ("has_second_event", "second"), ("active_second_distinct_day", "second_day"), ("active_after_7d", "after7"), ("active_after_30d", "after30")]
    test = F.col("w").isNull() | F.col("wallet_address").isNull()
    for a, b in pairs:
        test = test | (F.col(a) != F.col(b))
    return _mismatches(joined, test)


def reconcile_all(raw: DataFrame, house, sample: int = 2000) -> dict[str, int]:
    """Mismatches of every reconciliation of a Warehouse against its raw events."""
    parts = {
        "row_counts": row_counts(raw, house.stg_transfers),
        "self_transfer_flag": self_flag(raw),
        "daily_metrics": activity(raw, house.mart_daily_metrics, "activity_date"),
        "weekly_metrics": activity(raw, house.mart_weekly_metrics, "activity_week"),
        "wallet_totals": wallet_totals(raw, house.int_wallet_lifecycle),
        "retention_cells": retention_cells(raw, house.mart_retention_cohorts),
        "concentration": concentration(raw, house.mart_concentration),
        "anomalies": anomalies(house.mart_daily_metrics, house.mart_anomalies),
        "wallet_sample": wallet_sample(raw, house.int_wallet_lifecycle, house.int_wallet_funnel_flags, house.int_wallet_activation, sample),
    }
    return {name: df.first()["mismatches"] for name, df in parts.items()}


__all__ = ["METRICS", "reconcile_all"]

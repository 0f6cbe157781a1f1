"""Named queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from loomstream.functions import scalar
from loomstream.functions.ranks import with_rank
from loomstream.operators import analytics, experiments, marts, quality, reconcile, reports, staging, wallets
from loomstream.sources import adapters, segments

from .oracles import model_sql
from .warehouse import Warehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LOGS = {"events": adapters.events_log, "orders": adapters.orders_log}


def register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


TABLES = {"events": ["events"], "orders": ["orders", "lineitem"]}
#: Warehouses whose hubs are kept for the next query on the same files; the longest unused goes first.
KEPT: OrderedDict[tuple, Warehouse] = OrderedDict()
MOST_KEPT = 4


def _files(spark: SparkSession, path: str) -> tuple:
    """What tells the files of a table from later ones below the same path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in system.listStatus(hadoop)))


def house(spark: SparkSession, sf_dir: str, log: str, dedup: bool = True) -> Warehouse:
    """The models of a log; staged events, daily activity and life cycles are kept from one query to the next."""
    key = (spark.sparkContext.applicationId, log, dedup, *(_files(spark, f"{sf_dir}/{t}.parquet") for t in TABLES[log]))
    if key not in KEPT:
        KEPT[key] = Warehouse(LOGS[log](spark, sf_dir), dedup=dedup, share=True)
        while len(KEPT) > MOST_KEPT:
            _, old = KEPT.popitem(last=False)
            old.forget()
    KEPT.move_to_end(key)
    return KEPT[key]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded: sums of doubles depend on their order."""
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def of(name: str, log: str, build: Callable[[Warehouse], DataFrame], select: str, *, digits: int = 4, strict: bool = False, dedup: bool = True) -> None:
    """A query on the models of a log; in select, {r:x} stands for x rounded."""
    sql = select
    while "{r:" in sql:
        a = sql.index("{r:")
        b = sql.index("}", a)
        sql = f"{sql[:a]}round({sql[a + 3 : b]}, {digits}){sql[b + 1 :]}"
    register(name, lambda spark, sf_dir: rounded(build(house(spark, sf_dir, log, dedup)), digits), model_sql(log, sql, strict=strict))


STAGED = ["event_id", "block_number", "block_timestamp", "transaction_hash", "log_index", "from_address", "to_address", "raw_amount", "amount", "is_self_transfer"]
STAGED_SQL = f"SELECT {', '.join(STAGED)} FROM stg"

# Models.
of("stg_transfers_dedup", "orders", lambda w: w.stg_transfers.select(*STAGED), STAGED_SQL)
of("stg_transfers_disjoint", "events", lambda w: w.stg_transfers.select(*STAGED), STAGED_SQL, dedup=False)
of("stg_wallet_events", "events", lambda w: w.stg_wallet_events, "SELECT * FROM legs")
of("wallet_first_seen", "orders", lambda w: w.int_wallet_first_seen, "SELECT * FROM first_seen")
of("wallet_daily_activity", "orders", lambda w: w.int_wallet_daily_activity, "SELECT wallet_address, activity_date, event_count, {r:gross_amount} AS gross_amount FROM daily", digits=2)
of("wallet_activity_weeks", "orders", lambda w: w.int_wallet_activity_weeks, "SELECT * FROM weeks")
of("wallet_gap_days", "orders", lambda w: wallets.gap_days(w.int_wallet_daily_activity).select("wallet_address", "activity_date", F.col("gap_days").cast("double").alias("gap_days")), "SELECT wallet_address, activity_date, CAST(gap_days AS DOUBLE) AS gap_days FROM gaps")
LIFE = "wallet_address, first_seen_at, first_seen_week, first_active_date, last_active_date, active_days, total_events, {r:total_amount} AS total_amount, {r:avg_days_between_active_days} AS avg_days_between_active_days"
of("wallet_lifecycle", "orders", lambda w: w.int_wallet_lifecycle, f"SELECT {LIFE} FROM life", digits=2)
of("wallet_funnel_flags", "orders", lambda w: w.int_wallet_funnel_flags, "SELECT * FROM flags")
of("lifecycle_funnel", "events", lambda w: w.mart_lifecycle_funnel, "SELECT * FROM flags")
of("wallet_activation", "orders", lambda w: w.int_wallet_activation, "SELECT * FROM activation")
DAILY = "activity_date, transfer_count, active_wallets, {r:total_volume} AS total_volume, {r:median_amount} AS median_amount, {r:p90_amount} AS p90_amount, {r:p99_amount} AS p99_amount"
of("daily_metrics", "events", lambda w: w.mart_daily_metrics, f"SELECT {DAILY} FROM daily_metrics")
WEEKLY = "activity_week, transfer_count, active_wallets, {r:total_volume} AS total_volume, {r:median_amount} AS median_amount"
of("weekly_metrics", "orders", lambda w: w.mart_weekly_metrics, f"SELECT {WEEKLY} FROM weekly_metrics")
of("wallet_segments", "orders", lambda w: w.mart_wallet_segments, "SELECT wallet_address, total_events, {r:total_amount} AS total_amount, active_days, frequency_segment, volume_segment FROM segments", digits=2)
of("retention_cohorts", "orders", lambda w: w.mart_retention_cohorts, "SELECT * FROM cells")
of("concentration", "events", lambda w: w.mart_concentration, "SELECT {r:gini_coefficient} AS gini_coefficient, {r:top1pct_volume_share} AS top1pct_volume_share, {r:top10pct_volume_share} AS top10pct_volume_share, {r:top10pct_transaction_share} AS top10pct_transaction_share FROM conc", digits=8)
of("concentration_by_week", "orders", lambda w: w.mart_concentration_by_week, "SELECT activity_week, {r:top10pct_volume_share} AS top10pct_volume_share FROM conc_week", digits=8)
ANOMALIES = "SELECT metric_name, activity_date, {r:metric_value} AS metric_value, {r:rolling_median} AS rolling_median, {r:rolling_mad} AS rolling_mad, {r:robust_z_score} AS robust_z_score, is_anomaly FROM anomalies"
of("anomalies", "events", lambda w: w.mart_anomalies, ANOMALIES)
of("strict_anomalies", "events", lambda w: analytics.strict_anomalies(w.mart_daily_metrics), ANOMALIES, strict=True)

# Analytics.
of(
    "dataset_overview",
    "events",
    lambda w: analytics.dataset_overview(w.stg_transfers, w.int_wallet_first_seen).drop("networks"),
    """SELECT string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, count(*) AS raw_events, count(*) FILTER (is_self_transfer) AS self_transfer_events, count(*) FILTER (NOT is_self_transfer) AS qualifying_events,
  min(block_number) AS min_block, max(block_number) AS max_block, min(block_timestamp) AS first_event_at, max(block_timestamp) AS last_event_at,
  (SELECT count(*) FROM (SELECT from_address FROM stg UNION SELECT to_address FROM stg)) AS distinct_wallets_any_event, (SELECT count(*) FROM first_seen) AS distinct_wallets_qualifying FROM stg""",
)
OFFSETS = [0, 1, 2, 4, 8]
of(
    "retention_matrix",
    "orders",
    lambda w: analytics.retention_matrix(w.mart_retention_cohorts, OFFSETS).select("cohort_week", *(F.col(f"`{o}`").alias(f"w{o}") for o in OFFSETS)),
    "SELECT cohort_week, " + ", ".join(f"max(retention_rate) FILTER (week_offset = {o} AND is_mature) AS w{o}" for o in OFFSETS) + " FROM cells GROUP BY 1",
)
SUMMARY = """SELECT CAST(o AS BIGINT) AS week_offset, count(cohort_week) AS mature_cohorts, CAST(coalesce(sum(cohort_size), 0) AS BIGINT) AS total_cohort_wallets, {r:CAST(sum(retained_wallets) AS DOUBLE) / sum(cohort_size)} AS avg_retention_rate
FROM unnest([%s]) t(o) LEFT JOIN cells ON week_offset = o AND is_mature GROUP BY 1"""
of("summary_retention", "orders", lambda w: analytics.summary_retention(w.mart_retention_cohorts), SUMMARY % "1, 2, 4, 8")
of("pooled_retention", "events", lambda w: reports.pooled_retention(w.mart_retention_cohorts), SUMMARY % "1, 2, 4")
of("cohort_sizes", "orders", lambda w: analytics.cohort_sizes(w.mart_retention_cohorts), "SELECT DISTINCT cohort_week, cohort_size FROM cells")


def _activation(offset: int, no_opening: bool) -> tuple[Callable[[Warehouse], DataFrame], str]:
    build = lambda w: analytics.activation_vs_retention(w.stg_transfers, w.int_wallet_first_seen, w.int_wallet_activity_weeks, w.int_wallet_activation, week_offset=offset, exclude_opening_cohort=no_opening)
    opening = " AND first_seen_week > (SELECT min(first_seen_week) FROM first_seen)" if no_opening else ""
    sql = f""", mature AS (SELECT f.wallet_address, first_seen_week, is_activated, EXISTS (SELECT 1 FROM weeks k WHERE k.wallet_address = f.wallet_address AND date_diff('week', f.first_seen_week, k.activity_week) = {offset}) AS back
  FROM first_seen f JOIN activation a ON f.wallet_address = a.wallet_address CROSS JOIN seen_until WHERE first_seen_week + INTERVAL {7 * (offset + 1)} DAY <= observed_end{opening}),
n AS (SELECT count(*) FILTER (is_activated) AS a, count(*) FILTER (NOT is_activated) AS b, count(*) FILTER (is_activated AND back) AS ra, count(*) FILTER (NOT is_activated AND back) AS rb FROM mature),
s AS (SELECT *, CAST(ra AS DOUBLE) / nullif(a, 0) AS x, CAST(rb AS DOUBLE) / nullif(b, 0) AS y FROM n)
SELECT a AS activated_wallets, b AS non_activated_wallets, {{r:x}} AS activated_return_rate, {{r:y}} AS non_activated_return_rate, {{r:x / nullif(y, 0)}} AS lift_ratio, CAST({offset} AS INTEGER) AS week_offset, {no_opening} AS opening_cohort_excluded FROM s"""
    return build, sql


for _name, _offset, _no in (("activation_vs_w2", 2, False), ("activation_vs_w4", 4, False), ("activation_vs_w4_no_opening", 4, True)):
    of(_name, "orders", *_activation(_offset, _no), digits=6)
of(
    "funnel_conversion",
    "events",
    lambda w: analytics.funnel_conversion(w.stg_transfers, w.mart_lifecycle_funnel),
    """, b AS (SELECT *, eligible_at_7d <= m AS e7, eligible_at_30d <= m AS e30 FROM flags, (SELECT max(block_timestamp) AS m FROM stg)),
c AS (SELECT count(*) AS t, sum(has_second_event) AS s, sum(active_second_distinct_day) AS d, count(*) FILTER (e7) AS n7, sum(active_after_7d) FILTER (e7) AS a7, count(*) FILTER (e30) AS n30, sum(active_after_30d) FILTER (e30) AS a30 FROM b),
x AS (SELECT 'first_event' AS stage, t AS w, t AS e FROM c UNION ALL SELECT 'second_event', s, t FROM c UNION ALL SELECT 'active_second_distinct_day', d, t FROM c UNION ALL SELECT 'active_after_7d', a7, n7 FROM c UNION ALL SELECT 'active_after_30d', a30, n30 FROM c)
SELECT stage, CAST(coalesce(w, 0) AS BIGINT) AS wallets, CAST(e AS BIGINT) AS eligible_denominator, {r:CAST(coalesce(w, 0) AS DOUBLE) / nullif(e, 0)} AS conversion_rate FROM x""",
)
DISTRIBUTION = "SELECT frequency_segment, count(*) AS wallets, CAST(sum(total_events) AS BIGINT) AS total_events, {r:sum(total_amount)} AS total_amount"
of("segment_distribution", "orders", lambda w: analytics.segment_distribution(w.mart_wallet_segments), DISTRIBUTION + " FROM segments GROUP BY 1", digits=2)
of(
    "segment_shares",
    "orders",
    lambda w: analytics.segment_shares(w.mart_wallet_segments).drop("total_amount"),
    """SELECT frequency_segment, count(*) AS wallets, CAST(sum(total_events) AS BIGINT) AS total_events, {r:count(*) / sum(count(*)) OVER ()} AS wallet_share, {r:sum(total_events) / sum(sum(total_events)) OVER ()} AS event_share,
  {r:sum(total_amount) / sum(sum(total_amount)) OVER ()} AS volume_share FROM segments GROUP BY 1""",
    digits=8,
)
of("segment_cutoffs", "orders", lambda w: marts.segment_cutoffs(w.int_wallet_lifecycle), "SELECT {r:p50_events} AS p50_events, {r:p90_events} AS p90_events, {r:p90_amount} AS p90_amount FROM cutoffs", digits=2)
of(
    "engagement_summary",
    "orders",
    lambda w: analytics.engagement_summary(w.int_wallet_lifecycle),
    "SELECT {r:avg(total_events)} AS avg_events_per_wallet, {r:median(total_events)} AS median_events_per_wallet, {r:avg(active_days)} AS avg_active_days, {r:median(active_days)} AS median_active_days, {r:avg(CASE WHEN total_events > 1 THEN 1.0 ELSE 0 END)} AS repeat_rate FROM life",
)
of(
    "value_distribution",
    "orders",
    lambda w: analytics.value_distribution(w.stg_transfers),
    "SELECT {r:median(amount)} AS median_amount, {r:avg(amount)} AS mean_amount, " + ", ".join(f"{{r:quantile_cont(amount, {p / 100})}} AS p{p}_amount" for p in (10, 50, 90, 99)) + ", {r:max(amount)} AS max_amount FROM stg WHERE NOT is_self_transfer",
    digits=2,
)
of("concentration_summary", "orders", lambda w: w.mart_concentration, "SELECT {r:gini_coefficient} AS gini_coefficient, {r:top1pct_volume_share} AS top1pct_volume_share, {r:top10pct_volume_share} AS top10pct_volume_share, {r:top10pct_transaction_share} AS top10pct_transaction_share FROM conc", digits=8)
of(
    "lorenz_curve",
    "events",
    lambda w: analytics.lorenz_curve(w.int_wallet_lifecycle),
    """, l AS (SELECT amount_rank, n, sum(total_amount) OVER (ORDER BY amount_rank) / sum(total_amount) OVER () AS v FROM ranked),
p AS (SELECT DISTINCT CAST(floor(i * (n - 1.0) / (least(100, n) - 1)) AS BIGINT) + 1 AS amount_rank FROM range(100) t(i), (SELECT max(n) AS n FROM ranked) WHERE i < least(100, n))
SELECT {r:CAST(amount_rank AS DOUBLE) / n} AS cumulative_wallet_share, {r:v} AS cumulative_volume_share FROM l JOIN p USING (amount_rank)""",
    digits=8,
)

# Reports.
of("top_wallet_share", "orders", lambda w: reports.top_wallet_share(w.int_wallet_lifecycle), ", t AS (SELECT total_amount, row_number() OVER (ORDER BY total_amount DESC) AS rn FROM life) SELECT " + ", ".join(f"{{r:sum(total_amount) FILTER (rn <= {n}) / sum(total_amount)}} AS top{n}_share" for n in (1, 10, 100)) + " FROM t", digits=8)
of("value_histogram_log", "orders", lambda w: reports.value_histogram(w.stg_transfers), "SELECT {r:power(10, floor(log10(amount) * 4) / 4)} AS bin_start, count(*) AS transfers FROM stg WHERE NOT is_self_transfer AND amount > 0 GROUP BY 1")
of("dust_caveats", "events", lambda w: reports.dust_caveats(w.stg_transfers), "SELECT count(*) AS qualifying_events, count(*) FILTER (amount = 0) AS zero_amount_events, count(*) FILTER (amount < 1) AS under_one_events, count(DISTINCT from_address) AS sender_wallets FROM stg WHERE NOT is_self_transfer")
of("wallets_moving_min_amount", "events", lambda w: reports.wallets_moving(w.stg_transfers), "SELECT count(DISTINCT wallet_address) AS wallets FROM legs WHERE NOT is_self_transfer AND amount >= 1")
of("multi_transfer_transactions", "orders", lambda w: reports.multi_transfer_transactions(w.stg_transfers), ", p AS (SELECT count(*) AS n FROM stg GROUP BY transaction_hash) SELECT count(*) AS transactions, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS events_in_multi, {r:coalesce(sum(n) FILTER (n > 1), 0) / sum(n)} AS multi_share, max(n) AS max_events FROM p")
of("days_per_week", "orders", lambda w: reports.days_per_week(w.mart_daily_metrics), "SELECT date_trunc('week', activity_date) AS activity_week, count(*) AS days_covered FROM daily_metrics GROUP BY 1")
of("cohort_shares", "orders", lambda w: reports.cohort_shares(w.mart_retention_cohorts), ", s AS (SELECT DISTINCT cohort_week, cohort_size FROM cells) SELECT cohort_week, cohort_week = min(cohort_week) OVER () AS opening, cohort_size, {r:cohort_size / sum(cohort_size) OVER ()} AS share_of_all_wallets FROM s", digits=8)
of("immature_cells_by_offset", "orders", lambda w: reports.immature_cells_by_offset(w.mart_retention_cohorts), "SELECT week_offset, count(*) FILTER (NOT is_mature) AS immature_cells FROM cells GROUP BY 1")
of("max_mature_offset", "orders", lambda w: reports.max_mature_offset(w.mart_retention_cohorts), "SELECT max(week_offset) AS max_offset, max(week_offset) >= 1 AS weekly_retention_measurable FROM cells WHERE is_mature")
of("activated_share", "orders", lambda w: reports.activated_share(w.int_wallet_activation), "SELECT {r:avg(CASE WHEN is_activated THEN 1.0 ELSE 0 END)} AS activated_share FROM activation", digits=8)
of("high_volume_wallets", "orders", lambda w: reports.high_volume_wallets(w.mart_wallet_segments), "SELECT count(*) AS high_volume_wallets FROM segments WHERE volume_segment = 'high_volume'")
of("wallet_extremes", "orders", lambda w: reports.wallet_extremes(w.int_wallet_lifecycle), "SELECT max(total_events) AS max_events, max(active_days) AS max_active_days, count(*) FILTER (total_events = 1) AS one_event_wallets FROM life")
of("anomaly_counts", "events", lambda w: reports.anomaly_counts(w.mart_anomalies), "SELECT count(DISTINCT activity_date) AS days_observed, count(rolling_mad) AS evaluable_metric_days, count(DISTINCT metric_name) AS metrics, count(*) FILTER (is_anomaly) AS flagged FROM anomalies")
of("daily_active_range", "events", lambda w: reports.daily_active_range(w.mart_daily_metrics), "SELECT min(active_wallets) AS min_active, {r:median(active_wallets)} AS median_active, max(active_wallets) AS max_active FROM daily_metrics")

# Validation: violations and mismatches.
CHECKS = {
    "transaction_hash_not_null": "count(*) FILTER (transaction_hash IS NULL)", "block_number_nonnegative": "count(*) FILTER (block_number < 0)", "log_index_nonnegative": "count(*) FILTER (log_index < 0)",
    "from_address_format_valid": "count(*) FILTER (NOT regexp_full_match(from_address, '0x[0-9a-f]{40}'))", "to_address_format_valid": "count(*) FILTER (NOT regexp_full_match(to_address, '0x[0-9a-f]{40}'))",
    "amount_nonnegative": "count(*) FILTER (amount < 0 OR raw_amount < 0)", "token_contract_matches_expected": "count(*) FILTER (FALSE)", "block_timestamp_not_null": "count(*) FILTER (block_timestamp IS NULL)",
    "event_id_unique": "count(*) - count(DISTINCT event_id)", "no_duplicate_transaction_hash_log_index": "count(*) - count(*) + (SELECT count(*) FROM (SELECT 1 FROM stg GROUP BY transaction_hash, log_index HAVING count(*) > 1))",
    "normalized_row_count_matches_deduped_raw": "abs(count(*) - (SELECT count(DISTINCT transaction_hash || '-' || log_index) FROM raw))",
}
register(
    "dq_checks",
    lambda spark, sf_dir: quality.dq_checks((w := house(spark, sf_dir, "orders")).stg_transfers, w.raw, adapters.TOKEN),
    model_sql("orders", ", c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS check_name, CAST({e} AS BIGINT) AS violations FROM stg" for n, e in CHECKS.items()) + ") SELECT check_name, violations, violations = 0 AS passed FROM c"),
)
ZERO = "SELECT CAST(0 AS BIGINT) AS mismatches"
of("reconcile_daily", "events", lambda w: reconcile.activity(w.raw, w.mart_daily_metrics, "activity_date"), ZERO)
of("reconcile_weekly", "events", lambda w: reconcile.activity(w.raw, w.mart_weekly_metrics, "activity_week"), ZERO)
of("reconcile_wallet_totals", "events", lambda w: reconcile.wallet_totals(w.raw, w.int_wallet_lifecycle), ZERO)
of("reconcile_retention", "events", lambda w: reconcile.retention_cells(w.raw, w.mart_retention_cohorts), ZERO)
of("reconcile_row_counts", "events", lambda w: reconcile.row_counts(w.raw, w.stg_transfers), "SELECT CAST(NOT ((SELECT count(*) FROM raw) = (SELECT count(*) FROM stg)) AS BIGINT) AS mismatches")
of("reconcile_row_counts_repeated", "orders", lambda w: reconcile.row_counts(w.raw, w.stg_transfers), "SELECT CAST(NOT ((SELECT count(*) FROM raw) = (SELECT count(*) FROM stg)) AS BIGINT) AS mismatches")
of("reconcile_self_flag", "events", lambda w: reconcile.self_flag(w.raw), ZERO)
of("reconcile_concentration", "events", lambda w: reconcile.concentration(w.raw, w.mart_concentration), ZERO)
of("reconcile_anomalies", "events", lambda w: reconcile.anomalies(w.mart_daily_metrics, w.mart_anomalies), ZERO)
of("reconcile_wallet_sample", "events", lambda w: reconcile.wallet_sample(w.raw, w.int_wallet_lifecycle, w.int_wallet_funnel_flags, w.int_wallet_activation), ZERO)


# The same on tampered input: what a check that always answers "fine" would not find.
nth = lambda n: F.pmod(F.col("block_number"), F.lit(n)) == 0


def _damage() -> dict[str, Column]:
    return {
        "transaction_hash": F.when(nth(89), None).otherwise(F.col("transaction_hash")),
        "from_address": F.when(nth(97), "0xNOT").otherwise(F.col("from_address")),
        "amount": F.when(nth(97), -F.col("amount") - 1).otherwise(F.col("amount")),
        "token_address": F.when(nth(83), "0x" + "1" * 40).otherwise(F.col("token_address")),
        "block_timestamp": F.when(nth(79), None).otherwise(F.col("block_timestamp")),
        "log_index": F.when(nth(73), -1).otherwise(F.col("log_index")),
    }


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged events of which some break each check, and some are there twice, against the raw ones."""
    w = house(spark, sf_dir, "events")
    bad = w.stg_transfers.withColumns(_damage())
    return quality.dq_checks(bad.unionByName(bad.where(nth(101))), w.raw, adapters.TOKEN)


DAMAGED_SQL = """, once AS (SELECT CASE WHEN block_number % 89 = 0 THEN NULL ELSE transaction_hash END AS h, CASE WHEN block_number % 73 = 0 THEN -1 ELSE log_index END AS i, *  FROM stg),
d AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE block_number % 101 = 0), per AS (SELECT h, i, count(*) AS n FROM d GROUP BY 1, 2),
c AS (SELECT unnest([
  {'check_name': 'transaction_hash_not_null', 'violations': count(*) FILTER (block_number % 89 = 0)}, {'check_name': 'block_number_nonnegative', 'violations': count(*) FILTER (block_number < 0)},
  {'check_name': 'log_index_nonnegative', 'violations': count(*) FILTER (block_number % 73 = 0)}, {'check_name': 'from_address_format_valid', 'violations': count(*) FILTER (block_number % 97 = 0)},
  {'check_name': 'to_address_format_valid', 'violations': count(*) FILTER (NOT regexp_full_match(to_address, '0x[0-9a-f]{40}'))}, {'check_name': 'amount_nonnegative', 'violations': count(*) FILTER (block_number % 97 = 0)},
  {'check_name': 'token_contract_matches_expected', 'violations': count(*) FILTER (block_number % 83 = 0)}, {'check_name': 'block_timestamp_not_null', 'violations': count(*) FILTER (block_number % 79 = 0)},
  {'check_name': 'event_id_unique', 'violations': count(*) - (SELECT count(*) FROM per)}, {'check_name': 'no_duplicate_transaction_hash_log_index', 'violations': (SELECT count(*) FROM per WHERE n > 1)},
  {'check_name': 'normalized_row_count_matches_deduped_raw', 'violations': abs(count(*) - (SELECT count(DISTINCT transaction_hash || '-' || log_index) FROM raw))}], recursive := true) FROM d)
SELECT check_name, CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM c"""
register("dq_checks_damaged", _damaged, model_sql("events", DAMAGED_SQL))
odd_day = lambda: F.dayofyear("activity_date") % 2 == 1
odd_week = lambda: F.weekofyear("activity_week") % 2 == 1
odd_wallet = lambda: F.substring("wallet_address", -1, 1) == "7"
more = lambda c, test: F.when(test, F.col(c) + 1).otherwise(F.col(c))
of("reconcile_daily_tampered", "events", lambda w: reconcile.activity(w.raw, w.mart_daily_metrics.withColumn("transfer_count", more("transfer_count", odd_day())), "activity_date"), "SELECT count(*) AS mismatches FROM daily_metrics WHERE dayofyear(activity_date) % 2 = 1")
of("reconcile_weekly_tampered", "events", lambda w: reconcile.activity(w.raw, w.mart_weekly_metrics.withColumn("active_wallets", more("active_wallets", odd_week())), "activity_week"), "SELECT count(*) AS mismatches FROM weekly_metrics WHERE weekofyear(activity_week) % 2 = 1")
of("reconcile_wallet_totals_tampered", "events", lambda w: reconcile.wallet_totals(w.raw, w.int_wallet_lifecycle.withColumn("total_amount", more("total_amount", odd_wallet())).where(F.substring("wallet_address", -1, 1) != "9")), "SELECT count(*) AS mismatches FROM life WHERE right(wallet_address, 1) IN ('7', '9')")
of("reconcile_retention_tampered", "events", lambda w: reconcile.retention_cells(w.raw, w.mart_retention_cohorts.withColumn("is_mature", F.col("is_mature") & (F.col("week_offset") % 3 != 0))), "SELECT count(*) AS mismatches FROM cells WHERE is_mature AND week_offset % 3 = 0")
of("reconcile_self_flag_tampered", "events", lambda w: reconcile.self_flag(w.raw.withColumn("is_self_transfer", F.col("is_self_transfer") | nth(97))), "SELECT count(*) AS mismatches FROM raw WHERE block_number % 97 = 0 AND from_address <> to_address")
of("reconcile_concentration_tampered", "events", lambda w: reconcile.concentration(w.raw, w.mart_concentration.withColumns({"gini_coefficient": F.col("gini_coefficient") - 0.05, "top1pct_volume_share": F.col("top1pct_volume_share") + 0.01})), "SELECT CAST(2 AS BIGINT) AS mismatches FROM conc")
of("reconcile_anomalies_tampered", "events", lambda w: reconcile.anomalies(w.mart_daily_metrics, w.mart_anomalies.withColumn("is_anomaly", F.col("is_anomaly") != odd_day())), "SELECT count(*) AS mismatches FROM anomalies WHERE dayofyear(activity_date) % 2 = 1")
of("reconcile_wallet_sample_tampered", "events", lambda w: reconcile.wallet_sample(w.raw, w.int_wallet_lifecycle, w.int_wallet_funnel_flags.withColumn("has_second_event", F.when(odd_wallet(), 1 - F.col("has_second_event")).otherwise(F.col("has_second_event"))), w.int_wallet_activation, 20), ", s AS ((SELECT wallet_address FROM life ORDER BY total_events DESC, wallet_address LIMIT 10) UNION (SELECT wallet_address FROM life ORDER BY sha256(wallet_address) LIMIT 10)) SELECT count(*) AS mismatches FROM s WHERE right(wallet_address, 1) = '7'")


# Experiments on customers: a unit converts with an order over 200,000, its metric is its largest order.
def experiment_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    units = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("unit_id"), F.col("c_acctbal").alias("pre_period_metric"))
    joined = units.join(orders, F.col("unit_id") == F.col("o_custkey"), "left").withColumn("continuous_metric", F.coalesce("top", F.lit(0.0))).withColumn("converted", (F.col("continuous_metric") > 200000).cast("int"))
    return experiments.assign_units(joined, "unit_id").select("unit_id", "group", "converted", "continuous_metric", "pre_period_metric")


FRAME = """WITH x AS (
  SELECT c_custkey AS unit_id, CASE WHEN CAST('0x' || substr(sha256('exp:' || c_custkey), 1, 8) AS UBIGINT) / 4294967296.0 < 0.5 THEN 'treatment' ELSE 'control' END AS "group",
    CAST(coalesce(top, 0) > 200000 AS INTEGER) AS converted, coalesce(top, 0.0) AS y, c_acctbal AS x FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) ON o_custkey = c_custkey)
"""
register("assign_units", lambda s, d: experiment_frame(s, d).select("unit_id", "group"), FRAME + 'SELECT unit_id, "group" FROM x')
register("srm_counts", lambda s, d: experiment_frame(s, d).groupBy("group").agg(F.count("*").alias("n")), FRAME + 'SELECT "group", count(*) AS n FROM x GROUP BY 1')


def _arms(spark: SparkSession, sf_dir: str) -> tuple[Row, Row]:
    arms = {r["group"]: r for r in experiments.arm_statistics(experiment_frame(spark, sf_dir)).collect()}
    return arms[experiments.CONTROL], arms[experiments.TREATMENT]


def _ztest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = _arms(spark, sf_dir)
    z = experiments.two_proportion_ztest(c["conversions"], c["n"], t["conversions"], t["n"])
    return spark.createDataFrame([(round(z["control_rate"], 8), round(z["treatment_rate"], 8), round(z["z"], 6))], "control_rate double, treatment_rate double, z double")


register("ztest_components", _ztest, FRAME + ', a AS (SELECT avg(converted) FILTER ("group" = \'control\') AS q, avg(converted) FILTER ("group" = \'treatment\') AS p, avg(converted) AS r, count(*) FILTER ("group" = \'control\') AS n, count(*) FILTER ("group" = \'treatment\') AS m FROM x) SELECT round(q, 8) AS control_rate, round(p, 8) AS treatment_rate, round((p - q) / sqrt(r * (1 - r) * (1.0 / n + 1.0 / m)), 6) AS z FROM a')


def _welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = _arms(spark, sf_dir)
    w = experiments.welch_ttest(c["mean"], c["variance"], c["n"], t["mean"], t["variance"], t["n"])
    return spark.createDataFrame([(round(w["t"], 6), round(w["df"], 4))], "t double, df double")


register("welch_components", _welch, FRAME + ', a AS (SELECT avg(y) FILTER ("group" = \'treatment\') - avg(y) FILTER ("group" = \'control\') AS d, var_samp(y) FILTER ("group" = \'control\') / count(*) FILTER ("group" = \'control\') AS a, var_samp(y) FILTER ("group" = \'treatment\') / count(*) FILTER ("group" = \'treatment\') AS b, count(*) FILTER ("group" = \'control\') AS n, count(*) FILTER ("group" = \'treatment\') AS m FROM x) SELECT round(d / sqrt(a + b), 6) AS t, round((a + b) * (a + b) / (a * a / (n - 1) + b * b / (m - 1)), 4) AS df FROM a')
register("cuped_theta", lambda s, d: rounded(experiments.cuped_theta(experiment_frame(s, d)).select("theta", "pre_mean", "variance_reduction"), 6), FRAME + "SELECT round(covar_samp(y, x) / var_samp(x), 6) AS theta, round(avg(x), 6) AS pre_mean, round(covar_samp(y, x) * covar_samp(y, x) / var_samp(x) / var_samp(y), 6) AS variance_reduction FROM x")
register("cuped_adjusted", lambda s, d: rounded(experiments.cuped_adjust(experiment_frame(s, d).where(F.col("group") == "control")).select("unit_id", "adjusted_metric"), 2), FRAME + ", t AS (SELECT covar_samp(y, x) / var_samp(x) AS theta, avg(x) AS m FROM x WHERE \"group\" = 'control') SELECT unit_id, round(y - theta * (x - m), 2) AS adjusted_metric FROM x, t WHERE \"group\" = 'control'")

# Ingestion.
register("segment_plan", lambda s, d: segments.plan_segments_df(s, 1, 9_500, 2_000), "SELECT lo AS start_block, least(lo + 1999, 9500) AS end_block FROM range(1, 9501, 2000) t(lo)")


def _integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of the log has its segment; blocks 0 to 9,999 are expected and planned in any case."""
    log = adapters.events_log(spark, sf_dir)
    low, high = log.agg(F.min("block_number"), F.max("block_number")).first()
    start = min(0, 0 if low is None else low // 500 * 500)
    plan = segments.plan_segments_df(spark, start, max(9_999, 0 if high is None else high), 500)
    return segments.segment_counts(log, plan)


register(
    "segment_integrity",
    _integrity,
    """SELECT lo AS start_block, least(lo + 499, hi) AS end_block, count(event_id) AS row_count
FROM (SELECT unnest(range(s, hi + 1, 500)) AS lo, hi FROM (SELECT CAST(least(0, floor(coalesce(min(event_id), 0) / 500.0) * 500) AS BIGINT) AS s, greatest(9999, coalesce(max(event_id), 0)) AS hi FROM events))
LEFT JOIN events ON event_id BETWEEN lo AND least(lo + 499, hi) GROUP BY 1, 2""",
)
register("window_cut", lambda s, d: segments.window_rows(adapters.events_log(s, d), 100, 399).select("block_number", "log_index", "transaction_hash", "amount"), model_sql("events", "SELECT block_number, log_index, transaction_hash, amount FROM raw WHERE block_number BETWEEN 100 AND 399"))
register(
    "decode_hex_address",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.lower(F.hex("c_custkey")).alias("h")).select("c_custkey", scalar.topic_address(F.concat(F.lit("0x"), F.lpad("h", 64, "0"))).alias("address"), scalar.hex_long(F.concat(F.lit("0x"), F.lpad("h", 64, "0"))).alias("value"), scalar.units(scalar.hex_long(F.concat(F.lit("0x"), F.col("h")))).alias("amount")),
    "SELECT c_custkey, printf('0x%040x', c_custkey) AS address, c_custkey AS value, c_custkey / 1000000.0 AS amount FROM customer",
)

# Single operators.
of("join_full_outer_diff", "events", lambda w: w.int_wallet_daily_activity.alias("a").join(w.mart_daily_metrics.alias("b"), F.col("a.activity_date") == F.col("b.activity_date"), "full_outer").agg(F.count_if(F.col("a.activity_date").isNull() | F.col("b.activity_date").isNull()).alias("unmatched"), F.count("*").alias("rows")), "SELECT count(*) FILTER (a.activity_date IS NULL OR b.activity_date IS NULL) AS unmatched, count(*) AS rows FROM daily a FULL JOIN daily_metrics b ON a.activity_date = b.activity_date")
of("join_band_left", "orders", lambda w: wallets.activation(w.int_wallet_daily_activity, w.int_wallet_first_seen, days=30, least=3).select("wallet_address", "distinct_days_in_first_30d", "is_activated"), "SELECT f.wallet_address, count(DISTINCT activity_date) AS distinct_days_in_first_30d, count(DISTINCT activity_date) >= 3 AS is_activated FROM first_seen f LEFT JOIN daily d ON d.wallet_address = f.wallet_address AND activity_date < first_seen_date + INTERVAL 30 DAY GROUP BY 1")
of("join_left_anti", "events", lambda w: w.int_wallet_first_seen.join(staging.qualifying(w.stg_transfers), F.col("wallet_address") == F.col("from_address"), "left_anti").select("wallet_address"), "SELECT wallet_address FROM first_seen f WHERE NOT EXISTS (SELECT 1 FROM stg WHERE from_address = f.wallet_address AND NOT is_self_transfer)")
of("join_left_anti_suppliers", "orders", lambda w: w.int_wallet_first_seen.join(staging.qualifying(w.stg_transfers).where("amount > 90000"), F.col("wallet_address") == F.col("from_address"), "left_anti").select("wallet_address"), "SELECT wallet_address FROM first_seen f WHERE NOT EXISTS (SELECT 1 FROM stg WHERE from_address = f.wallet_address AND NOT is_self_transfer AND amount > 90000)")
of("order_by_all", "events", lambda w: w.mart_daily_metrics.select("activity_date", "transfer_count").orderBy("activity_date", "transfer_count"), "SELECT activity_date, transfer_count FROM daily_metrics ORDER BY ALL")
CUT = "2000-06-15"
register(
    "retention_cohorts_censored",
    lambda spark, sf_dir: Warehouse(adapters.orders_log(spark, sf_dir, before=CUT)).mart_retention_cohorts,
    model_sql("orders", "SELECT * FROM cells").replace("JOIN orders ON l_orderkey = o_orderkey)", f"JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < TIMESTAMP '{CUT}')"),
)
of("join_left_semi", "orders", lambda w: w.stg_wallet_events.join(reconcile.sampled_wallets(w.int_wallet_lifecycle, 20), "wallet_address", "left_semi").select("event_id", "wallet_address"), ", s AS ((SELECT wallet_address FROM life ORDER BY total_events DESC, wallet_address LIMIT 10) UNION (SELECT wallet_address FROM life ORDER BY sha256(wallet_address) LIMIT 10)) SELECT event_id, wallet_address FROM legs WHERE wallet_address IN (SELECT wallet_address FROM s)")
of("union_distinct", "events", lambda w: w.stg_transfers.select(F.col("from_address").alias("w")).union(w.stg_transfers.select("to_address")).distinct(), "SELECT from_address AS w FROM stg UNION SELECT to_address FROM stg")
of("topk_wallets", "orders", lambda w: w.int_wallet_lifecycle.select("wallet_address", "total_events").orderBy(F.desc("total_events"), "wallet_address").limit(25), "SELECT wallet_address, total_events FROM life ORDER BY total_events DESC, wallet_address LIMIT 25")
of("unpivot_metrics", "events", lambda w: marts.unpivot_metrics(w.mart_daily_metrics), "SELECT metric_name, activity_date, {r:metric_value} AS metric_value FROM long")
of("pivot_segments", "orders", lambda w: w.mart_wallet_segments.groupBy("frequency_segment").pivot("volume_segment", ["high_volume", "standard_volume"]).agg(F.count(F.lit(1))).na.fill(0), "SELECT frequency_segment, count(*) FILTER (volume_segment = 'high_volume') AS high_volume, count(*) FILTER (volume_segment = 'standard_volume') AS standard_volume FROM segments GROUP BY 1")
of("listagg_sources", "events", lambda w: w.stg_transfers.select(F.when(F.col("is_self_transfer"), "self").otherwise("between").alias("k")).agg(F.listagg_distinct("k", F.lit(", ")).alias("kinds")).select(F.array_join(F.array_sort(F.split("kinds", ", ")), ", ").alias("kinds")), "SELECT string_agg(DISTINCT k, ', ' ORDER BY k) AS kinds FROM (SELECT CASE WHEN is_self_transfer THEN 'self' ELSE 'between' END AS k FROM stg)")
of("global_rank", "orders", lambda w: with_rank(w.int_wallet_lifecycle.select("wallet_address"), "wallet_address", "rank").select("wallet_address", "rank", "n"), "SELECT wallet_address, row_number() OVER (ORDER BY wallet_address) AS rank, count(*) OVER () AS n FROM life")
of("having_repeats", "orders", lambda w: w.raw.groupBy("transaction_hash", "log_index").agg(F.count("*").alias("n")).where("n > 1"), "SELECT transaction_hash, log_index, count(*) AS n FROM raw GROUP BY 1, 2 HAVING count(*) > 1")
of("window_running_share", "events", lambda w: w.mart_daily_metrics.select("activity_date", F.round(F.sum("total_volume").over(Window.orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running_volume")), "SELECT activity_date, round(sum(total_volume) OVER (ORDER BY activity_date), 2) AS running_volume FROM daily_metrics")
of("bool_and_flags", "orders", lambda w: w.mart_retention_cohorts.groupBy("week_offset").agg(F.bool_and("is_mature").alias("all_mature")), "SELECT week_offset, bool_and(is_mature) AS all_mature FROM cells GROUP BY 1")

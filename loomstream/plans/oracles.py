"""The models in SQL, one common table expression each, from which every query's SQL is put together."""

from __future__ import annotations

RAW = {
    "events": """raw AS (
  SELECT 'ev' || event_id AS transaction_hash, CAST(0 AS BIGINT) AS log_index, event_id AS block_number, ts AS block_timestamp, printf('0x%040x', user_id) AS from_address,
    printf('0x%040x', CAST(json_extract_string(props, '$.k') AS BIGINT)) AS to_address, CAST(round(value * 1000000) AS BIGINT) AS raw_amount, value AS amount, ts AS ingested_at, 'events' AS source
  FROM events)""",
    "orders": """raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS transaction_hash, CAST(l_linenumber AS BIGINT) AS log_index, l_orderkey AS block_number, l_shipdate AS block_timestamp, printf('0x%040x', o_custkey) AS from_address,
    printf('0x%040x', l_suppkey) AS to_address, CAST(round(l_extendedprice * 1000000) AS BIGINT) AS raw_amount, l_extendedprice AS amount, l_shipdate AS ingested_at, 'orders' AS source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}

CTES = {
    "stg": """stg AS (
  SELECT transaction_hash || '-' || log_index AS event_id, block_number, block_timestamp, transaction_hash, log_index, from_address, to_address, raw_amount, amount, from_address = to_address AS is_self_transfer, source
  FROM (SELECT *, row_number() OVER (PARTITION BY transaction_hash, log_index ORDER BY ingested_at DESC, raw_amount DESC, from_address DESC, to_address DESC) AS nth FROM raw) WHERE nth = 1)""",
    "legs": """legs AS (
  SELECT event_id, block_timestamp, transaction_hash, from_address AS wallet_address, to_address AS counterparty_address, 'SEND' AS direction, amount, is_self_transfer FROM stg
  UNION ALL SELECT event_id, block_timestamp, transaction_hash, to_address, from_address, 'RECEIVE', amount, is_self_transfer FROM stg)""",
    "first_seen": """first_seen AS (
  SELECT wallet_address, min(block_timestamp) AS first_seen_at, date_trunc('day', min(block_timestamp)) AS first_seen_date, date_trunc('week', min(block_timestamp)) AS first_seen_week
  FROM legs WHERE NOT is_self_transfer GROUP BY wallet_address)""",
    "daily": """daily AS (
  SELECT wallet_address, date_trunc('day', block_timestamp) AS activity_date, count(*) AS event_count, sum(amount) AS gross_amount FROM legs WHERE NOT is_self_transfer GROUP BY 1, 2)""",
    "weeks": "weeks AS (SELECT DISTINCT wallet_address, date_trunc('week', activity_date) AS activity_week FROM daily)",
    "gaps": "gaps AS (SELECT *, date_diff('day', lag(activity_date) OVER (PARTITION BY wallet_address ORDER BY activity_date), activity_date) AS gap_days FROM daily)",
    "life": """life AS (
  SELECT g.wallet_address, f.first_seen_at, f.first_seen_week, min(activity_date) AS first_active_date, max(activity_date) AS last_active_date, count(DISTINCT activity_date) AS active_days,
    CAST(sum(event_count) AS BIGINT) AS total_events, sum(gross_amount) AS total_amount, avg(gap_days) AS avg_days_between_active_days
  FROM gaps g JOIN first_seen f ON g.wallet_address = f.wallet_address GROUP BY ALL)""",
    "flags": """flags AS (
  SELECT f.wallet_address, f.first_seen_at, f.first_seen_at + INTERVAL 7 DAY AS eligible_at_7d, f.first_seen_at + INTERVAL 30 DAY AS eligible_at_30d, CAST(total_events >= 2 AS INTEGER) AS has_second_event,
    CAST(active_days >= 2 AS INTEGER) AS active_second_distinct_day, CAST(last_active_date >= first_seen_date + INTERVAL 7 DAY AS INTEGER) AS active_after_7d, CAST(last_active_date >= first_seen_date + INTERVAL 30 DAY AS INTEGER) AS active_after_30d
  FROM first_seen f JOIN life l ON f.wallet_address = l.wallet_address)""",
    "activation": """activation AS (
  SELECT f.wallet_address, f.first_seen_at, count(DISTINCT d.activity_date) AS distinct_days_in_first_7d, count(DISTINCT d.activity_date) >= 2 AS is_activated
  FROM first_seen f LEFT JOIN daily d ON d.wallet_address = f.wallet_address AND d.activity_date BETWEEN f.first_seen_date AND f.first_seen_date + INTERVAL 6 DAY GROUP BY 1, 2)""",
    "daily_metrics": """daily_metrics AS (
  SELECT t.activity_date, transfer_count, active_wallets, total_volume, median_amount, p90_amount, p99_amount FROM (
    SELECT date_trunc('day', block_timestamp) AS activity_date, count(*) AS transfer_count, sum(amount) AS total_volume, median(amount) AS median_amount, quantile_cont(amount, 0.9) AS p90_amount, quantile_cont(amount, 0.99) AS p99_amount
    FROM stg WHERE NOT is_self_transfer GROUP BY 1) t
  JOIN (SELECT activity_date, count(DISTINCT wallet_address) AS active_wallets FROM daily GROUP BY 1) w ON t.activity_date = w.activity_date)""",
    "weekly_metrics": """weekly_metrics AS (
  SELECT t.activity_week, transfer_count, active_wallets, total_volume, median_amount FROM (
    SELECT date_trunc('week', block_timestamp) AS activity_week, count(*) AS transfer_count, sum(amount) AS total_volume, median(amount) AS median_amount FROM stg WHERE NOT is_self_transfer GROUP BY 1) t
  JOIN (SELECT date_trunc('week', activity_date) AS activity_week, count(DISTINCT wallet_address) AS active_wallets FROM daily GROUP BY 1) w ON t.activity_week = w.activity_week)""",
    "cutoffs": "cutoffs AS (SELECT quantile_cont(total_events, 0.5) AS p50_events, quantile_cont(total_events, 0.9) AS p90_events, quantile_cont(total_amount, 0.9) AS p90_amount FROM life)",
    "segments": """segments AS (
  SELECT wallet_address, total_events, total_amount, active_days,
    CASE WHEN total_events = 1 THEN 'one_time' WHEN total_events <= p50_events THEN 'occasional' WHEN total_events <= p90_events THEN 'repeat' ELSE 'high_frequency' END AS frequency_segment,
    CASE WHEN total_amount >= p90_amount THEN 'high_volume' ELSE 'standard_volume' END AS volume_segment FROM life, cutoffs)""",
    "seen_until": "seen_until AS (SELECT date_trunc('day', max(block_timestamp)) + INTERVAL 1 DAY AS observed_end FROM stg)",
    "cells": """cells AS (
  SELECT r.cohort_week, cohort_size, week_offset, retained_wallets, round(CAST(retained_wallets AS DOUBLE) / cohort_size, 4) AS retention_rate,
    week_offset = 0 OR r.cohort_week + to_days(CAST(7 * (week_offset + 1) AS INTEGER)) <= observed_end AS is_mature
  FROM (SELECT first_seen_week AS cohort_week, date_diff('week', first_seen_week, activity_week) AS week_offset, count(DISTINCT f.wallet_address) AS retained_wallets
    FROM first_seen f JOIN weeks w ON f.wallet_address = w.wallet_address GROUP BY 1, 2) r
  JOIN (SELECT first_seen_week AS cohort_week, count(*) AS cohort_size FROM first_seen GROUP BY 1) s ON r.cohort_week = s.cohort_week CROSS JOIN seen_until)""",
    "ranked": """ranked AS (
  SELECT *, row_number() OVER (ORDER BY total_amount) AS amount_rank, ntile(100) OVER (ORDER BY total_amount) AS amount_tile, ntile(100) OVER (ORDER BY total_events) AS event_tile, count(*) OVER () AS n FROM life WHERE total_amount > 0)""",
    "conc": """conc AS (
  SELECT sum((2 * amount_rank - n - 1) * total_amount) / (max(n) * sum(total_amount)) AS gini_coefficient, sum(total_amount) FILTER (amount_tile = 100) / sum(total_amount) AS top1pct_volume_share,
    sum(total_amount) FILTER (amount_tile > 90) / sum(total_amount) AS top10pct_volume_share, sum(total_events) FILTER (event_tile > 90) / sum(total_events) AS top10pct_transaction_share FROM ranked)""",
    "conc_week": """conc_week AS (
  SELECT activity_week, coalesce(sum(wallet_amount) FILTER (decile = 10), 0) / sum(wallet_amount) AS top10pct_volume_share FROM (
    SELECT *, ntile(10) OVER (PARTITION BY activity_week ORDER BY wallet_amount) AS decile FROM (
      SELECT date_trunc('week', block_timestamp) AS activity_week, wallet_address, sum(amount) AS wallet_amount FROM legs WHERE NOT is_self_transfer GROUP BY 1, 2)) GROUP BY 1)""",
    "long": """long AS (
  SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY activity_date) AS nth FROM (
    UNPIVOT (SELECT activity_date, CAST(active_wallets AS DOUBLE) AS active_wallets, CAST(transfer_count AS DOUBLE) AS transfer_count, total_volume, median_amount FROM daily_metrics)
    ON active_wallets, transfer_count, total_volume, median_amount INTO NAME metric_name VALUE metric_value))""",
    "medians": """medians AS (
  SELECT *, CASE WHEN nth > 7 THEN median(metric_value) OVER (PARTITION BY metric_name ORDER BY activity_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS rolling_median FROM long)""",
    "mads": """mads AS (
  SELECT *, CASE WHEN nth > {start} THEN median(abs(metric_value - rolling_median)) OVER (PARTITION BY metric_name ORDER BY activity_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS rolling_mad FROM medians)""",
    "anomalies": """anomalies AS (
  SELECT metric_name, activity_date, metric_value, rolling_median, rolling_mad, CASE WHEN rolling_mad <> 0 THEN 0.6745 * (metric_value - rolling_median) / rolling_mad END AS robust_z_score,
    coalesce(rolling_mad > 0 AND abs(0.6745 * (metric_value - rolling_median) / CASE WHEN rolling_mad > 0 THEN rolling_mad END) > 3.5, FALSE) AS is_anomaly FROM mads)""",
}

#: The common table expressions in an order in which each uses only earlier ones.
ORDER = list(CTES)


def model_sql(log: str, select: str, *, strict: bool = False) -> str:
    """select over the models of a log; unused ones cost nothing."""
    parts = [RAW[log], *(CTES[name].replace("{start}", "14" if strict else "7") for name in ORDER)]
    return "WITH " + ",\n".join(parts) + "\n" + select

"""All summaries of a warehouse as plain values: for the screen, and as JSON that is the same from run to run."""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Mapping
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from loomstream.functions.scalar import significant

from . import analytics, marts, reports


def plain(value: object) -> object:
    """JSON's values: times in ISO form, ten significant digits (sums of doubles depend on their order), no NaN."""
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else significant(value)
    return value


def findings(house) -> dict[str, list[dict]]:
    """The rows of every summary by its name; each is a few rows, whatever the log's size."""
    w = house
    active = lambda offset, no: analytics.activation_vs_retention(w.stg_transfers, w.int_wallet_first_seen, w.int_wallet_activity_weeks, w.int_wallet_activation, week_offset=offset, exclude_opening_cohort=no)
    tables = {
        "dataset": analytics.dataset_overview(w.stg_transfers, w.int_wallet_first_seen),
        "weekly_activity": w.mart_weekly_metrics.orderBy("activity_week"),
        "daily_active_range": reports.daily_active_range(w.mart_daily_metrics),
        "value_distribution": analytics.value_distribution(w.stg_transfers),
        "dust": reports.dust_caveats(w.stg_transfers),
        "multi_transfer_transactions": reports.multi_transfer_transactions(w.stg_transfers),
        "cohort_sizes": analytics.cohort_sizes(w.mart_retention_cohorts),
        "retention_matrix": analytics.retention_matrix(w.mart_retention_cohorts).orderBy("cohort_week"),
        "retention_summary": analytics.summary_retention(w.mart_retention_cohorts).orderBy("week_offset"),
        "activation": active(2, False).unionByName(active(2, True)).unionByName(active(4, False)).unionByName(active(4, True)).orderBy("week_offset", "opening_cohort_excluded"),
        "funnel": analytics.funnel_conversion(w.stg_transfers, w.mart_lifecycle_funnel),
        "segments": analytics.segment_shares(w.mart_wallet_segments).orderBy(F.desc("total_events")),
        "segment_cutoffs": marts.segment_cutoffs(w.int_wallet_lifecycle),
        "engagement": analytics.engagement_summary(w.int_wallet_lifecycle),
        "concentration": w.mart_concentration,
        "concentration_by_week": w.mart_concentration_by_week.orderBy("activity_week"),
        "anomaly_counts": reports.anomaly_counts(w.mart_anomalies),
        "anomalies": w.mart_anomalies.where("is_anomaly").orderBy("metric_name", "activity_date"),
    }
    return {name: [plain(r.asDict()) for r in df.collect()] for name, df in tables.items()}


def save(found: Mapping, path: str) -> None:
    Path(path).write_text(json.dumps(plain(found), indent=2, sort_keys=True))


def window_matches(report: Mapping, found: Mapping) -> list[str]:
    """Where a window's report (its .window.json) and the dataset's summary disagree."""
    dataset = found["dataset"][0]
    pairs = {"row_count": "raw_events", "first_event_at": "first_event_at", "last_event_at": "last_event_at"}
    same = lambda a, b: str(a).replace("T", " ")[:19] == str(b).replace("T", " ")[:19]
    wrong = [f"{a}: {report[a]} in the window, {dataset[b]} in the dataset" for a, b in pairs.items() if not same(report[a], dataset[b])]
    if dataset["min_block"] is not None and not report["start_block"] <= dataset["min_block"] <= dataset["max_block"] <= report["end_block"]:
        wrong.append("blocks outside of the window")
    return wrong

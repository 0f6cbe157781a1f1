"""The model graph: every model of one event log as a lazy DataFrame, hubs shared."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from loomstream.operators import marts, staging, wallets


@dataclass
class Warehouse:
    """Models of one raw event log; each is built when first asked for and builds what it needs."""

    raw: DataFrame
    dedup: bool = True
    share: bool = False  # keep the hubs in storage, for callers that compute many models
    report: dict[str, float] = field(default_factory=dict)
    _kept: list[DataFrame] = field(default_factory=list, repr=False)

    def _hub(self, df: DataFrame) -> DataFrame:
        if self.share:
            self._kept.append(df.persist())
        return df

    def forget(self) -> None:
        """Give the hubs' storage back; they are computed again where they are still asked for."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    @cached_property
    def stg_transfers(self) -> DataFrame:
        return self._hub(staging.stage_dedup(self.raw) if self.dedup else staging.stage_disjoint(self.raw))

    @cached_property
    def stg_wallet_events(self) -> DataFrame:
        return staging.wallet_legs(self.stg_transfers)

    @cached_property
    def int_wallet_first_seen(self) -> DataFrame:
        return wallets.first_seen(self.stg_wallet_events)

    @cached_property
    def int_wallet_daily_activity(self) -> DataFrame:
        return self._hub(wallets.daily_activity(self.stg_wallet_events))

    @cached_property
    def int_wallet_activity_weeks(self) -> DataFrame:
        return wallets.activity_weeks(self.int_wallet_daily_activity)

    @cached_property
    def int_wallet_lifecycle(self) -> DataFrame:
        return self._hub(wallets.lifecycle(self.int_wallet_daily_activity, self.int_wallet_first_seen))

    @cached_property
    def int_wallet_funnel_flags(self) -> DataFrame:
        return wallets.funnel_flags(self.int_wallet_daily_activity, self.int_wallet_first_seen)

    @cached_property
    def int_wallet_activation(self) -> DataFrame:
        return wallets.activation(self.int_wallet_daily_activity, self.int_wallet_first_seen)

    @cached_property
    def mart_daily_metrics(self) -> DataFrame:
        return marts.daily_metrics(self.stg_transfers, self.int_wallet_daily_activity)

    @cached_property
    def mart_weekly_metrics(self) -> DataFrame:
        return marts.weekly_metrics(self.stg_transfers, self.int_wallet_activity_weeks)

    @cached_property
    def mart_wallet_segments(self) -> DataFrame:
        return marts.wallet_segments(self.int_wallet_lifecycle)

    @cached_property
    def mart_retention_cohorts(self) -> DataFrame:
        return marts.retention_cohorts(self.stg_transfers, self.int_wallet_first_seen, self.int_wallet_activity_weeks)

    @cached_property
    def mart_lifecycle_funnel(self) -> DataFrame:
        return self.int_wallet_funnel_flags

    @cached_property
    def mart_concentration(self) -> DataFrame:
        return marts.concentration(self.int_wallet_lifecycle)

    @cached_property
    def mart_concentration_by_week(self) -> DataFrame:
        return marts.concentration_by_week(self.stg_transfers)

    @cached_property
    def mart_anomalies(self) -> DataFrame:
        return marts.anomalies(self.mart_daily_metrics)

    def save(self, database: str | None = None) -> dict[str, int]:
        """Write every model as a table and return row counts; seconds by model are kept in report."""
        counts = {}
        for name in MODELS:
            began = time.perf_counter()
            table = f"{database}.{name}" if database else name
            getattr(self, name).write.mode("overwrite").saveAsTable(table)
            counts[name] = self.raw.sparkSession.table(table).count()
            self.report[name] = time.perf_counter() - began
        return counts

    def views(self) -> None:
        for name in MODELS:
            getattr(self, name).createOrReplaceTempView(name)


MODELS = [name for name, value in vars(Warehouse).items() if isinstance(value, cached_property)]

"""Models, checks, reconciliation, experiments and ingestion on small inputs."""

import datetime as dt
import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstream import registry
from loomstream.functions import scalar, stats
from loomstream.functions.quantiles import exact_quantiles
from loomstream.functions.ranks import ntile_of, with_rank
from loomstream.operators import analytics, experiments, findings, marts, quality, reconcile, staging
from loomstream.plans.warehouse import Warehouse
from loomstream.schema import RAW_TRANSFERS
from loomstream.sources import segments
from loomstream.sources.adapters import TOKEN, address, orders_log
from loomstream.sources.synthetic import SyntheticConfig, synthetic_transfers

SF = "/root/testdata/sf0.001"
TABLES = ["orders", "lineitem", "events", "customer"]


def transfers(spark, rows):
    """rows: (iso time, from, to, amount) with keys in order."""
    data = [
        (f"t{i}-0", i, dt.datetime.fromisoformat(t).replace(tzinfo=dt.UTC), f"t{i}", 0, TOKEN, f"0x{a:040x}", f"0x{b:040x}", int(x * 1e6), float(x), a == b, 8453, "n", "s", dt.datetime(2026, 7, 1, tzinfo=dt.UTC))
        for i, (t, a, b, x) in enumerate(rows)
    ]
    return spark.createDataFrame(data, RAW_TRANSFERS)


@pytest.mark.parametrize("name", ["stg_transfers_dedup", "daily_metrics", "wallet_lifecycle", "concentration", "anomalies", "dq_checks", "lorenz_curve", "funnel_conversion", "segment_integrity"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(got.columns) == sorted(names)
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else (v + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    assert sorted(str([clean(v) for v in r]) for r in got.select(*names).collect()) == sorted(str([clean(v) for v in r]) for r in want)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


WEEKS = [("2026-06-01T10:00:00", 1, 2, 1), ("2026-06-15T10:00:00", 1, 2, 1)]


@pytest.mark.parametrize(("last", "mature"), [("2026-06-21T23:59:59", True), ("2026-06-18T23:59:59", False)])
def test_a_cell_matures_with_its_week(spark, last, mature):
    cells = Warehouse(transfers(spark, [*WEEKS, (last, 8, 9, 1)])).mart_retention_cohorts
    cell = cells.where("week_offset = 2").first()
    assert (cell["retained_wallets"], cell["is_mature"]) == (2, mature)


def test_dedup_keeps_latest_and_disjoint_refuses(spark):
    raw = transfers(spark, [*WEEKS])
    twice = raw.unionByName(raw.limit(1).withColumns({"amount": F.lit(9.0), "ingested_at": F.col("ingested_at") + F.expr("INTERVAL 1 DAY")}))
    staged = staging.stage_dedup(twice)
    assert staged.count() == 2 and staged.agg(F.max("amount")).first()[0] == 9.0
    with pytest.raises(staging.DuplicateEventsError):
        staging.stage_disjoint(twice)
    assert reconcile.row_counts(twice, staged).first()[0] == 1


def test_empty_log(spark):
    house = Warehouse(transfers(spark, []))
    for name in ("mart_daily_metrics", "mart_retention_cohorts", "mart_wallet_segments", "mart_anomalies"):
        assert getattr(house, name).count() == 0
    assert house.mart_concentration.first()["gini_coefficient"] is None


def test_quality_checks_trip(spark):
    raw = transfers(spark, WEEKS)
    assert quality.all_passed(quality.run_checks(staging.stage_dedup(raw), raw, TOKEN))
    other = raw.withColumn("token_address", F.when(F.col("log_index") == 0, "0x" + "1" * 40))
    failed = [c.name for c in quality.run_checks(staging.stage_dedup(other), other, TOKEN) if not c.passed]
    assert failed == ["token_contract_matches_expected"]


def test_reconciliation_finds_tampering(spark):
    raw = transfers(spark, [(f"2026-06-{d:02d}T0{h}:00:00", d % 5 + 1, h + 3, d * h + 1) for d in range(1, 25) for h in range(5)])
    house = Warehouse(raw)
    assert set(reconcile.reconcile_all(raw, house, 50).values()) == {0}
    day = house.mart_daily_metrics
    assert reconcile.activity(raw, day.withColumn("transfer_count", F.col("transfer_count") + 1), "activity_date").first()[0] == day.count()
    assert reconcile.wallet_totals(raw, house.int_wallet_lifecycle.withColumn("total_amount", F.col("total_amount") * 1.01)).first()[0] > 0
    assert reconcile.concentration(raw, house.mart_concentration.withColumn("gini_coefficient", F.col("gini_coefficient") - 0.05)).first()[0] == 1
    flipped = house.mart_retention_cohorts.withColumn("is_mature", ~F.col("is_mature"))
    assert reconcile.retention_cells(raw, flipped).first()[0] == flipped.count()


def test_anomaly_needs_spread(spark):
    rows = [(dt.datetime(2026, 1, 1) + dt.timedelta(days=i), 10 if i < 20 else 1000, 1, 1.0, 1.0) for i in range(21)]
    daily = spark.createDataFrame(rows, "activity_date timestamp_ntz, transfer_count long, active_wallets long, total_volume double, median_amount double")
    assert marts.anomalies(daily).where("is_anomaly").count() == 0


def test_rank_and_ntile(spark):
    df = spark.range(250).select((F.col("id") % 50).alias("v"))
    ranked = with_rank(df, "v", "r").withColumn("b", ntile_of(F.col("r"), F.col("n"), 100))
    assert sorted(r["r"] for r in ranked.collect()) == list(range(1, 251))
    assert ranked.where("b > 90").count() == 20


def test_statistics():
    z = experiments.two_proportion_ztest(1000, 10000, 1120, 10000)
    assert round(z["z"], 3) == 2.756 and round(z["p_value"], 5) == 0.00584 and round(z["ci_low"], 4) == 0.0035
    assert abs(stats.t_quantile(0.975, 10) - 2.2281388519) < 1e-8
    assert abs(stats.t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert experiments.chi_square_srm(4000, 6000)["srm_detected"] and not experiments.chi_square_srm(5010, 4990)["srm_detected"]
    assert not experiments.chi_square_srm(2000, 8000, 0.2)["srm_detected"]
    n = experiments.sample_size_two_proportions(0.1, 0.02)
    assert abs(experiments.power_two_proportions(n, 0.1, 0.02) - 0.8) < 0.001


def test_experiment_scenarios(spark):
    report = experiments.experiment_report(experiments.generate_scenario(spark, "positive_effect", n_units=8000, treatment_conversion_lift_pp=0.06), n_boot=50)
    assert not report["srm"]["srm_detected"] and report["ztest"]["significant"]
    assert experiments.experiment_report(experiments.generate_scenario(spark, "srm", n_units=4000), n_boot=5)["srm"]["srm_detected"]
    cuped = experiments.cuped_theta(experiments.generate_scenario(spark, "cuped", n_units=8000)).first()
    assert 0.5 < cuped["variance_reduction"] < 0.63  # 0.75 squared
    values = experiments.generate_scenario(spark, "positive_effect").select("group", "continuous_metric").toPandas()
    arms = [values[values["group"] == g]["continuous_metric"].to_numpy() for g in ("control", "treatment")]
    interval = experiments.bootstrap_ci(*arms, n_boot=400)
    assert interval["ci_low"] < interval["difference"] < interval["ci_high"] and interval["ci_low"] > 0
    welch = report["welch"]
    assert abs(report["bootstrap"]["ci_low"] - welch["ci_low"]) < 0.2 and abs(report["bootstrap"]["ci_high"] - welch["ci_high"]) < 0.2
    with pytest.raises(KeyError):
        experiments.generate_scenario(spark, "no such scenario")


def test_hexadecimal_fields(spark):
    row = spark.createDataFrame([("0x" + "0" * 24 + "AB" * 20, "0x7fffffffffffffff", "0xffffffffffffffffffffffff", "0x0")], "a string, b string, c string, d string")
    got = row.select(scalar.topic_address(F.col("a")), scalar.hex_long(F.col("b")), scalar.hex_decimal(F.col("c")), scalar.hex_long(F.col("d"))).first()
    assert got[0] == "0x" + "ab" * 20 and got[1] == 2**63 - 1 and int(got[2]) == 2**96 - 1 and got[3] == 0
    assert spark.range(1).select(address(F.lit(7))).first()[0] == f"0x{7:040x}"


def test_segments(spark, tmp_path):
    assert segments.plan_segments(1, 10, 4) == [(1, 4), (5, 8), (9, 10)]
    raw = transfers(spark, [(f"2026-06-01T00:00:{i:02d}", 1, 2, i) for i in range(20)])
    manifest = segments.Manifest(0, 19, 10, TOKEN, 8453)
    for lo, hi in segments.plan_segments(0, 19, 10):
        segments.window_rows(raw, lo, hi).write.parquet(f"{tmp_path}/s{lo}")
        manifest.segments.append(segments.Segment(lo, hi, 10, f"s{lo}"))
    manifest.save(tmp_path / "manifest.json")
    loaded = segments.Manifest.load(segments.find_manifest(tmp_path))
    assert segments.verify_manifest(spark, str(tmp_path), loaded) == []
    report = segments.extract_window(spark, str(tmp_path), loaded, 5, 14, str(tmp_path / "cut"))
    assert (report.row_count, report.distinct_keys) == (10, 10)
    assert json.loads((tmp_path / "cut.window.json").read_text())["row_count"] == 10
    loaded.segments[1].row_count = 11
    assert len(segments.verify_manifest(spark, str(tmp_path), loaded)) == 1
    del loaded.segments[0]
    with pytest.raises(ValueError, match="not covered"):
        segments.plan_window(loaded, 5, 14)
    nothing = segments.Manifest(0, 9, 10, TOKEN, 8453, segments=[segments.Segment(0, 9, 0, None)])
    assert segments.extract_window(spark, str(tmp_path), nothing, 2, 5, str(tmp_path / "none")).row_count == 0


def test_orders_log_is_whole_unless_cut(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert orders_log(spark, SF).count() == lines.count()
    assert registry.queries()["stg_transfers_dedup"](spark, SF).count() == lines.select("l_orderkey", "l_linenumber").distinct().count()
    cut = orders_log(spark, SF, before="2000-06-15")  # a Thursday: the last week of each cohort is immature
    assert cut.count() == lines.where("l_shipdate < timestamp_ntz'2000-06-15'").count() < lines.count()
    assert Warehouse(cut).mart_retention_cohorts.where("NOT is_mature").count() > 0


def test_segment_integrity_counts_every_block(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1), 1, '{"k": 2}', 1.0) for i in (-700, -1, 0, 9_999, 10_000, 25_250)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, props string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["segment_integrity"](spark, str(tmp_path)).where("row_count > 0").orderBy("start_block").collect()
    assert [tuple(r) for r in got] == [(-1000, -501, 1), (-500, -1, 1), (0, 499, 1), (9_500, 9_999, 1), (10_000, 10_499, 1), (25_000, 25_250, 1)]


def test_synthetic_transfers(spark):
    config = SyntheticConfig(n_days=20, n_wallets=200, events_per_day=300)
    log = synthetic_transfers(spark, config).cache()
    assert log.columns == RAW_TRANSFERS.fieldNames()
    n = log.count()
    assert abs(n - 6000) < 400 and log.select("event_id").distinct().count() == n
    assert log.exceptAll(synthetic_transfers(spark, config)).isEmpty()
    selfs = log.where("is_self_transfer").count()
    assert 0.005 * n < selfs < 0.12 * n and log.where("from_address = to_address").count() == selfs and log.where("raw_amount < 1").isEmpty()
    house = Warehouse(log)
    assert house.mart_concentration.first()["gini_coefficient"] > 0.5 and house.mart_retention_cohorts.select("cohort_week").distinct().count() >= 3
    assert quality.all_passed(quality.run_checks(house.stg_transfers, log, TOKEN))


def test_findings(spark, tmp_path):
    log = synthetic_transfers(spark, SyntheticConfig(n_days=12, n_wallets=60, events_per_day=40))
    found = findings.findings(Warehouse(log, share=True))
    assert all(found[name] for name in found if name != "anomalies")
    findings.save(found, f"{tmp_path}/f.json")
    assert json.loads((tmp_path / "f.json").read_text()) == found
    one = found["dataset"][0]
    report = {"start_block": one["min_block"], "end_block": one["max_block"], "row_count": one["raw_events"], "first_event_at": one["first_event_at"], "last_event_at": one["last_event_at"]}
    assert findings.window_matches(report, found) == [] and len(findings.window_matches(report | {"row_count": 1, "end_block": 1}, found)) == 2
    assert findings.plain({"a": float("nan"), 1: [1 / 3]}) == {"a": None, "1": [0.3333333333]}


@pytest.mark.parametrize("small", [5, 100_000])
def test_exact_quantiles(spark, small):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(0, 1, 4001), "b": rng.integers(0, 9, 3000).astype(float), "c": np.array([3.0]), "d": np.full(2000, 7.0), "e": rng.pareto(1.1, 2500)}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("a", None), ("f", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["k"]: r for r in exact_quantiles(frame, ["k"], "v", probs, small=small).collect()}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        assert got[k]["n"] == len(values) and all(abs(got[k][name] - np.quantile(values, p)) < 1e-9 for name, p in probs.items())
    one = exact_quantiles(frame, [], "v", {"m": 0.5}, small=small).collect()
    assert len(one) == 1 and abs(one[0]["m"] - np.median(np.concatenate(list(groups.values())))) < 1e-9
    assert exact_quantiles(frame.limit(0), ["k"], "v", probs).count() == 0 and exact_quantiles(frame.limit(0), [], "v", {"m": 0.5}).first()["m"] is None


def test_rank_within(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    rows = with_rank(df, "v", "r", within="g").collect()
    for g in range(3):
        own = sorted(((r["r"], r["v"]) for r in rows if r["g"] == g))
        assert [r for r, _ in own] == list(range(1, 101)) and [v for _, v in own] == sorted(v for _, v in own) and {r["n"] for r in rows} == {100}


def test_library_anomalies_and_gini(spark):
    values = [float(x) for x in (10, 11, 9, 10, 12, 8, 10, 11, 9, 10, 10, 11, 12, 9, 10, 60, 10, 11)]
    series = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    scored = {r["i"]: r for r in analytics.detect_anomalies(series, "i", "x").collect()}
    assert [i for i, r in scored.items() if r["is_anomaly"]] == [15]
    assert scored[6]["rolling_median"] is None and scored[7]["rolling_median"] == 10.0 and scored[13]["rolling_mad"] is None and scored[14]["rolling_mad"] is not None
    deviations = [abs(values[j] - float(np.median(values[j - 7 : j]))) for j in range(8, 15)]
    z = 0.6745 * (60 - float(np.median(values[8:15]))) / float(np.median(deviations))
    assert abs(scored[15]["robust_z_score"] - z) < 1e-9
    flat = spark.createDataFrame([(i, 5.0 if i < 19 else 500.0) for i in range(20)], "i int, x double")
    assert analytics.detect_anomalies(flat, "i", "x").where("is_anomaly OR robust_z_score IS NOT NULL").isEmpty()
    gini = lambda v: analytics.gini_coefficient(spark.createDataFrame([(float(x),) for x in v], "x double"), "x")
    assert gini([1, 1, 1, 1]) == 0 and abs(gini([0, 1, 3]) - 0.25) < 1e-12 and gini([0, -1]) == 0


def test_welch_and_power():
    a, b = np.arange(10.0), np.arange(12.0) * 1.5 + 1
    w = experiments.welch_ttest(a.mean(), a.var(ddof=1), 10, b.mean(), b.var(ddof=1), 12)
    se = math.sqrt(a.var(ddof=1) / 10 + b.var(ddof=1) / 12)
    assert abs(w["t"] - (b.mean() - a.mean()) / se) < 1e-12 and 17 < w["df"] < 20 and w["ci_low"] < w["difference"] < w["ci_high"]
    assert abs(stats.t_two_sided(w["t"], w["df"]) - w["p_value"]) < 1e-12
    n = experiments.sample_size_two_means(10, 2)
    assert n == 393
    assert abs(experiments.minimum_detectable_effect_two_proportions(experiments.sample_size_two_proportions(0.1, 0.02), 0.1) - 0.02) < 0.002


def test_equal_sets_of_amounts_tie_at_the_cutoff(spark):
    # Ten senders move the same amounts on other days, so plain sums differ in the last bit by the order of days.
    amounts = [0.1, 0.2, 0.3, 0.7, 3.3, 100000.01]
    rows = [(f"2026-06-{1 + (i * s + s) % 7:02d}T10:00:00", 10 + s, 100 + 10 * s + i, x) for s in range(1, 11) for i, x in enumerate(amounts)]
    house = Warehouse(transfers(spark, rows))
    senders = F.col("wallet_address").isin([f"0x{10 + s:040x}" for s in range(1, 11)])
    assert {r["total_amount"] for r in house.int_wallet_lifecycle.where(senders).collect()} == {math.fsum(amounts)}
    assert house.mart_wallet_segments.where(senders & (F.col("volume_segment") == "high_volume")).count() == 10


@pytest.mark.parametrize("values", [[1e12, 0.1, -1e12], [0.1] * 10, [None, None], [None, 2.5], [math.inf, 1.0], [math.inf, -math.inf], [math.nan, 1.0], [-3.7, 3.7], [1e300, 1e300]])
def test_steady_sum(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).agg(scalar.steady_sum(F.col("v"))).first()[0]
    there = [v for v in values if v is not None]
    want = None if not there else math.fsum(there) if all(map(math.isfinite, there)) else sum(there)
    assert got is want or (math.isnan(got) and math.isnan(want)) or got == want


def test_quantiles_of_a_sketch_that_varies(spark, monkeypatch):
    # A sketch depends on the order in which its parts meet; taken twice, it may bracket differently.
    sketch = F.percentile_approx

    def loose(b):
        draw, half = random.SystemRandom(), len(b) // 2
        return [x - draw.uniform(0, 300) for x in b[:half]] + [x + draw.uniform(0, 300) for x in b[half:]]

    monkeypatch.setattr(F, "percentile_approx", lambda v, at, accuracy: F.udf(loose, "array<double>")(sketch(v, at, accuracy)))
    frame = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 4001).cast("double").alias("v"))
    for k, got in {r["k"]: r for r in exact_quantiles(frame, ["k"], "v", {"a": 0.5, "b": 0.9}, small=100).collect()}.items():
        values = [i * 7919 % 4001 for i in range(k, 4000, 2)]
        assert got["a"] == pytest.approx(np.quantile(values, 0.5)) and got["b"] == pytest.approx(np.quantile(values, 0.9))

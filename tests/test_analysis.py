from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pvspark.operators import profile as P
from pvspark.operators import quality as Q
from pvspark.operators import splits as SP
from pvspark.operators.config import AnalysisThresholds, SplitProportions


def _hourly(spark, rows):
    return spark.createDataFrame(rows, "site_id string, timestamp timestamp, ac_energy_kwh double, ghi_w_m2 double")


def test_describe_percentiles_linear(spark):
    df = _hourly(spark, [("a", datetime(2025, 1, 1, h), float(h), 0.0) for h in range(4)])
    r = P.target_summary(df).filter("level = 'overall'").first()
    assert r["percentile_05"] == pytest.approx(0.15) and r["percentile_25"] == pytest.approx(0.75)
    assert r["percentile_95"] == pytest.approx(2.85) and r["median"] == pytest.approx(1.5)
    assert r["zero_generation_percentage"] == 25.0


def test_single_value_std_is_zero(spark):
    r = P.target_summary(_hourly(spark, [("a", datetime(2025, 1, 1), 5.0, 0.0)])).filter("level='site'").first()
    assert r["standard_deviation"] == 0.0 and r["count"] == 1


def test_coverage_can_go_negative_for_off_grid_rows(spark):
    rows = [("a", datetime(2025, 1, 1, 0), 1.0, 0.0), ("a", datetime(2025, 1, 1, 0, 30), 1.0, 0.0),
            ("a", datetime(2025, 1, 1, 1), 1.0, 0.0)]
    r = P.site_coverage(_hourly(spark, rows)).first()
    assert (r["expected_hourly_records"], r["actual_hourly_records"], r["missing_timestamp_count"]) == (2, 3, -1)
    assert Q.missing_hours(_hourly(spark, rows)).count() == 0


def test_correlation_reasons_in_order(spark):
    rows = [("a", datetime(2025, 1, 1, h), float(h), 7.0) for h in range(5)]
    c = {r["weather_variable"]: r for r in P.correlations(_hourly(spark, rows)).collect()}
    assert c["ghi_w_m2"]["reason"] == "weather column is constant" and c["ghi_w_m2"]["correlation_with_ac_energy_kwh"] is None
    rows = [("a", datetime(2025, 1, 1, h), 1.0, float(h)) for h in range(5)]
    c = {r["weather_variable"]: r for r in P.correlations(_hourly(spark, rows)).collect()}
    assert c["ghi_w_m2"]["reason"] == "target column is constant"
    rows = [("a", datetime(2025, 1, 1, h), float(h), float(2 * h + 1)) for h in range(5)]
    c = {r["weather_variable"]: r for r in P.correlations(_hourly(spark, rows)).collect()}
    assert c["ghi_w_m2"]["correlation_with_ac_energy_kwh"] == pytest.approx(1.0)


def test_quality_indicators_fire(spark):
    th = AnalysisThresholds(consecutive_zero_hours=3, minimum_history_days=60)
    rows = []
    t0 = datetime(2025, 1, 1)
    energy = [0, 0, 0, 0, 5, 1, 1, 1, 1, 90, 1, 1, 1, 1, 1, 1]
    for h, e in enumerate(energy):
        if h == 12:
            continue  # a missing hour
        rows.append(("a", t0 + timedelta(hours=h), float(e), 600.0 if h < 4 else 10.0))
    rows.append(("b", t0 + timedelta(hours=1), 1.0, 10.0))
    df = _hourly(spark, rows)
    counts = {r["indicator"]: r["flag_count"] for r in Q.flag_counts(Q.quality_flags(df, th)).collect()}
    assert counts["near_zero_generation_at_high_irradiance"] == 4
    assert counts["long_consecutive_near_zero_generation"] == 4
    assert counts["missing_hourly_timestamp"] == 1
    assert counts["positive_generation_at_very_low_irradiance"] >= 1
    assert counts["extreme_value_iqr"] >= 1
    assert counts["sites_have_different_date_ranges"] == 1
    assert counts["insufficient_historical_coverage"] == 2


def test_gap_scan_crosses_block_boundaries(spark):
    t0 = datetime(2025, 1, 1)
    rows = [("a", t0 + timedelta(hours=h), 1.0, 0.0) for h in (0, 1, 5, 30, 31, 100)]
    g = Q.gaps(_hourly(spark, rows), block_hours=3).orderBy("next_timestamp").collect()
    assert [(r["gap_hours"], r["missing_hours"]) for r in g] == [(4.0, 3), (25.0, 24), (69.0, 68)]
    assert Q.missing_hours(_hourly(spark, rows), block_hours=3).count() == 3 + 24 + 68


def test_chronological_split_boundaries(spark):
    t0 = datetime(2025, 1, 1)
    rows = [(s, t0 + timedelta(hours=h), 1.0, 0.0) for h in range(100) for s in ("a", "b")]
    df = _hourly(spark, rows)
    plan = SP.plan_chronological_splits(df, SplitProportions())
    assert plan.training_end == t0 + timedelta(hours=69) and plan.validation_end == t0 + timedelta(hours=84)
    s = {r["split"]: r for r in SP.split_summary(SP.label_chronological(df, plan)).collect()}
    assert (s["training"]["record_count"], s["validation"]["record_count"], s["testing"]["record_count"]) == (140, 30, 30)
    assert s["training"]["ending_timestamp"] < s["validation"]["beginning_timestamp"]


def test_rolling_origin_folds(spark):
    t0 = datetime(2025, 1, 1)
    df = _hourly(spark, [(s, t0 + timedelta(hours=h), 1.0, 0.0) for h in range(20) for s in ("a", "b")])
    spec = SP.FoldSpec(n_splits=2, gap_hours=2, minimum_training_hours=4, validation_window_hours=3)
    folds = SP.rolling_origin_folds(df, spec).orderBy("fold_number").collect()
    assert folds[-1]["validation_end"] == t0 + timedelta(hours=19)
    assert folds[0]["validation_start"] == t0 + timedelta(hours=14)
    assert folds[0]["training_end"] == t0 + timedelta(hours=11)
    m = SP.fold_membership(df, SP.rolling_origin_folds(df, spec))
    assert m.filter("fold_number = 1 AND role = 'validation'").count() == 6
    with pytest.raises(ValueError, match="insufficient"):
        SP.rolling_origin_folds(df, SP.FoldSpec(5, 24, 240, 72))


def test_exact_percentiles_match_spark_percentile(spark):
    import numpy as np
    from pvspark.functions.quantiles import exact_percentiles
    rng = np.random.default_rng(1)
    rows = [(f"g{i % 3}", float(v)) for i, v in enumerate(rng.normal(size=3000))] + [("g0", 0.0)] * 500 + [("g3", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    got = {r["g"]: [r[f"p{i}"] for i in range(5)] for r in exact_percentiles(df, ["g"], "v", probs, accuracy=50).collect()}
    # accuracy=50: groups above 200 rows take the band path, g3 (1 row) the exact path
    ref = {r["g"]: list(r["q"]) for r in df.groupBy("g").agg(F.percentile("v", probs).alias("q")).collect()}
    assert set(got) == set(ref)
    for k in ref:
        assert got[k] == pytest.approx(ref[k], abs=1e-12)
    one = exact_percentiles(df, [], "v", [0.5, 0.75], accuracy=100).first()
    assert [one["p0"], one["p1"]] == pytest.approx(list(df.agg(F.percentile("v", [0.5, 0.75])).first()[0]), abs=1e-12)
    small = spark.createDataFrame([("a", float(v)) for v in range(694)], "g string, v double")
    for acc in (50, 10_000):
        r = exact_percentiles(small, ["g"], "v", probs, accuracy=acc).first()
        assert [r[f"p{i}"] for i in range(5)] == pytest.approx(
            list(small.agg(F.percentile("v", probs)).first()[0]), abs=1e-12)

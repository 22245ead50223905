from datetime import datetime

from pyspark.sql import functions as F

from pvspark.operators.config import FeatureConfig
from pvspark.operators.eligibility import add_eligibility, eligibility_table
from pvspark.operators.history import add_history

CFG = FeatureConfig(target_lag_hours=(24, 48, 168), rolling_window_hours=(3,), include_weather_lags=False)


def _row(df, site, hour):
    return df.filter((F.col("site_id") == site) & (F.col("timestamp") == datetime(2025, 1, 1) + __import__("datetime").timedelta(hours=hour))).first()


def test_hand_computed_values_at_hour_48(ramp):
    out, _, _, _ = add_history(ramp(), CFG)
    r = _row(out, "site-0", 48)
    assert r["ac_energy_lag_24h"] == 24.0
    assert r["ac_energy_lag_48h"] == 0.0
    assert r["ac_energy_lag_168h"] is None
    assert r["ac_energy_rolling_3h_count"] == 3
    assert r["ac_energy_rolling_3h_mean"] == 23.0
    assert abs(r["ac_energy_rolling_3h_std"] - 1.0) < 1e-12
    assert (r["ac_energy_rolling_3h_min"], r["ac_energy_rolling_3h_max"], r["ac_energy_rolling_3h_median"]) == (22.0, 24.0, 23.0)


def test_irregular_time_is_not_row_shifted(ramp):
    out, _, _, _ = add_history(ramp(drop=(22, 23)), CFG)
    r = _row(out, "site-0", 48)
    assert r["ac_energy_rolling_3h_count"] == 1
    assert r["ac_energy_lag_24h"] == 24.0


def test_empty_window_count_zero_and_std_null_for_one(ramp):
    out, _, _, _ = add_history(ramp(drop=(22, 23)), CFG)
    r0 = _row(out, "site-0", 0)
    assert r0["ac_energy_rolling_3h_count"] == 0 and r0["ac_energy_rolling_3h_mean"] is None
    r48 = _row(out, "site-0", 48)
    assert r48["ac_energy_rolling_3h_std"] is None


def test_sites_are_isolated(ramp):
    out, _, _, _ = add_history(ramp(sites=2), CFG)
    r = _row(out, "site-1", 48)
    assert r["ac_energy_lag_24h"] == 1024.0
    assert r["ac_energy_rolling_3h_max"] == 1024.0


def test_small_time_blocks_give_identical_results(ramp):
    a, _, _, _ = add_history(ramp(sites=2), CFG)
    b, _, _, _ = add_history(ramp(sites=2), CFG, block_hours=5)
    cols = [c for c in a.columns]
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert b.count() == a.count() == 400


def test_future_mutation_does_not_change_past_features(ramp):
    base = ramp()
    mutated = base.withColumn("ac_energy_kwh", F.when(F.col("timestamp") >= datetime(2025, 1, 5), F.lit(-99.0))
                              .otherwise(F.col("ac_energy_kwh")))
    a, _, _, _ = add_history(base, CFG)
    b, _, _, _ = add_history(mutated, CFG)
    cut = datetime(2025, 1, 6)  # features at t use data at or before t - 24h
    feats = [c for c in a.columns if c.startswith("ac_energy_") and c != "ac_energy_kwh"]
    x = a.filter(F.col("timestamp") < cut).select("site_id", "timestamp", *feats)
    y = b.filter(F.col("timestamp") < cut).select("site_id", "timestamp", *feats)
    assert x.exceptAll(y).count() == 0


def test_eligibility_reasons_order_and_counts(ramp):
    out, _, _, failures = add_history(ramp(), CFG)
    e = add_eligibility(out, failures)
    r = _row(e, "site-0", 30)
    assert r["feature_missing_reasons"] == "missing_exact_target_lag_48h;missing_exact_target_lag_168h"
    assert r["feature_missing_count"] == 2 and r["feature_eligible"] is False
    assert e.filter("feature_eligible").count() == 200 - 168
    t = {(x["reason"]): x["row_count"] for x in eligibility_table(e).collect()}
    assert t["eligible"] == 32


def test_weather_lags_exact_time(ramp):
    df = ramp().withColumn("ghi_w_m2", F.col("ac_energy_kwh") * 2)
    out, _, names, _ = add_history(df, FeatureConfig(include_target_history=False, weather_lag_hours=(24,)))
    assert "ghi_lag_24h" in names
    assert _row(out, "site-0", 30)["ghi_lag_24h"] == 12.0


def test_history_frames_keep_their_partitions(spark, ramp):
    # 40 small sites fit in one task by their bytes; their frames are still dealt out over all partitions.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        wide, *_ = add_history(ramp(sites=40, hours=60), FeatureConfig())
        assert wide.select(F.spark_partition_id().alias("p")).distinct().count() > 16 and wide.count() == 40 * 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

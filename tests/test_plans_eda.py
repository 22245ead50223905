import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pvspark.operators.config import FeatureConfig
from pvspark.plans.eda import run_analysis, run_feature_job


def _hourly(spark, hours=120, sites=2):
    t0 = datetime(2025, 1, 1)
    rows = []
    for s in range(sites):
        for h in range(hours):
            if h in (30, 31):
                continue
            ghi = float(max(0, 600 - abs(12 - (h % 24)) * 60))
            rows.append((f"site-{s}", t0 + timedelta(hours=h), round(ghi / 100.0, 2), ghi, 20.0, 30.0, 60.0, 2.0,
                         None if h % 10 == 0 else ghi * 0.5))
    return spark.createDataFrame(rows, "site_id string, timestamp timestamp, ac_energy_kwh double, ghi_w_m2 double, "
                                       "ambient_temperature_c double, cloud_cover_pct double, relative_humidity_pct double, "
                                       "wind_speed_m_s double, dni_w_m2 double")


def test_analysis_bundle_and_sinks(spark, tmp_path):
    df = _hourly(spark)
    b = run_analysis(df, output_dir=str(tmp_path / "eda"))
    assert b.tables["profile"].first()["total_record_count"] == 2 * 118
    assert b.tables["gaps"].count() == 2
    split = {r["split"]: r["record_count"] for r in b.tables["split_summary"].collect()}
    assert sum(split.values()) == 236 and split["training"] > split["validation"] > 0
    assert os.path.isdir(tmp_path / "eda" / "quality_flags") and os.path.isdir(tmp_path / "eda" / "splits")
    counts = {r["indicator"]: r["flag_count"] for r in b.tables["quality_flag_counts"].collect()}
    assert counts["missing_hourly_timestamp"] == 4 and counts["missing_optional_weather_value"] == 22  # h % 10 == 0, hour 30 dropped


def test_feature_job_outputs(spark, tmp_path):
    df = _hourly(spark)
    sites = spark.createDataFrame([(f"site-{i}", 10.0, 20.0, "UTC", 5.0 + i, 10.0, 180.0) for i in range(2)],
                                  "site_id string, latitude double, longitude double, timezone string, "
                                  "installed_capacity_kwp double, panel_tilt_degrees double, panel_azimuth_degrees double")
    cfg = FeatureConfig(target_lag_hours=(24,), rolling_window_hours=(3,), weather_lag_hours=(24,))
    out = run_feature_job(df, sites, cfg, only_eligible=True, output_dir=str(tmp_path / "f"))
    m = out["manifest"].first()
    assert m["source_row_count"] == 236 and m["output_row_count"] == m["eligible_rows"] > 0
    f = out["features"]
    assert f.filter(~F.col("feature_eligible")).count() == 0
    assert {"ghi_lag_24h", "ac_energy_rolling_3h_median", "historical_generation_per_capacity", "local_hour"} <= set(f.columns)
    assert spark.read.parquet(str(tmp_path / "f" / "features")).count() == m["output_row_count"]

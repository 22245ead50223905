import json
import math
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pvspark.operators import chartdata as C
from pvspark.operators import metrics as M
from pvspark.operators import ranking as RK
from pvspark.operators import splits as SP
from pvspark.operators.rules import DataValidationError
from pvspark.sources import io


def test_csv_ingest_reports_csv_lines_and_writes_nothing_on_failure(spark, tmp_path):
    src = tmp_path / "in.csv"
    lines = ["timestamp,site_id,ac_energy_kwh,ghi_w_m2,ambient_temperature_c,cloud_cover_pct,relative_humidity_pct,wind_speed_m_s"]
    for h in range(5):
        lines.append(f"2025-01-01T0{h}:00:00Z,a,{h}.0,10,20,50,40,2")
    lines.append("2025-01-01T09:00:00,a,1,10,20,50,40,2")  # naive -> CSV line 7
    src.write_text("\n".join(lines) + "\n")
    with pytest.raises(DataValidationError, match=r"CSV rows=7"):
        io.ingest_hourly_csv(spark, str(src), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")


def test_csv_ingest_success_and_empty_input(spark, tmp_path):
    src = tmp_path / "ok.csv"
    src.write_text("timestamp,site_id,ac_energy_kwh,ghi_w_m2,ambient_temperature_c,cloud_cover_pct,relative_humidity_pct,"
                   "wind_speed_m_s\n2025-01-01T03:00:00+03:00,a,1,10,20,50,40,2\n")
    out = io.ingest_hourly_csv(spark, str(src), str(tmp_path / "out")).first()
    assert str(out["timestamp"]) == "2025-01-01 00:00:00" and out["ac_energy_kwh"] == 1.0
    empty = tmp_path / "empty.csv"
    empty.write_text("timestamp,site_id\n")
    with pytest.raises(io.CSVIngestionError):
        io.read_hourly_csv(spark, str(empty))


def test_json_report_nan_inf_to_null(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.5, datetime(2025, 1, 1))], "a double, b double, c double, t timestamp")
    io.write_json_report(df, str(tmp_path / "r"))
    rows = [json.loads(x) for f in os.listdir(tmp_path / "r") if f.endswith(".json") for x in open(tmp_path / "r" / f)]
    assert rows == [{"c": 1.5, "t": "2025-01-01T00:00:00.000000Z"}]


def test_split_plan_requires_zone(spark, tmp_path):
    p = tmp_path / "plan.json"
    p.write_text(json.dumps({"periods": {
        "training": {"beginning_timestamp": "2025-01-01T00:00:00", "ending_timestamp": "2025-01-02T00:00:00Z"},
        "validation": {"beginning_timestamp": "2025-01-03T00:00:00Z", "ending_timestamp": "2025-01-04T00:00:00Z"},
        "testing": {"beginning_timestamp": "2025-01-05T00:00:00Z", "ending_timestamp": "2025-01-06T00:00:00Z"}}}))
    with pytest.raises(DataValidationError, match="timezone-aware"):
        io.load_split_plan(spark, str(p))


def test_split_checks(spark):
    t0 = datetime(2025, 1, 1)
    df = spark.createDataFrame([(("train" if h < 10 else "validation" if h < 15 else "test"), t0 + timedelta(hours=h))
                                for h in range(20)], "split string, timestamp timestamp")
    assert SP.split_order_checks(df, {"train": 5}).count() == 0
    assert [r[0] for r in SP.split_order_checks(df, {"test": 6}).collect()] == ["test split has fewer than 6 rows"]
    bad = SP.check_split_plan(df, [("train", t0, t0 + timedelta(hours=5)), ("validation", t0 + timedelta(hours=4), t0 + timedelta(hours=9)),
                                   ("test", t0 + timedelta(hours=10), t0 + timedelta(hours=30))]).collect()
    assert {r["message"] for r in bad} == {"Split periods overlap or are not chronological."}


def test_top_k_and_keep_last(spark):
    imp = spark.createDataFrame([(f"f{i}", float(i)) for i in range(30)], "feature string, gain double")
    top = RK.top_importances(imp, "gain", 20).collect()
    assert len(top) == 20 and top[0]["feature"] == "f29"
    t0 = datetime(2025, 1, 1)
    df = spark.createDataFrame([("a", t0 + timedelta(hours=h)) for h in range(10)] + [("b", t0 + timedelta(hours=9))],
                               "site_id string, timestamp timestamp")
    assert RK.keep_last_timestamps(df, 2).count() == 3


def test_cumulative_matches_running_sum(spark):
    t0 = datetime(2025, 1, 1)
    rows = [(t0 + timedelta(hours=h), s, float(h + i), float(h)) for h in range(6) for i, s in enumerate(("b", "a"))]
    rep = spark.createDataFrame(rows, "timestamp timestamp, site_id string, actual_ac_energy_kwh double, prediction double") \
        .withColumn("model_identifier", F.lit("m"))
    got = M.cumulative_energy(rep).orderBy("timestamp", "site_id").collect()
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    acc = 0.0
    for g, r in zip(got, ordered):
        acc += r[2]
        assert g["cumulative_actual_kwh"] == pytest.approx(acc)


def test_robustness_cohorts_present(spark):
    t0 = datetime(2025, 1, 1)
    rows = [(f"s{h % 2}", t0 + timedelta(hours=h), float(h % 5), float(h % 4), float(h * 10 % 700), float(h % 100), h % 2)
            for h in range(100)]
    df = spark.createDataFrame(rows, "site_id string, timestamp timestamp, ac_energy_kwh double, prediction double, "
                                     "ghi_w_m2 double, cloud_cover_pct double, is_daylight int")
    r = M.robustness(df)
    kinds = {x["cohort_type"] for x in r.collect()}
    assert kinds == {"site", "utc_hour", "utc_month", "daylight", "irradiance", "cloud_cover", "target_magnitude"}
    z = r.filter("cohort_type = 'target_magnitude' AND cohort_value = 'zero'").first()
    assert z["prediction_count"] == 20 and z["small_cohort"] is True


def test_daily_pivot_fills_zero(spark):
    df = spark.createDataFrame([("a", datetime(2025, 1, 1, 1), 2.0), ("b", datetime(2025, 1, 2, 1), 3.0)],
                               "site_id string, timestamp timestamp, ac_energy_kwh double")
    rows = {(str(r["day"])[:10], r["site_id"]): r["energy"] for r in C.daily_energy_pivot(df).collect()}
    assert rows == {("2025-01-01", "a"): 2.0, ("2025-01-01", "b"): 0.0, ("2025-01-02", "a"): 0.0, ("2025-01-02", "b"): 3.0}

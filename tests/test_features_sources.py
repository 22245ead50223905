from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pvspark.operators import align as A
from pvspark.operators import chartdata as C
from pvspark.operators.features import add_calendar, add_weather_features
from pvspark.sources import weather as WX
from pvspark.sources.fixtures import PAYLOAD_FIELDS


def test_calendar_local_time_and_dst(spark):
    df = spark.createDataFrame([(datetime(2025, 11, 2, 5, 0), "America/New_York"),
                                (datetime(2025, 11, 2, 6, 0), "America/New_York"),
                                (datetime(2025, 1, 4, 23, 30), "Asia/Kolkata")], "timestamp timestamp, timezone string")
    r = add_calendar(df).orderBy("timestamp").collect()
    assert [x["local_hour"] for x in r] == [5, 1, 1]  # Kolkata first (Jan); DST repeated hour gives 1, 1
    kol = r[0]
    assert kol["local_day_of_week"] == 6 and kol["is_weekend"] == 1 and kol["local_day_of_month"] == 5
    assert kol["hour_sin"] == pytest.approx(__import__("math").sin(2 * __import__("math").pi * 5 / 24))


def test_safe_ratio_and_optional_features(spark):
    df = spark.createDataFrame([(0.0, 5.0, 3.0, 1.0), (10.0, 5.0, 3.0, 0.0)],
                               "ghi_w_m2 double, dhi_w_m2 double, precipitation_mm double, installed_capacity_kwp double")
    df = df.select("*", F.lit(20.0).alias("ambient_temperature_c"), F.lit(10.0).alias("cloud_cover_pct"),
                   F.lit(40.0).alias("relative_humidity_pct"))
    out, names = add_weather_features(df)
    r = out.orderBy("ghi_w_m2").collect()
    assert r[0]["diffuse_fraction"] is None and r[1]["diffuse_fraction"] == 0.5
    assert r[0]["is_daylight"] == 0 and r[1]["is_daylight"] == 1
    assert "precipitation_indicator" in names and "availability_fraction" not in names


def _gw(spark, gen_hours, wx_hours, sites=("s",)):
    g = spark.createDataFrame([(s, datetime(2025, 1, 1, h), float(h)) for s in sites for h in gen_hours],
                              "site_id string, timestamp timestamp, ac_energy_kwh double")
    w = spark.createDataFrame([(s, datetime(2025, 1, 1, h), 20.0) for s in sites for h in wx_hours],
                              "site_id string, timestamp timestamp, ambient_temperature_c double")
    return g, w


def test_strict_join_failure_kinds(spark):
    g, w = _gw(spark, (0, 1, 2), (0, 2))
    with pytest.raises(A.DatasetJoinError, match="Missing weather hours"):
        A.join_generation_weather(g, w)
    g, w = _gw(spark, (0, 1), (0, 1))
    assert A.join_generation_weather(g, w).count() == 2
    g2 = spark.createDataFrame([("other", datetime(2025, 1, 1, 0), 1.0)], "site_id string, timestamp timestamp, ac_energy_kwh double")
    p = {r["problem"]: r for r in A.join_problems(g.unionByName(g2), w).collect()}
    assert "missing_weather_hours" not in p  # sites without weather are J2's job
    assert p["unmatched_generation"]["first_keys"] == "other@2025-01-01T00:00:00+00:00"


def _payload(spark, times, temps):
    arrays = {p: [1.0] * len(times) for p, _ in PAYLOAD_FIELDS}
    arrays["temperature_2m"] = temps
    row = ("s", {"hourly": {"time": times, **arrays}})
    schema = "site_id string, payload struct<hourly: struct<time: array<string>, " + ", ".join(
        f"{p}: array<double>" for p, _ in PAYLOAD_FIELDS) + ">>"
    return spark.createDataFrame([row], schema)


def test_payload_decode_and_length_check(spark):
    ok = _payload(spark, ["2025-01-01T00:00", "2025-01-01T01:00"], [25.0, 26.0])
    rows = WX.decode_payloads(ok).orderBy("timestamp").collect()
    assert [r["ambient_temperature_c"] for r in rows] == [25.0, 26.0]
    bad = _payload(spark, ["2025-01-01T00:00", "2025-01-01T01:00"], [25.0])
    assert WX.payload_errors(bad).first()["error"] == "hourly arrays have mismatched lengths"
    assert WX.decode_payloads(bad).count() == 0


def test_fetch_plan_chunks_and_bounds(spark):
    req = spark.createDataFrame([("s", "2025-01-01", "2025-02-02"), ("s", "2025-01-02", "2025-01-01"),
                                 ("s", "2024-01-01", "2025-01-01")], "site_id string, start_date string, end_date string")
    req = req.select("site_id", F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"))
    plan = WX.fetch_plan(req)
    chunks = plan.filter("error IS NULL").orderBy("chunk_start").collect()
    assert len(chunks) == 2 and str(chunks[0]["chunk_end"]) == "2025-01-31" and str(chunks[1]["chunk_start"]) == "2025-02-01"
    errs = sorted(r["error"] for r in plan.filter("error IS NOT NULL").collect())
    assert errs[0].startswith("Date range is limited to 366") and errs[1].startswith("end-date must")


def test_histogram_numpy_rules(spark):
    import numpy as np
    vals = [0.0, 0.1, 0.5, 0.99, 1.0, 2.5, 3.0, 3.0, 7.25, 10.0, 10.0, 4.4]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = C.histogram(df, "x", 2).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins=min(30, max(5, len(vals) // 2)))
    assert [r["count"] for r in h] == counts.tolist()
    assert [r["lower_edge"] for r in h] == pytest.approx(edges[:-1].tolist())

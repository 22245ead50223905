"""Nested records, split-plan counts, site files, order of rows, node tables, artifact digests."""

import glob
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pvspark.operators import features as FE
from pvspark.operators import models as ML
from pvspark.operators import prepare as PR
from pvspark.operators import registry as REG
from pvspark.operators import rules as R
from pvspark.operators import splits as SP
from pvspark.operators.config import FeatureConfig
from pvspark.plans import q_records as QR
from pvspark.plans import training as TR
from pvspark.sources import io
from pvspark.sources import sites as SI

T0 = datetime(2025, 1, 1)
SITE = {"site_id": " a ", "latitude": 1, "longitude": "2.5", "timezone": "UTC", "installed_capacity_kwp": 5.0,
        "panel_tilt_degrees": 0, "panel_azimuth_degrees": 180.0}


# ------------------------------------------------------------------ V16
@pytest.mark.parametrize("block", [3, 1 << 20])
def test_order_is_checked_inside_blocks_and_across_their_borders(spark, block):
    hours = {"a": [0, 2, 1, 3, 4, 4], "b": [5, 0, 1]}  # a: back at row 2; b: at row 1; equal times are in order
    rows = [(s, T0 + timedelta(hours=h), 2 * i) for s, hs in hours.items() for i, h in enumerate(hs)]
    rows += [("a", None, 100), (None, T0, 101), ("a", T0, None)]
    table = spark.createDataFrame(rows, "site_id string, timestamp timestamp, source_row long").repartition(3)
    got = {(r["site_id"], r["source_row"]) for r in PR.order_violations(table, block_rows=block).collect()}
    assert got == {("a", 4), ("b", 2)}


def test_border_of_a_block_with_empty_blocks_between(spark):
    table = spark.createDataFrame([("a", T0 + timedelta(hours=5), 0), ("a", T0, 1000), ("a", T0 + timedelta(hours=1), 1001)],
                                  "site_id string, timestamp timestamp, source_row long")
    assert [r["source_row"] for r in PR.order_violations(table, block_rows=10).collect()] == [1000]


def test_row_issues_name_the_order(spark):
    rows = [("a", T0 + timedelta(hours=h), 1.0, "train", True, i) for i, h in enumerate([1, 0])]
    table = spark.createDataFrame(rows, "site_id string, timestamp timestamp, ac_energy_kwh double, split string, "
                                        "feature_eligible boolean, source_row long")
    assert ("not_sorted_within_site", 1) in [tuple(r) for r in PR.row_issues(table, [], position="source_row").collect()]


# ------------------------------------------------------------------ S8 / V19
def plan(tmp_path, periods, **more):
    path = str(tmp_path / "plan.json")
    with open(path, "w") as f:
        json.dump({"periods": periods} | more, f)
    return path


def period(start, end, **more):
    return {"beginning_timestamp": f"2025-01-01T{start:02d}:00:00Z", "ending_timestamp": f"2025-01-01T{end:02d}:00:00+00:00"} | more


@pytest.fixture
def labelled(spark):
    rows = [(s, T0 + timedelta(hours=h), "train" if h < 4 else "validation" if h < 6 else "test") for s in "ab" for h in range(8)]
    return spark.createDataFrame(rows, "site_id string, timestamp timestamp, split string")


def issues(spark, labelled, path):
    return {tuple(r)[1:] for r in SP.plan_count_issues(labelled, io.read_split_plan(spark, path)).collect()}


def test_counts_that_hold_give_no_issue(spark, labelled, tmp_path):
    path = plan(tmp_path, {"training": period(0, 3, record_count=8, counts_by_site={"a": 4, "b": 4}),
                           "validation": period(4, 5, record_count=4), "testing": period(6, 7)})
    assert issues(spark, labelled, path) == set()
    assert [(n, rc) for n, _, _, rc in io.load_split_plan(spark, path)] == [("train", 8), ("validation", 4), ("test", None)]


def test_wrong_missing_and_extra_sites(spark, labelled, tmp_path):
    path = plan(tmp_path, {"training": period(0, 3, counts_by_site={"a": 5, "b": 4}),
                           "validation": period(4, 5, counts_by_site={"a": 2}),
                           "testing": period(6, 7, record_count=5, counts_by_site={"a": 2, "b": 2, "c": 0})})
    text = "{} {} does not match the input dataset."
    assert issues(spark, labelled, path) == {
        (text.format("training", "counts_by_site"), "a", 5, 4), (text.format("validation", "counts_by_site"), "b", None, 2),
        (text.format("testing", "counts_by_site"), "c", 0, None), (text.format("testing", "record_count"), None, 5, 4)}


def test_counts_of_other_types_match_nothing(spark, labelled, tmp_path):
    path = plan(tmp_path, {"training": period(0, 3, record_count="8", counts_by_site=[4, 4]),
                           "validation": period(4, 5, counts_by_site={}), "testing": period(6, 7, record_count=None, counts_by_site=None)})
    got = issues(spark, labelled, path)
    assert {(m.split()[0], m.split()[1], s) for m, s, _, _ in got} == {
        ("training", "record_count", None), ("training", "counts_by_site", None),  # one row, not one a site
        ("validation", "counts_by_site", "a"), ("validation", "counts_by_site", "b")}


@pytest.mark.parametrize("periods, word", [({}, "periods object"), ({"training": period(0, 3), "testing": period(6, 7)}, "validation"),
                                           ({"training": period(0, 3) | {"ending_timestamp": "2025-01-01T03:00:00"},
                                             "validation": period(4, 5), "testing": period(6, 7)}, "timezone-aware")])
def test_plans_that_are_none(spark, tmp_path, periods, word):
    with pytest.raises(R.DataValidationError, match=word):
        io.load_split_plan(spark, plan(tmp_path, periods))


# ------------------------------------------------------------------ S7
def sites(tmp_path, **texts):
    for name, text in texts.items():
        with open(tmp_path / f"{name}.json", "wb") as f:
            f.write(text if isinstance(text, bytes) else (text if isinstance(text, str) else json.dumps(text)).encode())
    return str(tmp_path)


def test_site_files_with_every_fault(spark, tmp_path):
    path = sites(tmp_path, good=SITE, cut=json.dumps(SITE)[:-5], listed=[SITE], empty="", blank=" ", latin=b'{"site_id": "\xe9"}',
                 extra=SITE | {"colour": {"a": 1}}, number=SITE | {"site_id": 7}, north=SITE | {"latitude": "north"},
                 less={k: v for k, v in SITE.items() if k not in ("timezone", "longitude")}, nan=json.dumps(SITE).replace("5.0", "NaN"))
    parsed = SI.parse_site_files(spark, path)
    got = {}
    for r in SI.site_file_issues(parsed).collect():
        got.setdefault(os.path.basename(r["file"])[:-5], set()).add((r["field"], r["problem"]))
    unreadable, number = {("file", SI.UNREADABLE)}, "must be a finite number"
    assert got == {"cut": unreadable, "latin": unreadable, "blank": unreadable, "nan": unreadable, "listed": {("file", SI.NOT_OBJECT)},
                   "extra": {("colour", SI.EXTRA_FIELD)}, "number": {("site_id", "must be a non-empty string")},
                   "north": {("latitude", number)}, "less": {("timezone", SI.REQUIRED_FIELD), ("longitude", SI.REQUIRED_FIELD)}}
    assert [tuple(r) for r in SI.valid_sites(parsed).collect()] == [("a", 1.0, 2.5, "UTC", 5.0, 0.0, 180.0)]
    with pytest.raises(SI.SiteConfigurationError, match="cut.json: file could not read"):
        SI.read_sites(spark, path)


def test_planted_site_files_are_written_by_many_tasks(spark, tmp_path):
    """One file a site, by about SITES_A_TASK files a task: adaptive execution does not merge them by their few bytes."""
    n = 2 * QR.SITES_A_TASK + 1
    spark.range(1, n + 1).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    files = glob.glob(os.path.join(QR._site_files(spark, str(tmp_path)).removeprefix("file:"), "site=*", "part-*"))
    assert len({os.path.dirname(f) for f in files}) == len(files) == n
    assert len({os.path.basename(f).split("-")[1] for f in files}) == 3


def test_reading_sites(spark, tmp_path):
    assert SI.read_sites(spark, sites(tmp_path, a=SITE, b=SITE | {"site_id": "b"})).count() == 2
    with pytest.raises(SI.SiteConfigurationError, match="does not exist"):
        SI.read_sites(spark, str(tmp_path / "none"))


# ------------------------------------------------------------------ A15 / A18 / V15
@pytest.fixture(scope="module")
def features(spark):
    rows = [(s, T0 + timedelta(hours=h), float(h % 24 + i), 100.0 + h, 20.0, 10.0, 50.0, 2.0)
            for i, s in enumerate(("s-0", "s-1")) for h in range(400)]
    hourly = spark.createDataFrame(rows, "site_id string, timestamp timestamp, ac_energy_kwh double, ghi_w_m2 double, "
                                   "ambient_temperature_c double, cloud_cover_pct double, relative_humidity_pct double, wind_speed_m_s double")
    site = spark.createDataFrame([(s, 1.0, 2.0, "UTC", 5.0, 10.0, 180.0) for s in ("s-0", "s-1")], SI.SITE_SCHEMA)
    periods = [("train", T0, T0 + timedelta(hours=299)), ("validation", T0 + timedelta(hours=300), T0 + timedelta(hours=349)),
               ("test", T0 + timedelta(hours=350), T0 + timedelta(hours=399))]
    res = FE.build_features(hourly, site, periods=periods)
    return res, PR.eligible(res.features).count()


def test_manifest_round_trip_is_enforced(spark, features, tmp_path):
    res, eligible = features
    path = str(tmp_path / "manifest")
    io.write_manifest(FE.manifest_record(res), path)
    manifest = io.load_manifest(spark, path)
    assert manifest["output_row_count"] == manifest["source_row_count"] == 800 and manifest["excluded_row_count"] == 0
    assert manifest["site_ids"] == ["s-0", "s-1"] and manifest["split_counts"] == {"train": 600, "validation": 100, "test": 100}
    assert manifest["eligibility_counts"] == {"True": eligible, "False": 800 - eligible}
    assert manifest["missing_value_counts"]["ac_energy_lag_24h"] == 48 and manifest["missing_value_counts"]["ghi_w_m2"] == 0
    assert manifest["units"]["ghi_w_m2"] and manifest["units"]["is_weekend"] is None
    assert manifest["earliest_timestamp"].startswith("2025-01-01T00:00:00")
    assert json.loads(manifest["feature_configuration"])["forecast_horizon_hours"] == 24
    predictors = list(res.contract.predictor_columns)
    PR.check_training_table(res.features, predictors, manifest)
    for change in ({"output_row_count": 799}, {"predictor_columns": predictors[1:]}, {"forecast_horizon_hours": 12}):
        with pytest.raises(ValueError, match="manifest"):
            TR.run_baseline(res.features, predictors, manifest=manifest | change)
        with pytest.raises(ValueError, match="manifest"):
            TR.run_advanced(res.features, predictors, SP.FoldSpec(2, 24, 48, 24), manifest=manifest | change)


def test_manifest_of_eligible_rows_only(spark, features):
    res, eligible = features
    row = FE.manifest_record(res, FeatureConfig(), only_eligible=True).first()
    assert (row["output_row_count"], row["excluded_row_count"]) == (eligible, 800 - eligible)
    assert not any(row["missing_value_counts"][c] for c in res.contract.predictor_columns if "_lag_" in c)


def test_quality_record(features):
    res, eligible = features
    row = FE.quality_record(res).first()
    assert row["row_count"] == 800 and row["counts_by_site"] == {"s-0": 400, "s-1": 400}
    assert row["exact_time_lag_availability"]["ac_energy_lag_168h"] == 2 * (400 - 168)
    assert row["eligibility_reasons"]["missing_exact_target_lag_168h"] == 2 * 168
    assert {"latitude", "ambient_temperature_c"} <= set(row["constant_features"]) and "ghi_w_m2" not in row["constant_features"]
    assert "dni_w_m2" in row["source_optional_columns_absent"] and row["suspicious_predictor_ranges"] == []
    assert set(row["feature_groups"]["rolling_history"]) == {c for c in res.contract.predictor_columns if "_rolling_" in c}


def test_records_of_an_empty_table(spark, features):
    res, _ = features
    empty = FE.FeatureResult(res.features.limit(0), res.audit.limit(0), res.contract)
    row = FE.manifest_record(empty).first()
    assert (row["source_row_count"], row["site_ids"], row["split_counts"]) == (0, [], {})
    assert FE.quality_record(empty).first()["row_count"] == 0


def test_descriptions_follow_the_groups(features):
    text = FE.describe(features[0].contract)
    assert text["ac_energy_lag_24h"] == text["ghi_lag_24h"] == FE.DESCRIPTIONS["exact_lag"]
    assert text["ac_energy_rolling_3h_mean"] == FE.DESCRIPTIONS["rolling"]
    assert text["hour_sin"] == text["local_hour"] == FE.DESCRIPTIONS["calendar"]
    assert text["is_weekend"] == text["ghi_w_m2"] == text["historical_generation_per_capacity"] == FE.DESCRIPTIONS["own_row"]


@pytest.mark.parametrize("text", ["", "{", "[1]"])
def test_a_manifest_that_is_none(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    with pytest.raises(ValueError, match="manifest"):
        io.load_manifest(spark, str(tmp_path / "m.json"))


# ------------------------------------------------------------------ M14 / M15 / V20
def test_gain_and_weight_are_those_of_the_trees(spark, tmp_path):
    rows = [("a", T0 + timedelta(hours=i), float(i % 7), float(i % 5), 0.0, float(3 * (i % 7) + (i % 5))) for i in range(200)]
    df = spark.createDataFrame(rows, "site_id string, timestamp timestamp, x double, y double, z double, ac_energy_kwh double")
    model = ML.fit_model(df, ["x", "y", "z"], "random_forest")
    path = str(tmp_path / "forest")
    model.write().save(path)
    got = {r["feature"]: r for r in ML.tree_importance(spark, path, ["x", "y", "z"]).collect()}
    text = model.stages[-1].toDebugString
    for i, c in enumerate("xyz"):
        assert got[c]["weight"] == text.count(f"If (feature {i} ")
    assert got["z"]["gain"] == got["z"]["weight"] == 0 and got["x"]["gain"] > got["y"]["gain"] > 0


def test_artifact_digest_changes_with_any_byte(spark, tmp_path):
    for name, text in (("metadata/part-0", b"m"), ("stages/0/data", b"d" * 100)):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(text)
    row = REG.artifact_checksum(spark, str(tmp_path)).first()
    assert (row["files"], row["bytes"]) == (2, 101)
    REG.verify_artifact(spark, str(tmp_path), row["sha256"])
    (tmp_path / "stages/0/data").write_bytes(b"d" * 99 + b"e")
    with pytest.raises(ValueError, match="verification failed"):
        REG.verify_artifact(spark, str(tmp_path), row["sha256"])


def test_predictions_have_to_be_finite(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, float("nan"), 3.0), (1.0, float("-inf"), 4.0)], "a double, b double, c double")
    assert {tuple(r) for r in R.finite_predictions(df, ["a", "b", "c"]).collect()} == {("b", 2), ("c", 1)}
    assert R.finite_predictions(df, []).count() == 0


def test_rows_without_a_key_are_no_duplicates(spark):
    columns = list(R.REQUIRED)
    rows = [{c: "1" for c in columns} | {"site_id": s, "timestamp": t} for s, t in
            [("a", "2025-01-01T00:00:00Z"), ("a", "2025-01-01T03:00:00+03:00"), ("a", "x"), ("a", "x"), (None, None), (None, None)]]
    table = spark.createDataFrame([tuple(r[c] for c in columns) + (i,) for i, r in enumerate(rows)],
                                  ", ".join(f"{c} string" for c in columns) + ", source_row long")
    found = {r["code"]: r["rows"] for r in R.issues(table, R.hourly_rules(table.columns)).collect() if "duplicate" in r["code"]}
    assert list(found.values()) == ["2, 3"]

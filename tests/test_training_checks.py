import pytest

from pvspark.operators import models as ML
from pvspark.operators import prepare as PR
from pvspark.operators.metrics import fold_metrics

COLUMNS = ("site_id string, timestamp timestamp, ac_energy_kwh double, split string, feature_eligible boolean, "
           "feature_missing_count int, feature_missing_reasons string, x double")


@pytest.fixture
def table(spark):
    from datetime import datetime
    rows = [("a", datetime(2025, 1, 1, h), float(h), s, True, 0, "", float(h))
            for h, s in enumerate(["train"] * 4 + ["validation"] * 2 + ["test"] * 2)]
    return spark.createDataFrame(rows, COLUMNS)


def manifest(**changes):
    return {"target_column": "ac_energy_kwh", "key_columns": ["timestamp", "site_id"], "predictor_columns": ["x"],
            "forecast_horizon_hours": 24, "metadata_columns": list(PR.METADATA), "numerical_columns": ["x"],
            "categorical_columns": [], "boolean_columns": [], "output_row_count": 8, "source_row_count": 9} | changes


def test_a_sound_table_passes(table):
    PR.check_training_table(table, ["x"], manifest(), {"train": 4, "test": 2})


@pytest.mark.parametrize("change, word", [
    ({"target_column": "y"}, "target"), ({"key_columns": ["site_id", "timestamp"]}, "keys"),
    ({"predictor_columns": ["x", "z"]}, "predictors"), ({"forecast_horizon_hours": 12}, "horizon"),
    ({"metadata_columns": ["split"]}, "metadata"), ({"categorical_columns": ["x"]}, "two type groups"),
    ({"numerical_columns": []}, "type groups differ"), ({"expected_data_types": {"x": "double"}}, "expected_data_types"),
    ({"output_row_count": 7}, "7 rows"), ({"source_row_count": 3}, "source rows")])
def test_a_manifest_that_disagrees_is_rejected(table, change, word):
    with pytest.raises(ValueError, match=word):
        PR.check_training_table(table, ["x"], manifest(**change))


def test_undeclared_columns_and_forbidden_predictors_are_rejected(table):
    extra = table.withColumn("other", table.x)
    assert any("undeclared" in i for i in PR.contract_issues(extra, ["x"], manifest=manifest()))
    assert any("forbidden" in i for i in PR.contract_issues(table, ["x", "row_id"]))


def test_too_few_eligible_rows_are_rejected(table):
    with pytest.raises(ValueError, match="too_few_eligible_rows:test: 1 rows"):
        PR.check_training_table(table, ["x"], minimum_rows={"test": 3})


def test_tune_records_failures_and_metrics(spark, table):
    from datetime import datetime
    folds = spark.createDataFrame([(1, datetime(2025, 1, 1, 4), datetime(2025, 1, 1, 6), datetime(2025, 1, 1, 7))],
                                  "fold_number int, training_end timestamp, validation_start timestamp, validation_end timestamp")
    space = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.1, "min_child_weight": 1.0, "subsample": 1.0,
             "colsample_bytree": 1.0, "gamma": 0.0}
    got = {r["candidate_id"]: r for r in ML.tune(table, folds, ["x"], [
        {"candidate_id": "good", "parameters": space},
        {"candidate_id": "bad", "parameters": space | {"max_depth": 99}}]).collect()}
    assert got["good"]["status"] == "succeeded" and got["good"]["prediction_count"] == 2
    assert got["good"]["training_duration_seconds"] > 0 and got["good"]["mae_kwh"] is not None
    assert got["bad"]["status"] == "failed" and got["bad"]["failure_message"] and got["bad"]["mae_kwh"] is None


def test_folds_are_prepared_once_for_all_candidates(spark, monkeypatch):
    from datetime import datetime, timedelta
    began = datetime(2025, 1, 1)
    rows = [(f"s{i % 2}", began + timedelta(hours=i // 2), float(i % 7), None if i % 5 == 0 else float(i % 11), i % 3 // 2)
            for i in range(120)]
    train = spark.createDataFrame(rows, "site_id string, timestamp timestamp, ac_energy_kwh double, x double, is_daylight int")
    folds = spark.createDataFrame([(k, began + timedelta(hours=20 + 10 * k), began + timedelta(hours=21 + 10 * k),
                                    began + timedelta(hours=25 + 10 * k)) for k in range(3)],
                                  "fold_number int, training_end timestamp, validation_start timestamp, validation_end timestamp")
    calls, fit = [], ML.fit_preprocessing
    monkeypatch.setattr(ML, "fit_preprocessing", lambda rows, *a, **k: calls.append(rows) or fit(rows, *a, **k))
    space = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.1, "min_child_weight": 1.0, "subsample": 1.0,
             "colsample_bytree": 1.0, "gamma": 0.0}
    candidates = [{"candidate_id": f"c{n}", "parameters": space | {"n_estimators": n}} for n in (1, 2, 3, 4)]
    got = {(r["candidate_id"], r["fold_number"]): r for r in ML.tune(train, folds, ["x"], candidates).collect()}
    assert len(calls) == 3 and len(got) == 12 and {r["status"] for r in got.values()} == {"succeeded"}
    # as one pipeline fitted on the same fold
    fold = folds.where("fold_number = 1").first()
    training, validation = ML.fold_rows(train, fold)
    model = ML.fit_model(training, ["x"], "tuned_xgboost", params=candidates[2]["parameters"])
    scored = ML.predict(model, validation, ["site_id", "timestamp", "ac_energy_kwh"]).collect()
    mae = sum(abs(max(r["prediction"], 0) - r["ac_energy_kwh"]) for r in scored) / len(scored)
    record = got["c3", 1]
    assert record["mae_kwh"] == pytest.approx(mae)
    assert set(record["by_site"]) == {"s0", "s1"} and record["daylight"]["prediction_count"] < record["prediction_count"]
    assert sum(m["prediction_count"] for m in record["by_site"].values()) == record["prediction_count"] == 10
    assert record["daylight"]["prediction_coverage_pct"] == 100 * record["daylight"]["prediction_count"] / 10


def test_a_fold_that_cannot_be_prepared_fails_for_every_candidate(spark, table):
    from datetime import datetime
    folds = spark.createDataFrame([(1, datetime(1990, 1, 1), datetime(2025, 1, 1), datetime(2025, 1, 2))],
                                  "fold_number int, training_end timestamp, validation_start timestamp, validation_end timestamp")
    space = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.1, "min_child_weight": 1.0, "subsample": 1.0,
             "colsample_bytree": 1.0, "gamma": 0.0}
    got = ML.tune(table, folds, ["x"], [{"candidate_id": c, "parameters": space} for c in "ab"]).collect()
    assert [(r["status"], bool(r["failure_message"])) for r in got] == [("failed", True)] * 2


def test_fold_metrics_count_and_clip_negative_predictions(spark):
    scored = spark.createDataFrame([("c", 1, 2.0, -3.0), ("c", 1, 1.0, 1.0)],
                                   "candidate_id string, fold_number int, ac_energy_kwh double, prediction double")
    clipped, raw = (fold_metrics(scored, clip=c).first() for c in (True, False))
    assert (clipped["negative_raw_prediction_count"], clipped["mae_kwh"], raw["mae_kwh"]) == (1, 1.0, 2.5)

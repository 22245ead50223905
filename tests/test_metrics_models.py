import hashlib
import json
import math
import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvspark.operators import metrics as M
from pvspark.operators import models as ML
from pvspark.operators import ranking as RK
from pvspark.operators import registry as REG


def test_hand_computed_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 1.0)], "site_id string, ac_energy_kwh double, prediction double")
    r = M.forecast_metrics(df, ["site_id"]).first()
    assert r["mae_kwh"] == 1.5 and r["rmse_kwh"] == pytest.approx(math.sqrt(2.5))
    assert r["mean_bias_error_kwh"] == -0.5 and r["wape"] == 0.75
    assert r["r2"] == pytest.approx(1 - 5 / 2)


def test_r2_constant_target_convention(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)],
                               "site_id string, ac_energy_kwh double, prediction double")
    r = {x["site_id"]: x["r2"] for x in M.forecast_metrics(df, ["site_id"]).collect()}
    assert r == {"a": 1.0, "b": 0.0}


def test_common_cohort_reasons(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (None, 1.0, 2.0), (1.0, float("nan"), 2.0)],
                               "persistence double, m1 double, m2 double")
    cohort, summary, reasons = M.common_cohort(df, "persistence", ["m1", "m2"])
    assert cohort.count() == 1
    assert {r["reason"]: r["row_count"] for r in reasons.collect()} == {"persistence_unavailable": 1, "m1_prediction_unavailable": 1}


def test_rank_models_tie_breaks(spark):
    df = spark.createDataFrame([("ridge", 1.0, 2.0), ("persistence", 1.0, 2.0), ("random_forest", 0.5, 9.0)],
                               "model_identifier string, mae_kwh double, rmse_kwh double")
    got = [r["model_identifier"] for r in RK.rank_models(df).orderBy("rank").collect()]
    assert got == ["random_forest", "persistence", "ridge"]


def test_candidate_grid_deterministic_unique_and_hashed(spark):
    a = ML.candidate_grid(spark, budget=24, seed=42).collect()
    b = ML.candidate_grid(spark, budget=24, seed=42).collect()
    assert [r["candidate_id"] for r in a] == [r["candidate_id"] for r in b]
    assert len({r["candidate_id"] for r in a}) == 24
    p = a[0]["parameters"].asDict()
    enc = json.dumps(p, sort_keys=True, separators=(",", ":"))
    assert a[0]["candidate_id"] == "xgb-" + hashlib.sha256(enc.encode()).hexdigest()[:10]
    assert ML.grid_size() == 1_800_000


def _train(spark, n=60):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        x1, x2 = float(rng.normal()), (None if i % 7 == 0 else float(rng.normal()))
        y = 3 + 2 * x1 + (0 if x2 is None else -1.5 * x2) + float(rng.normal(scale=0.1))
        rows.append(("s", datetime(2025, 1, 1) + timedelta(hours=i), x1, x2, y))
    return spark.createDataFrame(rows, "site_id string, timestamp timestamp, x1 double, x2 double, ac_energy_kwh double")


def test_ridge_matches_closed_form(spark):
    df = _train(spark)
    pdf = df.toPandas()
    med = float(np.median(pdf["x2"].dropna()))
    X = np.column_stack([pdf["x1"], pdf["x2"].fillna(med), pdf["x2"].isna().astype(float)])
    Xs = (X - X.mean(0)) / np.where(X.std(0) == 0, 1, X.std(0))
    y = pdf["ac_energy_kwh"].to_numpy()
    A = np.column_stack([np.ones(len(y)), Xs])
    reg = np.eye(A.shape[1]); reg[0, 0] = 0
    w = np.linalg.solve(A.T @ A + 1.0 * reg, A.T @ y)
    expected = A @ w
    model = ML.fit_model(df, ["x1", "x2"], "ridge")
    got = ML.predict(model, df, ["timestamp"]).orderBy("timestamp").toPandas()["prediction"].to_numpy()
    assert np.max(np.abs(got - expected)) < 1e-8


def test_imputation_is_exact_median_and_train_only(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    t = ML.imputation_table(df, ["x"]).first()
    assert t["median"] == 2.0 and t["train_missing_count"] == 1


def test_imputation_unpivots_plain_doubles(spark, monkeypatch):
    from pvspark.functions import quantiles
    seen, plain = [], quantiles.exact_percentiles
    monkeypatch.setattr(quantiles, "exact_percentiles", lambda df, *a, **kw: seen.append(df) or plain(df, *a, **kw))
    nan = float("nan")
    rows = [(1, 1.0, None, nan), (2, None, None, 5.0), (4, 3.0, None, None), (4, 3.0, None, 7.0), (None, 2.0, None, nan)]
    df = spark.createDataFrame(rows, "a int, `b` double, c double, d double")
    got = {r["feature"]: (r["median"], r["train_missing_count"]) for r in ML.imputation_table(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": (3.0, 1), "b": (2.5, 1), "c": (None, 5), "d": (6.0, 1)}
    assert {t for _, t in seen[0].dtypes} == {"int", "double"}  # no name of a column beside each value
    assert ML.imputation_table(df.limit(0), ["a", "b"]).count() == 0


def test_save_reload_same_predictions(spark, tmp_path):
    df = _train(spark)
    model = ML.fit_model(df, ["x1", "x2"], "random_forest", ML.TrainingConfig(random_forest_estimators=5))
    assert ML.save_and_verify(model, str(tmp_path / "m"), df) == 0.0


def test_permutation_importance_ranks_informative_feature(spark):
    df = _train(spark, 80)
    model = ML.fit_model(df, ["x1", "x2"], "ridge")
    imp = {r["predictor"]: r["importance_mean"] for r in ML.permutation_importance(model, df, ["x1", "x2"], repeats=2).collect()}
    assert imp["x1"] > imp["x2"] > 0


def test_permuted_copies_are_scored_by_all_tasks(spark):
    """Copies are made behind the join, whose few bytes do not merge its tasks; each group scores every row once."""
    df = _train(spark, 80)
    model, seen = ML.fit_model(df, ["x1", "x2"], "ridge"), []

    class Watched:
        def transform(self, rows):
            seen.append(rows)
            return model.transform(rows)

    ML.permutation_importance(Watched(), df, ["x1", "x2"], repeats=2).collect()
    copies = seen[-1]
    assert copies.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = {r["_g"]: r for r in copies.groupBy("_g").agg(F.count("*").alias("n"), F.countDistinct("_i").alias("rows"),
                                                           F.sort_array(F.collect_list("x1")).alias("x1")).collect()}
    x1 = sorted(r["x1"] for r in df.select(F.col("x1").cast("double")).collect())
    assert set(groups) == {0, 1, 2, 3} and all(g["n"] == g["rows"] == 80 and g["x1"] == x1 for g in groups.values())


def test_linear_copies_exchange_one_share(spark, monkeypatch):
    """A linear model scores each row once, not once a copy, with the importances that scoring whole copies gives."""
    df = _train(spark, 80).withColumns({"odd name": F.col("x1") * F.col("x1"), "none": F.lit(None).cast("double")})
    df = df.unionByName(df.limit(3))  # keys that repeat
    names = ["x1", "x2", "odd name", "none"]
    model, asked = ML.fit_model(df, names, "ridge"), []
    assert [len(t) for t in ML.linear_terms(model, names)] == [1, 2, 1, 1]  # value, value and indicator, value, indicator
    plain = type(model).transform
    monkeypatch.setattr(type(model), "transform", lambda self, rows: asked.append(rows) or plain(self, rows))

    def table(m):
        return {r["predictor"]: (r["importance_mean"], r["importance_std"])
                for r in ML.permutation_importance(m, df, names, repeats=3, max_copies=6).collect()}

    got = table(model)
    assert [rows.count() for rows in asked] == [83]

    class Opaque:
        def transform(self, rows):
            return plain(model, rows)

    want = table(Opaque())
    assert set(got) == set(want) == set(names)
    assert all(got[p] == pytest.approx(want[p], abs=1e-9) for p in names)
    assert ML.linear_terms(ML.fit_model(df, names, "dummy_mean"), names) is None
    other = ML.SQLTransformer(statement="SELECT *, x1 * x2 AS `__f0` FROM __THIS__")
    assert ML.linear_terms(ML.PipelineModel([other, *model.stages[1:]]), names) is None


def test_independent_models_are_fitted_at_once(spark, monkeypatch):
    """Each fit waits until the other has begun; both get the statistics, only the tuned one its parameters."""
    both = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(ML, "fit_model", lambda train, predictors, m, cfg, params, *, statistics: (both.wait() >= 0, m, params, statistics))
    got = ML.fit_models(None, [], ["ridge", "tuned_xgboost"], params={"n": 1}, statistics={"s": 2})
    assert list(got.items()) == [("ridge", (True, "ridge", None, {"s": 2})), ("tuned_xgboost", (True, "tuned_xgboost", {"n": 1}, {"s": 2}))]


def test_global_rank_dense(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    r = ML.global_rank(df, ["k"], "r", partitions=7)
    assert sorted(x[0] for x in r.select("r").collect()) == list(range(1000))


def test_registry_promotion_archives_previous_champion(spark):
    ev = spark.createDataFrame([
        ("v1", "o", "register", 1, True, True), ("v1", "o", "promote", 2, True, True),
        ("v2", "o", "register", 3, True, True), ("v2", "o", "promote", 4, True, True),
        ("v3", "o", "register", 5, True, True), ("v3", "o", "promote", 6, True, False)],
        "model_version string, objective string, action string, seq long, artifact_verified boolean, "
        "selection_based_on_validation boolean")
    st = {r["model_version"]: r for r in REG.registry_state(ev).collect()}
    assert st["v1"]["status"] == "archived" and st["v2"]["status"] == "champion"
    assert st["v2"]["previous_champion_version"] == "v1"
    assert st["v3"]["status"] == "candidate" and st["v3"]["previous_champion_version"] == "v2"
    assert {r["problem"] for r in REG.registry_issues(ev).collect()} == {"promotion must be based on validation selection"}


def fold_registry(events):
    """(state, problems by seq): the rules applied to one event after the other."""
    models, problems = {}, {}
    for version, objective, action, seq, verified, selected in sorted(events, key=lambda e: e[3]):
        champion = {m["objective"]: v for v, m in models.items() if m["status"] == "champion"}
        model, problem = models.get(version), None
        if action == "register":
            problem = REG.REGISTERED if model else None if verified else REG.UNVERIFIED
            if not problem:
                models[version] = {"objective": objective, "status": "candidate", "previous": champion.get(objective)}
        elif action == "promote":
            problem = (REG.NOT_VALIDATION if not selected else REG.UNKNOWN if not model else
                       REG.NOT_CANDIDATE if model["status"] == "archived" else None if verified else REG.UNVERIFIED)
            if not problem:
                if model["objective"] in champion:
                    models[champion[model["objective"]]]["status"] = "archived"
                model["status"] = "champion"
        elif action == "archive":
            problem = None if model else REG.UNKNOWN
            if model:
                model["status"] = "archived"
        else:
            problem = REG.UNKNOWN_ACTION
        if problem:
            problems[seq] = problem
    return {(v, m["objective"], m["status"], m["previous"]) for v, m in models.items()}, problems


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_registry_equals_a_fold_over_its_events(spark, seed):
    import random
    r = random.Random(seed)
    events = [(f"v{r.randrange(9)}", r.choice("ab"), r.choice(["register", "register", "promote", "promote", "promote", "archive", "x"]),
               k, r.random() < 0.8 or None, r.random() < 0.85 or None) for k in range(60)]
    events += [(f"w{k}", "c", a, 100 + 10 * k + i, True, True) for k in range(3) for i, a in enumerate(("register", "promote"))]
    events += [("w1", "c", "register", 200, True, True), ("w0", "c", "promote", 201, True, True), ("w2", "c", "promote", 202, True, True),
               ("w2", "c", "archive", 203, True, True), ("w3", "c", "register", 204, True, True), ("w2", "c", "promote", 205, True, True)]
    table = spark.createDataFrame(events, "model_version string, objective string, action string, seq long, artifact_verified boolean, "
                                          "selection_based_on_validation boolean")
    state, problems = fold_registry(events)
    assert {tuple(x) for x in REG.registry_state(table).collect()} == state
    assert {x["seq"]: x["problem"] for x in REG.registry_issues(table).collect()} == problems
    assert {("w2", "c", "archived", "w1"), ("w3", "c", "candidate", None)} <= state and problems[201] == REG.NOT_CANDIDATE


def test_categorical_most_frequent_and_unknown_all_zero(spark):
    train = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 3.0, 3.0), (None, 4.0, 4.0)],
                                  "c string, x double, ac_energy_kwh double")
    prep = ML.fit_preprocessing(train, ["x"], scale=False, categorical=["c"])
    assert "'a'" in prep.statement  # NULL filled with the most frequent value
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    model = Pipeline(stages=[SQLTransformer(statement=prep.statement), *prep.categorical_stages,
                             VectorAssembler(inputCols=prep.feature_columns, outputCol="features")]).fit(train)
    test = spark.createDataFrame([("zzz", 1.0, 0.0)], "c string, x double, ac_energy_kwh double")
    vec = model.transform(test).first()["features"].toArray().tolist()
    assert vec[1:] == [0.0, 0.0]


def test_registered_tuning_fits_the_default_search(spark, monkeypatch):
    from pvspark.plans import q_models
    want = {r["candidate_id"] for r in ML.candidate_grid(spark).collect()}

    class Reached(Exception):
        pass

    def tune(train, folds, predictors, candidates, *args, **kwargs):
        assert len(want) == 24 and {c["candidate_id"] for c in candidates} == want
        raise Reached

    monkeypatch.setattr(ML, "tune", tune)
    with pytest.raises(Reached):
        q_models.q_advanced(spark, "/root/testdata/sf0.01")


@pytest.mark.parametrize("block", ["hour", "day", "month", "year"])
def test_running_totals_in_blocks_equal_one_running_sum(spark, block):
    from datetime import datetime, timedelta
    import random
    r = random.Random(2)
    rows = [(m, datetime(2024, 11, 28) + timedelta(hours=h, minutes=r.choice([0, 0, 7, 30])), f"s{s}", float(r.randrange(9)), float(r.randrange(9)))
            for m in ("a", "b") for h in range(0, 1700, 13) for s in range(3)]
    rows = list({(m, t, s): (m, t, s, x, y) for m, t, s, x, y in rows}.values()) + [("a", None, "s0", 2.0, 3.0), ("a", None, "s1", 4.0, 1.0)]
    table = spark.createDataFrame(rows, "model_identifier string, timestamp timestamp, site_id string, actual_ac_energy_kwh double, prediction double")
    got = {tuple(x)[:3]: tuple(x)[3:] for x in M.cumulative_energy(table, block=block).collect()}
    assert len(got) == len(rows)
    for m in ("a", "b"):
        a = b = 0.0
        for _, t, s, x, y in sorted((x for x in rows if x[0] == m), key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
            a, b = a + x, b + y
            assert got[m, t, s] == (a, b)

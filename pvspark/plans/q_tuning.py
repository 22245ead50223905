"""Queries: tuning records (M10, A25, W10, C9, S14), preprocessing and ridge (M2, M4) and training
checks (V16, V18) that SQL can compute as well.

The candidates are three forecasts of the feature table, so that their fold metrics need no fitted
model: the exact 24 h lag, the 24 h rolling mean, and that mean less 20 kWh, which goes below zero.
A fourth candidate has failed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.operators import chartdata as C
from pvspark.operators import metrics as M
from pvspark.operators import models as ML
from pvspark.operators import prepare as PR
from pvspark.operators import ranking as RK
from pvspark.operators import splits as SP
from pvspark.plans import q_features as QF
from pvspark.plans import q_metrics as QM
from pvspark.plans.q_io import _scratch
from pvspark.plans.q_models import PREDICTORS, _features
from pvspark.plans.registry import register, rnd_sql, rounded
from pvspark.session import cut_lineage
from pvspark.sources import io

SHIFT = 20.0
# candidate -> (n_estimators, max_depth): two of them cost the same
CANDIDATES = {"lag": (200, 3), "rolling": (200, 4), "shifted": (400, 3), "broken": (100, 2)}


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, fold_number, key, target, is_daylight, prediction): raw predictions on every fold."""
    train = PR.eligible(_features(spark, d), "train")
    rolling = F.col("ac_energy_rolling_24h_mean")
    guesses = {"lag": F.col("ac_energy_lag_24h"), "rolling": rolling, "shifted": rolling - F.lit(SHIFT)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("candidate_id"), v.alias("prediction")) for k, v in guesses.items()]))
    folds = SP.rolling_origin_folds(train, QF.FOLDS).collect()  # one row a fold
    parts = [ML.fold_rows(train, f)[1].select(F.lit(f["fold_number"]).alias("fold_number"), "site_id", "timestamp",
                                              "ac_energy_kwh", "is_daylight", each.alias("c")) for f in folds]
    return cut_lineage(reduce(DataFrame.unionByName, parts).select("*", "c.*").drop("c"))


_SCORED = QF._folds_sql() + f""",
raw AS (SELECT fold_number, site_id, timestamp, ac_energy_kwh, is_daylight, unnest(['lag', 'rolling', 'shifted']) AS candidate_id,
   unnest([ac_energy_lag_24h, ac_energy_rolling_24h_mean, ac_energy_rolling_24h_mean - {SHIFT}]) AS raw
   FROM members JOIN tr USING (site_id, timestamp) WHERE role = 'validation'),
long AS (SELECT *, greatest(raw, 0.0) AS prediction FROM raw)"""


def _fold_sql(group: str) -> str:
    return f"""SELECT * FROM ({QM.metrics_sql(group, capacity=False)}) JOIN (SELECT {group},
   count(*) FILTER (WHERE raw < 0) AS negative_raw_prediction_count FROM long GROUP BY {group}) USING ({group})"""


@register("fold_metrics", rnd_sql(_SCORED + _fold_sql("candidate_id, fold_number"), QM.NOCAP))
def q_fold_metrics(spark, d):
    return rounded(M.fold_metrics(_scored(spark, d)))


@register("fold_metrics_by_site", rnd_sql(_SCORED + _fold_sql("candidate_id, fold_number, site_id"), QM.NOCAP))
def q_fold_metrics_site(spark, d):
    return rounded(M.fold_metrics(_scored(spark, d), ["site_id"]))


@register("fold_metrics_daylight", rnd_sql(
    _SCORED + " SELECT * EXCLUDE (full_count) REPLACE (100.0 * prediction_count / full_count AS prediction_coverage_pct) FROM ("
    + QM.metrics_sql("candidate_id, fold_number", source="(SELECT * FROM long WHERE is_daylight = 1)", capacity=False)
    + ") RIGHT JOIN (SELECT candidate_id, fold_number, count(*) AS full_count FROM long GROUP BY ALL) USING (candidate_id, fold_number)",
    QM.NOCAP))
def q_fold_metrics_daylight(spark, d):
    return rounded(M.fold_metrics(_scored(spark, d), daylight=True))


@register("fold_record", rnd_sql(_SCORED + f"""
SELECT f.candidate_id, f.fold_number, s.site_id, f.mae_kwh, f.median_absolute_error_kwh, f.r2, f.negative_raw_prediction_count,
   d.mae_kwh AS daylight_mae_kwh, 100.0 * d.prediction_count / f.prediction_count AS daylight_coverage_pct, d.wape AS daylight_wape,
   s.rmse_kwh AS site_rmse_kwh, s.median_absolute_error_kwh AS site_median_absolute_error_kwh, s.prediction_count AS site_prediction_count,
   s.negative_raw_prediction_count AS site_negative_raw_prediction_count
FROM ({_fold_sql("candidate_id, fold_number")}) f JOIN ({_fold_sql("candidate_id, fold_number, site_id")}) s USING (candidate_id, fold_number)
LEFT JOIN ({QM.metrics_sql("candidate_id, fold_number", source="(SELECT * FROM long WHERE is_daylight = 1)", capacity=False)}) d
   USING (candidate_id, fold_number)""", ["mae_kwh", "median_absolute_error_kwh", "r2", "daylight_mae_kwh", "daylight_coverage_pct",
                                          "daylight_wape", "site_rmse_kwh", "site_median_absolute_error_kwh"]))
def q_fold_record(spark, d):
    """The nested record of each candidate and fold, its sites unfolded."""
    record = M.fold_record(_scored(spark, d)).select("*", F.explode("by_site").alias("site_id", "s"))
    return rounded(record.select(
        "candidate_id", "fold_number", "site_id", "mae_kwh", "median_absolute_error_kwh", "r2", "negative_raw_prediction_count",
        F.col("daylight.mae_kwh").alias("daylight_mae_kwh"), F.col("daylight.wape").alias("daylight_wape"),
        F.col("daylight.prediction_coverage_pct").alias("daylight_coverage_pct"),
        *[F.col(f"s.{c}").alias(f"site_{c}") for c in ("rmse_kwh", "median_absolute_error_kwh", "prediction_count",
                                                       "negative_raw_prediction_count")]))


_CV = _SCORED + """,
fm AS (SELECT candidate_id, fold_number, avg(abs(prediction - ac_energy_kwh)) AS mae_kwh,
   sqrt(avg((prediction - ac_energy_kwh) * (prediction - ac_energy_kwh))) AS rmse_kwh FROM long GROUP BY ALL),
cv AS (SELECT candidate_id, avg(mae_kwh) AS mean_mae, stddev_pop(mae_kwh) AS std_mae, min(mae_kwh) AS min_mae, max(mae_kwh) AS max_mae,
   avg(rmse_kwh) AS mean_rmse, stddev_pop(rmse_kwh) AS std_rmse, min(rmse_kwh) AS min_rmse, max(rmse_kwh) AS max_rmse,
   count(*) AS fold_count FROM fm GROUP BY candidate_id)"""
_CV_DOUBLES = [f"{a}_{b}" for b in ("mae", "rmse") for a in ("mean", "std", "min", "max")]


@register("candidate_cv_summary", rnd_sql(_CV + " SELECT * FROM cv", _CV_DOUBLES))
def q_cv_summary(spark, d):
    """A25."""
    return rounded(RK.cv_summary(M.fold_metrics(_scored(spark, d))))


@register("candidate_ranking", rnd_sql(_CV + f""",
cand AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {n}, {depth})" for k, (n, depth) in CANDIDATES.items())})
   t(candidate_id, n_estimators, max_depth)),
s AS (SELECT *, CASE WHEN fold_count IS NULL THEN 'failed' ELSE 'succeeded' END AS status FROM cand LEFT JOIN cv USING (candidate_id))
SELECT candidate_id, status, mean_mae, std_mae, CASE WHEN status = 'succeeded' THEN CAST(row_number() OVER (
   ORDER BY (status <> 'succeeded'), mean_mae, std_mae, n_estimators * power(2, max_depth), candidate_id) AS INTEGER) END AS rank FROM s""",
    ["mean_mae", "std_mae"]))
def q_candidate_ranking(spark, d):
    """Candidates that failed come last, without a rank."""
    fm = M.fold_metrics(_scored(spark, d)).select("candidate_id", "fold_number", "mae_kwh", "rmse_kwh",
                                                  F.lit("succeeded").alias("status"))
    failed = spark.createDataFrame([("broken", 1, None, None, "failed")], fm.schema)
    cands = spark.createDataFrame([(k, {"n_estimators": n, "max_depth": m}) for k, (n, m) in CANDIDATES.items()],
                                  "candidate_id string, parameters struct<n_estimators: int, max_depth: int>")
    ranked = RK.rank_candidates(ML.candidate_summary(fm.unionByName(failed), cands))
    return rounded(ranked.select("candidate_id", "status", "mean_mae", "std_mae", "rank"))


@register("fold_mae_chart", rnd_sql(_CV + " SELECT candidate_id, fold_number, mae_kwh AS mae FROM fm", ["mae"]))
def q_fold_mae(spark, d):
    """C9."""
    return rounded(C.fold_mae(M.fold_metrics(_scored(spark, d))))


@register("fold_predictions_roundtrip", rnd_sql(_SCORED + " SELECT candidate_id, fold_number, count(*) AS row_count, "
                                                "sum(raw) AS prediction_sum FROM long GROUP BY ALL", ["prediction_sum"]))
def q_fold_predictions(spark, d):
    """One folder per candidate and fold, read back."""
    base = _scratch(spark, "fold-predictions")
    io.write_fold_predictions(_scored(spark, d), base)
    return rounded(spark.read.parquet(base).groupBy("candidate_id", "fold_number").agg(
        F.count("*").alias("row_count"), F.sum("prediction").alias("prediction_sum")))


_TRAIN = QF._FJ + ", trn AS (SELECT * FROM feat WHERE split = 'train' AND feature_eligible), " \
                  "val AS (SELECT * FROM feat WHERE split = 'validation' AND feature_eligible)\n"


def _standardised_sql(c: str) -> str:
    x = f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM trn))"
    return f"""SELECT '{c}' AS feature, (v - m) / CASE WHEN s < 1e-12 THEN 1.0 ELSE s END AS mean_z
   FROM (SELECT avg({x}) AS m, stddev_pop({x}) AS s FROM trn), (SELECT avg({x}) AS v FROM val)"""


# Predictors that differ in every table; those constant in training keep their own test in A20.
_SCALED = ["ghi_w_m2", "ambient_temperature_c", "cloud_cover_pct", "relative_humidity_pct", "wind_speed_m_s", "ac_energy_lag_24h",
           "ac_energy_lag_168h", "ac_energy_rolling_24h_mean", "ac_energy_rolling_72h_median", "hour_sin"]


@register("standardised_validation_means", rnd_sql(_TRAIN + " UNION ALL ".join(map(_standardised_sql, _SCALED)), ["mean_z"]))
def q_standardised(spark, d):
    """M1, M2: mean of each standardised predictor over the validation rows, by the training statistics."""
    rows = _features(spark, d)
    prep = ML.fit_preprocessing(PR.eligible(rows, "train"), _SCALED, scale=True)
    scaled = ML.SQLTransformer(statement=prep.statement).transform(PR.eligible(rows, "validation"))
    means = scaled.agg(*[F.avg(c).alias(c) for c in prep.feature_columns])
    named = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).alias("mean_z"))
                      for n, c in zip(prep.output_names, prep.feature_columns, strict=True)
                      if not n.startswith("missingindicator_")])
    return rounded(means.select(F.explode(named).alias("s")).select("s.*"))


@register("ridge_single_predictor", rnd_sql(_TRAIN + """, f AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n,
   covar_pop(x, y) AS c FROM (SELECT CAST(ac_energy_lag_24h AS DOUBLE) AS x, ac_energy_kwh AS y FROM trn))
SELECT site_id, count(*) AS row_count, avg(my + n * (c / sx) / (n + 1.0) * (ac_energy_lag_24h - mx) / sx) AS mean_prediction
FROM val, f GROUP BY site_id""", ["mean_prediction"]))
def q_ridge_single(spark, d):
    """M4: ridge with one predictor has a closed form."""
    rows = _features(spark, d)
    model = ML.fit_model(PR.eligible(rows, "train"), ["ac_energy_lag_24h"], "ridge")
    scored = ML.predict(model, PR.eligible(rows, "validation"), ["site_id"])
    return rounded(scored.groupBy("site_id").agg(F.count("*").alias("row_count"), F.avg("prediction").alias("mean_prediction")))


# Defects planted by rules on the rows themselves: every check but the infinite predictors has failing rows.
_PLANT = """bad AS (SELECT CASE WHEN hour(timestamp) = 5 THEN NULL ELSE site_id END AS site_id, timestamp,
   CASE WHEN hour(timestamp) = 7 THEN -1.0 WHEN hour(timestamp) = 8 THEN NULL ELSE ac_energy_kwh END AS ac_energy_kwh,
   CASE WHEN hour(timestamp) = 9 THEN 'holdout' WHEN split = 'test' THEN 'train' ELSE split END AS split, feature_eligible,
   CASE WHEN hour(timestamp) = 11 THEN CAST('infinity' AS DOUBLE) ELSE ghi_w_m2 END AS ghi_w_m2 FROM feat),
twice AS (SELECT * FROM bad UNION ALL SELECT * FROM bad WHERE hour(timestamp) = 3)"""
_MINIMUM = {"train": 10, "test": 12}


@register("training_row_issues_planted", QF._FJ + ", " + _PLANT + """
SELECT * FROM (
   SELECT 'null_key' AS issue, count(*) FILTER (WHERE site_id IS NULL OR timestamp IS NULL) AS rows FROM twice
   UNION ALL SELECT 'invalid_target', count(*) FILTER (WHERE ac_energy_kwh IS NULL OR ac_energy_kwh < 0) FROM twice
   UNION ALL SELECT 'invalid_split_label', count(*) FILTER (WHERE split NOT IN ('train', 'validation', 'test')) FROM twice
   UNION ALL SELECT 'infinite_predictor:ghi_w_m2', count(*) FILTER (WHERE isinf(ghi_w_m2)) FROM twice
   UNION ALL SELECT 'missing_split:test', CAST(count(*) FILTER (WHERE split = 'test') = 0 AS BIGINT) FROM twice
   UNION ALL SELECT 'too_few_eligible_rows:test', greatest(12 - count(*) FILTER (WHERE split = 'test' AND feature_eligible), 0) FROM twice
   UNION ALL SELECT 'duplicate_key', coalesce(CAST(sum(n) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM twice
      GROUP BY site_id, timestamp HAVING count(*) > 1))
WHERE rows > 0""")
def q_row_issues_planted(spark, d):
    hour = F.hour("timestamp")
    bad = _features(spark, d).select(
        F.when(hour != 5, F.col("site_id")).alias("site_id"), "timestamp",
        F.when(hour == 7, -1.0).when(hour != 8, F.col("ac_energy_kwh")).alias("ac_energy_kwh"),
        F.when(hour == 9, "holdout").when(F.col("split") == "test", "train").otherwise(F.col("split")).alias("split"),
        "feature_eligible", F.when(hour == 11, float("inf")).otherwise(F.col("ghi_w_m2")).alias("ghi_w_m2"))
    return PR.row_issues(bad.unionByName(bad.where(hour == 3)), ["ghi_w_m2"], _MINIMUM)


@register("split_boundary_checks_planted", QF._FJ + """, bad AS (SELECT timestamp,
   CASE WHEN hour(timestamp) = 4 AND split = 'train' THEN 'validation' ELSE split END AS split FROM feat),
n AS (SELECT count(*) FILTER (WHERE split = 'test') AS c FROM bad)
SELECT 'split boundaries are not strictly ordered' AS problem FROM bad
   HAVING NOT max(timestamp) FILTER (WHERE split = 'train') < min(timestamp) FILTER (WHERE split = 'validation')
UNION ALL SELECT 'test split has fewer than 1000000000 rows' FROM n WHERE c < 1000000000""")
def q_split_checks_planted(spark, d):
    """V18 where training hours are labelled as validation and the minimum is beyond the table."""
    split = F.when((F.hour("timestamp") == 4) & (F.col("split") == "train"), "validation").otherwise(F.col("split"))
    return SP.split_order_checks(_features(spark, d).withColumn("split", split), {"test": 1_000_000_000})


@register("feature_csv_roundtrip", rnd_sql(QF._FJ + """SELECT split, feature_eligible, count(*) AS row_count, count(ac_energy_lag_24h) AS lags,
   count(ac_energy_rolling_72h_median) AS medians, sum(ac_energy_kwh) AS energy,
   CAST(sum(is_daylight) AS BIGINT) AS daylight_rows, min(timestamp) AS first_timestamp FROM feat GROUP BY ALL""", ["energy"]))
def q_feature_csv(spark, d):
    """The feature table as CSV, read back by its schema."""
    rows, base = _features(spark, d), _scratch(spark, "features")
    io.write_table(rows, base, "csv")
    back = io.load_feature_dataset(spark, base, "csv", rows.schema)
    return rounded(back.groupBy("split", "feature_eligible").agg(
        F.count("*").alias("row_count"), F.count("ac_energy_lag_24h").alias("lags"),
        F.count("ac_energy_rolling_72h_median").alias("medians"), F.sum("ac_energy_kwh").alias("energy"),
        F.sum("is_daylight").cast("long").alias("daylight_rows"), F.min("timestamp").alias("first_timestamp")))

"""Queries: forecast metrics, cohorts, ranking and reports on F-PRED
(A21-A26, J10, J11, W9, W11-W13, F13).

F-PRED: the validation split of the feature table with three SQL-checkable
forecasts — ``persistence`` (exact 24 h lag), ``dummy_mean`` (mean target of
eligible training rows) and ``rolling_mean_24h`` (24 h rolling mean).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pvspark.operators import metrics as M
from pvspark.operators import ranking as RK
from pvspark.plans import q_features as QF
from pvspark.plans.registry import register, rnd_sql, rounded
from pvspark.session import cut_lineage

MODELS = ["persistence", "dummy_mean", "rolling_mean_24h"]
KEEP = ["site_id", "timestamp", "split", "ac_energy_kwh", "is_daylight", "installed_capacity_kwp", "ghi_w_m2",
        "cloud_cover_pct"]


def wide_predictions(spark, d):
    r = QF._spark_features(spark, d)
    feats = r.features
    train_mean = feats.filter((F.col("split") == "train") & F.col("feature_eligible")).agg(
        F.avg("ac_energy_kwh")).scalar()
    wide = feats.filter(F.col("split") == "validation").select(
        *KEEP, F.col("ac_energy_lag_24h").alias("persistence"), train_mean.alias("dummy_mean"),
        F.col("ac_energy_rolling_24h_mean").alias("rolling_mean_24h"))
    # Reused by counts, cohorts and several metric passes: materialise once.
    return cut_lineage(wide)


def _cohort_long(spark, d):
    wide = wide_predictions(spark, d)
    cohort, summary, reasons = M.common_cohort(wide, "persistence", ["dummy_mean", "rolling_mean_24h"])
    return wide, M.to_long(cohort, KEEP, MODELS)


PRED_SQL = QF._FJ.rstrip() + """,
pred AS (SELECT site_id, timestamp, split, ac_energy_kwh, is_daylight, installed_capacity_kwp, ghi_w_m2, cloud_cover_pct,
   ac_energy_lag_24h AS persistence,
   (SELECT avg(ac_energy_kwh) FROM feat WHERE split = 'train' AND feature_eligible) AS dummy_mean,
   ac_energy_rolling_24h_mean AS rolling_mean_24h FROM feat WHERE split = 'validation'),
cohort AS (SELECT * FROM pred WHERE coalesce(isfinite(persistence), false) AND coalesce(isfinite(dummy_mean), false)
   AND coalesce(isfinite(rolling_mean_24h), false)),
long AS (SELECT site_id, timestamp, split, ac_energy_kwh, is_daylight, installed_capacity_kwp, ghi_w_m2, cloud_cover_pct,
   unnest(['persistence', 'dummy_mean', 'rolling_mean_24h']) AS model_identifier,
   unnest([persistence, dummy_mean, rolling_mean_24h]) AS prediction FROM cohort)
"""


def metrics_sql(group: str, source: str = "long", capacity: bool = True, full: str | None = None) -> str:
    e, y = "(prediction - ac_energy_kwh)", "ac_energy_kwh"
    cap = ""
    if capacity:
        ok = "coalesce(isfinite(installed_capacity_kwp), false) AND installed_capacity_kwp > 0"
        ce = f"CASE WHEN {ok} THEN {e} / installed_capacity_kwp END"
        cap = f", avg(abs({ce})) AS capacity_normalised_mae_kwh_per_kwp, sqrt(avg({ce} * {ce})) AS capacity_normalised_rmse_kwh_per_kwp"
    cov = "CAST(100.0 AS DOUBLE)" if full is None else f"CASE WHEN {full} > 0 THEN 100.0 * count(*) / {full} ELSE 100.0 END"
    return (f"SELECT {group}, count(*) AS prediction_count, avg(abs({e})) AS mae_kwh, sqrt(avg({e} * {e})) AS rmse_kwh, "
            f"quantile_cont(abs({e}), 0.5) AS median_absolute_error_kwh, avg({e}) AS mean_bias_error_kwh, "
            f"sum({y}) AS actual_total_energy_kwh, sum(prediction) AS predicted_total_energy_kwh, "
            f"CASE WHEN count(*) < 2 THEN NULL WHEN var_pop({y}) * count(*) = 0 THEN CASE WHEN sum({e} * {e}) = 0 THEN 1.0 ELSE 0.0 END "
            f"ELSE 1 - sum({e} * {e}) / (var_pop({y}) * count(*)) END AS r2, "
            f"CASE WHEN sum({y}) > 0 THEN sum(abs({e})) / sum({y}) END AS wape, {cov} AS prediction_coverage_pct{cap} "
            f"FROM {source} GROUP BY {group}")


METRIC_DOUBLES = ["mae_kwh", "rmse_kwh", "median_absolute_error_kwh", "mean_bias_error_kwh", "actual_total_energy_kwh",
                  "predicted_total_energy_kwh", "r2", "wape", "prediction_coverage_pct",
                  "capacity_normalised_mae_kwh_per_kwp", "capacity_normalised_rmse_kwh_per_kwp"]
NOCAP = METRIC_DOUBLES[:-2]


@register("common_cohort_summary", PRED_SQL + """SELECT count(*) AS full_row_count,
   (SELECT count(*) FROM cohort) AS common_comparison_row_count,
   CASE WHEN count(*) > 0 THEN 100.0 * (SELECT count(*) FROM cohort) / count(*) ELSE 0.0 END AS comparison_coverage_pct,
   count(*) - (SELECT count(*) FROM cohort) AS excluded_comparison_row_count FROM pred""")
def q_cohort_summary(spark, d):
    _, summary, _ = M.common_cohort(wide_predictions(spark, d), "persistence", ["dummy_mean", "rolling_mean_24h"])
    return summary


@register("common_cohort_exclusions", PRED_SQL + """SELECT * FROM (
   SELECT 'persistence_unavailable' AS reason, count(*) FILTER (WHERE NOT coalesce(isfinite(persistence), false)) AS row_count FROM pred
   UNION ALL SELECT 'dummy_mean_prediction_unavailable', count(*) FILTER (WHERE NOT coalesce(isfinite(dummy_mean), false)) FROM pred
   UNION ALL SELECT 'rolling_mean_24h_prediction_unavailable', count(*) FILTER (WHERE NOT coalesce(isfinite(rolling_mean_24h), false)) FROM pred)
   WHERE row_count > 0""")
def q_cohort_exclusions(spark, d):
    _, _, reasons = M.common_cohort(wide_predictions(spark, d), "persistence", ["dummy_mean", "rolling_mean_24h"])
    return reasons


@register("validation_metrics", rnd_sql(PRED_SQL + metrics_sql("model_identifier", full="(SELECT count(*) FROM pred)"),
                                        METRIC_DOUBLES))
def q_validation_metrics(spark, d):
    wide, long = _cohort_long(spark, d)
    return rounded(M.forecast_metrics(long, ["model_identifier"], capacity="installed_capacity_kwp",
                                      full_row_count=F.lit(wide.count())))


@register("validation_metrics_by_site", rnd_sql(
    PRED_SQL + metrics_sql("model_identifier, site_id", full="(SELECT count(*) FROM pred)"), METRIC_DOUBLES))
def q_validation_metrics_site(spark, d):
    wide, long = _cohort_long(spark, d)
    return rounded(M.forecast_metrics(long, ["model_identifier", "site_id"], capacity="installed_capacity_kwp",
                                      full_row_count=F.lit(wide.count())))


@register("daylight_metrics", rnd_sql(
    PRED_SQL + "SELECT * EXCLUDE (prediction_coverage_pct, _full), 100.0 * prediction_count / _full AS prediction_coverage_pct FROM ("
    + metrics_sql("model_identifier", source="(SELECT * FROM long WHERE is_daylight = 1)", capacity=False)
    + ") JOIN (SELECT model_identifier, count(*) AS _full FROM long GROUP BY model_identifier) USING (model_identifier)", NOCAP))
def q_daylight(spark, d):
    _, long = _cohort_long(spark, d)
    return rounded(M.daylight_metrics(long, ["model_identifier"]))


def _leaderboard(spark, d):
    wide, long = _cohort_long(spark, d)
    m = M.forecast_metrics(M.postprocess(long), ["model_identifier"], capacity="installed_capacity_kwp",
                           full_row_count=F.lit(wide.count()))
    neg = M.negative_counts(long, ["model_identifier"])
    return m.join(neg, "model_identifier")


RANK_BASE = PRED_SQL.rstrip() + ",\nmet AS (" + metrics_sql("model_identifier", full="(SELECT count(*) FROM pred)") + ")\n"


@register("model_ranking", rnd_sql(RANK_BASE + """SELECT model_identifier, mae_kwh, rmse_kwh, model_complexity_rank,
   CAST(row_number() OVER (ORDER BY mae_kwh, rmse_kwh, model_complexity_rank, model_identifier) AS INTEGER) AS rank FROM
   (SELECT *, CASE model_identifier WHEN 'persistence' THEN 0 WHEN 'dummy_mean' THEN 1 WHEN 'ridge' THEN 2
     WHEN 'histogram_gradient_boosting' THEN 3 WHEN 'random_forest' THEN 4 ELSE 99 END AS model_complexity_rank FROM met)""",
    ["mae_kwh", "rmse_kwh"]))
def q_model_ranking(spark, d):
    _, long = _cohort_long(spark, d)
    m = M.forecast_metrics(long, ["model_identifier"])
    return rounded(RK.rank_models(m).select("model_identifier", "mae_kwh", "rmse_kwh", "model_complexity_rank", "rank"))


@register("validation_leaderboard", rnd_sql(RANK_BASE + """SELECT model_identifier, mae_kwh, rmse_kwh, r2, wape,
   CAST(0 AS BIGINT) AS negative_raw_prediction_count, CAST(0.0 AS DOUBLE) AS cross_validation_stability, model_complexity_rank,
   CAST(row_number() OVER (ORDER BY mae_kwh, rmse_kwh, 0.0, model_complexity_rank, model_identifier) AS INTEGER) AS rank FROM
   (SELECT *, CASE model_identifier WHEN 'persistence' THEN 0 WHEN 'ridge' THEN 1 WHEN 'random_forest' THEN 2
     WHEN 'histogram_gradient_boosting' THEN 3 WHEN 'tuned_xgboost' THEN 4 ELSE 99 END AS model_complexity_rank FROM met)""",
    ["mae_kwh", "rmse_kwh", "r2", "wape", "cross_validation_stability"]))
def q_leaderboard(spark, d):
    lb = RK.validation_leaderboard(_leaderboard(spark, d))
    return rounded(lb.select("model_identifier", "mae_kwh", "rmse_kwh", "r2", "wape", "negative_raw_prediction_count",
                             "cross_validation_stability", "model_complexity_rank", "rank"))


PAIRS = [("rolling_mean_24h", "persistence"), ("dummy_mean", "persistence"), ("tuned_xgboost", "persistence")]


@register("leaderboard_comparison", rnd_sql(RANK_BASE + """, req AS (SELECT * FROM (VALUES ('rolling_mean_24h', 'persistence'),
   ('dummy_mean', 'persistence'), ('tuned_xgboost', 'persistence')) t("first", second))
SELECT req."first", req.second, a.mae_kwh - b.mae_kwh AS mae_difference_kwh FROM req
   LEFT JOIN met a ON a.model_identifier = req."first" LEFT JOIN met b ON b.model_identifier = req.second""",
    ["mae_difference_kwh"]).replace("WITH", "WITH", 1))
def q_comparison(spark, d):
    return rounded(RK.compare_pairs(_leaderboard(spark, d), PAIRS))


def _g_sql(x):
    return f"printf('%g', {x})"


ROBUST_SQL = PRED_SQL.rstrip() + f""",
th AS (SELECT model_identifier, quantile_cont(ghi_w_m2, 0.5) FILTER (WHERE isfinite(ghi_w_m2)) AS gm,
   quantile_cont(cloud_cover_pct, 0.5) FILTER (WHERE isfinite(cloud_cover_pct)) AS cm,
   quantile_cont(ac_energy_kwh, 1/3) FILTER (WHERE ac_energy_kwh > 0) AS t1,
   quantile_cont(ac_energy_kwh, 2/3) FILTER (WHERE ac_energy_kwh > 0) AS t2 FROM long GROUP BY model_identifier),
lt AS (SELECT * FROM long JOIN th USING (model_identifier)),
coh AS (
   SELECT model_identifier, 'site' AS cohort_type, site_id AS cohort_value, ac_energy_kwh, prediction FROM lt
   UNION ALL SELECT model_identifier, 'utc_hour', CAST(hour(timestamp) AS VARCHAR), ac_energy_kwh, prediction FROM lt
   UNION ALL SELECT model_identifier, 'utc_month', CAST(month(timestamp) AS VARCHAR), ac_energy_kwh, prediction FROM lt
   UNION ALL SELECT model_identifier, 'daylight', 'daylight', ac_energy_kwh, prediction FROM lt WHERE is_daylight = 1
   UNION ALL SELECT model_identifier, 'daylight', 'non_daylight', ac_energy_kwh, prediction FROM lt WHERE coalesce(is_daylight, 0) <> 1
   UNION ALL SELECT model_identifier, 'irradiance', 'low_le_' || {_g_sql('gm')}, ac_energy_kwh, prediction FROM lt WHERE isfinite(ghi_w_m2) AND ghi_w_m2 <= gm
   UNION ALL SELECT model_identifier, 'irradiance', 'high_gt_' || {_g_sql('gm')}, ac_energy_kwh, prediction FROM lt WHERE isfinite(ghi_w_m2) AND ghi_w_m2 > gm
   UNION ALL SELECT model_identifier, 'cloud_cover', 'low_le_' || {_g_sql('cm')}, ac_energy_kwh, prediction FROM lt WHERE isfinite(cloud_cover_pct) AND cloud_cover_pct <= cm
   UNION ALL SELECT model_identifier, 'cloud_cover', 'high_gt_' || {_g_sql('cm')}, ac_energy_kwh, prediction FROM lt WHERE isfinite(cloud_cover_pct) AND cloud_cover_pct > cm
   UNION ALL SELECT model_identifier, 'target_magnitude', 'zero', ac_energy_kwh, prediction FROM lt WHERE t1 IS NOT NULL AND NOT ac_energy_kwh > 0
   UNION ALL SELECT model_identifier, 'target_magnitude', 'low', ac_energy_kwh, prediction FROM lt WHERE ac_energy_kwh > 0 AND ac_energy_kwh <= t1
   UNION ALL SELECT model_identifier, 'target_magnitude', 'medium', ac_energy_kwh, prediction FROM lt WHERE ac_energy_kwh > t1 AND ac_energy_kwh <= t2
   UNION ALL SELECT model_identifier, 'target_magnitude', 'high', ac_energy_kwh, prediction FROM lt WHERE ac_energy_kwh > t2)
"""


@register("robustness_cohorts", rnd_sql(
    ROBUST_SQL + "SELECT *, prediction_count < 30 AS small_cohort FROM ("
    + metrics_sql("model_identifier, cohort_type, cohort_value", source="coh", capacity=False) + ")", NOCAP))
def q_robustness(spark, d):
    _, long = _cohort_long(spark, d)
    return rounded(M.robustness(long, group_cols=["model_identifier"]))


@register("prediction_report", rnd_sql(PRED_SQL + """SELECT timestamp, site_id, split, ac_energy_kwh AS actual_ac_energy_kwh,
   prediction, ac_energy_kwh - prediction AS residual, abs(ac_energy_kwh - prediction) AS absolute_error,
   (ac_energy_kwh - prediction) * (ac_energy_kwh - prediction) AS squared_error, is_daylight, model_identifier FROM long""",
    ["actual_ac_energy_kwh", "prediction", "residual", "absolute_error", "squared_error"]))
def q_prediction_report(spark, d):
    _, long = _cohort_long(spark, d)
    return rounded(M.prediction_frame(long))


@register("cumulative_energy", rnd_sql(PRED_SQL + """SELECT model_identifier, timestamp, site_id,
   sum(ac_energy_kwh) OVER w AS cumulative_actual_kwh, sum(prediction) OVER w AS cumulative_predicted_kwh FROM long
   WINDOW w AS (PARTITION BY model_identifier ORDER BY timestamp, site_id ROWS UNBOUNDED PRECEDING)""",
    ["cumulative_actual_kwh", "cumulative_predicted_kwh"]))
def q_cumulative(spark, d):
    _, long = _cohort_long(spark, d)
    return rounded(M.cumulative_energy(M.prediction_frame(long)))


@register("last_training_timestamps", QF._FJ + """SELECT site_id, count(*) AS row_count, min(timestamp) AS first_kept FROM feat
   WHERE split = 'train' AND timestamp >= (SELECT min(timestamp) FROM (SELECT DISTINCT timestamp FROM feat WHERE split = 'train'
   ORDER BY timestamp DESC LIMIT 200)) AND split = 'train' GROUP BY site_id""")
def q_last_timestamps(spark, d):
    train = QF._spark_features(spark, d).features.filter(F.col("split") == "train")
    kept = RK.keep_last_timestamps(train, 200)
    return kept.groupBy("site_id").agg(F.count("*").alias("row_count"), F.min("timestamp").alias("first_kept"))

"""Queries: calendar / weather / lag features, the feature job, its quality
and manifest (F1-F14, J6, J8, A15-A18), chronological splits and folds
(W7, W8, J9, A27, A28)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pvspark.operators import features as FE
from pvspark.operators import splits as SP
from pvspark.operators.config import FeatureConfig
from pvspark.operators.history import add_history
from pvspark.plans import oracle as O
from pvspark.plans.registry import HOURLY_DOUBLES, register, rnd_sql, rounded
from pvspark.sources import fixtures as fx

CFG = FeatureConfig()
FOLDS = SP.FoldSpec(n_splits=3, gap_hours=24, minimum_training_hours=96, validation_window_hours=48)


def _lit(x: float) -> str:
    return f"CAST('{repr(x)}' AS DOUBLE)"


CAL_INTS = ["local_hour", "local_day_of_week", "local_day_of_month", "local_day_of_year", "local_week_of_year",
            "local_month", "local_quarter", "is_weekend"]
CYC_NAMES = [f"{n}_{f}" for n, _ in FE.CYCLES for f in ("sin", "cos")]


def _calendar_sql(src: str) -> str:
    base = {"hour": "local_hour", "day_of_week": "local_day_of_week",
            "day_of_year": "(local_day_of_year - 1)", "month": "(local_month - 1)"}
    cyc = ", ".join(f"{fn}(CAST({base[n]} AS DOUBLE) * {_lit(2 * math.pi / p)}) AS {n}_{fn}"
                    for n, p in FE.CYCLES for fn in ("sin", "cos"))
    return f"""
cal0 AS (SELECT *, timezone(timezone, timezone('UTC', timestamp)) AS _local FROM {src}),
cal1 AS (SELECT * EXCLUDE (_local), CAST(hour(_local) AS INTEGER) AS local_hour, CAST(isodow(_local) - 1 AS INTEGER) AS local_day_of_week,
   CAST(day(_local) AS INTEGER) AS local_day_of_month, CAST(dayofyear(_local) AS INTEGER) AS local_day_of_year,
   CAST(weekofyear(_local) AS INTEGER) AS local_week_of_year, CAST(month(_local) AS INTEGER) AS local_month,
   CAST(quarter(_local) AS INTEGER) AS local_quarter, CASE WHEN isodow(_local) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend FROM cal0),
cal AS (SELECT *, {cyc} FROM cal1)"""


WEATHER_ENGINEERED = ["is_daylight", "ghi_normalised_by_capacity", "temperature_ghi_interaction", "cloud_ghi_interaction",
                      "humidity_temperature_interaction", "diffuse_fraction", "direct_to_global_ratio",
                      "precipitation_indicator", "availability_fraction", "apparent_temperature_difference"]


def _weather_sql(src: str, cfg: FeatureConfig) -> str:
    eps = _lit(cfg.irradiance_epsilon)
    return f"""
wf AS (SELECT *, CASE WHEN ghi_w_m2 >= {_lit(cfg.daylight_ghi_threshold_w_m2)} THEN 1 ELSE 0 END AS is_daylight,
   ghi_w_m2 / installed_capacity_kwp AS ghi_normalised_by_capacity,
   ambient_temperature_c * ghi_w_m2 AS temperature_ghi_interaction, cloud_cover_pct * ghi_w_m2 AS cloud_ghi_interaction,
   relative_humidity_pct * ambient_temperature_c AS humidity_temperature_interaction,
   CASE WHEN abs(ghi_w_m2) > {eps} THEN dhi_w_m2 / ghi_w_m2 END AS diffuse_fraction,
   CASE WHEN abs(ghi_w_m2) > {eps} THEN dni_w_m2 / ghi_w_m2 END AS direct_to_global_ratio,
   CASE WHEN precipitation_mm > 0 THEN 1 ELSE 0 END AS precipitation_indicator,
   inverter_availability_pct / 100 AS availability_fraction,
   module_temperature_c - ambient_temperature_c AS apparent_temperature_difference FROM {src})"""


SITE_JOIN = """
fj AS (SELECT h.*, s.timezone, s.installed_capacity_kwp, s.panel_tilt_degrees, s.panel_azimuth_degrees, s.latitude, s.longitude
   FROM hourly h LEFT JOIN sites s USING (site_id))"""

SPLIT_SQL = """
dts AS (SELECT DISTINCT timestamp AS t FROM hourly),
rk AS (SELECT t, row_number() OVER (ORDER BY t) AS r FROM dts),
nn AS (SELECT count(*) AS n, CAST(floor(CAST(count(*) AS DOUBLE) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS k1,
   CAST(floor(CAST(count(*) AS DOUBLE) * CAST(0.15 AS DOUBLE)) AS BIGINT) AS k2 FROM dts),
cuts AS (SELECT (SELECT t FROM rk, nn WHERE r = k1) AS te, (SELECT t FROM rk, nn WHERE r = k1 + k2) AS ve)"""


def _label(names=("training", "validation", "testing")):
    return (f"CASE WHEN timestamp <= (SELECT te FROM cuts) THEN '{names[0]}' WHEN timestamp <= (SELECT ve FROM cuts) "
            f"THEN '{names[1]}' ELSE '{names[2]}' END")


def feature_job_sql(cfg: FeatureConfig = CFG):
    hist, hist_names, failures = O.history_select(cfg, HOURLY_DOUBLES, source="wf")
    elig = O.eligibility_select(failures, "hist")
    lagmin = f"ac_energy_lag_{min(cfg.target_lag_hours)}h"
    ctes = O.with_ctes(O.EVENTS_HOURLY, O.SITES, SITE_JOIN, _calendar_sql("fj"), _weather_sql("cal", cfg),
                       f"hist AS ({hist})", f"elig AS ({elig})", SPLIT_SQL,
                       f"feat AS (SELECT *, {lagmin} / installed_capacity_kwp AS historical_generation_per_capacity, "
                       f"{_label(('train', 'validation', 'test'))} AS split FROM elig)")
    return ctes, hist_names


def _spark_features(spark, d, cfg=CFG, only_eligible=False):
    # Read by the split plan and the feature job: materialise once.
    h = fx.materialized(fx.events_hourly(spark, d))
    plan = SP.plan_chronological_splits(h)
    return FE.build_features(h, fx.sites_for(h), cfg, split_plan=plan, only_eligible=only_eligible)


_FJ, _HIST = feature_job_sql()
_WLAGS = [n for n in _HIST if not n.startswith("ac_energy_")]
_TARGET_HIST = [n for n in _HIST if n.startswith("ac_energy_")]
PREDICTORS = (list(FE.RAW_WEATHER) + WEATHER_ENGINEERED + list(FE.TEMPORAL_FEATURES) + _TARGET_HIST + _WLAGS
              + list(FE.SITE_FEATURES) + ["historical_generation_per_capacity"])
INT_COLS = set(CAL_INTS) | {"is_daylight", "precipitation_indicator", "feature_missing_count"} | {
    n for n in _HIST if n.endswith("_count")}
FEATURE_COLS = ["timestamp", "site_id", "ac_energy_kwh", "feature_eligible", "feature_missing_count",
                "feature_missing_reasons", "split"] + PREDICTORS
DOUBLE_COLS = [c for c in FEATURE_COLS if c not in INT_COLS and c not in (
    "timestamp", "site_id", "feature_eligible", "feature_missing_reasons", "split")]


@register("calendar_features", rnd_sql(O.with_ctes(O.EVENTS_HOURLY, O.SITES, SITE_JOIN, _calendar_sql("fj"))
                                       + "SELECT site_id, timestamp, timezone, " + ", ".join(CAL_INTS + CYC_NAMES) + " FROM cal",
                                       CYC_NAMES))
def q_calendar(spark, d):
    h = fx.events_hourly(spark, d)
    df = FE.with_site_attributes(h.select("site_id", "timestamp"), fx.sites_for(h), ["timezone"])
    return rounded(FE.add_calendar(df).select("site_id", "timestamp", "timezone", *CAL_INTS, *CYC_NAMES))


_WE_DOUBLES = [c for c in WEATHER_ENGINEERED if c not in ("is_daylight", "precipitation_indicator")]


@register("weather_features", rnd_sql(O.with_ctes(O.EVENTS_HOURLY, O.SITES, SITE_JOIN, _weather_sql("fj", CFG))
                                      + "SELECT site_id, timestamp, " + ", ".join(WEATHER_ENGINEERED) + " FROM wf", _WE_DOUBLES))
def q_weather_features(spark, d):
    h = fx.events_hourly(spark, d)
    df = FE.with_site_attributes(h, fx.sites_for(h), ["installed_capacity_kwp"])
    out, names = FE.add_weather_features(df, CFG)
    return rounded(out.select("site_id", "timestamp", *names))


_WL_CFG = FeatureConfig(include_target_history=False)
_wl_hist, _wl_names, _ = O.history_select(_WL_CFG, HOURLY_DOUBLES)


@register("weather_lag_features", rnd_sql(O.with_ctes(O.EVENTS_HOURLY, f"wl AS ({_wl_hist})")
                                          + "SELECT site_id, timestamp, " + ", ".join(_wl_names) + " FROM wl", _wl_names))
def q_weather_lags(spark, d):
    out, _, names, _ = add_history(fx.events_hourly(spark, d), _WL_CFG)
    return rounded(out.select("site_id", "timestamp", *names))


@register("feature_table", rnd_sql(_FJ + "SELECT " + ", ".join(FEATURE_COLS) + " FROM feat", DOUBLE_COLS))
def q_feature_table(spark, d):
    return rounded(_spark_features(spark, d).features)


@register("feature_table_eligible", rnd_sql(_FJ + "SELECT " + ", ".join(FEATURE_COLS) + " FROM feat WHERE feature_eligible",
                                            DOUBLE_COLS))
def q_feature_table_eligible(spark, d):
    return rounded(_spark_features(spark, d, only_eligible=True).features)


def _quality_sql():
    parts = []
    for c in PREDICTORS:
        x = f"CAST({c} AS DOUBLE)"
        grp = ("'raw'" if c in FE.UNITS else "'exact_time_lags'" if "_lag_" in c
               else "'rolling_history'" if "_rolling_" in c else "'other'")
        parts.append(f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {x} IS NULL) AS missing_count, count({x}) AS non_null_count, "
                     f"count(*) FILTER (WHERE abs({x}) = CAST('inf' AS DOUBLE)) AS infinite_count, "
                     f"(min({x}) IS NULL OR min({x}) = max({x})) AS is_constant, {grp} AS feature_group FROM feat")
    return _FJ + " UNION ALL ".join(parts)


@register("feature_quality", _quality_sql())
def q_feature_quality(spark, d):
    r = _spark_features(spark, d)
    return FE.feature_quality(r.audit, r.contract)


@register("feature_manifest", _FJ + """SELECT count(*) AS output_row_count, count(*) AS source_row_count, CAST(0 AS BIGINT) AS excluded_row_count,
   count(DISTINCT site_id) AS site_count, count(*) FILTER (WHERE feature_eligible) AS eligible_rows,
   count(*) FILTER (WHERE NOT feature_eligible) AS ineligible_rows, min(timestamp) AS earliest_timestamp, max(timestamp) AS latest_timestamp,
   count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'validation') AS validation_rows,
   count(*) FILTER (WHERE split = 'test') AS test_rows, """ + f"{len(PREDICTORS)} AS predictor_count FROM feat")
def q_feature_manifest(spark, d):
    r = _spark_features(spark, d)
    return FE.feature_manifest(r.audit, r.contract).select(
        "output_row_count", "source_row_count", "excluded_row_count", "site_count", "eligible_rows", "ineligible_rows",
        "earliest_timestamp", "latest_timestamp", "train_rows", "validation_rows", "test_rows",
        F.col("predictor_count").cast("int"))


# ------------------------------------------------------------------ splits
@register("chronological_split_summary", O.with_ctes(O.EVENTS_HOURLY, SPLIT_SQL) + f"""
SELECT split, min(timestamp) AS beginning_timestamp, max(timestamp) AS ending_timestamp, count(*) AS record_count,
   count(DISTINCT timestamp) AS unique_timestamp_count FROM (SELECT *, {_label()} AS split FROM hourly) GROUP BY split""")
def q_split_summary(spark, d):
    h = fx.events_hourly(spark, d)
    return SP.split_summary(SP.label_chronological(h, SP.plan_chronological_splits(h)))


@register("chronological_split_site_counts", O.with_ctes(O.ORDERS_HOURLY, SPLIT_SQL) + f"""
SELECT split, site_id, count(*) AS record_count FROM (SELECT *, {_label()} AS split FROM hourly) GROUP BY ALL""")
def q_split_sites(spark, d):
    h = fx.orders_hourly(spark, d)
    return SP.split_site_counts(SP.label_chronological(h, SP.plan_chronological_splits(h)))


def _folds_sql():
    n, g, v = FOLDS.n_splits, FOLDS.gap_hours, FOLDS.validation_window_hours
    return _FJ + f""",
tr AS (SELECT * FROM feat WHERE split = 'train' AND feature_eligible),
fb AS (SELECT CAST(i + 1 AS INTEGER) AS fold_number,
   max_t - to_hours({n * v - 1}) + to_hours(i * {v}) AS validation_start FROM (SELECT max(timestamp) AS max_t FROM tr),
   range({n}) AS t(i)),
folds AS (SELECT fold_number, validation_start - to_hours({g + 1}) AS training_end, validation_start - to_hours({g}) AS gap_start,
   validation_start - to_hours(1) AS gap_end, validation_start, validation_start + to_hours({v - 1}) AS validation_end FROM fb),
members AS (SELECT tr.site_id, tr.timestamp, folds.fold_number, 'training' AS role FROM tr JOIN folds ON tr.timestamp <= folds.training_end
   UNION ALL SELECT tr.site_id, tr.timestamp, folds.fold_number, 'validation' FROM tr JOIN folds
   ON tr.timestamp BETWEEN folds.validation_start AND folds.validation_end)"""


def _spark_members(spark, d):
    r = _spark_features(spark, d)
    tr = r.features.filter((F.col("split") == "train") & F.col("feature_eligible")).select("site_id", "timestamp")
    folds = SP.rolling_origin_folds(tr, FOLDS)
    return tr, folds, SP.fold_membership(tr, folds)


@register("rolling_origin_fold_summary", _folds_sql() + """
, per AS (SELECT fold_number, role, site_id, count(*) AS n, min(timestamp) AS lo FROM members GROUP BY ALL),
s AS (SELECT fold_number, CAST(sum(n) FILTER (WHERE role = 'training') AS BIGINT) AS training_row_count,
   CAST(sum(n) FILTER (WHERE role = 'validation') AS BIGINT) AS validation_row_count,
   count(*) FILTER (WHERE role = 'training') AS training_site_count, count(*) FILTER (WHERE role = 'validation') AS validation_site_count,
   min(lo) FILTER (WHERE role = 'training') AS training_start FROM per GROUP BY fold_number)
SELECT * FROM folds LEFT JOIN s USING (fold_number)""")
def q_fold_summary(spark, d):
    _, folds, m = _spark_members(spark, d)
    return SP.fold_summary(m, folds)


@register("rolling_origin_fold_site_counts", _folds_sql()
          + " SELECT fold_number, site_id, role, count(*) AS row_count FROM members GROUP BY ALL")
def q_fold_sites(spark, d):
    _, _, m = _spark_members(spark, d)
    return SP.fold_site_counts(m)

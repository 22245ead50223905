"""DuckDB SQL equivalents of the fixtures and operators.

Each registered query has an independent SQL formulation that DuckDB runs on
the same parquet tables; the helpers here build the shared CTEs.
"""

from __future__ import annotations

from pvspark.operators.config import FeatureConfig
from pvspark.operators.history import ROLLING_STATS, WEATHER_LAG_BASES
from pvspark.schema import HOUR_US, REQUIRED_WEATHER

EVENTS_HOURLY = """
ev_k AS (SELECT CAST(greatest(2, floor(count(*) / 2500)) AS BIGINT) AS k_sites FROM events),
ev_src AS (
  SELECT 'site-' || CAST(user_id % (SELECT k_sites FROM ev_k) AS VARCHAR) AS site_id,
         date_trunc('hour', ts) AS timestamp, event_type AS et,
         CAST(round(value * 100) AS BIGINT) AS c,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
hourly AS (
  SELECT site_id, timestamp,
    CAST(sum(CASE WHEN et = 'purchase' THEN c ELSE 0 END) AS DOUBLE) / 100 AS ac_energy_kwh,
    CAST(min(k) AS DOUBLE) * 10 AS ghi_w_m2,
    CAST(sum(k) % 400 AS DOUBLE) / 10 - 5 AS ambient_temperature_c,
    CAST(max(k) AS DOUBLE) AS cloud_cover_pct,
    CAST(sum(c) % 101 AS DOUBLE) AS relative_humidity_pct,
    CAST(max(c) % 200 AS DOUBLE) / 10 AS wind_speed_m_s,
    CAST(max(k) FILTER (WHERE et = 'error') AS DOUBLE) * 8 AS dni_w_m2,
    CAST(min(k) FILTER (WHERE et = 'click') AS DOUBLE) * 3 AS dhi_w_m2,
    CAST(max(k) FILTER (WHERE et = 'signup') AS DOUBLE) / 2 AS module_temperature_c,
    CAST(count(*) FILTER (WHERE et = 'view') AS DOUBLE) / 2 AS precipitation_mm,
    CAST(100 - count(*) % 5 AS DOUBLE) AS inverter_availability_pct
  FROM ev_src GROUP BY site_id, timestamp)"""

ORDERS_HOURLY = """
or_k AS (SELECT CAST(greatest(2, floor(count(*) / 3000)) AS BIGINT) AS k_sites FROM orders),
or_src AS (
  SELECT 'plant-' || CAST(o_custkey % (SELECT k_sites FROM or_k) AS VARCHAR) AS site_id,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS timestamp,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders),
hourly AS (
  SELECT site_id, timestamp,
    CAST(sum(cents % 5000) AS DOUBLE) / 100 AS ac_energy_kwh,
    CAST(max(cents % 1000) AS DOUBLE) AS ghi_w_m2
  FROM or_src GROUP BY site_id, timestamp)"""

SITES = """
sites AS (
  SELECT site_id,
    CAST((i * 37) % 181 - 90 AS DOUBLE) AS latitude,
    CAST((i * 53) % 361 - 180 AS DOUBLE) AS longitude,
    ['UTC', 'Africa/Dar_es_Salaam', 'America/New_York', 'Asia/Kolkata'][CAST(i % 4 + 1 AS INTEGER)] AS timezone,
    CAST(10 + i AS DOUBLE) AS installed_capacity_kwp,
    CAST(5 + i % 40 AS DOUBLE) AS panel_tilt_degrees,
    CAST(i % 360 AS DOUBLE) AS panel_azimuth_degrees
  FROM (SELECT DISTINCT site_id, CAST(regexp_extract(site_id, '(\\d+)$', 1) AS BIGINT) AS i FROM hourly))"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _frame(lo_us: int, hi_us: int) -> str:
    return (f"OVER (PARTITION BY site_id ORDER BY _us RANGE BETWEEN {lo_us} PRECEDING "
            f"AND {hi_us} PRECEDING)")


def _stat_sql(stat: str, y: str) -> str:
    return {
        "count": f"count({y})",
        "mean": f"avg({y})",
        "std": f"stddev_samp({y})",
        "min": f"min({y})",
        "max": f"max({y})",
        "median": f"quantile_cont({y}, 0.5)",
    }[stat]


def history_select(cfg: FeatureConfig, present: list[str], source: str = "hourly") -> tuple[str, list[str], list[tuple[str, str]]]:
    """SELECT adding history columns over ``source``; returns (sql, names, failures)."""
    parts, names, failures = [], [], []
    if cfg.include_target_history:
        for lag in cfg.target_lag_hours:
            n = f"ac_energy_lag_{lag}h"
            parts.append(f"max(ac_energy_kwh) {_frame(lag * HOUR_US, lag * HOUR_US)} AS {n}")
            names.append(n)
            failures.append((f"missing_exact_target_lag_{lag}h", f"{n} IS NULL"))
        h = cfg.forecast_horizon_hours
        for win in cfg.rolling_window_hours:
            for stat in ROLLING_STATS:
                n = f"ac_energy_rolling_{win}h_{stat}"
                parts.append(f"{_stat_sql(stat, 'ac_energy_kwh')} {_frame((h + win) * HOUR_US - 1, h * HOUR_US)} AS {n}")
                names.append(n)
            failures.append((f"missing_rolling_history_{win}h", f"coalesce(ac_energy_rolling_{win}h_count, 0) = 0"))
            if cfg.require_complete_history:
                failures.append((f"incomplete_rolling_history_{win}h", f"ac_energy_rolling_{win}h_count < {win}"))
    if cfg.include_weather_lags:
        srcs = [c for c in WEATHER_LAG_BASES if c in present]
        for lag in cfg.weather_lag_hours:
            for s in srcs:
                n = f"{WEATHER_LAG_BASES[s]}_lag_{lag}h"
                parts.append(f"max({s}) {_frame(lag * HOUR_US, lag * HOUR_US)} AS {n}")
                names.append(n)
    sql = (f"SELECT *, {', '.join(parts)} FROM (SELECT *, epoch_us(timestamp) AS _us FROM {source})")
    return sql, names, failures


def eligibility_select(failures: list[tuple[str, str]], source: str) -> str:
    items = [f"CASE WHEN {c} IS NULL THEN 'missing_source_weather:{c}' END" for c in REQUIRED_WEATHER]
    items += [f"CASE WHEN coalesce({cond}, true) THEN '{reason}' END" for reason, cond in failures]
    arr = f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
    return (f"SELECT *, CAST(len(_r) AS INTEGER) AS feature_missing_count, "
            f"array_to_string(_r, ';') AS feature_missing_reasons, len(_r) = 0 AS feature_eligible "
            f"FROM (SELECT *, {arr} AS _r FROM {source})")


def describe_sql(x: str) -> str:
    return (f"CASE WHEN count({x}) > 0 THEN count({x}) END AS count, min({x}) AS minimum, "
            f"max({x}) AS maximum, avg({x}) AS mean, quantile_cont({x}, 0.5) AS median, "
            f"CASE WHEN count({x}) = 1 THEN CAST(0 AS DOUBLE) ELSE stddev_samp({x}) END AS standard_deviation, "
            f"quantile_cont({x}, 0.05) AS percentile_05, quantile_cont({x}, 0.25) AS percentile_25, "
            f"quantile_cont({x}, 0.5) AS percentile_50, quantile_cont({x}, 0.75) AS percentile_75, "
            f"quantile_cont({x}, 0.95) AS percentile_95, sum({x}) AS total")


DESCRIBE_DOUBLES = ["minimum", "maximum", "mean", "median", "standard_deviation", "percentile_05",
                    "percentile_25", "percentile_50", "percentile_75", "percentile_95", "total"]

COVERAGE = """
cov_keys AS (SELECT site_id, timestamp, count(*) AS n FROM hourly GROUP BY ALL),
cov_days AS (SELECT site_id, date_trunc('day', timestamp) AS day, CAST(sum(n) AS BIGINT) AS n,
             CAST(sum(n - 1) AS BIGINT) AS dups, min(timestamp) AS lo, max(timestamp) AS hi
             FROM cov_keys GROUP BY ALL),
cov_sites AS (SELECT site_id, min(lo) AS earliest_timestamp, max(hi) AS latest_timestamp,
              CAST(sum(n) AS BIGINT) AS actual_hourly_records, CAST(sum(dups) AS BIGINT) AS duplicate_count,
              count(*) FILTER (WHERE n = 24) AS complete_days, count(*) FILTER (WHERE n < 24) AS partial_days
              FROM cov_days GROUP BY site_id),
coverage AS (SELECT site_id, earliest_timestamp, latest_timestamp,
   CAST(floor((epoch_us(latest_timestamp) - epoch_us(earliest_timestamp)) / 3600000000) + 1 AS BIGINT) AS expected_hourly_records,
   actual_hourly_records, duplicate_count, complete_days, partial_days FROM cov_sites)"""

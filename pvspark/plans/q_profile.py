"""Queries: statistics, profile, coverage, correlation and readiness."""

from __future__ import annotations

from pvspark.operators import profile as P
from pvspark.plans import oracle as O
from pvspark.plans.registry import register, rnd_sql, rounded
from pvspark.schema import WEATHER_COLUMNS
from pvspark.sources import fixtures as fx

EV = O.with_ctes(O.EVENTS_HOURLY)
EV_COV = O.with_ctes(O.EVENTS_HOURLY, O.COVERAGE)
ORD = O.with_ctes(O.ORDERS_HOURLY)
ORD_COV = O.with_ctes(O.ORDERS_HOURLY, O.COVERAGE)
LEVEL = "CASE WHEN grouping(site_id) = 1 THEN 'overall' ELSE 'site' END AS level"


@register("target_summary", rnd_sql(
    EV + f"SELECT {LEVEL}, site_id, {O.describe_sql('ac_energy_kwh')}, "
    "count(*) FILTER (WHERE ac_energy_kwh = 0) / count(*) * 100 AS zero_generation_percentage "
    "FROM hourly GROUP BY ROLLUP (site_id)",
    O.DESCRIBE_DOUBLES + ["zero_generation_percentage"]).replace("AS total,", "AS total_generated_energy_kwh,")
    .replace("round(round(total *", "round(round(total_generated_energy_kwh *").replace("AS total)", "AS total_generated_energy_kwh)"))
def q_target_summary(spark, d):
    return rounded(P.target_summary(fx.events_hourly(spark, d)))


def _weather_sql():
    cols = [c for c in WEATHER_COLUMNS]
    return rnd_sql(EV + f"SELECT weather_variable AS \"column\", {O.describe_sql('value')} FROM "
                   f"(UNPIVOT hourly ON {', '.join(cols)} INTO NAME weather_variable VALUE value) "
                   "GROUP BY weather_variable", O.DESCRIBE_DOUBLES)


@register("weather_summary", _weather_sql())
def q_weather_summary(spark, d):
    return rounded(P.weather_summary(fx.events_hourly(spark, d)))


@register("hourly_profile", rnd_sql(
    EV + f"SELECT {LEVEL}, site_id, CAST(hour(timestamp) AS INTEGER) AS hour_utc, "
    "avg(ac_energy_kwh) AS mean_ac_energy_kwh FROM hourly "
    "GROUP BY GROUPING SETS ((hour_utc), (site_id, hour_utc))", ["mean_ac_energy_kwh"]))
def q_hourly_profile(spark, d):
    return rounded(P.hourly_profile(fx.events_hourly(spark, d)))


@register("daily_energy", rnd_sql(
    EV + f"SELECT {LEVEL}, site_id, date_trunc('day', timestamp) AS day, sum(ac_energy_kwh) AS energy_kwh "
    "FROM hourly GROUP BY GROUPING SETS ((day), (site_id, day))", ["energy_kwh"]))
def q_daily_energy(spark, d):
    return rounded(P.daily_energy(fx.events_hourly(spark, d)))


_MONTHLY = (f"SELECT * EXCLUDE (_n) FROM (SELECT *, count(*) OVER (PARTITION BY level, site_id) AS _n FROM ("
            f"SELECT {LEVEL}, site_id, strftime(timestamp, '%Y-%m') AS month, sum(ac_energy_kwh) AS energy_kwh, "
            "avg(ac_energy_kwh) AS mean_ac_energy_kwh FROM hourly "
            "GROUP BY GROUPING SETS ((month), (site_id, month)))) WHERE _n >= 2")


@register("monthly_energy", rnd_sql(ORD + _MONTHLY, ["energy_kwh", "mean_ac_energy_kwh"]))
def q_monthly_energy(spark, d):
    return rounded(P.monthly_energy(fx.orders_hourly(spark, d)))


@register("monthly_energy_single_month", rnd_sql(EV + _MONTHLY, ["energy_kwh", "mean_ac_energy_kwh"]))
def q_monthly_energy_events(spark, d):
    return rounded(P.monthly_energy(fx.events_hourly(spark, d)))


@register("weekday_profile", rnd_sql(
    EV + "SELECT dayname(timestamp) AS weekday, avg(ac_energy_kwh) AS mean_ac_energy_kwh FROM hourly GROUP BY ALL",
    ["mean_ac_energy_kwh"]))
def q_weekday_profile(spark, d):
    return rounded(P.weekday_profile(fx.events_hourly(spark, d)))


@register("hourly_ghi_generation", rnd_sql(
    EV + "SELECT CAST(hour(timestamp) AS INTEGER) AS hour_utc, avg(ghi_w_m2) AS mean_ghi_w_m2, "
    "avg(ac_energy_kwh) AS mean_generation_kwh FROM hourly GROUP BY ALL",
    ["mean_ghi_w_m2", "mean_generation_kwh"]))
def q_hourly_ghi(spark, d):
    return rounded(P.hourly_ghi_generation(fx.events_hourly(spark, d)))


_COV_SELECT = ("SELECT site_id, earliest_timestamp, latest_timestamp, expected_hourly_records, actual_hourly_records, "
               "round_even(actual_hourly_records / expected_hourly_records * 100, 4) AS completeness_percentage, "
               "expected_hourly_records - actual_hourly_records AS missing_timestamp_count, complete_days, partial_days "
               "FROM coverage")


@register("site_coverage", rnd_sql(EV_COV + _COV_SELECT, ["completeness_percentage"]))
def q_site_coverage(spark, d):
    return rounded(P.site_coverage(fx.events_hourly(spark, d)))


@register("site_coverage_orders", rnd_sql(ORD_COV + _COV_SELECT, ["completeness_percentage"]))
def q_site_coverage_orders(spark, d):
    return rounded(P.site_coverage(fx.orders_hourly(spark, d)))


def _profile_sql(cov, optional_absent):
    return rnd_sql(cov + (
        "SELECT CAST(sum(actual_hourly_records) AS BIGINT) AS total_record_count, count(*) AS number_of_sites, "
        "min(earliest_timestamp) AS earliest_timestamp, max(latest_timestamp) AS latest_timestamp, "
        "(epoch_us(max(latest_timestamp)) - epoch_us(min(earliest_timestamp))) / 3600000000 AS total_calendar_duration_hours, "
        "CAST(sum(expected_hourly_records - actual_hourly_records) AS BIGINT) AS missing_timestamp_count, "
        "CAST(sum(duplicate_count) AS BIGINT) AS duplicate_count, CAST(sum(complete_days) AS BIGINT) AS number_of_complete_days, "
        f"CAST(sum(partial_days) AS BIGINT) AS number_of_partial_days, '{optional_absent}' AS optional_columns_absent "
        "FROM coverage"), ["total_calendar_duration_hours"])


@register("dataset_profile", _profile_sql(EV_COV, ""))
def q_dataset_profile(spark, d):
    return rounded(P.dataset_profile(fx.events_hourly(spark, d)))


@register("dataset_profile_orders", _profile_sql(
    ORD_COV, "dni_w_m2;dhi_w_m2;module_temperature_c;precipitation_mm;inverter_availability_pct"))
def q_dataset_profile_orders(spark, d):
    df = fx.orders_hourly(spark, d)
    return rounded(P.dataset_profile(df))


_HOURLY_COLS = ["site_id", "timestamp", "ac_energy_kwh", "ghi_w_m2", "ambient_temperature_c", "cloud_cover_pct",
                "relative_humidity_pct", "wind_speed_m_s", "dni_w_m2", "dhi_w_m2", "module_temperature_c",
                "precipitation_mm", "inverter_availability_pct"]


@register("missing_value_counts", EV + "UNPIVOT (SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _HOURLY_COLS)
    + " FROM hourly) ON COLUMNS(*) INTO NAME \"column\" VALUE missing_count")
def q_missing_value_counts(spark, d):
    return P.missing_value_counts(fx.events_hourly(spark, d))


def _corr_sql():
    names = ", ".join(f"'{c}'" for c in WEATHER_COLUMNS)
    return O.with_ctes(O.EVENTS_HOURLY, f"""
corr_long AS (SELECT weather_variable, x, ac_energy_kwh AS y FROM
   (UNPIVOT hourly ON {', '.join(WEATHER_COLUMNS)} INTO NAME weather_variable VALUE x)
   WHERE x IS NOT NULL AND ac_energy_kwh IS NOT NULL)""", f"""
corr_agg AS (SELECT weather_variable, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
   covar_samp(x, y) AS cov, stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM corr_long GROUP BY ALL)""", f"""
corr_names AS (SELECT unnest([{names}]) AS weather_variable)""", """
corr AS (SELECT weather_variable, coalesce(n, 0) AS n, x0, x1, y0, y1, cov, sx, sy,
   CASE WHEN coalesce(n, 0) < 2 THEN 'fewer than two complete paired observations'
        WHEN x0 = x1 THEN 'weather column is constant'
        WHEN y0 = y1 THEN 'target column is constant' END AS reason
   FROM corr_names LEFT JOIN corr_agg USING (weather_variable))""", """
corr_out AS (SELECT weather_variable, 'Pearson' AS method, n AS paired_observations,
   CASE WHEN reason IS NULL AND sx * sy > 0 THEN cov / (sx * sy) END AS correlation_with_ac_energy_kwh,
   CASE WHEN reason IS NULL AND sx * sy > 0 THEN 'available' ELSE 'unavailable' END AS availability, reason
   FROM corr)""")


@register("correlations", rnd_sql(_corr_sql() + "SELECT * FROM corr_out", ["correlation_with_ac_energy_kwh"]))
def q_correlations(spark, d):
    return rounded(P.correlations(fx.events_hourly(spark, d)))


def _matrix_sql():
    cols = ["ac_energy_kwh"] + list(WEATHER_COLUMNS)
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            xa = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
            xb = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            parts.append(
                f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_samp({xa}) * stddev_samp({xb}) > 0 THEN "
                f"covar_samp({xa}, {xb}) / (stddev_samp({xa}) * stddev_samp({xb})) END AS r FROM hourly")
    pairs = " UNION ALL ".join(parts)
    return _corr_sql().rstrip() + f""",
mx_half AS ({pairs}),
mx_all AS (SELECT a, b, r FROM mx_half UNION ALL SELECT b AS a, a AS b, r FROM mx_half WHERE a <> b),
mx_ok AS (SELECT weather_variable AS v FROM corr_out WHERE availability = 'available' UNION ALL SELECT 'ac_energy_kwh'),
mx AS (SELECT a, b, r FROM mx_all WHERE a IN (SELECT v FROM mx_ok) AND b IN (SELECT v FROM mx_ok))
SELECT row_variable, column_variable, correlation FROM (
  SELECT a AS row_variable, b AS column_variable, r AS correlation, count(*) OVER () AS _k FROM mx) WHERE _k > 1"""


@register("correlation_matrix", rnd_sql(_matrix_sql(), ["correlation"]))
def q_correlation_matrix(spark, d):
    return rounded(P.correlation_matrix(fx.events_hourly(spark, d)))


def _readiness_sql(base, all_cols):
    any_null = " OR ".join(f"{c} IS NULL" for c in all_cols)
    L = P.READINESS_LIMITATIONS
    return base + f"""
, r_rows AS (SELECT site_id, timestamp, ac_energy_kwh AS y, strftime(timestamp, '%Y-%m') AS m,
     CAST(({any_null}) AS INTEGER) AS nul,
     CAST((ghi_w_m2 >= 500.0 AND NOT ({any_null})) AS INTEGER) AS cd FROM hourly),
r_sites AS (SELECT site_id, floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3600000000) + 1 - count(*) AS missing,
     min(y) AS y0, max(y) AS y1, min(m) AS m0, max(m) AS m1, max(nul) AS nul, max(cd) AS cd FROM r_rows GROUP BY site_id),
r_flags AS (SELECT sum(missing) = 0 AS c, max(nul) = 1 AS mp, min(y0) < max(y1) AS tv, min(m0) < max(m1) AS mm,
     coalesce(max(cd) = 1, false) AS cdr, count(*) > 1 AS multi FROM r_sites),
r_lim AS (SELECT *, list_filter([CASE WHEN NOT c THEN '{L[0]}' END, CASE WHEN mp THEN '{L[1]}' END,
     CASE WHEN NOT tv THEN '{L[2]}' END, CASE WHEN NOT mm THEN '{L[3]}' END,
     CASE WHEN NOT cdr THEN '{L[4]}' END, CASE WHEN NOT multi THEN '{L[5]}' END], lambda x: x IS NOT NULL) AS lim FROM r_flags)
SELECT CASE WHEN NOT tv OR NOT cdr THEN 'not_ready' WHEN len(lim) > 0 THEN 'ready_with_warnings' ELSE 'ready' END AS category,
  c AS chronological_continuity_acceptable, mp AS missingness_present, tv AS target_has_sufficient_variation,
  mm AS history_covers_multiple_months, cdr AS complete_daylight_records_present,
  CASE WHEN multi THEN 'multiple_sites' ELSE 'single_site' END AS site_scope,
  array_to_string(lim, ' | ') AS major_limitations_before_training FROM r_lim"""


@register("readiness", _readiness_sql(O.with_ctes(O.EVENTS_HOURLY).rstrip(), _HOURLY_COLS))
def q_readiness(spark, d):
    return P.readiness(fx.events_hourly(spark, d))


@register("readiness_orders", _readiness_sql(O.with_ctes(O.ORDERS_HOURLY).rstrip(),
                                             ["site_id", "timestamp", "ac_energy_kwh", "ghi_w_m2"]))
def q_readiness_orders(spark, d):
    return P.readiness(fx.orders_hourly(spark, d))

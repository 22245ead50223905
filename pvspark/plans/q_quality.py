"""Queries: continuity and quality indicators.

The oracle SQL uses the direct per-site formulations (``lag`` over a site
window, cumulative run ids, a full hourly grid ``EXCEPT`` observed hours), so
it checks the block-partitioned Spark plans independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pvspark.operators import quality as Q
from pvspark.plans import oracle as O
from pvspark.plans.registry import register, rnd_sql, rounded
from pvspark.schema import NUMERIC, OPTIONAL
from pvspark.sources import fixtures as fx

H = 3600000000
W = "WINDOW w AS (PARTITION BY site_id ORDER BY timestamp)"

GAPS = f"""
g_lag AS (SELECT site_id, timestamp, lag(timestamp) OVER w AS prev FROM hourly {W}),
gaps AS (SELECT site_id, prev AS previous_timestamp, timestamp AS next_timestamp,
   (epoch_us(timestamp) - epoch_us(prev)) / {H} AS gap_hours,
   CAST(floor((epoch_us(timestamp) - epoch_us(prev)) / {H}) - 1 AS BIGINT) AS missing_hours
   FROM g_lag WHERE epoch_us(timestamp) - epoch_us(prev) > {H})"""

MISSING = """
missing AS (SELECT site_id, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp
   FROM hourly GROUP BY site_id
   EXCEPT SELECT site_id, timestamp FROM hourly)"""

RUNS = f"""
z AS (SELECT site_id, timestamp, ac_energy_kwh, ac_energy_kwh <= 0.01 AS zero,
   lag(ac_energy_kwh) OVER w <= 0.01 AS pz, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w) AS d
   FROM hourly {W}),
zr AS (SELECT *, sum(CASE WHEN pz IS NULL OR zero <> pz OR d <> {H} THEN 1 ELSE 0 END)
   OVER (PARTITION BY site_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS run FROM z),
runs AS (SELECT site_id, timestamp, ac_energy_kwh, run_length FROM
   (SELECT *, count(*) OVER (PARTITION BY site_id, run) AS run_length FROM zr WHERE zero) WHERE run_length >= 6)"""

ABRUPT = f"""
ch AS (SELECT site_id, timestamp, ac_energy_kwh,
   CASE WHEN epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w) = {H}
        THEN abs(ac_energy_kwh - lag(ac_energy_kwh) OVER w) END AS change FROM hourly {W}),
chq AS (SELECT site_id, count(*) AS n, min(change) AS c0, max(change) AS c1,
   quantile_cont(change, 0.25) AS q1, quantile_cont(change, 0.75) AS q3
   FROM ch WHERE change IS NOT NULL GROUP BY site_id),
chf AS (SELECT site_id, q3 + 1.5 * (q3 - q1) AS upper_fence FROM chq WHERE n >= 4 AND c0 < c1),
abrupt AS (SELECT site_id, timestamp, ac_energy_kwh, change, upper_fence FROM ch JOIN chf USING (site_id)
   WHERE change > upper_fence)"""


def _numeric_long(cols):
    return f"(UNPIVOT (SELECT site_id, timestamp, {', '.join(cols)} FROM hourly) ON {', '.join(cols)} INTO NAME \"column\" VALUE value)"


def outliers_cte(cols):
    return f"""
o_long AS (SELECT * FROM {_numeric_long(cols)} WHERE value IS NOT NULL),
o_q AS (SELECT "column", count(DISTINCT value) AS nd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
   FROM o_long GROUP BY "column"),
o_f AS (SELECT "column", q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM o_q WHERE nd >= 2 AND q3 - q1 > 0),
outl AS (SELECT site_id, timestamp, "column", value, lower, upper FROM o_long JOIN o_f USING ("column")
   WHERE value < lower OR value > upper)"""


def constant_cte(cols):
    parts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS lo, max({c}) AS hi FROM hourly" for c in cols)
    return f"""
const AS (SELECT "column", lo AS value FROM ({parts}) WHERE lo IS NULL OR lo = hi)"""


EV_NUM = list(NUMERIC)
ORD_NUM = ["ac_energy_kwh", "ghi_w_m2"]


@register("gaps", rnd_sql(O.with_ctes(O.EVENTS_HOURLY, GAPS) + "SELECT * FROM gaps", ["gap_hours"]))
def q_gaps(spark, d):
    return rounded(Q.gaps(fx.events_hourly(spark, d)))


@register("gaps_orders", rnd_sql(O.with_ctes(O.ORDERS_HOURLY, GAPS) + "SELECT * FROM gaps", ["gap_hours"]))
def q_gaps_orders(spark, d):
    return rounded(Q.gaps(fx.orders_hourly(spark, d)))


@register("missing_hours", O.with_ctes(O.EVENTS_HOURLY, MISSING) + "SELECT * FROM missing")
def q_missing_hours(spark, d):
    return Q.missing_hours(fx.events_hourly(spark, d))


@register("missing_hours_orders", O.with_ctes(O.ORDERS_HOURLY, MISSING) + "SELECT * FROM missing")
def q_missing_hours_orders(spark, d):
    return Q.missing_hours(fx.orders_hourly(spark, d))


@register("near_zero_runs", O.with_ctes(O.EVENTS_HOURLY, RUNS) + "SELECT * FROM runs")
def q_near_zero_runs(spark, d):
    return Q.near_zero_runs(fx.events_hourly(spark, d))


@register("abrupt_changes", rnd_sql(O.with_ctes(O.EVENTS_HOURLY, ABRUPT) + "SELECT * FROM abrupt",
                                    ["change", "upper_fence"]))
def q_abrupt_changes(spark, d):
    return rounded(Q.abrupt_changes(fx.events_hourly(spark, d)))


@register("abrupt_changes_orders", rnd_sql(O.with_ctes(O.ORDERS_HOURLY, ABRUPT) + "SELECT * FROM abrupt",
                                           ["change", "upper_fence"]))
def q_abrupt_changes_orders(spark, d):
    return rounded(Q.abrupt_changes(fx.orders_hourly(spark, d)))


@register("iqr_outliers", rnd_sql(O.with_ctes(O.EVENTS_HOURLY, outliers_cte(EV_NUM)) + "SELECT * FROM outl",
                                  ["value", "lower", "upper"]))
def q_iqr_outliers(spark, d):
    return rounded(Q.outliers(fx.events_hourly(spark, d)).select(
        "site_id", "timestamp", "column", "value", "lower", "upper"))


@register("constant_columns", O.with_ctes(O.EVENTS_HOURLY, constant_cte(EV_NUM)) + "SELECT * FROM const")
def q_constant_columns(spark, d):
    return Q.constant_columns(fx.events_hourly(spark, d))


@register("site_date_ranges",
          O.with_ctes(O.ORDERS_HOURLY) + "SELECT site_id, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3600000000 / 24 AS coverage_days "
          "FROM hourly GROUP BY site_id HAVING (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3600000000 / 24 < 60")
def q_insufficient_orders(spark, d):
    return Q.insufficient_coverage(fx.orders_hourly(spark, d))


def _flags_sql(base_cte, num_cols, optional):
    eps_lo = ("'positive_generation_at_very_low_irradiance'", "ac_energy_kwh > 0.01 AND ghi_w_m2 < 20.0")
    eps_hi = ("'near_zero_generation_at_high_irradiance'", "ac_energy_kwh <= 0.01 AND ghi_w_m2 >= 500.0")
    parts = [
        f"SELECT site_id, timestamp, {eps_lo[0]} AS indicator, 'ac_energy_kwh' AS \"column\", ac_energy_kwh AS value FROM hourly WHERE {eps_lo[1]}",
        f"SELECT site_id, timestamp, {eps_hi[0]}, 'ac_energy_kwh', ac_energy_kwh FROM hourly WHERE {eps_hi[1]}",
        "SELECT site_id, timestamp, 'long_consecutive_near_zero_generation', 'ac_energy_kwh', ac_energy_kwh FROM runs",
        "SELECT site_id, timestamp, 'missing_hourly_timestamp', 'timestamp', NULL FROM missing",
    ]
    parts += [f"SELECT site_id, timestamp, 'missing_optional_weather_value', '{c}', NULL FROM hourly WHERE {c} IS NULL"
              for c in optional]
    parts += [
        "SELECT NULL, NULL, 'constant_value_sensor_column', \"column\", value FROM const",
        "SELECT site_id, timestamp, 'extreme_value_iqr', \"column\", value FROM outl",
        "SELECT site_id, timestamp, 'abrupt_generation_change', 'ac_energy_kwh', ac_energy_kwh FROM abrupt",
        "SELECT NULL, NULL, 'sites_have_different_date_ranges', 'timestamp', NULL FROM "
        "(SELECT site_id, min(timestamp) AS lo, max(timestamp) AS hi FROM hourly GROUP BY site_id) "
        "HAVING count(*) > 1 AND (count(DISTINCT lo) > 1 OR count(DISTINCT hi) > 1)",
        "SELECT site_id, NULL, 'insufficient_historical_coverage', 'timestamp', NULL FROM hourly GROUP BY site_id "
        "HAVING (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3600000000 / 24 < 60",
    ]
    union = " UNION ALL ".join(parts)
    return O.with_ctes(base_cte, RUNS, MISSING, constant_cte(num_cols), outliers_cte(num_cols), ABRUPT,
                       f"flags AS (SELECT CAST(site_id AS VARCHAR) AS site_id, CAST(timestamp AS TIMESTAMP) AS timestamp, "
                       f"indicator, \"column\", CAST(value AS DOUBLE) AS value FROM ({union}))")


@register("quality_flags", rnd_sql(_flags_sql(O.EVENTS_HOURLY, EV_NUM, list(OPTIONAL)) + "SELECT * FROM flags", ["value"]))
def q_quality_flags(spark, d):
    return rounded(Q.quality_flags(fx.materialized(fx.events_hourly(spark, d))).drop("detail"))


@register("quality_flags_orders", rnd_sql(_flags_sql(O.ORDERS_HOURLY, ORD_NUM, []) + "SELECT * FROM flags", ["value"]))
def q_quality_flags_orders(spark, d):
    return rounded(Q.quality_flags(fx.materialized(fx.orders_hourly(spark, d))).drop("detail"))


@register("quality_flag_counts", _flags_sql(O.EVENTS_HOURLY, EV_NUM, list(OPTIONAL))
          + "SELECT indicator, count(*) AS flag_count FROM flags GROUP BY indicator")
def q_flag_counts(spark, d):
    return Q.flag_counts(Q.quality_flags(fx.materialized(fx.events_hourly(spark, d))))

"""Queries: chart-data tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvspark.operators import chartdata as C
from pvspark.operators import metrics as M
from pvspark.plans import oracle as O
from pvspark.plans import q_metrics as QM
from pvspark.plans.registry import register, rnd_sql, rounded
from pvspark.schema import WEATHER_COLUMNS
from pvspark.sources import fixtures as fx

@register("daily_energy_pivot", rnd_sql(O.with_ctes(O.EVENTS_HOURLY) + """
SELECT d.day, s.site_id, coalesce(sum(h.ac_energy_kwh), 0) AS energy
FROM (SELECT DISTINCT date_trunc('day', timestamp) AS day FROM hourly) d
CROSS JOIN (SELECT DISTINCT site_id FROM hourly) s
LEFT JOIN hourly h ON h.site_id = s.site_id AND date_trunc('day', h.timestamp) = d.day
GROUP BY d.day, s.site_id""", ["energy"]))
def q_daily_pivot(spark, d):
    return rounded(C.daily_energy_pivot(fx.events_hourly(spark, d)))


def hist_sql(source: str, col: str, divisor: int) -> str:
    return f"""
hs AS (SELECT CAST(least(30, greatest(5, floor(count({col}) / {divisor}))) AS INTEGER) AS bins,
   CASE WHEN min({col}) = max({col}) THEN min({col}) - 0.5 ELSE min({col}) END AS lo,
   CASE WHEN min({col}) = max({col}) THEN max({col}) + 0.5 ELSE max({col}) END AS hi FROM {source}),
hx AS (SELECT x, bins, lo, hi, (hi - lo) / bins AS step,
   CAST(floor((x - lo) * (bins / (hi - lo))) AS INTEGER) AS i0 FROM (SELECT {col} AS x FROM {source} WHERE {col} IS NOT NULL), hs),
h1 AS (SELECT *, CASE WHEN i0 = bins THEN i0 - 1 ELSE i0 END AS i1 FROM hx),
h2 AS (SELECT *, CASE WHEN x < (CASE WHEN i1 = bins THEN hi ELSE CAST(i1 AS DOUBLE) * step + lo END) THEN i1 - 1 ELSE i1 END AS i2 FROM h1),
h3 AS (SELECT *, CASE WHEN x >= (CASE WHEN i2 + 1 = bins THEN hi ELSE CAST(i2 + 1 AS DOUBLE) * step + lo END) AND i2 <> bins - 1
   THEN i2 + 1 ELSE i2 END AS bin FROM h2),
hc AS (SELECT bin, count(*) AS cnt FROM h3 GROUP BY bin),
hb AS (SELECT CAST(range AS INTEGER) AS bin, bins, lo, hi, (hi - lo) / bins AS step FROM range(30), hs WHERE range < bins)
SELECT hb.bin, CASE WHEN hb.bin = bins THEN hi ELSE CAST(hb.bin AS DOUBLE) * step + lo END AS lower_edge,
   CASE WHEN hb.bin + 1 = bins THEN hi ELSE CAST(hb.bin + 1 AS DOUBLE) * step + lo END AS upper_edge,
   coalesce(cnt, 0) AS count FROM hb LEFT JOIN hc USING (bin)"""


@register("target_histogram", rnd_sql(O.with_ctes(O.EVENTS_HOURLY).rstrip() + "," + hist_sql("hourly", "ac_energy_kwh", 2),
                                      ["lower_edge", "upper_edge"]))
def q_target_hist(spark, d):
    return rounded(C.histogram(fx.events_hourly(spark, d), "ac_energy_kwh", 2))


@register("standardised_daily_weather", rnd_sql(O.with_ctes(O.EVENTS_HOURLY) + f""", dl AS (
   SELECT day, "column", v FROM (UNPIVOT (SELECT date_trunc('day', timestamp) AS day, {', '.join(f'avg({c}) AS {c}' for c in WEATHER_COLUMNS)}
   FROM hourly GROUP BY day) ON {', '.join(WEATHER_COLUMNS)} INTO NAME "column" VALUE v)),
st AS (SELECT "column", avg(v) AS m, stddev_samp(v) AS s FROM dl GROUP BY "column")
SELECT day, "column", (v - m) / CASE WHEN s = 0 THEN 1.0 ELSE s END AS standardised_mean FROM dl JOIN st USING ("column")""",
    ["standardised_mean"]))
def q_std_weather(spark, d):
    return rounded(C.daily_weather_standardised(fx.events_hourly(spark, d)))


REPORT_SQL = QM.PRED_SQL.rstrip() + """,
rep AS (SELECT timestamp, site_id, ac_energy_kwh AS actual_ac_energy_kwh, prediction, ac_energy_kwh - prediction AS residual
   FROM long WHERE model_identifier = 'rolling_mean_24h')
"""


def _report(spark, d):
    _, long = QM._cohort_long(spark, d)
    return M.prediction_frame(long.filter(F.col("model_identifier") == "rolling_mean_24h"))


@register("timestamp_totals", rnd_sql(REPORT_SQL + "SELECT timestamp, sum(actual_ac_energy_kwh) AS actual_ac_energy_kwh, "
                                      "sum(prediction) AS prediction FROM rep GROUP BY timestamp",
                                      ["actual_ac_energy_kwh", "prediction"]))
def q_ts_totals(spark, d):
    return rounded(C.timestamp_totals(_report(spark, d)))


@register("daily_prediction_totals", rnd_sql(REPORT_SQL + "SELECT CAST(timestamp AS DATE) AS date, sum(actual_ac_energy_kwh) AS "
                                             "actual_ac_energy_kwh, sum(prediction) AS prediction FROM rep GROUP BY ALL",
                                             ["actual_ac_energy_kwh", "prediction"]))
def q_daily_totals(spark, d):
    return rounded(C.daily_totals(_report(spark, d)))


@register("residual_histogram", rnd_sql(REPORT_SQL.rstrip() + "," + hist_sql("rep", "residual", 3), ["lower_edge", "upper_edge"]))
def q_residual_hist(spark, d):
    return rounded(C.histogram(_report(spark, d), "residual", 3))


@register("hourly_mean_residual", rnd_sql(REPORT_SQL + "SELECT CAST(hour(timestamp) AS INTEGER) AS hour, avg(residual) AS mean_residual "
                                          "FROM rep GROUP BY ALL", ["mean_residual"]))
def q_hourly_residual(spark, d):
    return rounded(C.hourly_residual(_report(spark, d)))

"""Queries: strict join problems (J1-J4), lookups (J7), payload decode (S5),
fetch plan (S6) and site dimension checks (V12-V14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvspark.operators import align as A
from pvspark.plans import oracle as O
from pvspark.plans.registry import register
from pvspark.schema import WEATHER_TABLE_COLUMNS
from pvspark.sources import fixtures as fx
from pvspark.sources import sites as SI
from pvspark.sources import weather as WX

H = 3600000000
WX_SQL = f"""
gen AS (SELECT timestamp, site_id, ac_energy_kwh FROM hourly),
wx_all AS (SELECT timestamp, site_id, ambient_temperature_c, relative_humidity_pct, precipitation_mm, cloud_cover_pct,
   wind_speed_m_s, ghi_w_m2, coalesce(dni_w_m2, 0) AS dni_w_m2, coalesce(dhi_w_m2, 0) AS dhi_w_m2 FROM hourly),
wx AS (SELECT * FROM wx_all WHERE (dayofyear(timestamp) * 24 + hour(timestamp)) % 53 <> 0)"""

J2 = "unmatched AS (SELECT site_id, timestamp FROM gen EXCEPT SELECT site_id, timestamp FROM wx)"
J3 = """jgrid AS (SELECT site_id, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp
   FROM gen WHERE site_id IN (SELECT site_id FROM wx) GROUP BY site_id),
jmissing AS (SELECT site_id, timestamp FROM jgrid EXCEPT SELECT site_id, timestamp FROM wx)"""

BASE = O.with_ctes(O.EVENTS_HOURLY, WX_SQL, J2, J3)


def _gen_wx(spark, d, drop=True):
    h = fx.events_hourly(spark, d)
    wx = fx.weather_part(h)
    if not drop:
        wx = h.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in ("dni_w_m2", "dhi_w_m2") else F.col(c)
                        for c in WEATHER_TABLE_COLUMNS])
    return fx.generation_part(h), wx


@register("join_unmatched_generation", BASE + "SELECT * FROM unmatched")
def q_unmatched(spark, d):
    g, w = _gen_wx(spark, d)
    return A.unmatched_generation(g, w)


@register("join_missing_weather_hours", BASE + "SELECT * FROM jmissing")
def q_missing_weather(spark, d):
    g, w = _gen_wx(spark, d)
    return A.missing_weather_hours(g, w)


def _problem_sql(kind, cte):
    return (f"SELECT '{kind}' AS problem, (SELECT count(*) FROM {cte}) AS key_count, "
            f"array_to_string(list(site_id || '@' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '+00:00' "
            f"ORDER BY site_id, timestamp), ', ') AS first_keys FROM "
            f"(SELECT * FROM {cte} ORDER BY site_id, timestamp LIMIT 10) HAVING count(*) > 0")


@register("join_problems", BASE + _problem_sql("missing_weather_hours", "jmissing") + " UNION ALL "
          + _problem_sql("unmatched_generation", "unmatched"))
def q_join_problems(spark, d):
    g, w = _gen_wx(spark, d)
    return A.join_problems(g, w)


@register("generation_weather_join", BASE + "SELECT g.timestamp, g.site_id, g.ac_energy_kwh, w.ghi_w_m2, "
          "w.ambient_temperature_c, w.cloud_cover_pct, w.relative_humidity_pct, w.wind_speed_m_s, w.dni_w_m2, "
          "w.dhi_w_m2, w.precipitation_mm FROM gen g JOIN wx_all w USING (site_id, timestamp)")
def q_generation_weather_join(spark, d):
    # The derived tables have gaps, so the strict form raises (see join_problems);
    # the join itself is the same plan.
    g, w = _gen_wx(spark, d, drop=False)
    return A.join_generation_weather(g, w, strict=False)


@register("site_attributes", O.with_ctes(O.EVENTS_HOURLY, O.SITES)
          + "SELECT h.site_id, h.timestamp, s.installed_capacity_kwp, s.timezone, s.latitude, s.longitude "
          "FROM hourly h LEFT JOIN sites s USING (site_id)")
def q_site_attributes(spark, d):
    h = fx.events_hourly(spark, d)
    return A.with_site_attributes(h.select("site_id", "timestamp"), fx.sites_for(h),
                                  ["installed_capacity_kwp", "timezone", "latitude", "longitude"])


# ------------------------------------------------------------------ payloads
def _payloads(spark, d, corrupt: bool):
    h = fx.events_hourly(spark, d)
    p = fx.weather_payloads(fx.weather_part(h))
    if corrupt:
        # Sites with number % 3 == 1 lose the last temperature of every payload.
        i = fx.site_number(F.col("site_id"))
        hourly = F.col("payload.hourly")
        t = hourly.getField("temperature_2m")
        p = p.withColumn("payload", F.when(i % 3 == 1, F.struct(hourly.withField(
            "temperature_2m", F.slice(t, 1, F.size(t) - 1)).alias("hourly"))).otherwise(F.col("payload")))
    return p


@register("weather_payload_decode", O.with_ctes(O.EVENTS_HOURLY, WX_SQL) + "SELECT * FROM wx")
def q_payload_decode(spark, d):
    return WX.decode_payloads(_payloads(spark, d, corrupt=False))


@register("weather_payload_errors", O.with_ctes(O.EVENTS_HOURLY, WX_SQL)
          + "SELECT site_id, strftime(timestamp, '%Y-%m') AS month, 'hourly arrays have mismatched lengths' AS error "
          "FROM wx WHERE CAST(regexp_extract(site_id, '(\\d+)$', 1) AS BIGINT) % 3 = 1 GROUP BY ALL")
def q_payload_errors(spark, d):
    p = WX.payload_errors(_payloads(spark, d, corrupt=True))
    return p.filter(F.col("error").isNotNull()).select("site_id", "month", "error")


@register("weather_payload_decode_valid_only", O.with_ctes(O.EVENTS_HOURLY, WX_SQL)
          + "SELECT * FROM wx WHERE CAST(regexp_extract(site_id, '(\\d+)$', 1) AS BIGINT) % 3 <> 1")
def q_payload_decode_valid(spark, d):
    return WX.decode_payloads(_payloads(spark, d, corrupt=True))


# ------------------------------------------------------------------ fetch plan
def _requests(spark, d):
    h = fx.orders_hourly(spark, d)
    whole = h.groupBy("site_id").agg(F.to_date(F.min("timestamp")).alias("start_date"),
                                     F.to_date(F.max("timestamp")).alias("end_date"))
    yearly = h.groupBy("site_id", F.year("timestamp").alias("y")).agg(
        F.to_date(F.min("timestamp")).alias("start_date"), F.to_date(F.max("timestamp")).alias("end_date")).drop("y")
    reversed_ = whole.select("site_id", F.col("end_date").alias("start_date"), F.col("start_date").alias("end_date"))
    return whole.unionByName(yearly).unionByName(reversed_)


FETCH_SQL = O.with_ctes(O.ORDERS_HOURLY, """
whole AS (SELECT site_id, CAST(min(timestamp) AS DATE) AS start_date, CAST(max(timestamp) AS DATE) AS end_date FROM hourly GROUP BY site_id),
yearly AS (SELECT site_id, CAST(min(timestamp) AS DATE) AS start_date, CAST(max(timestamp) AS DATE) AS end_date
   FROM hourly GROUP BY site_id, year(timestamp)),
req AS (SELECT * FROM whole UNION ALL SELECT * FROM yearly UNION ALL SELECT site_id, end_date, start_date FROM whole),
chk AS (SELECT *, CASE WHEN end_date < start_date THEN 'end-date must be on or after start-date'
   WHEN end_date - start_date + 1 > 366 THEN 'Date range is limited to 366 days per command invocation' END AS error FROM req)""") + """
SELECT site_id, start_date, end_date, CAST(i - 1 AS INTEGER) AS chunk_index, CAST(s AS DATE) AS chunk_start,
   least(CAST(s AS DATE) + 30, end_date) AS chunk_end, CAST(NULL AS VARCHAR) AS error
FROM (SELECT site_id, start_date, end_date, unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 31 DAY)) AS s,
      generate_subscripts(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 31 DAY), 1) AS i
      FROM chk WHERE error IS NULL)
"""


@register("weather_fetch_plan", FETCH_SQL)
def q_fetch_plan(spark, d):
    return WX.fetch_plan(_requests(spark, d)).filter(F.col("error").isNull())


@register("weather_fetch_rejections", FETCH_SQL.split("SELECT site_id, start_date, end_date, CAST(i - 1")[0]
          + "SELECT site_id, start_date, end_date, error FROM chk WHERE error IS NOT NULL")
def q_fetch_rejections(spark, d):
    return WX.fetch_plan(_requests(spark, d)).filter(F.col("error").isNotNull()).select(
        "site_id", "start_date", "end_date", "error")


# ------------------------------------------------------------------ sites
def _dirty_sites(h):
    s = fx.sites_for(h)
    i = fx.site_number(F.col("site_id"))
    return s.select(
        "site_id",
        F.when(i % 5 == 1, F.lit(95.0)).otherwise(F.col("latitude")).alias("latitude"),
        "longitude",
        F.when(i % 7 == 2, F.lit("Mars/Olympus")).otherwise(F.col("timezone")).alias("timezone"),
        F.when(i % 11 == 3, F.lit(0.0)).otherwise(F.col("installed_capacity_kwp")).alias("installed_capacity_kwp"),
        "panel_tilt_degrees", "panel_azimuth_degrees")


@register("site_dimension_issues", O.with_ctes(O.ORDERS_HOURLY, O.SITES) + """
SELECT site_id, field, problem FROM (
  SELECT site_id, 'latitude' AS field, 'must be between -90 and 90' AS problem FROM sites
     WHERE CAST(regexp_extract(site_id, '(\\d+)$', 1) AS BIGINT) % 5 = 1
  UNION ALL SELECT site_id, 'installed_capacity_kwp', 'must be greater than 0' FROM sites
     WHERE CAST(regexp_extract(site_id, '(\\d+)$', 1) AS BIGINT) % 11 = 3
  UNION ALL SELECT site_id, 'timezone', 'must be a valid IANA timezone' FROM sites
     WHERE CAST(regexp_extract(site_id, '(\\d+)$', 1) AS BIGINT) % 7 = 2)""")
def q_site_issues(spark, d):
    return SI.site_issues(_dirty_sites(fx.orders_hourly(spark, d)))


@register("dataset_site_match", O.with_ctes(O.EVENTS_HOURLY) + """
SELECT 'site-0' AS site_id, 'missing_site_configuration' AS problem
UNION ALL SELECT DISTINCT 'plant-' || CAST(o_custkey % (SELECT CAST(greatest(2, floor(count(*) / 3000)) AS BIGINT) FROM orders) AS VARCHAR),
   'unused_site_configuration' FROM orders""")
def q_dataset_site_match(spark, d):
    ev = fx.events_hourly(spark, d)
    reg = fx.sites_for(ev).filter(F.col("site_id") != "site-0").unionByName(fx.sites_for(fx.orders_hourly(spark, d)))
    return SI.dataset_site_match(ev, reg)


@register("site_registry_issues", O.with_ctes(O.EVENTS_HOURLY, O.SITES)
          + "SELECT site_id, 'duplicate site configuration' AS problem FROM sites "
          "WHERE CAST(regexp_extract(site_id, '(\\d+)$', 1) AS BIGINT) % 2 = 0")
def q_registry_issues(spark, d):
    s = fx.sites_for(fx.events_hourly(spark, d))
    return SI.registry_issues(s.unionByName(s.filter(fx.site_number(F.col("site_id")) % 2 == 0)))

"""Canonical hourly solar tables derived from the driver's parquet tables.

The driver tables hold no solar data, so each fixture is a deterministic
grouping of a given table; its size grows with the table it reads.  All
quantities are built from integer cents before one final division so that
Spark and DuckDB produce identical doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.schema import HOUR_US, WEATHER_TABLE_COLUMNS
from pvspark.session import ensure_utc, table_path

# Site timezones picked by site number modulo 4.
FIXTURE_TIMEZONES = ("UTC", "Africa/Dar_es_Salaam", "America/New_York", "Asia/Kolkata")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def _utc(col: str) -> Column:
    """Driver timestamps are timestamp_ntz; interpret them as UTC instants."""
    return F.col(col).cast("timestamp")


def hourly_from_events(events: DataFrame) -> DataFrame:
    """F-EVENTS: canonical hourly table with all optional columns."""
    k_sites = events.select(
        F.greatest(F.lit(2), F.floor(F.count("*") / 2500)).cast("bigint")
    ).scalar()
    et = F.col("event_type")
    c = F.round(F.col("value") * 100).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("bigint")
    src = events.select(
        F.concat(F.lit("site-"), (F.col("user_id") % k_sites).cast("string")).alias("site_id"),
        F.date_trunc("hour", _utc("ts")).alias("timestamp"),
        et.alias("et"), c.alias("c"), k.alias("k"),
    )
    kk, cc, et = F.col("k"), F.col("c"), F.col("et")
    return src.groupBy("site_id", "timestamp").agg(
        (F.sum(F.when(et == "purchase", cc).otherwise(0)).cast("double") / 100).alias("ac_energy_kwh"),
        (F.min(kk).cast("double") * 10).alias("ghi_w_m2"),
        ((F.sum(kk) % 400).cast("double") / 10 - 5).alias("ambient_temperature_c"),
        F.max(kk).cast("double").alias("cloud_cover_pct"),
        (F.sum(cc) % 101).cast("double").alias("relative_humidity_pct"),
        ((F.max(cc) % 200).cast("double") / 10).alias("wind_speed_m_s"),
        (F.max(F.when(et == "error", kk)).cast("double") * 8).alias("dni_w_m2"),
        (F.min(F.when(et == "click", kk)).cast("double") * 3).alias("dhi_w_m2"),
        (F.max(F.when(et == "signup", kk)).cast("double") / 2).alias("module_temperature_c"),
        (F.count_if(et == "view").cast("double") / 2).alias("precipitation_mm"),
        (100 - F.count("*") % 5).cast("double").alias("inverter_availability_pct"),
    )


def hourly_from_orders(orders: DataFrame) -> DataFrame:
    """F-ORDERS: sparse generation/GHI table spanning many months."""
    k_sites = orders.select(
        F.greatest(F.lit(2), F.floor(F.count("*") / 3000)).cast("bigint")
    ).scalar()
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    src = orders.select(
        F.concat(F.lit("plant-"), (F.col("o_custkey") % k_sites).cast("string")).alias("site_id"),
        (_utc("o_orderdate")
         + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0),
                           (F.col("o_orderkey") % 24).cast("int"), F.lit(0), F.lit(0))
         ).alias("timestamp"),
        cents.alias("cents"),
    )
    return src.groupBy("site_id", "timestamp").agg(
        (F.sum(F.col("cents") % 5000).cast("double") / 100).alias("ac_energy_kwh"),
        F.max(F.col("cents") % 1000).cast("double").alias("ghi_w_m2"),
    )


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_from_events(read_table(spark, sf_dir, "events"))


def orders_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_from_orders(read_table(spark, sf_dir, "orders"))


def materialized(df: DataFrame) -> DataFrame:
    """The derived table written once to the shared checkpoint folder, for
    jobs that read it many times (each branch then scans the written table)."""
    from pvspark.session import cut_lineage
    return cut_lineage(df)


def site_number(site_id: Column) -> Column:
    return F.regexp_extract(site_id, r"(\d+)$", 1).cast("bigint")


def sites_for(hourly: DataFrame) -> DataFrame:
    """F-SITES: one site-dimension row per distinct site of a canonical table."""
    i = site_number(F.col("site_id"))
    tz = F.element_at(F.array(*[F.lit(z) for z in FIXTURE_TIMEZONES]), (i % 4 + 1).cast("int"))
    return hourly.select("site_id").distinct().select(
        "site_id",
        ((i * 37) % 181 - 90).cast("double").alias("latitude"),
        ((i * 53) % 361 - 180).cast("double").alias("longitude"),
        tz.alias("timezone"),
        (10 + i).cast("double").alias("installed_capacity_kwp"),
        (5 + i % 40).cast("double").alias("panel_tilt_degrees"),
        (i % 360).cast("double").alias("panel_azimuth_degrees"),
    )


def with_source_row(hourly: DataFrame) -> DataFrame:
    """CSV line order (timestamp, site) as a dense-per-hour row index.

    ``source_row = hour_index * k_sites + site_number``: monotone in CSV order
    and computed row-locally (no global sort through one task).
    """
    stats = hourly.select(F.min(F.unix_micros("timestamp")).alias("m"),
                          F.max(site_number(F.col("site_id"))).alias("s"))
    min_us = stats.select("m").scalar()
    width = stats.select(F.col("s") + 1).scalar()
    hour_index = F.floor((F.unix_micros("timestamp") - min_us) / HOUR_US)
    return hourly.withColumn("source_row", hour_index * width + site_number(F.col("site_id")))


def raw_strings(hourly: DataFrame) -> DataFrame:
    """F-RAW: canonical table as CSV-like strings plus ``source_row``."""
    rows = with_source_row(hourly)
    cols = [F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.col("site_id")]
    cols += [F.col(c).cast("string").alias(c) for c in rows.columns
             if c not in ("timestamp", "site_id", "source_row")]
    return rows.select(*cols, "source_row")


def dirty_strings(hourly: DataFrame) -> DataFrame:
    """F-DIRTY: F-RAW with defects chosen by ``source_row % 97``."""
    raw = raw_strings(hourly)
    d = F.col("source_row") % 97
    naive = F.regexp_replace("timestamp", "Z$", "")
    dirty = raw.select(
        F.when(d == 3, naive).when(d == 11, F.lit("not-a-time")).otherwise(F.col("timestamp")).alias("timestamp"),
        F.when(d == 17, F.lit("  ")).otherwise(F.col("site_id")).alias("site_id"),
        F.when(d == 23, F.lit("-1.5")).otherwise(F.col("ac_energy_kwh")).alias("ac_energy_kwh"),
        F.when(d == 41, F.lit("abc")).otherwise(F.col("ghi_w_m2")).alias("ghi_w_m2"),
        F.when(d == 29, F.lit("inf")).otherwise(F.col("ambient_temperature_c")).alias("ambient_temperature_c"),
        F.when(d == 31, F.lit("101")).otherwise(F.col("cloud_cover_pct")).alias("cloud_cover_pct"),
        *[F.col(c) for c in raw.columns if c not in (
            "timestamp", "site_id", "ac_energy_kwh", "ghi_w_m2", "ambient_temperature_c",
            "cloud_cover_pct", "source_row")],
        "source_row",
    )
    max_row = raw.select(F.max("source_row") + 1).scalar()
    # Same instant written with a +03:00 offset: a duplicate key after UTC conversion.
    shifted = F.to_timestamp(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ssX") + F.expr("INTERVAL 3 HOURS")
    dup = raw.filter(d == 53).select(
        F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00")).alias("timestamp"),
        *[F.col(c) for c in raw.columns if c not in ("timestamp", "source_row")],
        (F.col("source_row") + max_row).alias("source_row"),
    )
    return dirty.unionByName(dup)


def generation_part(hourly: DataFrame) -> DataFrame:
    """F-GEN: measured generation projection."""
    return hourly.select("timestamp", "site_id", "ac_energy_kwh")


def weather_part(hourly: DataFrame) -> DataFrame:
    """F-WX: weather projection; null irradiance set to 0, some hours dropped."""
    keep = (F.dayofyear("timestamp") * 24 + F.hour("timestamp")) % 53 != 0
    cols = []
    for c in WEATHER_TABLE_COLUMNS:
        if c in ("dni_w_m2", "dhi_w_m2"):
            cols.append(F.coalesce(F.col(c), F.lit(0.0)).alias(c))
        else:
            cols.append(F.col(c))
    return hourly.filter(keep).select(*cols)


# Payload field names of the hourly weather archive, in order,
# and the canonical column each maps to.
PAYLOAD_FIELDS = (
    ("temperature_2m", "ambient_temperature_c"),
    ("relative_humidity_2m", "relative_humidity_pct"),
    ("precipitation", "precipitation_mm"),
    ("cloud_cover", "cloud_cover_pct"),
    ("wind_speed_10m", "wind_speed_m_s"),
    ("shortwave_radiation", "ghi_w_m2"),
    ("direct_normal_irradiance", "dni_w_m2"),
    ("diffuse_radiation", "dhi_w_m2"),
)


def _field_getter(name: str):
    return lambda e: e[name]


def weather_payloads(weather: DataFrame) -> DataFrame:
    """F-PAYLOAD: one archive-style payload per (site, month), times naive UTC.

    A group holds at most one month of hours of one site, so the collected
    arrays are bounded by the calendar, not by the data volume.
    """
    month = F.date_format("timestamp", "yyyy-MM")
    entry = F.struct(F.col("timestamp").alias("t"), *[F.col(c).alias(p) for p, c in PAYLOAD_FIELDS])
    grouped = weather.groupBy(F.col("site_id"), month.alias("month")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries"))
    hourly = F.struct(
        F.transform("entries", lambda e: F.date_format(e["t"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        *[F.transform("entries", _field_getter(p)).alias(p) for p, _ in PAYLOAD_FIELDS],
    )
    return grouped.select("site_id", "month", F.struct(hourly.alias("hourly")).alias("payload"))

"""Queries: validation issues on raw and dirty string tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvspark.operators import rules as R
from pvspark.plans import oracle as O
from pvspark.plans.registry import register
from pvspark.schema import FIELD_BY_NAME, GENERATION_COLUMNS, NUMERIC, REQUIRED, WEATHER_TABLE_COLUMNS
from pvspark.sources import fixtures as fx

SITE_NO = "CAST(regexp_extract(site_id, '(\\d+)$', 1) AS BIGINT)"
VALUE_COLS = list(NUMERIC)

RAW = f"""
raw_base AS (SELECT *, CAST(floor((epoch_us(timestamp) - (SELECT min(epoch_us(timestamp)) FROM hourly)) / 3600000000) AS BIGINT)
     * (SELECT max({SITE_NO}) + 1 FROM hourly) + {SITE_NO} AS source_row FROM hourly),
raw AS (SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, site_id,
     {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in VALUE_COLS)}, source_row FROM raw_base),
dirty AS (
  SELECT CASE WHEN source_row % 97 = 3 THEN regexp_replace(timestamp, 'Z$', '')
              WHEN source_row % 97 = 11 THEN 'not-a-time' ELSE timestamp END AS timestamp,
         CASE WHEN source_row % 97 = 17 THEN '  ' ELSE site_id END AS site_id,
         CASE WHEN source_row % 97 = 23 THEN '-1.5' ELSE ac_energy_kwh END AS ac_energy_kwh,
         CASE WHEN source_row % 97 = 41 THEN 'abc' ELSE ghi_w_m2 END AS ghi_w_m2,
         CASE WHEN source_row % 97 = 29 THEN 'inf' ELSE ambient_temperature_c END AS ambient_temperature_c,
         CASE WHEN source_row % 97 = 31 THEN '101' ELSE cloud_cover_pct END AS cloud_cover_pct,
         {', '.join(c for c in VALUE_COLS if c not in ('ac_energy_kwh', 'ghi_w_m2', 'ambient_temperature_c', 'cloud_cover_pct'))},
         source_row FROM raw
  UNION ALL
  SELECT strftime(r.timestamp + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S') || '+03:00', r.site_id,
         {', '.join(f'CAST(r.{c} AS VARCHAR)' for c in ('ac_energy_kwh', 'ghi_w_m2', 'ambient_temperature_c', 'cloud_cover_pct'))},
         {', '.join(f'CAST(r.{c} AS VARCHAR)' for c in VALUE_COLS if c not in ('ac_energy_kwh', 'ghi_w_m2', 'ambient_temperature_c', 'cloud_cover_pct'))},
         r.source_row + (SELECT max(source_row) + 1 FROM raw_base)
  FROM raw_base r WHERE r.source_row % 97 = 53)"""

ZONE = R.ZONE_PATTERN


def _norm(s):
    s = f"regexp_replace(trim({s}), '\\s*UTC$', 'Z')"
    s = f"regexp_replace({s}, 'z$', 'Z')"
    return f"regexp_replace({s}, '([T ]\\d{{2}}:\\d{{2}})([Z+-][^:]*(:\\d{{2}})?)$', '\\1:00\\2')"


def parse_sql(s):
    zone = f"coalesce(regexp_matches(trim({s}), '{ZONE}'), false)"
    return (f"CASE WHEN {zone} THEN timezone('UTC', TRY_CAST({_norm(s)} AS TIMESTAMPTZ)) "
            f"ELSE TRY_CAST({_norm(s)} AS TIMESTAMP) END"), zone


def _num(c):
    return f"TRY_CAST(trim({c}) AS DOUBLE)"


def _finite(x):
    return f"({x} IS NOT NULL AND isfinite({x}))"


def _rules_sql(kind, columns):
    """(ordinal, code, column, message, predicate) for a rule set, as SQL."""
    ts, zone = parse_sql("timestamp")
    out = []
    if kind == "hourly":
        out.append(("invalid_site_id", "site_id", "site_id IS NULL OR trim(site_id) = ''"))
        out.append(("invalid_timestamp", "timestamp", f"({ts}) IS NULL OR NOT {zone}"))
        for c in [c for c in NUMERIC if c in columns]:
            f = FIELD_BY_NAME[c]
            n = _num(c)
            miss = f"{c} IS NULL" if c in REQUIRED else "false"
            out.append(("invalid_numeric_value", c,
                        f"({miss}) OR ({c} IS NOT NULL AND {n} IS NULL) OR ({n} IS NOT NULL AND NOT isfinite({n}))"))
            if f.minimum is not None or f.maximum is not None:
                conds = []
                if f.minimum is not None:
                    conds.append(f"coalesce({n} < {f.minimum}, false)")
                if f.maximum is not None:
                    conds.append(f"coalesce({n} > {f.maximum}, false)")
                out.append(("value_out_of_range", c, " OR ".join(conds), R.range_message(f.minimum, f.maximum)))
        dup = "duplicate_observation"
    elif kind == "generation":
        n = _num("ac_energy_kwh")
        out.append(("invalid_generation_site_id", "site_id", "site_id IS NULL OR trim(site_id) = ''"))
        out.append(("invalid_generation_timestamp", "timestamp", f"({ts}) IS NULL OR NOT {zone}"))
        out.append(("invalid_generation_energy", "ac_energy_kwh",
                    f"ac_energy_kwh IS NULL OR NOT {_finite(n)} OR coalesce({n} < 0, false)"))
        dup = "duplicate_generation_record"
    else:
        out.append(("invalid_weather_site_id", "site_id", "site_id IS NULL OR trim(site_id) = ''"))
        out.append(("invalid_weather_timestamp", "timestamp", f"({ts}) IS NULL"))
        for c in WEATHER_TABLE_COLUMNS[2:]:
            n = _num(c)
            cond = f"{c} IS NULL OR NOT {_finite(n)}"
            lo, hi = R.WEATHER_RANGES.get(c, (None, None))
            if lo is not None:
                cond += f" OR coalesce({n} < {lo}, false)"
            if hi is not None:
                cond += f" OR coalesce({n} > {hi}, false)"
            out.append(("invalid_weather_value", c, cond))
        dup = "duplicate_weather_record"
    rows = []
    for i, r in enumerate(out):
        code, col, pred = r[0], r[1], r[2]
        msg = r[3] if len(r) > 3 else R.MSG[code]
        rows.append((i, code, col, msg, pred))
    return rows, dup, ts


def issues_sql(kind, source, columns):
    rules, dup, ts = _rules_sql(kind, columns)
    selects = [f"SELECT source_row + 2 AS line, {i} AS ordinal, '{code}' AS code, '{col}' AS \"column\", "
               f"'{msg}' AS message FROM src WHERE {pred}" for i, code, col, msg, pred in rules]
    selects.append(f"SELECT source_row + 2, {len(rules)}, '{dup}', NULL, '{R.MSG[dup]}' FROM src "
                   f"WHERE site_id IS NOT NULL AND _ts IS NOT NULL AND (site_id, _ts) IN "
                   f"(SELECT (site_id, _ts) FROM src WHERE site_id IS NOT NULL AND _ts IS NOT NULL GROUP BY site_id, _ts HAVING count(*) > 1)")
    return f"""
src AS (SELECT *, {ts} AS _ts FROM {source}),
flagged AS ({' UNION ALL '.join(selects)}),
issues AS (SELECT CAST(ordinal AS INTEGER) AS ordinal, code, "column", message, count(*) AS n,
   array_to_string(list_sort(list(line ORDER BY line)[1:10]), ', ') AS rows
   FROM flagged GROUP BY ALL)"""


BASE = O.with_ctes(O.EVENTS_HOURLY, RAW)


def _dirty(spark, d):
    # The dirty table is read by every rule branch: materialise it once.
    return fx.materialized(fx.dirty_strings(fx.materialized(fx.events_hourly(spark, d))))


@register("hourly_validation_issues", BASE.rstrip() + "," + issues_sql("hourly", "dirty", VALUE_COLS) + "\nSELECT * FROM issues")
def q_hourly_issues(spark, d):
    df = _dirty(spark, d)
    return R.issues(df, R.hourly_rules(df.columns))


@register("hourly_validation_clean", BASE.rstrip() + "," + issues_sql("hourly", "raw", VALUE_COLS) + "\nSELECT * FROM issues")
def q_hourly_clean(spark, d):
    df = fx.raw_strings(fx.events_hourly(spark, d))
    return R.issues(df, R.hourly_rules(df.columns))


@register("generation_validation_issues",
          BASE.rstrip() + ", gen AS (SELECT timestamp, site_id, ac_energy_kwh, source_row FROM dirty),"
          + issues_sql("generation", "gen", ["ac_energy_kwh"]) + "\nSELECT * FROM issues")
def q_generation_issues(spark, d):
    df = _dirty(spark, d).select(*GENERATION_COLUMNS, "source_row")
    return R.issues(df, R.generation_rules(df.columns))


@register("weather_validation_issues",
          BASE.rstrip() + f", wx AS (SELECT {', '.join(WEATHER_TABLE_COLUMNS)}, source_row FROM dirty),"
          + issues_sql("weather", "wx", []) + "\nSELECT * FROM issues")
def q_weather_issues(spark, d):
    df = _dirty(spark, d).select(*WEATHER_TABLE_COLUMNS, "source_row")
    return R.issues(df, R.weather_rules(df.columns))


@register("validated_hourly_rows",
          O.with_ctes(O.EVENTS_HOURLY) + "SELECT count(*) AS row_count, count(DISTINCT site_id) AS site_count, "
          "min(timestamp) AS earliest_timestamp, max(timestamp) AS latest_timestamp FROM hourly")
def q_validated_hourly(spark, d):
    """S1/S3-style ingest: raw strings -> validate (raises on issues) -> typed table."""
    raw = fx.raw_strings(fx.events_hourly(spark, d))
    typed = R.validate_hourly(raw)
    return typed.agg(F.count("*").alias("row_count"), F.countDistinct("site_id").alias("site_count"),
                     F.min("timestamp").alias("earliest_timestamp"), F.max("timestamp").alias("latest_timestamp"))

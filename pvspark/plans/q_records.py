"""Queries: nested manifest and quality records (A15, A18, S10), counts of a split plan (S8, V19), site files (S7),
the order of training rows (V16), and the texts of data-dependent quality flags (A14, Q6-Q8)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.operators import features as FE
from pvspark.operators import prepare as PR
from pvspark.operators import quality as Q
from pvspark.operators import splits as SP
from pvspark.operators.align import label_periods
from pvspark.plans import oracle as O
from pvspark.plans import q_features as QF
from pvspark.plans import q_quality as QQ
from pvspark.plans.registry import register, rnd_sql, rounded
from pvspark.session import checkpoint_dir, table_path
from pvspark.sources import fixtures as fx
from pvspark.sources import io
from pvspark.sources import sites as SI

PREDICTORS = QF.PREDICTORS


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), "pvspark-records", f"{name}-{uuid.uuid4().hex[:12]}")


def _long(record: DataFrame, maps: list[str]) -> DataFrame:
    """The record's maps as rows: section, name, value."""
    sections = [F.struct(F.lit(m).alias("section"), F.map_entries(m).alias("entries")) for m in maps]
    return record.select(F.explode(F.array(*sections)).alias("s")).select("s.section", F.inline("s.entries").alias("name", "value"))


def _counts_sql(section: str, key: str, where: str = "true") -> str:
    return (f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS name, count(*) AS value FROM feat "
            f"WHERE {key} IS NOT NULL AND {where} GROUP BY 2")


def _per_predictor(section: str, value: str, names: list[str]) -> str:
    # One pass: the counts side by side, then turned into rows.
    wide = ", ".join(f"{value.format(c=c)} AS {c}" for c in names)
    return f"SELECT '{section}' AS section, name, value FROM (UNPIVOT (SELECT {wide} FROM feat) ON * INTO NAME name VALUE value)"


_ELIGIBLE = "CASE WHEN feature_eligible THEN 'True' ELSE 'False' END"
_LAGS = [c for c in PREDICTORS if "_lag_" in c]
_ROLLING = [c for c in PREDICTORS if "_rolling_" in c]


@register("manifest_record", QF._FJ + " UNION ALL ".join([
    _per_predictor("missing_value_counts", "count(*) FILTER (WHERE feature_eligible AND {c} IS NULL)", PREDICTORS),
    _counts_sql("eligibility_counts", _ELIGIBLE), _counts_sql("split_counts", "split"),
    "SELECT 'rows', 'source', count(*) FROM feat", "SELECT 'rows', 'output', count(*) FILTER (WHERE feature_eligible) FROM feat",
    "SELECT 'rows', 'excluded', count(*) FILTER (WHERE NOT feature_eligible) FROM feat",
    "SELECT DISTINCT 'site', site_id, CAST(1 AS BIGINT) FROM feat",
    "SELECT 'predictor', unnest([" + ", ".join(f"'{c}'" for c in PREDICTORS) + "]), unnest(range(1, " + str(len(PREDICTORS) + 1) + "))"]))
def q_manifest_record(spark, d):
    """The manifest of the eligible rows, written as JSON and read again; V15 holds the rows against it."""
    res = QF._spark_features(spark, d, only_eligible=True)
    path = _scratch(spark, "manifest")
    io.write_manifest(FE.manifest_record(res, QF.CFG, only_eligible=True), path)
    manifest = io.load_manifest(spark, path)
    wrong = PR.contract_issues(res.features, PREDICTORS, manifest=manifest, row_count=res.features.count())
    if wrong:
        raise ValueError("; ".join(wrong))
    rows = [(s, k, int(v)) for s in ("missing_value_counts", "eligibility_counts", "split_counts") for k, v in manifest[s].items()]
    rows += [("rows", k, manifest[f"{k}_row_count"]) for k in ("source", "output", "excluded")]
    rows += [("site", s, 1) for s in manifest["site_ids"]]
    rows += [("predictor", c, i) for i, c in enumerate(manifest["predictor_columns"], 1)]
    return spark.createDataFrame(rows, "section string, name string, value long")  # a manifest's size


@register("quality_record", QF._FJ + " UNION ALL ".join([
    _per_predictor("missing_values_by_feature", "count(*) FILTER (WHERE {c} IS NULL)", PREDICTORS),
    _per_predictor("infinite_value_counts", "count(*) FILTER (WHERE abs(CAST({c} AS DOUBLE)) = CAST('inf' AS DOUBLE))", PREDICTORS),
    _per_predictor("exact_time_lag_availability", "count({c})", _LAGS),
    _per_predictor("rolling_window_availability", "count({c})", _ROLLING),
    _counts_sql("eligibility_counts", _ELIGIBLE), _counts_sql("counts_by_split", "split"), _counts_sql("counts_by_site", "site_id"),
    "SELECT 'eligibility_reasons', reason, count(*) FROM (SELECT unnest(string_split(feature_missing_reasons, ';')) AS reason FROM feat) "
    "WHERE reason <> '' GROUP BY reason"]))
def q_quality_record(spark, d):
    record = FE.quality_record(QF._spark_features(spark, d))
    return _long(record, ["missing_values_by_feature", "infinite_value_counts", "exact_time_lag_availability",
                          "rolling_window_availability", "eligibility_counts", "counts_by_split", "counts_by_site",
                          "eligibility_reasons"])


# ------------------------------------------------------------------ V16
@register("training_order_issues_planted", O.with_ctes(O.EVENTS_HOURLY) + """,
base AS (SELECT site_id, timestamp, CAST(regexp_extract(site_id, '(\\d+)$', 1) AS BIGINT) AS no,
   CAST(floor((epoch_us(timestamp) - (SELECT min(epoch_us(timestamp)) FROM hourly)) / 3600000000) AS BIGINT) AS hour FROM hourly),
placed AS (SELECT site_id, timestamp, hour * (SELECT max(no) + 1 FROM base) + no AS source_row FROM base),
moved AS (SELECT site_id, source_row, timestamp + to_hours(CASE WHEN source_row % 97 = 5 THEN 30 ELSE 0 END) AS timestamp FROM placed)
SELECT * FROM (SELECT site_id, source_row, timestamp, lag(timestamp) OVER (PARTITION BY site_id ORDER BY source_row) AS previous_timestamp
   FROM moved) WHERE timestamp < previous_timestamp""")
def q_order_planted(spark, d):
    """Each row whose number leaves 5 over 97 is stamped 30 hours late, so rows behind it go back in time."""
    rows = fx.with_source_row(fx.materialized(fx.events_hourly(spark, d))).select("site_id", "timestamp", "source_row")
    late = F.when(F.col("source_row") % 97 == 5, F.expr("timestamp + INTERVAL 30 HOURS")).otherwise(F.col("timestamp"))
    return PR.order_violations(rows.withColumn("timestamp", late))


# ------------------------------------------------------------------ S8 / V19
_PLAN_SQL = O.with_ctes(O.ORDERS_HOURLY, QF.SPLIT_SQL) + f""",
lab AS (SELECT site_id, {QF._label()} AS period FROM hourly),
cnt AS (SELECT period, site_id, count(*) AS n FROM lab GROUP BY ALL),
low AS (SELECT period, min(site_id) AS lowest FROM cnt GROUP BY period)
SELECT 'split_plan_dataset_mismatch' AS code, 'training counts_by_site does not match the input dataset.' AS message, site_id,
   n + 1 AS planned_count, n AS actual_count FROM cnt JOIN low USING (period) WHERE period = 'training' AND site_id = lowest
UNION ALL SELECT 'split_plan_dataset_mismatch', 'validation counts_by_site does not match the input dataset.', site_id, NULL, n
   FROM cnt JOIN low USING (period) WHERE period = 'validation' AND site_id = lowest
UNION ALL SELECT 'split_plan_dataset_mismatch', 'testing counts_by_site does not match the input dataset.', 'plant-none', 3, NULL
UNION ALL SELECT 'split_plan_dataset_mismatch', 'testing record_count does not match the input dataset.', NULL, count(*) + 2, count(*)
   FROM lab WHERE period = 'testing'"""


@register("split_plan_site_counts", _PLAN_SQL)
def q_plan_counts(spark, d):
    """A plan written as JSON with a wrong count, a site left out, a site too many and a wrong record_count."""
    h = fx.materialized(fx.orders_hourly(spark, d))
    labelled = SP.label_chronological(h, SP.plan_chronological_splits(h))
    counts = SP.split_site_counts(labelled).withColumnRenamed("split", "period")
    bounds = SP.split_summary(labelled).withColumnRenamed("split", "period")
    lowest = counts.groupBy("period").agg(F.min("site_id").alias("lowest"))
    first = F.col("site_id") == F.col("lowest")
    planted = counts.join(lowest, "period").where(~((F.col("period") == "validation") & first)).select(
        "period", "site_id", (F.col("record_count") + F.when((F.col("period") == "training") & first, 1).otherwise(0)).alias("n"))
    planted = planted.unionByName(bounds.where("period = 'testing'").select("period", F.lit("plant-none").alias("site_id"),
                                                                          F.lit(3).cast("long").alias("n")))
    maps = planted.groupBy("period").agg(F.map_from_entries(F.collect_list(F.struct("site_id", "n"))).alias("counts_by_site"))

    def iso(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c)
    period = F.struct(iso("beginning_timestamp"), iso("ending_timestamp"),
                      (F.col("record_count") + F.when(F.col("period") == "testing", 2).otherwise(0)).alias("record_count"), "counts_by_site")
    text = bounds.join(maps, "period").agg(F.to_json(F.struct(
        F.map_from_entries(F.collect_list(F.struct("period", period))).alias("periods"))).alias("value"))
    path = _scratch(spark, "plan")
    text.coalesce(1).write.text(path)
    named = label_periods(h, [(n, s, e) for n, s, e, _ in io.load_split_plan(spark, path)])
    return SP.plan_count_issues(named, io.read_split_plan(spark, path))


# ------------------------------------------------------------------ S7
_SITES_SQL = """WITH s AS (SELECT s_suppkey AS i, s_suppkey % 10 AS kind FROM supplier)
"""
SITES_A_TASK = 50  # files that one task writes, about


def _site_files(spark, d) -> str:
    """Every supplier as a site file; of ten kinds, eight are planted faults."""
    i = F.col("s_suppkey").cast("long")
    kind = i % 10
    fields = {"latitude": ((i * 37) % 181 - 90).cast("double"), "longitude": ((i * 53) % 361 - 180).cast("double"),
              "installed_capacity_kwp": F.when(kind == 4, -1.0).otherwise((10 + i).cast("double")),
              "panel_tilt_degrees": (5 + i % 40).cast("double"), "panel_azimuth_degrees": (i % 360).cast("double")}
    texts = [F.concat(F.lit(f'"{c}": '), F.when(F.lit(c == "latitude") & (kind == 3), '"north"').otherwise(v.cast("string")))
             for c, v in fields.items()]
    texts += [F.concat(F.lit('"site_id": '), F.when(kind == 7, i.cast("string")).otherwise(F.concat(F.lit('" site-'), i.cast("string"), F.lit('"')))),
              F.when(kind != 2, F.concat(F.lit('"timezone": "'), F.when(kind == 6, "Mars/Olympus").otherwise("Asia/Kolkata"), F.lit('"'))),
              F.when(kind == 1, '"colour": "blue"')]
    body = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*texts)), ", "), F.lit("}"))
    text = F.when(kind == 0, F.substring(body, 1, 40)).when(kind == 5, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    path = _scratch(spark, "sites")
    suppliers = spark.read.parquet(table_path(d, "supplier"))
    # The cost is that of creating files, not of their few bytes, by which adaptive execution would merge all into one task.
    tasks = max(1, -(-suppliers.count() // SITES_A_TASK))
    suppliers.select(i.alias("site"), text.alias("value")).repartition(tasks, "site").write.partitionBy("site").text(path)
    return path


@register("site_file_issues", _SITES_SQL + """SELECT 'site=' || i AS file, CASE kind WHEN 0 THEN 'file' WHEN 1 THEN 'colour' WHEN 2 THEN 'timezone'
   WHEN 3 THEN 'latitude' WHEN 4 THEN 'installed_capacity_kwp' WHEN 5 THEN 'file' WHEN 6 THEN 'timezone' ELSE 'site_id' END AS field,
   CASE kind WHEN 0 THEN 'could not read site configuration' WHEN 1 THEN 'extra inputs are not permitted' WHEN 2 THEN 'field required'
   WHEN 3 THEN 'must be a finite number' WHEN 4 THEN 'must be greater than 0' WHEN 5 THEN 'must be a JSON object'
   WHEN 6 THEN 'must be a valid IANA timezone' ELSE 'must be a non-empty string' END AS problem FROM s WHERE kind < 8""")
def q_site_file_issues(spark, d):
    found = SI.site_file_issues(SI.parse_site_files(spark, _site_files(spark, d)))
    return found.withColumn("file", F.regexp_extract("file", "(site=[^/]+)", 1))


@register("site_files_valid", _SITES_SQL + """SELECT 'site-' || i AS site_id, CAST((i * 37) % 181 - 90 AS DOUBLE) AS latitude,
   CAST((i * 53) % 361 - 180 AS DOUBLE) AS longitude, 'Asia/Kolkata' AS timezone, CAST(10 + i AS DOUBLE) AS installed_capacity_kwp,
   CAST(5 + i % 40 AS DOUBLE) AS panel_tilt_degrees, CAST(i % 360 AS DOUBLE) AS panel_azimuth_degrees FROM s WHERE kind >= 8""")
def q_site_files_valid(spark, d):
    return SI.valid_sites(SI.parse_site_files(spark, _site_files(spark, d)))


# ------------------------------------------------------------------ A14, Q6-Q8
_PLANTED = O.EVENTS_HOURLY.replace("\nhourly AS (", "\nplain AS (") + """,
hourly AS (SELECT * REPLACE (CAST(3.5 AS DOUBLE) AS wind_speed_m_s, CAST(NULL AS DOUBLE) AS dni_w_m2) FROM plain)"""


def _planted_hourly(spark, d):
    h = fx.events_hourly(spark, d)
    return fx.materialized(h.withColumn("wind_speed_m_s", F.lit(3.5)).withColumn("dni_w_m2", F.lit(None).cast("double")))


@register("constant_columns_planted", O.with_ctes(_PLANTED, QQ.constant_cte(QQ.EV_NUM)) + "SELECT * FROM const")
def q_constant_planted(spark, d):
    return Q.constant_columns(_planted_hourly(spark, d))


@register("quality_flag_details", rnd_sql(O.with_ctes(_PLANTED, QQ.constant_cte(QQ.EV_NUM), QQ.outliers_cte(QQ.EV_NUM), QQ.ABRUPT) + """
SELECT CAST(NULL AS VARCHAR) AS site_id, CAST(NULL AS TIMESTAMP) AS timestamp, 'constant_value_sensor_column' AS indicator, "column", value,
   'All available values are identical.' AS detail FROM const
UNION ALL SELECT site_id, timestamp, 'extreme_value_iqr', "column", value,
   printf('Outside Tukey fences [%g, %g] using 1.5 × IQR.', lower, upper) FROM outl
UNION ALL SELECT site_id, timestamp, 'abrupt_generation_change', 'ac_energy_kwh', ac_energy_kwh,
   printf('Absolute adjacent-hour change exceeds the Tukey upper fence %g kWh.', upper_fence) FROM abrupt""", ["value"]))
def q_flag_details(spark, d):
    flags = Q.quality_flags(_planted_hourly(spark, d))
    return rounded(flags.where(F.col("indicator").isin("constant_value_sensor_column", "extreme_value_iqr", "abrupt_generation_change")))

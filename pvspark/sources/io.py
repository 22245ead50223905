"""Table sources and sinks.

CSV input is read with every column as a string (no inference); values are
typed by the validation rules.  ``source_row`` (0-based CSV data line) is a
dense rank over (file, position) computed with a distributed sort, so the
first-ten-rows messages can name CSV lines.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvspark.operators import rules as R


class CSVIngestionError(ValueError):
    pass


def read_hourly_csv(spark: SparkSession, path: str, with_source_row: bool = True) -> DataFrame:
    """Header CSV, all columns as strings; missing, zero-byte or
    header-only input is an error (checked by reading at most one row)."""
    try:
        df = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    except Exception as exc:  # missing path
        raise CSVIngestionError(f"Could not read CSV {path}: {exc}") from exc
    if not df.columns or df.isEmpty():
        raise CSVIngestionError(f"CSV has no data rows: {path}")
    if not with_source_row:
        return df
    from pvspark.operators.models import global_rank
    staged = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_pos", F.monotonically_increasing_id())
    return global_rank(staged, ["_file", "_pos"], "source_row").drop("_file", "_pos")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                order_by: list[str] | None = None) -> None:
    """Overwrite a table (parents created by the writer; CSV with header).

    T1: ``order_by`` sorts at the sink only (a range-partitioned distributed
    sort; part files are in key order)."""
    if order_by:
        df = df.orderBy(*order_by)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_canonical(df: DataFrame, path: str) -> None:
    """Canonical hourly table: parquet partitioned by UTC month and clustered
    by (site, time) inside each file, so period filters prune directories and
    site/time predicates skip row groups."""
    out = df.withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    # (month, site) groups hold at most one site-month of hours: no hot task.
    (out.repartition("month", "site_id").sortWithinPartitions("site_id", "timestamp")
        .write.mode("overwrite").partitionBy("month").parquet(path))


def ingest_hourly_csv(spark: SparkSession, source: str, destination: str, fmt: str = "parquet") -> DataFrame:
    """S3: read -> validate (raises with every issue) -> write; nothing is
    written when validation fails.  Parquet output uses :func:`write_canonical`."""
    typed = R.validate_hourly(read_hourly_csv(spark, source))
    if fmt == "parquet":
        write_canonical(typed, destination)
    else:
        write_table(typed, destination, fmt)
    return typed


def read_generation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Generation CSV -> validated (V10) generation table."""
    return R.validate_generation(read_hourly_csv(spark, path))


def read_weather_csv(spark: SparkSession, path: str) -> DataFrame:
    return R.validate_weather(read_hourly_csv(spark, path))


SPLIT_PLAN_NAMES = {"training": "train", "validation": "validation", "testing": "test"}


def _plan_error(message: str) -> R.DataValidationError:
    return R.DataValidationError([{"code": "invalid_split_plan", "message": message, "column": None, "rows": None}])


def read_split_plan(spark: SparkSession, path: str) -> DataFrame:
    """A split-plan JSON as one row per period of the plan.

    ``period`` and ``split`` are its names in plan and feature table; ``start`` and ``end`` texts; ``record_count`` and
    ``counts_by_site`` (a map) are null where absent or of another type, which ``has_record_count`` and
    ``has_counts_by_site`` tell apart.  A file that is no plan has no row.
    """
    doc = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("plan"))

    def at(period: str, field: str, kind: str) -> Column:
        return F.try_variant_get("plan", f"$.periods.{period}.{field}", kind)

    def given(period: str, field: str, *kinds: str) -> Column:
        shape = F.schema_of_variant(at(period, field, "variant"))
        return F.when(shape != "VOID", shape.rlike("^(" + "|".join(kinds) + ")")) if kinds else shape != "VOID"

    periods = [F.when(F.schema_of_variant(F.try_variant_get("plan", f"$.periods.{p}", "variant")).startswith("OBJECT"), F.struct(
        F.lit(p).alias("period"), F.lit(name).alias("split"),
        at(p, "beginning_timestamp", "string").alias("start"), at(p, "ending_timestamp", "string").alias("end"),
        F.when(given(p, "record_count", "BIGINT"), at(p, "record_count", "bigint")).alias("record_count"),
        F.coalesce(given(p, "record_count"), F.lit(False)).alias("has_record_count"),
        F.when(given(p, "counts_by_site", "OBJECT"), at(p, "counts_by_site", "map<string, bigint>")).alias("counts_by_site"),
        F.coalesce(given(p, "counts_by_site"), F.lit(False)).alias("has_counts_by_site")))
        for p, name in SPLIT_PLAN_NAMES.items()]
    return doc.select(F.explode(F.array_compact(F.array(*periods))).alias("p")).select("p.*")


def load_split_plan(spark: SparkSession, path: str) -> list[tuple[str, object, object, int | None]]:
    """Split-plan JSON -> [(feature split name, start, end, record_count)].

    The plan holds three periods, which are collected; counts by site stay in :func:`read_split_plan`.
    Boundaries must carry a zone (V19)."""
    rows = read_split_plan(spark, path).select(
        "period", "split", R.parse_utc(F.col("start")).alias("start"), R.parse_utc(F.col("end")).alias("end"), "record_count",
        (R.has_zone(F.col("start")) & R.has_zone(F.col("end"))).alias("zoned")).collect()
    found = {r["period"]: r for r in rows}
    if not found:
        raise _plan_error("Split plan must contain a periods object.")
    for period in SPLIT_PLAN_NAMES:
        if period not in found:
            raise _plan_error(f"Missing {period} period.")
    if not all(r["zoned"] for r in rows):
        raise _plan_error("Split boundaries must be timezone-aware.")
    return [(found[p]["split"], found[p]["start"], found[p]["end"], found[p]["record_count"]) for p in SPLIT_PLAN_NAMES]


def load_feature_dataset(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Feature table; missingness is kept as NULL.

    Nothing is inferred: CSV columns are matched by header name and cast to ``schema``, and a value
    that does not fit its type is an error; without a schema they stay strings."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw if schema is None else raw.select(*[F.col(_quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_manifest(record: DataFrame, path: str) -> None:
    """A one-row nested record as a JSON object in one file."""
    json_safe(record).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_manifest(spark: SparkSession, path: str) -> dict:
    """Feature manifest (one JSON object) as a dict; no schema is inferred, so maps stay maps.

    The manifest is one object of the size of the column list and the number of sites."""
    texts = spark.read.option("wholetext", True).text(path).limit(2).collect()
    try:
        found = [json.loads(r["value"]) for r in texts if r["value"].strip()]
    except ValueError as broken:
        raise ValueError(f"invalid feature manifest {path}: {broken}") from broken
    if len(found) != 1 or not isinstance(found[0], dict):
        raise ValueError(f"a feature manifest is one JSON object: {path}")
    return found[0]


def json_safe(df: DataFrame) -> DataFrame:
    """NaN / +-inf -> NULL, timestamps as ISO-8601 UTC strings."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_json_report(df: DataFrame, path: str) -> None:
    """JSON-lines report sink."""
    json_safe(df).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One output per split (``split=<name>`` directories)."""
    if "split" not in df.columns:
        raise ValueError("writing splits requires a split plan (no split column)")
    write_table(df, path, fmt, ["split"])


def write_fold_predictions(df: DataFrame, path: str) -> None:
    """Per-candidate, per-fold predictions."""
    write_table(df, path, "parquet", ["candidate_id", "fold_number"])


def to_json_text(value) -> str:
    return json.dumps(value, sort_keys=True, default=str)

"""Site dimension: source (S7), rules (V12), registry checks."""

from __future__ import annotations

import zoneinfo

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvspark.functions import is_finite
from pvspark.schema import SITE_FIELDS

SITE_SCHEMA = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("timezone", T.StringType()),
    T.StructField("installed_capacity_kwp", T.DoubleType()),
    T.StructField("panel_tilt_degrees", T.DoubleType()),
    T.StructField("panel_azimuth_degrees", T.DoubleType()),
])

# Numeric bounds of the site contract (inclusive unless noted).
SITE_BOUNDS = {
    "latitude": (-90.0, 90.0),
    "longitude": (-180.0, 180.0),
    "panel_tilt_degrees": (0.0, 90.0),
}


# Texts of the site contract.
UNREADABLE = "could not read site configuration"
NOT_OBJECT = "must be a JSON object"
REQUIRED_FIELD = "field required"
EXTRA_FIELD = "extra inputs are not permitted"


class SiteConfigurationError(ValueError):
    pass


def _value_checks(values: dict[str, Column]) -> list[tuple[str, str, Column]]:
    """(field, problem, condition) for the contract's fields among ``values``."""
    checks = []
    for c, v in values.items():
        if c == "site_id":
            checks.append((c, "must be a non-empty string", v.isNull() | (v == "")))
        elif c == "timezone":
            checks.append((c, "must be a valid IANA timezone",
                           v.isNull() | ~v.isin(sorted(zoneinfo.available_timezones()))))
        else:
            checks.append((c, "must be a finite number", ~is_finite(v)))
            if c in SITE_BOUNDS:
                lo, hi = SITE_BOUNDS[c]
                checks.append((c, f"must be between {lo:g} and {hi:g}", is_finite(v) & ((v < lo) | (v > hi))))
            if c == "installed_capacity_kwp":
                checks.append((c, "must be greater than 0", is_finite(v) & (v <= 0)))
    return checks


def _problem(field: str, text: str, broken: Column) -> Column:
    return F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(text).alias("problem")))


def parse_site_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` as one row: ``file``, ``issues`` (field, problem) and the ``site`` it describes.

    Nothing is inferred: a file is read as one text and parsed as strict JSON, its keys are held against the
    contract, and each value is cast by itself, so an unknown key or a malformed file is a row with issues and never
    a column or a failed job.  Numbers may come as text, a site id may not come as a number.  Spark's file sources
    leave files of no bytes out: their sites are missing from the dimension, which V14 reports.
    """
    files = (spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))
    doc = F.when(F.is_valid_utf8("text"), F.try_parse_json("text"))
    files = files.withColumn("doc", doc).withColumn(
        "keys", F.when(F.schema_of_variant("doc").startswith("OBJECT"), F.json_object_keys("text")))
    keys = F.col("keys")

    def value(c: str) -> Column:
        wanted = "double" if SITE_SCHEMA[c].dataType == T.DoubleType() else "string"
        got = F.try_variant_get("doc", f"$.{c}", wanted)
        if wanted == "string":
            text = F.schema_of_variant(F.try_variant_get("doc", f"$.{c}", "variant")) == "STRING"
            got = F.when(text, F.trim(got))
        return got

    values = {c: value(c) for c in SITE_FIELDS}
    checks = [_problem(c, text, F.array_contains("keys", c) & broken) for c, text, broken in _value_checks(values)]
    checks += [_problem(c, REQUIRED_FIELD, ~F.array_contains("keys", c)) for c in SITE_FIELDS]
    extra = F.transform(F.array_except(keys, F.array(*[F.lit(c) for c in SITE_FIELDS])),
                        lambda k: F.struct(k.alias("field"), F.lit(EXTRA_FIELD).alias("problem")))
    whole = F.array_compact(F.array(_problem("file", UNREADABLE, F.col("doc").isNull()),
                                    _problem("file", NOT_OBJECT, F.col("doc").isNotNull() & keys.isNull())))
    issues = F.when(keys.isNull(), whole).otherwise(F.concat(F.array_compact(F.array(*checks)), extra))
    return files.select("file", issues.alias("issues"), F.struct(*[v.alias(c) for c, v in values.items()]).alias("site"))


def site_file_issues(parsed: DataFrame) -> DataFrame:
    """One row per (file, field, problem) of :func:`parse_site_files`."""
    return parsed.select("file", F.explode("issues").alias("i")).select("file", "i.field", "i.problem")


def valid_sites(parsed: DataFrame) -> DataFrame:
    """The site dimension: typed rows of the files without issues."""
    return parsed.where(F.size("issues") == 0).select("site.*")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """The site dimension of a folder of JSON files; any issue is an error that names the first ten."""
    try:
        parsed = parse_site_files(spark, path)
    except AnalysisException as missing:
        raise SiteConfigurationError(f"Site configuration does not exist: {path}") from missing
    found = site_file_issues(parsed).orderBy("file", "field", "problem").limit(10).collect()
    if found:
        raise SiteConfigurationError("Invalid site configuration: " + "; ".join(
            f"{r['file']}: {r['field']} {r['problem']}" for r in found))
    return valid_sites(parsed)


def site_issues(sites: DataFrame) -> DataFrame:
    """One row per (site_id, field, problem)."""
    sid = F.trim(F.col("site_id").cast("string")) if "site_id" in sites.columns else F.lit(None).cast("string")
    values = {c: sid if c == "site_id" else F.col(c) if c == "timezone" else F.col(c).cast("double")
              for c in SITE_FIELDS if c in sites.columns}
    checks = [_problem(c, REQUIRED_FIELD, F.lit(True)) for c in SITE_FIELDS if c not in sites.columns]
    checks += [_problem(c, text, broken) for c, text, broken in _value_checks(values)]
    checks += [_problem(c, EXTRA_FIELD, F.col(c).isNotNull())
               for c in sites.columns if c not in SITE_FIELDS and not c.startswith("_")]
    return sites.select(sid.alias("site_id"), F.explode(F.array_compact(F.array(*checks))).alias("i")).select(
        "site_id", "i.field", "i.problem")


def registry_issues(sites: DataFrame) -> DataFrame:
    """Duplicate site ids, and an empty registry."""
    sid = F.trim(F.col("site_id"))
    dups = sites.groupBy(sid.alias("site_id")).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(
        "site_id", F.lit("duplicate site configuration").alias("problem"))
    empty = sites.agg(F.count("*").alias("n")).filter(F.col("n") == 0).select(
        F.lit(None).cast("string").alias("site_id"), F.lit("at least one site configuration is required").alias("problem"))
    return dups.unionByName(empty)


def dataset_site_match(dataset: DataFrame, sites: DataFrame, allow_unused: bool = False) -> DataFrame:
    """Dataset sites missing from the registry (always fail) and registry
    sites unused by the dataset (fail unless allowed); two anti joins on ids."""
    ds = dataset.select("site_id").distinct()
    rs = sites.select(F.trim(F.col("site_id")).alias("site_id")).distinct()
    missing = ds.join(rs, "site_id", "left_anti").select("site_id", F.lit("missing_site_configuration").alias("problem"))
    if allow_unused:
        return missing
    unused = rs.join(ds, "site_id", "left_anti").select("site_id", F.lit("unused_site_configuration").alias("problem"))
    return missing.unionByName(unused)

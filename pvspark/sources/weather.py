"""Weather archive payloads (S5) and the request plan.

The HTTP client is not part of the library; payloads landed as JSON files are
read with ``spark.read.json`` (explicit schema) and decoded here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvspark.sources.fixtures import PAYLOAD_FIELDS

MAX_REQUEST_DAYS = 366
CHUNK_DAYS = 31
REQUIRED_FIELDS = ("time",) + tuple(p for p, _ in PAYLOAD_FIELDS)

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("hourly", T.StructType(
        [T.StructField("time", T.ArrayType(T.StringType()))]
        + [T.StructField(p, T.ArrayType(T.DoubleType())) for p, _ in PAYLOAD_FIELDS]))
])


def read_payloads(spark, path: str) -> DataFrame:
    """Landed payload files (one JSON object per file) -> rows with the input file name."""
    df = spark.read.schema(PAYLOAD_SCHEMA).option("multiLine", True).json(path)
    return df.select(F.col("_metadata.file_name").alias("source_file"), F.struct("hourly").alias("payload"))


def payload_errors(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Per payload: the first failing check in the documented order, else none.

    Order: hourly object missing; a field missing or not an array; array
    lengths differ (checked before zipping, which would pad with NULL); empty.
    """
    h = F.col(f"{payload}.hourly")
    arrays = [h.getField(f) for f in REQUIRED_FIELDS]
    missing = F.array_compact(F.array(*[F.when(a.isNull(), F.lit(f)) for f, a in zip(REQUIRED_FIELDS, arrays)]))
    sizes = F.array(*[F.size(a) for a in arrays])
    err = (F.when(h.isNull(), F.lit("response is missing the hourly object"))
           .when(F.size(missing) > 0, F.concat(F.lit("response is missing hourly fields: "), F.array_join(missing, ", ")))
           .when(F.array_max(sizes) != F.array_min(sizes), F.lit("hourly arrays have mismatched lengths"))
           .when(F.array_max(sizes) == 0, F.lit("returned no hourly weather records")))
    return df.withColumn("error", err)


def decode_payloads(df: DataFrame, site_col: str = "site_id", payload: str = "payload") -> DataFrame:
    """Valid payloads -> canonical weather rows (naive times taken as UTC).

    Rows are produced with ``inline(arrays_zip(...))`` inside each task; a
    payload is one site-chunk (at most 31 days of hours).
    """
    checked = payload_errors(df, payload).filter(F.col("error").isNull())
    h = F.col(f"{payload}.hourly")
    zipped = F.arrays_zip(*[h.getField(f).alias(f) for f in REQUIRED_FIELDS])
    rows = checked.select(F.col(site_col).alias("site_id"), F.inline(zipped))
    return rows.select(
        F.col("time").try_cast("timestamp").alias("timestamp"), "site_id",
        *[F.col(p).cast("double").alias(c) for p, c in PAYLOAD_FIELDS])


def fetch_plan(requests: DataFrame) -> DataFrame:
    """Validate (site, start_date, end_date) requests and cut 31-day chunks.

    Invalid requests keep one row with ``error`` set and no chunk.
    """
    days = F.datediff("end_date", "start_date") + 1
    err = (F.when(F.col("end_date") < F.col("start_date"), F.lit("end-date must be on or after start-date"))
           .when(days > MAX_REQUEST_DAYS,
                 F.lit(f"Date range is limited to {MAX_REQUEST_DAYS} days per command invocation")))
    r = requests.withColumn("error", err)
    ok = r.filter(F.col("error").isNull()).select(
        "site_id", "start_date", "end_date",
        F.posexplode(F.sequence("start_date", "end_date", F.expr(f"INTERVAL {CHUNK_DAYS} DAYS"))).alias("chunk_index", "chunk_start"))
    ok = ok.withColumn("chunk_end", F.least(F.date_add("chunk_start", CHUNK_DAYS - 1), F.col("end_date")))
    bad = r.filter(F.col("error").isNotNull()).select(
        "site_id", "start_date", "end_date", F.lit(None).cast("int").alias("chunk_index"),
        F.lit(None).cast("date").alias("chunk_start"), F.lit(None).cast("date").alias("chunk_end"))
    return ok.withColumn("error", F.lit(None).cast("string")).unionByName(bad.withColumn("error", err))

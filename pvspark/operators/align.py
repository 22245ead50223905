"""Strict generation-weather join and lookups.

Join problems are computed as DataFrames (anti joins, gap scans); ``strict``
entry points raise when a problem table is non-empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.operators import sequence as S
from pvspark.schema import CANONICAL, HOUR_US

JOIN_KEYS = ["site_id", "timestamp"]
MAX_DESCRIBED_KEYS = 10


class DatasetJoinError(ValueError):
    pass


def unmatched_generation(gen: DataFrame, wx: DataFrame) -> DataFrame:
    """Generation keys without a weather row."""
    return gen.select(*JOIN_KEYS).join(wx.select(*JOIN_KEYS), JOIN_KEYS, "left_anti")


def missing_weather_hours(gen: DataFrame, wx: DataFrame, block_hours: int = S.DEFAULT_BLOCK_HOURS) -> DataFrame:
    """Hourly grid points in [min, max] of each site's generation with no
    weather row; sites without any weather are skipped (J2 reports them).

    Weather times inside the range plus one grid sentinel on each side are
    scanned in time order; the missing grid points are exactly those strictly
    between consecutive points, so no full hourly grid is materialised.
    """
    rng = gen.groupBy("site_id").agg(F.min(F.unix_micros("timestamp")).alias("_a"),
                                     F.max(F.unix_micros("timestamp")).alias("_z"))
    rng = rng.join(wx.select("site_id").distinct(), "site_id", "left_semi")
    inside = (wx.select("site_id", F.unix_micros("timestamp").alias("_t")).join(rng, "site_id")
                .filter((F.col("_t") >= F.col("_a")) & (F.col("_t") <= F.col("_z")))
                .select("site_id", "_t", "_a"))
    sentinels = rng.select("site_id", F.explode(F.array(F.col("_a") - HOUR_US, F.col("_z") + HOUR_US)).alias("_t"), "_a")
    pts = inside.unionByName(sentinels).select("site_id", F.timestamp_micros("_t").alias("timestamp"), "_a")
    p = S.with_previous(pts, [], block_hours).filter(F.col(S.US) - F.col("prev_us") > HOUR_US)
    k0 = F.floor((F.col("prev_us") - F.col("_a")) / HOUR_US) + 1
    k1 = F.ceil((F.col(S.US) - F.col("_a")) / HOUR_US) - 1
    ex = p.filter(k0 <= k1).select("site_id", "_a", F.explode(F.sequence(k0, k1)).alias("_k"))
    return ex.select("site_id", F.timestamp_micros(F.col("_a") + F.col("_k") * HOUR_US).alias("timestamp"))


def join_problems(gen: DataFrame, wx: DataFrame) -> DataFrame:
    """Both problem kinds with counts and the first ten keys.

    Per kind, the key count (one global aggregate row) and the first ten keys
    (a top-k) are unioned and folded by one small aggregate: no join.
    """
    iso = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    out = None
    for kind, keys in (("missing_weather_hours", missing_weather_hours(gen, wx)),
                       ("unmatched_generation", unmatched_generation(gen, wx))):
        n = keys.agg(F.count("*").alias("n")).select(
            "n", F.lit(None).cast("string").alias("site_id"), F.lit(None).cast("timestamp").alias("timestamp"),
            F.lit(None).cast("string").alias("k"))
        first = keys.orderBy(*JOIN_KEYS).limit(MAX_DESCRIBED_KEYS).select(
            F.lit(None).cast("bigint").alias("n"), "site_id", "timestamp",
            F.concat(F.col("site_id"), F.lit("@"), iso).alias("k"))
        part = n.unionByName(first).agg(
            F.max("n").alias("key_count"),
            F.array_join(F.transform(F.sort_array(F.collect_list(
                F.when(F.col("k").isNotNull(), F.struct("site_id", "timestamp", "k")))), lambda x: x["k"]), ", ")
            .alias("first_keys")).filter(F.col("key_count") > 0).select(F.lit(kind).alias("problem"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def join_generation_weather(gen: DataFrame, wx: DataFrame, strict: bool = True) -> DataFrame:
    """Strict one-to-one inner join in canonical column order.

    Inputs are validated tables (unique keys).  With ``strict`` the problem
    table is evaluated first (a small action) and any problem raises.
    """
    if strict:
        problems = join_problems(gen, wx).collect()  # at most two rows
        if problems:
            msgs = []
            for p in sorted(problems, key=lambda r: r["problem"]):
                label = ("Missing weather hours within the generation range: " if p["problem"] == "missing_weather_hours"
                         else "Generation timestamps cannot be matched to weather: ")
                msgs.append(label + p["first_keys"])
            raise DatasetJoinError("\n".join(msgs))
    joined = gen.join(wx, JOIN_KEYS, "inner")
    return joined.select(*[c for c in CANONICAL if c in joined.columns])


def with_site_attributes(df: DataFrame, sites: DataFrame, fields: list[str]) -> DataFrame:
    """Site attribute lookup (left join on site_id).

    The join is planned normally; AQE turns it into a broadcast join where the
    site table's measured bytes are below Spark's threshold.
    """
    return df.join(sites.select("site_id", *fields), "site_id", "left")


def label_periods(df: DataFrame, periods: list[tuple[str, object, object]], col: str = "split") -> DataFrame:
    """Label rows by inclusive [start, end] periods (three collected rows)."""
    expr = None
    for name, start, end in periods:
        cond = (F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("timestamp") <= F.lit(end).cast("timestamp"))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return df.withColumn(col, expr)

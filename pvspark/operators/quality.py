"""Continuity and row-level quality indicators.

Indicators never change, fill or drop observations; they produce a long flag
table ``(site_id, timestamp, indicator, column, value, detail)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvspark.functions import hours_between
from pvspark.functions.quantiles import exact_percentiles
from pvspark.operators import sequence as S
from pvspark.operators.config import AnalysisThresholds
from pvspark.operators.metrics import g_format
from pvspark.schema import HOUR_US, NUMERIC, OPTIONAL, TARGET

FLAG_SCHEMA = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("indicator", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("detail", T.StringType()),
])


def _g(x: float) -> str:
    return f"{x:g}"


def _flags(df: DataFrame, indicator: str, column: str | None, value: Column | None, detail: Column | str,
           site: Column | None = None, ts: Column | None = None) -> DataFrame:
    return df.select(
        (site if site is not None else F.col("site_id")).cast("string").alias("site_id"),
        (ts if ts is not None else F.col("timestamp")).cast("timestamp").alias("timestamp"),
        F.lit(indicator).alias("indicator"),
        F.lit(column).cast("string").alias("column"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"),
    )


# ------------------------------------------------------------------ W3
def gaps(df: DataFrame, block_hours: int = S.DEFAULT_BLOCK_HOURS) -> DataFrame:
    """Consecutive observations of a site more than one hour apart."""
    p = S.with_previous(df.select("site_id", "timestamp"), [], block_hours)
    p = p.filter(F.col(S.US) - F.col("prev_us") > HOUR_US)
    gap = (F.col(S.US) - F.col("prev_us")) / F.lit(float(HOUR_US))
    return p.select(
        "site_id", F.timestamp_micros("prev_us").alias("previous_timestamp"),
        F.col("timestamp").alias("next_timestamp"), gap.alias("gap_hours"),
        (F.floor(gap) - 1).cast("bigint").alias("missing_hours"))


# ------------------------------------------------------------------ W4
def previous_rows(df: DataFrame, block_hours: int = S.DEFAULT_BLOCK_HOURS, target: str = TARGET) -> DataFrame:
    """One block-partitioned previous-row scan shared by W3-W6."""
    return S.with_previous(df.select("site_id", "timestamp", target), [target], block_hours)


def missing_hours(df: DataFrame, block_hours: int = S.DEFAULT_BLOCK_HOURS, prev: DataFrame | None = None) -> DataFrame:
    """Hourly grid points (anchored at each site's first timestamp) that
    have no observation.  Generated only inside gaps: a grid point is missing
    exactly when it lies strictly between two consecutive observations."""
    p = prev if prev is not None else S.with_previous(df.select("site_id", "timestamp"), [], block_hours)
    anchor = df.groupBy("site_id").agg(F.min(F.unix_micros("timestamp")).alias("_a"))
    g = p.filter(F.col(S.US) - F.col("prev_us") > HOUR_US).join(anchor, "site_id")
    k0 = F.floor((F.col("prev_us") - F.col("_a")) / HOUR_US) + 1
    k1 = F.ceil((F.col(S.US) - F.col("_a")) / HOUR_US) - 1
    ex = g.filter(k0 <= k1).select("site_id", "_a", F.explode(F.sequence(k0, k1)).alias("_k"))
    return ex.select("site_id", F.timestamp_micros(F.col("_a") + F.col("_k") * HOUR_US).alias("timestamp"))


# ------------------------------------------------------------------ W5
def near_zero_runs(df: DataFrame, th: AnalysisThresholds = AnalysisThresholds(),
                   block_hours: int = S.DEFAULT_BLOCK_HOURS, target: str = TARGET,
                   prev: DataFrame | None = None) -> DataFrame:
    """Rows in runs of >= N adjacent (1 h apart) near-zero observations."""
    zero = F.col(target) <= th.near_zero_generation_kwh
    p = prev if prev is not None else previous_rows(df, block_hours, target)
    prev_zero = F.col(f"prev_{target}") <= th.near_zero_generation_kwh
    adjacent = (F.col(S.US) - F.col("prev_us")) == HOUR_US
    starts = zero & ~F.coalesce(prev_zero & adjacent, F.lit(False))
    r = S.run_start(p, starts).filter(zero)
    sizes = r.groupBy("site_id", "run_start_us").agg(F.count("*").alias("run_length"))
    long_runs = sizes.filter(F.col("run_length") >= th.consecutive_zero_hours)
    return r.join(long_runs, ["site_id", "run_start_us"], "inner").select("site_id", "timestamp", target, "run_length")


# ------------------------------------------------------------------ W6
def abrupt_changes(df: DataFrame, th: AnalysisThresholds = AnalysisThresholds(),
                   block_hours: int = S.DEFAULT_BLOCK_HOURS, target: str = TARGET,
                   prev: DataFrame | None = None) -> DataFrame:
    """|change| between 1-hour-adjacent rows above the site's Tukey upper fence.

    Fences need >= 4 changes and >= 2 distinct changes per site (IQR may be 0).
    """
    p = prev if prev is not None else previous_rows(df, block_hours, target)
    change = F.when((F.col(S.US) - F.col("prev_us")) == HOUR_US, F.abs(F.col(target) - F.col(f"prev_{target}")))
    c = p.select("site_id", "timestamp", target, change.alias("change"))
    ok = c.filter(F.col("change").isNotNull())
    q = ok.groupBy("site_id").agg(F.count("*").alias("n"), F.min("change").alias("c0"), F.max("change").alias("c1"))
    quart = exact_percentiles(ok, ["site_id"], "change", [0.25, 0.75], ["q1", "q3"])  # hot sites split
    fences = q.filter((F.col("n") >= 4) & (F.col("c0") < F.col("c1"))).join(quart, "site_id").select(
        "site_id", (F.col("q3") + th.outlier_iqr_multiplier * (F.col("q3") - F.col("q1"))).alias("upper_fence"))
    return c.join(fences, "site_id").filter(F.col("change") > F.col("upper_fence"))


# ------------------------------------------------------------------ A14 / Q6
def constant_columns(df: DataFrame) -> DataFrame:
    """Numeric columns with <= 1 distinct non-null value (all-null counts)."""
    present = [c for c in NUMERIC if c in df.columns]
    agg = df.agg(*[F.struct(F.lit(c).alias("column"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                   for c in present])
    long = agg.select(F.explode(F.array(*[F.col(c) for c in present])).alias("s")).select("s.*")
    return long.filter(F.col("lo").isNull() | (F.col("lo") == F.col("hi"))).select(
        "column", F.col("lo").alias("value"))


# ------------------------------------------------------------------ Q7
def iqr_fences(df: DataFrame, th: AnalysisThresholds = AnalysisThresholds()) -> DataFrame:
    """Global Tukey fences per numeric column (all sites together).

    Quartiles use the two-pass exact selection (a column over all rows is the
    largest group in the library); "at least two distinct values" is
    ``min < max``.
    """
    present = [c for c in NUMERIC if c in df.columns]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in present
    ])).alias("kv")).select("kv.*").filter(F.col("v").isNotNull())
    span = long.groupBy("column").agg(F.min("v").alias("v0"), F.max("v").alias("v1"))
    q = span.join(exact_percentiles(long, ["column"], "v", [0.25, 0.75], ["q1", "q3"]), "column")
    iqr = F.col("q3") - F.col("q1")
    m = th.outlier_iqr_multiplier
    return q.filter((F.col("v0") < F.col("v1")) & (iqr > 0)).select(
        "column", (F.col("q1") - m * iqr).alias("lower"), (F.col("q3") + m * iqr).alias("upper"))


def outliers(df: DataFrame, th: AnalysisThresholds = AnalysisThresholds()) -> DataFrame:
    """Q7: rows strictly outside the global fences of a column."""
    present = [c for c in NUMERIC if c in df.columns]
    long = df.select("site_id", "timestamp", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in present
    ])).alias("kv")).select("site_id", "timestamp", "kv.*")
    f = F.broadcast(iqr_fences(df, th))  # at most one row per numeric column
    return long.join(f, "column").filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))


# ------------------------------------------------------------------ Q9 / Q10
def site_ranges(df: DataFrame) -> DataFrame:
    return df.groupBy("site_id").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))


def different_date_ranges(df: DataFrame) -> DataFrame:
    """Q9: one row with the flag (> 1 site and differing first or last timestamp)."""
    r = site_ranges(df)
    return r.agg(((F.count("*") > 1) & ((F.countDistinct("lo") > 1) | (F.countDistinct("hi") > 1)))
                 .alias("sites_have_different_date_ranges"))


def insufficient_coverage(df: DataFrame, th: AnalysisThresholds = AnalysisThresholds()) -> DataFrame:
    """Q10: sites whose (max - min) span is shorter than the minimum days."""
    r = site_ranges(df)
    days = hours_between("hi", "lo") / 24
    return r.filter(days < th.minimum_history_days).select("site_id", days.alias("coverage_days"))


# ------------------------------------------------------------------ Q11
def quality_flags(df: DataFrame, th: AnalysisThresholds = AnalysisThresholds(),
                  block_hours: int = S.DEFAULT_BLOCK_HOURS, target: str = TARGET) -> DataFrame:
    """Q11: the full flag table (union of Q1-Q10)."""
    eps, lo, hi = th.near_zero_generation_kwh, th.low_irradiance_w_m2, th.high_irradiance_w_m2
    y = F.col(target)
    prev = previous_rows(df, block_hours, target)
    parts = [
        _flags(df.filter((y > eps) & (F.col("ghi_w_m2") < lo)), "positive_generation_at_very_low_irradiance",
               target, y, f"Generation exceeds {_g(eps)} kWh while GHI is below {_g(lo)} W/m²."),
        _flags(df.filter((y <= eps) & (F.col("ghi_w_m2") >= hi)), "near_zero_generation_at_high_irradiance",
               target, y, f"Generation is at most {_g(eps)} kWh while GHI is at least {_g(hi)} W/m²."),
        _flags(near_zero_runs(df, th, block_hours, target, prev), "long_consecutive_near_zero_generation", target, y,
               f"Part of an adjacent near-zero run lasting at least {th.consecutive_zero_hours} hours."),
        _flags(missing_hours(df, block_hours, prev), "missing_hourly_timestamp", "timestamp", None,
               "Expected hourly timestamp is absent; no record was inserted."),
    ]
    optional = [c for c in OPTIONAL if c in df.columns]
    if optional:
        long = df.select("site_id", "timestamp", F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).isNull().alias("m")) for c in optional])).alias("kv"))
        parts.append(long.filter(F.col("kv.m")).select(
            F.col("site_id"), F.col("timestamp"), F.lit("missing_optional_weather_value").alias("indicator"),
            F.col("kv.c").alias("column"), F.lit(None).cast("double").alias("value"),
            F.lit("Optional weather value is missing; it was not filled.").alias("detail")))
    parts.append(constant_columns(df).select(
        F.lit(None).cast("string").alias("site_id"), F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit("constant_value_sensor_column").alias("indicator"), "column", F.col("value").cast("double"),
        F.lit("All available values are identical.").alias("detail")))
    m = th.outlier_iqr_multiplier
    parts.append(outliers(df, th).select(
        "site_id", "timestamp", F.lit("extreme_value_iqr").alias("indicator"), "column", "value",
        F.format_string(f"Outside Tukey fences [%s, %s] using {_g(m)} × IQR.", g_format(F.col("lower")), g_format(F.col("upper"))).alias("detail")))
    parts.append(abrupt_changes(df, th, block_hours, target, prev).select(
        "site_id", "timestamp", F.lit("abrupt_generation_change").alias("indicator"), F.lit(target).alias("column"),
        F.col(target).alias("value"),
        F.format_string("Absolute adjacent-hour change exceeds the Tukey upper fence %s kWh.", g_format(F.col("upper_fence"))).alias("detail")))
    parts.append(different_date_ranges(df).filter(F.col("sites_have_different_date_ranges")).select(
        F.lit(None).cast("string").alias("site_id"), F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit("sites_have_different_date_ranges").alias("indicator"), F.lit("timestamp").alias("column"),
        F.lit(None).cast("double").alias("value"), F.lit("Site coverage start or end timestamps differ.").alias("detail")))
    parts.append(insufficient_coverage(df, th).select(
        "site_id", F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit("insufficient_historical_coverage").alias("indicator"), F.lit("timestamp").alias("column"),
        F.lit(None).cast("double").alias("value"),
        F.lit(f"Coverage is shorter than {th.minimum_history_days} days.").alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flag_counts(flags: DataFrame) -> DataFrame:
    """Flag counts by indicator."""
    return flags.groupBy("indicator").agg(F.count("*").alias("flag_count"))

"""Dataset profile, descriptive statistics, correlation and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.functions import DESCRIBE_NAMES, PERCENTILE_NAMES, PERCENTILES, describe_moments, hours_between
from pvspark.functions.quantiles import exact_percentiles
from pvspark.operators.config import AnalysisThresholds
from pvspark.schema import OPTIONAL, TARGET, WEATHER_COLUMNS

def _hour():
    return F.hour("timestamp")


def _day():
    return F.date_trunc("day", "timestamp")


def _month():
    return F.date_format("timestamp", "yyyy-MM")


def _level(g: str = "_g"):
    return F.when(F.col(g) == 1, F.lit("overall")).otherwise(F.lit("site")).alias("level")


def _with_percentiles(base: DataFrame, long: DataFrame, key: str) -> DataFrame:
    """Join exact percentiles (two-pass selection per ``key``) onto ``base``."""
    pct = exact_percentiles(long, [key], "value", list(PERCENTILES), list(PERCENTILE_NAMES))
    out = base.join(pct, key, "left").withColumn("median", F.col("percentile_50"))
    return out


def target_summary(df: DataFrame, target: str = TARGET) -> DataFrame:
    """A1/A2: descriptive measures of the target overall and per site.

    Moments come from one ROLLUP; percentiles from the exact two-pass
    selection over the rows keyed once per level (site, and overall).
    """
    y = F.col(target)
    agg = df.rollup("site_id").agg(
        *describe_moments(y),
        (F.count_if(y == 0) / F.count("*") * 100).alias("zero_generation_percentage"),
        F.grouping("site_id").alias("_g"),
    )
    agg = agg.withColumn("_key", F.when(F.col("_g") == 1, F.lit(None).cast("string")).otherwise(F.col("site_id")))
    overall = "\u0000overall"
    agg = agg.withColumn("_key", F.coalesce(F.col("_key"), F.lit(overall)))
    long = df.select(F.explode(F.array(F.col("site_id"), F.lit(overall))).alias("_key"), y.cast("double").alias("value"))
    out = _with_percentiles(agg, long, "_key")
    cols = [c if c != "total" else "total" for c in DESCRIBE_NAMES]
    return out.select(_level(), "site_id", *cols, "zero_generation_percentage") \
        .withColumnRenamed("total", "total_generated_energy_kwh")


def weather_summary(df: DataFrame) -> DataFrame:
    """Descriptive measures per present weather column (unpivot + one groupBy)."""
    present = [c for c in WEATHER_COLUMNS if c in df.columns]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in present
    ])).alias("kv")).select("kv.column", "kv.value")
    base = long.groupBy("column").agg(*describe_moments(F.col("value")))
    return _with_percentiles(base, long, "column").select("column", *DESCRIBE_NAMES)


def _by_levels(df: DataFrame, key, key_name: str, *aggs) -> DataFrame:
    """Overall and per-site aggregates in one pass (GROUPING SETS)."""
    base = df.select("site_id", key.alias(key_name), *[c for c in df.columns if c not in ("site_id",)])
    agg = base.groupingSets([[key_name], ["site_id", key_name]], key_name, "site_id").agg(
        *aggs, F.grouping("site_id").alias("_g"))
    return agg.select(_level(), "site_id", key_name, *[c for c in agg.columns if c not in ("site_id", key_name, "_g")])


def hourly_profile(df: DataFrame, target: str = TARGET) -> DataFrame:
    """A3: mean generation by UTC hour of day, overall and per site."""
    return _by_levels(df, _hour(), "hour_utc", F.avg(target).alias("mean_ac_energy_kwh"))


def daily_energy(df: DataFrame, target: str = TARGET) -> DataFrame:
    """A4: daily energy totals, overall and per site."""
    return _by_levels(df, _day(), "day", F.sum(target).alias("energy_kwh"))


def monthly_energy(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Monthly totals and means, kept only for levels with >= 2 months."""
    agg = _by_levels(df, _month(), "month", F.sum(target).alias("energy_kwh"),
                     F.avg(target).alias("mean_ac_energy_kwh"))
    from pyspark.sql import Window
    n = F.count("*").over(Window.partitionBy("level", "site_id"))
    return agg.withColumn("_n", n).filter(F.col("_n") >= 2).drop("_n")


def weekday_profile(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Mean generation by UTC weekday name."""
    return df.groupBy(F.date_format("timestamp", "EEEE").alias("weekday")).agg(
        F.avg(target).alias("mean_ac_energy_kwh"))


def hourly_ghi_generation(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Hour of day -> (mean GHI, mean generation)."""
    return df.groupBy(_hour().alias("hour_utc")).agg(
        F.avg("ghi_w_m2").alias("mean_ghi_w_m2"), F.avg(target).alias("mean_generation_kwh"))


def _day_rollup(df: DataFrame, extra=()) -> DataFrame:
    """(site, day) aggregates from the key-level counts (duplicates kept)."""
    keys = df.groupBy("site_id", "timestamp").agg(F.count("*").alias("n"), *extra)
    return keys.groupBy("site_id", F.date_trunc("day", "timestamp").alias("day")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("dups"),
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))


def _coverage_from_days(days: DataFrame) -> DataFrame:
    s = days.groupBy("site_id").agg(
        F.min("lo").alias("earliest_timestamp"), F.max("hi").alias("latest_timestamp"),
        F.sum("n").alias("actual_hourly_records"), F.sum("dups").alias("duplicate_count"),
        F.count_if(F.col("n") == 24).alias("complete_days"),
        F.count_if(F.col("n") < 24).alias("partial_days"))
    expected = (F.floor(hours_between("latest_timestamp", "earliest_timestamp")) + 1).cast("bigint")
    return s.select(
        "site_id", "earliest_timestamp", "latest_timestamp",
        expected.alias("expected_hourly_records"), "actual_hourly_records",
        F.bround(F.col("actual_hourly_records") / expected * 100, 4).alias("completeness_percentage"),
        (expected - F.col("actual_hourly_records")).alias("missing_timestamp_count"),
        "complete_days", "partial_days", "duplicate_count")


def site_coverage(df: DataFrame) -> DataFrame:
    """Expected vs actual hourly records per site, complete/partial days.

    Key -> (site, day) -> site aggregates: partial aggregation at each level,
    no per-row window, so a hot site never lands whole in one task.
    """
    return _coverage_from_days(_day_rollup(df)).drop("duplicate_count")


def dataset_profile(df: DataFrame) -> DataFrame:
    """One-row dataset profile (records, sites, range, gaps, duplicates, days)."""
    cov = _coverage_from_days(_day_rollup(df))
    overall = cov.agg(
        F.sum("actual_hourly_records").alias("total_record_count"),
        F.count("*").alias("number_of_sites"),
        F.min("earliest_timestamp").alias("earliest_timestamp"),
        F.max("latest_timestamp").alias("latest_timestamp"),
        F.sum("missing_timestamp_count").alias("missing_timestamp_count"),
        F.sum("duplicate_count").alias("duplicate_count"),
        F.sum("complete_days").alias("number_of_complete_days"),
        F.sum("partial_days").alias("number_of_partial_days"),
    )
    return overall.select(
        "total_record_count", "number_of_sites", "earliest_timestamp", "latest_timestamp",
        hours_between("latest_timestamp", "earliest_timestamp").alias("total_calendar_duration_hours"),
        "missing_timestamp_count", "duplicate_count", "number_of_complete_days", "number_of_partial_days",
        F.lit(";".join(c for c in OPTIONAL if c not in df.columns)).alias("optional_columns_absent"),
    )


def missing_value_counts(df: DataFrame) -> DataFrame:
    """NULL count per column (one aggregate, then unpivot)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "missing_count")


CONSTANT_REASONS = (
    "fewer than two complete paired observations",
    "weather column is constant",
    "target column is constant",
)


def correlations(df: DataFrame, target: str = TARGET) -> DataFrame:
    """A10: Pearson correlation of the target with each present weather column.

    Uses covariance / (std * std) with ``try_divide`` — ``corr`` would raise
    DIVIDE_BY_ZERO on a constant column under ANSI mode.
    """
    present = [c for c in WEATHER_COLUMNS if c in df.columns]
    long = df.select(F.col(target).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("weather_variable"), F.col(c).cast("double").alias("x")) for c in present
    ])).alias("kv")).select("kv.weather_variable", "kv.x", "y").filter(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    g = long.groupBy("weather_variable").agg(
        F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.covar_samp("x", "y").alias("cov"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"))
    names = df.sparkSession.createDataFrame([(c,) for c in present], "weather_variable string")
    g = names.join(g, "weather_variable", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    reason = (F.when(n < 2, F.lit(CONSTANT_REASONS[0]))
              .when(F.col("x0") == F.col("x1"), F.lit(CONSTANT_REASONS[1]))
              .when(F.col("y0") == F.col("y1"), F.lit(CONSTANT_REASONS[2])))
    corr = F.when(reason.isNull(), F.try_divide(F.col("cov"), F.col("sx") * F.col("sy")))
    return g.select(
        "weather_variable", F.lit("Pearson").alias("method"), n.alias("paired_observations"),
        corr.alias("correlation_with_ac_energy_kwh"),
        F.when(corr.isNotNull(), F.lit("available")).otherwise(F.lit("unavailable")).alias("availability"),
        reason.alias("reason"))


def correlation_matrix(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Pairwise-complete Pearson matrix over the target and usable columns.

    Each row is exploded into the (a, b) column pairs where both values are
    present, and one ``groupBy(a, b)`` (map-side combined) gives covariance
    and standard deviations per pair.  The usable set (at most the ten
    weather columns, a schema-bounded table) filters the result; it is empty
    when no weather column is usable.
    """
    usable = correlations(df, target).filter(F.col("availability") == "available") \
        .select(F.col("weather_variable").alias("v"))
    present = [target] + [c for c in WEATHER_COLUMNS if c in df.columns]
    pairs = [(a, b) for i, a in enumerate(present) for b in present[i:]]
    items = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(),
                    F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"),
                             F.col(b).cast("double").alias("y"))) for a, b in pairs]
    long = df.select(F.explode(F.array_compact(F.array(*items))).alias("p")).select("p.*")
    stats = long.groupBy("a", "b").agg(
        F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("r"))
    # Both orientations from the (small) result in one pass: no second aggregate.
    both = stats.select(F.explode(F.array_compact(F.array(
        F.struct("a", "b", "r"),
        F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))))).alias("m")
    ).select("m.*")
    ok = F.broadcast(usable.unionByName(df.sparkSession.createDataFrame([(target,)], "v string")))
    out = (both.join(ok.withColumnRenamed("v", "a"), "a", "left_semi")
               .join(ok.withColumnRenamed("v", "b"), "b", "left_semi"))
    from pyspark.sql import Window
    k = F.count("*").over(Window.partitionBy(F.lit(0)))  # <= 121 rows
    return out.withColumn("_k", k).filter(F.col("_k") > 1).select(
        F.col("a").alias("row_variable"), F.col("b").alias("column_variable"), F.col("r").alias("correlation"))


# Texts of the report that results have to equal.
READINESS_LIMITATIONS = (
    "Resolve missing hourly timestamps or document an explicit gap policy.",
    "Review optional-field missingness before feature selection.",
    "The target lacks variation required for supervised learning.",
    "Collect multiple months to represent broader temporal conditions.",
    "No fully populated high-irradiance observation is available.",
    "Single-site evidence does not establish cross-site generalisation.",
)


def readiness(df: DataFrame, thresholds: AnalysisThresholds = AnalysisThresholds(),
              target: str = TARGET) -> DataFrame:
    """Readiness flags and category.

    Every flag is a mergeable aggregate (min/max/sum), computed along the
    key -> (site, day) -> site -> overall chain used by the profile.
    """
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(c).isNull()
    high = F.col("ghi_w_m2") >= thresholds.high_irradiance_w_m2
    y = F.col(target)
    rows = df.select("site_id", "timestamp", y.alias("y"), _month().alias("m"),
                     any_null.cast("int").alias("nul"), (high & ~any_null).cast("int").alias("cd"))
    days = rows.groupBy("site_id", F.date_trunc("day", "timestamp").alias("day")).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("m").alias("m0"), F.max("m").alias("m1"),
        F.max("nul").alias("nul"), F.max("cd").alias("cd"))
    sites = days.groupBy("site_id").agg(
        (F.floor(hours_between(F.max("hi"), F.min("lo"))) + 1 - F.sum("n")).alias("missing"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("m0").alias("m0"), F.max("m1").alias("m1"),
        F.max("nul").alias("nul"), F.max("cd").alias("cd"))
    flags = sites.agg(
        (F.sum("missing") == 0).alias("chronological_continuity_acceptable"),
        (F.max("nul") == 1).alias("missingness_present"),
        (F.min("y0") < F.max("y1")).alias("target_has_sufficient_variation"),
        (F.min("m0") < F.max("m1")).alias("history_covers_multiple_months"),
        F.coalesce(F.max("cd") == 1, F.lit(False)).alias("complete_daylight_records_present"),
        (F.count("*") > 1).alias("_multi"))
    L = READINESS_LIMITATIONS
    lim = F.array_compact(F.array(
        F.when(~F.col("chronological_continuity_acceptable"), F.lit(L[0])),
        F.when(F.col("missingness_present"), F.lit(L[1])),
        F.when(~F.col("target_has_sufficient_variation"), F.lit(L[2])),
        F.when(~F.col("history_covers_multiple_months"), F.lit(L[3])),
        F.when(~F.col("complete_daylight_records_present"), F.lit(L[4])),
        F.when(~F.col("_multi"), F.lit(L[5])),
    ))
    category = (F.when(~F.col("target_has_sufficient_variation") | ~F.col("complete_daylight_records_present"),
                       F.lit("not_ready"))
                .when(F.size(lim) > 0, F.lit("ready_with_warnings")).otherwise(F.lit("ready")))
    return flags.select(
        category.alias("category"), "chronological_continuity_acceptable", "missingness_present",
        "target_has_sufficient_variation", "history_covers_multiple_months",
        "complete_daylight_records_present",
        F.when(F.col("_multi"), F.lit("multiple_sites")).otherwise(F.lit("single_site")).alias("site_scope"),
        F.array_join(lim, " | ").alias("major_limitations_before_training"))


def column_types(df: DataFrame) -> DataFrame:
    """Columns present with their types (schema-sized table, no data read)."""
    return df.sparkSession.createDataFrame([(c, t) for c, t in df.dtypes], "column string, data_type string")

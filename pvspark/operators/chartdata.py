"""Tables behind the reference charts (C1-C9); pictures are not drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.schema import TARGET, WEATHER_COLUMNS


def daily_energy_pivot(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Energy of every site on every day of the table, 0 where it has no row.

    Long form (day, site_id, energy): each site's days come from a sequence
    between the table's first and last day, kept where any site has rows, so
    no list of sites passes through the driver.
    """
    day = F.date_trunc("day", "timestamp")
    daily = df.groupBy(day.alias("day"), "site_id").agg(F.sum(target).alias("energy"))
    span = df.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    sites = df.select("site_id").distinct().select("site_id", F.explode(F.sequence(
        span.select("first").scalar(), span.select("last").scalar(), F.expr("interval 1 day"))).alias("day"))
    grid = sites.join(daily.select("day").distinct(), "day", "left_semi")
    return grid.join(daily, ["day", "site_id"], "left").select(
        "day", "site_id", F.coalesce("energy", F.lit(0.0)).alias("energy"))


def histogram_bins(n_rows: Column, divisor: int) -> Column:
    return F.least(F.lit(30), F.greatest(F.lit(5), F.floor(n_rows / divisor))).cast("int")


def histogram(df: DataFrame, col: str, divisor: int = 2) -> DataFrame:
    """Equal-width histogram with ``min(30, max(5, n // divisor))`` bins.

    Same rules as NumPy: range [min, max] (widened by 0.5 each side when
    min = max), last bin closed, index corrected against the computed edges.
    All bins are returned, empty ones with count 0.
    """
    x = F.col(col)
    st = df.agg(F.count(x).alias("n"), F.min(x).alias("lo0"), F.max(x).alias("hi0"))
    st = st.select(histogram_bins(F.col("n"), divisor).alias("bins"),
                   F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
                   F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    row = st.first()  # one row: three numbers
    bins, lo, hi = row["bins"], row["lo"], row["hi"]
    if row["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, lower_edge double, upper_edge double, count bigint")
    step = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))

    i0 = F.floor((x - F.lit(lo)) * F.lit(bins / (hi - lo))).cast("int")
    i1 = F.when(i0 == bins, i0 - 1).otherwise(i0)
    i2 = F.when(x < edge(i1), i1 - 1).otherwise(i1)
    i3 = F.when((x >= edge(i2 + 1)) & (i2 != bins - 1), i2 + 1).otherwise(i2)
    counts = df.filter(x.isNotNull()).groupBy(i3.alias("bin")).agg(F.count("*").alias("count"))
    spark = df.sparkSession
    all_bins = spark.range(0, 30).select(F.col("id").cast("int").alias("bin")).filter(F.col("bin") < bins)
    b = F.col("bin")
    return all_bins.join(counts, "bin", "left").select(
        "bin", edge(b).alias("lower_edge"), edge(b + 1).alias("upper_edge"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"))


def daily_weather_standardised(df: DataFrame) -> DataFrame:
    """C4: daily means of present weather columns, z-scored over days
    (sample std; a zero std is replaced by 1)."""
    present = [c for c in WEATHER_COLUMNS if c in df.columns]
    daily = df.groupBy(F.date_trunc("day", "timestamp").alias("day")).agg(*[F.avg(c).alias(c) for c in present])
    long = daily.select("day", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v"))
                                                    for c in present])).alias("s")).select("day", "s.*")
    st = long.groupBy("column").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    z = (F.col("v") - F.col("m")) / F.when(F.col("s") == 0, F.lit(1.0)).otherwise(F.col("s"))
    return long.join(F.broadcast(st), "column").select("day", "column", z.alias("standardised_mean"))  # <= 10 rows


def timestamp_totals(report: DataFrame) -> DataFrame:
    """Actual vs predicted summed per timestamp."""
    return report.groupBy("timestamp").agg(F.sum("actual_ac_energy_kwh").alias("actual_ac_energy_kwh"),
                                           F.sum("prediction").alias("prediction"))


def daily_totals(report: DataFrame) -> DataFrame:
    """Actual vs predicted summed per UTC date."""
    return report.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.sum("actual_ac_energy_kwh").alias("actual_ac_energy_kwh"), F.sum("prediction").alias("prediction"))


def hourly_residual(report: DataFrame) -> DataFrame:
    """Mean residual by UTC hour."""
    return report.groupBy(F.hour("timestamp").alias("hour")).agg(F.avg("residual").alias("mean_residual"))


def fold_mae(fold_metrics: DataFrame) -> DataFrame:
    """MAE per candidate and fold (mean +- std comes from A25)."""
    return fold_metrics.select("candidate_id", "fold_number", F.col("mae_kwh").alias("mae"))

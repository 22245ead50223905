"""Scalar Column helpers shared by operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pvspark.schema import HOUR_US

PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def nan_to_null(c: str | Column) -> Column:
    x = col(c)
    return F.when(~F.isnan(x), x)


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    """Exact (fractional) hours between two timestamps, as a double."""
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(float(HOUR_US))


def safe_ratio(num: str | Column, den: str | Column, eps: float) -> Column:
    """num / den only where |den| > eps (physically defined), else NULL."""
    d = col(den)
    return F.when(F.abs(d) > F.lit(eps), col(num) / d)


PERCENTILE_NAMES = ("percentile_05", "percentile_25", "percentile_50", "percentile_75", "percentile_95")


def describe_moments(x: Column) -> list[Column]:
    """A1 measures other than percentiles; sample std is 0.0 for one value;
    all NULL when empty."""
    n = F.count(x)
    return [
        F.when(n > 0, n).alias("count"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
        F.avg(x).alias("mean"),
        F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(x)).alias("standard_deviation"),
        F.sum(x).alias("total"),
    ]


def describe(x: Column) -> list[Column]:
    """A1 measures with Spark's exact percentile (for small groups)."""
    pct = F.percentile(x, list(PERCENTILES))
    return describe_moments(x) + [pct[2].alias("median")] + [pct[i].alias(n) for i, n in enumerate(PERCENTILE_NAMES)]


DESCRIBE_NAMES = ("count", "minimum", "maximum", "mean", "median", "standard_deviation",
                  "percentile_05", "percentile_25", "percentile_50", "percentile_75",
                  "percentile_95", "total")

"""Feature-row eligibility (F9), the only-eligible filter (F11) and the
eligibility audit tables (A16, A17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.schema import REQUIRED_WEATHER


def add_eligibility(df: DataFrame, failures: dict[str, Column]) -> DataFrame:
    """Reasons: missing required weather (schema order), then history failures
    (configuration order); a NULL failure mask counts as failed."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"missing_source_weather:{c}")) for c in REQUIRED_WEATHER]
    reasons += [F.when(F.coalesce(mask, F.lit(True)), F.lit(reason)) for reason, mask in failures.items()]
    arr = F.array_compact(F.array(*reasons))
    return (df.withColumn("_reasons", arr)
              .withColumn("feature_missing_count", F.size("_reasons"))
              .withColumn("feature_missing_reasons", F.array_join("_reasons", ";"))
              .withColumn("feature_eligible", F.col("feature_missing_count") == 0)
              .drop("_reasons"))


def only_eligible(df: DataFrame) -> DataFrame:
    return df.filter(F.col("feature_eligible"))


def _exploded_reasons(df: DataFrame) -> DataFrame:
    return df.select("site_id", "feature_eligible",
                     F.explode(F.split("feature_missing_reasons", ";")).alias("reason"))


def eligibility_table(df: DataFrame) -> DataFrame:
    """Row counts by (site, eligible, reason); an empty reason is 'eligible'."""
    ex = _exploded_reasons(df).withColumn(
        "reason", F.when(F.col("reason") == "", F.lit("eligible")).otherwise(F.col("reason")))
    return ex.groupBy("site_id", "feature_eligible", "reason").agg(F.count("*").alias("row_count"))


def reason_counts(df: DataFrame) -> DataFrame:
    """Occurrences of each reason (empty reasons dropped)."""
    ex = _exploded_reasons(df).filter(F.col("reason") != "")
    return ex.groupBy("reason").agg(F.count("*").alias("row_count"))

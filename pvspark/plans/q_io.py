"""Queries: source/sink round trips (S1-S3, S8, S11, J8) through files in the
session's shared checkpoint folder."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import functions as F

from pvspark.operators import align as A
from pvspark.operators import splits as SP
from pvspark.plans import oracle as O
from pvspark.plans import q_features as QF
from pvspark.plans.registry import register
from pvspark.session import checkpoint_dir
from pvspark.sources import fixtures as fx
from pvspark.sources import io


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), "pvspark-io", f"{name}-{uuid.uuid4().hex[:12]}")


@register("csv_ingest_roundtrip", O.with_ctes(O.EVENTS_HOURLY) + """SELECT *,
   row_number() OVER (ORDER BY site_id, timestamp) - 1 AS source_row FROM hourly""")
def q_csv_roundtrip(spark, d):
    """S1-S3; the CSV is written in key order, so its line numbers are known."""
    raw = fx.raw_strings(fx.events_hourly(spark, d)).drop("source_row")
    base = _scratch(spark, "csv")
    io.write_table(raw, base + "/raw", "csv", order_by=["site_id", "timestamp"])
    io.ingest_hourly_csv(spark, base + "/raw", base + "/canonical")
    return spark.read.parquet(base + "/canonical").drop("month")


@register("split_plan_roundtrip", O.with_ctes(O.EVENTS_HOURLY, QF.SPLIT_SQL) + f"""
SELECT split, count(*) AS record_count FROM (SELECT {QF._label(('train', 'validation', 'test'))} AS split FROM hourly)
GROUP BY split""")
def q_split_plan_roundtrip(spark, d):
    h = fx.events_hourly(spark, d)
    plan = SP.plan_chronological_splits(h)
    summary = SP.split_summary(SP.label_chronological(h, plan)).collect()  # three rows
    periods = {r["split"]: {"beginning_timestamp": r["beginning_timestamp"].isoformat() + "+00:00",
                            "ending_timestamp": r["ending_timestamp"].isoformat() + "+00:00",
                            "record_count": r["record_count"]} for r in summary}
    path = _scratch(spark, "plan") + "/split_plan.json"
    spark.createDataFrame([(json.dumps({"periods": periods}),)], "v string").coalesce(1).write.mode("overwrite").text(path)
    loaded = io.load_split_plan(spark, path)
    labelled = A.label_periods(h, [(n, s, e) for n, s, e, _ in loaded])
    return labelled.groupBy("split").agg(F.count("*").alias("record_count"))


@register("feature_splits_roundtrip", QF._FJ + "SELECT split, count(*) AS record_count, "
          "count(*) FILTER (WHERE feature_eligible) AS eligible_rows FROM feat GROUP BY split")
def q_feature_splits(spark, d):
    """One output per split, read back."""
    base = _scratch(spark, "splits")
    io.write_splits(QF._spark_features(spark, d).features, base)
    back = spark.read.parquet(base)
    return back.groupBy("split").agg(F.count("*").alias("record_count"),
                                     F.count_if(F.col("feature_eligible")).alias("eligible_rows"))


@register("split_boundary_checks", QF._FJ + """SELECT problem FROM (
   SELECT CASE WHEN NOT (max(timestamp) FILTER (WHERE split = 'train') < min(timestamp) FILTER (WHERE split = 'validation')
      AND min(timestamp) FILTER (WHERE split = 'validation') <= max(timestamp) FILTER (WHERE split = 'validation')
      AND max(timestamp) FILTER (WHERE split = 'validation') < min(timestamp) FILTER (WHERE split = 'test'))
      THEN 'split boundaries are not strictly ordered' END AS problem FROM feat
   UNION ALL SELECT CASE WHEN count(*) FILTER (WHERE split = 'train') < 24 THEN 'train split has fewer than 24 rows' END FROM feat
   UNION ALL SELECT CASE WHEN count(*) FILTER (WHERE split = 'validation') < 12 THEN 'validation split has fewer than 12 rows' END FROM feat
   UNION ALL SELECT CASE WHEN count(*) FILTER (WHERE split = 'test') < 12 THEN 'test split has fewer than 12 rows' END FROM feat)
WHERE problem IS NOT NULL""")
def q_split_checks(spark, d):
    """V18 on the feature table."""
    return SP.split_order_checks(QF._spark_features(spark, d).features, {"train": 24, "validation": 12, "test": 12})


@register("split_plan_checks", O.with_ctes(O.ORDERS_HOURLY) + """SELECT 'split_plan_dataset_mismatch' AS code,
   'Every input timestamp must fall within exactly one split period.' AS message FROM hourly
   WHERE timestamp >= TIMESTAMP '1998-01-01' AND timestamp < TIMESTAMP '1998-02-01' HAVING count(*) > 0""")
def q_split_plan_checks(spark, d):
    """A plan whose periods leave January 1998 uncovered (F-ORDERS)."""
    from datetime import datetime
    h = fx.orders_hourly(spark, d)
    periods = [("train", datetime(1990, 1, 1), datetime(1997, 12, 31, 23)),
               ("validation", datetime(1998, 2, 1), datetime(1999, 12, 31, 23)),
               ("test", datetime(2000, 1, 1), datetime(2010, 1, 1))]
    return SP.check_split_plan(h, periods)

"""Ranks and percentiles on tables beyond any sampling or sketch bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvspark.functions.quantiles import exact_percentiles
from pvspark.operators.config import AnalysisThresholds, FeatureConfig, SplitProportions
from pvspark.operators.metrics import g_format
from pvspark.operators.models import global_rank


@pytest.mark.parametrize("layout", ["ascending", "shuffled"])
def test_global_rank_is_dense_and_unique_on_many_rows(spark, layout):
    df = spark.range(0, 400_000, 1, 7).select((F.col("id") * 3).alias("k"))
    if layout == "shuffled":
        df = df.repartition(5).withColumn("h", F.xxhash64("k")).orderBy("h").drop("h")
    r = global_rank(df, ["k"], "r", partitions=9)
    got = r.agg(F.count("*").alias("n"), F.countDistinct("r").alias("u"), F.min("r").alias("a"), F.max("r").alias("z"),
                F.count_if(F.col("r") * 3 != F.col("k")).alias("wrong")).first()
    assert tuple(got) == (400_000, 400_000, 0, 399_999, 0)


def test_global_rank_of_an_empty_table(spark):
    assert global_rank(spark.range(0), ["id"], "r").count() == 0


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_percentiles_of_groups_of_any_size(spark, accuracy):
    g = np.random.default_rng(1)
    groups = {"one": [4.0], "two": [1.0, 3.0], "ties": [2.0] * 30 + [5.0] * 3, "three": [1.0, 2.0, 9.0],
              "small": list(g.normal(size=37)), "large": list(g.normal(size=60_000).round(3)), None: [1.0, 2.0]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None), ("two", float("nan"))]
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    out = {r["k"]: list(r)[1:] for r in exact_percentiles(df, ["k"], "v", probs, accuracy=accuracy).collect()}
    assert set(out) == set(groups)
    for k, vs in groups.items():
        assert out[k] == pytest.approx([float(np.quantile(vs, p)) for p in probs], rel=1e-12, abs=1e-12), k


@pytest.mark.parametrize("shape", ["distinct", "ties", "heavy"])
def test_percentiles_narrow_their_bands_until_one_task_can_order_them(spark, monkeypatch, shape):
    from pvspark.functions import quantiles
    calls, narrowed = [], quantiles._narrowed
    monkeypatch.setattr(quantiles, "BAND_ROWS", 4)
    monkeypatch.setattr(quantiles, "SPLITS", 7)
    monkeypatch.setattr(quantiles, "_narrowed", lambda *a: calls.append(a) or narrowed(*a))
    v = {"distinct": F.col("id") * 1.5, "ties": (F.col("id") % 37) * 1.0,
         "heavy": F.when(F.col("id") % 10 < 9, 5.0).otherwise(F.col("id") * 1.0)}[shape]
    df = spark.range(0, 6001, 1, 5).select(F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("k"), v.alias("v"))
    probs = [0.0, 0.05, 0.3, 0.5, 2 / 3, 0.97, 1.0]
    got = {r["k"]: list(r)[1:] for r in exact_percentiles(df, ["k"], "v", probs, accuracy=20).collect()}
    want = df.groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(f"p{i}") for i, p in enumerate(probs)]).collect()
    assert got == {r["k"]: pytest.approx(list(r)[1:], rel=1e-12) for r in want}
    assert len(calls) >= (3 if shape == "distinct" else 1)


def test_g_format_is_pythons(spark):
    ties = [-73.79625, 100000.5, 100001.5, 2.5, 999999.5, 99999.95, 0.00012345675, 1234565.0, 0.1234565, 1e300]
    xs = ties + [0.0, 1.0, -2.5, 1234.5678, 123456.5, 999999.5, 1e6, 1.5e-5, 0.00012345678, 1e-4, 455.123456, 12.3, -0.1, 9.999996]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", g_format(F.col("x")).alias("s")).collect()
    assert {r["x"]: r["s"] for r in rows} == {x: f"{x:g}" for x in xs}


@pytest.mark.parametrize("make", [lambda: FeatureConfig(target_lag_hours=(24, 24)), lambda: FeatureConfig(irradiance_epsilon=-1.0),
                                  lambda: FeatureConfig(target_lag_hours=(3,)), lambda: AnalysisThresholds(consecutive_zero_hours=1),
                                  lambda: AnalysisThresholds(low_irradiance_w_m2=600.0), lambda: SplitProportions(0.7, 0.2, 0.2),
                                  lambda: SplitProportions(1.0, 0.0, 0.0), lambda: FeatureConfig(forecast_horizon_hours=0)])
def test_configurations_out_of_bounds_are_rejected(make):
    with pytest.raises(ValueError):
        make()

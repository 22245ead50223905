"""Leakage-safe target history and exact-time weather lags.

Exact-time lag ``L``: the value at ``t - L`` of the same site, else NULL; a
``RANGE`` frame of width zero at ``-L`` hours.  Rolling statistics cover
``(t - h - w, t - h]`` (left-open), i.e. ``RANGE BETWEEN -(h+w)H + 1 AND -hH``
in microseconds.  All lags and rolling windows share one shuffle, one sort
and one Window operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.operators import blocks
from pvspark.operators.config import FeatureConfig
from pvspark.schema import HOUR_US, TARGET

ROLLING_STATS = ("count", "mean", "std", "min", "max", "median")

# Weather lag output name stems, in source-column order.
WEATHER_LAG_BASES = {
    "ghi_w_m2": "ghi",
    "cloud_cover_pct": "cloud_cover",
    "ambient_temperature_c": "ambient_temperature",
    "relative_humidity_pct": "relative_humidity",
    "wind_speed_m_s": "wind_speed",
    "dni_w_m2": "dni",
    "dhi_w_m2": "dhi",
    "module_temperature_c": "module_temperature",
    "precipitation_mm": "precipitation",
    "inverter_availability_pct": "inverter_availability",
}


def _stat(stat: str, y: Column) -> Column:
    return {
        "count": F.count(y),
        "mean": F.avg(y),
        "std": F.stddev_samp(y),
        "min": F.min(y),
        "max": F.max(y),
        "median": F.percentile(y, 0.5),
    }[stat]


def history_columns(cfg: FeatureConfig, present: list[str], target: str = TARGET
                    ) -> tuple[list[tuple[str, Column]], list[str], list[str], dict[str, Column]]:
    """Window expressions for target history and weather lags.

    Returns ``(named_exprs, history_names, weather_lag_names, failures)`` where
    ``failures`` maps a reason to a boolean Column over the output columns.
    """
    w = blocks.block_window()
    y = F.col(target)
    exprs: list[tuple[str, Column]] = []
    hist: list[str] = []
    failures: dict[str, Column] = {}
    if cfg.include_target_history:
        for lag in cfg.target_lag_hours:
            name = f"ac_energy_lag_{lag}h"
            exprs.append((name, F.max(y).over(w.rangeBetween(-lag * HOUR_US, -lag * HOUR_US))))
            hist.append(name)
            failures[f"missing_exact_target_lag_{lag}h"] = F.col(name).isNull()
        h = cfg.forecast_horizon_hours
        for win in cfg.rolling_window_hours:
            frame = w.rangeBetween(-(h + win) * HOUR_US + 1, -h * HOUR_US)
            for stat in ROLLING_STATS:
                name = f"ac_energy_rolling_{win}h_{stat}"
                exprs.append((name, _stat(stat, y).over(frame)))
                hist.append(name)
            count = F.col(f"ac_energy_rolling_{win}h_count")
            failures[f"missing_rolling_history_{win}h"] = F.coalesce(count, F.lit(0)) == 0
            if cfg.require_complete_history:
                failures[f"incomplete_rolling_history_{win}h"] = count < win
    lag_names: list[str] = []
    if cfg.include_weather_lags:
        sources = [c for c in WEATHER_LAG_BASES if c in present]
        for lag in cfg.weather_lag_hours:
            frame = w.rangeBetween(-lag * HOUR_US, -lag * HOUR_US)
            for src in sources:
                name = f"{WEATHER_LAG_BASES[src]}_lag_{lag}h"
                exprs.append((name, F.max(F.col(src)).over(frame)))
                lag_names.append(name)
    return exprs, hist, lag_names, failures


def add_history(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), *,
                block_hours: int | None = None, target: str = TARGET
                ) -> tuple[DataFrame, list[str], list[str], dict[str, Column]]:
    """Add target history (J5, W1) and weather lags (J6) in one window pass."""
    exprs, hist, lag_names, failures = history_columns(cfg, df.columns, target)
    if not exprs:
        return df, hist, lag_names, failures
    # A row's frames cost far more than its bytes tell, so the adaptive merging of small partitions, which goes by
    # bytes, would leave a task a core: a number of partitions that is asked for is kept.
    spark = df.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    staged = blocks.blocked(df, cfg.reach_hours, block_hours).repartition(parts, "site_id", blocks.BLOCK)
    out = staged.select("*", *[e.alias(n) for n, e in exprs])
    return blocks.home_rows(out).drop(blocks.US), hist, lag_names, failures


def add_generation_history(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), **kw
                           ) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """Target lags and rolling statistics only (no weather lags)."""
    from dataclasses import replace
    out, hist, _, failures = add_history(df, replace(cfg, include_weather_lags=False), **kw)
    return out, hist, failures

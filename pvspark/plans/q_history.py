"""Queries: fixtures, target history and eligibility (flagship)."""

from __future__ import annotations

from pvspark.operators.config import FeatureConfig
from pvspark.operators.eligibility import add_eligibility, eligibility_table, reason_counts
from pvspark.operators.history import add_history
from pvspark.plans import oracle as O
from pvspark.plans.registry import HOURLY_DOUBLES, register, rnd_sql, rounded
from pvspark.sources import fixtures as fx

# The flagship configuration: three lags and three rolling windows.
FLAGSHIP_CFG = FeatureConfig(rolling_window_hours=(3, 24, 168), include_weather_lags=False)


# ---------------------------------------------------------------- fixtures
@register("events_hourly", O.with_ctes(O.EVENTS_HOURLY) + "SELECT * FROM hourly")
def q_events_hourly(spark, d):
    return fx.events_hourly(spark, d)


@register("orders_hourly", O.with_ctes(O.ORDERS_HOURLY) + "SELECT * FROM hourly")
def q_orders_hourly(spark, d):
    return fx.orders_hourly(spark, d)


# ---------------------------------------------------------------- history
def _flagship_features(spark, d, cfg=FLAGSHIP_CFG):
    hourly = fx.events_hourly(spark, d)
    out, _, _, failures = add_history(hourly, cfg)
    return add_eligibility(out, failures)


def _flagship_sql(cfg=FLAGSHIP_CFG):
    hist, names, failures = O.history_select(cfg, HOURLY_DOUBLES)
    elig = O.eligibility_select(failures, "hist")
    return O.with_ctes(O.EVENTS_HOURLY, f"hist AS ({hist})", f"feat AS ({elig})"), names


_fs, _hist_names = _flagship_sql()


@register("eligibility_by_site_reason",
          _fs + "SELECT site_id, feature_eligible, "
          "CASE WHEN reason = '' THEN 'eligible' ELSE reason END AS reason, count(*) AS row_count "
          "FROM (SELECT site_id, feature_eligible, unnest(string_split(feature_missing_reasons, ';')) AS reason FROM feat) "
          "GROUP BY ALL")
def q_eligibility_table(spark, d):
    return eligibility_table(_flagship_features(spark, d))


@register("eligibility_reason_counts",
          _fs + "SELECT reason, count(*) AS row_count FROM "
          "(SELECT unnest(string_split(feature_missing_reasons, ';')) AS reason FROM feat) "
          "WHERE reason <> '' GROUP BY reason")
def q_reason_counts(spark, d):
    return reason_counts(_flagship_features(spark, d))


_hist_doubles = [n for n in _hist_names if not n.endswith("_count")]


@register("generation_history",
          rnd_sql(_fs + "SELECT site_id, timestamp, ac_energy_kwh, " + ", ".join(_hist_names)
                  + ", feature_missing_count, feature_missing_reasons, feature_eligible FROM feat",
                  _hist_doubles))
def q_generation_history(spark, d):
    df = _flagship_features(spark, d)
    return rounded(df.select("site_id", "timestamp", "ac_energy_kwh", *_hist_names,
                             "feature_missing_count", "feature_missing_reasons", "feature_eligible"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_eligibility_table(spark, sf_dir)

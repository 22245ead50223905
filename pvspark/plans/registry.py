"""Query registry: Spark callables and their DuckDB oracle SQL.

Every query reads the driver tables under ``sf_dir`` (or tables Spark derives
from them) and runs over whole tables.  Doubles are rounded to 6 decimals on
both sides so that summation order cannot change the value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

def stable_round(c, digits: int = DIGITS):
    """Round identically in Spark and DuckDB: first to 9 decimals (removes
    summation-order noise), then to ``digits`` with an explicit scale,
    round-to-integer, unscale (both engines agree on exact .5 integers)."""
    hi, lo = float(10 ** 9), float(10 ** digits)
    y = F.round(c * F.lit(hi), 0) / F.lit(hi)
    return F.round(y * F.lit(lo), 0) / F.lit(lo) + F.lit(0.0)


def stable_round_sql(c: str, digits: int = DIGITS) -> str:
    return (f"round(round({c} * CAST(1000000000 AS DOUBLE)) / CAST(1000000000 AS DOUBLE) "
            f"* CAST({10 ** digits} AS DOUBLE)) / CAST({10 ** digits} AS DOUBLE) + CAST(0 AS DOUBLE)")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(stable_round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rnd_sql(sql: str, double_cols: list[str], digits: int = DIGITS) -> str:
    if not double_cols:
        return sql
    rep = ", ".join(f"{stable_round_sql(c, digits)} AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _q"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


HOURLY_DOUBLES = ["ac_energy_kwh", "ghi_w_m2", "ambient_temperature_c", "cloud_cover_pct",
                  "relative_humidity_pct", "wind_speed_m_s", "dni_w_m2", "dhi_w_m2",
                  "module_temperature_c", "precipitation_mm", "inverter_availability_pct"]

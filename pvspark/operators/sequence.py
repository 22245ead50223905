"""Per-site "previous row" and run-start scans without a per-site window.

A site may hold a third of all rows, so nothing here partitions by site
alone.  Rows are grouped into time blocks; inside a ``(site, block)``
partition ``lag`` gives the previous row, and the first row of a block takes
the last row of the nearest earlier non-empty block from a block summary
(``#blocks`` rows per site) lagged per site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvspark.schema import HOUR_US

US, BLK = "_us", "_b"
DEFAULT_BLOCK_HOURS = 720
DEFAULT_BLOCK_ROWS = 1 << 20


def _blocks(df: DataFrame, block_hours: int, ts: str = "timestamp") -> DataFrame:
    return (df.withColumn(US, F.unix_micros(F.col(ts)))
              .withColumn(BLK, F.floor(F.col(US) / F.lit(block_hours * HOUR_US))))


def with_previous(df: DataFrame, value_cols: list[str], block_hours: int = DEFAULT_BLOCK_HOURS,
                  site: str = "site_id", ts: str = "timestamp") -> DataFrame:
    """Add ``prev_us`` and ``prev_<c>`` (previous row of the same site by time)."""
    return _previous(_blocks(df, block_hours, ts), value_cols, site)


def with_previous_row(df: DataFrame, position: str, value_cols: list[str], block_rows: int = DEFAULT_BLOCK_ROWS,
                      site: str = "site_id") -> DataFrame:
    """The same along a table's own order: ``position`` is a row's number, and a block is a range of numbers."""
    d = df.withColumn(US, F.col(position).cast("long")).withColumn(BLK, F.floor(F.col(US) / F.lit(block_rows)))
    return _previous(d, value_cols, site)


def _previous(d: DataFrame, value_cols: list[str], site: str) -> DataFrame:
    summ = d.groupBy(site, BLK).agg(
        F.max(US).alias("_last_us"), *[F.max_by(c, US).alias(f"_last_{c}") for c in value_cols])
    wb = Window.partitionBy(site).orderBy(BLK)
    summ = summ.select(site, BLK, F.lag("_last_us").over(wb).alias("_bp_us"),
                       *[F.lag(f"_last_{c}").over(wb).alias(f"_bp_{c}") for c in value_cols])
    d = d.join(summ, [site, BLK], "left")
    w = Window.partitionBy(site, BLK).orderBy(US)
    inner = F.lag(US).over(w)
    out = d.withColumn("prev_us", F.coalesce(inner, F.col("_bp_us")))
    for c in value_cols:
        out = out.withColumn(f"prev_{c}", F.when(inner.isNull(), F.col(f"_bp_{c}")).otherwise(F.lag(c).over(w)))
    return out.drop("_bp_us", *[f"_bp_{c}" for c in value_cols])


def run_start(df: DataFrame, starts: Column, site: str = "site_id") -> DataFrame:
    """Add ``run_start_us``: time of the latest row (<= current) where ``starts``.

    Needs the ``_us``/``_b`` columns from :func:`with_previous`.  Inside a block
    a running max finds the start; a block without one inherits the last start
    of earlier blocks (block summary, running max per site).
    """
    d = df.withColumn("_st", F.when(starts, F.col(US)))
    summ = d.groupBy(site, BLK).agg(F.max("_st").alias("_bst"))
    wb = Window.partitionBy(site).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(site, BLK, F.max("_bst").over(wb).alias("_carry"))
    d = d.join(summ, [site, BLK], "left")
    w = Window.partitionBy(site, BLK).orderBy(US).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("run_start_us", F.coalesce(F.max("_st").over(w), F.col("_carry"))).drop("_st", "_carry")


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(US, BLK)

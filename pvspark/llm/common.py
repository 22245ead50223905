"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.session import checkpoint_dir, table_path


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Rows, and bytes beside one row, that go to a Python worker at once, where the session has Spark's defaults.
_BATCH_LIMITS = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
                 ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from its folder where it is not installed, and bound their batches."""
    for setting, default, limit in _BATCH_LIMITS:
        if spark.conf.get(setting) == default:
            spark.conf.set(setting, limit)
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared checkpoint folder and read it back.

    Texts take about a third less of the shared disk in zstandard than in the default codec.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, under fixed names; other columns cannot clash.

    A null text counts as the empty text.
    """
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

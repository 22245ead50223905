"""Training-set preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.functions import is_finite
from pvspark.operators import sequence as S
from pvspark.schema import TARGET

SPLITS = ("train", "validation", "test")
KEYS = ("timestamp", "site_id")
METADATA = ("split", "feature_eligible", "feature_missing_count", "feature_missing_reasons")
# Columns that must never be predictors.
FORBIDDEN_PREDICTORS = ("ac_energy_kwh", "timestamp", "site_id", "split", "feature_eligible",
                        "feature_missing_count", "feature_missing_reasons", "row_id", "record_id", "source_row")


def contract_issues(df: DataFrame, predictors: list[str], horizon: int = 24, *, manifest: dict | None = None,
                    row_count: int | None = None) -> list[str]:
    """What the table's schema, and its manifest where one is given, break of the training contract.

    No data is read: ``row_count`` is the caller's count, held against the manifest's output rows.
    """
    names, columns = set(predictors), set(df.columns)
    found = [(TARGET not in columns, "target column missing"),
             (not predictors or len(names) != len(predictors), "predictors must be non-empty and unique"),
             (names & set(FORBIDDEN_PREDICTORS), f"forbidden predictors: {sorted(names & set(FORBIDDEN_PREDICTORS))}"),
             (names - columns, f"declared columns missing: {sorted(names - columns)}"),
             ({*KEYS, *METADATA} - columns, f"key or metadata columns missing: {sorted({*KEYS, *METADATA} - columns)}"),
             (horizon != 24, "forecast horizon must be 24 hours for training")]
    if manifest is not None:
        metadata = set(manifest.get("metadata_columns") or ())
        typed = [c for group in ("numerical", "categorical", "boolean") for c in manifest.get(f"{group}_columns") or ()]
        types = set(manifest.get("expected_data_types") or ())
        extra = columns - {*KEYS, TARGET, *METADATA, *names, *metadata}
        outputs = manifest.get("output_row_count", row_count)
        found += [(manifest.get("target_column") != TARGET, "manifest names another target column"),
                  (tuple(manifest.get("key_columns") or ()) != KEYS, f"manifest keys must be {list(KEYS)}, in this order"),
                  (manifest.get("predictor_columns") != list(predictors), "manifest lists other predictors"),
                  (manifest.get("forecast_horizon_hours") != horizon, "manifest has another forecast horizon"),
                  (set(METADATA) - metadata, f"manifest metadata lacks {sorted(set(METADATA) - metadata)}"),
                  (metadata & names, f"predictors among the metadata: {sorted(metadata & names)}"),
                  (len(set(typed)) != len(typed), "a predictor is in two type groups"),
                  (set(typed) != names, f"predictors and type groups differ: {sorted(set(typed) ^ names)}"),
                  (types and not {*KEYS, TARGET, *names} <= types, "expected_data_types leaves columns out"),
                  (row_count is not None and outputs != row_count, f"manifest says {outputs} rows, the table has {row_count}"),
                  (outputs is not None and manifest.get("source_row_count", outputs) < outputs,
                   "manifest has more output rows than source rows"),
                  (extra, f"undeclared columns: {sorted(extra)}")]
    return [text for broken, text in found if broken]


def order_violations(df: DataFrame, position: str = "source_row", block_rows: int = S.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Rows whose timestamp is before that of their site's row in front of them.

    A Spark table has no order of its own, so ``position`` names the column that tells the input's order
    (``source_row`` of a CSV).  Only neighbours are compared, also across the borders of blocks.  Rows without
    site, timestamp or position take no part; equal timestamps are in order (they are ``duplicate_key``)."""
    rows = df.where(F.col("site_id").isNotNull() & F.col("timestamp").isNotNull() & F.col(position).isNotNull())
    seen = S.with_previous_row(rows.select("site_id", "timestamp", position), position, ["timestamp"], block_rows)
    return seen.where(F.col("timestamp") < F.col("prev_timestamp")).select(
        "site_id", position, "timestamp", F.col("prev_timestamp").alias("previous_timestamp"))


def row_issues(df: DataFrame, predictors: list[str], minimum_rows: dict[str, int] | None = None,
               position: str | None = None) -> DataFrame:
    """Row checks over all rows: keys present and unique, target finite and >= 0, split labels,
    no infinite predictor, ``minimum_rows`` eligible rows a split, and, where a ``position`` column tells
    the input's order, timestamps in order within each site; one row per failing check with the number of
    rows that fail it (that are missing, for a minimum)."""
    checks = [("null_key", F.col("site_id").isNull() | F.col("timestamp").isNull()),
              ("invalid_target", F.col(TARGET).isNull() | ~is_finite(F.col(TARGET)) | (F.col(TARGET) < 0)),
              ("invalid_split_label", F.col("split").isNull() | ~F.col("split").isin(list(SPLITS)))]
    checks += [(f"infinite_predictor:{p}", F.abs(F.col(p).cast("double")) == F.lit(float("inf"))) for p in predictors]
    agg = df.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, c) in enumerate(checks)],
                 *[F.count_if(F.col("split") == s).alias(f"s_{s}") for s in SPLITS],
                 *[F.count_if((F.col("split") == s) & F.col("feature_eligible")).alias(f"e_{s}") for s in SPLITS])
    long = agg.select(F.explode(F.array(
        *[F.struct(F.lit(n).alias("issue"), F.col(f"c{i}").alias("rows")) for i, (n, _) in enumerate(checks)],
        *[F.struct(F.lit(f"missing_split:{s}").alias("issue"),
                   F.when(F.col(f"s_{s}") == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("rows"))
          for s in SPLITS],
        *[F.struct(F.lit(f"too_few_eligible_rows:{s}").alias("issue"),
                   F.greatest(F.lit(m) - F.col(f"e_{s}"), F.lit(0)).cast("bigint").alias("rows"))
          for s, m in (minimum_rows or {}).items()])).alias("x")).select("x.*")
    dup = df.groupBy("site_id", "timestamp").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows")).select(
        F.lit("duplicate_key").alias("issue"), "rows")
    found = long.unionByName(dup)
    if position is not None:
        found = found.unionByName(order_violations(df, position).agg(F.count("*").alias("rows")).select(
            F.lit("not_sorted_within_site").alias("issue"), "rows"))
    return found.filter(F.col("rows") > 0)


def check_training_table(df: DataFrame, predictors: list[str], manifest: dict | None = None,
                         minimum_rows: dict[str, int] | None = None) -> None:
    """V15 and V16 before a training job: raise ValueError with everything that is wrong.

    A ``source_row`` column, where the table has one, is its order."""
    wrong = contract_issues(df.drop("source_row"), predictors, manifest=manifest,
                            row_count=None if manifest is None else df.count())
    position = "source_row" if "source_row" in df.columns else None
    if not wrong:  # one row a check
        wrong = [f"{r['issue']}: {r['rows']} rows" for r in row_issues(df, predictors, minimum_rows, position).collect()]
    if wrong:
        raise ValueError("; ".join(wrong))


def eligibility_audit(df: DataFrame) -> DataFrame:
    """Eligible / excluded rows by split and site."""
    return df.groupBy("split", "site_id").agg(F.count_if(F.col("feature_eligible")).alias("eligible_rows"),
                                              F.count_if(~F.col("feature_eligible")).alias("excluded_rows"))


def exclusion_reasons(df: DataFrame) -> DataFrame:
    """Reasons of excluded rows by split."""
    ex = df.filter(~F.col("feature_eligible")).select(
        "split", F.explode(F.split("feature_missing_reasons", ";")).alias("reason")).filter(F.col("reason") != "")
    return ex.groupBy("split", "reason").agg(F.count("*").alias("row_count"))


def constant_train_predictors(df: DataFrame, predictors: list[str]) -> DataFrame:
    """Predictors with <= 1 distinct non-null value on eligible train rows."""
    tr = df.filter((F.col("split") == "train") & F.col("feature_eligible"))
    agg = tr.agg(*[F.struct(F.lit(p).alias("predictor"), F.min(F.col(p).cast("double")).alias("lo"),
                            F.max(F.col(p).cast("double")).alias("hi")).alias(f"p{i}") for i, p in enumerate(predictors)])
    long = agg.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(predictors))])).alias("s")).select("s.*")
    return long.filter(F.col("lo").isNull() | (F.col("lo") == F.col("hi"))).select("predictor")


def eligible(df: DataFrame, split: str | None = None) -> DataFrame:
    out = df.filter(F.col("feature_eligible"))
    return out.filter(F.col("split") == split) if split else out

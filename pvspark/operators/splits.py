"""Chronological splits and rolling-origin folds.

The k-th distinct timestamp is found without a global sort through one task:
distinct timestamps are counted per day, a running sum over the (small) day
table locates the boundary day, and only that day's timestamps are ranked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvspark.operators.config import SplitProportions
from pvspark.schema import HOUR_US

SPLIT_NAMES = ("training", "validation", "testing")
FEATURE_SPLIT_NAMES = {"training": "train", "validation": "validation", "testing": "test"}


def day_counts(df: DataFrame, ts: str = "timestamp") -> list[tuple[object, int]]:
    """Distinct timestamps per UTC day, sorted (one row per calendar day)."""
    distinct = df.select(F.col(ts).alias("t")).distinct()
    rows = distinct.groupBy(F.date_trunc("day", "t").alias("day")).agg(F.count("*").alias("n")).collect()
    return sorted((r["day"], r["n"]) for r in rows)


def kth_distinct_timestamps(df: DataFrame, ranks: list[int], ts: str = "timestamp",
                            days: list[tuple[object, int]] | None = None) -> dict[int, object]:
    """1-based ranks of distinct timestamps -> timestamp, in two jobs.

    Job 1: distinct timestamps counted per day (rows = calendar days).  The
    boundary day of each rank follows from the running total on the driver.
    Job 2: only the boundary days' timestamps are ranked (partitioned by day).
    """
    days = days if days is not None else day_counts(df, ts)
    want: dict[object, list[tuple[int, int]]] = {}
    upto = 0
    targets = sorted(ranks)
    ti = 0
    for day, n in days:
        while ti < len(targets) and targets[ti] <= upto + n:
            want.setdefault(day, []).append((targets[ti], targets[ti] - upto))
            ti += 1
        upto += n
    out = {k: None for k in ranks}
    if not want:
        return out
    distinct = df.select(F.col(ts).alias("t")).distinct().withColumn("day", F.date_trunc("day", "t"))
    cond = None
    for day, picks in want.items():
        for _, pos in picks:
            c = (F.col("day") == F.lit(day)) & (F.col("r") == pos)
            cond = c if cond is None else cond | c
    ranked = distinct.filter(F.col("day").isin(list(want))).withColumn(
        "r", F.row_number().over(Window.partitionBy("day").orderBy("t")))
    found = {(r["day"], r["r"]): r["t"] for r in ranked.filter(cond).collect()}
    for day, picks in want.items():
        for k, pos in picks:
            out[k] = found.get((day, pos))
    return out


@dataclass
class SplitPlan:
    training_end: object
    validation_end: object
    counts: tuple[int, int, int]


def plan_chronological_splits(df: DataFrame, p: SplitProportions = SplitProportions()) -> SplitPlan:
    """Cut distinct timestamps at floor(n*p_train) and floor(n*p_val)."""
    days = day_counts(df)
    n = sum(c for _, c in days)
    train = int(math.floor(float(n) * p.training))
    val = int(math.floor(float(n) * p.validation))
    test = n - train - val
    if min(train, val, test) < 1:
        raise ValueError("Chronological split would contain an empty period; provide more unique timestamps.")
    ends = kth_distinct_timestamps(df, [train, train + val], days=days)
    return SplitPlan(ends[train], ends[train + val], (train, val, test))


def label_chronological(df: DataFrame, plan: SplitPlan, names=SPLIT_NAMES, col: str = "split") -> DataFrame:
    ts = F.col("timestamp")
    lab = (F.when(ts <= F.lit(plan.training_end), F.lit(names[0]))
           .when(ts <= F.lit(plan.validation_end), F.lit(names[1])).otherwise(F.lit(names[2])))
    return df.withColumn(col, lab)


def split_summary(labelled: DataFrame, col: str = "split") -> DataFrame:
    """Per split first/last timestamp, rows and distinct timestamps."""
    per_ts = labelled.groupBy(col, "timestamp").agg(F.count("*").alias("n"))
    return per_ts.groupBy(col).agg(
        F.min("timestamp").alias("beginning_timestamp"), F.max("timestamp").alias("ending_timestamp"),
        F.sum("n").alias("record_count"), F.count("*").alias("unique_timestamp_count"))


def split_site_counts(labelled: DataFrame, col: str = "split") -> DataFrame:
    """Rows by (split, site)."""
    return labelled.groupBy(col, "site_id").agg(F.count("*").alias("record_count"))


def periods_from_plan(plan: SplitPlan, labelled: DataFrame) -> list[tuple[str, object, object]]:
    """Feature-job periods (train/validation/test) with inclusive bounds."""
    rows = split_summary(labelled).collect()  # three rows
    by = {r["split"]: r for r in rows}
    return [(FEATURE_SPLIT_NAMES[n], by[n]["beginning_timestamp"], by[n]["ending_timestamp"]) for n in SPLIT_NAMES]


def check_split_plan(df: DataFrame, periods: list[tuple[str, object, object]],
                     planned_counts: dict[str, int] | None = None) -> DataFrame:
    """Ordered non-overlapping periods, every row labelled, optional
    record_count equality; returns a problems table (empty when valid)."""
    problems = []
    for name, s, e in periods:
        if s is None or e is None or s > e:
            problems.append(("invalid_split_plan", f"Invalid {name} boundaries."))
    for a, b in zip(periods, periods[1:]):
        if a[2] is not None and b[1] is not None and a[2] >= b[1]:
            problems.append(("invalid_split_plan", "Split periods overlap or are not chronological."))
            break
    spark = df.sparkSession
    static = spark.createDataFrame(problems, "code string, message string")
    from pvspark.operators.align import label_periods
    lab = label_periods(df, periods)
    unl = lab.agg(F.count_if(F.col("split").isNull()).alias("u")).filter(F.col("u") > 0).select(
        F.lit("split_plan_dataset_mismatch").alias("code"),
        F.lit("Every input timestamp must fall within exactly one split period.").alias("message"))
    out = static.unionByName(unl)
    if planned_counts:
        counts = lab.groupBy("split").agg(F.count("*").alias("n"))
        exp = spark.createDataFrame(list(planned_counts.items()), "split string, planned bigint")
        bad = exp.join(counts, "split", "left").filter(F.coalesce(F.col("n"), F.lit(0)) != F.col("planned")).select(
            F.lit("split_plan_dataset_mismatch").alias("code"),
            F.concat(F.col("split"), F.lit(" record_count does not match the input dataset.")).alias("message"))
        out = out.unionByName(bad)
    return out


def plan_count_issues(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Where the counts of a split plan (``io.read_split_plan``) differ from those of a labelled table.

    One row per period for its ``record_count``, and one per site for ``counts_by_site``: a wrong count, a site
    that the plan leaves out (``planned_count`` null) or one that the period does not have (``actual_count`` null).
    Counts that are no integer or no map differ from everything.
    """
    actual = df.where(F.col("site_id").isNotNull()).groupBy("split", F.col("site_id").cast("string")).agg(
        F.count("*").alias("actual_count"))
    rows = df.groupBy("split").agg(F.count("*").alias("actual_count"))
    totals = plan.where("has_record_count").join(rows, "split", "left").select(
        "period", F.lit("record_count").alias("what"), F.lit(None).cast("string").alias("site_id"),
        F.col("record_count").alias("planned_count"), F.coalesce("actual_count", F.lit(0)).alias("actual_count"))
    named = plan.where("counts_by_site IS NOT NULL")
    planned = named.select("period", "split", F.explode("counts_by_site").alias("site_id", "planned_count"))
    sites = planned.join(actual.join(named.select("period", "split"), "split"), ["period", "split", "site_id"], "full").select(
        "period", F.lit("counts_by_site").alias("what"), "site_id", "planned_count", "actual_count")
    unread = plan.where("has_counts_by_site AND counts_by_site IS NULL").select(
        "period", F.lit("counts_by_site").alias("what"), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("site_id", "string"), ("planned_count", "long"), ("actual_count", "long"))])
    differs = ~F.col("planned_count").eqNullSafe(F.col("actual_count"))
    return totals.unionByName(sites).where(differs).unionByName(unread).select(
        F.lit("split_plan_dataset_mismatch").alias("code"),
        F.concat("period", F.lit(" "), "what", F.lit(" does not match the input dataset.")).alias("message"),
        "site_id", "planned_count", "actual_count")


def split_order_checks(df: DataFrame, minimum_rows: dict[str, int] | None = None) -> DataFrame:
    """Minimum rows per split and train.end < val.start <= val.end < test.start."""
    s = df.groupBy("split").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    g = s.agg(*[F.max(F.when(F.col("split") == k, F.col(c))).alias(f"{k}_{c}")
                for k in ("train", "validation", "test") for c in ("n", "lo", "hi")])
    checks = [F.when(~(F.col("train_hi") < F.col("validation_lo")) | ~(F.col("validation_lo") <= F.col("validation_hi"))
                     | ~(F.col("validation_hi") < F.col("test_lo")), F.lit("split boundaries are not strictly ordered"))]
    for k, m in (minimum_rows or {}).items():
        checks.append(F.when(F.coalesce(F.col(f"{k}_n"), F.lit(0)) < m, F.lit(f"{k} split has fewer than {m} rows")))
    return g.select(F.explode(F.array_compact(F.array(*checks))).alias("problem"))


# ---------------------------------------------------------------- W8 / J9
@dataclass
class FoldSpec:
    n_splits: int
    gap_hours: int
    minimum_training_hours: int
    validation_window_hours: int

    def __post_init__(self):
        if self.n_splits < 2:
            raise ValueError("n_splits must be at least 2")
        if min(self.gap_hours, self.minimum_training_hours, self.validation_window_hours) <= 0:
            raise ValueError("rolling-origin durations must be positive")


def rolling_origin_folds(df: DataFrame, spec: FoldSpec) -> DataFrame:
    """Fold boundaries (n rows) from one global min/max aggregate."""
    bounds = df.agg(F.min(F.unix_micros("timestamp")).alias("t0"), F.max(F.unix_micros("timestamp")).alias("t1")).first()
    if bounds["t0"] is None:
        raise ValueError("cannot split an empty training frame")
    required = spec.minimum_training_hours + spec.gap_hours + spec.n_splits * spec.validation_window_hours
    available = (bounds["t1"] - bounds["t0"]) // HOUR_US + 1
    if available < required:
        raise ValueError(f"insufficient training history: need at least {required} hourly periods; found {available}")
    spark = df.sparkSession
    v, g = spec.validation_window_hours * HOUR_US, (spec.gap_hours + 1) * HOUR_US
    first_val = bounds["t1"] - (spec.n_splits * spec.validation_window_hours - 1) * HOUR_US
    rows = spark.range(spec.n_splits).select((F.col("id") + 1).cast("int").alias("fold_number"),
                                              (F.lit(first_val) + F.col("id") * v).alias("vs"))
    return rows.select(
        "fold_number",
        F.timestamp_micros(F.col("vs") - g).alias("training_end"),
        F.timestamp_micros(F.col("vs") - g + HOUR_US).alias("gap_start"),
        F.timestamp_micros(F.col("vs") - HOUR_US).alias("gap_end"),
        F.timestamp_micros("vs").alias("validation_start"),
        F.timestamp_micros(F.col("vs") + v - HOUR_US).alias("validation_end"))


def fold_membership(df: DataFrame, folds: DataFrame) -> DataFrame:
    """(row, fold, role) — a row is training for every fold whose
    training_end it precedes, validation for at most one fold.

    The fold table has ``n_splits`` rows (a configuration value); its bounds
    become literal conditions and one ``explode`` replaces a theta join.
    """
    fs = folds.collect()
    ts = F.col("timestamp")
    items = []
    for f in fs:
        items.append(F.when(ts <= F.lit(f["training_end"]),
                            F.struct(F.lit(f["fold_number"]).alias("fold_number"), F.lit("training").alias("role"))))
        items.append(F.when((ts >= F.lit(f["validation_start"])) & (ts <= F.lit(f["validation_end"])),
                            F.struct(F.lit(f["fold_number"]).alias("fold_number"), F.lit("validation").alias("role"))))
    return df.select("*", F.explode(F.array_compact(F.array(*items))).alias("_m")).select(
        "*", "_m.fold_number", "_m.role").drop("_m")


def fold_summary(members: DataFrame, folds: DataFrame) -> DataFrame:
    """A28 / fold boundary audit: rows, sites and training start per fold and role."""
    per = members.groupBy("fold_number", "role", "site_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"))
    s = per.groupBy("fold_number").agg(
        F.sum(F.when(F.col("role") == "training", F.col("n"))).alias("training_row_count"),
        F.sum(F.when(F.col("role") == "validation", F.col("n"))).alias("validation_row_count"),
        F.count_if(F.col("role") == "training").alias("training_site_count"),
        F.count_if(F.col("role") == "validation").alias("validation_site_count"),
        F.min(F.when(F.col("role") == "training", F.col("lo"))).alias("training_start"))
    return folds.join(s, "fold_number", "left")


def fold_site_counts(members: DataFrame) -> DataFrame:
    """Eligible rows by (fold, site, role)."""
    return members.groupBy("fold_number", "site_id", "role").agg(F.count("*").alias("row_count"))

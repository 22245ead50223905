"""Forecast metrics, cohorts and prediction reports.

Predictions are long: one row per (key, model_identifier, prediction); every
metric is a mergeable aggregate per group, so many models, sites and
cohorts are evaluated in one pass.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvspark.functions import is_finite
from pvspark.functions.quantiles import exact_percentiles
from pvspark.schema import TARGET
from pvspark.session import cut_lineage


def metric_aggs(y: Column, p: Column, capacity: Column | None = None) -> list[Column]:
    """A21 aggregates (before the final projection in :func:`finish_metrics`)."""
    e = p - y
    aggs = [
        F.count("*").alias("prediction_count"),
        F.avg(F.abs(e)).alias("_mae"),
        F.avg(e * e).alias("_mse"),
        F.avg(e).alias("mean_bias_error_kwh"),
        F.sum(F.abs(e)).alias("_sae"),
        F.sum(y).alias("actual_total_energy_kwh"),
        F.sum(p).alias("predicted_total_energy_kwh"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(y).alias("_vary"),
    ]
    if capacity is not None:
        ok = is_finite(capacity) & (capacity > 0)
        ce = F.when(ok, e / capacity)
        aggs += [F.avg(F.abs(ce)).alias("capacity_normalised_mae_kwh_per_kwp"),
                 F.sqrt(F.avg(ce * ce)).alias("capacity_normalised_rmse_kwh_per_kwp")]
    return aggs


def finish_metrics(agg: DataFrame, full_row_count: Column | None = None) -> DataFrame:
    """R² follows the scikit-learn convention (constant target: 1.0 if
    perfect else 0.0); NULL for fewer than two rows.  WAPE divides by Σy."""
    n = F.col("prediction_count")
    sst = F.col("_vary") * n
    r2 = (F.when(n < 2, F.lit(None).cast("double"))
          .when(sst == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1 - F.col("_sse") / sst))
    coverage = F.lit(100.0) if full_row_count is None else F.when(
        full_row_count > 0, 100.0 * n / full_row_count).otherwise(F.lit(100.0))
    return (agg.withColumn("mae_kwh", F.col("_mae"))
               .withColumn("rmse_kwh", F.sqrt("_mse"))
               .withColumn("r2", r2)
               .withColumn("wape", F.when(F.col("actual_total_energy_kwh") > 0,
                                          F.col("_sae") / F.col("actual_total_energy_kwh")))
               .withColumn("prediction_coverage_pct", coverage)
               .drop("_mae", "_mse", "_sae", "_sse", "_vary"))


def forecast_metrics(df: DataFrame, group_cols: list[str], y: str = TARGET, p: str = "prediction",
                     capacity: str | None = None, full_row_count: Column | None = None) -> DataFrame:
    """A21 per group (e.g. per model); A22 when ``site_id`` is a group column.

    The median absolute error is an exact two-pass selection
    (``functions.quantiles``), so no task holds a whole group's errors.
    """
    g = list(group_cols)
    cap = F.col(capacity) if capacity else None
    agg = df.groupBy(*g).agg(*metric_aggs(F.col(y), F.col(p), cap))
    ae = df.select(*g, F.abs(F.col(p) - F.col(y)).alias("_ae"))
    med = exact_percentiles(ae, g, "_ae", [0.5], ["median_absolute_error_kwh"])
    if g:
        agg = agg.join(med, g, "left")
    else:  # one global row: a scalar subquery, not a join
        agg = agg.withColumn("median_absolute_error_kwh", med.select("median_absolute_error_kwh").scalar())
    return finish_metrics(agg, full_row_count)


def daylight_metrics(df: DataFrame, group_cols: list[str], y: str = TARGET, p: str = "prediction") -> DataFrame:
    """Metrics on daylight rows; coverage relative to all rows of the group.

    A group without daylight rows, or a table without the flag, has null metrics.
    """
    full = df.groupBy(*group_cols).agg(F.count("*").alias("_full"))
    flag = F.col("is_daylight") == 1 if "is_daylight" in df.columns else F.lit(False)
    m = forecast_metrics(df.filter(flag), group_cols, y, p)
    return full.join(m, group_cols, "left").withColumn(
        "prediction_coverage_pct", 100.0 * F.col("prediction_count") / F.col("_full")).drop("_full")


# ------------------------------------------------------------------ M10
def fold_metrics(scored: DataFrame, by: list[str] = (), clip: bool = True, daylight: bool = False) -> DataFrame:
    """Metrics of raw fold predictions per candidate and fold, and per ``by`` (``["site_id"]``: per-site record).

    Negative predictions are counted, then raised to 0 where ``clip`` is set.  ``daylight`` restricts
    the metrics to daylight rows, with the coverage relative to all rows of the fold.
    """
    g = ["candidate_id", "fold_number", *by]
    out = postprocess(scored) if clip else scored
    if daylight:
        return daylight_metrics(out, g)
    return forecast_metrics(out, g).join(negative_counts(scored, g), g)


def fold_record(scored: DataFrame, clip: bool = True) -> DataFrame:
    """One record per candidate and fold: its metrics, the struct ``daylight`` and the map ``by_site`` of the same.

    Every prediction goes into its cohorts (fold, site, daylight) as it is read, so one grouping computes
    all of them.  Daylight coverage is relative to the fold's rows; without the flag or without such
    rows the struct is null.  Without ``site_id`` the map is empty; a null site counts as ``''``.
    """
    g = ["candidate_id", "fold_number"]
    out = scored.withColumn("_negative", F.col("prediction") < 0)
    out = out.withColumn("prediction", F.greatest("prediction", F.lit(0.0))) if clip else out
    cohorts = [F.struct(F.lit("fold").alias("cohort"), F.lit("").alias("site"))]
    if "site_id" in scored.columns:
        cohorts.append(F.struct(F.lit("site").alias("cohort"), F.coalesce("site_id", F.lit("")).alias("site")))
    if "is_daylight" in scored.columns:
        cohorts.append(F.when(F.col("is_daylight") == 1, F.struct(F.lit("daylight").alias("cohort"), F.lit("").alias("site"))))
    rows = out.select(*g, TARGET, "prediction", "_negative",
                      F.explode(F.array_compact(F.array(*cohorts))).alias("_c")).select("*", "_c.*").drop("_c")
    key = [*g, "cohort", "site"]
    e = F.col("prediction") - F.col(TARGET)
    agg = rows.groupBy(*key).agg(*metric_aggs(F.col(TARGET), F.col("prediction")),
                                 F.count_if("_negative").alias("negative_raw_prediction_count"))
    med = exact_percentiles(rows.select(*key, F.abs(e).alias("_ae")), key, "_ae", [0.5], ["median_absolute_error_kwh"])
    each = finish_metrics(agg.join(med, key, "left"))
    names = [c for c in each.columns if c not in key]
    record = F.struct(*names)
    each = each.groupBy(*g).agg(
        F.first(F.when(F.col("cohort") == "fold", record), ignorenulls=True).alias("_fold"),
        F.first(F.when(F.col("cohort") == "daylight", record), ignorenulls=True).alias("daylight"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("cohort") == "site", F.struct("site", record)))))
        .alias("by_site"))
    covered = 100.0 * F.col("daylight.prediction_count") / F.col("_fold.prediction_count")
    return each.select(*g, "_fold.*", F.when(F.col("daylight").isNotNull(), F.col("daylight").withField(
        "prediction_coverage_pct", covered)).alias("daylight"), "by_site")


# ------------------------------------------------------------------ J10
def common_cohort(wide: DataFrame, persistence: str, models: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows where persistence and every model prediction are finite.

    Returns (cohort rows, summary row, reason counts with zero counts dropped).
    """
    ok = is_finite(F.col(persistence))
    for m in models:
        ok = ok & is_finite(F.col(m))
    cohort = wide.filter(ok)
    reasons = [F.count_if(~is_finite(F.col(persistence))).alias("persistence_unavailable")]
    reasons += [F.count_if(~is_finite(F.col(m))).alias(f"{m}_prediction_unavailable") for m in models]
    agg = wide.agg(F.count("*").alias("full_row_count"), F.count_if(ok).alias("common_comparison_row_count"), *reasons)
    summary = agg.select(
        "full_row_count", "common_comparison_row_count",
        F.when(F.col("full_row_count") > 0, 100.0 * F.col("common_comparison_row_count") / F.col("full_row_count"))
        .otherwise(F.lit(0.0)).alias("comparison_coverage_pct"),
        (F.col("full_row_count") - F.col("common_comparison_row_count")).alias("excluded_comparison_row_count"))
    names = ["persistence_unavailable"] + [f"{m}_prediction_unavailable" for m in models]
    counts = agg.select(F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("row_count"))
                                             for n in names])).alias("r")).select("r.*").filter(F.col("row_count") > 0)
    return cohort, summary, counts


def to_long(wide: DataFrame, keep: list[str], models: list[str]) -> DataFrame:
    """Wide prediction columns -> (keep..., model_identifier, prediction)."""
    return wide.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(m).alias("model_identifier"), F.col(m).cast("double").alias("prediction")) for m in models
    ])).alias("_m")).select(*keep, "_m.model_identifier", "_m.prediction")


# ------------------------------------------------------------------ A26 / F13
def postprocess(df: DataFrame, p: str = "prediction", clip_negative: bool = True) -> DataFrame:
    """``raw_negative`` flag and clipped prediction (V20 checks finiteness)."""
    out = df.withColumn("raw_negative", F.col(p) < 0)
    return out.withColumn(p, F.greatest(F.col(p), F.lit(0.0))) if clip_negative else out


def negative_counts(df: DataFrame, group_cols: list[str], p: str = "prediction") -> DataFrame:
    return df.groupBy(*group_cols).agg(F.count_if(F.col(p) < 0).alias("negative_raw_prediction_count"))


def prediction_frame(df: DataFrame, model_col: str = "model_identifier", p: str = "prediction") -> DataFrame:
    """narrow prediction report; no predictor columns leak."""
    resid = F.col(TARGET) - F.col(p)
    cols = [F.col("timestamp"), F.col("site_id"), F.col("split"), F.col(TARGET).alias("actual_ac_energy_kwh"),
            F.col(p).alias("prediction"), resid.alias("residual"), F.abs(resid).alias("absolute_error"),
            (resid * resid).alias("squared_error")]
    if "is_daylight" in df.columns:
        cols.append(F.col("is_daylight"))
    return df.select(*cols, F.col(model_col).alias("model_identifier"))


# ------------------------------------------------------------------ W13
def cumulative_energy(report: DataFrame, group_cols: list[str] = ("model_identifier",), block: str = "month") -> DataFrame:
    """Running actual and predicted totals in (timestamp, site) order.

    Prefix sums on three levels, so that no window spans a model's timestamps: the totals of the blocks
    before (``block``, a unit of ``date_trunc``; one row per block), of the timestamps before within the
    block, and of the sites up to the row within its timestamp.  Rows without a timestamp come first, as
    a block of their own.
    """
    g, sums = list(group_cols), ("actual_ac_energy_kwh", "prediction")
    spark = report.sparkSession
    rows = report.select(*g, "timestamp", "site_id", *sums, F.date_trunc(block, "timestamp").alias("_block"))
    per_ts = cut_lineage(rows.groupBy(*g, "_block", "timestamp").agg(*[F.sum(c).alias(c) for c in sums]), spark)

    def before(table: DataFrame, within: list[str], order: str, keys: list[str], prefix: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, -1)
        return table.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys],
                            *[F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(f"{prefix}{c}") for c in sums])

    def with_offsets(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & left[k].eqNullSafe(right[f"{prefix}{k}"])
        return left.join(right, same).drop(*[f"{prefix}{k}" for k in keys])

    blocks = per_ts.groupBy(*g, "_block").agg(*[F.sum(c).alias(c) for c in sums])
    rows = with_offsets(rows, before(per_ts, [*g, "_block"], "timestamp", [*g, "_block", "timestamp"], "_t_"),
                        [*g, "_block", "timestamp"], "_t_")
    rows = with_offsets(rows, before(blocks, g, "_block", [*g, "_block"], "_b_"), [*g, "_block"], "_b_")
    here = Window.partitionBy(*g, "timestamp").orderBy("site_id").rowsBetween(Window.unboundedPreceding, 0)
    total = {c: F.col(f"_b_{c}") + F.col(f"_t_{c}") + F.sum(c).over(here) for c in sums}
    return rows.select(*g, "timestamp", "site_id", total[sums[0]].alias("cumulative_actual_kwh"),
                       total[sums[1]].alias("cumulative_predicted_kwh"))


# ------------------------------------------------------------------ A24
def g_format(c: Column) -> Column:
    """Python ``{x:g}``: six significant digits without trailing zeros.

    What is rounded is the double's own binary value, as Python does it: quartiles of prices often end in a
    seventh digit 5, and there the shortest decimal text does not tell on which side of the tie the double lies.
    Between 1e-4 and 1e6 the value is taken as a whole number of 2^-64; outside, its shortest text is rounded (null below 1e-323).
    """
    x = c.cast("double")
    y = F.abs(x)
    power = lambda e: F.pow(F.lit(10.0), e)

    def strip(s: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    def whole(v: Column, digits: int = 20) -> Column:
        return v.cast(f"decimal({digits},0)")

    e = F.floor(F.log10(y))
    e = F.when(power(e) > y, e - 1).otherwise(e)
    two32, two64 = F.lit(Decimal(1 << 32)), F.lit(Decimal(1 << 64))
    z = F.when((y >= 1e-4) & (y < 999999.5), y)  # null outside, and so is all that follows from it
    high = (z - F.floor(z)) * float(1 << 32)
    units = whole(F.floor(z), 10) * two64 + whole(F.floor(high)) * two32 + whole(F.floor((high - F.floor(high)) * float(1 << 32)))
    scale = whole(power(5 - F.when(z.isNotNull(), e)), 10)  # 10^0 to 10^9
    scaled = whole(units * scale, 38)
    rest = scaled % two64
    kept = whole((scaled - rest) / two64)
    half = F.lit(Decimal(1 << 63))
    kept = kept + F.when((rest > half) | ((rest == half) & (kept % 2 == 1)), 1).otherwise(0)
    near = strip((kept / scale).cast("decimal(24,10)").cast("string"))

    digits = F.bround(F.try_divide(y, power(e)), 5)  # rounding can reach the next power of ten
    e, digits = F.when(digits >= 10, e + 1).otherwise(e), F.when(digits >= 10, digits / 10).otherwise(digits)
    exponent = F.concat(F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
    far = F.concat(strip(digits.cast("decimal(12,5)").cast("string")), F.lit("e"), exponent)
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), F.coalesce(near, far)))


def robustness(df: DataFrame, y: str = TARGET, p: str = "prediction", group_cols: list[str] = ()) -> DataFrame:
    """Metrics per descriptive cohort in one pass.

    Thresholds (medians of GHI and cloud cover, terciles of positive targets)
    come from the exact selection; cohorts of absent columns are left out; each row is exploded into every cohort it
    belongs to and a single ``groupBy`` computes all cohort metrics.
    """
    g = list(group_cols)
    has = set(df.columns)
    number = {"ghi": "ghi_w_m2", "cc": "cloud_cover_pct"}
    kinds = [F.struct(F.lit(k).alias("kind"), F.when(is_finite(F.col(c)), F.col(c).cast("double")).alias("v"))
             for k, c in number.items() if c in has]
    kinds.append(F.struct(F.lit("y").alias("kind"), F.when(F.col(y) > 0, F.col(y).cast("double")).alias("v")))
    values = df.select(*g, F.explode(F.array(*kinds)).alias("_k")).select(*g, "_k.kind", "_k.v")
    cut = exact_percentiles(values, [*g, "kind"], "v", [1 / 3, 0.5, 2 / 3], ["a", "b", "c"])
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    third = F.when(of("y", "a").isNotNull(), F.array(of("y", "a"), of("y", "c")))
    th = cut.groupBy(*g).agg(of("ghi", "b").alias("_ghi_med"), of("cc", "b").alias("_cc_med"), third.alias("_terc"))
    if g:
        rows = df.join(th, g, "left")
    else:  # one threshold row: a scalar subquery per threshold, no join
        rows = df.withColumns({k: th.select(k).scalar() for k in ("_ghi_med", "_cc_med", "_terc")})
    ts = F.col("timestamp")

    def c(t, v, cond=None):
        s = F.struct(F.lit(t).alias("cohort_type"), v.cast("string").alias("cohort_value"))
        return s if cond is None else F.when(cond, s)

    ghi, cc, tgt = F.col("ghi_w_m2"), F.col("cloud_cover_pct"), F.col(y)
    lo, hi = F.col("_terc")[0], F.col("_terc")[1]
    absent = {"is_daylight": ("daylight",), "ghi_w_m2": ("irradiance",), "cloud_cover_pct": ("cloud_cover",)}
    skip = {t for col, types in absent.items() if col not in has for t in types}
    rows = rows.withColumns({col: F.lit(None).cast("double") for col in absent if col not in has})
    items = [
        c("site", F.col("site_id")),
        c("utc_hour", F.hour(ts)),
        c("utc_month", F.month(ts)),
        c("daylight", F.lit("daylight"), F.col("is_daylight") == 1),
        c("daylight", F.lit("non_daylight"), F.coalesce(F.col("is_daylight"), F.lit(0)) != 1),
        c("irradiance", F.concat(F.lit("low_le_"), g_format(F.col("_ghi_med"))), is_finite(ghi) & (ghi <= F.col("_ghi_med"))),
        c("irradiance", F.concat(F.lit("high_gt_"), g_format(F.col("_ghi_med"))), is_finite(ghi) & (ghi > F.col("_ghi_med"))),
        c("cloud_cover", F.concat(F.lit("low_le_"), g_format(F.col("_cc_med"))), is_finite(cc) & (cc <= F.col("_cc_med"))),
        c("cloud_cover", F.concat(F.lit("high_gt_"), g_format(F.col("_cc_med"))), is_finite(cc) & (cc > F.col("_cc_med"))),
        c("target_magnitude", F.lit("zero"), F.col("_terc").isNotNull() & ~(tgt > 0)),
        c("target_magnitude", F.lit("low"), (tgt > 0) & (tgt <= lo)),
        c("target_magnitude", F.lit("medium"), (tgt > lo) & (tgt <= hi)),
        c("target_magnitude", F.lit("high"), tgt > hi),
    ]
    ex = rows.select(*g, y, p, F.explode(F.array_compact(F.array(*items))).alias("_c")).select(
        *g, y, p, "_c.cohort_type", "_c.cohort_value").filter(~F.col("cohort_type").isin(*skip) if skip else F.lit(True))
    m = forecast_metrics(ex, [*g, "cohort_type", "cohort_value"], y, p)
    return m.withColumn("small_cohort", F.col("prediction_count") < 30)

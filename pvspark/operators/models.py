"""Model building with pyspark.ml.

Preprocessing fitted on training rows is expressed as a ``SQLTransformer``
whose statement carries the fitted constants (medians, means, scales), so a
fitted model is one ``PipelineModel`` (SQL -> VectorAssembler -> estimator)
that saves, reloads and scores like any Spark ML model.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from pvspark.schema import TARGET
from pvspark.session import checkpoint_dir, cut_lineage

MODEL_IDS = ("persistence", "dummy_mean", "ridge", "random_forest", "histogram_gradient_boosting")


@dataclass(frozen=True)
class TrainingConfig:
    random_seed: int = 42
    clip_negative_predictions: bool = True
    enabled_models: tuple[str, ...] = MODEL_IDS
    persistence_lag_hours: int = 24
    random_forest_estimators: int = 100
    random_forest_max_depth: int = 12
    random_forest_min_samples_leaf: int = 2
    histogram_boosting_max_iter: int = 100
    histogram_boosting_learning_rate: float = 0.1
    histogram_boosting_max_depth: int = 4  # ~16 leaves (reference caps leaves at 15)
    ridge_alpha: float = 1.0
    permutation_importance_repeats: int = 5
    refit_selected_model_on_train_validation: bool = True
    minimum_train_rows: int = 24
    minimum_validation_rows: int = 12
    minimum_test_rows: int = 12

    def __post_init__(self):
        bad = sorted(set(self.enabled_models) - set(MODEL_IDS))
        if bad:
            raise ValueError(f"unsupported models: {bad}")
        if not self.enabled_models or len(set(self.enabled_models)) != len(self.enabled_models):
            raise ValueError("enabled_models must be non-empty and unique")

    @property
    def minimum_rows(self) -> dict[str, int]:
        """Eligible rows that each split needs."""
        return {"train": self.minimum_train_rows, "validation": self.minimum_validation_rows, "test": self.minimum_test_rows}


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _num(x: float) -> str:
    return f"CAST('{repr(float(x))}' AS DOUBLE)"


# ------------------------------------------------------------------ M1-M3
@dataclass
class FittedPreprocessing:
    statement: str
    feature_columns: list[str]
    output_names: list[str]
    dropped: list[str] = field(default_factory=list)
    categorical_stages: list = field(default_factory=list)


def fill_statistics(train: DataFrame, numeric: list[str], categorical: list[str] = ()) -> dict:
    """What preprocessing of these training rows needs besides scaling: exact medians (linear interpolation, not
    ``ml.Imputer``'s lower-rank pick), null counts and modes.  Models of the same rows share one fit of it.
    """
    st = {}
    if categorical:
        st = train.agg(*[F.mode(F.col(c), deterministic=True).alias(f"c{j}") for j, c in enumerate(categorical)]).first().asDict()
    if numeric:  # one row per column
        for r in imputation_table(train, numeric).collect():
            i = numeric.index(r["feature"])
            st[f"m{i}"], st[f"n{i}"] = r["median"], r["train_missing_count"]
    return st


def fit_preprocessing(train: DataFrame, numeric: list[str], *, scale: bool, categorical: list[str] = (),
                      statistics: dict | None = None) -> FittedPreprocessing:
    """M1 median imputation + missing indicators (columns with training NULLs;
    all-NULL columns dropped, their indicator kept), M2 optional standardising
    (population std, zero std -> 1), M3 most-frequent fill for categoricals.
    ``statistics`` are the rows' ``fill_statistics`` where the caller has them.
    """
    st = fill_statistics(train, numeric, categorical) if statistics is None else statistics
    exprs, names, dropped, indicators = [], [], [], []
    for i, c in enumerate(numeric):
        med, nnull = st.get(f"m{i}"), st.get(f"n{i}")
        if nnull:
            indicators.append((c, f"CAST({_q(c)} IS NULL AS DOUBLE)"))
        if med is None:
            dropped.append(c)
            continue
        exprs.append((c, f"coalesce(CAST({_q(c)} AS DOUBLE), {_num(med)})"))
    cols = exprs + [(f"missingindicator_{c}", e) for c, e in indicators]
    if scale and cols:
        moments = train.select(*[F.expr(e).alias(f"v{k}") for k, (_, e) in enumerate(cols)]).agg(
            *[F.avg(f"v{k}").alias(f"a{k}") for k in range(len(cols))],
            *[F.stddev_pop(f"v{k}").alias(f"s{k}") for k in range(len(cols))]).first()
        scaled = []
        for k, (n, e) in enumerate(cols):
            s = moments[f"s{k}"] or 0.0
            s = 1.0 if s == 0 else s
            scaled.append((n, f"(({e}) - {_num(moments[f'a{k}'])}) / {_num(s)}"))
        cols = scaled
    cat_sql, stages = [], []
    for j, c in enumerate(categorical):
        cat_sql.append(f"coalesce(CAST({_q(c)} AS STRING), '{str(st[f'c{j}']).replace(chr(39), chr(39) * 2)}') AS `__c{j}`")
        stages += [StringIndexer(inputCol=f"__c{j}", outputCol=f"__ci{j}", handleInvalid="keep"),
                   OneHotEncoder(inputCol=f"__ci{j}", outputCol=f"__co{j}", dropLast=True)]
    select = [f"{e} AS `__f{k}`" for k, (_, e) in enumerate(cols)] + cat_sql
    statement = "SELECT *" + "".join(", " + s for s in select) + " FROM __THIS__"
    feats = [f"__f{k}" for k in range(len(cols))] + [f"__co{j}" for j in range(len(categorical))]
    return FittedPreprocessing(statement, feats, [n for n, _ in cols] + list(categorical), dropped, stages)


# ------------------------------------------------------------------ M4-M8
def _estimator(model_id: str, cfg: TrainingConfig, train: DataFrame, params: dict | None = None):
    seed = cfg.random_seed
    if model_id == "ridge":
        st = train.agg(F.stddev_pop(TARGET).alias("s"), F.count("*").alias("n")).first()
        reg = cfg.ridge_alpha * (st["s"] or 0.0) / max(st["n"], 1)
        return LinearRegression(featuresCol="features", labelCol=TARGET, solver="normal", standardization=False,
                                elasticNetParam=0.0, regParam=reg, fitIntercept=True)
    if model_id == "random_forest":
        if cfg.random_forest_max_depth > 30:
            raise ValueError("random_forest_max_depth: Spark's trees have at most 30 levels")
        return RandomForestRegressor(featuresCol="features", labelCol=TARGET, numTrees=cfg.random_forest_estimators,
                                     maxDepth=cfg.random_forest_max_depth,
                                     minInstancesPerNode=cfg.random_forest_min_samples_leaf,
                                     featureSubsetStrategy="all", seed=seed)
    if model_id == "histogram_gradient_boosting":
        return GBTRegressor(featuresCol="features", labelCol=TARGET, maxIter=cfg.histogram_boosting_max_iter,
                            stepSize=cfg.histogram_boosting_learning_rate, maxDepth=cfg.histogram_boosting_max_depth,
                            seed=seed)
    if model_id == "tuned_xgboost":
        p = params or {}
        return GBTRegressor(featuresCol="features", labelCol=TARGET, maxIter=int(p["n_estimators"]),
                            maxDepth=int(p["max_depth"]), stepSize=float(p["learning_rate"]),
                            minInstancesPerNode=max(1, int(math.ceil(float(p["min_child_weight"])))),
                            subsamplingRate=float(p["subsample"]),
                            featureSubsetStrategy=repr(float(p["colsample_bytree"])) if float(p["colsample_bytree"]) < 1 else "all",
                            minInfoGain=float(p["gamma"]), seed=seed)
    raise ValueError(f"unsupported model: {model_id}")


def fit_model(train: DataFrame, predictors: list[str], model_id: str, cfg: TrainingConfig = TrainingConfig(),
              params: dict | None = None, categorical: list[str] = (), statistics: dict | None = None) -> PipelineModel:
    """Fit one model (preprocessing included) on the training rows; ``statistics`` as in ``fit_preprocessing``."""
    if model_id == "dummy_mean":
        mean = train.agg(F.avg(TARGET)).first()[0]
        sql = SQLTransformer(statement=f"SELECT *, {_num(mean)} AS prediction FROM __THIS__")
        return Pipeline(stages=[sql]).fit(train)
    if model_id == "persistence":
        col = f"ac_energy_lag_{cfg.persistence_lag_hours}h"
        sql = SQLTransformer(statement=f"SELECT *, CAST({_q(col)} AS DOUBLE) AS prediction FROM __THIS__")
        return Pipeline(stages=[sql]).fit(train)
    numeric = [p for p in predictors if p not in categorical]
    prep = fit_preprocessing(train, numeric, scale=(model_id == "ridge"), categorical=list(categorical),
                             statistics=statistics)
    stages = [SQLTransformer(statement=prep.statement), *prep.categorical_stages,
              VectorAssembler(inputCols=prep.feature_columns, outputCol="features", handleInvalid="keep"),
              _estimator(model_id, cfg, train, params)]
    return Pipeline(stages=stages).fit(train)


def fit_models(train: DataFrame, predictors: list[str], model_ids: list[str], cfg: TrainingConfig = TrainingConfig(),
               params: dict | None = None, statistics: dict | None = None) -> dict[str, PipelineModel]:
    """``fit_model`` for each id, at once: they do not depend on each other, and the many small jobs of boosting
    run on the cores that the passes of the forest leave idle.  ``params`` are those of ``tuned_xgboost``."""
    with ThreadPoolExecutor(max_workers=max(1, len(model_ids))) as pool:
        fitted = pool.map(lambda m: fit_model(train, predictors, m, cfg, params if m == "tuned_xgboost" else None,
                                              statistics=statistics), model_ids)
        return dict(zip(model_ids, fitted, strict=True))


def predict(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Score rows; only ``keep`` columns and ``prediction`` are returned."""
    return model.transform(df).select(*keep, F.col("prediction").cast("double").alias("prediction"))


# ------------------------------------------------------------------ M9
# The default tuning search space (nine lists, in this order).
DEFAULT_SEARCH_SPACE = {
    "n_estimators": (200, 350, 500, 750, 1000),
    "max_depth": (2, 3, 4, 5, 6, 8),
    "learning_rate": (0.01, 0.03, 0.05, 0.08, 0.1, 0.15),
    "min_child_weight": (1.0, 3.0, 5.0, 10.0, 15.0),
    "subsample": (0.65, 0.75, 0.85, 1.0),
    "colsample_bytree": (0.65, 0.75, 0.85, 1.0),
    "reg_alpha": (0.0, 0.1, 1.0, 5.0, 10.0),
    "reg_lambda": (0.1, 1.0, 5.0, 10.0, 20.0),
    "gamma": (0.0, 0.1, 0.5, 1.0, 5.0),
}
UNUSED_BY_SPARK = ("reg_alpha", "reg_lambda")  # kept in the record, no GBT equivalent


def candidate_grid(spark, space: dict = DEFAULT_SEARCH_SPACE, budget: int = 24, seed: int = 42) -> DataFrame:
    """M9: deterministic sample of the Cartesian product of the nine lists.

    The product is never materialised on the driver: ``spark.range`` numbers
    the combinations, a mixed-radix decode maps an index to its values, and a
    seeded ``xxhash64`` order picks the first ``budget`` (a top-k).  The id is
    ``xgb-`` + 10 hex digits of SHA-256 of the canonical (sorted-key) JSON.
    """
    names = list(space)
    sizes = [len(space[n]) for n in names]
    total = math.prod(sizes)
    idx = F.col("id")
    cols, stride = [], total
    for n, k in zip(names, sizes):
        stride //= k
        digit = ((idx / F.lit(stride)).cast("long") % k).cast("int") + 1
        vals = F.array(*[F.lit(v) for v in space[n]])
        cols.append(F.element_at(vals, digit).alias(n))
    picked = (spark.range(total).select("id", *cols)
              .orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(min(budget, total)))
    params = F.struct(*[F.col(n) for n in sorted(names)])
    return picked.select(
        F.concat(F.lit("xgb-"), F.substring(F.sha2(F.to_json(params), 256), 1, 10)).alias("candidate_id"),
        F.struct(*[F.col(n) for n in names]).alias("parameters"), F.col("id").alias("grid_index"))


def flatten_candidates(candidates: DataFrame) -> DataFrame:
    """``parameters`` struct -> ``parameter_*`` columns."""
    fields = candidates.schema["parameters"].dataType.names
    return candidates.select("*", *[F.col(f"parameters.{f}").alias(f"parameter_{f}") for f in fields]).drop("parameters")


# ------------------------------------------------------------------ M10
def fold_rows(rows: DataFrame, fold) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one fold, by its bounds as literals (no join with a membership table)."""
    ts = F.col("timestamp")
    return (rows.filter(ts <= F.lit(fold["training_end"])),
            rows.filter(ts.between(F.lit(fold["validation_start"]), F.lit(fold["validation_end"]))))


# What a candidate's settings can do to its own fit; anything else (a lost executor, a full disk) ends the job.
_CANDIDATE_ERRORS = (TypeError, ValueError, KeyError, ArithmeticError, IllegalArgumentException)


@dataclass
class PreparedFold:
    """One fold, preprocessed and assembled once for all candidates: (features, target) rows to fit on, and
    (kept columns, features) rows to score, both written tables."""
    number: int
    training: DataFrame
    validation: DataFrame


def prepare_fold(rows: DataFrame, fold, predictors: list[str], keep: list[str]) -> PreparedFold:
    """Preprocessing fitted on the fold's training rows alone, applied to its two parts.

    The written tables have as few files as their bytes need (``rebalance`` goes by the advisory partition
    size), so that a small fold's many boosting rounds are jobs of one task and a large fold's are spread.
    """
    training, validation = fold_rows(rows, fold)
    if training.isEmpty():
        raise ValueError(f"fold {fold['fold_number']} has no training rows")
    prep = fit_preprocessing(training, predictors, scale=False)
    fill = SQLTransformer(statement=prep.statement)
    assemble = VectorAssembler(inputCols=prep.feature_columns, outputCol="features", handleInvalid="keep")
    parts = [cut_lineage(assemble.transform(fill.transform(part)).select(*columns, "features").hint("rebalance"))
             for part, columns in ((training, [TARGET]), (validation, keep))]
    return PreparedFold(fold["fold_number"], *parts)


def tune(train_rows: DataFrame, folds: DataFrame, predictors: list[str], candidates: list[dict],
         cfg: TrainingConfig = TrainingConfig(), parallelism: int = 16, predictions_path: str | None = None) -> DataFrame:
    """Fit every candidate on every fold; one record per candidate and fold.

    A fold is prepared once, whatever the number of candidates: its preprocessing knows nothing of them.
    Each fit writes the raw predictions of its fold (S14) to ``predictions_path``, by default a new
    folder in the shared checkpoint folder; one pass over them gives all metrics.  A record has status,
    failure_message, durations, the fold metrics, and nested beside them those of daylight hours
    (``daylight``) and of each site (``by_site``), null where the fit failed.  A fold that can't be prepared
    fails for every candidate.  Fits are distributed Spark jobs; a thread pool runs ``parallelism`` at once,
    like ``CrossValidator(parallelism=...)``, since the rounds of small folds leave most cores idle.
    ``folds`` is the boundary table of W8, one row per fold.
    """
    from pvspark.operators.metrics import fold_record
    spark = train_rows.sparkSession
    path = predictions_path or f"{checkpoint_dir(spark).rstrip('/')}/fold-predictions-{uuid.uuid4().hex}"
    keep = [c for c in ("site_id", "timestamp", TARGET, "is_daylight") if c in train_rows.columns]

    def attempt(work):
        """(result, None), or (None, what a candidate's settings or a fold's rows did to it)."""
        try:
            return work(), None
        except _CANDIDATE_ERRORS as exc:  # recorded, not fatal
            return None, f"{type(exc).__name__}: {exc}"

    def run(job):
        cand, number, (prepared, broken) = job
        cid = cand["candidate_id"]

        def work():
            began = time.perf_counter()
            model = _estimator("tuned_xgboost", cfg, prepared.training, cand["parameters"]).fit(prepared.training)
            fitted = time.perf_counter()
            model.transform(prepared.validation).select(*keep, F.col("prediction").cast("double").alias("prediction")) \
                .write.mode("overwrite").parquet(f"{path}/candidate_id={cid}/fold_number={number}")
            return fitted - began, time.perf_counter() - fitted

        took, problem = (None, broken) if broken else attempt(work)
        return (cid, number, "failed", problem, None, None) if took is None else (cid, number, "succeeded", None, *took)

    bounds = folds.collect()  # one row a fold
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        prepared = list(pool.map(lambda f: attempt(lambda: prepare_fold(train_rows, f, predictors, keep)), bounds))
        # the longest fits first: the last to end decide when the pool is through
        jobs = sorted(((c, f["fold_number"], p) for c in candidates for f, p in zip(bounds, prepared, strict=True)),
                      key=lambda job: -_boosting_work(job[0]["parameters"]))
        rows = list(pool.map(run, jobs))
    records = spark.createDataFrame(rows, "candidate_id string, fold_number int, status string, failure_message string, "
                                          "training_duration_seconds double, prediction_duration_seconds double")
    schema = StructType([*train_rows.select(*keep).schema, StructField("prediction", DoubleType()),
                         StructField("candidate_id", StringType()), StructField("fold_number", IntegerType())])
    scored = (spark.read.schema(schema).parquet(path) if any(r[2] == "succeeded" for r in rows)
              else spark.createDataFrame([], schema))
    return records.join(fold_record(scored, clip=cfg.clip_negative_predictions), ["candidate_id", "fold_number"], "left")


def _boosting_work(parameters: dict) -> float:
    """Jobs of a fit, about: one a level of each tree."""
    try:
        return float(parameters["n_estimators"]) * float(parameters["max_depth"])
    except _CANDIDATE_ERRORS:
        return 0.0


def candidate_summary(fold_metrics: DataFrame, candidates: DataFrame) -> DataFrame:
    """A25 + status per candidate (failed when any fold failed)."""
    from pvspark.operators.ranking import cv_summary
    ok = fold_metrics.groupBy("candidate_id").agg(F.max((F.col("status") != "succeeded").cast("int")).alias("_f"))
    s = cv_summary(fold_metrics.filter(F.col("status") == "succeeded"))
    flat = candidates.select("candidate_id", "parameters.n_estimators", "parameters.max_depth")
    return (flat.join(ok, "candidate_id", "left").join(s, "candidate_id", "left")
                .withColumn("status", F.when(F.col("_f") == 0, F.lit("succeeded")).otherwise(F.lit("failed")))
                .drop("_f"))


# ------------------------------------------------------------------ M13
def permutation_importance(model: PipelineModel, rows: DataFrame, predictors: list[str], repeats: int = 5,
                           seed: int = 42, key: list[str] = ("site_id", "timestamp"),
                           max_copies: int = 25) -> DataFrame:
    """Drop in negative MAE when one predictor is permuted (k repeats).

    Group g = (predictor, repeat).  In group g row i takes the predictor value
    of the row whose seeded-hash rank in g equals i.  All groups have exactly n
    rows, so one global rank over (g, hash) gives the within-group rank as
    ``rank - g * n``.  The values that a row takes come to it as one array, so
    only (group, row, value) is shuffled per group; the row is copied behind
    the join (``explode``), where copies go straight into the model.
    Predictors are processed in chunks so that one job holds at most
    ``max_copies`` values a row (the work is the same, the intermediate stays
    bounded at 100 TB).  The model scores every copy as a whole, except where
    it is linear (``linear_terms``): then each copy's error is the row's own
    with one predictor's share of the prediction exchanged.
    """
    key = list(key)
    spark = rows.sparkSession
    base = rows.withColumn("_k", F.xxhash64(*key))
    ranked = global_rank(base, ["_k", *key], "_i").drop("_k")
    n = ranked.count()
    terms = linear_terms(model, predictors)
    if terms is not None:
        return _importance_table(spark, _linear_importance(model, ranked, n, terms, predictors, repeats, seed, max_copies))
    base_mae = predict(model, ranked, ["_i", TARGET]).agg(
        F.avg(F.abs(F.col("prediction") - F.col(TARGET)))).first()[0]
    chunk = max(1, max_copies // max(1, repeats))
    # By their bytes the rows would be merged into few tasks; the cost is that of their copies.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    results = []
    for start in range(0, len(predictors), chunk):
        part = predictors[start:start + chunk]
        groups = len(part) * repeats
        g = F.col("_g")
        pidx = (g / repeats).cast("int")
        vals = F.array(*[F.col(p).cast("double") for p in part])
        src = ranked.select("_i", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"), vals.alias("_vals"))
        # Global predictor index keeps the hash seeds independent of the chunking.
        src = src.select("_g", "_i", F.element_at("_vals", pidx + 1).alias("_v"),
                         F.xxhash64(F.lit(seed), pidx + start, g % repeats, "_i").alias("_h"))
        src = global_rank(src, ["_g", "_h", "_i"], "_r").select("_g", (F.col("_r") - g * n).alias("_i"), "_v")
        taken = src.repartition(tasks, "_i").groupBy("_i").agg(F.collect_list(F.struct("_g", "_v")).alias("_taken"))  # one a group
        perm = ranked.repartition(tasks, "_i").join(taken, "_i").select(*ranked.columns, F.inline("_taken").alias("_g", "_v"))
        perm = perm.select(*[F.when(pidx == k, F.col("_v")).otherwise(F.col(p).cast("double")).alias(p)
                             for k, p in enumerate(part)],
                           *[c for c in ranked.columns if c not in part], "_g")
        scored = model.transform(perm).groupBy("_g").agg(
            F.avg(F.abs(F.col("prediction") - F.col(TARGET))).alias("_mae"))
        names = F.element_at(F.array(*[F.lit(p) for p in part]), pidx + 1)
        results.append(scored.select(names.alias("predictor"), (F.col("_mae") - F.lit(base_mae)).alias("importance"))
                       .collect())  # len(part) * repeats rows
    return _importance_table(spark, [(r["predictor"], float(r["importance"])) for rs in results for r in rs])


def _importance_table(spark, importances: list[tuple[str, float]]) -> DataFrame:
    """Mean and standard deviation over the repeats of each predictor."""
    imp = spark.createDataFrame(importances, "predictor string, importance double")
    return imp.groupBy("predictor").agg(F.avg("importance").alias("importance_mean"),
                                        F.stddev_pop("importance").alias("importance_std"))


# One numeric feature as ``fit_preprocessing`` writes it, filled or missing, scaled or not: groups are the column, then the name.
_NUMBER = r"CAST\('[^']*' AS DOUBLE\)"
_NAME = r"`((?:[^`]|``)+)`"
_FEATURE = re.compile(rf", (?:\(\()?(?:coalesce\(CAST\({_NAME} AS DOUBLE\), {_NUMBER}\)|CAST\({_NAME} IS NULL AS DOUBLE\))"
                      rf"(?:\) - {_NUMBER}\) / {_NUMBER})? AS {_NAME}")


def linear_terms(model, predictors: list[str]) -> list[list[tuple[int, float]]] | None:
    """(place in the feature vector, coefficient) of the features made from each predictor, where ``model`` is linear
    in features of one column each, as ``fit_model`` makes ridge; None for any other model."""
    stages = getattr(model, "stages", [])
    if [type(stage) for stage in stages] != [SQLTransformer, VectorAssembler, LinearRegressionModel]:
        return None
    fill, assemble, line = stages
    found = list(_FEATURE.finditer(fill.getStatement()))
    if f"SELECT *{''.join(m[0] for m in found)} FROM __THIS__" != fill.getStatement() or len(set(predictors)) != len(predictors):
        return None
    column = {m[3]: (m[1] or m[2]).replace("``", "`") for m in found}
    inputs = assemble.getInputCols()
    if not set(inputs) <= set(column) or assemble.getOutputCol() != line.getFeaturesCol() or line.numFeatures != len(inputs):
        return None
    coefficients = [float(x) for x in line.coefficients.toArray()]
    return [[(k, coefficients[k]) for k, name in enumerate(inputs) if column[name] == p] for p in predictors]


def _linear_importance(model, ranked: DataFrame, n: int, terms, predictors: list[str], repeats: int, seed: int,
                       max_copies: int) -> list[tuple[str, float]]:
    """M13 of a linear model, the permutations those of the general form.

    A row's prediction is the sum of its predictors' shares, each made from one column, so the rows are scored once.
    In group g row i has the share of predictor p that the row ranked i in g has of it, in place of its own: only
    (group, row, share) is sorted and shuffled, and met by the row's error without its own share.
    """
    features = model.stages[-1].getFeaturesCol()
    x = F.col("_x")
    shares = [reduce(lambda a, b: a + b, [F.lit(w) * x[k] for k, w in of], F.lit(0.0)) for of in terms]
    scored = cut_lineage(model.transform(ranked).select("_i", (F.col("prediction") - F.col(TARGET)).alias("_e"),
                                                        vector_to_array(features).alias("_x"))
                         .select("_i", "_e", F.array(*shares).alias("_shares")))
    base_mae = scored.agg(F.avg(F.abs("_e"))).first()[0]
    chunk = max(1, max_copies // max(1, repeats))
    g, pidx, results = F.col("_g"), (F.col("_g") / repeats).cast("int"), []
    for start in range(0, len(predictors), chunk):
        part = predictors[start:start + chunk]
        mine = scored.select("_i", "_e", F.slice("_shares", start + 1, len(part)).alias("_shares"))
        src = mine.select("_i", "_shares", F.explode(F.sequence(F.lit(0), F.lit(len(part) * repeats - 1))).alias("_g"))
        # Global predictor index keeps the hash seeds independent of the chunking.
        src = src.select("_g", "_i", F.element_at("_shares", pidx + 1).alias("_v"),
                         F.xxhash64(F.lit(seed), pidx + start, g % repeats, "_i").alias("_h"))
        src = global_rank(src, ["_g", "_h", "_i"], "_r").select("_g", (F.col("_r") - g * n).alias("_i"), "_v")
        rest = mine.select("_i", F.transform("_shares", lambda share: F.col("_e") - share).alias("_rest"))
        met = src.join(rest.hint("shuffle_hash"), "_i").groupBy("_g").agg(
            F.avg(F.abs(F.col("_v") + F.element_at("_rest", pidx + 1))).alias("_mae"))
        results += [(part[r["_g"] // repeats], float(r["_mae"] - base_mae)) for r in met.collect()]  # one a group
    return results


def global_rank(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Dense 0-based rank by ``order`` without a single-partition window.

    The range-partitioned, sorted table is written once, each row with its
    partition and its position there; counts and ranks read that one table, so
    they cannot disagree however the ranges were drawn.  ``order`` should tell
    rows apart: ties get distinct ranks in no defined order.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = cut_lineage(placed)
    pid, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)  # layout of the id, as documented
    counts = placed.groupBy(pid.alias("_pid")).agg((F.max(at) + 1).alias("c")).orderBy("_pid").collect()
    offsets, acc = [], 0  # one row per partition
    for r in counts:
        offsets.append((r["_pid"], acc))
        acc += r["c"]
    offsets = spark.createDataFrame(offsets, "_pid long, _offset long")
    return (placed.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_offset") + at).drop("_pid", "_offset", "_at"))


# ------------------------------------------------------------------ M14 / M15
def tree_importance(spark, path: str, names: list[str]) -> DataFrame:
    """Mean gain of a feature's splits and their number (``weight``) in the saved ensemble at ``path``.

    The trees are read as the table of nodes that the saved model is; a feature without a split has zeros.
    ``names`` are the model's features in their order, a table of the model's size."""
    nodes = spark.read.parquet(f"{path.rstrip('/')}/stages/*_*/data").select("nodeData.*")
    splits = nodes.where(F.col("leftChild") >= 0).groupBy(F.col("split.featureIndex").alias("i")).agg(
        F.avg("gain").alias("gain"), F.count("*").alias("weight"))
    features = spark.createDataFrame(list(enumerate(names)), "i int, feature string")
    return features.join(splits, "i", "left").select("feature", F.coalesce("gain", F.lit(0.0)).alias("gain"),
                                                     F.coalesce("weight", F.lit(0)).cast("double").alias("weight"))


def save_and_verify(model: PipelineModel, path: str, rows: DataFrame, key: list[str] = ("site_id", "timestamp"),
                    tolerance: float = 1e-12) -> float:
    """Save, reload, score the same rows and compare predictions by key."""
    key = list(key)
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = predict(model, rows, key).withColumnRenamed("prediction", "_a")
    b = predict(loaded, rows, key).withColumnRenamed("prediction", "_b")
    diff = a.join(b, key).agg(F.max(F.abs(F.col("_a") - F.col("_b")))).first()[0] or 0.0
    if diff > tolerance:
        raise ValueError("loaded-model predictions do not match pre-save predictions")
    return float(diff)


def grid_size(space: dict = DEFAULT_SEARCH_SPACE) -> int:
    return math.prod(len(v) for v in space.values())


def canonical_json(params: dict) -> str:
    return json.dumps(params, sort_keys=True, separators=(",", ":"))



def imputation_table(train: DataFrame, numeric: list[str]) -> DataFrame:
    """M1 statistics as a table: exact training median and NULL count per column.

    Columns are unpivoted to (number of the column, value), a plain array of doubles a row; medians use the two-pass
    exact selection.  NULLs are counted in the wide rows, one aggregate."""
    from pvspark.functions.quantiles import exact_percentiles
    values = [F.col(c).cast("double") for c in numeric]
    long = train.select(F.posexplode(F.array(*values)).alias("_column", "_v"))
    counts = train.agg(F.count("*").alias("_n"), F.array(*[F.count_if(v.isNull()) for v in values]).alias("_nulls"))
    nulls = counts.where(F.col("_n") > 0).select(F.posexplode("_nulls").alias("_column", "train_missing_count"))
    med = exact_percentiles(long, ["_column"], "_v", [0.5], ["median"])
    feature = F.element_at(F.array(*[F.lit(c) for c in numeric]), F.col("_column") + 1).alias("feature")
    return nulls.join(med, "_column", "left").select(feature, "median", "train_missing_count")

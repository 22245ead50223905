"""Queries: training preparation (V16, A19, A20), preprocessing statistics
(M1), model jobs (M10-M15, rows-only checks), registry state (W15) and file
checksums (A29)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from pvspark.operators import models as ML
from pvspark.operators import prepare as PR
from pvspark.operators import registry as REG
from pvspark.plans import q_features as QF
from pvspark.plans import q_metrics as QM
from pvspark.plans import training as TR
from pvspark.plans.registry import register, rnd_sql, rounded
from pvspark.session import checkpoint_dir, cut_lineage, table_path

PREDICTORS = QF.PREDICTORS


def _features(spark, d):
    """Feature table materialised once per query (reused by fits and scores)."""
    return cut_lineage(QF._spark_features(spark, d).features)


@register("imputation_medians", rnd_sql(QF._FJ + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS train_missing_count FROM feat WHERE split = 'train' AND feature_eligible"
    for c in PREDICTORS), ["median"]))
def q_imputation(spark, d):
    tr = PR.eligible(_features(spark, d), "train")
    return rounded(ML.imputation_table(tr, PREDICTORS))


@register("training_eligibility_audit", QF._FJ + "SELECT split, site_id, count(*) FILTER (WHERE feature_eligible) AS eligible_rows, "
          "count(*) FILTER (WHERE NOT feature_eligible) AS excluded_rows FROM feat GROUP BY ALL")
def q_audit(spark, d):
    return PR.eligibility_audit(_features(spark, d))


@register("training_exclusion_reasons", QF._FJ + "SELECT split, reason, count(*) AS row_count FROM (SELECT split, "
          "unnest(string_split(feature_missing_reasons, ';')) AS reason FROM feat WHERE NOT feature_eligible) "
          "WHERE reason <> '' GROUP BY ALL")
def q_exclusions(spark, d):
    return PR.exclusion_reasons(_features(spark, d))


@register("constant_train_predictors", QF._FJ + " UNION ALL ".join(
    f"SELECT '{c}' AS predictor FROM feat WHERE split = 'train' AND feature_eligible "
    f"HAVING min(CAST({c} AS DOUBLE)) IS NULL OR min(CAST({c} AS DOUBLE)) = max(CAST({c} AS DOUBLE))" for c in PREDICTORS))
def q_constant_train(spark, d):
    return PR.constant_train_predictors(_features(spark, d), PREDICTORS)


@register("training_row_issues", QF._FJ + "SELECT 'none' AS issue, CAST(0 AS BIGINT) AS rows FROM feat WHERE false")
def q_row_issues(spark, d):
    return PR.row_issues(_features(spark, d), PREDICTORS)


@register("baseline_validation_ranking")
def q_baseline_ranking(spark, d):
    res = TR.run_baseline(_features(spark, d), PREDICTORS)
    return rounded(res.validation_ranking.select("model_identifier", "mae_kwh", "rmse_kwh", "r2", "rank",
                                                 "negative_raw_prediction_count"))


@register("baseline_test_metrics")
def q_baseline_test(spark, d):
    res = TR.run_baseline(_features(spark, d), PREDICTORS)
    return rounded(res.test_metrics.select("model_identifier", "mae_kwh", "rmse_kwh", "prediction_count",
                                           "prediction_coverage_pct"))


@register("advanced_validation_leaderboard")
def q_advanced(spark, d):
    res = TR.run_advanced(_features(spark, d), PREDICTORS, QF.FOLDS)
    return rounded(res.leaderboard.select("model_identifier", "mae_kwh", "rmse_kwh", "cross_validation_stability",
                                          "model_complexity_rank", "rank"))


@register("ridge_permutation_importance")
def q_permutation(spark, d):
    f = _features(spark, d)
    tr, va = PR.eligible(f, "train"), PR.eligible(f, "validation")
    model = ML.fit_model(tr, PREDICTORS, "ridge")
    return rounded(ML.permutation_importance(model, va, PREDICTORS, max_copies=100))


def _model_path(spark, name):
    return os.path.join(checkpoint_dir(spark), "models", f"{name}-{uuid.uuid4().hex[:12]}")


@register("forest_feature_importance")
def q_tree_importance(spark, d):
    f = _features(spark, d)
    tr = PR.eligible(f, "train")
    statistics = ML.fill_statistics(tr, PREDICTORS)
    model = ML.fit_model(tr, PREDICTORS, "random_forest", statistics=statistics)
    path = _model_path(spark, "forest")
    model.write().save(path)
    prep = ML.fit_preprocessing(tr, PREDICTORS, scale=False, statistics=statistics)
    return rounded(ML.tree_importance(spark, path, prep.output_names))


@register("model_save_verify")
def q_save_verify(spark, d):
    f = _features(spark, d)
    tr, te = PR.eligible(f, "train"), PR.eligible(f, "test")
    model = ML.fit_model(tr, PREDICTORS, "ridge")
    path = _model_path(spark, "ridge")
    diff = ML.save_and_verify(model, path, te)
    saved = REG.artifact_checksum(spark, path).first()
    REG.verify_artifact(spark, path, saved["sha256"])
    return spark.createDataFrame([("ridge", diff, saved["files"])],
                                 "model_identifier string, max_abs_prediction_difference double, artifact_files long")


def _registry_events(spark, d):
    lb = QM._leaderboard(spark, d)
    from pvspark.operators.ranking import validation_leaderboard
    ranked = validation_leaderboard(lb)
    reg = ranked.select(F.col("model_identifier").alias("model_version"), F.lit("ac_energy_kwh_24h").alias("objective"),
                        F.lit("register").alias("action"), F.col("rank").cast("long").alias("seq"),
                        F.lit(True).alias("artifact_verified"), F.lit(True).alias("selection_based_on_validation"))
    prom = reg.filter(F.col("seq") == 1).withColumn("action", F.lit("promote")).withColumn("seq", F.lit(100).cast("long"))
    return reg.unionByName(prom)


@register("registry_state", QM.RANK_BASE + """, lb AS (SELECT model_identifier, row_number() OVER (ORDER BY mae_kwh, rmse_kwh, 0.0,
   CASE model_identifier WHEN 'persistence' THEN 0 WHEN 'ridge' THEN 1 WHEN 'random_forest' THEN 2
   WHEN 'histogram_gradient_boosting' THEN 3 WHEN 'tuned_xgboost' THEN 4 ELSE 99 END, model_identifier) AS rk FROM met)
SELECT model_identifier AS model_version, 'ac_energy_kwh_24h' AS objective,
   CASE WHEN rk = 1 THEN 'champion' ELSE 'candidate' END AS status, CAST(NULL AS VARCHAR) AS previous_champion_version FROM lb""")
def q_registry(spark, d):
    return REG.registry_state(_registry_events(spark, d))


# A registry of many models: orders are events, customers versions and priorities objectives. Rules on the keys plant
# second registrations, artifacts that fail, promotions without validation, of unknown and of archived versions,
# and champions that are promoted again or archived. SQL folds the events one by one.
_REGISTRY_SQL = """WITH RECURSIVE e AS (SELECT o_orderkey AS seq, 'v' || o_custkey AS model_version, o_orderpriority AS objective,
   CASE WHEN o_orderkey % 7 < 3 THEN 'register' WHEN o_orderkey % 7 < 6 THEN 'promote' ELSE 'archive' END AS action,
   o_orderkey % 5 <> 0 AS verified, o_orderkey % 11 <> 0 AS selected FROM orders),
reg AS (SELECT model_version, min(seq) AS since, arg_min(objective, seq) AS home FROM e WHERE action = 'register' AND verified GROUP BY 1),
j AS (SELECT e.*, since, home, CASE WHEN action = 'register' AND since < seq THEN 'model version already registered'
      WHEN action = 'register' AND NOT verified THEN 'model artifact verification failed'
      WHEN action = 'promote' AND NOT selected THEN 'promotion must be based on validation selection'
      WHEN action <> 'register' AND (since IS NULL OR since > seq) THEN 'unknown model version' END AS refused
      FROM e LEFT JOIN reg USING (model_version)),
live AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY seq) AS i FROM j WHERE refused IS NULL),
fold AS (SELECT DISTINCT home, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS champion, NULL::VARCHAR AS before,
      []::VARCHAR[] AS archived, NULL::VARCHAR AS problem FROM reg
   UNION ALL SELECT f.home, l.i, l.seq,
      CASE WHEN action = 'archive' AND champion = l.model_version THEN NULL
           WHEN action = 'promote' AND verified AND NOT list_contains(archived, l.model_version) THEN l.model_version ELSE champion END,
      CASE WHEN action = 'register' THEN champion END,
      CASE WHEN action = 'archive' AND NOT list_contains(archived, l.model_version) THEN list_append(archived, l.model_version)
           WHEN action = 'promote' AND verified AND NOT list_contains(archived, l.model_version) AND champion <> l.model_version
           THEN list_append(archived, champion) ELSE archived END,
      CASE WHEN action = 'promote' AND list_contains(archived, l.model_version) THEN 'only a complete candidate can be promoted'
           WHEN action = 'promote' AND NOT verified THEN 'model artifact verification failed' END
   FROM fold f JOIN live l ON l.home = f.home AND l.i = f.i + 1)
"""


def _planted_registry(spark, d):
    key = F.col("o_orderkey")
    return spark.read.parquet(table_path(d, "orders")).select(
        F.concat(F.lit("v"), "o_custkey").alias("model_version"), F.col("o_orderpriority").alias("objective"),
        F.when(key % 7 < 3, "register").when(key % 7 < 6, "promote").otherwise("archive").alias("action"),
        key.cast("long").alias("seq"), (key % 5 != 0).alias("artifact_verified"),
        (key % 11 != 0).alias("selection_based_on_validation"))


@register("registry_state_planted", _REGISTRY_SQL + """, last AS (SELECT home, max(i) AS n FROM fold GROUP BY home),
ends AS (SELECT f.home, f.champion AS holder, f.archived AS gone FROM fold f JOIN last USING (home) WHERE f.i = n)
SELECT reg.model_version, reg.home AS objective, CASE WHEN list_contains(gone, reg.model_version) THEN 'archived'
   WHEN holder = reg.model_version THEN 'champion' ELSE 'candidate' END AS status, f.before AS previous_champion_version
FROM reg JOIN ends USING (home) JOIN fold f ON f.home = reg.home AND f.seq = reg.since""")
def q_registry_planted(spark, d):
    return REG.registry_state(_planted_registry(spark, d))


@register("registry_issues_planted", _REGISTRY_SQL + """SELECT seq::BIGINT AS seq, model_version, action, refused AS problem FROM j WHERE refused IS NOT NULL
UNION ALL SELECT j.seq::BIGINT, model_version, action, problem FROM fold JOIN j USING (seq) WHERE problem IS NOT NULL""")
def q_registry_issues_planted(spark, d):
    return REG.registry_issues(_planted_registry(spark, d))


@register("table_checksums")
def q_checksums(spark, d):
    return REG.file_checksums(spark, os.path.join(d, "*.parquet"))

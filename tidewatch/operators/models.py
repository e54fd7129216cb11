"""Model registry rows: ranking, roles, promotion verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch import config as C
from tidewatch.functions.frame import attach_row
from tidewatch.operators import metrics as M


def metrics_by_model(scored: DataFrame, model: str) -> DataFrame:
    """Validation and locked-test metrics per model, from (model, split, score, is_fraud)."""
    m = M.ranking_report(scored, [model, "split"])
    val, test = F.col("split") == "val", F.col("split") == "test"
    return m.groupBy(model).agg(
        F.max(F.when(val, F.col("roc_auc"))).alias("val_roc"),
        F.max(F.when(test, F.col("roc_auc"))).alias("test_roc"),
        F.max(F.when(val, F.col("average_precision"))).alias("val_ap"),
        F.max(F.when(test, F.col("average_precision"))).alias("test_ap"),
        F.max(F.when(test, F.col("rows"))).alias("test_rows"),
        F.max(F.when(test, F.col("frauds"))).alias("test_frauds"))


def flat(registry: DataFrame) -> DataFrame:
    """Registry configs as flat metric rows."""
    return registry.select(
        "name", "model_name", "backend", "feature_set", "training_rows",
        F.col("metrics_validation.roc_auc").alias("val_roc"),
        F.col("metrics_test_locked.roc_auc").alias("test_roc"),
        F.col("metrics_test_locked.average_precision").alias("test_ap"),
        F.col("metrics_test_locked.action_counts").alias("action_counts"),
        F.col("thresholds.hold").alias("hold"), F.col("thresholds.review").alias("review"))


def rank_candidates(models: DataFrame, serving: str, degraded: bool = True,
                    penalty: float = C.SWITCH_PENALTY) -> DataFrame:
    """Candidates above the serving bar, best first (rank 1).

    A candidate counts with its locked-test ROC, or its validation ROC less a
    penalty when it has none. The bar is the serving model's test ROC; without
    drift its penalised validation ROC may raise it.
    """
    score = F.coalesce("test_roc", F.col("val_roc") - penalty)
    bar = F.coalesce("test_roc", F.lit(-1.0))
    if not degraded:
        bar = F.greatest(bar, F.coalesce("val_roc", F.lit(-1.0)) - penalty)
    own = models.filter(F.col("name") == serving).agg(F.coalesce(F.max(bar), F.lit(-1.0)).alias("bar"))
    cand = attach_row(models.filter(F.col("name") != serving).withColumn("rank_score", score), own)
    cand = cand.filter(F.col("rank_score") > F.col("bar"))
    from pyspark.sql import Window  # registry rows: one per model directory
    return cand.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rank_score"), F.desc("name"))))


def race(models: DataFrame, serving: str, hero: str, research_words: tuple[str, ...]) -> DataFrame:
    """Roles and flags for every model."""
    label = F.lower(F.coalesce("model_name", "name"))
    research = F.lit(False)
    for w in research_words:
        research = research | label.contains(w) | F.col("name").contains(w)
    is_hero = F.col("name") == hero
    return models.withColumn(
        "role", F.when(F.col("name") == serving, "serving")
        .when(F.col("action_counts").isNotNull() & (F.size("action_counts") > 0), "promotion-candidate")
        .otherwise("candidate")
    ).withColumn("is_hero", is_hero).withColumn("is_research", ~is_hero & research)


def promotion_gate(candidate_roc, serving_roc):
    return F.when(candidate_roc >= serving_roc, "PASS").otherwise("BLOCKED")


def repair_verdict(frauds, margin, top_repair, top_serving):
    """Verdict of the repair model on the locked slice."""
    gain = top_repair - top_serving
    return (F.when(frauds < 500, "insufficient_evidence")
            .when((margin >= 0.02) & (gain >= 5), "pass_with_caveat")
            .when((margin <= -0.02) & (gain <= -5), "fail").otherwise("insufficient_evidence"))

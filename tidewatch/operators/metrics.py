"""Ranking metrics over (score, label) rows, exact under ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.functions import expr as X
from tidewatch.functions.frame import attach_row
from tidewatch.operators import ranking as R

ACTIONS = ("allow", "review", "hold")


def score_groups(df: DataFrame, score: str = "score", label: str = "is_fraud",
                 keys: list[str] | None = None, descending: bool = True) -> DataFrame:
    """Rows and positives per distinct score, with cumulative and total sums."""
    return R.cumulative(df, score, {"n": F.count(F.lit(1)), "pos": F.sum(label)}, keys, descending)


def roc_auc(df: DataFrame, score: str = "score", label: str = "is_fraud",
            keys: list[str] | None = None) -> DataFrame:
    """Area under ROC with average ranks for ties; null when one class is absent."""
    keys = keys or []
    g = score_groups(df, score, label, keys, descending=False)
    neg_before, neg = F.col("before_n") - F.col("before_pos"), F.col("n") - F.col("pos")
    wins = F.sum(F.col("pos") * (neg_before + neg / 2))
    pairs = F.max("total_pos") * (F.max("total_n") - F.max("total_pos"))
    return g.groupBy(*keys).agg(
        F.max("total_n").alias("rows"), F.max("total_pos").alias("frauds"),
        F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "is_fraud",
             keys: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 when everything at or above each score is flagged."""
    keys = keys or []
    g = score_groups(df, score, label, keys)
    flagged, tp = F.col("before_n") + F.col("n"), F.col("before_pos") + F.col("pos")
    p, r = tp / flagged, tp / F.when(F.col("total_pos") > 0, F.col("total_pos"))
    return g.select(*keys, F.col(score).alias("threshold"), F.col("n"), F.col("pos"),
                    flagged.alias("flagged"), tp.alias("tp"), "total_n", "total_pos",
                    p.alias("precision"), r.alias("recall"),
                    (2 * p * r / (p + r + 1e-12)).alias("f1"))


def average_precision(df: DataFrame, score: str = "score", label: str = "is_fraud",
                      keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    c = pr_curve(df, score, label, keys)
    return c.groupBy(*keys).agg(
        F.sum(F.col("pos") / F.when(F.col("total_pos") > 0, F.col("total_pos")) * F.col("precision"))
        .alias("average_precision"))


def ranking_report(df: DataFrame, keys: list[str], score: str = "score", label: str = "is_fraud") -> DataFrame:
    """rows, frauds, `roc_auc` and `average_precision` per key, from one cumulative pass."""
    g = score_groups(df, score, label, keys)
    neg = F.col("n") - F.col("pos")
    neg_below = (F.col("total_n") - F.col("total_pos")) - (F.col("before_n") - F.col("before_pos")) - neg
    pairs = F.max("total_pos") * (F.max("total_n") - F.max("total_pos"))
    precision = (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n"))
    return g.groupBy(*keys).agg(
        F.max("total_n").alias("rows"), F.max("total_pos").alias("frauds"),
        F.when(pairs > 0, F.sum(F.col("pos") * (neg_below + neg / 2)) / pairs).alias("roc_auc"),
        F.sum(F.col("pos") / F.when(F.col("total_pos") > 0, F.col("total_pos")) * precision).alias("average_precision"))


def best_f1(df: DataFrame, score: str = "score", label: str = "is_fraud") -> DataFrame:
    """The threshold of the largest F1; the lowest one when several tie."""
    c = pr_curve(df, score, label)
    best = c.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1", "flagged", "tp",
                                   "total_n", "total_pos"),
                          F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")
    fp = F.col("flagged") - F.col("tp")
    return best.select(
        F.col("threshold").alias("f1_threshold"), F.col("f1").alias("f1_max"), "precision", "recall",
        F.col("tp"), fp.alias("fp"), (F.col("total_pos") - F.col("tp")).alias("fn"),
        (F.col("total_n") - F.col("total_pos") - fp).alias("tn"))


def recall_at_precision(df: DataFrame, targets=(0.25, 0.5, 0.8), score: str = "score",
                        label: str = "is_fraud") -> DataFrame:
    c = pr_curve(df, score, label)
    return c.agg(*[F.round(F.coalesce(F.max(F.when(F.col("precision") >= t, F.col("recall"))), F.lit(0.0)), 4)
                   .alias(f"recall_at_precision_{int(t * 100)}") for t in targets])


def top_capture(df: DataFrame, ks=(100, 500, 1000, 5000, 10000, 50000), score: str = "score",
                label: str = "is_fraud", tie: str = "transaction_id") -> DataFrame:
    """Precision and recall among the k highest scores, for each k that fits.

    A bound on the score leaves about max(ks) rows, and those are numbered in ranges.
    """
    totals = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("frauds"))
    near = R.highest(df.select(score, label, tie), F.col(score), max(ks))
    top = R.numbered(near.withColumn("_down", -F.col(score)).filter(F.col(score).isNotNull()), "_down", [tie], name="rank")
    top = top.withColumn("rank", F.col("rank") + 1).filter(F.col("rank") <= max(ks))
    ladder = top.select("rank", label, F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    hits = ladder.filter(F.col("rank") <= F.col("k")).groupBy("k").agg(
        F.sum(label).alias("hits"), F.count(F.lit(1)).alias("taken"))
    return (attach_row(hits.filter(F.col("taken") == F.col("k")), totals)
            .select("k", "hits", F.round(F.col("hits") / F.col("k"), 4).alias("precision_at_k"),
                    F.round(F.col("hits") / F.col("frauds"), 4).alias("recall_at_k")))


def confusion(df: DataFrame, threshold: float, score: str = "score", label: str = "is_fraud") -> DataFrame:
    flagged, pos = F.col(score) >= threshold, F.col(label) == 1
    out = df.agg(F.count_if(flagged & pos).alias("tp"), F.count_if(flagged & ~pos).alias("fp"),
                 F.count_if(~flagged & pos).alias("fn"), F.count_if(~flagged & ~pos).alias("tn"))
    return out.withColumn("fpr", F.col("fp") / F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") + F.col("tn")))


def fit_thresholds(df: DataFrame, hold_precision: float = 0.8, review_precision: float = 0.3,
                   score: str = "score", label: str = "is_fraud", min_index: int = 10) -> tuple[float, float, bool]:
    """Hold and review thresholds from a validation stream, and whether a fall-back was used.

    The threshold lies between the two lowest scores of the smallest flagged
    set that reaches the target precision. A set that small (its last row at
    index below `min_index`) counts as not reached; then fixed top shares
    (0.05 % hold, 1.05 % review) take over. Review never exceeds hold. One row
    comes back from the cluster; the quantiles are only computed when needed.
    """
    g = score_groups(df, score, label)
    flagged = F.col("before_n") + F.col("n")
    precision = (F.col("before_pos") + F.col("pos")) / flagged
    found = g.agg(*[
        F.min_by(F.struct(F.col(score).alias("s"), F.col("n"), F.col("previous"), flagged.alias("flagged")),
                 F.when(precision >= t, flagged)).alias(name)
        for name, t in (("hold", hold_precision), ("review", review_precision))]).first()

    def threshold(hit) -> float | None:
        if hit is None or hit["flagged"] - 1 < min_index:
            return None
        upper = hit["s"] if hit["n"] >= 2 else hit["previous"]
        return (upper + hit["s"]) / 2

    hold, review = threshold(found["hold"]), threshold(found["review"])
    fallback = hold is None or review is None
    if fallback:
        q = R.quantiles(df, score, [1 - 0.0005, 1 - 0.0105]).first()["q"]
        hold, review = q[0] if hold is None else hold, q[1] if review is None else review
    return hold, hold * 0.9 if review > hold else review, fallback


def threshold_policy(df: DataFrame, hold_precision: float = 0.8, review_precision: float = 0.3,
                     score: str = "score", label: str = "is_fraud", min_index: int = 10) -> DataFrame:
    """One row: fitted thresholds, action counts and the precision of both bands."""
    hold, review, fallback = fit_thresholds(df, hold_precision, review_precision, score, label, min_index)
    flags = df.withColumn("action", X.band(score, hold, review))
    held, reviewed = F.col("action") == "hold", F.col("action") == "review"
    pos = F.col(label) == 1
    return flags.agg(
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS],
        F.round(F.count_if(held & pos) / F.greatest(F.count_if(held), F.lit(1)), 4).alias("hold_precision"),
        F.round(F.count_if(reviewed & pos) / F.greatest(F.count_if(reviewed), F.lit(1)), 4)
        .alias("review_precision")).select(
        F.lit(hold).alias("hold"), F.lit(review).alias("review"), F.lit(fallback).alias("fallback_used"), "*")


def action_counts(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    return df.agg(
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS],
        *[F.count_if((F.col("action") == a) & (F.col(label) == 1)).alias(f"fraud_{a}") for a in ACTIONS])


def pos_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    p, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(n.alias("negatives"), p.alias("positives"),
                  F.when(p > 0, n / p).otherwise(1.0).alias("pos_weight"),
                  (n / F.greatest(p, F.lit(1))).alias("scale_pos_weight"))


def standardise(df: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """z-scores with population std; a constant column (std < 1e-6) divides by 1."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])  # one row
    return attach_row(df, stats).select(*ids, *[
        ((F.col(c) - F.col(f"m_{c}"))
         / F.when(F.col(f"s_{c}") < 1e-6, 1.0).otherwise(F.col(f"s_{c}"))).alias(c) for c in columns])


def metrics_report(df: DataFrame, score: str = "score", label: str = "is_fraud",
                   key: str = "split") -> DataFrame:
    """rows, frauds, ROC-AUC and average precision per split."""
    return ranking_report(df, [key], score, label)

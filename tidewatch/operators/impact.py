"""Outcome P&L and business impact of a decision stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X
from tidewatch.functions.frame import attach_row
from tidewatch.operators import ranking as R


def inr(usd):
    """Rupees with two digits, in exact decimal arithmetic."""
    rate = F.lit(str(C.INR_PER_USD)).cast("decimal(4,1)")
    return F.round(X.as_col(usd).cast("decimal(30,4)") * rate, 2).cast("double")


def pnl_rows(decisions: DataFrame, amount: str = "amount_inr") -> DataFrame:
    cls = X.outcome_class("action", "outcome")
    return decisions.withColumn("classification", cls).select(
        "*", F.when(cls == "fraud_prevented", F.col(amount)).otherwise(0.0).alias("protected_value"),
        F.when(cls == "missed_fraud", F.col(amount)).otherwise(0.0).alias("missed_value"),
        F.when(cls == "false_positive", F.col(amount)).otherwise(0.0).alias("false_positive_cost"))


def pnl(decisions: DataFrame, amount: str = "amount_inr") -> DataFrame:
    """One row: protected, missed and false-positive value, net, and counts of all six classes."""
    r = pnl_rows(decisions, amount)
    p, m, f = F.sum("protected_value"), F.sum("missed_value"), F.sum("false_positive_cost")
    return r.agg(
        F.count(F.lit(1)).alias("n"), F.round(p, 2).alias("fraud_prevented_value"),
        F.round(m, 2).alias("missed_fraud_value"), F.round(f, 2).alias("false_positive_cost"),
        F.round(p - f, 2).alias("net_protected_value"),
        *[F.count_if(F.col("classification") == c).alias(f"n_{c}") for c in C.OUTCOME_CLASSES.values()])


def impact(decisions: DataFrame, months: float, label: str = "is_fraud") -> DataFrame:
    """Totals, actions, what was caught by which action, recall by count and amount, per month."""
    pos, act, amt = F.col(label) == 1, F.col("action"), F.col("amount")
    units = lambda cond: F.coalesce(F.sum(F.when(cond, X.money_units("amount"))), F.lit(0)) / F.lit(10000.0)
    one = decisions.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(pos).alias("frauds"),
        units(pos).alias("fraud_amount_usd"),
        *[F.count_if(act == a).alias(f"n_{a}") for a in ("allow", "review", "hold")],
        *[F.count_if(pos & (act == a)).alias(f"caught_{a}") for a in ("review", "hold")],
        *[units(pos & (act == a)).alias(f"caught_{a}_usd") for a in ("review", "hold")])
    caught_n, caught = F.col("caught_review") + F.col("caught_hold"), F.col("caught_review_usd") + F.col("caught_hold_usd")
    missed = F.col("fraud_amount_usd") - caught
    r = C.INR_PER_USD
    return one.select(
        "*", caught_n.alias("frauds_caught"),
        F.round(caught_n / F.greatest("frauds", F.lit(1)), 4).alias("recall_by_count"),
        F.round(caught / F.when(F.col("fraud_amount_usd") > 0, F.col("fraud_amount_usd")), 4).alias("recall_by_amount"),
        F.round(caught, 2).alias("fraud_amount_caught_usd"), F.round(missed, 2).alias("fraud_amount_missed_usd"),
        inr("fraud_amount_usd").alias("fraud_amount_inr"),
        inr(caught).alias("fraud_amount_caught_inr"),
        F.round(caught * r / months, 2).alias("per_month_protected_inr"),
        F.round(missed * r / months, 2).alias("per_month_missed_inr"))


def verified_pnl(report: DataFrame) -> DataFrame:
    legit = F.col("n_hold") - F.col("caught_hold")
    missed = inr("fraud_amount_missed_usd")
    return report.select(
        F.col("fraud_amount_caught_inr").alias("fraud_prevented_value"), missed.alias("missed_fraud_value"),
        legit.alias("false_positive_legit_holds"), F.round(F.col("n_hold") / F.col("rows"), 6).alias("hold_volume_fraction"),
        "frauds", "frauds_caught", "recall_by_count", "recall_by_amount", "per_month_protected_inr",
        F.round(F.col("fraud_amount_caught_inr") - missed, 2).alias("net_protected_value"))


def headline(report: DataFrame) -> DataFrame:
    return report.select(
        F.col("fraud_amount_caught_inr").alias("total_protected_inr"), F.col("per_month_protected_inr").alias("monthly_protected_inr"),
        F.col("recall_by_amount").alias("fraud_amount_blocked_rate"), F.col("recall_by_count").alias("fraud_events_blocked_rate"))


def signal_lift(df: DataFrame, features: list[str], label: str = "is_fraud") -> DataFrame:
    """Per feature: mean over held fraud, over allowed legitimate rows, their ratio, held-fraud p90."""
    held = (F.col("action") == "hold") & (F.col(label) == 1)
    allowed = (F.col("action") == "allow") & (F.col(label) == 0)
    grp = F.when(held, "held").when(allowed, "allowed")
    long = (df.withColumn("grp", grp).filter(F.col("grp").isNotNull())
            .select("grp", *[F.col(f).cast("double").alias(f) for f in features])
            .unpivot(["grp"], features, "feature", "value").filter(F.col("value").isNotNull()))
    means = long.groupBy("feature").agg(
        F.coalesce(F.avg(F.when(F.col("grp") == "held", F.col("value"))), F.lit(0.0)).alias("hf"),
        F.coalesce(F.avg(F.when(F.col("grp") == "allowed", F.col("value"))), F.lit(0.0)).alias("al"))
    p90 = R.quantiles(long.filter(F.col("grp") == "held"), "value", [0.9], ["feature"])
    return means.join(p90, "feature", "left").select(
        "feature", F.round("hf", 3).alias("held_fraud_mean"), F.round("al", 3).alias("allowed_legit_mean"),
        F.when(F.col("al") > 1e-9, F.round(F.col("hf") / F.when(F.col("al") > 1e-9, F.col("al")), 2)).alias("lift"),
        F.round(F.coalesce(F.col("q")[0], F.lit(0.0)), 3).alias("held_fraud_p90"))


def top_categories(df: DataFrame, n: int = 5, label: str = "is_fraud") -> DataFrame:
    f = df.filter(F.col(label) == 1).groupBy("merchant_category_code").agg(
        (F.sum(X.money_units("amount")) / F.lit(10000.0)).alias("amt"))
    return f.orderBy(F.desc("amt"), "merchant_category_code").limit(n).select(
        F.col("merchant_category_code").alias("mcc"), inr("amt").alias("fraud_amount_inr"))


def decision_parity(metrics: DataFrame, counts: DataFrame, recorded: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Recomputed AUC within tolerance of the record, and identical action counts."""
    j = attach_row(attach_row(metrics, counts), recorded)
    same = ((F.col("n_allow") == F.col("rec_allow")) & (F.col("n_review") == F.col("rec_review")) & (F.col("n_hold") == F.col("rec_hold")))
    return j.withColumn("matches", (F.abs(F.col("roc_auc") - F.col("rec_roc_auc")) <= tolerance) & same)


def require_parity(parity: DataFrame) -> DataFrame:
    """Fail the job rather than publish figures of a different decision stream."""
    return parity.filter(F.when(F.coalesce("matches", F.lit(False)), True).otherwise(
        F.raise_error(F.lit("decision stream differs from the recorded configuration")).cast("boolean")))

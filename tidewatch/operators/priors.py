"""Train-only priors and frequency encodings, and the model's feature row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X
from tidewatch.functions.frame import attach_row


def fit_merchant_rates(train: DataFrame) -> DataFrame:
    """Per merchant: rows and fraud rate (6 digits, half even). Call it on train rows only."""
    return train.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("n"), X.half_even(F.avg("is_fraud"), 6).alias("rate"))


def default_rate(train: DataFrame) -> DataFrame:
    return train.agg(X.half_even(F.avg("is_fraud"), 8).alias("default_rate"))


def fit_shares(train: DataFrame, column: str) -> DataFrame:
    """Share of train rows per category (8 digits, half even)."""
    total = train.agg(F.count(F.lit(1)).alias("total"))
    counts = train.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return attach_row(counts, total).select(
        column, X.half_even(F.col("n") / F.greatest("total", F.lit(1)), 8).alias("share"))


def fit(train: DataFrame) -> dict[str, DataFrame]:
    """All priors of the train rows; one grouping per category column."""
    total = train.agg(F.count(F.lit(1)).alias("total"))
    share = X.half_even(F.col("n") / F.greatest("total", F.lit(1)), 8)
    return {
        "merchants": attach_row(fit_merchant_rates(train), total).select(
            "merchant_id", F.col("rate").alias("_rate"), share.alias("_share")),
        "mcc": fit_shares(train, "merchant_category_code").withColumnRenamed("share", "_mcc_share"),
        "default": default_rate(train),
    }


def with_placeholders(df: DataFrame) -> DataFrame:
    """Typed-null columns for what only a fitted prior can fill."""
    have = [c for c in df.columns if c not in C.ENCODING_COLUMNS]
    return df.select(*have, *[F.lit(None).cast("double").alias(c) for c in C.ENCODING_COLUMNS])


def attach(df: DataFrame, p: dict[str, DataFrame]) -> DataFrame:
    """Join the priors; unseen categories take the defaults, rates stay in [0, 1].

    Category codes come from a short standard list, so their shares are
    broadcast. The merchant table grows with the data, so its join is left to
    the planner, which broadcasts it only below its own size limit.
    """
    keep = [c for c in df.columns if c not in C.ENCODING_COLUMNS]
    out = attach_row(
        df.select(*keep).join(p["merchants"], "merchant_id", "left")
        .join(F.broadcast(p["mcc"]), "merchant_category_code", "left"), p["default"])
    return out.select(
        *keep, F.coalesce("_share", F.lit(0.0)).alias("merch_freq_share"),
        X.clip(F.coalesce("_rate", "default_rate"), 0.0, 1.0).alias("merch_fraud_rate_prior"),
        F.coalesce("_mcc_share", F.lit(0.0)).alias("mcc_freq_share"))


def join_velocity(df: DataFrame, velocity: DataFrame) -> DataFrame:
    """Left join of replayed features; on a name clash the replayed prior wins."""
    names = [c for c in velocity.columns if c != "transaction_id"]
    return df.drop(*names).join(velocity, "transaction_id", "left")


def online_features(base: DataFrame, velocity: DataFrame, columns: list[str]) -> DataFrame:
    """The model's columns in order: base values, and velocity where base has none."""
    v = velocity.select("transaction_id", *[F.col(c).alias(f"_v_{c}") for c in velocity.columns if c != "transaction_id"])
    j = base.join(v, "transaction_id", "left")

    def pick(c):
        parts = [F.col(c).cast("double")] if c in base.columns else []
        parts += [F.col(f"_v_{c}")] if f"_v_{c}" in j.columns else []
        return (F.coalesce(*parts) if parts else F.lit(None).cast("double")).alias(c)

    return j.select("transaction_id", *[pick(c) for c in columns])


def interval_bin(log_gap: Column, bins: int = 64, longest: float = 3e7) -> Column:
    """Bin 0..bins-1 of a log1p gap; gaps of about a year and more share the last bin."""
    frac = F.least(F.greatest(log_gap / math.log1p(longest), F.lit(0.0)), F.lit(0.9999))
    return F.floor(frac * bins)

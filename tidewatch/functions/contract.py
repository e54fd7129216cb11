"""The online event contract: normalise, name the broken rules, split good from bad."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values: (column, required, shortest, longest).
LENGTHS = (
    ("transaction_id", True, 1, 128),
    ("customer_id", True, 1, 128),
    ("card_id", True, 1, 128),
    ("merchant_id", True, 1, 256),
    ("merchant_category_code", False, 0, 16),
    ("currency", True, 3, 3),
    ("merchant_city", False, 0, 128),
    ("merchant_state", False, 0, 128),
    ("merchant_country", False, 2, 2),
    ("device_id", False, 0, 256),
    ("ip_hash", False, 0, 128),
    ("payment_channel", False, 0, 64),
)


def normalise_event(df: DataFrame) -> DataFrame:
    """Trim every text and upper-case the currency (USD when absent)."""
    cols = []
    for c, t in df.dtypes:
        v = F.trim(c) if t == "string" else F.col(c)
        if c == "currency":
            v = F.upper(F.coalesce(v, F.lit("USD")))
        cols.append(v.alias(c))
    return df.select(*cols)


def violations(columns: list[str]) -> Column:
    """Names of the broken rules, sorted as listed; empty when the event is valid."""
    rules = []
    for c, required, lo, hi in LENGTHS:
        if c not in columns:
            continue
        n = F.length(c)
        bad = (n < lo) | (n > hi)
        rules.append(F.when(F.coalesce(bad, F.lit(required)), f"{c}_length"))
    if "event_time" in columns:
        rules.append(F.when(F.col("event_time").isNull(), "event_time_missing"))
    amount = F.col("amount")
    rules.append(F.when(F.coalesce(amount <= 0, F.lit(True)), "amount_not_positive"))
    rules.append(F.when(amount >= 10_000_000_000, "amount_digits"))
    rules.append(F.when(F.round(amount, 2) != amount, "amount_decimals"))
    return F.array_compact(F.array(*rules))


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected events with their violations)."""
    checked = normalise_event(df).withColumn("violations", violations(df.columns))
    return (checked.filter(F.size("violations") == 0).drop("violations"),
            checked.filter(F.size("violations") > 0))

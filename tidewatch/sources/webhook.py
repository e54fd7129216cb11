"""Payment webhooks: nested JSON to the canonical event, plus retained context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.schemas import WEBHOOK_CONTEXT_KEYS, WEBHOOK_SCHEMA

# Payment method -> channel; a card is resolved by presence.
METHOD_CHANNELS = {"upi": "upi", "wallet": "wallet", "netbanking": "online", "emandate": "online"}


def parse(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to columns; works on batch and streaming frames alike."""
    return df.select(F.from_json(F.col(value).cast("string"), WEBHOOK_SCHEMA).alias("w")).select("w.*")


def method_channel(method: Column, present: Column) -> Column:
    m = F.lower(F.coalesce(F.when(method != "", method), F.lit("card")))
    out = None
    for name, channel in METHOD_CHANNELS.items():
        out = F.when(m == name, channel) if out is None else out.when(m == name, channel)
    return out.otherwise(F.when(F.coalesce(present, F.lit(False)), "chip").otherwise("online"))


def _first(*cols: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def paise_to_usd(paise: Column) -> Column:
    """Exact decimal division by 100 and by 83.5, two digits, half even."""
    inr = paise.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")
    return F.bround(inr.cast("decimal(22,2)") / F.lit("83.5").cast("decimal(3,1)"), 2).cast("decimal(12,2)")


def to_event(w: DataFrame) -> DataFrame:
    """Canonical event with id fall-backs; rows with amount <= 0 keep amount null."""
    return w.select(
        F.coalesce(_first(F.col("payment_id"), F.col("event_id")), F.lit("webhook-txn")).alias("transaction_id"),
        F.try_to_timestamp(F.col("timestamp")).alias("event_time"),
        F.coalesce(_first(F.col("customer_id"), F.col("customer.id")), F.lit("C-UNKNOWN-0000")).alias("customer_id"),
        F.coalesce(_first(F.col("card_id"), F.col("card.id")), F.lit("NOCARD-0000")).alias("card_id"),
        F.coalesce(_first(F.col("merchant_id"), F.col("merchant.id")), F.lit("MERCHANT-UNKNOWN")).alias("merchant_id"),
        _first(F.col("mcc"), F.col("merchant_category_code")).alias("merchant_category_code"),
        F.when(F.col("amount") > 0, paise_to_usd(F.col("amount"))).alias("amount"),
        F.upper(F.coalesce(_first(F.col("currency")), F.lit("INR"))).alias("currency"),
        F.substring(F.coalesce(_first(F.col("merchant_country")), F.lit("IN")), 1, 2).alias("merchant_country"),
        _first(F.col("device_id")).alias("device_id"), _first(F.col("ip_hash")).alias("ip_hash"),
        method_channel(F.col("method"), F.col("card_present").cast("boolean")).alias("payment_channel"),
        context_map().alias("context"))


def context_map(columns: list[str] | None = None) -> Column:
    """The non-null context keys that no model reads."""
    keys = [k for k in WEBHOOK_CONTEXT_KEYS if columns is None or k in columns]
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(f"`{k}`") for k in keys]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())

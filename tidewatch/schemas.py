"""Row types shared by sources, operators and streams."""

from __future__ import annotations

from pyspark.sql import types as T

# Headers of the raw card table, canonical name -> header.
RAW_HEADERS = {
    "customer_id": "User",
    "card_id": "Card",
    "year": "Year",
    "month": "Month",
    "day": "Day",
    "time": "Time",
    "amount": "Amount",
    "payment_channel": "Use Chip",
    "merchant_id": "Merchant Name",
    "merchant_city": "Merchant City",
    "merchant_state": "Merchant State",
    "merchant_zip": "Zip",
    "merchant_category_code": "MCC",
    "errors": "Errors?",
    "is_fraud": "Is Fraud?",
}

RAW_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in RAW_HEADERS.values()])

TXN_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("card_id", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("merchant_category_code", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("merchant_city", T.StringType()),
    T.StructField("merchant_state", T.StringType()),
    T.StructField("merchant_zip", T.StringType()),
    T.StructField("payment_channel", T.StringType()),
    T.StructField("payment_error", T.StringType()),
    T.StructField("is_fraud", T.ByteType()),
])

EPISODE_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("fraud_probability", T.DoubleType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("fail_type", T.StringType()),
    T.StructField("event", T.MapType(T.StringType(), T.StringType())),
    T.StructField("reasons", T.ArrayType(T.StringType())),
    T.StructField("feedback_at", T.StringType()),
    T.StructField("source", T.StringType()),
])

MODEL_CONFIG_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("feature_set", T.StringType()),
    T.StructField("training_rows", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("calibration_scale_pos_weight", T.DoubleType()),
    T.StructField("feature_columns", T.ArrayType(T.StringType())),
    T.StructField("thresholds", T.StructType([
        T.StructField("hold", T.DoubleType()), T.StructField("review", T.DoubleType())])),
    T.StructField("metrics_validation", T.StructType([
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("average_precision", T.DoubleType())])),
    T.StructField("metrics_test_locked", T.StructType([
        T.StructField("rows", T.LongType()),
        T.StructField("frauds", T.LongType()),
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("average_precision", T.DoubleType()),
        T.StructField("action_counts", T.MapType(T.StringType(), T.LongType()))])),
])

# Context keys of a payment webhook kept beside the canonical event.
WEBHOOK_CONTEXT_KEYS = (
    "method", "device_id", "ip_hash", "order_id", "payment_intent_id",
    "checkout_session_id", "3ds_status", "step_up_required",
    "card_present", "refund_id", "chargeback", "refund_reason",
    "address_city", "address_country", "gateway_metadata",
    "emi_tenure", "bank_code", "wallet_provider", "auth_status",
)

_ID = T.StructType([T.StructField("id", T.StringType())])
WEBHOOK_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in (
        "payment_id", "event_id", "customer_id", "card_id", "merchant_id", "mcc",
        "merchant_category_code", "currency", "timestamp", "merchant_country", "error_code")]
    + [T.StructField("amount", T.LongType())]
    + [T.StructField(c, _ID) for c in ("customer", "card", "merchant")]
    + [T.StructField(c, T.StringType()) for c in WEBHOOK_CONTEXT_KEYS]
)

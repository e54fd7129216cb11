"""Fixed-length event sequences per customer, padded at the front."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.operators.positions import last_n

# Category ids; 0 is padding.
CHANNEL_IDS = {"swipe": 1, "chip": 2, "online": 3}
CHANNEL_UNKNOWN, ERROR_NONE, ERROR_SOME, MCC_UNKNOWN = 4, 1, 2, 1
PAD_LABEL = -100


def channel_id(channel):
    low = F.lower(channel)
    out = None
    for word, i in CHANNEL_IDS.items():
        out = F.when(low.contains(word), i) if out is None else out.when(low.contains(word), i)
    return out.otherwise(CHANNEL_UNKNOWN)


def error_id(err):
    return F.when(F.trim(F.coalesce(err, F.lit(""))) == "", ERROR_NONE).otherwise(ERROR_SOME)


def mcc_vocabulary(txn: DataFrame) -> DataFrame:
    """Category code -> id from 2 upwards in code order: does not depend on row order.

    Merchant category codes are a four-digit standard, so the list is short.
    """
    codes = txn.select("merchant_category_code").filter(
        F.coalesce("merchant_category_code", F.lit("")) != "").distinct()
    return codes.select("merchant_category_code", (F.row_number().over(
        Window.orderBy("merchant_category_code")) + 1).alias("mcc_id"))


def sequence_tail(txn: DataFrame, length: int) -> DataFrame:
    """The last `length` events per customer as arrays of that length.

    Gaps and ratios are taken inside the kept events. Padding stands in front:
    zeros, ratio 1, label -100, pad_mask true.
    """
    vocab = mcc_vocabulary(txn)
    kept = last_n(txn, "customer_id", length).join(
        F.broadcast(vocab), "merchant_category_code", "left")
    w = Window.partitionBy("customer_id").orderBy(F.desc("back"))
    prev_t, prev_a = F.lag(F.unix_micros("event_time")).over(w), F.lag("amount").over(w)
    rows = kept.select(
        "customer_id", (-F.col("back")).alias("at"), "transaction_id",
        F.log1p(F.greatest("amount", F.lit(0.0))).alias("amount_log1p"),
        F.coalesce(F.log1p((F.unix_micros("event_time") - prev_t) / 1e6), F.lit(0.0)).alias("interval_log1p"),
        F.when(prev_a.isNull(), 1.0).otherwise(
            F.least(F.greatest(F.col("amount") / F.greatest(prev_a, F.lit(1e-6)), F.lit(0.0)), F.lit(50.0)))
        .alias("prev_amount_ratio"),
        F.coalesce("mcc_id", F.lit(MCC_UNKNOWN)).alias("mcc_id"),
        channel_id(F.col("payment_channel")).alias("channel_id"),
        error_id(F.col("payment_error")).alias("error_id"),
        F.col("is_fraud").cast("long").alias("label"))
    names = ["amount_log1p", "interval_log1p", "prev_amount_ratio", "mcc_id", "channel_id", "error_id", "label",
             "transaction_id"]
    # At most `length` rows per customer reach this list.
    packed = rows.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("at", *names))).alias("s"))
    missing = F.lit(length) - F.size("s")

    def padded(name, fill):
        return F.concat(F.array_repeat(F.lit(fill), missing), F.col(f"s.{name}")).alias(name)

    return packed.select(
        "customer_id", F.size("s").alias("kept"),
        padded("amount_log1p", 0.0), padded("interval_log1p", 0.0), padded("prev_amount_ratio", 1.0),
        padded("mcc_id", 0), padded("channel_id", 0), padded("error_id", 0),
        F.concat(F.array_repeat(F.lit(PAD_LABEL).cast("long"), missing), F.col("s.label")).alias("label"),
        F.concat(F.array_repeat(F.lit(True), missing), F.array_repeat(F.lit(False), F.size("s"))).alias("pad_mask"),
        F.col("s.transaction_id").alias("transaction_ids"))

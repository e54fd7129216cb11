"""Adapters from the supplied tables to the engine's row types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions import expr as X


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_to_txn(events: DataFrame) -> DataFrame:
    """Map an event table to transactions; also applies to a streaming frame."""
    k = F.regexp_extract("props", "[0-9]+", 0)
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        user.alias("customer_id"),
        F.concat(user, F.lit("::"), (F.col("event_id") % 2).cast("string")).alias("card_id"),
        F.concat(F.lit("m"), k).alias("merchant_id"),
        (k.cast("int") % 10).cast("string").alias("merchant_category_code"),
        F.col("value").alias("amount"),
        F.lit("USD").alias("currency"),
        F.when(kind == "view", "Swipe Transaction").when(kind == "purchase", "Chip Transaction")
        .otherwise("Online Transaction").alias("payment_channel"),
        F.when(kind == "error", "Bad PIN").alias("payment_error"),
        F.when(F.col("user_id") % 2 == 1, F.concat(F.lit("d"), (k.cast("int") % 7).cast("string")))
        .alias("device_id"),
        F.when(F.col("event_id") % 101 == 0, 1).otherwise(0).alias("is_fraud"),
    )


def lines_to_txn(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines as transactions: day-granular times, so many ties."""
    key = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return (
        lineitem.join(orders.select("o_orderkey", "o_custkey"),
                      F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
            F.concat_ws("-", *key).alias("transaction_id"),
            F.col("l_shipdate").cast("timestamp").alias("event_time"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.concat(F.col("o_custkey").cast("string"), F.lit("::"),
                     (F.col("l_orderkey") % 2).cast("string")).alias("card_id"),
            F.col("l_suppkey").cast("string").alias("merchant_id"),
            F.concat(F.lit("c"), (F.col("l_partkey") % 25).cast("string"))
            .alias("merchant_category_code"),
            F.col("l_extendedprice").alias("amount"),
            F.lit("USD").alias("currency"),
            F.when(F.col("l_returnflag") == "A", "Swipe Transaction")
            .when(F.col("l_returnflag") == "N", "Chip Transaction")
            .otherwise("Online Transaction").alias("payment_channel"),
            F.lit(None).cast("string").alias("payment_error"),
            F.lit(None).cast("string").alias("device_id"),
            F.when(F.col("l_orderkey") % 97 == 0, 1).otherwise(0).alias("is_fraud"),
            (((F.col("l_orderkey") * 48271 + F.col("l_linenumber") * 69621
               + F.col("l_partkey") * 16807 + F.col("l_suppkey") * 31) % 1000003)).alias("h"),
        )
    )


def score_stream(lines: DataFrame) -> DataFrame:
    """A deterministic pseudo-score per line (integer arithmetic), split by time.

    The level moves up in 2000, so drift has something to find.
    """
    h = F.col("h")
    cube = F.floor(F.floor(h * h / 1000003) * h / 1000003)
    micro = (1 + F.floor(cube * 6 / 10) + F.when(F.col("is_fraud") == 1, 250000).otherwise(0)
             + F.when(F.year("event_time") >= 2000, 50000).otherwise(0))
    score = micro / F.lit(1000000.0)
    return lines.withColumn("score", score).drop("h").withColumn(
        "split",
        F.when(F.col("event_time") < F.lit("1999-03-01").cast("timestamp"), "train")
        .when(F.col("event_time") < F.lit("2000-07-01").cast("timestamp"), "val").otherwise("test"),
    ).withColumn("action", X.band("score", 0.6, 0.35))


def decisions(txn: DataFrame) -> DataFrame:
    """One scored decision per event, with the outcome that came back later."""
    h = (F.col("seq") * 7919 + 104729) % 100003
    p = F.least(F.floor(h * h / 100003), F.lit(99999)) / F.lit(100000.0)
    d = txn.withColumn("fraud_probability", p).withColumn("action", X.band("fraud_probability", 0.55, 0.25))
    return d.withColumn(
        "model_version", F.when(F.col("seq") % 3 == 0, "online-v2").otherwise("online-v3")
    ).withColumn("outcome", F.when(F.col("is_fraud") == 1, "fraud").otherwise("legit"))


def episodes(dec: DataFrame) -> DataFrame:
    """Feedback episodes: every decision with its outcome, an event map and reasons."""
    return dec.select(
        "seq", "transaction_id", "model_version", "action", "fraud_probability", "outcome",
        X.fail_type("action", "outcome").alias("fail_type"),
        F.create_map(
            F.lit("transaction_id"), F.col("transaction_id"),
            F.lit("customer_id"), F.col("customer_id"),
            F.lit("card_id"), F.col("card_id"),
            F.lit("merchant_id"), F.col("merchant_id"),
            F.lit("amount"), F.format_string("%.2f", F.col("amount")),
            F.lit("payment_channel"), F.col("payment_channel")).alias("event"),
        F.array(F.lit("model_score")).alias("reasons"),
        F.date_format(F.col("event_time"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("feedback_at"),
        F.lit("feedback").alias("source"),
    )


def repair_log(txn: DataFrame) -> DataFrame:
    """Operational failures told by event type, and whether the repair worked."""
    n = F.col("transaction_id")
    ch = F.col("payment_channel")
    text = (
        F.when(F.col("payment_error").isNotNull(), F.concat(F.lit("Request timed out after "), n, F.lit(" ms")))
        .when(ch == "Swipe Transaction", F.concat(F.lit("Connection refused by host "), F.col("merchant_category_code")))
        .when(ch == "Chip Transaction", F.concat(F.lit("missed_fraud on transaction "), n))
        .when(F.col("seq") % 4 == 0, F.concat(F.lit("Rate limit: quota of "), n))
        .when(F.col("seq") % 4 == 1, F.concat(F.lit("HTTP 503 from endpoint "), F.col("merchant_category_code")))
        .otherwise(F.concat(F.lit("Strange state "), n))
    )
    return txn.select("seq", "transaction_id", "event_time", "merchant_id",
                      text.alias("error_text"), (F.col("amount") > 10.0).alias("success"))


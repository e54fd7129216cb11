"""Raw card tables: strict reading, profile, canonical form, chronological splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch.functions import expr as X
from tidewatch.functions.frame import attach_row
from tidewatch.operators import ranking as R
from tidewatch.schemas import RAW_HEADERS, RAW_SCHEMA


def read_raw(spark: SparkSession, path: str, row_limit: int | None = None) -> DataFrame:
    """Strict CSV: text columns by schema, and a malformed line fails the read."""
    df = (spark.read.option("header", True).option("mode", "FAILFAST")
          .option("enforceSchema", False).schema(RAW_SCHEMA).csv(path))
    return df if row_limit is None else df.limit(row_limit)


def missing_columns(df: DataFrame) -> list[str]:
    return sorted(set(RAW_HEADERS.values()) - set(df.columns))


def require_columns(df: DataFrame) -> DataFrame:
    missing = missing_columns(df)
    if missing:
        raise ValueError(f"card table is missing expected columns: {', '.join(missing)}")
    return df


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls, smallest and largest value, expected or not."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        aggs += [F.count_if(v.isNull()).alias(f"n{i}"), F.min(v.cast("string")).alias(f"lo{i}"),
                 F.max(v.cast("string")).alias(f"hi{i}")]
    expected = set(RAW_HEADERS.values())
    one = df.agg(*aggs)
    return one.select("rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"n{i}").alias("nulls"),
                 F.col(f"lo{i}").alias("lowest"), F.col(f"hi{i}").alias("highest"),
                 F.lit(c in expected).alias("expected"))
        for i, (c, t) in enumerate(df.dtypes)])).alias("p")).select("p.*", "rows")


def with_file_row_id(df: DataFrame) -> DataFrame:
    """Contiguous row index in scan order, without sorting or a single task.

    Spark numbers rows inside a partition; the partition sizes (one small row
    each) give the offsets.
    """
    m = df.withColumn("_m", F.monotonically_increasing_id())
    m = m.withColumn("_p", F.shiftright("_m", 33))
    sizes = m.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return (m.join(F.broadcast(offsets), "_p")
            .withColumn("row_id", F.col("_m") - F.shiftleft("_p", 33) + F.col("_o")).drop("_m", "_p", "_o"))


def event_time(year, month, day, hhmm):
    return F.to_timestamp(
        F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"), hhmm), "yyyy-MM-dd-HH:mm")


def money(c):
    """Drop everything but digits, dot, backslash and minus; the cast is strict."""
    return F.regexp_replace(X.as_col(c), r"[^0-9.\\-]", "").cast("double")


def label(c):
    v = F.lower(F.trim(X.as_col(c).cast("string")))
    return F.when(v == "yes", 1).when(v == "no", 0).cast("byte")


def card_key(customer, card):
    """`customer::card`; null when either part is null."""
    return F.concat(X.as_col(customer), F.lit("::"), X.as_col(card))


def canonical(raw: DataFrame, row_id: str | None = None) -> DataFrame:
    """The 14 canonical columns; rows without time or amount are left out."""
    src = require_columns(raw)
    if row_id is None:
        src, row_id = with_file_row_id(src), "row_id"
    h = {k: F.col(f"`{v}`") for k, v in RAW_HEADERS.items()}
    return src.select(
        F.col(row_id).cast("string").alias("transaction_id"),
        event_time(h["year"], h["month"], h["day"], h["time"]).alias("event_time"),
        h["customer_id"].alias("customer_id"),
        card_key(h["customer_id"], h["card_id"]).alias("card_id"),
        h["merchant_id"].alias("merchant_id"),
        h["merchant_category_code"].alias("merchant_category_code"),
        money(h["amount"]).alias("amount"),
        F.lit("USD").alias("currency"),
        h["merchant_city"].alias("merchant_city"), h["merchant_state"].alias("merchant_state"),
        h["merchant_zip"].alias("merchant_zip"), h["payment_channel"].alias("payment_channel"),
        h["errors"].alias("payment_error"), label(h["is_fraud"]).alias("is_fraud"),
    ).filter(F.col("event_time").isNotNull() & F.col("amount").isNotNull())


def split_bounds(txn: DataFrame, train: float = 0.6, validation: float = 0.8) -> DataFrame:
    """Nearest-rank time quantiles, as microseconds: columns train_end, validation_end."""
    q = R.nearest_rank(txn.select(X.micros("event_time").alias("us")), "us", [train, validation])
    return q.select(F.col("q0").alias("train_end"), F.col("q1").alias("validation_end"))


def check_bounds(bounds: DataFrame) -> DataFrame:
    ok = F.col("train_end") < F.col("validation_end")
    return bounds.filter(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(
        F.raise_error(F.lit("split bounds must be strictly ordered")).cast("boolean")))


def with_split(txn: DataFrame, bounds: DataFrame) -> DataFrame:
    us = X.micros("event_time")
    return attach_row(txn, bounds).withColumn(
        "split", F.when(us <= F.col("train_end"), "train")
        .when(us <= F.col("validation_end"), "validation").otherwise("test")
    ).drop("train_end", "validation_end")


def split_summary(split_txn: DataFrame) -> DataFrame:
    return split_txn.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min(X.micros("event_time")).alias("min_us"),
        F.max(X.micros("event_time")).alias("max_us"), F.avg("is_fraud").alias("fraud_rate"))


def write_splits(txn: DataFrame, path: str) -> None:
    """zstd parquet, one folder per split, rows in time order inside each file."""
    (with_split(txn, split_bounds(txn)).withColumn("_us", X.micros("event_time"))
     .repartitionByRange("split", "_us").sortWithinPartitions("split", "_us").drop("_us")
     .write.option("compression", "zstd").partitionBy("split").parquet(path))


def write_manifest(split_txn: DataFrame, bounds: DataFrame, path: str) -> None:
    """Bounds and per-split figures as one small JSON file."""
    attach_row(split_summary(split_txn), bounds).coalesce(1).write.json(path)

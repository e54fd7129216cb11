"""The audit ledger: per-row hashes, links between rows, verification, rollups.

The signed body leaves out the previous hash, so every row's hash can be
computed on its own; only the link to the row before needs the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X

LINK_SLICE = 100_000


def record_hash(record_id: Column, event_type: Column, payload_json: Column) -> Column:
    """SHA-256 of the canonical body: sorted keys, compact separators."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    body = F.concat(F.lit('{"event_type":'), quoted(event_type), F.lit(',"id":'), quoted(record_id),
                    F.lit(',"payload":'), payload_json, F.lit("}"))
    return F.sha2(body, 256)


def _previous(df: DataFrame, value: str, name: str) -> DataFrame:
    """Value of the row before in `seq` order, GENESIS for the first.

    Rows are linked inside blocks of `seq`, blocks (by their last value, one row
    a block) inside groups of LINK_SLICE blocks, and only the groups, one row for
    10^10 records, in one task. `_block` and `_at`, the row's place in its block
    from 1, stay for the caller.
    """
    d = df.withColumn("_block", F.floor(F.col("seq") / LINK_SLICE))
    inner = Window.partitionBy("_block").orderBy("seq")
    ends = d.groupBy("_block").agg(F.max_by(value, "seq").alias("_last")).withColumn("_group", F.floor(F.col("_block") / LINK_SLICE))
    groups = ends.groupBy("_group").agg(F.max_by("_last", "_block").alias("_last"))
    groups = groups.select("_group", F.lag("_last").over(Window.orderBy("_group")).alias("_from"))
    carried = F.lag("_last").over(Window.partitionBy("_group").orderBy("_block"))
    ends = ends.withColumn("_carry", carried).join(groups, "_group").select("_block", F.coalesce("_carry", "_from").alias("_carry"))
    return (d.withColumn("_lag", F.lag(value).over(inner))
            .withColumn("_at", F.row_number().over(inner))
            .join(ends, "_block")
            .withColumn(name, F.coalesce(F.when(F.col("_at") == 1, F.col("_carry")).otherwise(F.col("_lag")),
                                         F.lit(C.GENESIS)))
            .drop("_lag", "_carry"))


def chain(records: DataFrame) -> DataFrame:
    """Add `hash` and `prev_hash` to records (seq, id, event_type, payload)."""
    h = records.withColumn("hash", record_hash(F.col("id"), F.col("event_type"), F.col("payload")))
    return _previous(h, "hash", "prev_hash").drop("_block", "_at")


def _checked(ledger: DataFrame) -> DataFrame:
    expect = record_hash(F.col("id"), F.col("event_type"), F.col("payload"))
    linked = _previous(ledger, "hash", "_expected_prev")
    return linked.withColumn("body_ok", F.col("hash") == expect).withColumn(
        "link_ok", F.col("prev_hash") == F.col("_expected_prev")).drop("_expected_prev")


def verify_rows(ledger: DataFrame) -> DataFrame:
    """Per record: body_ok (hash recomputed) and link_ok (previous hash matches)."""
    return _checked(ledger).drop("_block", "_at")


def verify(ledger: DataFrame) -> DataFrame:
    """One row: valid, records, seq of the first broken record and its index.

    The records are checked once; what is left is one row a block, and the index
    of the first broken one is its place in its block behind the blocks before.
    """
    bad = ~(F.col("body_ok") & F.col("link_ok"))
    blocks = _checked(ledger).groupBy("_block").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(bad, F.struct("seq", "_at"))).alias("broken"))
    first = blocks.agg(F.min(F.when(F.col("broken").isNotNull(), F.struct("_block", "broken"))).alias("_bad"))
    before = F.col("_block") < F.col("_bad._block")
    both = blocks.join(F.broadcast(first)).agg(
        F.sum("n").alias("records"), F.first("_bad").alias("_bad"), F.sum(F.when(before, F.col("n"))).alias("_n"))
    return both.select(
        F.col("_bad").isNull().alias("valid"), F.coalesce("records", F.lit(0)).alias("records"),
        F.col("_bad.broken.seq").alias("first_broken_seq"),
        (F.coalesce("_n", F.lit(0)) + F.col("_bad.broken._at") - 1).alias("first_broken_index"))


def daily(ledger: DataFrame, days: int = 14) -> DataFrame:
    """Per UTC day: total, counts by event type and by action; newest days first."""
    day = F.to_date(F.timestamp_seconds("audited_at"))
    d = ledger.select(day.alias("date"), "event_type", F.get_json_object("payload", "$.action").alias("action"))
    per = d.groupBy("date", "event_type", "action").agg(F.count(F.lit(1)).alias("n"))

    def counts(column):
        part = per.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy("date", column).agg(F.sum("n").alias("n"))
        return part.groupBy("date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"by_{column}"))

    total = per.groupBy("date").agg(F.sum("n").alias("total"))
    out = (total.join(counts("event_type"), "date", "left").join(counts("action"), "date", "left"))
    return out.orderBy(F.desc("date")).limit(max(1, days))


def recent(ledger: DataFrame, limit: int = 50) -> DataFrame:
    """Newest records first; between 1 and 200 of them can be asked for."""
    if not 1 <= limit <= 200:
        raise ValueError(f"limit must lie between 1 and 200, not {limit}")
    return ledger.orderBy(F.desc("seq")).limit(limit)


def from_decisions(dec: DataFrame) -> DataFrame:
    """Ledger records of scored decisions, one per decision, `seq` in event order."""
    payload = X.canonical_json(
        transaction_id="transaction_id", model_version="model_version", action="action",
        fraud_probability=F.format_string("%.5f", F.col("fraud_probability")),
        amount=F.format_string("%.2f", F.col("amount")), currency="currency",
        customer_id="customer_id", merchant_id="merchant_id", payment_channel="payment_channel")
    kind = (F.when(F.col("payment_error").isNotNull(), "decision.review_failsafe")
            .when(F.col("device_id").isNull(), "decision.cold_start").otherwise("decision.scored"))
    return dec.select("seq", F.md5("transaction_id").alias("id"), kind.alias("event_type"),
                      payload.alias("payload"), (X.micros("event_time") / F.lit(1e6)).alias("audited_at"))

"""Streams as micro-batches over tables: scoring, ledger, overrides, feedback.

Each micro-batch writes into its own `batch=<id>` folder with overwrite, so a
batch that is replayed after a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener

from tidewatch import config as C
from tidewatch.functions import expr as X, reasons
from tidewatch.operators import audit, memory as MEM, velocity as V
from tidewatch.session import scratch_path
from tidewatch.sources.adapters import events_to_txn

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None,
                 glob: str | None = None) -> DataFrame:
    """Transactions from a folder of event files, as they arrive."""
    r = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return events_to_txn(r.parquet(path))


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stream_settings(spark: SparkSession, timed: bool = False, partitions: int | None = None) -> Iterator[None]:
    """Settings a stream takes over when it starts; the session gets its own back.

    State lives in RocksDB. Its pieces are fixed for the life of a checkpoint:
    `partitions`, or the session's shuffle partitions up to twice its cores.
    State with a processing-time expiry asks for empty batches without end, so
    `timed` streams run with those switched off.
    """
    pieces = partitions or min(int(spark.conf.get(PARTITIONS)), 2 * spark.sparkContext.defaultParallelism)
    wanted = {PROVIDER: ROCKSDB, PARTITIONS: str(pieces)}
    if timed:
        wanted[NO_DATA] = "false"
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run_available(stream: DataFrame, name: str, path: str | None = None, timed: bool = False,
                  partitions: int | None = None) -> str:
    """Process what is there, append to parquet, stop; returns the output folder."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    with stream_settings(spark, timed, partitions):
        (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{path}-checkpoint").option("path", path)
         .trigger(availableNow=True).start().awaitTermination())
    return path


def run_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], name: str, mode: str = "append"):
    """foreachBatch over what is there; returns the finished query for its progress."""
    spark = stream.sparkSession
    path = scratch_path(spark, f"{name}-checkpoint")
    with stream_settings(spark):
        q = (stream.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", path)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return q


class BatchProgress(StreamingQueryListener):
    """One stored row a finished micro-batch: its number, its input rows and what the stream observed in it.

    The figures are those of `DataFrame.observe`, so they come with the batch and need
    no second pass. A batch that runs again after a restart overwrites its row. Rows are
    told by the name of the observation, so one listener serves one stream.
    """

    def __init__(self, spark: SparkSession, name: str, root: str) -> None:
        self.spark, self.name, self.root = spark, name, root

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is None:
            return
        figures = {k: F.lit(v) for k, v in seen.asDict().items()}
        row = self.spark.range(1).select(F.lit(str(p.runId)).alias("run"), F.lit(p.timestamp).alias("at"),
                                         F.lit(int(p.numInputRows)).cast("long").alias("input_rows"), *[v.alias(k) for k, v in figures.items()])
        write_batch(row, self.root, p.batchId)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def run_observed(stream: DataFrame, name: str, progress: str, figures: list[Column], path: str | None = None) -> str:
    """`run_available` with `figures` observed batch by batch; their rows are in `progress` when it returns."""
    spark = stream.sparkSession
    listener = BatchProgress(spark, name, progress)
    spark.streams.addListener(listener)
    try:
        return run_available(stream.observe(name, *figures), name, path)
    finally:
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()  # progress is told asynchronously
        spark.streams.removeListener(listener)


def write_batch(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def read_batches(spark: SparkSession, root: str, before: int | None = None, schema: T.StructType | None = None) -> DataFrame | None:
    """All finished batches of a table, or None when there are none yet.

    Tables whose batches may be without any file name their `schema`.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    numbers = [int(f.getPath().getName()[6:]) for f in files.listStatus(path) if f.getPath().getName().startswith("batch=")]
    done = [n for n in numbers if before is None or n < before]
    if not done:
        return None
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    df = reader.parquet(root)
    return df if before is None else df.filter(F.col("batch") < before)


def append_history(df: DataFrame, root: str, batch_id: int, at: str = "event_time") -> None:
    """Store a batch of events by batch and by day, so that later batches list the days they need and no more."""
    df.withColumn("day", F.to_date(at)).write.mode("overwrite").partitionBy("day").parquet(f"{root}/batch={batch_id}")


def recent_history(history: DataFrame, batch: DataFrame, entities=C.CATALOGUE) -> DataFrame:
    """History rows a batch can still see: inside the longest window before its first event, and not after its last.

    With a `day` column, as `append_history` leaves it, the bounds are literals on folders.
    """
    span = max(C.WINDOW_SECONDS[w.label] for e in entities for w in e.windows)
    us = X.micros("event_time")
    first, last = batch.agg(F.min(us), F.max(us)).first()
    if first is None:
        return history.limit(0)
    low, high = (F.timestamp_micros(F.lit(x)) for x in (first - span * 1_000_000, last))
    if "day" in history.columns:
        history = history.filter(F.col("day").between(F.to_date(low), F.to_date(high)))
    return history.filter(F.col("event_time").between(low, high))


def sweep_batch(history: DataFrame | None, batch: DataFrame, entities=C.CATALOGUE) -> DataFrame:
    """Window features of a batch by the batch sweep over recent history and the batch.

    Hot entities are cut into slices there, so no task holds one entity.
    """
    windows = tuple(C.Entity(e.name, e.id_col, e.windows, ()) for e in entities)
    rows = batch if history is None else batch.unionByName(recent_history(history, batch, windows).select(batch.columns))
    return V.velocity_features(rows, windows).join(batch.select("transaction_id"), "transaction_id", "left_semi")


def decide(features: DataFrame, hold: float, review: float, probability) -> DataFrame:
    """Cold entities take the rules, others the model; no score means review."""
    cold = reasons.cold_flag("cust_txn_count_prior", "card_txn_count_prior", "merch_txn_count_prior")
    score, action, _ = reasons.cold_risk(features.columns)
    d = features.withColumn("is_cold_start", cold).withColumn("_p", probability)
    failed = ~F.col("is_cold_start") & F.col("_p").isNull()
    return d.withColumn("fraud_probability", F.when(F.col("is_cold_start"), score).otherwise(F.round("_p", 6))).withColumn(
        "action", F.when(F.col("is_cold_start"), action).when(failed, "review").otherwise(X.band("_p", hold, review))).withColumn(
        "event_type", F.when(F.col("is_cold_start"), "decision.cold_start").when(failed, "decision.review_failsafe")
        .otherwise("decision.scored")).withColumn("security_action", X.security_action("action")).drop("_p")


def append_ledger(spark: SparkSession, records: DataFrame, root: str, batch_id: int) -> None:
    """Chain a batch of records behind the ledger's last row and append it.

    Each batch leaves its last (seq, hash) in `<root>-heads`, one row a batch, so
    no later batch reads the ledger itself. A replayed batch overwrites both.
    """
    heads = f"{root}-heads"
    chained = audit.chain(records)
    old = read_batches(spark, heads, before=batch_id)
    if old is None:  # a ledger from before there were heads
        old = read_batches(spark, root, before=batch_id)
    if old is not None:
        last = old.agg(F.max_by("hash", "seq").alias("_last"))
        chained = chained.join(F.broadcast(last)).withColumn("prev_hash", F.when(
            F.col("prev_hash") == C.GENESIS, F.coalesce("_last", F.lit(C.GENESIS))).otherwise(F.col("prev_hash"))).drop("_last")
    write_batch(chained, root, batch_id)
    written = spark.read.schema("seq long, hash string").parquet(f"{root}/batch={batch_id}")
    write_batch(written.agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash")).filter("seq IS NOT NULL"),
                heads, batch_id)


def append_once(spark: SparkSession, rows: DataFrame, root: str, batch_id: int, key: str, at: str = "event_time") -> None:
    """Append the rows whose `key` no earlier batch has stored; nothing expires.

    Rows are stored by the day of `at`, and a batch reads the keys of its own days
    only: a repeated delivery has the time of the first. Rows without a key cannot
    be recognised and all stay; rows without a time share one folder.
    """
    day = rows.withColumn("day", F.to_date(at))
    new = day.filter(F.col(key).isNotNull()).dropDuplicates([key])
    old = read_batches(spark, root, before=batch_id, schema=day.schema)
    if old is not None:
        span = day.agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count_if(F.col("day").isNull()).alias("none")).first()
        seen = F.lit(span["none"] > 0) & F.col("day").isNull()
        if span["lo"] is not None:
            seen |= F.col("day").between(F.lit(span["lo"]), F.lit(span["hi"]))  # literals prune the folders
        new = new.join(old.filter(seen).select(key), key, "left_anti").select(day.columns)
    kept = new.unionByName(day.filter(F.col(key).isNull()))
    kept.write.mode("overwrite").partitionBy("day").parquet(f"{root}/batch={batch_id}")


def apply_current_overrides(decisions: DataFrame, thresholds_path: str, hold: float, review: float) -> DataFrame:
    """Re-read the threshold table for every batch, so a change takes effect with the next one."""
    spark = decisions.sparkSession
    merchant = spark.read.parquet(thresholds_path)
    glob = merchant.agg(F.lit(None).cast("double").alias("g_hold"), F.lit(None).cast("double").alias("g_review"))
    return MEM.apply_overrides(decisions, merchant, glob, hold, review)


def match_feedback(spark: SparkSession, feedback: DataFrame, decisions: DataFrame, episodes: str, unmatched: str,
                   batch_id: int, order: str = "event_time") -> None:
    """Outcomes of a micro-batch meet the stored decisions, however late they come.

    `feedback` has (transaction_id, outcome, ...), `decisions` is the stored table of
    audited decisions; of several for one id the first by `order` counts. What meets a
    decision goes to the `episodes` table, everything else, outcomes without an id
    included, to `unmatched` with its reason; no outcome is lost. A batch of outcomes
    is small beside the decisions, so the planner broadcasts it or shuffles, as its
    size asks for.
    """
    asked = feedback.select("transaction_id").distinct()
    d = decisions.join(asked, "transaction_id", "left_semi").groupBy(F.col("transaction_id").alias("_id")).agg(F.min_by(
        F.struct(*[c for c in decisions.columns if c != "transaction_id"]), F.struct(F.isnull(order), order)).alias("_d"))
    met = feedback.join(d, F.col("transaction_id") == F.col("_id"), "left")
    taken = [c for c in decisions.columns if c != "transaction_id" and c not in feedback.columns]
    write_batch(met.filter(F.col("_id").isNotNull()).select(*feedback.columns, *[f"_d.{c}" for c in taken]), episodes, batch_id)
    error = F.concat(F.lit("no audited decision for transaction '"), F.coalesce("transaction_id", F.lit("")), F.lit("'"))
    write_batch(met.filter(F.col("_id").isNull()).select(*feedback.columns, error.alias("error")), unmatched, batch_id)

"""Sources and sinks: every query writes or reads through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import config as C
from tidewatch.functions import contract, expr as X
from tidewatch.operators import audit, drift as D, graph as G, models as MD, ranking as R, velocity as V
from tidewatch.plans.registry import query
from tidewatch.plans.scalars import CONTRACT_SQL, contract_events, raw_cards
from tidewatch.plans.sqltext import sql
from tidewatch.schemas import RAW_HEADERS
from tidewatch.session import scratch_path, stored
from tidewatch.sources import cards, files, webhook

ID = "transaction_id"
RAW = list(RAW_HEADERS.values())


def raw_csv(t) -> str:
    path = scratch_path(t.spark, "raw-csv")
    (raw_cards(t).select(*[F.col(f"`{c}`") for c in RAW]).write.option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


_RAW_SQL = {
    "User": "customer_id", "Card": "CAST(seq % 2 AS VARCHAR)", "Year": "CAST(year(event_time) AS VARCHAR)",
    "Month": "CAST(month(event_time) AS VARCHAR)", "Day": "CAST(day(event_time) AS VARCHAR)",
    "Time": "strftime(event_time, '%H:%M')", "Amount": "'$' || printf('%.2f', amount)",
    "Use Chip": "payment_channel", "Merchant Name": "merchant_id", "Merchant City": "'Austin'",
    "Merchant State": "'TX'", "Zip": "'78701'", "MCC": "merchant_category_code", "Errors?": "payment_error",
    "Is Fraud?": "CASE WHEN is_fraud = 1 THEN ' Yes' WHEN seq % 7 = 0 THEN '?' ELSE 'No ' END"}


@query("src_csv_strict", sql("SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in _RAW_SQL.items()) + " FROM txn", "txn"))
def _(t):
    return cards.read_raw(t.spark, raw_csv(t))


@query("src_required_columns", sql(
    "SELECT m AS missing, count(*) AS rows FROM txn, (VALUES ('Errors?'), ('MCC')) v(m) GROUP BY m", "txn"))
def _(t):
    partial = raw_cards(t).drop("MCC", "Errors?")
    names = F.array(*[F.lit(c) for c in cards.missing_columns(partial)])
    return partial.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(names).alias("missing"), "rows")


@query("src_profile", sql(" UNION ALL ".join(
    f"SELECT '{k.replace(chr(39), chr(39) * 2)}' AS \"column\", 'string' AS dtype, count(*) - count({v}) AS nulls, min({v}) AS lowest, "
    f"max({v}) AS highest, true AS expected, count(*) AS rows FROM txn" for k, v in _RAW_SQL.items()), "txn"))
def _(t):
    return cards.profile(cards.read_raw(t.spark, raw_csv(t)))


@query("src_row_limit", sql("SELECT transaction_id, amount FROM txn ORDER BY seq LIMIT 250", "txn"))
def _(t):
    return t.txn().orderBy("seq").limit(250).select(ID, "amount")


@query("src_parquet", "SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us FROM events")
def _(t):
    return t.raw("events").withColumn("us", X.micros("ts")).drop("ts")


@query("src_parquet_glob", sql("SELECT payment_channel, count(*) AS rows, round(sum(amount), 2) AS amount FROM txn GROUP BY 1", "txn"))
def _(t):
    path = scratch_path(t.spark, "parts")
    t.txn().repartition(4, "payment_channel").write.parquet(path)
    return (t.spark.read.parquet(f"{path}/part-*.parquet").groupBy("payment_channel")
            .agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("amount"), 2).alias("amount")))


@query("src_column_projection", "SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1")
def _(t):
    d = t.raw("lineitem").select("l_suppkey", "l_extendedprice")
    return d.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("src_row_range", sql(
    "SELECT transaction_id, row_id FROM (SELECT transaction_id, row_number() OVER (ORDER BY us, seq, transaction_id) - 1 AS row_id FROM lines) "
    "WHERE row_id >= 2000 AND row_id < 5000", "lines"))
def _(t):
    d = R.numbered(t.lines().withColumn("us", X.micros("event_time")), "us", ["seq", ID])
    return files.row_range(d, "row_id", 2000, 5000).select(ID, "row_id")


@query("src_sample", sql("SELECT transaction_id FROM lines ORDER BY md5('42|' || transaction_id), transaction_id LIMIT 500", "lines"))
def _(t):
    return files.sample_rows(t.lines().select(ID), ID, 500)


def episodes_json(t) -> str:
    path = scratch_path(t.spark, "episodes")
    t.episodes().drop("seq").write.json(path)
    return path


@query("src_ndjson_struct", sql("SELECT transaction_id, merchant_id AS mid, outcome, fail_type FROM epi", "epi"))
def _(t):
    e = files.read_episodes(t.spark, episodes_json(t))
    return e.select(ID, F.col("event")["merchant_id"].alias("mid"), "outcome", "fail_type")


@query("src_jsonl_tolerant", sql(
    "SELECT transaction_id, outcome FROM epi WHERE seq % 10 NOT IN (3, 6, 9)", "epi"))
def _(t):
    s = F.col("seq") % 10
    line = F.to_json(F.struct("transaction_id", "outcome"))
    text = (F.when(s == 3, F.lit("")).when(s == 6, F.concat(line, F.lit("{oops")))
            .when(s == 9, F.to_json(F.struct("outcome"))).otherwise(line))
    path = scratch_path(t.spark, "damaged")
    t.episodes().select(text.alias("value")).write.text(path)
    return files.read_episodes(t.spark, path).select(ID, "outcome")


# -- model registry ---------------------------------------------------------

AUC_SQL = """auc_ AS (
  SELECT name, split, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS frauds,
    CASE WHEN sum(is_fraud) > 0 AND sum(is_fraud) < count(*) THEN
      (sum(CASE WHEN is_fraud = 1 THEN r END) - sum(is_fraud) * (sum(is_fraud) + 1) / 2.0) / (sum(is_fraud) * (count(*) - sum(is_fraud))) END AS roc_auc
  FROM (SELECT merchant_category_code AS name, split, is_fraud,
          rank() OVER (PARTITION BY merchant_category_code, split ORDER BY score)
          + (count(*) OVER (PARTITION BY merchant_category_code, split, score) - 1) / 2.0 AS r FROM scores)
  GROUP BY 1, 2),
models AS (SELECT name, round(max(CASE WHEN split = 'val' THEN roc_auc END), 4) AS val_roc,
    CASE WHEN name NOT LIKE 'c2%' THEN round(max(CASE WHEN split = 'test' THEN roc_auc END), 4) END AS test_roc,
    max(CASE WHEN split = 'test' THEN rows END) AS test_rows,
    max(CASE WHEN split = 'train' THEN rows END) AS training_rows FROM auc_ GROUP BY 1)"""


def model_table(t):
    """A registry with one model per category code, metrics computed from its scores."""
    s = stored(t.scores().select(F.col("merchant_category_code").alias("name"), "split", "score", "is_fraud"), "scores")
    m = MD.metrics_by_model(s, "name")
    n = s.filter(F.col("split") == "train").groupBy("name").agg(F.count(F.lit(1)).alias("training_rows"))
    tested = ~F.col("name").startswith("c2")
    return m.join(n, "name").select(
        "name", F.concat(F.lit("gbt_"), "name").alias("model_name"), F.lit("gbt").alias("backend"),
        F.lit("velocity").alias("feature_set"), "training_rows", F.round("val_roc", 4).alias("val_roc"),
        F.when(tested, F.round("test_roc", 4)).alias("test_roc"), F.when(tested, F.round("test_ap", 4)).alias("test_ap"),
        "test_rows", "test_frauds")


def write_registry(t) -> str:
    path = scratch_path(t.spark, "registry")
    (model_table(t).select(
        "name", "model_name", "backend", "feature_set", "training_rows",
        F.struct(F.lit(0.6).alias("hold"), F.lit(0.35).alias("review")).alias("thresholds"),
        F.struct(F.col("val_roc").alias("roc_auc")).alias("metrics_validation"),
        F.struct(F.col("test_rows").alias("rows"), F.col("test_frauds").alias("frauds"), F.col("test_roc").alias("roc_auc"),
                 F.col("test_ap").alias("average_precision")).alias("metrics_test_locked"))
     .coalesce(1).write.partitionBy("name").json(path))
    return path


@query("src_registry", sql("SELECT name, 'gbt_' || name AS model_name, training_rows, val_roc, test_roc FROM models", "scores", extra=AUC_SQL))
def _(t):
    r = MD.flat(files.read_registry(t.spark, write_registry(t), "*.json"))
    return r.select("name", "model_name", "training_rows", "val_roc", "test_roc")


# -- webhook and foreign tables ---------------------------------------------

def webhook_bodies(t):
    d = t.txn()
    return d.select(F.to_json(F.struct(
        F.col(ID).alias("payment_id"), F.concat(F.lit("o-"), F.col(ID)).alias("order_id"),
        F.struct(F.col("customer_id").alias("id")).alias("customer"), F.struct(F.col("card_id").alias("id")).alias("card"),
        F.struct(F.col("merchant_id").alias("id")).alias("merchant"), F.col("merchant_category_code").alias("mcc"),
        F.when(F.col("seq") % 2 == 0, "upi").otherwise("card").alias("method"),
        F.round(F.col("amount") * 100).cast("long").alias("amount"), F.lit("inr").alias("currency"),
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "device_id",
        F.col("device_id").isNotNull().alias("card_present"))).alias("value"))


@query("src_webhook_json", sql(
    "SELECT transaction_id, epoch_us(date_trunc('second', event_time)) AS us, customer_id, card_id, merchant_id, merchant_category_code, "
    "CASE WHEN round(amount * 100) > 0 THEN printf('%.2f', round_even(CAST(round(amount * 100) AS BIGINT) / 100.0 / 83.5, 2)::DOUBLE) END AS amount_usd, 'INR' AS currency, "
    "CASE WHEN seq % 2 = 0 THEN 'upi' WHEN device_id IS NOT NULL THEN 'chip' ELSE 'online' END AS payment_channel, device_id, "
    "CASE WHEN device_id IS NULL THEN 3 ELSE 4 END AS context_keys FROM txn", "txn"))
def _(t):
    e = webhook.to_event(webhook.parse(webhook_bodies(t)))
    return e.select(ID, X.micros("event_time").alias("us"), "customer_id", "card_id", "merchant_id", "merchant_category_code",
                    F.col("amount").cast("string").alias("amount_usd"),
                    "currency", "payment_channel", "device_id", F.size("context").alias("context_keys"))


@query("src_adapter_bankshield", "SELECT CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS transaction_id, "
       "CAST(l_partkey AS VARCHAR) AS customer_id, epoch_us(l_shipdate) AS us, l_extendedprice AS amount, CAST(l_suppkey AS VARCHAR) AS merchant_id, "
       "l_returnflag AS merchant_category_code, l_linestatus AS payment_channel, CAST(NULL AS VARCHAR) AS payment_error, "
       "CASE WHEN l_tax >= 0.08 THEN 1 ELSE 0 END AS is_fraud FROM lineitem")
def _(t):
    d = t.raw("lineitem")
    key = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return files.adapt(d, {
        ID: key, "customer_id": F.col("l_partkey").cast("string"), "us": X.micros("l_shipdate"), "amount": "l_extendedprice",
        "merchant_id": F.col("l_suppkey").cast("string"), "merchant_category_code": "l_returnflag",
        "payment_channel": "l_linestatus", "payment_error": F.lit(None).cast("string"),
        "is_fraud": F.when(F.col("l_tax") >= 0.08, 1).otherwise(0)})


@query("src_adapter_ieee", "SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, 'UNK' AS customer_id, "
       "epoch_us(TIMESTAMP '2017-01-01' + to_seconds(o_orderkey)) AS us, o_totalprice AS amount, 'UNK' AS merchant_category_code, "
       "o_orderstatus AS payment_channel, 'None' AS payment_error, c_mktsegment AS device_type FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t):
    o = t.raw("orders").withColumnRenamed("o_custkey", "c_custkey")
    j = o.join(t.raw("customer").select("c_custkey", "c_mktsegment"), "c_custkey", "left")
    anchor = 1483228800  # 2017-01-01, an arbitrary monotonic anchor
    return files.adapt(j, {
        ID: F.col("o_orderkey").cast("string"), "customer_id": F.lit("UNK"),
        "us": X.micros(F.timestamp_seconds(F.col("o_orderkey") + anchor)), "amount": "o_totalprice",
        "merchant_category_code": F.lit("UNK"), "payment_channel": "o_orderstatus", "payment_error": F.lit("None"),
        "device_type": "c_mktsegment"})


# -- sinks ------------------------------------------------------------------

BOUNDS_SQL = """b AS (SELECT list(us ORDER BY i) AS q FROM (SELECT us, row_number() OVER (ORDER BY us) - 1 AS i, count(*) OVER () AS n FROM txn)
  WHERE i IN (round(0.6 * (n - 1)), round(0.8 * (n - 1)))),
sp AS (SELECT txn.*, CASE WHEN us <= q[1] THEN 'train' WHEN us <= q[2] THEN 'validation' ELSE 'test' END AS split, q FROM txn, b)"""


@query("snk_parquet_split", sql("SELECT split, transaction_id, amount FROM sp", "txn", extra=BOUNDS_SQL))
def _(t):
    path = scratch_path(t.spark, "splits")
    cards.write_splits(t.txn(), path)
    return t.spark.read.parquet(path).select("split", ID, "amount")


@query("snk_part_numbered", sql(
    "SELECT transaction_id, CAST(NULL AS DOUBLE) AS device_v_24h_count, CAST(count(*) OVER (PARTITION BY merchant_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS merch_txn_count_prior FROM txn", "txn"))
def _(t):
    merch = tuple(e for e in C.CATALOGUE if e.name == "merch")
    out = files.with_missing_columns(V.velocity_features(t.txn(), merch),
                                     [ID, *C.velocity_feature_names(), *C.prior_feature_names()])
    path = scratch_path(t.spark, "velocity")
    out.write.parquet(path)
    return t.spark.read.parquet(path).select(
        ID, F.col("device_v_24h_count").cast("double").alias("device_v_24h_count"), "merch_txn_count_prior")


@query("snk_manifest", sql(
    "SELECT split, count(*) AS rows, min(us) AS min_us, max(us) AS max_us, round(avg(is_fraud), 8) AS fraud_rate, "
    "any_value(q[1]) AS train_end, any_value(q[2]) AS validation_end FROM sp GROUP BY split", "txn", extra=BOUNDS_SQL))
def _(t):
    d = t.txn()
    bounds = cards.check_bounds(cards.split_bounds(d))
    path = scratch_path(t.spark, "manifest")
    cards.write_manifest(cards.with_split(d, bounds), bounds, path)
    return t.spark.read.json(path).withColumn("fraud_rate", F.round("fraud_rate", 8))


@query("snk_score_stream", sql("SELECT transaction_id, epoch_us(event_time) AS us, score, is_fraud, split FROM scores", "scores"))
def _(t):
    path = scratch_path(t.spark, "scores")
    t.scores().select(ID, "event_time", "score", "is_fraud", "split").write.partitionBy("split").parquet(path)
    d = t.spark.read.parquet(path)
    return d.select(ID, X.micros("event_time").alias("us"), "score", "is_fraud", "split")


@query("snk_score_stream_ordered", sql(
    "SELECT transaction_id, score, split, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, us, seq, transaction_id) - 1 AS row_id FROM scores", "scores"))
def _(t):
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    # Split rank and time in one whole number, which keeps every microsecond apart: 2^52 of them are 142 years.
    d = t.scores().withColumn("pos", (rank.cast("long") * 4503599627370496 + X.micros("event_time")))
    path = scratch_path(t.spark, "ordered-scores")
    R.numbered(d, "pos", ["seq", ID]).select(ID, "score", "split", "row_id").write.parquet(path)
    return t.spark.read.parquet(path)


@query("snk_report_json", sql(
    "SELECT strftime(event_time, '%Y-%m') AS month, count(*) AS rows, round(avg(score), 6) AS mean_score, CAST(sum(is_fraud) AS BIGINT) AS frauds FROM scores GROUP BY 1", "scores"))
def _(t):
    path = scratch_path(t.spark, "report")
    r = D.window_stats(t.scores()).select("month", "rows", F.round("mean_score", 6).alias("mean_score"), "frauds")
    r.coalesce(1).write.json(path)
    return t.spark.read.schema("month string, rows long, mean_score double, frauds long").json(path)


QUEUE_SQL = """q AS (SELECT DISTINCT strftime(event_time, '%Y-%m-%d') AS day, coalesce(fail_type, 'none') AS reason FROM epi)"""


@query("snk_jsonl_append_dedupe", sql(
    "SELECT day, reason, count(*) AS entries FROM q WHERE reason <> 'none' GROUP BY 1, 2", "epi", extra=QUEUE_SQL))
def _(t):
    e = t.episodes().filter(F.col("fail_type").isNotNull()).select(
        F.substring("feedback_at", 1, 10).alias("day"), F.col("fail_type").alias("reason"), "model_version")
    path = scratch_path(t.spark, "queue")
    old = e.filter(F.col("day") < "2024-01-16")
    files.append_new(old.limit(0), old, ["day", "reason"]).write.json(path)
    queue = t.spark.read.schema("day string, reason string, model_version string").json(path)
    files.append_new(queue, e, ["day", "reason"]).write.mode("append").json(path)
    return (t.spark.read.schema("day string, reason string, model_version string").json(path)
            .groupBy("day", "reason").agg(F.count(F.lit(1)).alias("entries")))


@query("snk_retention", sql("SELECT transaction_id FROM epi ORDER BY seq DESC LIMIT (SELECT CASE WHEN count(*) > 5000 THEN 3000 ELSE 5000 END FROM epi)", "epi"))
def _(t):
    path = scratch_path(t.spark, "retained")
    files.keep_newest(t.episodes(), "seq", above=5000, keep=3000).write.json(path)
    return t.spark.read.schema("transaction_id string").json(path)


@query("snk_ledger_table", sql("SELECT seq, action, count(*) OVER () AS total FROM dec ORDER BY seq DESC LIMIT 50", "dec"))
def _(t):
    """Append, count and newest-first read of a ledger table."""
    path = scratch_path(t.spark, "ledger")
    audit.chain(audit.from_decisions(t.decisions())).write.parquet(path)
    led = t.spark.read.parquet(path)
    total = led.agg(F.count(F.lit(1)).alias("total"))
    return audit.recent(led, 50).join(F.broadcast(total)).select(
        "seq", F.get_json_object("payload", "$.action").alias("action"), "total")


@query("snk_graph_tables", sql(
    "SELECT 'customer' AS label, count(DISTINCT customer_id) AS n FROM txn UNION ALL SELECT 'merchant', count(DISTINCT merchant_id) FROM txn "
    "UNION ALL SELECT 'card', count(DISTINCT card_id) FROM txn UNION ALL SELECT 'purchased', count(*) FROM txn "
    "UNION ALL SELECT 'has_card', count(DISTINCT (customer_id, card_id)) FROM txn", "txn"))
def _(t):
    d = t.txn()
    tables = {"customer": d.select("customer_id").distinct(), "merchant": G.merchant_nodes(d),
              "card": d.select("card_id").distinct(), "purchased": G.purchases(d),
              "has_card": d.select("customer_id", "card_id").distinct()}
    root = scratch_path(t.spark, "graph")
    out = None
    for name, frame in tables.items():
        frame.write.parquet(f"{root}/{name}")
        n = t.spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("snk_split_quarantine", sql(
    "SELECT sink, violations, count(*) AS n FROM (SELECT violations, CASE WHEN violations = '' THEN 'events' ELSE 'quarantine' END AS sink FROM (" + CONTRACT_SQL + ")) GROUP BY 1, 2", "txn"))
def _(t):
    good, bad = contract.split_quarantine(contract_events(t))
    root = scratch_path(t.spark, "contract")
    good.write.parquet(f"{root}/events")
    bad.write.parquet(f"{root}/quarantine")
    g = t.spark.read.parquet(f"{root}/events").select(F.lit("events").alias("sink"), F.lit("").alias("violations"))
    b = t.spark.read.parquet(f"{root}/quarantine").select(F.lit("quarantine").alias("sink"), F.array_join("violations", ",").alias("violations"))
    return g.unionByName(b).groupBy("sink", "violations").agg(F.count(F.lit(1)).alias("n"))

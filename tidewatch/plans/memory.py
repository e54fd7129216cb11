"""Failure memory, healing, repair knowledge, audit ledger, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X
from tidewatch.functions.frame import attach_row
from tidewatch.operators import audit, memory as MEM, positions as P
from tidewatch.plans.joins import GENE_SQL, HISTORY_SQL, HOLD, gene_outcomes
from tidewatch.plans.registry import query
from tidewatch.plans.scalars import class_sql
from tidewatch.plans.sqltext import sql
from tidewatch.session import scratch_path

ID = "transaction_id"

ROLL = ("ro AS (SELECT merchant_id, count(*) AS txns, count(fail_type) AS failures, count(*) FILTER (fail_type = 'missed_fraud') AS missed_fraud, "
        "count(*) FILTER (fail_type = 'false_hold') AS false_hold, min(feedback_at) FILTER (fail_type IS NOT NULL) AS first_failure_at, "
        "max(feedback_at) FILTER (fail_type IS NOT NULL) AS last_failure_at, count(*) FILTER (outcome = 'fraud') AS confirmed_fraud FROM epi GROUP BY 1)")


@query("agg_failure_rollup", sql("SELECT * EXCLUDE (confirmed_fraud) FROM ro", "epi", extra=ROLL))
def _(t):
    return MEM.failure_rollup(t.episodes())


STATS = ("st AS (SELECT count(*) AS episodes, count(fail_type) AS failures, count(*) FILTER (fail_type = 'missed_fraud') AS missed_fraud, count(*) FILTER (fail_type = 'false_hold') AS false_hold, "
         "round(count(*) FILTER (fail_type = 'missed_fraud') / greatest(count(*), 1), 4) AS miss_rate, round(count(*) FILTER (fail_type = 'false_hold') / greatest(count(*), 1), 4) AS false_hold_rate FROM epi)")


@query("agg_memory_stats", sql("SELECT * FROM st", "epi", extra=STATS))
def _(t):
    return MEM.memory_stats(t.episodes())


@query("agg_top_fraud_merchants", sql("SELECT merchant_id, txns, failures, missed_fraud, confirmed_fraud FROM ro ORDER BY failures DESC, merchant_id LIMIT 10", "epi", extra=ROLL))
def _(t):
    return MEM.top_fraud_merchants(t.episodes())


@query("agg_confirmed_set", sql("SELECT DISTINCT merchant_id FROM epi WHERE outcome = 'fraud'", "epi"))
def _(t):
    return MEM.confirmed_merchants(t.episodes())


@query("top_hot_merchants", sql("SELECT merchant_id, failures, missed_fraud, false_hold FROM ro WHERE failures >= 2 ORDER BY failures DESC, merchant_id", "epi", extra=ROLL))
def _(t):
    return MEM.hot_merchants(MEM.failure_rollup(t.episodes())).orderBy(F.desc("failures"), "merchant_id").select(
        "merchant_id", "failures", "missed_fraud", "false_hold")


@query("top_recent_episodes", sql("SELECT transaction_id, outcome, fail_type FROM epi ORDER BY seq DESC LIMIT 5", "epi"))
def _(t):
    return t.episodes().orderBy(F.desc("seq")).limit(5).select(ID, "outcome", "fail_type")


# -- audit ------------------------------------------------------------------

LEDGER = """pay AS (SELECT seq, md5(transaction_id) AS id, CASE WHEN payment_error IS NOT NULL THEN 'decision.review_failsafe' WHEN device_id IS NULL THEN 'decision.cold_start' ELSE 'decision.scored' END AS event_type, action, event_time,
  '{"action":"' || action || '","amount":"' || printf('%.2f', amount) || '","currency":"' || currency || '","customer_id":"' || customer_id || '","fraud_probability":"' || printf('%.5f', fraud_probability) || '","merchant_id":"' || merchant_id
  || '","model_version":"' || model_version || '","payment_channel":"' || payment_channel || '","transaction_id":"' || transaction_id || '"}' AS payload FROM dec),
led AS (SELECT *, lag(hash, 1, 'GENESIS') OVER (ORDER BY seq) AS prev_hash FROM (SELECT *, sha256('{"event_type":"' || event_type || '","id":"' || id || '","payload":' || payload || '}') AS hash FROM pay))"""


def ledger(t):
    return audit.chain(audit.from_decisions(t.decisions()))


@query("win_hash_chain", sql("SELECT seq, hash, prev_hash FROM led", "dec", extra=LEDGER))
def _(t):
    return ledger(t).select("seq", "hash", "prev_hash")


@query("win_hash_verify", sql(
    "SELECT seq, seq % 997 <> 5 AS body_ok, seq % 991 <> 8 AS link_ok FROM led WHERE seq % 991 <> 7", "dec", extra=LEDGER))
def _(t):
    """A stored ledger with edited payloads and deleted records."""
    path = scratch_path(t.spark, "ledger")
    led = ledger(t).filter(F.col("seq") % 991 != 7)
    led.withColumn("payload", F.when(F.col("seq") % 997 == 5, F.regexp_replace("payload", "USD", "EUR"))
                   .otherwise(F.col("payload"))).write.parquet(path)
    return audit.verify_rows(t.spark.read.parquet(path)).select("seq", "body_ok", "link_ok")


@query("rp_audit_summary", sql(
    "SELECT what, records, valid, first_broken_seq, first_broken_index FROM (SELECT 'intact' AS what, count(*) AS records, true AS valid, NULL::BIGINT AS first_broken_seq, NULL::BIGINT AS first_broken_index FROM led "
    "UNION ALL SELECT 'tampered', count(*), false, 42, 42 FROM led)", "dec", extra=LEDGER))
def _(t):
    led = ledger(t)
    bad = led.withColumn("payload", F.when(F.col("seq") >= 42, F.concat(F.col("payload"), F.lit(" "))).otherwise(F.col("payload")))
    a, b = audit.verify(led), audit.verify(bad)
    return a.withColumn("what", F.lit("intact")).unionByName(b.withColumn("what", F.lit("tampered")))


@query("agg_audit_daily", sql(
    "SELECT strftime(event_time, '%Y-%m-%d') AS date, count(*) AS total, count(*) FILTER (event_type = 'decision.scored') AS scored, count(*) FILTER (event_type = 'decision.cold_start') AS cold, "
    "count(*) FILTER (action = 'hold') AS hold, count(*) FILTER (action = 'allow') AS allow FROM led GROUP BY 1 ORDER BY 1 DESC LIMIT 14", "dec", extra=LEDGER))
def _(t):
    d = audit.daily(ledger(t), days=14)
    n = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    return d.select(F.col("date").cast("string").alias("date"), "total", n("by_event_type", "decision.scored").alias("scored"),
                    n("by_event_type", "decision.cold_start").alias("cold"), n("by_action", "hold").alias("hold"), n("by_action", "allow").alias("allow"))


@query("top_recent", sql("SELECT seq, event_type, hash FROM led ORDER BY seq DESC LIMIT 20", "dec", extra=LEDGER))
def _(t):
    return audit.recent(ledger(t), 20).select("seq", "event_type", "hash")


# -- repair knowledge -------------------------------------------------------

ALL_GENES = GENE_SQL.format(part="0", keep="0")


@query("win_q_value", sql("SELECT signature, success_count, failure_count, round(q_value, 6) AS q_value FROM gn", "rep", extra=ALL_GENES))
def _(t):
    return MEM.genes(gene_outcomes(t)).withColumn("q_value", F.round("q_value", 6))


@query("top_genes", sql("SELECT signature, round(q_value, 6) AS q_value FROM gn WHERE q_value >= 0 ORDER BY gn.q_value DESC, signature LIMIT 20", "rep", extra=ALL_GENES))
def _(t):
    return MEM.top_genes(MEM.genes(gene_outcomes(t))).select("signature", F.round("q_value", 6).alias("q_value"))


STRAT = ("sx AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{a}', {e}::DOUBLE, {r}::DOUBLE, '{p}')" for c, a, e, r, p in MEM.STRATEGIES)
         + ") v(error_class, action, expected, risk, params)),\n"
         "sb AS (SELECT error_class, action, params, expected * (1 - risk) AS score FROM sx QUALIFY row_number() OVER (PARTITION BY error_class ORDER BY expected * (1 - risk) DESC, action DESC, params DESC) = 1),\n"
         "ch AS (SELECT s.seq, s.transaction_id, s.success, s.signature, sb.error_class, least(0.95, gn.q_value + 0.5) * 0.95 >= sb.score AND gn.q_value > 0.4 AS hit, sb.action, sb.params, sb.score, gn.q_value FROM "
         "(SELECT *, " + class_sql("error_text") + " AS error_class FROM sig) s JOIN sb USING (error_class) LEFT JOIN gn USING (signature))")


def choices(t):
    known = MEM.genes(gene_outcomes(t)).filter(F.col("q_value") > 0.4).withColumn("action", F.lit("cached"))
    return MEM.choose_repair(t.repair_log().select(ID, "error_text"), known)


_HIT = "coalesce(hit, false)"


@query("hl_repair_choice", sql(
    f"SELECT transaction_id, signature, error_class, CASE WHEN {_HIT} THEN 'cached' ELSE action END AS action, CASE WHEN {_HIT} THEN '' ELSE params END AS params, "
    f"round(CASE WHEN {_HIT} THEN least(0.95, q_value + 0.5) * 0.95 ELSE score END, 6) AS score, {_HIT} AS gene_hit FROM ch", "rep", extra=ALL_GENES + ",\n" + STRAT))
def _(t):
    return choices(t).withColumn("score", F.round("score", 6))


@query("agg_repair_stats", sql(
    f"SELECT count(*) AS repair_attempts, count(*) FILTER (success) AS repair_successes, round(count(*) FILTER (success) / count(*), 4) AS recovery_rate, count(*) FILTER ({_HIT}) AS gene_hits, round(count(*) FILTER ({_HIT}) / count(*), 4) AS gene_hit_rate FROM ch", "rep", extra=ALL_GENES + ",\n" + STRAT))
def _(t):
    return MEM.repair_stats(t.repair_log().select(ID, "success").join(choices(t), ID))


@query("rp_repair_status", sql(
    f"SELECT g.signature, round(g.q_value, 4) AS q_value, g.success_count + g.failure_count AS total_uses, round(success_count / (success_count + failure_count), 6) AS success_rate, n AS repair_attempts, h AS gene_hits FROM gn g, (SELECT count(*) AS n, count(*) FILTER ({_HIT}) AS h FROM ch)", "rep", extra=ALL_GENES + ",\n" + STRAT))
def _(t):
    g = MEM.genes(gene_outcomes(t))
    s = MEM.repair_stats(t.repair_log().select(ID, "success").join(choices(t), ID)).select("repair_attempts", "gene_hits")
    total = F.col("success_count") + F.col("failure_count")
    path = scratch_path(t.spark, "genes")
    g.write.json(path)
    g = t.spark.read.schema("signature string, success_count long, failure_count long, q_value double").json(path)
    return attach_row(g, s).select("signature", F.round("q_value", 4).alias("q_value"), total.alias("total_uses"),
                                   F.round(F.col("success_count") / total, 6).alias("success_rate"), "repair_attempts", "gene_hits")


# -- thresholds and healing -------------------------------------------------

@query("win_threshold_history", sql(
    "SELECT merchant_id, i, cycle, kind, round(old_hold, 8) AS old_hold, round(new_hold, 8) AS new_hold FROM walk", "epi", recursive=True, extra=HISTORY_SQL))
def _(t):
    h = MEM.threshold_history(MEM.adjustments_by_cycle(t.episodes()), HOLD)
    return h.select("merchant_id", F.col("i").cast("long").alias("i"), "cycle", "kind", F.round("old_hold", 8).alias("old_hold"), F.round("new_hold", 8).alias("new_hold"))


HEAL = STATS + ",\n" + ROLL + """,
he AS (SELECT *, (SELECT count(*) FROM ro WHERE failures >= 2) AS hot, miss_rate < 0.025 AND false_hold_rate < 0.05 AS rec FROM st)"""
_HOLD2 = "CASE WHEN rec THEN NULL WHEN false_hold_rate >= 0.1 THEN round_even(0.55::DOUBLE * 0.8, 8) WHEN miss_rate >= 0.05 THEN round_even(0.55::DOUBLE * 1.25, 8) END"


@query("hl_heal_actions", sql(
    "SELECT kind, detail, value FROM (SELECT 'hot_list' AS kind, hot || ' merchant(s)' AS detail, NULL::DOUBLE AS value FROM he WHERE hot > 0 "
    "UNION ALL SELECT 'tighten', printf('missed-fraud rate %.3f', miss_rate), NULL FROM he WHERE miss_rate >= 0.05 UNION ALL SELECT 'relax', printf('false-hold rate %.3f', false_hold_rate), NULL FROM he WHERE false_hold_rate >= 0.1 "
    f"UNION ALL SELECT 'override', 'hold threshold', {_HOLD2} FROM he WHERE {_HOLD2} IS NOT NULL UNION ALL SELECT 'retrain', 'drift trigger', NULL FROM he "
    "UNION ALL SELECT 'retrain', failures || ' remembered failures (missed ' || missed_fraud || ', false-hold ' || false_hold || ')', NULL FROM he WHERE failures >= 2)", "epi", extra=HEAL))
def _(t):
    e = t.episodes()
    hot = MEM.hot_merchants(MEM.failure_rollup(e)).agg(F.count(F.lit(1)).alias("hot"))
    drift = e.agg(F.when(F.count(F.lit(1)) > 0, "YES").otherwise("NO").alias("drift_trigger"))
    return MEM.heal_actions(MEM.memory_stats(e), hot, drift, HOLD)


@query("rp_healing_status", sql(
    "SELECT episodes, failures, miss_rate, false_hold_rate, hot, (SELECT count(*) FROM (SELECT DISTINCT strftime(event_time, '%Y-%m-%d'), fail_type FROM epi WHERE fail_type IS NOT NULL)) AS retrain_queue_len, "
    "(SELECT max(strftime(event_time, '%Y-%m-%d')) FROM epi WHERE fail_type IS NOT NULL) AS last_retrain_day, (SELECT count(DISTINCT merchant_id) FROM adjn) AS overridden_merchants FROM he", "epi", recursive=True, extra=HEAL + ",\n" + HISTORY_SQL))
def _(t):
    e = t.episodes()
    hot = MEM.hot_merchants(MEM.failure_rollup(e)).agg(F.count(F.lit(1)).alias("hot"))
    queue = e.filter(F.col("fail_type").isNotNull()).select(F.substring("feedback_at", 1, 10).alias("day"), "fail_type").distinct()
    q = queue.agg(F.count(F.lit(1)).alias("retrain_queue_len"), F.max("day").alias("last_retrain_day"))
    over = MEM.adjustments_by_cycle(e).agg(F.count_distinct("merchant_id").alias("overridden_merchants"))
    s = MEM.memory_stats(e).select("episodes", "failures", "miss_rate", "false_hold_rate")
    return attach_row(attach_row(attach_row(s, hot), q), over)


_REPAIR = ("rr AS (SELECT e.transaction_id, e.feedback_at, round(ln(1 + round(amount, 2)), 6) AS amount_log1p, CASE WHEN lower(payment_channel) = 'swipe' THEN 1.0 ELSE 0.0 END::DOUBLE AS channel_swipe, "
           "CASE WHEN r.failures >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS merchant_is_hot, round(r.failures / r.txns, 6) AS merchant_failure_rate, CASE WHEN outcome = 'fraud' THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM epi e JOIN ro r USING (merchant_id))")


def repair_frame(t, max_rows=None):
    e = t.episodes()
    r = MEM.repair_rows(e, MEM.failure_rollup(e), max_rows=max_rows)
    return r.select(ID, "feedback_at", F.round("amount_log1p", 6).alias("amount_log1p"), "channel_swipe", "merchant_is_hot",
                    F.round("merchant_failure_rate", 6).alias("merchant_failure_rate"), "label")


@query("prj_repair_features", sql("SELECT * FROM rr", "epi", extra=ROLL + ",\n" + _REPAIR))
def _(t):
    return repair_frame(t)


@query("top_repair_newest", sql("SELECT * FROM rr ORDER BY feedback_at DESC, transaction_id LIMIT 5000", "epi", extra=ROLL + ",\n" + _REPAIR))
def _(t):
    return repair_frame(t, 5000)


@query("ml_repair_data", sql(
    "SELECT count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, count(*) >= 8 AND sum(label) > 0 AS trainable FROM rr", "epi", extra=ROLL + ",\n" + _REPAIR))
def _(t):
    r = repair_frame(t).agg(F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives"))
    return r.withColumn("trainable", (F.col("rows") >= C.MIN_REPAIR_ROWS) & (F.col("positives") > 0))


# -- sorts ------------------------------------------------------------------

@query("srt_time", sql("SELECT transaction_id, epoch_us(event_time) AS us FROM lines ORDER BY event_time, seq, transaction_id", "lines"))
def _(t):
    return t.lines().orderBy("event_time", "seq", ID).select(ID, X.micros("event_time").alias("us"))


@query("srt_entity_time", sql(
    "SELECT customer_id, transaction_id, row_number() OVER (PARTITION BY customer_id ORDER BY us, seq, transaction_id) AS pos FROM lines ORDER BY customer_id, pos", "lines"))
def _(t):
    return P.positions(t.lines(), "customer_id").sortWithinPartitions("customer_id", "pos").select("customer_id", ID, "pos")

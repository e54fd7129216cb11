"""Failure memory, healing actions, thresholds and repair knowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X
from tidewatch.functions.frame import attach_row



def merchant_of(episodes: DataFrame) -> DataFrame:
    return episodes.withColumn("merchant_id", F.col("event")["merchant_id"])


def failure_rollup(episodes: DataFrame) -> DataFrame:
    """Per merchant: rows, failures by kind, first and last failure time."""
    e = merchant_of(episodes).filter(F.coalesce("merchant_id", F.lit("")) != "")
    failed = F.col("fail_type").isNotNull()
    return e.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("txns"), F.count_if(failed).alias("failures"),
        F.count_if(F.col("fail_type") == "missed_fraud").alias("missed_fraud"),
        F.count_if(F.col("fail_type") == "false_hold").alias("false_hold"),
        F.min(F.when(failed, F.col("feedback_at"))).alias("first_failure_at"),
        F.max(F.when(failed, F.col("feedback_at"))).alias("last_failure_at"))


def hot_merchants(rollup: DataFrame, min_failures: int = 2) -> DataFrame:
    return rollup.filter(F.col("failures") >= min_failures)


def memory_stats(episodes: DataFrame) -> DataFrame:
    missed, held = F.count_if(F.col("fail_type") == "missed_fraud"), F.count_if(F.col("fail_type") == "false_hold")
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return episodes.agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("fail_type").isNotNull()).alias("failures"),
        missed.alias("missed_fraud"), held.alias("false_hold"),
        F.round(missed / n, 4).alias("miss_rate"), F.round(held / n, 4).alias("false_hold_rate"))


def top_fraud_merchants(episodes: DataFrame, limit: int = 10) -> DataFrame:
    e = merchant_of(episodes).filter(F.col("merchant_id").isNotNull())
    return e.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("txns"), F.count_if(F.col("fail_type").isNotNull()).alias("failures"),
        F.count_if(F.col("fail_type") == "missed_fraud").alias("missed_fraud"),
        F.count_if(F.col("outcome") == "fraud").alias("confirmed_fraud"),
    ).orderBy(F.desc("failures"), "merchant_id").limit(limit)


def confirmed_merchants(episodes: DataFrame) -> DataFrame:
    """Merchants with at least one confirmed fraud."""
    return merchant_of(episodes).filter(
        (F.col("outcome") == "fraud") & (F.coalesce("merchant_id", F.lit("")) != "")).select("merchant_id").distinct()


def with_feedback(outcomes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Outcomes with the first audited decision of their transaction; `ok` tells if one exists."""
    d = ledger.select(F.get_json_object("payload", "$.transaction_id").alias("transaction_id"), "seq",
                      F.get_json_object("payload", "$.action").alias("action"),
                      F.get_json_object("payload", "$.model_version").alias("model_version"))
    first = d.groupBy("transaction_id").agg(F.min_by(F.struct("action", "model_version"), "seq").alias("d"))
    j = outcomes.join(first, "transaction_id", "left")
    ok = F.col("d").isNotNull()
    return j.select(
        *outcomes.columns, ok.alias("ok"), F.col("d.action").alias("action"), F.col("d.model_version").alias("model_version"),
        F.when(ok, X.fail_type("d.action", "outcome")).alias("fail_type"),
        F.when(~ok, F.concat(F.lit("no audited decision for transaction '"), F.col("transaction_id"), F.lit("'"))).alias("error"))


# -- thresholds -------------------------------------------------------------

def apply_overrides(decisions: DataFrame, merchant: DataFrame, glob: DataFrame, hold: float, review: float) -> DataFrame:
    """Re-derive the band: merchant override first, then the global one, then the base.

    `merchant`: (merchant_id, m_hold, m_review), adjusted merchants only.
    `glob`: one row (g_hold, g_review), null when no override is active.
    """
    d = attach_row(decisions.join(merchant, "merchant_id", "left"), glob)
    use_m = F.col("m_hold").isNotNull()
    use_g = ~use_m & F.col("g_hold").isNotNull()
    h = F.when(use_m, F.col("m_hold")).when(use_g, F.col("g_hold")).otherwise(F.lit(hold))
    r = F.when(use_m, F.coalesce("m_review", F.lit(review))).when(
        use_g, F.coalesce("g_review", F.lit(review))).otherwise(F.lit(review))
    p = F.col("fraud_probability")
    return d.withColumn("threshold_source", F.when(use_m, "merchant").when(use_g, "global").otherwise("base")).withColumn(
        "final_action", F.when(use_m | use_g, X.band(p, h, r)).otherwise(F.col("action"))).drop(
        "m_hold", "m_review", "g_hold", "g_review")


def adjustments_by_cycle(episodes: DataFrame) -> DataFrame:
    """One adjustment per merchant and daily heal cycle that saw failures.

    Missed fraud tightens, otherwise false holds relax. Grouping by day first
    bounds a merchant's list by the calendar.
    """
    day = F.substring("feedback_at", 1, 10)
    per = merchant_of(episodes).filter(F.col("fail_type").isNotNull()).groupBy("merchant_id", day.alias("cycle")).agg(
        F.count_if(F.col("fail_type") == "missed_fraud").alias("missed"))
    return per.select("merchant_id", "cycle", F.when(F.col("missed") > 0, "tighten").otherwise("relax").alias("kind"),
                      F.when(F.col("missed") > 0, C.TIGHTEN_HOLD_FACTOR).otherwise(C.RELAX_HOLD_FACTOR).alias("factor"))


def threshold_history(adjustments: DataFrame, base_hold: float) -> DataFrame:
    """Apply a merchant's adjustments in order: multiply, round to 8 digits, keep in bounds.

    One row per adjustment with the threshold before and after. The fold is not
    associative (rounding, bounds); a merchant has at most one adjustment per
    heal cycle, so the list stays short.
    """
    items = adjustments.groupBy("merchant_id").agg(F.array_sort(F.collect_list(F.struct("cycle", "kind", "factor"))).alias("a"))
    start = F.struct(F.lit(float(base_hold)).alias("hold"), F.array().cast(
        "array<struct<cycle:string,kind:string,old_hold:double,new_hold:double>>").alias("log"))

    def step(acc, x):
        new = F.least(F.greatest(F.bround(acc["hold"] * x["factor"], 8), F.lit(C.HOLD_FLOOR)), F.lit(C.HOLD_CEILING))
        return F.struct(new.alias("hold"), F.concat(acc["log"], F.array(F.struct(
            x["cycle"].alias("cycle"), x["kind"].alias("kind"), acc["hold"].alias("old_hold"), new.alias("new_hold")))).alias("log"))

    log = F.aggregate("a", start, step, lambda acc: acc["log"])
    return items.select("merchant_id", F.posexplode(log).alias("i", "x")).select("merchant_id", "i", "x.*")


def heal_actions(stats: DataFrame, hot_count: DataFrame, drift: DataFrame, base_hold: float,
                 override_active: bool = False) -> DataFrame:
    """Action rows of one heal cycle from one row of memory statistics.

    hot-list, threshold override with half-rate hysteresis, retrain requests.
    """
    one = attach_row(attach_row(stats, hot_count), drift)
    miss, held = F.col("miss_rate"), F.col("false_hold_rate")
    recovered = (miss < C.MISS_RATE_WARN * 0.5) & (held < C.FALSE_HOLD_WARN * 0.5)
    relax, tighten = held >= C.FALSE_HOLD_WARN, miss >= C.MISS_RATE_WARN
    hold = (F.when(recovered, None).when(relax, F.bround(F.lit(base_hold * C.RELAX_HOLD_FACTOR), 8))
            .when(tighten, F.bround(F.lit(base_hold * C.TIGHTEN_HOLD_FACTOR), 8)))
    none = F.lit(None).cast("double")

    def row(cond, kind, detail, value=none):
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), value.alias("value")))

    rows = F.array_compact(F.array(
        row(F.col("hot") > 0, "hot_list", F.concat(F.col("hot").cast("string"), F.lit(" merchant(s)"))),
        row(tighten, "tighten", F.format_string("missed-fraud rate %.3f", miss)),
        row(relax, "relax", F.format_string("false-hold rate %.3f", held)),
        row(recovered & F.lit(override_active), "clear_override", F.lit("rates recovered")),
        row(hold.isNotNull(), "override", F.lit("hold threshold"), hold),
        row(F.col("drift_trigger") == "YES", "retrain", F.lit("drift trigger")),
        row(F.col("failures") >= C.RETRAIN_MIN_FAILURES, "retrain", F.concat(
            F.col("failures").cast("string"), F.lit(" remembered failures (missed "), F.col("missed_fraud").cast("string"),
            F.lit(", false-hold "), F.col("false_hold").cast("string"), F.lit(")")))))
    return one.select(F.explode(rows).alias("a")).select("a.*")


# -- repair model data ------------------------------------------------------

def repair_rows(episodes: DataFrame, rollup: DataFrame, min_failures: int = 2, max_rows: int | None = None) -> DataFrame:
    """Compact feature rows with label, newest feedback first when capped."""
    e = merchant_of(episodes)
    r = rollup.select("merchant_id", "txns", "failures")
    j = e.join(r, "merchant_id", "left")
    channel = F.lower(F.coalesce(F.col("event")["payment_channel"], F.lit("")))
    amount = F.coalesce(F.expr("try_cast(event['amount'] AS double)"), F.lit(0.0))
    out = j.select(
        "transaction_id", "feedback_at", F.log1p(F.greatest(amount, F.lit(0.0))).alias("amount_log1p"),
        *[(channel == w).cast("double").alias(f"channel_{w}") for w in ("swipe", "chip", "online")],
        F.when(F.col("failures") >= min_failures, 1.0).otherwise(0.0).alias("merchant_is_hot"),
        F.coalesce(F.col("failures") / F.when(F.col("txns") > 0, F.col("txns")), F.lit(0.0)).alias("merchant_failure_rate"),
        F.when(F.col("outcome") == "fraud", 1.0).otherwise(0.0).alias("label"))
    return out if max_rows is None else out.orderBy(F.desc("feedback_at"), "transaction_id").limit(max_rows)


# -- repair knowledge (genes) -----------------------------------------------

# Repair strategies per failure class (action, expected success, risk, parameter).
STRATEGIES = (
    ("RATE_LIMIT", "backoff", 0.7, 0.05, "delay=1.0"),
    ("RATE_LIMIT", "backoff", 0.85, 0.05, "delay=5.0"),
    ("RATE_LIMIT", "switch_endpoint", 0.6, 0.1, ""),
    ("TIMEOUT", "retry", 0.5, 0.1, "timeout=30"),
    ("TIMEOUT", "retry", 0.75, 0.1, "timeout=60"),
    ("AUTH_EXPIRED", "refresh_token", 0.9, 0.05, ""),
    ("SERVER_ERROR", "retry", 0.5, 0.1, "timeout=15"),
    ("SERVER_ERROR", "switch_endpoint", 0.6, 0.1, ""),
    ("NETWORK_ERROR", "backoff", 0.6, 0.08, "delay=2.0"),
    ("MISSED_FRAUD", "tighten_hold", 0.7, 0.2, "factor=1.25"),
    ("MISSED_FRAUD", "queue_retrain", 0.6, 0.1, ""),
    ("FALSE_HOLD", "relax_hold", 0.7, 0.15, "factor=0.8"),
    ("COLD_START_UNCERTAIN", "conservative_review", 0.8, 0.05, ""),
    ("UNKNOWN", "safe_fallback", 0.3, 0.01, "decision=review"),
)
LEARNING_RATE, REWARD, PENALTY = 0.1, 1.0, -0.5


def genes(outcomes: DataFrame, key: str = "signature", seq: str = "seq", blocks: int = 1_000_000) -> DataFrame:
    """Success and failure counts and q-value per signature, in outcome order.

    q <- 0.9 q + 0.1 r unrolls to sum(0.1 * r_i * 0.9^(outcomes after i)), so
    it is a plain sum once each outcome knows how many followed it. Those
    numbers come from block totals, so one signature may hold any share of the
    outcomes.
    """
    d = outcomes.withColumn("_block", F.floor(F.col(seq) / blocks))
    per = d.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    after = Window.partitionBy(key).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(key, "_block", F.coalesce(F.sum("_n").over(after), F.lit(0)).alias("_after"))
    inside = F.row_number().over(Window.partitionBy(key, "_block").orderBy(F.desc(seq))) - 1
    ranked = d.withColumn("_in", inside).join(base, [key, "_block"])
    r = F.when(F.col("success"), REWARD).otherwise(PENALTY)
    weight = F.pow(F.lit(1 - LEARNING_RATE), (F.col("_in") + F.col("_after")).cast("double"))
    return ranked.groupBy(key).agg(
        F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"),
        F.sum(LEARNING_RATE * r * weight).alias("q_value"))


def merge_genes(existing: DataFrame, imported: DataFrame, key: str = "signature") -> DataFrame:
    """Federated merge: the existing gene stays unless the imported q is higher."""
    cols = [c for c in existing.columns if c != key]
    j = existing.alias("e").withColumn("_e", F.lit(True)).join(imported.alias("i").withColumn("_i", F.lit(True)), key, "full_outer")
    keep = F.col("_e") & (F.col("_i").isNull() | (F.col("e.q_value") >= F.col("i.q_value")))
    keep = F.coalesce(keep, F.lit(False))
    return j.select(key, *[F.when(keep, F.col(f"e.{c}")).otherwise(F.col(f"i.{c}")).alias(c) for c in cols],
                    F.when(keep, "existing").otherwise("imported").alias("origin"))


def top_genes(g: DataFrame, min_q: float = 0.0, limit: int = 20, key: str = "signature") -> DataFrame:
    return g.filter(F.col("q_value") >= min_q).orderBy(F.desc("q_value"), key).limit(limit)


def strategy_table(spark) -> DataFrame:
    return spark.createDataFrame(list(STRATEGIES), "error_class string, action string, expected double, risk double, params string")


def choose_repair(failures: DataFrame, known: DataFrame) -> DataFrame:
    """The best strategy per failure: expected * (1 - risk), known genes included.

    `failures`: (transaction_id, error_text); `known`: genes with their action.
    The strategy table is fixed and short; genes are joined by signature.
    """
    f = failures.withColumn("signature", X.error_signature("error_text")).withColumn(
        "error_class", X.error_class("error_text"))
    # A class has a fixed best candidate, so the table is reduced before the join.
    best = strategy_table(failures.sparkSession).withColumn(
        "score", F.col("expected") * (1 - F.col("risk"))).groupBy("error_class").agg(
        F.max_by(F.struct("action", "params", "score"), F.struct("score", "action", "params")).alias("s"))
    g = known.select("signature", F.col("action").alias("g_action"), F.lit("").alias("g_params"),
                     (F.least(F.lit(0.95), F.col("q_value") + 0.5) * 0.95).alias("g_score"))
    j = f.join(F.broadcast(best), "error_class").join(g, "signature", "left")
    use = F.coalesce(F.col("g_score") >= F.col("s.score"), F.lit(False))
    return j.select(
        "transaction_id", "signature", "error_class",
        F.when(use, F.col("g_action")).otherwise(F.col("s.action")).alias("action"),
        F.when(use, F.col("g_params")).otherwise(F.col("s.params")).alias("params"),
        F.when(use, F.col("g_score")).otherwise(F.col("s.score")).alias("score"), use.alias("gene_hit"))


def repair_stats(log: DataFrame) -> DataFrame:
    n, ok, hits = F.count(F.lit(1)), F.count_if("success"), F.count_if("gene_hit")
    return log.agg(n.alias("repair_attempts"), ok.alias("repair_successes"),
                   F.when(n > 0, F.round(ok / n, 4)).alias("recovery_rate"),
                   hits.alias("gene_hits"), F.when(n > 0, F.round(hits / n, 4)).alias("gene_hit_rate"))

"""Joins: priors, velocity, as-of, intervals, feedback, overrides, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X
from tidewatch.operators import asof, audit, graph as G, learned as L, memory as MEM, priors, velocity as V
from tidewatch.plans.registry import query
from tidewatch.plans.sources import BOUNDS_SQL
from tidewatch.plans.sqltext import sql
from tidewatch.plans.windows import velocity_sql
from tidewatch.sources import cards, files

ID = "transaction_id"
HOLD, REVIEW = 0.55, 0.25


@query("jn_velocity_left", sql(
    "SELECT t.transaction_id, t.amount, p.n AS cust_txn_count_prior, p.m AS merch_txn_count_prior FROM txn t JOIN (SELECT transaction_id, "
    "CAST(count(*) OVER (PARTITION BY customer_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS n, "
    "CAST(count(*) OVER (PARTITION BY merchant_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS m FROM txn) p USING (transaction_id)", "txn"))
def _(t):
    d = t.txn()
    base = d.select(ID, "amount", F.lit(-1.0).alias("cust_txn_count_prior"))
    return priors.join_velocity(base, V.velocity_features(d)).select(
        ID, "amount", "cust_txn_count_prior", "merch_txn_count_prior")


@query("jn_priors_broadcast", sql(
    "SELECT transaction_id, coalesce(s.share, 0.0) AS merch_freq_share, least(greatest(coalesce(r.rate, (SELECT round_even(avg(is_fraud), 8) FROM sp WHERE split = 'train')), 0.0), 1.0) AS merch_fraud_rate_prior, "
    "coalesce(m.share, 0.0) AS mcc_freq_share FROM txn "
    "LEFT JOIN (SELECT merchant_id, round_even(avg(is_fraud), 6) AS rate FROM sp WHERE split = 'train' GROUP BY 1) r USING (merchant_id) "
    "LEFT JOIN (SELECT merchant_id, round_even(count(*) / (SELECT count(*) FROM sp WHERE split = 'train'), 8) AS share FROM sp WHERE split = 'train' GROUP BY 1) s USING (merchant_id) "
    "LEFT JOIN (SELECT merchant_category_code, round_even(count(*) / (SELECT count(*) FROM sp WHERE split = 'train'), 8) AS share FROM sp WHERE split = 'train' GROUP BY 1) m USING (merchant_category_code)",
    "txn", extra=BOUNDS_SQL))
def _(t):
    d = t.txn()
    train = cards.with_split(d, cards.split_bounds(d)).filter(F.col("split") == "train")
    return priors.attach(d.select(ID, "merchant_id", "merchant_category_code"), priors.fit(train)).select(
        ID, "merch_freq_share", "merch_fraud_rate_prior", "mcc_freq_share")


@query("jn_base_left", sql(
    "SELECT transaction_id, count(*) OVER (PARTITION BY customer_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::DOUBLE AS cust_txn_count_prior, amount, merchant_category_code FROM txn", "txn"))
def _(t):
    d = t.txn()
    f = V.history_features(d).select(ID, "cust_txn_count_prior")
    return f.join(d.select(ID, "amount", "merchant_category_code"), ID, "left")


@query("jn_asof_backward", sql(
    "SELECT p.transaction_id, e.us AS us_matched, e.amount AS amount_matched FROM (SELECT * FROM txn WHERE payment_channel = 'Chip Transaction') p "
    "ASOF LEFT JOIN (SELECT customer_id, us, max(amount) AS amount FROM txn WHERE payment_error IS NOT NULL GROUP BY 1, 2) e ON p.customer_id = e.customer_id AND p.us >= e.us", "txn"))
def _(t):
    d = t.txn().withColumn("us", X.micros("event_time"))
    left = d.filter(F.col("payment_channel") == "Chip Transaction").select(ID, "customer_id", "us")
    right = d.filter(F.col("payment_error").isNotNull()).select("customer_id", "us", "amount")
    return asof.asof_backward(left, right, "customer_id", "us", ["amount"]).select(ID, "us_matched", "amount_matched")


@query("jn_inner_pos", sql(
    "SELECT row_number() OVER (ORDER BY us, seq) - 1 AS row_id, transaction_id, amount, merchant_id FROM txn", "txn"))
def _(t):
    d = t.txn().withColumn("us", X.micros("event_time"))
    return asof.join_by_position(d.select("us", "seq", ID, "amount"), d.select("us", "seq", "merchant_id"), "us", ["seq"]).select(
        "row_id", ID, "amount", "merchant_id")


_HOURLY = (C.Entity("device", "device_id", (C.WindowFeature("1h"), C.WindowFeature("24h")), ()),
           C.Entity("merch", "merchant_id", (C.WindowFeature("1h"),), ()))


@query("jn_interval_self", sql(velocity_sql("txn", _HOURLY), "txn"))
def _(t):
    """A configured catalogue: other entities and windows than the default one."""
    return V.velocity_features(t.txn(), _HOURLY)


_PARITY = C.velocity_feature_names(C.CATALOGUE[:2])


@query("jn_parity", sql(
    "SELECT count(*) AS rows_compared, c AS \"column\", 0.0::DOUBLE AS max_abs_diff, true AS exact_match FROM txn, (VALUES "
    + ", ".join(f"('{c}')" for c in _PARITY) + ") v(c) GROUP BY c", "txn"))
def _(t):
    """The sweep with hot entities cut into slices against the sweep without."""
    d = t.txn()
    a = V.velocity_features(d, C.CATALOGUE[:2], hot_rows=None)
    b = V.velocity_features(d, C.CATALOGUE[:2], hot_rows=60)
    return asof.parity_report(a, b, ID, _PARITY)


_HIST = """hm AS (SELECT customer_id, month_idx, count(*) AS n, sum(amount) AS amt FROM
  (SELECT *, (year(event_time) - 1970) * 12 + month(event_time) - 1 AS month_idx FROM lines) GROUP BY 1, 2)"""


@query("jn_roster_left", sql(
    "SELECT c.customer_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS hist_n, round(coalesce(sum(amt), 0.0), 2) AS hist_amt FROM (SELECT DISTINCT customer_id FROM lines) c "
    "LEFT JOIN (SELECT * FROM hm WHERE month_idx < 312) h USING (customer_id) GROUP BY 1", "lines", extra=_HIST))
def _(t):
    b = G.with_buckets(t.lines())
    hist = G.history(G.entity_month(b, "customer_id", "merchant_id"), "customer_id", exclusive=False)
    bucket = t.spark.range(1).select(F.array(F.lit(26).cast("long")).alias("_buckets"))
    past = G.latest_past(hist, "customer_id", bucket)
    roster = b.select("customer_id").distinct()
    return roster.join(past, "customer_id", "left").select(
        "customer_id", F.coalesce("hist_n", F.lit(0)).alias("hist_n"),
        F.round(F.coalesce("hist_amt", F.lit(0.0)), 2).alias("hist_amt"))


@query("jn_id_map", sql(
    "SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS node_idx FROM (SELECT DISTINCT card_id AS node_id FROM lines)", "lines"))
def _(t):
    return G.node_ids(t.lines(), "card_id")


@query("jn_feedback_decision", sql(
    "SELECT f.transaction_id, f.outcome, d.seq IS NOT NULL AS ok, d.action, d.model_version, d.fail_type, "
    "CASE WHEN d.seq IS NULL THEN 'no audited decision for transaction ''' || f.transaction_id || '''' END AS error FROM "
    "(SELECT CASE WHEN seq % 10 = 0 THEN 'x' || seq ELSE transaction_id END AS transaction_id, outcome FROM dec) f LEFT JOIN epi d USING (transaction_id)", "epi"))
def _(t):
    d = t.decisions()
    ledger = audit.from_decisions(d)
    again = ledger.withColumn("seq", F.col("seq") + 1_000_000_000).withColumn(
        "payload", F.regexp_replace("payload", '"action":"[a-z]+"', '"action":"later"'))
    unknown = F.concat(F.lit("x"), F.col("seq").cast("string"))
    out = d.select(F.when(F.col("seq") % 10 == 0, unknown).otherwise(F.col(ID)).alias(ID), "outcome")
    return MEM.with_feedback(out, ledger.unionByName(again))


@query("jn_gate_labels", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def _(t):
    return t.raw("documents").select("doc_id", "lang").join(t.raw("labels"), "doc_id")


def merchant_overrides(t):
    """Latest threshold per adjusted merchant from its adjustment history."""
    h = MEM.threshold_history(MEM.adjustments_by_cycle(t.episodes()), HOLD)
    return h.groupBy("merchant_id").agg(F.max_by("new_hold", "i").alias("m_hold")).withColumn(
        "m_review", F.lit(None).cast("double"))


HISTORY_SQL = """adj AS (SELECT merchant_id, strftime(event_time, '%Y-%m-%d') AS cycle,
    max(CASE WHEN fail_type = 'missed_fraud' THEN 1 ELSE 0 END) = 1 AS tight FROM epi WHERE fail_type IS NOT NULL GROUP BY 1, 2),
adjn AS (SELECT merchant_id, cycle, CASE WHEN tight THEN 'tighten' ELSE 'relax' END AS kind, CASE WHEN tight THEN 1.25 ELSE 0.8 END::DOUBLE AS factor,
    row_number() OVER (PARTITION BY merchant_id ORDER BY cycle) - 1 AS i FROM adj),
walk AS (SELECT merchant_id, i, cycle, kind, 0.55::DOUBLE AS old_hold, least(greatest(round_even(0.55::DOUBLE * factor, 8), 1e-8), 0.999999) AS new_hold FROM adjn WHERE i = 0
  UNION ALL SELECT a.merchant_id, a.i, a.cycle, a.kind, w.new_hold, least(greatest(round_even(w.new_hold * a.factor, 8), 1e-8), 0.999999)
  FROM walk w JOIN adjn a ON a.merchant_id = w.merchant_id AND a.i = w.i + 1)"""


@query("jn_threshold_precedence", sql(
    "SELECT transaction_id, CASE WHEN m.h IS NOT NULL THEN 'merchant' ELSE 'global' END AS threshold_source, "
    "CASE WHEN fraud_probability >= coalesce(m.h, 0.44) THEN 'hold' WHEN fraud_probability >= 0.25 THEN 'review' ELSE 'allow' END AS final_action "
    "FROM dec LEFT JOIN (SELECT merchant_id, max_by(new_hold, i) AS h FROM walk GROUP BY 1 HAVING count(*) >= 17) m USING (merchant_id)",
    "epi", recursive=True, extra=HISTORY_SQL))
def _(t):
    h = MEM.threshold_history(MEM.adjustments_by_cycle(t.episodes()), HOLD)
    often = h.groupBy("merchant_id").agg(F.max_by("new_hold", "i").alias("m_hold"), F.count(F.lit(1)).alias("n"))
    often = often.filter(F.col("n") >= 17).select("merchant_id", "m_hold", F.lit(None).cast("double").alias("m_review"))
    glob = t.spark.range(1).select(F.lit(0.44).alias("g_hold"), F.lit(None).cast("double").alias("g_review"))
    return MEM.apply_overrides(t.decisions(), often, glob, HOLD, REVIEW).select(
        ID, "threshold_source", "final_action")


@query("jn_hot_semi", sql(
    "SELECT transaction_id, merchant_id FROM txn WHERE merchant_id IN (SELECT merchant_id FROM epi WHERE outcome = 'fraud')", "epi"))
def _(t):
    return t.txn().join(MEM.confirmed_merchants(t.episodes()), "merchant_id", "left_semi").select(ID, "merchant_id")


_KEPT = """kc AS (SELECT customer_id FROM txn GROUP BY 1 ORDER BY count(*) DESC, customer_id LIMIT 30),
km AS (SELECT merchant_id FROM txn GROUP BY 1 ORDER BY count(*) DESC, merchant_id LIMIT 25)"""


@query("jn_kept_edges_semi", sql(
    "SELECT 'purchased' AS kind, customer_id AS src, merchant_id AS dst FROM txn WHERE customer_id IN (FROM kc) AND merchant_id IN (FROM km)", "txn", extra=_KEPT))
def _(t):
    d = t.txn()
    nodes = (G.top_degree(d, "customer_id", 30).select(F.lit("customer").alias("node_type"), F.col("customer_id").alias("node_id"))
             .unionByName(G.top_degree(d, "merchant_id", 25).select(F.lit("merchant").alias("node_type"), F.col("merchant_id").alias("node_id"))))
    return G.kept_edges(d, nodes)


@query("jn_dedupe_anti", sql(
    "SELECT DISTINCT strftime(event_time, '%Y-%m-%d') AS day, fail_type AS reason FROM epi WHERE fail_type IS NOT NULL AND (strftime(event_time, '%Y-%m-%d'), fail_type) NOT IN "
    "(SELECT strftime(event_time, '%Y-%m-%d'), fail_type FROM epi WHERE fail_type IS NOT NULL AND event_time < TIMESTAMP '2024-01-20')", "epi"))
def _(t):
    e = t.episodes().filter(F.col("fail_type").isNotNull()).select(
        F.substring("feedback_at", 1, 10).alias("day"), F.col("fail_type").alias("reason"), "model_version")
    return files.append_new(e.filter(F.col("day") < "2024-01-20"), e, ["day", "reason"]).select("day", "reason")


GENE_SQL = """sig AS (SELECT *, substr(md5(regexp_replace(lower(error_text), '[0-9]+', 'N', 'g')), 1, 16) AS signature FROM rep),
gn AS (SELECT signature, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count,
    sum(0.1 * CASE WHEN success THEN 1.0 ELSE -0.5 END * pow(0.9, later)) AS q_value FROM
    (SELECT *, row_number() OVER (PARTITION BY signature, part ORDER BY seq DESC) - 1 AS later FROM
      (SELECT *, {part} AS part FROM sig)) WHERE part = {keep} GROUP BY 1)"""


def gene_outcomes(t):
    return t.repair_log().withColumn("signature", X.error_signature("error_text"))


@query("jn_gene_merge", sql(
    "SELECT signature, CASE WHEN e.q_value >= i.q_value OR i.q_value IS NULL THEN round(e.q_value, 6) ELSE round(i.q_value, 6) END AS q_value, "
    "CASE WHEN e.q_value >= i.q_value OR i.q_value IS NULL THEN e.success_count ELSE i.success_count END AS success_count, "
    "CASE WHEN e.q_value >= i.q_value OR i.q_value IS NULL THEN 'existing' ELSE 'imported' END AS origin FROM gn e FULL JOIN gi i USING (signature)",
    "rep", extra=GENE_SQL.format(part="CAST(amount_id AS INTEGER)", keep="0").replace("CAST(amount_id AS INTEGER)", "seq % 2")
    + ",\n" + GENE_SQL.format(part="seq % 2", keep="1").split("),\n", 1)[1].replace("gn AS", "gi AS", 1)))
def _(t):
    o = gene_outcomes(t)
    mine, theirs = MEM.genes(o.filter(F.col("seq") % 2 == 0)), MEM.genes(o.filter(F.col("seq") % 2 == 1))
    return MEM.merge_genes(mine, theirs).select("signature", F.round("q_value", 6).alias("q_value"), "success_count", "origin")


@query("jn_cross_grid", sql(
    "SELECT transaction_id, f AS feature, CAST(i AS BIGINT) AS step, round(CASE f WHEN 'amount_log1p' THEN a WHEN 'hour_sin' THEN s ELSE c END - i * 0.05 * sc, 6) + 0.0 AS to_value FROM "
    "(SELECT *, greatest(abs(a), abs(s), abs(c), 1e-6) AS sc FROM (SELECT transaction_id, ln(1 + amount) AS a, sin(hour(event_time) * pi() / 12) AS s, cos(hour(event_time) * pi() / 12) AS c FROM dec WHERE action <> 'allow')), "
    "(VALUES ('amount_log1p'), ('hour_sin'), ('hour_cos')) v(f), range(1, 20) r(i)", "dec"))
def _(t):
    flagged = t.decisions().filter(F.col("action") != "allow").select(ID, *X.calendar_columns())
    g = L.perturbation_grid(flagged, [ID])
    return g.select(ID, "feature", F.col("step").cast("long").alias("step"), (F.round("to_value", 6) + 0.0).alias("to_value"))


@query("jn_positional_scores", sql(
    "SELECT transaction_id, split, score AS booster, h / 1000003.0::DOUBLE AS graph, is_fraud FROM scores", "scores"))
def _(t):
    """Base scores of several models stacked by transaction id, never by position."""
    base = t.scores()
    other = t.lines().select(ID, (F.col("h") / F.lit(1000003.0)).alias("graph"))
    return base.select(ID, "split", F.col("score").alias("booster"), "is_fraud").join(other, ID)


# -- set operations ---------------------------------------------------------

@query("set_union_all", sql("SELECT split, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS frauds FROM sp GROUP BY 1", "txn", extra=BOUNDS_SQL))
def _(t):
    d = t.txn()
    s = cards.with_split(d, cards.split_bounds(d))
    parts = [s.filter(F.col("split") == k) for k in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("is_fraud").alias("frauds"))


@query("set_distinct", sql("SELECT DISTINCT customer_id, card_id FROM (SELECT customer_id, card_id FROM txn UNION ALL SELECT customer_id, card_id FROM lines)", "txn", "lines"))
def _(t):
    cols = ["customer_id", "card_id"]
    return t.txn().select(cols).unionByName(t.lines().select(cols)).distinct()


@query("set_except", sql("SELECT DISTINCT merchant_id FROM txn WHERE merchant_id NOT IN (SELECT merchant_id FROM epi WHERE outcome = 'fraud')", "epi"))
def _(t):
    return t.txn().select("merchant_id").distinct().join(MEM.confirmed_merchants(t.episodes()), "merchant_id", "left_anti")


@query("set_except_columns", "SELECT c AS missing, (SELECT count(*) FROM events) AS rows FROM (VALUES "
       "('Amount'), ('Card'), ('Day'), ('Errors?'), ('Is Fraud?'), ('MCC'), ('Merchant City'), ('Merchant Name'), ('Merchant State'), ('Month'), ('Time'), ('Use Chip'), ('User'), ('Year'), ('Zip')) v(c)")
def _(t):
    """Expected minus actual columns of a table that is not a card table at all."""
    e = t.raw("events")
    return e.agg(F.count(F.lit(1)).alias("rows")).select(
        F.explode(F.array(*[F.lit(c) for c in cards.missing_columns(e)])).alias("missing"), "rows")


@query("set_upsert", sql(
    "SELECT merchant_id, CASE WHEN l.n IS NOT NULL THEN l.n ELSE f.n END AS n FROM (SELECT merchant_id, count(*) AS n FROM txn WHERE payment_error IS NULL GROUP BY 1) f "
    "FULL JOIN (SELECT merchant_id, count(*) AS n FROM txn WHERE payment_error IS NOT NULL AND is_fraud = 1 GROUP BY 1) l USING (merchant_id)", "txn"))
def _(t):
    d = t.txn()
    n = F.count(F.lit(1)).alias("n")
    first = d.filter(F.col("payment_error").isNull()).groupBy("merchant_id").agg(n)
    later = d.filter(F.col("payment_error").isNotNull() & (F.col("is_fraud") == 1)).groupBy("merchant_id").agg(n)
    return files.upsert(first, later, "merchant_id")

"""Aggregations: priors, quantiles, ranking metrics, P&L and impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X, reasons
from tidewatch.functions.frame import attach_row
from tidewatch.operators import drift as D, impact as IM, metrics as M, models as MD, priors, ranking as R, velocity as V
from tidewatch.operators.asof import parity_report
from tidewatch.plans.registry import query
from tidewatch.plans.sources import AUC_SQL, BOUNDS_SQL, model_table, write_registry
from tidewatch.plans.scalars import CLASS_SQL
from tidewatch.plans.sqltext import sql
from tidewatch.session import stored
from tidewatch.sources import cards, files

ID = "transaction_id"


def train_txn(t):
    d = t.txn()
    return cards.with_split(d, cards.split_bounds(d)).filter(F.col("split") == "train")


@query("agg_merchant_prior", sql(
    "SELECT merchant_id, count(*) AS n, round_even(avg(is_fraud), 6) AS rate FROM sp WHERE split = 'train' GROUP BY 1 "
    "UNION ALL SELECT '__default__', count(*), round_even(avg(is_fraud), 8) FROM sp WHERE split = 'train'", "txn", extra=BOUNDS_SQL))
def _(t):
    d = train_txn(t)
    default = d.agg(F.count(F.lit(1)).alias("n"), X.half_even(F.avg("is_fraud"), 8).alias("rate"))
    return priors.fit_merchant_rates(d).unionByName(default.select(F.lit("__default__").alias("merchant_id"), "n", "rate"))


@query("agg_freq_share", sql(
    "SELECT merchant_category_code, round_even(count(*) / (SELECT count(*) FROM sp WHERE split = 'train'), 8) AS share FROM sp WHERE split = 'train' GROUP BY 1", "txn", extra=BOUNDS_SQL))
def _(t):
    return priors.fit_shares(train_txn(t), "merchant_category_code")


@query("agg_split_summary", sql(
    "SELECT split, count(*) AS rows, min(us) AS min_us, max(us) AS max_us, round(avg(is_fraud), 8) AS fraud_rate FROM sp GROUP BY 1", "txn", extra=BOUNDS_SQL))
def _(t):
    d = t.txn()
    return cards.split_summary(cards.with_split(d, cards.split_bounds(d))).withColumn("fraud_rate", F.round("fraud_rate", 8))


@query("agg_quantile_bounds", sql("SELECT q[1] AS train_end, q[2] AS validation_end FROM b", "txn", extra=BOUNDS_SQL))
def _(t):
    return cards.check_bounds(cards.split_bounds(t.txn()))


@query("agg_quantile_bounds_sketch", sql(
    "SELECT q[1] AS train_end, q[2] AS validation_end, true AS near, (SELECT count(*) FROM txn) AS n FROM b", "txn", extra=BOUNDS_SQL))
def _(t):
    """The bounds from daily sketches, merged; near: at most 1 % of the rows lie between an estimate and the exact bound."""
    us = t.txn().select(X.micros("event_time").alias("us"), F.to_date("event_time").alias("day"))
    daily = stored(D.quantile_sketches(us, "us", ["day"]), "time-sketches")
    both = attach_row(cards.split_bounds(t.txn()), D.merged_quantiles(daily, [0.6, 0.8]))
    off = [F.count_if(F.col("us").between(F.least(c, F.col("q")[i]), F.greatest(c, F.col("q")[i]))) for i, c in enumerate(("train_end", "validation_end"))]
    return (attach_row(us, both).groupBy("train_end", "validation_end", "n").agg(F.greatest(*off).alias("off"))
            .select("train_end", "validation_end", (F.col("off") <= 0.01 * F.col("n") + 1).alias("near"), "n"))


@query("agg_quantile_linear", sql(
    "SELECT count(*) AS n, round(quantile_cont(score, 0.1), 8) AS p10, round(quantile_cont(score, 0.5), 8) AS p50, round(quantile_cont(score, 0.9), 8) AS p90, round(quantile_cont(score, 0.9895), 8) AS p9895, round(quantile_cont(score, 0.9995), 8) AS p9995 FROM scores", "scores"))
def _(t):
    q = R.quantiles(t.scores().select("score"), "score", [0.1, 0.5, 0.9, 0.9895, 0.9995])
    return q.select("n", *[F.round(F.col("q")[i], 8).alias(n) for i, n in enumerate(["p10", "p50", "p90", "p9895", "p9995"])])


# -- ranking metrics --------------------------------------------------------

CURVE = """g AS (SELECT score, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS pos FROM scores {where} GROUP BY 1),
cv AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS flagged, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER () AS BIGINT) AS tn_, CAST(sum(pos) OVER () AS BIGINT) AS tpos,
  lag(score) OVER (ORDER BY score DESC) AS above FROM g WINDOW w AS (ORDER BY score DESC)),
pr AS (SELECT *, tp / flagged AS precision, tp / tpos AS recall, 2 * (tp / flagged) * (tp / tpos) / ((tp / flagged) + (tp / tpos) + 1e-12) AS f1 FROM cv)"""


def curve(where=""):
    return CURVE.format(where=where)


@query("agg_roc_auc", sql(
    "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(pos) AS BIGINT) AS frauds, round(sum(pos * (tn_ - flagged - (tpos - tp) + (n - pos) / 2.0)) / (max(tpos) * (max(tn_) - max(tpos))), 9) AS roc_auc FROM cv", "scores", extra=curve()))
def _(t):
    return M.roc_auc(t.scores()).withColumn("roc_auc", F.round("roc_auc", 9))


@query("agg_average_precision", sql("SELECT round(sum(pos / tpos * precision), 9) AS average_precision FROM pr", "scores", extra=curve()))
def _(t):
    return M.average_precision(t.scores()).withColumn("average_precision", F.round("average_precision", 9))


@query("agg_pr_curve", sql("SELECT score AS threshold, n, pos, flagged, tp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM pr", "scores", extra=curve()))
def _(t):
    c = M.pr_curve(t.scores())
    return c.select("threshold", "n", "pos", "flagged", "tp", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@query("agg_best_f1", sql(
    "SELECT score AS f1_threshold, round(f1, 9) AS f1_max, round(precision, 9) AS precision, round(recall, 9) AS recall, tp, flagged - tp AS fp, tpos - tp AS fn, tn_ - tpos - (flagged - tp) AS tn FROM pr ORDER BY f1 DESC, score LIMIT 1", "scores", extra=curve()))
def _(t):
    b = M.best_f1(t.scores())
    return b.select("f1_threshold", *[F.round(x, 9).alias(x) for x in ("f1_max", "precision", "recall")], "tp", "fp", "fn", "tn")


@query("agg_recall_at_precision", sql(
    "SELECT " + ", ".join(f"round(coalesce(max(recall) FILTER (precision >= {p}), 0.0), 4) AS recall_at_precision_{n}" for p, n in ((0.25, 25), (0.5, 50), (0.8, 80))) + " FROM pr", "scores", extra=curve()))
def _(t):
    return M.recall_at_precision(t.scores())


@query("agg_precision_at_k", sql(
    "SELECT k, CAST(sum(is_fraud) AS BIGINT) AS hits, round(sum(is_fraud) / k, 4) AS precision_at_k, round(sum(is_fraud) / any_value(f), 4) AS recall_at_k FROM "
    "(SELECT is_fraud, row_number() OVER (ORDER BY score DESC, transaction_id) AS r, sum(is_fraud) OVER () AS f, count(*) OVER () AS n FROM scores), (VALUES (100), (500), (1000), (5000), (10000), (50000)) v(k) WHERE r <= k AND k <= n GROUP BY k", "scores"))
def _(t):
    return M.top_capture(t.scores())


@query("agg_confusion", sql(
    "SELECT count(*) FILTER (score >= 0.35 AND is_fraud = 1) AS tp, count(*) FILTER (score >= 0.35 AND is_fraud = 0) AS fp, count(*) FILTER (score < 0.35 AND is_fraud = 1) AS fn, "
    "count(*) FILTER (score < 0.35 AND is_fraud = 0) AS tn, round(count(*) FILTER (score >= 0.35 AND is_fraud = 0) / count(*) FILTER (is_fraud = 0), 9) AS fpr FROM scores", "scores"))
def _(t):
    return M.confusion(t.scores(), 0.35).withColumn("fpr", F.round("fpr", 9))


@query("agg_action_counts", sql(
    "SELECT " + ", ".join(f"count(*) FILTER (action = '{a}') AS n_{a}, count(*) FILTER (action = '{a}' AND is_fraud = 1) AS fraud_{a}" for a in M.ACTIONS) + " FROM scores", "scores"))
def _(t):
    return M.action_counts(t.scores())


@query("agg_pos_weight", sql(
    "SELECT count(*) FILTER (is_fraud = 0) AS negatives, count(*) FILTER (is_fraud = 1) AS positives, round(count(*) FILTER (is_fraud = 0) / count(*) FILTER (is_fraud = 1), 9) AS pos_weight, "
    "round(count(*) FILTER (is_fraud = 0) / greatest(count(*) FILTER (is_fraud = 1), 1), 9) AS scale_pos_weight FROM scores", "scores"))
def _(t):
    p = M.pos_weight(t.scores())
    return p.select("negatives", "positives", F.round("pos_weight", 9).alias("pos_weight"), F.round("scale_pos_weight", 9).alias("scale_pos_weight"))


@query("agg_standardise", sql(
    "SELECT transaction_id, round((amount - (SELECT avg(amount) FROM txn)) / (SELECT stddev_pop(amount) FROM txn), 6) AS amount, "
    "round((is_fraud - (SELECT avg(is_fraud) FROM txn)) / (SELECT stddev_pop(is_fraud) FROM txn), 6) AS is_fraud, 0.0::DOUBLE AS one FROM txn", "txn"))
def _(t):
    z = M.standardise(t.txn().withColumn("one", F.lit(1.0)), ["amount", "is_fraud", "one"], [ID])
    return z.select(ID, *[F.round(c, 6).alias(c) for c in ("amount", "is_fraud", "one")])


def policy_sql(where: str) -> str:
    return curve(where) + """,
fh AS (SELECT * FROM pr WHERE precision >= 0.8 ORDER BY flagged LIMIT 1), fr AS (SELECT * FROM pr WHERE precision >= 0.3 ORDER BY flagged LIMIT 1),
th0 AS (SELECT (SELECT CASE WHEN flagged - 1 >= 10 THEN (CASE WHEN n >= 2 THEN score ELSE above END + score) / 2 END FROM fh) AS h0,
  (SELECT CASE WHEN flagged - 1 >= 10 THEN (CASE WHEN n >= 2 THEN score ELSE above END + score) / 2 END FROM fr) AS r0,
  (SELECT quantile_cont(score, 0.9995) FROM scores """ + where + """) AS qh, (SELECT quantile_cont(score, 0.9895) FROM scores """ + where + """) AS qr),
th AS (SELECT coalesce(h0, qh) AS hold, CASE WHEN coalesce(r0, qr) > coalesce(h0, qh) THEN coalesce(h0, qh) * 0.9 ELSE coalesce(r0, qr) END AS review, h0 IS NULL OR r0 IS NULL AS fallback_used FROM th0)"""


@query("win_threshold_policy", sql(
    "SELECT round(hold, 6) AS hold_threshold, round(review, 6) AS review_threshold, fallback_used, count(*) FILTER (score < review AND score < hold) AS n_allow, count(*) FILTER (score >= review AND score < hold) AS n_review, count(*) FILTER (score >= hold) AS n_hold, "
    "round(count(*) FILTER (score >= hold AND is_fraud = 1) / greatest(count(*) FILTER (score >= hold), 1), 4) AS hold_precision, "
    "round(count(*) FILTER (score >= review AND score < hold AND is_fraud = 1) / greatest(count(*) FILTER (score >= review AND score < hold), 1), 4) AS review_precision FROM scores, th WHERE split = 'val' GROUP BY hold, review, fallback_used",
    "scores", extra=policy_sql("WHERE split = 'val'")))
def _(t):
    p = M.threshold_policy(t.scores().filter(F.col("split") == "val"))
    return p.select(F.round("hold", 6).alias("hold_threshold"), F.round("review", 6).alias("review_threshold"), "fallback_used",
                    "n_allow", "n_review", "n_hold", "hold_precision", "review_precision")


@query("win_threshold_fallback", sql(
    "SELECT round(hold, 6) AS hold_threshold, round(review, 6) AS review_threshold, fallback_used FROM "
    "(SELECT quantile_cont(fraud_probability, 0.9995) AS hold, quantile_cont(fraud_probability, 0.9895) AS review, true AS fallback_used FROM dec)", "dec"))
def _(t):
    """A score that never reaches the target precision takes the fixed top shares."""
    d = t.decisions().withColumn("score", F.col("fraud_probability"))
    p = M.threshold_policy(d, hold_precision=0.999, review_precision=0.995, min_index=100)
    return p.select(F.round("hold", 6).alias("hold_threshold"), F.round("review", 6).alias("review_threshold"), "fallback_used")


@query("ml_metrics_report", sql(
    "SELECT split, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS frauds, round((sum(CASE WHEN is_fraud = 1 THEN r END) - sum(is_fraud) * (sum(is_fraud) + 1) / 2.0) / (sum(is_fraud) * (count(*) - sum(is_fraud))), 9) AS roc_auc, "
    "round(any_value(ap), 9) AS average_precision FROM (SELECT split, is_fraud, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0 AS r FROM scores) JOIN "
    "(SELECT split, sum(pos / tpos * (tp / flagged)) AS ap FROM (SELECT split, score, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged, sum(pos) OVER (PARTITION BY split) AS tpos FROM "
    "(SELECT split, score, count(*) AS n, sum(is_fraud) AS pos FROM scores GROUP BY 1, 2) WINDOW w AS (PARTITION BY split ORDER BY score DESC)) GROUP BY 1) USING (split) GROUP BY split", "scores"))
def _(t):
    m = M.metrics_report(t.scores())
    return m.select("split", "rows", "frauds", F.round("roc_auc", 9).alias("roc_auc"), F.round("average_precision", 9).alias("average_precision"))


# -- outcome and impact -----------------------------------------------------

def inr(t):
    return t.decisions().withColumn("amount_inr", F.col("amount") * C.INR_PER_USD)


@query("agg_pnl", sql(
    "SELECT count(*) AS n, round(p, 2) AS fraud_prevented_value, round(m, 2) AS missed_fraud_value, round(f, 2) AS false_positive_cost, round(p - f, 2) AS net_protected_value, "
    + ", ".join(f"count(*) FILTER (c = '{c}') AS n_{c}" for c in C.OUTCOME_CLASSES.values())
    + f" FROM (SELECT *, {CLASS_SQL} AS c FROM dec), (SELECT sum(CASE WHEN c = 'fraud_prevented' THEN amount * 83.5::DOUBLE ELSE 0 END) AS p, sum(CASE WHEN c = 'missed_fraud' THEN amount * 83.5::DOUBLE ELSE 0 END) AS m, "
    f"sum(CASE WHEN c = 'false_positive' THEN amount * 83.5::DOUBLE ELSE 0 END) AS f FROM (SELECT *, {CLASS_SQL} AS c FROM dec)) GROUP BY p, m, f", "dec"))
def _(t):
    return IM.pnl(inr(t))


_U = "CAST(coalesce(sum(CASE WHEN {c} THEN CAST(round(amount * 10000) AS BIGINT) END), 0) AS BIGINT) / 10000.0::DOUBLE"
IMPACT = ("im AS (SELECT count(*) AS rows, count(*) FILTER (is_fraud = 1) AS frauds, " + _U.format(c="is_fraud = 1") + " AS fraud_amount_usd, "
          + ", ".join(f"count(*) FILTER (action = '{a}') AS n_{a}" for a in ("allow", "review", "hold")) + ", "
          + ", ".join(f"count(*) FILTER (is_fraud = 1 AND action = '{a}') AS caught_{a}, " + _U.format(c=f"is_fraud = 1 AND action = '{a}'") + f" AS caught_{a}_usd" for a in ("review", "hold"))
          + " FROM scores WHERE split = 'test'),\n"
          "ir AS (SELECT *, caught_review + caught_hold AS frauds_caught, round((caught_review + caught_hold) / greatest(frauds, 1), 4) AS recall_by_count, round((caught_review_usd + caught_hold_usd) / fraud_amount_usd, 4) AS recall_by_amount, "
          "round(caught_review_usd + caught_hold_usd, 2) AS fraud_amount_caught_usd, round(fraud_amount_usd - (caught_review_usd + caught_hold_usd), 2) AS fraud_amount_missed_usd, round(CAST(fraud_amount_usd AS DECIMAL(30,4)) * 83.5, 2)::DOUBLE AS fraud_amount_inr, "
          "round(CAST(caught_review_usd + caught_hold_usd AS DECIMAL(30,4)) * 83.5, 2)::DOUBLE AS fraud_amount_caught_inr, round((caught_review_usd + caught_hold_usd) * 83.5::DOUBLE / 17.0::DOUBLE, 2) AS per_month_protected_inr, "
          "round((fraud_amount_usd - (caught_review_usd + caught_hold_usd)) * 83.5::DOUBLE / 17.0::DOUBLE, 2) AS per_month_missed_inr FROM im)")


def impact_report(t):
    return IM.impact(t.scores().filter(F.col("split") == "test"), months=17.0)


@query("agg_impact", sql("SELECT * FROM ir", "scores", extra=IMPACT))
def _(t):
    return impact_report(t)


@query("agg_verified_pnl", sql(
    "SELECT fraud_amount_caught_inr AS fraud_prevented_value, round(CAST(fraud_amount_missed_usd AS DECIMAL(30,4)) * 83.5, 2)::DOUBLE AS missed_fraud_value, n_hold - caught_hold AS false_positive_legit_holds, round(n_hold / rows, 6) AS hold_volume_fraction, "
    "frauds, frauds_caught, recall_by_count, recall_by_amount, per_month_protected_inr, round(fraud_amount_caught_inr - round(CAST(fraud_amount_missed_usd AS DECIMAL(30,4)) * 83.5, 2)::DOUBLE, 2) AS net_protected_value FROM ir", "scores", extra=IMPACT))
def _(t):
    return IM.verified_pnl(impact_report(t))


@query("agg_impact_summary", sql(
    "SELECT fraud_amount_caught_inr AS total_protected_inr, per_month_protected_inr AS monthly_protected_inr, recall_by_amount AS fraud_amount_blocked_rate, recall_by_count AS fraud_events_blocked_rate FROM ir", "scores", extra=IMPACT))
def _(t):
    return IM.headline(impact_report(t))


LIFT = ["amount", "score", "hour", "customer_load"]


@query("agg_signal_lift", sql(
    "SELECT feature, round(coalesce(avg(value) FILTER (grp = 'held'), 0.0), 3) AS held_fraud_mean, round(coalesce(avg(value) FILTER (grp = 'allowed'), 0.0), 3) AS allowed_legit_mean, "
    "CASE WHEN avg(value) FILTER (grp = 'allowed') > 1e-9 THEN round(avg(value) FILTER (grp = 'held') / avg(value) FILTER (grp = 'allowed'), 2) END AS lift, round(quantile_cont(value, 0.9) FILTER (grp = 'held'), 3) AS held_fraud_p90 FROM "
    "(UNPIVOT (SELECT CASE WHEN action = 'hold' AND is_fraud = 1 THEN 'held' WHEN action = 'allow' AND is_fraud = 0 THEN 'allowed' END AS grp, amount, score, CAST(hour(event_time) AS DOUBLE) AS hour, CAST(seq % 8 AS DOUBLE) AS customer_load FROM scores) "
    "ON amount, score, hour, customer_load INTO NAME feature VALUE value) WHERE grp IS NOT NULL GROUP BY 1", "scores"))
def _(t):
    d = t.scores().withColumn("hour", F.hour("event_time")).withColumn("customer_load", F.col("seq") % 8)
    return IM.signal_lift(d, LIFT)


@query("agg_top_mcc", sql(
    "SELECT merchant_category_code AS mcc, round(CAST(amt AS DECIMAL(30,4)) * 83.5, 2)::DOUBLE AS fraud_amount_inr FROM (SELECT merchant_category_code, sum(CAST(round(amount * 10000) AS BIGINT))::BIGINT / 10000.0::DOUBLE AS amt FROM lines WHERE is_fraud = 1 GROUP BY 1) ORDER BY amt DESC, mcc LIMIT 5", "lines"))
def _(t):
    return IM.top_categories(t.lines())


# -- attributions and parity ------------------------------------------------

ATTR = {"amount_log1p": "amount - 20", "is_night": "hour(event_time) - 12", "channel_online": "seq % 11 - 5", "merch_fraud_rate_prior": "is_fraud * 40 - 1"}


def attributions(t):
    d = t.txn()
    return d.select(ID, ((F.col("amount") - 20) / 50.0).alias("amount_log1p"), ((F.hour("event_time") - 12) / F.lit(50.0)).alias("is_night"),
                    ((F.col("seq") % 11 - 5) / F.lit(50.0)).alias("channel_online"), ((F.col("is_fraud") * 40 - 1) / F.lit(50.0)).alias("merch_fraud_rate_prior"))


_ATTR_SQL = "attr_ AS (SELECT transaction_id, " + ", ".join(f"({e}) / 50.0::DOUBLE AS {n}" for n, e in ATTR.items()) + " FROM txn)"


@query("agg_mean_abs_attr", sql(" UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg(abs({n})), 8) AS mean_abs FROM attr_" for n in ATTR), "txn", extra=_ATTR_SQL))
def _(t):
    a = attributions(t).unpivot([ID], list(ATTR), "feature", "value")
    return a.groupBy("feature").agg(F.round(F.avg(F.abs("value")), 8).alias("mean_abs"))


@query("agg_row_top_reasons", sql(
    "SELECT transaction_id, string_agg(f || ' pushed ' || printf('%.4f', abs(v)) || CASE WHEN v > 0 THEN ' toward fraud' ELSE ' away from fraud' END, ' | ' ORDER BY abs(v) DESC, f) AS reasons FROM "
    "(SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(v) DESC, f) AS r FROM (UNPIVOT attr_ ON amount_log1p, is_night, channel_online, merch_fraud_rate_prior INTO NAME f VALUE v)) WHERE r <= 3 GROUP BY 1", "txn", extra=_ATTR_SQL))
def _(t):
    a = attributions(t)
    return a.select(ID, F.array_join(F.transform(reasons.top_attributions(list(ATTR), 3), lambda x: x["detail"]), " | ").alias("reasons"))


@query("agg_parity_report", sql(
    "SELECT c AS \"column\", count(*) AS rows_compared, CASE c WHEN 'cust_amount_mean_prior' THEN 0.0 ELSE 0.0 END::DOUBLE AS max_abs_diff, true AS exact_match FROM txn, (VALUES ('cust_txn_count_prior'), ('merch_txn_count_prior'), ('card_amount_mean_prior')) v(c) GROUP BY c", "txn"))
def _(t):
    d = t.txn()
    cols = ["cust_txn_count_prior", "merch_txn_count_prior", "card_amount_mean_prior"]
    p = parity_report(V.velocity_features(d), V.history_features(d), ID, cols)
    return p.withColumn("max_abs_diff", F.round("max_abs_diff", 6))


# -- models -----------------------------------------------------------------

RANK = """rk AS (SELECT m.name, coalesce(m.test_roc, m.val_roc - 0.02) AS rank_score, bar FROM models m, (SELECT coalesce(max(coalesce(test_roc, -1.0)), -1.0) AS bar FROM models WHERE name = 'c3') WHERE m.name <> 'c3'),
rn AS (SELECT name, rank_score, row_number() OVER (ORDER BY rank_score DESC, name DESC) AS rank FROM rk WHERE rank_score > bar)"""


@query("agg_model_rank", sql("SELECT name, round(rank_score, 6) AS rank_score, rank FROM rn", "scores", extra=AUC_SQL + ",\n" + RANK))
def _(t):
    r = MD.rank_candidates(MD.flat(files.read_registry(t.spark, write_registry(t), "*.json")), "c3")
    return r.select("name", F.round("rank_score", 6).alias("rank_score"), F.col("rank").cast("long").alias("rank"))


@query("agg_gate_verdict", sql(
    "SELECT name, CASE WHEN val_roc >= s THEN 'PASS' ELSE 'BLOCKED' END AS gate, CASE WHEN test_rows < 500 THEN 'insufficient_evidence' WHEN val_roc - s >= 0.02 THEN 'pass_with_caveat' WHEN val_roc - s <= -0.02 THEN 'fail' ELSE 'insufficient_evidence' END AS verdict "
    "FROM models, (SELECT val_roc AS s FROM models WHERE name = 'c3')", "scores", extra=AUC_SQL))
def _(t):
    m = model_table(t)
    s = m.filter(F.col("name") == "c3").agg(F.max("val_roc").alias("s"))
    j = m.join(F.broadcast(s))
    margin = F.col("val_roc") - F.col("s")
    gain = F.when(margin >= 0, 10).otherwise(-10)
    return j.select("name", MD.promotion_gate(F.col("val_roc"), F.col("s")).alias("gate"),
                    MD.repair_verdict(F.col("test_rows"), margin, gain, F.lit(0)).alias("verdict"))


@query("rp_model_race", sql(
    "SELECT name, CASE WHEN name = 'c3' THEN 'serving' ELSE 'candidate' END AS role, name = 'c7' AS is_hero, name <> 'c7' AND name LIKE 'c1%' AS is_research, val_roc, test_roc FROM models", "scores", extra=AUC_SQL))
def _(t):
    m = MD.flat(files.read_registry(t.spark, write_registry(t), "*.json"))
    return MD.race(m, "c3", "c7", ("c1",)).select("name", "role", "is_hero", "is_research", "val_roc", "test_roc")


@query("rp_model_status", sql("SELECT name, true AS ready, 0.6::DOUBLE AS hold, 0.35::DOUBLE AS review, val_roc, training_rows FROM models WHERE name = 'c3'", "scores", extra=AUC_SQL))
def _(t):
    m = MD.flat(files.read_registry(t.spark, write_registry(t), "*.json")).filter(F.col("name") == "c3")
    return m.select("name", F.col("model_name").isNotNull().alias("ready"), "hold", "review", "val_roc", "training_rows")


@query("rp_decision_parity", sql(
    "SELECT round(roc, 6) AS roc_auc, a AS n_allow, true AS matches FROM (SELECT (sum(CASE WHEN is_fraud = 1 THEN r END) - sum(is_fraud) * (sum(is_fraud) + 1) / 2.0) / (sum(is_fraud) * (count(*) - sum(is_fraud))) AS roc, count(*) FILTER (action = 'allow') AS a "
    "FROM (SELECT is_fraud, action, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scores))", "scores"))
def _(t):
    s = stored(t.scores().select("score", "is_fraud", "action"), "scores")  # four aggregates read it
    rec = M.roc_auc(s).select(F.round("roc_auc", 4).alias("rec_roc_auc")).join(F.broadcast(M.action_counts(s).select(
        *[F.col(f"n_{a}").alias(f"rec_{a}") for a in M.ACTIONS])))
    p = IM.require_parity(IM.decision_parity(M.roc_auc(s), M.action_counts(s), rec))
    return p.select(F.round("roc_auc", 6).alias("roc_auc"), "n_allow", "matches")

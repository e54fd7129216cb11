"""Graph tables, history windows and pattern queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidewatch.operators import graph as G, memory as MEM
from tidewatch.plans.registry import query
from tidewatch.plans.sqltext import sql
from tidewatch.session import stored

MN = "mn AS (SELECT merchant_id, min_by(merchant_category_code, (us, seq)) AS mcc, avg(is_fraud) AS fraud_rate FROM txn GROUP BY 1)"


def _show(df):
    return df.withColumn("fraud_rate", F.round("fraud_rate", 6))


_PAIR = "customer_id, merchant_id, mcc, round(fraud_rate, 6) AS fraud_rate"
_BY = "ORDER BY customer_id, merchant_id, seq, transaction_id"


@query("gq_overview", sql(f"SELECT {_PAIR} FROM txn JOIN mn USING (merchant_id) {_BY} LIMIT 40", "txn", extra=MN))
def _(t):
    return _show(G.overview(t.txn()))


@query("gq_hot_merchants", sql(f"SELECT {_PAIR} FROM txn JOIN mn USING (merchant_id) WHERE fraud_rate > 0.02 {_BY} LIMIT 60", "txn", extra=MN))
def _(t):
    return _show(G.hot_merchant_pairs(t.txn(), rate=0.02))


@query("gq_cards_of_customers", sql("SELECT DISTINCT customer_id, card_id FROM txn ORDER BY customer_id, card_id LIMIT 40", "txn"))
def _(t):
    return G.cards_of_customers(t.txn())


@query("gq_fraud_edges", sql(f"SELECT {_PAIR} FROM txn JOIN mn USING (merchant_id) WHERE is_fraud = 1 {_BY} LIMIT 50", "txn", extra=MN))
def _(t):
    return _show(G.fraud_edges(t.txn()))


_WEB = MN + """,
top_ AS (SELECT merchant_id FROM mn WHERE fraud_rate > 0 ORDER BY fraud_rate DESC, merchant_id LIMIT 6),
seed AS (SELECT DISTINCT customer_id FROM txn WHERE merchant_id IN (FROM top_) ORDER BY customer_id LIMIT 20),
lk AS (SELECT DISTINCT customer_id, merchant_id AS fraud_merchant FROM txn WHERE merchant_id IN (FROM top_) AND customer_id IN (FROM seed)),
web AS (SELECT t.customer_id, fraud_merchant, t.merchant_id, mcc, fraud_rate FROM txn t JOIN lk ON t.customer_id = lk.customer_id AND t.merchant_id <> fraud_merchant
  JOIN mn ON mn.merchant_id = t.merchant_id ORDER BY t.customer_id, fraud_merchant, t.merchant_id, seq LIMIT 70)"""


@query("gq_fraud_web", sql("SELECT customer_id, fraud_merchant, merchant_id, mcc, round(fraud_rate, 6) AS fraud_rate FROM web", "txn", extra=_WEB))
def _(t):
    return _show(G.fraud_web(t.txn()))


@query("gq_render", sql(
    "SELECT 'node' AS part, id, type AS kind, CASE WHEN max(fraud_rate) > 0.05 THEN 'fraud' ELSE 'clear' END AS detail, 1::BIGINT AS n FROM "
    "(SELECT 'customer-' || customer_id AS id, 'customer' AS type, fraud_rate FROM web UNION ALL SELECT 'merchant-' || merchant_id, 'merchant', fraud_rate FROM web) GROUP BY id, type "
    "UNION ALL SELECT 'edge', 'customer-' || customer_id, 'purchased', 'merchant-' || merchant_id, count(*) FROM web GROUP BY customer_id, merchant_id", "txn", extra=_WEB))
def _(t):
    nodes, edges = G.render(G.fraud_web(t.txn()))
    a = nodes.select(F.lit("node").alias("part"), "id", F.col("type").alias("kind"),
                     F.when(F.col("fraud"), "fraud").otherwise("clear").alias("detail"), F.lit(1).cast("long").alias("n"))
    b = edges.groupBy(F.lit("edge").alias("part"), F.col("source").alias("id"), F.lit("purchased").alias("kind"),
                      F.col("target").alias("detail")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


_SUB = """deg AS (SELECT merchant_id, count(*) AS d FROM txn GROUP BY 1),
seed AS (SELECT customer_id FROM txn GROUP BY 1 ORDER BY count(*) DESC, customer_id LIMIT 10),
m1 AS (SELECT merchant_id, row_number() OVER (ORDER BY d DESC, merchant_id) AS r FROM deg WHERE merchant_id IN (SELECT merchant_id FROM txn WHERE customer_id IN (FROM seed)) ORDER BY r LIMIT 40),
more AS (SELECT customer_id FROM txn JOIN m1 USING (merchant_id) WHERE customer_id NOT IN (FROM seed) GROUP BY 1 ORDER BY min(r), customer_id LIMIT 30),
cu AS (FROM seed UNION ALL FROM more),
m2 AS (SELECT merchant_id FROM deg WHERE merchant_id IN (SELECT merchant_id FROM txn WHERE customer_id IN (FROM cu)) AND merchant_id NOT IN (SELECT merchant_id FROM m1) ORDER BY d DESC, merchant_id LIMIT (SELECT 40 - count(*) FROM m1)),
ca AS (SELECT DISTINCT customer_id, card_id FROM txn WHERE customer_id IN (FROM cu) ORDER BY 1, 2 LIMIT 20)"""


@query("gq_sample_subgraph", sql(
    "SELECT 'customer' AS node_type, customer_id AS node_id FROM cu UNION ALL SELECT 'merchant', merchant_id FROM m1 UNION ALL SELECT 'merchant', merchant_id FROM m2 UNION ALL SELECT 'card', card_id FROM ca", "txn", extra=_SUB))
def _(t):
    return G.sample_subgraph(t.txn())


# -- snapshots and history --------------------------------------------------

def month_sql(base: str, idc: str, partner: str) -> str:
    return (f"em AS (SELECT {idc} AS id, (year(event_time) - 1970) * 12 + month(event_time) - 1 AS month_idx, count(*) AS n, "
            f"sum(CAST(round(amount * 10000) AS BIGINT))::BIGINT / 10000.0::DOUBLE AS amt, count(DISTINCT {partner}) AS extra, sum(is_fraud)::BIGINT AS fraud FROM {base} GROUP BY 1, 2)")


@query("agg_entity_month", sql("SELECT id AS customer_id, month_idx, n, amt, extra, fraud FROM em", "lines", extra=month_sql("lines", "customer_id", "merchant_id")))
def _(t):
    return G.entity_month(G.with_buckets(t.lines()), "customer_id", "merchant_id")


@query("agg_entity_month_sketch", sql(
    "SELECT id AS customer_id, month_idx, n, amt, fraud, extra, CAST(sum(coalesce(fresh, 0)) OVER (PARTITION BY id ORDER BY month_idx) AS BIGINT) AS until, true AS near FROM em LEFT JOIN "
    "(SELECT customer_id AS id, month_idx, count(*) AS fresh FROM (SELECT customer_id, merchant_id, min((year(event_time) - 1970) * 12 + month(event_time) - 1) AS month_idx FROM lines GROUP BY 1, 2) GROUP BY 1, 2) USING (id, month_idx)",
    "lines", extra=month_sql("lines", "customer_id", "merchant_id")))
def _(t):
    """Monthly partners as mergeable sketches, beside exact numbers; near: month and whole past are within five standard errors."""
    b = G.with_buckets(t.lines())
    sketched = stored(G.entity_month_sketches(b, "customer_id", "merchant_id"), "partner-sketches")
    month = sketched.select("customer_id", "month_idx", F.hll_sketch_estimate("partners").alias("m"))
    first = b.groupBy("customer_id", "merchant_id").agg(F.min("month_idx").alias("month_idx")).groupBy("customer_id", "month_idx").agg(F.count("merchant_id").alias("new"))
    past = Window.partitionBy("customer_id").orderBy("month_idx").rowsBetween(Window.unboundedPreceding, 0)  # a row a month
    exact = G.entity_month(b, "customer_id", "merchant_id").join(first, ["customer_id", "month_idx"], "left").withColumn(
        "until", F.sum(F.coalesce("new", F.lit(0))).over(past))
    both = exact.join(month, ["customer_id", "month_idx"]).join(G.partners_until(sketched, "customer_id"), ["customer_id", "month_idx"])
    off = lambda a, e: F.abs(F.col(a) - F.col(e)) <= 1 + 5 * 0.0163 * F.col(e)
    return both.select("customer_id", "month_idx", "n", "amt", "fraud", "extra", "until", (off("m", "extra") & off("partners_until", "until")).alias("near"))


_CUM = ", ".join(f"sum({c}) OVER w - {c} AS hist_{c}" for c in ("n", "extra", "fraud"))


@query("win_hist_exclusive", sql(
    "SELECT id AS customer_id, month_idx, CAST(sum(n) OVER w - n AS BIGINT) AS hist_n, round(sum(amt) OVER w - amt, 2) AS hist_amt, CAST(sum(extra) OVER w - extra AS BIGINT) AS hist_extra, "
    "CAST(sum(fraud) OVER w - fraud AS BIGINT) AS hist_fraud, count(*) OVER w - 1 AS hist_months FROM em WINDOW w AS (PARTITION BY id ORDER BY month_idx)",
    "lines", extra=month_sql("lines", "customer_id", "merchant_id")))
def _(t):
    h = G.history(G.entity_month(G.with_buckets(t.lines()), "customer_id", "merchant_id"), "customer_id")
    return h.withColumn("hist_amt", F.round("hist_amt", 2))


def hist_sql(base, idc, partner):
    return month_sql(base, idc, partner) + """,
cuts AS (SELECT DISTINCT ((year(event_time) - 1970) * 12 + month(event_time) - 1) // 12 AS bucket_idx FROM """ + base + """),
hi AS (SELECT em.id, bucket_idx, sum(n)::BIGINT AS n, sum(amt) AS amt, sum(extra)::BIGINT AS extra, sum(fraud)::BIGINT AS fraud, count(*) AS months, max(month_idx) AS month_idx
  FROM em JOIN cuts ON em.month_idx < bucket_idx * 12 GROUP BY 1, 2)"""


@query("win_latest_past", sql(
    "SELECT id AS merchant_id, bucket_idx, month_idx, n AS hist_n, round(amt, 2) AS hist_amt, extra AS hist_extra, fraud AS hist_fraud, months AS hist_months FROM hi", "lines",
    extra=hist_sql("lines", "merchant_id", "customer_id")))
def _(t):
    b = G.with_buckets(t.lines())
    h = G.history(G.entity_month(b, "merchant_id", "customer_id"), "merchant_id", exclusive=False)
    return G.latest_past(h, "merchant_id", G.bucket_list(b)).withColumn("hist_amt", F.round("hist_amt", 2))


def node_sql(idc, partner, kind):
    return ("SELECT '" + kind + "' AS node_type, r.id AS node_id, bucket_idx, round(ln(1 + coalesce(n, 0)), 6) AS log_n, round(ln(1 + greatest(coalesce(amt, 0), 0)), 6) AS log_amount, "
            "round(ln(1 + coalesce(extra, 0)), 6) AS log_extra, round(CASE WHEN n > 0 THEN least(fraud / n, 1.0) ELSE 0.0 END, 6) AS fraud_rate, round(ln(1 + coalesce(fraud, 0)), 6) AS log_frauds, "
            "round(ln(1 + coalesce(amt / n, 0)), 6) AS log_avg_amount, round(CASE WHEN n > 0 THEN least(extra / n, 1.0) ELSE 0.0 END, 6) AS partner_density, round(ln(1 + coalesce(amt / months, 0)), 6) AS log_velocity "
            f"FROM (SELECT DISTINCT {idc} AS id FROM lines) r CROSS JOIN cuts LEFT JOIN hi USING (id, bucket_idx)")


@query("win_node_features", sql(node_sql("merchant_id", "customer_id", "merchant"), "lines", extra=hist_sql("lines", "merchant_id", "customer_id")))
def _(t):
    n = G.snapshot_nodes(t.lines()).filter(F.col("node_type") == "merchant")
    return n.select(*[F.round(c, 6).alias(c) if ty == "double" else F.col(c) for c, ty in n.dtypes])


def _all_nodes_sql():
    parts, extra = [], []
    for i, (kind, (idc, partner)) in enumerate(G.NODE_TYPES.items()):
        h = hist_sql("lines", idc, partner).replace("em AS", f"em{i} AS").replace("FROM em ", f"FROM em{i} em ").replace("hi AS", f"hi{i} AS").replace("cuts AS", f"cuts{i} AS").replace("JOIN cuts", f"JOIN cuts{i}")
        extra.append(h)
        parts.append(node_sql(idc, partner, kind).replace("CROSS JOIN cuts", f"CROSS JOIN cuts{i}").replace("LEFT JOIN hi ", f"LEFT JOIN hi{i} hi "))
    return sql(" UNION ALL ".join(parts), "lines", extra=",\n".join(extra))


@query("gr_snapshot_nodes", _all_nodes_sql())
def _(t):
    n = G.snapshot_nodes(t.lines())
    return n.select(*[F.round(c, 6).alias(c) if ty == "double" else F.col(c) for c, ty in n.dtypes])


@query("gr_snapshot_edges", sql(
    "SELECT transaction_id, customer_id AS src, merchant_id AS dst, m // 12 AS bucket_idx, m AS month_idx, round(ln(1 + amount), 6) AS amount_log1p, round(sin(hour(event_time) * pi() / 12), 6) + 0.0 AS hour_sin, "
    "round(cos(hour(event_time) * pi() / 12), 6) + 0.0 AS hour_cos, CASE WHEN hour(event_time) < 5 OR hour(event_time) >= 23 THEN 1 ELSE 0 END AS is_night, CASE WHEN isodow(event_time) >= 6 THEN 1 ELSE 0 END AS is_weekend, "
    "CASE WHEN payment_channel LIKE 'Swipe%' THEN 1 ELSE 0 END AS channel_swipe, CASE WHEN payment_channel LIKE 'Chip%' THEN 1 ELSE 0 END AS channel_chip, CASE WHEN payment_channel LIKE 'Online%' THEN 1 ELSE 0 END AS channel_online, "
    "round(f, 6) AS month_frac, is_fraud AS label FROM (SELECT *, (year(event_time) - 1970) * 12 + month(event_time) - 1 AS m FROM lines) "
    "JOIN (SELECT bucket_idx, (row_number() OVER (ORDER BY bucket_idx) - 1) / greatest(count(*) OVER () - 1, 1) AS f FROM (SELECT DISTINCT ((year(event_time) - 1970) * 12 + month(event_time) - 1) // 12 AS bucket_idx FROM lines)) b ON b.bucket_idx = m // 12", "lines"))
def _(t):
    e = G.edge_attributes(t.lines())
    return e.select(*[(F.round(c, 6) + 0.0).alias(c) if ty == "double" else F.col(c) for c, ty in e.dtypes])


@query("gr_edge_kinds", sql(
    "SELECT kind, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM (SELECT 'purchased' AS kind, customer_id AS src, merchant_id AS dst FROM lines UNION ALL SELECT 'rev_purchased', merchant_id, customer_id FROM lines "
    "UNION ALL SELECT DISTINCT 'has_card', customer_id, card_id FROM lines UNION ALL SELECT DISTINCT 'rev_has_card', card_id, customer_id FROM lines) GROUP BY 1", "lines"))
def _(t):
    return G.edges(t.lines()).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


_MASK = """nd AS (SELECT 'customer' AS node_type, customer_id AS node_id FROM (SELECT DISTINCT customer_id FROM lines) UNION ALL SELECT 'merchant', merchant_id FROM (SELECT DISTINCT merchant_id FROM lines)
  UNION ALL SELECT 'card', card_id FROM (SELECT DISTINCT card_id FROM lines)),
nb AS (SELECT * FROM nd CROSS JOIN (SELECT DISTINCT ((year(event_time) - 1970) * 12 + month(event_time) - 1) // 12 AS bucket_idx FROM lines)),
mk AS (SELECT *, row_number() OVER (PARTITION BY node_type, bucket_idx ORDER BY md5('1|' || bucket_idx || '|' || node_type || '|' || node_id), node_id)
   <= greatest(1, floor(count(*) OVER (PARTITION BY node_type, bucket_idx) * 0.15)) AS masked FROM nb)"""


@query("win_mask_nodes", sql("SELECT node_type, node_id, bucket_idx, masked FROM mk", "lines", extra=_MASK))
def _(t):
    n = G.snapshot_nodes(t.lines()).select("node_type", "node_id", "bucket_idx")
    return G.mask_nodes(n, 0.15, epoch=1)


@query("gr_masked_targets", sql(
    "SELECT mk.node_type, mk.node_id, mk.bucket_idx, CASE WHEN masked THEN -1.0 ELSE 0.0 + v END::DOUBLE AS shown, CASE WHEN masked THEN v END AS target FROM mk "
    "JOIN (SELECT 'customer' AS node_type, r.id AS node_id, bucket_idx, round(ln(1 + coalesce(n, 0)), 6) AS v FROM (SELECT DISTINCT customer_id AS id FROM lines) r CROSS JOIN cuts LEFT JOIN hi USING (id, bucket_idx)) f USING (node_type, node_id, bucket_idx)",
    "lines", extra=_MASK + ",\n" + hist_sql("lines", "customer_id", "merchant_id")))
def _(t):
    n = G.snapshot_nodes(t.lines()).filter(F.col("node_type") == "customer")
    m = G.masked_targets(n, ["log_n"], 0.15, epoch=1, hidden=-1.0)
    return m.select("node_type", "node_id", "bucket_idx", F.round("shown", 6).alias("shown"), F.round("target", 6).alias("target"))


# -- counts and reports -----------------------------------------------------

@query("agg_merchant_nodes", sql("SELECT merchant_id, mcc, round(fraud_rate, 8) AS fraud_rate FROM mn", "txn", extra=MN))
def _(t):
    return G.merchant_nodes(t.txn()).withColumn("fraud_rate", F.round("fraud_rate", 8))


STATS = ("SELECT count(DISTINCT customer_id) AS customers, count(DISTINCT merchant_id) AS merchants, count(DISTINCT card_id) AS cards, count(*) AS purchased, "
         "count(DISTINCT (customer_id, card_id)) AS has_card, CAST(sum(is_fraud) AS BIGINT) AS fraud_edges FROM lines")


@query("agg_graph_stats", sql(STATS, "lines"))
def _(t):
    return G.graph_stats(t.lines())


@query("agg_snapshot_meta", sql(
    "SELECT ((year(event_time) - 1970) * 12 + month(event_time) - 1) // 12 AS bucket_idx, count(*) AS n_edges, CAST(sum(is_fraud) AS BIGINT) AS n_fraud FROM lines GROUP BY 1", "lines"))
def _(t):
    return G.snapshot_meta(t.lines())


@query("agg_degree", sql(
    "SELECT 'customer' AS node_type, customer_id AS node_id, count(*) AS degree FROM lines GROUP BY ALL UNION ALL SELECT 'merchant', merchant_id, count(*) FROM lines GROUP BY ALL", "lines"))
def _(t):
    d = t.lines()
    part = lambda kind, c: G.degrees(d, c).select(F.lit(kind).alias("node_type"), F.col(c).alias("node_id"), "degree")
    return part("customer", "customer_id").unionByName(part("merchant", "merchant_id"))


@query("agg_bucket_median", sql(
    "SELECT bucket_idx, med AS median_month, CASE WHEN med < 348 THEN 'train' WHEN med < 366 THEN 'val' ELSE 'test' END AS by_cutoff, "
    "CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'val' ELSE 'test' END AS by_count FROM (SELECT bucket_idx, med, row_number() OVER (ORDER BY bucket_idx) - 1 AS i, count(*) OVER () AS n FROM "
    "(SELECT m // 12 AS bucket_idx, quantile_disc(m, 0.5) AS med FROM (SELECT (year(event_time) - 1970) * 12 + month(event_time) - 1 AS m FROM lines) GROUP BY 1))", "lines"))
def _(t):
    return G.bucket_split(t.lines(), (348, 366))


@query("top_degree", sql("SELECT merchant_id, count(*) AS degree FROM txn GROUP BY 1 ORDER BY degree DESC, merchant_id LIMIT 15", "txn"))
def _(t):
    return G.top_degree(t.txn(), "merchant_id", 15)


@query("rp_graph_status", sql(
    "SELECT customers, merchants, cards, purchased AS total_edges, fraud_edges AS total_fraud_edges, buckets, first_bucket, last_bucket, top_merchant, top_failures FROM (" + STATS.replace("FROM lines", "FROM txn") + "), "
    "(SELECT count(*) AS buckets, min(b) AS first_bucket, max(b) AS last_bucket FROM (SELECT DISTINCT (year(event_time) - 1970) * 12 + month(event_time) - 1 AS b FROM txn)), "
    "(SELECT merchant_id AS top_merchant, count(*) FILTER (fail_type IS NOT NULL) AS top_failures FROM epi GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)", "epi"))
def _(t):
    d = t.txn()
    meta = G.snapshot_meta(d, bucket_months=1).agg(F.count(F.lit(1)).alias("buckets"), F.min("bucket_idx").alias("first_bucket"),
                                                   F.max("bucket_idx").alias("last_bucket"))
    top = MEM.top_fraud_merchants(t.episodes(), 1).agg(F.max("merchant_id").alias("top_merchant"), F.max("failures").alias("top_failures"))
    s = G.graph_stats(d).select("customers", "merchants", "cards", F.col("purchased").alias("total_edges"),
                                F.col("fraud_edges").alias("total_fraud_edges"))
    return G.attach_row(G.attach_row(s, meta), top)

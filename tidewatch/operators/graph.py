"""Temporal graph tables: nodes, edges, history features, pattern queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X
from tidewatch.functions.frame import attach_row
from tidewatch.operators import skew
from tidewatch.session import stored

#: Rows of all sides that a task of `placed_months` gets on average.
ROWS_PER_TASK = 500_000


def with_buckets(txn: DataFrame, bucket_months: int = 12) -> DataFrame:
    m = X.month_idx("event_time").cast("long")
    return txn.withColumn("month_idx", m).withColumn("bucket_idx", F.floor(m / bucket_months))


def bucket_fractions(bucketed: DataFrame) -> DataFrame:
    """Rank of each bucket scaled to 0..1. Buckets are calendar spans, so few."""
    b = bucketed.select("bucket_idx").distinct()
    w = Window.orderBy("bucket_idx")
    ranked = b.select("bucket_idx", (F.row_number().over(w) - 1).alias("i"))
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    return attach_row(ranked, n).select("bucket_idx", (F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))).alias("month_frac"))


def entity_month(txn: DataFrame, id_col: str, partner: str) -> DataFrame:
    """Per (entity, month): rows, amount, exact distinct partners, frauds.

    Partners are made distinct by grouping, so a busy entity's month is spread
    over (entity, month, partner) before it comes together.
    """
    pair = txn.groupBy(id_col, "month_idx", partner).agg(
        F.count(F.lit(1)).alias("n"), F.sum(X.money_units("amount")).alias("a"), F.sum("is_fraud").alias("f"))
    return pair.groupBy(id_col, "month_idx").agg(
        F.sum("n").alias("n"), (F.sum("a") / F.lit(10000.0)).alias("amt"), F.count(partner).alias("extra"),
        F.sum("f").alias("fraud"))


def placed_months(txn: DataFrame, ids: list[str], partner: str, hot_rows: int = C.HOT_ROWS) -> DataFrame:
    """`entity_month` for many entities at once: rows are shuffled once, by entity, as `history` wants them placed.

    A counting pass finds entities with more than `hot_rows` rows; theirs are dealt by
    partner and month first, and only what that leaves of a month comes together.
    """
    seen = Observation()
    hot = skew.find_hot(txn.select(*ids).observe(seen, F.count(F.lit(1)).alias("n")), ids, hot_rows)
    tasks = max(txn.sparkSession.sparkContext.defaultParallelism, -(-seen.get["n"] // ROWS_PER_TASK))
    rows, share = txn.select(*ids, "month_idx", partner, X.money_units("amount").alias("a"), F.col("is_fraud").alias("f")), []
    if hot is not None:
        dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64(partner, "month_idx"), F.lit(tasks)))
        rows, share = skew.join_null_safe(rows, hot, ids).withColumn("_share", dealt), ["_share"]
    pair = rows.repartition(tasks, *ids, *share).groupBy(*ids, *share, "month_idx", partner).agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("f").alias("fraud"))
    months = pair.groupBy(*ids, *share, "month_idx").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.count(partner).alias("extra"), F.sum("fraud").alias("fraud"))
    if hot is not None:
        months = months.repartition(tasks, *ids).groupBy(*ids, "month_idx").agg(*[F.sum(c).alias(c) for c in ("n", "a", "extra", "fraud")])
    return months.select(*ids, "month_idx", "n", (F.col("a") / F.lit(10000.0)).alias("amt"), "extra", "fraud")


def entity_month_sketches(txn: DataFrame, id_col: str, partner: str, lg_k: int = 12) -> DataFrame:
    """`entity_month` with a sketch of the partners in place of their exact number: one grouping, no row per partner.

    Sketches of months add up to one of the whole past (`partners_until`), where
    monthly numbers do not, for a partner may come back. One standard error is
    about 1.04 / sqrt(2 ** lg_k), 1.6 % at 12.
    """
    return txn.groupBy(id_col, "month_idx").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(X.money_units("amount")) / F.lit(10000.0)).alias("amt"),
        F.hll_sketch_agg(partner, lg_k).alias("partners"), F.sum("is_fraud").alias("fraud"))


def partners_until(sketches: DataFrame, id_col: str) -> DataFrame:
    """Estimated distinct partners of an entity up to and with each of its months."""
    w = Window.partitionBy(id_col).orderBy("month_idx").rowsBetween(Window.unboundedPreceding, 0)  # a row a month
    return sketches.select(id_col, "month_idx", F.hll_sketch_estimate(F.hll_union_agg("partners").over(w)).alias("partners_until"))


def history(monthly: DataFrame, id_col: str, exclusive: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative month totals per entity; `exclusive` leaves out the month itself.

    At most one row per entity and calendar month enters the window.
    """
    w = Window.partitionBy(*keys, id_col).orderBy("month_idx").rowsBetween(Window.unboundedPreceding, 0)
    own = 1 if exclusive else 0
    return monthly.select(
        *keys, id_col, "month_idx",
        *[(F.sum(c).over(w) - own * F.col(c)).alias(f"hist_{c}") for c in ("n", "amt", "extra", "fraud")],
        (F.count(F.lit(1)).over(w) - own).alias("hist_months"))


def bucket_list(bucketed: DataFrame) -> DataFrame:
    """One row with the buckets that occur, in order: a short calendar list."""
    return bucketed.select("bucket_idx").distinct().agg(F.sort_array(F.collect_list("bucket_idx")).alias("_buckets"))


def serve(hist: DataFrame, ids: list[str], buckets: DataFrame, bucket_months: int, before_first: bool = False) -> DataFrame:
    """Latest history row before the first month of each bucket, per entity.

    A history row serves the buckets that begin after its month and not after
    the entity's next month, so every (entity, bucket) is produced once, by the
    row itself and without a join. `before_first` adds the buckets before an
    entity's history, with nulls.
    """
    w = Window.partitionBy(*ids).orderBy("month_idx")
    low = F.floor(F.col("month_idx") / bucket_months) + 1
    spans = attach_row(hist.withColumn("_until", F.lead("month_idx").over(w)).withColumn("_first", F.row_number().over(w) == 1), buckets)
    mine = F.filter("_buckets", lambda k: ((k >= low) | (F.col("_first") & F.lit(before_first)))
                    & (F.col("_until").isNull() | (k * bucket_months <= F.col("_until"))))
    each = spans.withColumn("bucket_idx", F.explode(mine))
    cols = ["month_idx", *[c for c in hist.columns if c.startswith("hist_")]]
    return each.select(*ids, "bucket_idx", *[F.when(F.col("bucket_idx") >= low, F.col(c)).alias(c) for c in cols])


def latest_past(hist: DataFrame, id_col: str, buckets: DataFrame, bucket_months: int = 12) -> DataFrame:
    """Latest history row before each bucket of `bucket_list`, per entity."""
    return serve(hist, [id_col], buckets, bucket_months)


def _ratio(a: str, b: str, high: float | None = None) -> Column:
    r = F.when(F.col(b) > 0, F.greatest(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))).otherwise(0.0)
    return F.least(r, F.lit(high)) if high is not None else r


def node_features(nodes: DataFrame) -> DataFrame:
    """Eight features from history columns; a node without history gets zeros."""
    d = nodes
    for c in ("n", "amt", "extra", "fraud", "months"):
        d = d.withColumn(c, F.coalesce(F.col(f"hist_{c}").cast("double"), F.lit(0.0)))
    d = d.withColumn("amt", F.greatest("amt", F.lit(0.0)))
    keep = [c for c in nodes.columns if not c.startswith("hist_") and c != "month_idx"]
    return d.select(
        *keep, F.log1p("n").alias("log_n"), F.log1p("amt").alias("log_amount"), F.log1p("extra").alias("log_extra"),
        _ratio("fraud", "n", 1.0).alias("fraud_rate"), F.log1p("fraud").alias("log_frauds"),
        F.log1p(_ratio("amt", "n")).alias("log_avg_amount"), _ratio("extra", "n", 1.0).alias("partner_density"),
        F.log1p(_ratio("amt", "months")).alias("log_velocity"))


NODE_TYPES = {"customer": ("customer_id", "merchant_id"), "merchant": ("merchant_id", "customer_id"),
              "card": ("card_id", "merchant_id")}


def snapshot_nodes(txn: DataFrame, bucket_months: int = 12, exclusive: bool = False) -> DataFrame:
    """Node features per bucket for customers, merchants and cards.

    Every known node appears in every bucket, with zeros until it has history
    before the bucket. `exclusive=True` drops the newest past month as well.
    """
    b = with_buckets(txn, bucket_months)
    buckets = bucket_list(b)
    ends = F.explode(F.array(*[F.struct(F.lit(kind).alias("node_type"), F.col(idc).alias("node_id"), F.col(partner).alias("partner"))
                               for kind, (idc, partner) in NODE_TYPES.items()])).alias("e")
    sides = b.select("month_idx", "amount", "is_fraud", ends).select("e.*", "month_idx", "amount", "is_fraud")
    hist = history(placed_months(sides, ["node_type", "node_id"], "partner"), "node_id", exclusive, ("node_type",))
    served = serve(hist, ["node_type", "node_id"], buckets, bucket_months, before_first=True)
    return node_features(served)


def edge_attributes(txn: DataFrame, bucket_months: int = 12, equality: bool = False) -> DataFrame:
    """Purchase edges with nine attributes, label and calendar month."""
    b = with_buckets(txn, bucket_months)
    e = b.join(F.broadcast(bucket_fractions(b)), "bucket_idx")
    ch = F.coalesce("payment_channel", F.lit(""))
    return e.select(
        "transaction_id", F.col("customer_id").alias("src"), F.col("merchant_id").alias("dst"),
        "bucket_idx", "month_idx",
        X.amount_log1p("amount").alias("amount_log1p"), X.hour_sin("event_time").alias("hour_sin"),
        X.hour_cos("event_time").alias("hour_cos"), X.is_night("event_time", before_hour=5).alias("is_night"),
        X.is_weekend("event_time").alias("is_weekend"),
        *[X.channel_flag(ch, w, equality).alias(f"channel_{w}") for w in ("swipe", "chip", "online")],
        "month_frac", F.col("is_fraud").alias("label"))


def edges(txn: DataFrame) -> DataFrame:
    """All edge kinds as (kind, src, dst): purchases and cards, each with its reverse."""
    bought = txn.select(F.lit("purchased").alias("kind"), F.col("customer_id").alias("src"), F.col("merchant_id").alias("dst"))
    holds = txn.select(F.lit("has_card").alias("kind"), F.col("customer_id").alias("src"), F.col("card_id").alias("dst")).distinct()
    fwd = bought.unionByName(holds)
    return fwd.unionByName(fwd.select(F.concat(F.lit("rev_"), "kind").alias("kind"),
                                      F.col("dst").alias("src"), F.col("src").alias("dst")))


def node_ids(txn: DataFrame, id_col: str, pieces: int = 256, per_piece: int = 32) -> DataFrame:
    """Natural id -> contiguous index in id order.

    The ids are cut at a bounded sample of themselves (smallest hashes, the same
    on every run), counted per piece, and numbered inside the pieces.
    """
    ids = txn.select(F.col(id_col).alias("node_id")).filter(F.col("node_id").isNotNull()).distinct()
    drawn = sorted(r[0] for r in ids.orderBy(F.md5("node_id"), "node_id").limit(pieces * per_piece).collect())
    step = max(1, len(drawn) // pieces)
    edges = F.array(*[F.lit(e) for e in drawn[step::step]]).cast("array<string>")
    ids = ids.withColumn("_p", F.size(F.filter(edges, lambda e: e <= F.col("node_id"))))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = ids.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = base.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    w = Window.partitionBy("_p").orderBy("node_id")
    return (ids.withColumn("_r", F.row_number().over(w) - 1).join(F.broadcast(base), "_p")
            .select("node_id", (F.col("_r") + F.col("_b")).alias("node_idx")))


def merchant_nodes(txn: DataFrame) -> DataFrame:
    """Merchants with their first category code and fraud rate over all rows."""
    return txn.groupBy("merchant_id").agg(
        F.min_by("merchant_category_code", F.struct("event_time", "seq", "transaction_id")).alias("mcc"),
        F.avg("is_fraud").alias("fraud_rate"))


def purchases(txn: DataFrame) -> DataFrame:
    return txn.select("transaction_id", "customer_id", "merchant_id", "amount", "event_time",
                      F.col("payment_channel").alias("channel"), "is_fraud")


def snapshot_meta(txn: DataFrame, bucket_months: int = 12) -> DataFrame:
    b = with_buckets(txn, bucket_months)
    return b.groupBy("bucket_idx").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("is_fraud").alias("n_fraud"))


def graph_stats(txn: DataFrame) -> DataFrame:
    """Counts of nodes and edges, one row.

    Customers and cards are counted among their distinct pairs, so the rows are
    grouped twice and never multiplied.
    """
    pair = stored(txn.groupBy("customer_id", "card_id").agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").alias("f")), "customer-cards")
    both = F.col("customer_id").isNotNull() & F.col("card_id").isNotNull()
    customers = pair.groupBy("customer_id").agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.count_if(both).alias("pairs"))
    one = customers.agg(F.count("customer_id").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("purchased"),
                        F.coalesce(F.sum("pairs"), F.lit(0)).alias("has_card"), F.sum("f").alias("fraud_edges"))
    for name, df in (("merchant_id", txn), ("card_id", pair)):
        one = attach_row(one, df.select(name).distinct().agg(F.count(name).alias(name[:-3] + "s")))
    return one.select("customers", "merchants", "cards", "purchased", "has_card", "fraud_edges")


def bucket_split(txn: DataFrame, cutoffs: tuple[int, int], bucket_months: int = 12) -> DataFrame:
    """Each bucket's lower-median month, its part by cutoffs and by 60/20/20 of buckets.

    Months are counted first, so the median runs over at most twelve-ish rows
    per bucket.
    """
    b = with_buckets(txn, bucket_months)
    m = b.groupBy("bucket_idx", "month_idx").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("bucket_idx")
    run = m.withColumn("cum", F.sum("n").over(w.orderBy("month_idx"))).withColumn("tot", F.sum("n").over(w))
    half = F.floor((F.col("tot") - 1) / 2) + 1
    med = run.filter(F.col("cum") >= half).groupBy("bucket_idx").agg(F.min("month_idx").alias("median_month"))
    i = F.row_number().over(Window.orderBy("bucket_idx")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    lo, hi = cutoffs
    part = lambda v, a, c: F.when(v < a, "train").when(v < c, "val").otherwise("test")
    return med.select("bucket_idx", "median_month", part(F.col("median_month"), lo, hi).alias("by_cutoff"),
                      part(i, F.floor(n * 0.6), F.floor(n * 0.8)).alias("by_count"))


def mask_nodes(nodes: DataFrame, ratio: float, epoch: int) -> DataFrame:
    """Choose max(1, floor(n * ratio)) nodes per (type, bucket), the same on every run.

    The choice is the smallest hashes. Hashes are cut by their first three hex
    digits, so no task numbers all nodes of a type.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(epoch)), F.col("bucket_idx").cast("string"), "node_type", "node_id"))
    d = nodes.withColumn("_h", h).withColumn("_s", F.substring("_h", 1, 3))
    keys = ["node_type", "bucket_idx"]
    per = d.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 rows per key
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*keys, "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"),
                      F.sum("_n").over(Window.partitionBy(*keys)).alias("_t"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("_h", "node_id"))
    k = F.greatest(F.lit(1), F.floor(F.col("_t") * ratio))
    return (d.withColumn("_r", rank).join(base, [*keys, "_s"])
            .withColumn("masked", F.col("_r") + F.col("_b") <= k).drop("_h", "_s", "_r", "_b", "_t"))


# -- pattern queries --------------------------------------------------------
# Limits are part of these reports; a total order by ids makes them repeatable.

def _pairs(txn: DataFrame) -> DataFrame:
    return txn.select("customer_id", "merchant_id", "is_fraud", "seq", "transaction_id")


def _with_merchant(pairs: DataFrame, txn: DataFrame) -> DataFrame:
    return pairs.join(merchant_nodes(txn), "merchant_id").select("customer_id", "merchant_id", "mcc", "fraud_rate")


_ORDER = ["customer_id", "merchant_id", "seq", "transaction_id"]


def overview(txn: DataFrame, limit: int = 40) -> DataFrame:
    return _with_merchant(_pairs(txn).orderBy(*_ORDER).limit(limit), txn)


def hot_merchant_pairs(txn: DataFrame, rate: float = 0.05, limit: int = 60) -> DataFrame:
    hot = merchant_nodes(txn).filter(F.col("fraud_rate") > rate)
    return _pairs(txn).join(hot, "merchant_id").orderBy(*_ORDER).limit(limit).select(
        "customer_id", "merchant_id", "mcc", "fraud_rate")


def cards_of_customers(txn: DataFrame, limit: int = 40) -> DataFrame:
    return txn.select("customer_id", "card_id").distinct().orderBy("customer_id", "card_id").limit(limit)


def fraud_edges(txn: DataFrame, limit: int = 50) -> DataFrame:
    return _with_merchant(_pairs(txn).filter(F.col("is_fraud") == 1).orderBy(*_ORDER).limit(limit), txn)


def fraud_web(txn: DataFrame, worst: int = 6, customers: int = 20, limit: int = 70) -> DataFrame:
    """Worst merchants with fraud, their customers, and those customers' other merchants.

    Every step keeps a short list, so the lists are broadcast to the edges.
    """
    nodes = merchant_nodes(txn)
    top = nodes.filter(F.col("fraud_rate") > 0).orderBy(F.desc("fraud_rate"), "merchant_id").limit(worst)
    around = _pairs(txn).join(F.broadcast(top.select("merchant_id")), "merchant_id", "left_semi")
    seeds = around.select("customer_id").distinct().orderBy("customer_id").limit(customers)
    links = (around.join(F.broadcast(seeds), "customer_id", "left_semi")
             .select("customer_id", F.col("merchant_id").alias("fraud_merchant")).distinct())
    hops = _pairs(txn).join(F.broadcast(links), "customer_id").filter(F.col("merchant_id") != F.col("fraud_merchant"))
    hops = hops.orderBy("customer_id", "fraud_merchant", "merchant_id", "seq", "transaction_id").limit(limit)
    return hops.join(nodes, "merchant_id").select("customer_id", "fraud_merchant", "merchant_id", "mcc", "fraud_rate")


def render(pairs: DataFrame, max_nodes: int = 120, max_edges: int = 200, rate: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a drawing from (customer_id, merchant_id, fraud_rate) pairs."""
    c = pairs.select(F.concat(F.lit("customer-"), "customer_id").alias("id"), F.lit("customer").alias("type"), "fraud_rate")
    m = pairs.select(F.concat(F.lit("merchant-"), "merchant_id").alias("id"), F.lit("merchant").alias("type"), "fraud_rate")
    nodes = (c.unionByName(m).groupBy("id", "type").agg((F.max("fraud_rate") > rate).alias("fraud"))
             .orderBy("id").limit(max_nodes))
    e = pairs.select(F.concat(F.lit("customer-"), "customer_id").alias("source"),
                     F.concat(F.lit("merchant-"), "merchant_id").alias("target"))
    kept = F.broadcast(nodes.select("id"))
    e = e.join(kept.withColumnRenamed("id", "source"), "source", "left_semi").join(
        kept.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, e.orderBy("source", "target").limit(max_edges)


def degrees(txn: DataFrame, id_col: str) -> DataFrame:
    return txn.groupBy(id_col).agg(F.count(F.lit(1)).alias("degree"))


def top_degree(txn: DataFrame, id_col: str, n: int) -> DataFrame:
    return degrees(txn, id_col).orderBy(F.desc("degree"), id_col).limit(n)


def sample_subgraph(txn: DataFrame, max_nodes: int = 120) -> DataFrame:
    """A connected drawing: busiest customers, their most shared merchants, the
    customers around those, further merchants, and the customers' cards.

    Rows (node_type, node_id). Caps are thirds and a sixth of `max_nodes`
    (at least 24), so each intermediate list is short.
    """
    seed_n = max(4, min(10, max_nodes // 12))
    cust_cap, merch_cap, card_cap = max(8, max_nodes // 3), max(8, max_nodes // 3), max(6, max_nodes // 6)
    p = txn.select("customer_id", "merchant_id")
    deg = degrees(txn, "merchant_id")
    seeds = top_degree(txn, "customer_id", seed_n).select("customer_id")
    first = p.join(F.broadcast(seeds), "customer_id", "left_semi").select("merchant_id").distinct()
    by_degree = [F.desc("degree"), F.col("merchant_id")]
    merch = deg.join(first, "merchant_id", "left_semi")  # as many as the heaviest customers have.orderBy(*by_degree).limit(merch_cap)
    merch = merch.withColumn("rank", F.row_number().over(Window.orderBy(*by_degree)))
    around = (p.join(F.broadcast(merch), "merchant_id").join(F.broadcast(seeds), "customer_id", "left_anti")
              .groupBy("customer_id").agg(F.min("rank").alias("rank")))
    more = around.orderBy("rank", "customer_id").limit(cust_cap - seed_n).select("customer_id")
    cust = seeds.unionByName(more)
    reach = p.join(F.broadcast(cust), "customer_id", "left_semi").select("merchant_id").distinct()
    extra = deg.join(reach, "merchant_id", "left_semi").join(F.broadcast(merch.select("merchant_id")), "merchant_id", "left_anti")
    extra = extra.orderBy(*by_degree).limit(merch_cap)
    all_merch = (merch.select("merchant_id", "degree", F.lit(0).alias("step"))
                 .unionByName(extra.select("merchant_id", "degree", F.lit(1).alias("step")))
                 .orderBy("step", F.desc("degree"), "merchant_id").limit(merch_cap))
    card = (txn.select("customer_id", "card_id").distinct().join(F.broadcast(cust), "customer_id", "left_semi")
            .orderBy("customer_id", "card_id").limit(card_cap))
    return (cust.select(F.lit("customer").alias("node_type"), F.col("customer_id").alias("node_id"))
            .unionByName(all_merch.select(F.lit("merchant").alias("node_type"), F.col("merchant_id").alias("node_id")))
            .unionByName(card.select(F.lit("card").alias("node_type"), F.col("card_id").alias("node_id"))))


def kept_edges(txn: DataFrame, nodes: DataFrame) -> DataFrame:
    """Purchase and card edges whose two ends are among the kept nodes (a short list)."""
    def ids(kind, col):
        return F.broadcast(nodes.filter(F.col("node_type") == kind).select(F.col("node_id").alias(col)))

    bought = (txn.select("customer_id", "merchant_id").join(ids("customer", "customer_id"), "customer_id", "left_semi")
              .join(ids("merchant", "merchant_id"), "merchant_id", "left_semi")
              .select(F.lit("purchased").alias("kind"), F.col("customer_id").alias("src"), F.col("merchant_id").alias("dst")))
    holds = (txn.select("customer_id", "card_id").distinct().join(ids("customer", "customer_id"), "customer_id", "left_semi")
             .join(ids("card", "card_id"), "card_id", "left_semi")
             .select(F.lit("has_card").alias("kind"), F.col("customer_id").alias("src"), F.col("card_id").alias("dst")))
    return bought.unionByName(holds)


def masked_targets(nodes: DataFrame, features: list[str], ratio: float, epoch: int, hidden: float = -1.0) -> DataFrame:
    """Long form: what a model sees per feature, and the value to reconstruct where masked."""
    m = mask_nodes(nodes, ratio, epoch)
    long = m.select("node_type", "node_id", "bucket_idx", "masked", *features).unpivot(
        ["node_type", "node_id", "bucket_idx", "masked"], features, "feature", "value")
    return long.select("node_type", "node_id", "bucket_idx", "feature",
                       F.when(F.col("masked"), F.lit(hidden)).otherwise(F.col("value")).alias("shown"),
                       F.when(F.col("masked"), F.col("value")).alias("target"))

"""The expression functions of the data path, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X
from tidewatch.operators import learned as L, positions as P, velocity as V
from tidewatch.plans.registry import query
from tidewatch.plans.sqltext import sql

ID = "transaction_id"


def simple(name: str, text: str, build, base: str = "txn"):
    """Register a projection over transactions: SQL select list and columns."""
    def run(t):
        frame = {"txn": t.txn, "lines": t.lines, "dec": t.decisions, "epi": t.episodes}[base]()
        return frame.select(ID, *build())
    query(name, sql(f"SELECT transaction_id, {text} FROM {base}", base))(run)


simple("fn_str_trim_lower", "lower(trim('  ' || payment_channel || ' ')) AS v",
       lambda: [F.lower(F.trim(F.concat(F.lit("  "), "payment_channel", F.lit(" ")))).alias("v")])
simple("fn_str_map", "CASE payment_channel WHEN 'Swipe Transaction' THEN 1 WHEN 'Chip Transaction' THEN 2 END AS v",
       lambda: [F.try_element_at(F.create_map(F.lit("Swipe Transaction"), F.lit(1), F.lit("Chip Transaction"), F.lit(2)), F.col("payment_channel")).alias("v")])
simple("fn_str_zfill", "lpad(CAST(seq % 13 AS VARCHAR), 2, '0') AS v", lambda: [F.lpad((F.col("seq") % 13).cast("string"), 2, "0").alias("v")])
simple("fn_str_concat", "customer_id || '-' || device_id AS v", lambda: [F.concat("customer_id", F.lit("-"), "device_id").alias("v")])
simple("fn_str_regex_replace", "regexp_replace(card_id, '[^0-9]', '', 'g') AS v", lambda: [F.regexp_replace("card_id", "[^0-9]", "").alias("v")])
simple("fn_str_contains", "contains(lower(payment_channel), 'chip') AS v", lambda: [F.lower("payment_channel").contains("chip").alias("v")])
simple("fn_str_format", "printf('%s paid %.2f at %02d:00', customer_id, amount, hour(event_time)) AS v",
       lambda: [F.format_string("%s paid %.2f at %02d:00", "customer_id", "amount", F.hour("event_time")).alias("v")])
simple("fn_str_md5_sha", "substr(md5(card_id), 1, 16) AS m, sha256(card_id) AS s",
       lambda: [F.substring(F.md5("card_id"), 1, 16).alias("m"), F.sha2("card_id", 256).alias("s")])
simple("fn_date_parse", "epoch_us(date_trunc('minute', event_time)) AS strict_us, CASE WHEN seq % 4 <> 0 THEN epoch_us(date_trunc('second', event_time)) END AS lenient_us",
       lambda: [X.micros(F.to_timestamp(F.date_format("event_time", "yyyy-MM-dd-HH:mm"), "yyyy-MM-dd-HH:mm")).alias("strict_us"),
                X.micros(F.try_to_timestamp(F.when(F.col("seq") % 4 != 0, F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon"))).alias("lenient_us")])
simple("fn_date_parts", "hour(event_time) AS h, isodow(event_time) - 1 AS d, year(event_time) AS y, month(event_time) AS m",
       lambda: [F.hour("event_time").cast("long").alias("h"), F.weekday("event_time").cast("long").alias("d"), F.year("event_time").cast("long").alias("y"), F.month("event_time").cast("long").alias("m")])
simple("fn_date_epoch", "us, us / 1e6 AS seconds", lambda: [X.micros("event_time").alias("us"), (X.micros("event_time") / F.lit(1e6)).alias("seconds")])
simple("fn_date_diff", "(us - epoch_us(date_trunc('day', event_time))) / 1e6 AS seconds",
       lambda: [((X.micros("event_time") - X.micros(F.date_trunc("day", "event_time"))) / F.lit(1e6)).alias("seconds")])
simple("fn_date_format", "strftime(event_time, '%Y-%m') AS v", lambda: [F.date_format("event_time", "yyyy-MM").alias("v")])
simple("fn_math_log_trig", "round(ln(1 + amount), 6) AS a, round(sin(amount), 6) AS b, round(cos(amount), 6) AS c, round(exp(-amount / 100), 6) AS d, round(ln(amount), 6) AS e",
       lambda: [F.round(F.log1p("amount"), 6).alias("a"), F.round(F.sin("amount"), 6).alias("b"), F.round(F.cos("amount"), 6).alias("c"), F.round(F.exp(-F.col("amount") / 100), 6).alias("d"), F.round(X.ln("amount"), 6).alias("e")])
simple("fn_math_clip", "CASE WHEN seq % 9 = 0 THEN NULL ELSE least(greatest(amount, 5.0), 30.0) END AS v",
       lambda: [X.clip(F.when(F.col("seq") % 9 != 0, F.col("amount")), 5.0, 30.0).alias("v")])
simple("fn_math_minmax_h", "least(amount, 25.0) AS lo, greatest(amount, 25.0) AS hi", lambda: [F.least("amount", F.lit(25.0)).alias("lo"), F.greatest("amount", F.lit(25.0)).alias("hi")])
simple("fn_math_floordiv", "seq // 12 AS v", lambda: [F.floor(F.col("seq") / 12).alias("v")])
simple("fn_math_round", "CAST(round_even(CAST(seq AS DECIMAL(18,3)) / 8, 2) AS DOUBLE) AS half_even, round(CAST(seq AS DOUBLE) / 4, 1) AS half_up",
       lambda: [X.half_even(F.col("seq").cast("decimal(18,3)") / F.lit(8).cast("decimal(2,0)"), 2).cast("double").alias("half_even"), F.round(F.col("seq").cast("double") / 4, 1).alias("half_up")])
simple("fn_null_fill", "coalesce(device_id, 'none') AS a, CASE WHEN seq % 6 = 0 THEN 0.0 ELSE amount END::DOUBLE AS b, device_id IS NOT NULL AS c",
       lambda: [F.coalesce("device_id", F.lit("none")).alias("a"), F.nanvl(F.when(F.col("seq") % 6 == 0, float("nan")).otherwise(F.col("amount")), F.lit(0.0)).alias("b"), F.col("device_id").isNotNull().alias("c")])
simple("fn_cond", "CASE WHEN amount > 50 THEN 'high' WHEN amount > 10 THEN 'mid' ELSE 'low' END AS v", lambda: [F.when(F.col("amount") > 50, "high").when(F.col("amount") > 10, "mid").otherwise("low").alias("v")])
simple("fn_cast", "CAST(customer_id AS BIGINT) AS a, TRY_CAST(merchant_id AS BIGINT) AS b, CAST(seq AS VARCHAR) AS c",
       lambda: [F.col("customer_id").cast("long").alias("a"), F.col("merchant_id").try_cast("long").alias("b"), F.col("seq").cast("string").alias("c")])
simple("fn_struct_field", "merchant_id AS v", lambda: [F.col("event")["merchant_id"].alias("v")], "epi")
simple("fn_array_topk", "array_to_string(list_reverse_sort([seq % 7, seq % 11, seq % 13, seq % 17])[1:2], ',') AS v",
       lambda: [F.array_join(F.slice(F.sort_array(F.array(*[F.col("seq") % k for k in (7, 11, 13, 17)]), asc=False), 1, 2).cast("array<string>"), ",").alias("v")])
simple("fn_array_dedupe", "CASE WHEN seq % 2 = 0 THEN 'a,b' ELSE 'b,a' END AS v",
       lambda: [F.array_join(F.array_distinct(F.when(F.col("seq") % 2 == 0, F.array(*[F.lit(x) for x in "abab"])).otherwise(F.array(*[F.lit(x) for x in "baab"]))), ",").alias("v")])
simple("fn_map_filter", "CASE WHEN device_id IS NULL THEN 1 ELSE 2 END AS v",
       lambda: [F.size(F.map_filter(F.create_map(F.lit("d"), "device_id", F.lit("c"), "customer_id"), lambda _, v: v.isNotNull())).alias("v")])
simple("fn_json_parse_emit", "'{\"amount\":\"' || printf('%.2f', amount) || '\",\"id\":\"' || transaction_id || '\"}' AS emitted, merchant_id AS parsed",
       lambda: [X.canonical_json(id=ID, amount=F.format_string("%.2f", F.col("amount"))).alias("emitted"),
                F.from_json(F.to_json(F.struct(F.struct("merchant_id").alias("event"))), "event struct<merchant_id:string>")["event"]["merchant_id"].alias("parsed")])


@query("fn_agg_basic", sql(
    "SELECT customer_id, count(*) AS n, round(sum(amount), 4) AS s, CAST(sum(CAST(round(amount * 10000) AS BIGINT)) AS BIGINT) / 10000.0::DOUBLE / count(*) AS m, min(amount) AS lo, max(amount) AS hi, count(DISTINCT merchant_id) AS u, "
    "min_by(transaction_id, seq) AS first, max_by(transaction_id, seq) AS last FROM txn GROUP BY 1", "txn"))
def _(t):
    return t.txn().groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("s"), (F.sum(X.money_units("amount")) / F.lit(10000.0) / F.count(F.lit(1))).alias("m"),
        F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.count_distinct("merchant_id").alias("u"),
        F.min_by(ID, "seq").alias("first"), F.max_by(ID, "seq").alias("last"))


@query("fn_window_basic", sql(
    "SELECT transaction_id, count(*) OVER w AS cum_n, CAST(sum(seq) OVER w AS BIGINT) AS cum_s, lag(seq) OVER w AS before, lead(seq) OVER w AS after, row_number() OVER w AS pos, "
    "count(*) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS rolling FROM txn WINDOW w AS (PARTITION BY customer_id ORDER BY us, seq)", "txn"))
def _(t):
    """Running and neighbour values, and a closed rolling count, with hot customers in slices."""
    d = t.txn()
    run = P.running(d, "customer_id", "seq")
    cust = C.Entity("cust", "customer_id", tuple(w for w in C.CATALOGUE[0].windows if w.label == "24h"), ())
    day = V.velocity_features(d, (cust,)).select(ID, "cust_v_24h_count")
    tie = P.tie_ranks(d, "customer_id").select(ID, (F.col("tie_size") - F.col("tie_rank")).alias("left"))
    # what lies before the row in its window, the row itself and the later rows of its instant
    rolling = (F.col("cust_v_24h_count") + F.col("left")).cast("long")
    return run.join(day, ID).join(tie, ID).select(ID, F.col("pos").alias("cum_n"), F.col("cum_sum").alias("cum_s"), "before", "after", "pos", rolling.alias("rolling"))


@query("udf_scorer", sql("SELECT transaction_id, round(1.0 / (1.0 + exp(-(0.8 * ln(1 + amount) + 0.5 * is_fraud - 3.0))), 6) AS p FROM txn", "txn"))
def _(t):
    """Any batch scorer plugged in as an Arrow function over feature columns."""
    import numpy as np

    def logistic(x):
        return 1.0 / (1.0 + np.exp(-(0.8 * x[:, 0] + 0.5 * x[:, 1] - 3.0)))

    score = L.scorer(lambda: logistic)
    return t.txn().select(ID, F.round(score(X.amount_log1p("amount"), F.col("is_fraud").cast("double")), 6).alias("p"))


@query("udaf_series_fold", sql(
    "SELECT customer_id, round(e, 6) AS last_ewma FROM ew QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY i DESC) = 1", "txn", recursive=True,
    extra="""dy AS (SELECT customer_id, strftime(event_time, '%Y-%m-%d') AS day, avg(amount) AS x, row_number() OVER (PARTITION BY customer_id ORDER BY strftime(event_time, '%Y-%m-%d')) AS i FROM txn GROUP BY 1, 2),
ew AS (SELECT customer_id, i, x AS e FROM dy WHERE i = 1 UNION ALL SELECT d.customer_id, d.i, 0.5 * d.x + 0.5 * ew.e FROM ew JOIN dy d ON d.customer_id = ew.customer_id AND d.i = ew.i + 1)"""))
def _(t):
    """A fold per key over its daily means."""
    from tidewatch.operators import drift as D
    daily = t.txn().groupBy("customer_id", F.date_format("event_time", "yyyy-MM-dd").alias("day")).agg(F.avg("amount").alias("x"))
    s = D.ordered_series(daily, "day", "x", ["customer_id"])
    return s.select("customer_id", F.round(F.element_at(D.ewma(F.col("s"), 3.0), -1), 6).alias("last_ewma"))


@query("udtf_expand_windows", sql(
    "SELECT entity, win, count(*) AS n, count(DISTINCT id) AS ids FROM (" + " UNION ALL ".join(
        f"SELECT '{e}' AS entity, {c} AS id, '{w}' AS win FROM txn WHERE {c} IS NOT NULL" for e, c, ws in (
            ("cust", "customer_id", ("1h", "24h", "7d")), ("card", "card_id", ("1h", "24h", "7d")), ("merch", "merchant_id", ("24h", "7d")), ("device", "device_id", ("24h", "7d"))) for w in ws)
    + ") GROUP BY 1, 2", "txn"))
def _(t):
    rows = F.explode(F.array(*[F.struct(F.lit(e.name).alias("entity"), F.col(e.id_col).alias("id"), F.lit(w.label).alias("win"))
                               for e in C.CATALOGUE for w in e.windows]))
    x = t.txn().select(rows.alias("r")).select("r.*").filter(F.col("id").isNotNull())
    return x.groupBy("entity", "win").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))

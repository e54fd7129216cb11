"""Metrics, drift, graph, memory, audit, joins on small frames with known answers."""

import datetime as dt
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import config as C
from tidewatch.functions import contract, expr as X, reasons
from tidewatch.operators import asof, audit, drift as D, graph as G, impact as IM, memory as MEM, metrics as M, models as MD, ranking as R
from tidewatch.operators.sequences import sequence_tail
from tidewatch.sources import files, webhook


# -- global order -----------------------------------------------------------

@pytest.mark.parametrize("slices", [2, 7, 32])
def test_quantiles_equal_numpy(spark, slices):
    rnd = np.random.default_rng(0)
    v = np.round(rnd.exponential(size=3000), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.9, 0.9995, 1.0]
    q = R.quantiles(df, "v", probs, slices=slices).first()["q"]
    assert q == pytest.approx(list(np.quantile(v, probs)), abs=1e-9)


def test_numbered_is_contiguous_when_one_value_dominates(spark):
    df = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(600)], "at long, seq long")
    rows = R.numbered(df, "at", ["seq"], slices=8).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(600))
    assert [(r["at"], r["seq"]) for r in rows] == sorted((r["at"], r["seq"]) for r in rows)


def scored(spark, n=2000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = 1 if rnd.random() < 0.1 else 0
        rows.append((f"t{i}", float(round(min(max(rnd.gauss(0.3 + 0.3 * y, 0.2), 0.0), 1.0), 2)), y))
    return rows, spark.createDataFrame(rows, "transaction_id string, score double, is_fraud int").repartition(6)


def test_auc_and_ap_with_ties(spark):
    rows, df = scored(spark)
    pos, neg = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert M.roc_auc(df).first()["roc_auc"] == pytest.approx(auc, abs=1e-12)
    ap, last = 0.0, 0
    for s in sorted({r[1] for r in rows}, reverse=True):
        flagged = [r for r in rows if r[1] >= s]
        tp = sum(r[2] for r in flagged)
        ap += (tp - last) / len(pos) * tp / len(flagged)
        last = tp
    assert M.average_precision(df).first()[0] == pytest.approx(ap, abs=1e-12)


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, is_fraud int")
    assert M.roc_auc(df).first()["roc_auc"] is None


def test_threshold_policy_bands(spark):
    rows, df = scored(spark)
    hold, review, fallback = M.fit_thresholds(df, 0.8, 0.3, min_index=1)
    assert review <= hold and not fallback
    flagged = [r for r in rows if r[1] >= hold]
    p = M.threshold_policy(df, 0.999, 0.99, min_index=10 ** 6).first()
    q = np.quantile([r[1] for r in rows], [1 - 0.0005, 1 - 0.0105])
    assert flagged and p["fallback_used"]
    assert p["hold"] == pytest.approx(q[0])
    assert p["review"] == pytest.approx(q[0] * 0.9 if q[1] > q[0] else q[1])


def test_top_capture_and_confusion(spark):
    rows, df = scored(spark, 300)
    best = sorted(rows, key=lambda r: (-r[1], r[0]))[:100]
    got = {r["k"]: r["hits"] for r in M.top_capture(df, (100, 250, 1000)).collect()}
    assert got[100] == sum(r[2] for r in best) and 1000 not in got
    c = M.confusion(df, 0.5).first()
    assert c["tp"] == sum(1 for r in rows if r[1] >= 0.5 and r[2])
    assert c["tp"] + c["fp"] + c["fn"] + c["tn"] == 300


# -- drift ------------------------------------------------------------------

def test_psi_equals_numpy(spark):
    rnd = np.random.default_rng(2)
    a, b = np.round(rnd.normal(size=4000), 2), np.round(rnd.normal(0.3, 1.2, size=3000), 2)
    e = np.quantile(a, np.linspace(0, 1, 11))
    e[0], e[-1] = -np.inf, np.inf
    r, o = np.clip(np.histogram(a, e)[0] / 4000, 1e-6, None), np.clip(np.histogram(b, e)[0] / 3000, 1e-6, None)
    ref = spark.createDataFrame([(float(x),) for x in a], "v double")
    obs = spark.createDataFrame([(float(x),) for x in b], "v double")
    edges = D.bin_edges(ref, "v")
    got = D.psi(D.histogram(ref, "v", edges, []), D.histogram(obs, "v", edges, []), []).first()["psi"]
    assert got == pytest.approx(float(np.sum((o - r) * np.log(o / r))), abs=1e-9)


def drift_frames(spark, shift):
    rnd = np.random.default_rng(5)
    cols = ["amount_log1p", "hour_sin", "merch_fraud_rate_prior"]
    a = rnd.normal(size=(2000, 3))
    b = a.copy()
    b[:, 0] += shift
    mk = lambda m: spark.createDataFrame([tuple(map(float, r)) for r in m], ", ".join(f"{c} double" for c in cols))
    return D.feature_drift(mk(a), mk(b), cols)


def test_feature_drift_trigger(spark):
    same = drift_frames(spark, 0.0)
    assert max(r["psi"] for r in same.collect()) < 1e-3
    assert D.retrain_trigger(same).first()["trigger"] == "NO"
    moved = D.retrain_trigger(drift_frames(spark, 3.0)).first()
    assert moved["trigger"] == "YES" and moved["culprits"] == ["amount_log1p"]


def test_monitor_report_finds_the_month(spark):
    rnd = random.Random(4)
    rows = []
    for m in range(1, 9):
        level = 0.1 if m < 6 else 0.6
        for i in range(400):
            rows.append((dt.datetime(2020, m, 1 + i % 28), min(max(rnd.gauss(level, 0.02), 0.001), 0.999), int(i % 50 == 0),
                         "train" if m <= 4 else "val"))
    df = spark.createDataFrame(rows, "event_time timestamp, score double, is_fraud int, split string")
    report = D.monitor_report(df)
    assert [r["month"] for r in report.orderBy("month").collect()] == ["2020-05", "2020-06", "2020-07", "2020-08"]
    alerts = D.first_alerts(report).first()
    assert alerts["cusum_first_alert_month"] in ("2020-05", "2020-06") and alerts["psi_first_alert_month"] == "2020-06"
    with pytest.raises(ValueError, match="reference tail"):
        D.monitor_report(df, reference_months=9)


def series(spark, xs):
    return D.ordered_series(spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double"), "i", "x")


def test_page_hinkley_fires_only_on_a_jump(spark):
    for xs, fires in (([0.5] * 12, False), ([0.5] * 8 + [0.9] * 6, True)):
        s = series(spark, xs)
        c = D.calibrate_detector(F.col("s"))
        flags = s.select(D.page_hinkley(F.col("s"), c["baseline"], c["delta"], c["lamb"]).alias("f")).first()["f"]
        assert any(flags) == fires


def test_adwin_equals_a_plain_loop(spark):
    rnd = random.Random(9)
    xs = [rnd.gauss(0, 0.3) for _ in range(90)] + [rnd.gauss(6, 0.3) for _ in range(90)]
    buf, want = [], []
    for x in xs:
        buf = (buf + [x])[-128:]
        cut = next((c for c in range(3, len(buf)) if abs(np.mean(buf[:c]) - np.mean(buf[c:])) >
                    np.sqrt(2 * np.log(2 / 0.01) * (1 / c + 1 / (len(buf) - c)))), None)
        want.append(cut is not None)
        buf = buf[cut:] if cut else buf
    got = D.adwin(series(spark, xs).withColumn("k", F.lit(1)), ["k"]).orderBy("i").collect()
    assert [r["fired"] for r in got] == want and any(want)


def test_auto_switch_picks_the_best_candidate(spark):
    models = spark.createDataFrame(
        [("serving", 0.89, 0.60), ("robust", 0.82, 0.76), ("validated", 0.80, None), ("weak", 0.9, 0.5)], "name string, val_roc double, test_roc double")
    ranked = MD.rank_candidates(models, "serving")
    assert [r["name"] for r in ranked.orderBy("rank").collect()] == ["validated", "robust"]
    points = spark.createDataFrame([(i, 0.5 if i < 8 else 0.9) for i in range(14)], "i int, x double")
    d = D.auto_switch(points, "i", "x", ranked, "serving").first()
    assert d["triggered"] and d["to_model"] == "validated" and d["from_model"] == "serving"
    flat = D.auto_switch(points.withColumn("x", F.lit(0.5)), "i", "x", ranked, "serving").first()
    assert not flat["triggered"] and flat["to_model"] is None


# -- memory, audit ----------------------------------------------------------

def episodes(spark, rows):
    data = [(f"t{i}", "v", a, 0.5, o, None, {"merchant_id": m, "amount": "10.0"}, [], f"2024-01-0{1 + i % 9}T00:00:00Z", "feedback")
            for i, (a, o, m) in enumerate(rows)]
    from tidewatch.schemas import EPISODE_SCHEMA
    return spark.createDataFrame(data, EPISODE_SCHEMA).withColumn("fail_type", X.fail_type("action", "outcome"))


def test_failure_taxonomy_and_rollup(spark):
    e = episodes(spark, [("allow", "fraud", "m1"), ("hold", "legit", "m1"), ("allow", "legit", "m1"), ("review", "fraud", "m2")])
    s = MEM.memory_stats(e).first()
    assert (s["episodes"], s["failures"], s["missed_fraud"], s["false_hold"], s["miss_rate"]) == (4, 2, 1, 1, 0.25)
    r = {x["merchant_id"]: x for x in MEM.failure_rollup(e).collect()}
    assert r["m1"]["txns"] == 3 and r["m1"]["failures"] == 2 and r["m2"]["first_failure_at"] is None
    assert [x["merchant_id"] for x in MEM.hot_merchants(MEM.failure_rollup(e)).collect()] == ["m1"]


def test_heal_actions_and_recovery(spark):
    one = lambda v, c: spark.createDataFrame([(v,)], c)
    bad = episodes(spark, [("allow", "fraud", "m1"), ("allow", "fraud", "m1"), ("allow", "legit", "m2")])
    acts = [r["kind"] for r in MEM.heal_actions(MEM.memory_stats(bad), one(1, "hot int"), one("NO", "drift_trigger string"), 0.002).collect()]
    assert acts == ["hot_list", "tighten", "override", "retrain"]
    good = episodes(spark, [("allow", "legit", "m1")] * 40)
    acts = [r["kind"] for r in MEM.heal_actions(MEM.memory_stats(good), one(0, "hot int"), one("NO", "drift_trigger string"), 0.002, True).collect()]
    assert acts == ["clear_override"]


def test_q_value_in_blocks(spark):
    o = spark.createDataFrame([("s", 1, True), ("s", 2, True), ("s", 3, False)], "signature string, seq long, success boolean")
    for blocks in (1, 2, 1000):
        g = MEM.genes(o, blocks=blocks).first()
        assert (g["success_count"], g["failure_count"]) == (2, 1) and g["q_value"] == pytest.approx(0.121)


def test_append_only_new_requests(spark):
    old = spark.createDataFrame([("2024-01-01", "drift")], "day string, reason string")
    new = spark.createDataFrame([("2024-01-01", "drift"), ("2024-01-01", "miss"), ("2024-01-01", "miss")], "day string, reason string")
    assert [tuple(r) for r in files.append_new(old, new, ["day", "reason"]).collect()] == [("2024-01-01", "miss")]


def test_ledger_detects_tamper_and_deletion(spark):
    rec = spark.createDataFrame([(i, f"id{i}", "scored", json.dumps({"a": i}, separators=(",", ":")), 1000.0 + i) for i in range(5)],
                                "seq long, id string, event_type string, payload string, audited_at double")
    led = audit.chain(rec)
    rows = led.orderBy("seq").collect()
    assert rows[0]["prev_hash"] == C.GENESIS and rows[1]["prev_hash"] == rows[0]["hash"]
    import hashlib
    body = json.dumps({"id": "id0", "event_type": "scored", "payload": {"a": 0}}, sort_keys=True, separators=(",", ":"))
    assert rows[0]["hash"] == hashlib.sha256(body.encode()).hexdigest()
    ok = audit.verify(led).first()
    assert ok["valid"] and ok["records"] == 5
    bad = led.withColumn("payload", F.when(F.col("seq") == 1, F.lit('{"a":9}')).otherwise(F.col("payload")))
    assert audit.verify(bad).first()["first_broken_index"] == 1
    assert not audit.verify(led.filter("seq <> 2")).first()["valid"]


def test_ledger_links_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(audit, "LINK_SLICE", 3)
    rec = spark.createDataFrame([(i * 2, f"id{i}", "e", "{}", 0.0) for i in range(20)],
                                "seq long, id string, event_type string, payload string, audited_at double")
    rows = audit.chain(rec).orderBy("seq").collect()
    assert [r["prev_hash"] for r in rows] == [C.GENESIS, *[r["hash"] for r in rows[:-1]]]


# -- joins, graph, sequences ------------------------------------------------

def test_asof_with_and_without_slices(spark):
    rnd = random.Random(6)
    left = [(f"l{i}", rnd.choice("ab"), rnd.randint(0, 200)) for i in range(120)]
    right = [(rnd.choice("ab"), rnd.randint(0, 200), float(i)) for i in range(40)]
    ldf = spark.createDataFrame(left, "id string, k string, at long")
    rdf = spark.createDataFrame(right, "k string, at long, v double")
    for hot_rows in (10 ** 9, 5):
        got = {r["id"]: (r["at_matched"], r["v_matched"]) for r in asof.asof_backward(ldf, rdf, "k", "at", ["v"], hot_rows).collect()}
        for i, k, at in left:
            best = max(((a, v) for kk, a, v in right if kk == k and a <= at), default=(None, None))
            assert got[i] == best


def test_bucket_split_by_count(spark):
    rows = [(f"{m}-{i}", dt.datetime(1990 + m, 5, 1)) for m in range(30) for i in range(3)]
    df = spark.createDataFrame(rows, "transaction_id string, event_time timestamp")
    s = [r["by_count"] for r in G.bucket_split(df, (308, 314)).orderBy("bucket_idx").collect()]
    assert s == ["train"] * 18 + ["val"] * 6 + ["test"] * 6


def test_masks_repeat_and_count(spark):
    nodes = spark.createDataFrame([("c", f"n{i}", b) for i in range(100) for b in (1, 2)], "node_type string, node_id string, bucket_idx long")
    a = G.mask_nodes(nodes, 0.15, 1).filter("masked")
    assert {r["bucket_idx"]: r["count"] for r in a.groupBy("bucket_idx").count().collect()} == {1: 15, 2: 15}
    assert a.exceptAll(G.mask_nodes(nodes.repartition(9), 0.15, 1).filter("masked")).count() == 0


def test_node_features_use_only_the_past(spark):
    rows = [(i, f"t{i}", dt.datetime(2020 + i // 2, 6, 1), "c1", "k1", "m1", 10.0, i % 2) for i in range(4)]
    df = spark.createDataFrame(rows, "seq long, transaction_id string, event_time timestamp, customer_id string, card_id string, merchant_id string, amount double, is_fraud int")
    n = {r["bucket_idx"]: r for r in G.snapshot_nodes(df).filter("node_type = 'customer'").collect()}
    first, second = sorted(n)
    assert n[first]["log_n"] == 0.0 and n[second]["log_n"] == pytest.approx(np.log1p(2)) and n[second]["fraud_rate"] == 0.5


def test_sequences_keep_the_tail(spark):
    rows = [(i, f"t{i}", dt.datetime(2024, 1, 1 + i), "c1" if i < 5 else "c2", "5411", float(i + 1), "Chip Transaction", None, 0) for i in range(7)]
    df = spark.createDataFrame(rows, "seq long, transaction_id string, event_time timestamp, customer_id string, merchant_category_code string, amount double, payment_channel string, payment_error string, is_fraud int")
    s = {r["customer_id"]: r for r in sequence_tail(df, 4).collect()}
    assert s["c1"]["transaction_ids"] == ["t1", "t2", "t3", "t4"] and s["c1"]["amount_log1p"][-1] == pytest.approx(np.log1p(5))
    assert s["c2"]["pad_mask"] == [True, True, False, False] and s["c2"]["label"] == [-100, -100, 0, 0]
    assert s["c1"]["prev_amount_ratio"][0] == 1.0 and s["c1"]["prev_amount_ratio"][1] == pytest.approx(1.5)


# -- expressions ------------------------------------------------------------

def test_pnl_matrix(spark):
    df = spark.createDataFrame([("a", "hold", "fraud", 25000.0), ("b", "allow", "fraud", 19000.0), ("c", "hold", "legit", 500.0),
                                ("d", "allow", "legit", 100.0), ("e", "review", "pending", 1.0)], "transaction_id string, action string, outcome string, amount_inr double")
    r = IM.pnl(df).first()
    assert (r["fraud_prevented_value"], r["missed_fraud_value"], r["false_positive_cost"], r["net_protected_value"]) == (25000.0, 19000.0, 500.0, 24500.0)
    assert r["n_normal"] == 1 and r["n_review_friction"] == 0 and r["n"] == 5


def test_parity_gate_stops_a_divergent_stream(spark):
    one = lambda names, vals: spark.createDataFrame([vals], ", ".join(f"{n} double" for n in names))
    counts = one(["n_allow", "n_review", "n_hold"], (5.0, 1.0, 1.0))
    rec = one(["rec_roc_auc", "rec_allow", "rec_review", "rec_hold"], (0.8, 5.0, 1.0, 1.0))
    assert IM.require_parity(IM.decision_parity(one(["roc_auc"], (0.8004,)), counts, rec)).count() == 1
    with pytest.raises(Exception, match="differs from the recorded"):
        IM.require_parity(IM.decision_parity(one(["roc_auc"], (0.81,)), counts, rec)).collect()


def test_webhook_mapping(spark):
    body = {"payment_id": "p1", "merchant_id": "m", "customer": {"id": "c"}, "method": "upi", "amount": 125000, "timestamp": "2024-01-01T00:00:00Z",
            "chargeback": True, "3ds_status": "ok"}
    rows = [body, {**body, "method": "card", "card_present": True}, {**body, "method": "card", "card_present": False}, {**body, "amount": 0}]
    out = webhook.to_event(webhook.parse(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))).collect()
    assert str(out[0]["amount"]) == "14.97" and [r["payment_channel"] for r in out[:3]] == ["upi", "chip", "online"]
    assert out[3]["amount"] is None and out[0]["customer_id"] == "c" and out[0]["card_id"] == "NOCARD-0000"
    assert set(out[0]["context"]) == {"method", "3ds_status", "chargeback"}


def test_contract_rules(spark):
    df = spark.createDataFrame([(" t ", "c", "k", "m", 10.5, "usd"), ("", "c", "k", "m", 0.0, "euro"), ("t", None, "k", "m", 1.234, None)],
                               "transaction_id string, customer_id string, card_id string, merchant_id string, amount double, currency string")
    good, bad = contract.split_quarantine(df)
    assert [(r["transaction_id"], r["currency"]) for r in good.collect()] == [("t", "USD")]
    got = sorted(tuple(r["violations"]) for r in bad.collect())
    assert got == [("customer_id_length", "amount_decimals"), ("transaction_id_length", "currency_length", "amount_not_positive")]


def test_reasons_and_cold_start(spark):
    df = spark.createDataFrame([(8.4, 6.0, 1.0), (1.0, 0.0, 0.0)], "cust_prev_amount_ratio double, amount_log1p double, is_night double")
    r = [x[0] for x in df.select(reasons.human_reasons(df.columns)).collect()]
    assert r[0][0].startswith("This transaction amount is 8.4x") and len(r[0]) == 3 and r[1] == [reasons.ROUTINE]
    score, action, why = reasons.cold_risk(df.columns)
    rows = df.select(score, action, why).collect()
    assert rows[0][0] == 0.7 and rows[0][1] == "hold" and rows[1][1] == "allow" and rows[1][2] == [reasons.COLD_FALLBACK]
    cold = spark.createDataFrame([(5, 5, None), (5, 5, 5), (4, 9, 9)], "a int, b int, c int").select(reasons.cold_flag("a", "b", "c"))
    assert [x[0] for x in cold.collect()] == [True, False, True]


def test_calibration_and_verdicts(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (0.0,)], "p double")
    got = [r[0] for r in df.select(X.calibrate("p", 99.0)).collect()]
    assert got == pytest.approx([0.01, 1.0, 0.0])
    v = spark.createDataFrame([(600, 0.03, 60, 50), (400, 0.3, 60, 0), (600, -0.03, 0, 50), (600, 0.03, 52, 50)], "f int, m double, r int, s int")
    assert [r[0] for r in v.select(MD.repair_verdict(F.col("f"), F.col("m"), F.col("r"), F.col("s"))).collect()] == [
        "pass_with_caveat", "insufficient_evidence", "fail", "insufficient_evidence"]


def test_corrupt_lines_are_skipped(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"transaction_id": "a", "outcome": "fraud"}\n\nnot json\n{"outcome": "legit"}\n{"transaction_id": "b"}{x\n')
    assert [r["transaction_id"] for r in files.read_episodes(spark, str(tmp_path / "m.jsonl")).collect()] == ["a"]


def test_retention(spark):
    df = spark.range(100).withColumnRenamed("id", "seq")
    assert files.keep_newest(df, "seq", above=100, keep=50).count() == 100
    assert sorted(r[0] for r in files.keep_newest(df, "seq", above=99, keep=50).collect()) == list(range(50, 100))


def test_null_keys_are_cut_into_slices_too(spark):
    """Half of all rows have no key: they are one hot entity, and no slice holds them all."""
    from tidewatch.operators import positions, skew

    rows = [(f"t{i}", i, None if i % 2 else f"k{i % 7}", (i * 1000,)) for i in range(2000)]
    txn = spark.createDataFrame([(a, b, c, d[0]) for a, b, c, d in rows], "transaction_id string, seq long, k string, s long").select(
        "transaction_id", "seq", "k", F.timestamp_seconds("s").alias("event_time"))
    got = {r.transaction_id: r.pos for r in positions.positions(txn, "k", hot_rows=300).collect()}
    seen = {}
    for tid, _, k, _ in rows:
        seen[k] = seen.get(k, 0) + 1
        assert got[tid] == seen[k]
    at = F.unix_micros("event_time")
    hot = skew.find_hot(txn.select("k"), ["k"], 300)
    sliced = skew.with_slices(txn, ["k"], skew.slice_plan(txn, ["k"], hot, 300, at), at)
    assert 100 < sliced.filter("k IS NULL").groupBy(skew.SLICE).count().agg(F.max("count")).first()[0] <= 300


def test_order_keeps_single_microseconds(spark):
    """Rows of the last split one microsecond apart, numbered by time and not by seq."""
    from tidewatch.operators import ranking

    base = 2 * 4503599627370496 + 1_700_000_000_000_000
    df = spark.createDataFrame([(base + i, 100 - i) for i in range(50)], "pos long, seq long")
    got = ranking.numbered(df, "pos", ["seq"]).collect()
    assert all(r.row_id == r.pos - base for r in got)


def test_sweep_places_the_marks_once(spark):
    """Without hot entities the sweep has one exchange of the marks by their keys."""
    import re

    from tidewatch.operators import velocity
    from tidewatch.sources import adapters

    txn = adapters.events_to_txn(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    plan = velocity.velocity_features(txn, hot_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(eid#\d+, ent#\d+|Exchange hashpartitioning\(ent#\d+, eid#\d+", plan)) == 1


def test_snapshots_read_their_source_once_and_join_no_ranges(spark):
    rows = [(i, f"t{i}", dt.datetime(2020 + i, 6, 1), "c1" if i else None, f"k{i % 2}", "m1", 10.0, i % 2) for i in (0, 1, 2, 5)]
    df = spark.createDataFrame(rows, "seq long, transaction_id string, event_time timestamp, customer_id string, card_id string, merchant_id string, amount double, is_fraud int")
    nodes = G.snapshot_nodes(df)
    assert nodes.groupBy("node_type", "node_id").count().filter("count != 4").count() == 0
    assert nodes.count() == nodes.select("node_type", "node_id", "bucket_idx").distinct().count() == 4 * 5
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") <= 2 and plan.count("BroadcastNestedLoopJoin") <= 1  # the one row of buckets


def test_trees_are_cut_where_the_validation_part_gains_no_more(spark):
    from tidewatch.operators import learned as L

    assert L.best_prefix([5.0, 4.0, 4.5, 4.4, 3.0], 3) == 5 and L.best_prefix([5.0, 4.0, 4.5, 4.4, 3.0], 2) == 2 and L.best_prefix([1.0], 5) == 1
    noise = spark.range(600).selectExpr("cast(id % 7 AS double) AS a", "cast(hash(id) % 2 = 0 AS int) AS is_fraud", "id % 3 = 0 AS v")
    model, weight = L.train_gbt(noise.filter("NOT v"), ["a"], trees=12, depth=2, validation=noise.filter("v"), patience=4)
    assert model.getNumTrees < 12 and weight > 0
    assert L.train_gbt(noise.filter("NOT v"), ["a"], trees=3, depth=2, validation=noise.limit(0))[0].getNumTrees == 3
    planted = spark.range(1200).selectExpr("cast(id % 23 AS double) AS a", "cast(id % 7 AS double) AS b",
                                           "cast((id % 23) * 3 + (id % 7) * 5 + hash(id) % 9 > 45 AS int) AS is_fraud", "id % 3 = 0 AS v")
    kept, _ = L.train_gbt(planted.filter("NOT v"), ["a", "b"], trees=12, depth=2, validation=planted.filter("v"), patience=4)
    assert kept.getNumTrees > 1
    whole, _ = L.train_gbt(planted.filter("NOT v"), ["a", "b"], trees=12, depth=2)
    assert kept.treeWeights == whole.treeWeights[:kept.getNumTrees]
    assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.trees[:kept.getNumTrees]]


def busy(spark, n=1500):
    """Half of all rows in one instant of one key, a tenth with neither key nor time order."""
    rows = [(f"t{i}", (i * 7919) % n, "hot" if i % 10 else None, 1_000_000 if i % 2 else i * 977, f"m{i % 5}") for i in range(n)]
    return spark.createDataFrame(rows, "transaction_id string, seq long, k string, s long, merchant_id string").select(
        "transaction_id", "seq", "k", F.timestamp_seconds("s").alias("event_time"), "merchant_id", F.lit(1.0).alias("amount"))


def test_no_slice_is_larger_than_its_bound(spark):
    from tidewatch.operators import positions, skew

    txn, at = busy(spark), F.unix_micros("event_time")
    hot = skew.find_hot(txn.select("k"), ["k"], 100)
    plan = skew.slice_plan(txn, ["k"], hot, 100, at, seq=F.col("seq"))
    sliced = skew.with_slices(txn, ["k"], plan, at, seq=F.col("seq"))
    sizes = [r["count"] for r in sliced.groupBy("k", skew.SLICE).count().collect()]
    assert max(sizes) <= 100 and len(sizes) < 3 * 1500 / 50
    rows = sliced.select("k", skew.SLICE, at.alias("at"), "seq").collect()
    by_key = {}
    for r in sorted(rows, key=lambda r: (r.k or "", r.at, r.seq)):
        assert by_key.setdefault(r.k, 0) <= r[skew.SLICE]
        by_key[r.k] = r[skew.SLICE]
    order = {k: [r["transaction_id"] for r in sorted((r for r in txn.collect() if r.k == k), key=lambda r: (r.event_time, r.seq))] for k in ("hot", None)}
    seq = {r["transaction_id"]: r["seq"] for r in txn.collect()}
    ties = {r.transaction_id: (r.tie_rank, r.tie_size) for r in positions.tie_ranks(txn, "k", hot_rows=100).collect()}
    for r in positions.running(txn, "k", "seq", hot_rows=100).collect():
        own = order[r.k]
        assert own[r.pos - 1] == r.transaction_id and r.cum_sum == sum(seq[x] for x in own[:r.pos])
        assert (r.before, r.after) == (seq[own[r.pos - 2]] if r.pos > 1 else None, seq[own[r.pos]] if r.pos < len(own) else None)
    when = {r["transaction_id"]: r["event_time"] for r in txn.collect()}
    for own in order.values():
        for i, x in enumerate(own):
            same = [y for y in own if when[y] == when[x]]
            assert ties[x] == (same.index(x), len(same))


def test_asof_with_a_busy_instant(spark):
    from tidewatch.operators import asof

    left = busy(spark).select("transaction_id", "k", F.unix_micros("event_time").alias("at"))
    right = spark.createDataFrame([("hot", x * 1_000_000, v) for v, x in enumerate((0, 500_000, 999_999, 1_000_000, 1_000_001, 2_000_000))], "k string, at long, v long")
    show = lambda d: sorted((r.transaction_id, r.at_matched, r.v_matched) for r in d.filter("k IS NOT NULL").collect())
    assert show(asof.asof_backward(left, right, "k", "at", ["v"], hot_rows=150)) == show(asof.asof_backward(left, right, "k", "at", ["v"]))


def test_sweep_with_half_of_all_rows_in_one_instant(spark):
    from tidewatch import config as C
    from tidewatch.operators import velocity

    txn = busy(spark, 900).withColumnsRenamed({"k": "customer_id"}).withColumns({"card_id": F.lit("one"), "device_id": F.lit(None).cast("string")})
    one = velocity.velocity_features(txn, hot_rows=None).orderBy("transaction_id").collect()
    assert velocity.velocity_features(txn, hot_rows=60).orderBy("transaction_id").collect() == one
    assert velocity.history_features(txn, hot_rows=60).exceptAll(velocity.history_features(txn, hot_rows=None)).isEmpty()
    assert len(one[0]) > len(C.prior_feature_names())


def test_global_order_cuts_a_busy_instant(spark):
    from tidewatch.operators import ranking

    txn = busy(spark).withColumn("at", F.unix_micros("event_time"))
    laid = ranking.ordered(txn, ["at", "seq", "transaction_id"], 30)
    assert laid.groupBy("_slice").count().agg(F.max("count")).first()[0] < 250  # of 750 in the instant
    got = [r.transaction_id for r in ranking.numbered(txn, "at", ["seq", "transaction_id"], 30).orderBy("row_id").collect()]
    assert got == [r.transaction_id for r in sorted(txn.collect(), key=lambda r: (r.at, r.seq, r.transaction_id))]


def test_bound_of_a_rank_leaves_few_rows(spark):
    from tidewatch.operators import ranking

    df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 0.5 WHEN id % 50 = 1 THEN NULL ELSE 1e6 / (1 + id) END AS v", "id * id AS w").repartition(40)
    values = sorted((r.v for r in df.collect() if r.v is not None), reverse=True)
    for k in (1, 17, 900, 9_000, 19_000):
        left = ranking.highest(df, F.col("v"), k)
        assert sorted((r.v for r in left.filter("v IS NOT NULL").collect()), reverse=True)[:k] == values[:k]
        ties = sum(x == values[k - 1] for x in values)
        assert left.count() <= 2 * k + ranking.BINS + ties
    assert ranking.highest(df, F.col("v"), 10**6).count() == 20_000
    assert ranking.rank_bound(df, -F.col("w"), 5) is not None and ranking.rank_bound(df.limit(0), F.col("w"), 5) is None
    got = ranking.highest(df, -F.col("w"), 5).count()
    assert 5 <= got <= 5 + ranking.BINS


def test_sketches_stay_within_their_bounds(spark):
    df = spark.range(40_000).selectExpr("id", "id % 12 AS month", "pow(id % 977, 2) / 3 AS x")
    sketches = D.quantile_sketches(df, "x", ["month"], k=200)
    probs = [0.01, 0.1, 0.5, 0.9, 0.99]
    got = D.merged_quantiles(sketches, probs, k=200).first()
    xs = np.sort([r.x for r in df.collect()])
    assert got["n"] == 40_000
    for p, q in zip(probs, got["q"]):
        lo, hi = np.searchsorted(xs, q, "left") / len(xs), np.searchsorted(xs, q, "right") / len(xs)
        assert lo - 0.0265 <= p <= hi + 0.0265  # twice the rank error at k = 200
    rows = spark.range(60_000).selectExpr("cast(id % 3 AS string) AS c", "cast(id / 12000 AS int) AS month_idx", "cast(hash(id) % 4000 AS string) AS m", "1.0D AS amount", "0 AS is_fraud")
    s = G.entity_month_sketches(rows, "c", "m")
    exact = {}
    for r in rows.collect():
        exact.setdefault((r.c, r.month_idx), set()).add(r.m)
    for r in G.partners_until(s, "c").collect():
        want = len(set().union(*(exact[r.c, x] for x in range(r.month_idx + 1))))
        assert abs(r.partners_until - want) <= 5 * 0.0163 * want


def test_stacker_is_the_likelihood_optimum(spark):
    """At the optimum the residuals are orthogonal to every signal; Newton's method in numpy finds the same weights."""
    from pyspark.ml.functions import vector_to_array

    from tidewatch.operators import learned as L

    rnd = np.random.default_rng(12)
    y = (rnd.random(3000) < 0.2).astype(float)
    good, noise, ae = np.clip(rnd.normal(0.3 + 0.2 * y, 0.1), 0.01, 0.99), rnd.random(3000), rnd.normal(y, 1.0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(good, noise, ae, y)], "good double, noise double, ae double, label double")
    model = L.stack(df, ["good", "noise", "ae"], raw_signals=("ae",), label="label")
    x = np.column_stack([np.log(good / (1 - good)), np.log(np.clip(noise, 1e-6, 1 - 1e-6) / (1 - np.clip(noise, 1e-6, 1 - 1e-6))), ae, np.ones(3000)])
    w = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - y))
    fitted = model.stages[-1]
    assert np.allclose([*fitted.coefficients.toArray(), fitted.intercept], w, atol=2e-3)
    got = [r.p for r in model.transform(df).select(vector_to_array("probability")[1].alias("p")).collect()]
    assert np.abs(x.T @ (np.array(got) - y)).max() < 0.5


def test_anomaly_is_the_residual_of_numpys_components(spark):
    from tidewatch.operators import learned as L

    rnd = np.random.default_rng(13)
    x = rnd.normal(size=(400, 6)) @ rnd.normal(size=(6, 6)) + 3
    x[:, 5] = 7.0  # a constant column
    cols = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{c} double" for c in cols))
    got = {r.id: r.anomaly_score for r in L.anomaly(df.filter("id < 300"), df, cols, ["id"], k=3).collect()}
    std = x[:300].std(axis=0)
    z = (x - x[:300].mean(axis=0)) / np.where(std < 1e-6, 1.0, std)
    _, vectors = np.linalg.eigh(np.cov(z[:300].T))
    top = vectors[:, ::-1][:, :3]
    want = ((z - z @ top @ top.T) ** 2).mean(axis=1)
    assert np.allclose([got[i] for i in range(400)], want, atol=1e-8)


def test_what_if_takes_the_smallest_step_that_is_safe(spark):
    from tidewatch.operators import learned as L

    rows = [(i, 1.0 + i % 7, 0.3, 0.2) for i in range(40)]
    df = spark.createDataFrame(rows, "transaction_id int, amount_log1p double, hour_sin double, hour_cos double")
    train = spark.range(2000).selectExpr("cast(id % 100 AS double) / 12 AS amount_log1p", "cast(id % 11 AS double) / 11 AS hour_sin", "cast(id % 5 AS double) / 5 AS hour_cos",
                                         "cast(id % 100 > 50 AS int) AS is_fraud")
    cols = ["amount_log1p", "hour_sin", "hour_cos"]
    model, w = L.train_gbt(train, cols, trees=40, depth=3, step=0.4)
    old, L.SAFE_PROBABILITY = L.SAFE_PROBABILITY, 0.05
    try:
        scored = L.score(model, w, df, cols, 0.5, 0.1)
        found = L.what_if(model, w, scored, cols, ["transaction_id"]).collect()
        first = {}
        for r in L.perturbation_grid(df, ["transaction_id"]).collect():
            first.setdefault((r.transaction_id, r.feature, r.step), (r.from_value, r.to_value))
        grid = spark.createDataFrame([(t, f, s, *[v[1] if f == c else rows[t][1 + cols.index(c)] for c in cols]) for (t, f, s), v in first.items()],
                                     "transaction_id int, feature string, step int, " + ", ".join(f"{c} double" for c in cols))
        safe = {}
        for r in L.score(model, w, grid, cols, 0.5, 0.1).filter("fraud_probability <= 0.05").collect():
            safe[r.transaction_id, r.feature] = min(r.step, safe.get((r.transaction_id, r.feature), 99))
    finally:
        L.SAFE_PROBABILITY = old
    unsafe = {r.transaction_id for r in scored.filter("fraud_probability > 0.05").collect()}
    want = {k: v for k, v in safe.items() if k[0] in unsafe}
    assert found and {(r.transaction_id, r.feature): round(r.distance / L.STEP) for r in found} == want


def test_quantiles_and_drift_read_the_rows_once(spark):
    """Equal values are merged in the one pass over the rows; all that follows reads the merged ones."""
    seen = spark.sparkContext.accumulator(0)

    def see(x):
        seen.add(1)
        return float(x % 97)

    value = F.udf(see, "double").asNondeterministic()
    rows = lambda lo, hi: spark.range(lo, hi).select(value("id").alias("v"), (F.col("id") % 3).cast("double").alias("w"))
    q = R.quantiles(rows(0, 970), "v", [0.1, 0.5], slices=4).first()["q"]
    assert list(q) == [9.0, 48.0] and seen.value == 970
    got = {r["feature"]: r for r in D.feature_drift(rows(0, 970), rows(970, 1940), ["v", "w"]).collect()}
    assert seen.value == 970 * 3
    assert abs(got["v"]["psi"]) < 1e-12 and got["v"]["ref_mean"] == got["v"]["obs_mean"] == 48.0


def test_sweep_tasks_follow_the_number_of_events(spark, monkeypatch):
    """Spark does not merge the sweep's partitions: marks are several times the events that are shuffled."""
    from tidewatch.operators import velocity
    from tidewatch.sources import adapters as A

    txn = A.events_to_txn(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    monkeypatch.setattr(velocity, "EVENTS_PER_TASK", 100)  # 1,000 events name three or four entities each
    for made in (velocity.velocity_features(txn), velocity.history_features(txn)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        n = [int(x) for x in re.findall(r"hashpartitioning\(eid#\d+, ent#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
        assert n and all(30 <= x <= 40 for x in n), plan


def test_shift_by_groups_equals_shift_by_rows(spark):
    """The z of encodings from merchants and categories, weighted by their rows, is that of the joined rows."""
    from tidewatch.plans import drift as P
    from tidewatch.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    got = {r["feature"]: r["z"] for r in P.shifts(t, "test").collect()}
    want = {r["feature"]: r["z"] for r in P.drift_table(P.featured(t), "test").collect()}
    assert set(got) == set(want) == set(C.MONITORED_COLUMNS)
    assert all(abs(got[f] - z) < 1e-6 for f, z in want.items())


def test_shift_ignores_what_is_on_neither_side(spark):
    rows = spark.createDataFrame([("train", 1.0, 2), ("train", 3.0, 2), ("test", 5.0, 4), ("val", 99.0, 1), ("test", None, 7)], "split string, x double, n long")
    is_train = F.when(F.col("split") != "val", F.col("split") == "train")
    assert [tuple(r) for r in D.feature_shift(rows, is_train, ["x"], weight="n").collect()] == [("x", 6.0)]
    assert [tuple(r) for r in D.feature_shift(rows, is_train, ["x"]).collect()] == [("x", 3.0)]

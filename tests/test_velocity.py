"""Velocity sweep and history against brute force, ties, skew and shuffled input."""

import datetime as dt
import math
import random

import pytest

from tidewatch import config as C
from tidewatch.operators import positions as P, velocity as V

SCHEMA = ("seq long, transaction_id string, event_time timestamp, customer_id string, card_id string, merchant_id string, "
          "device_id string, amount double")
T0 = dt.datetime(2024, 1, 1)


def make(spark, n=400, seed=3, hot=0.4):
    """Random events; many share an instant, one customer and one merchant hold a large share."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        cust = "c0" if rnd.random() < hot else f"c{rnd.randint(1, 6)}"
        merch = "m0" if rnd.random() < hot else (None if rnd.random() < 0.1 else f"m{rnd.randint(1, 5)}")
        when = T0 + dt.timedelta(minutes=30 * rnd.randint(0, 900))
        rows.append((i, f"t{i}", when, cust, f"{cust}::{i % 2}", merch, f"d{i % 3}" if i % 4 else None,
                     round(rnd.uniform(1, 500), 2)))
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    out = {}
    ids = {"cust": 3, "card": 4, "merch": 5, "device": 6}
    for r in rows:
        f = {}
        for e in C.CATALOGUE:
            k = ids[e.name]
            if r[k] is None:
                continue
            past = sorted((x for x in rows if x[k] == r[k] and (x[2], x[0]) < (r[2], r[0])), key=lambda x: (x[2], x[0]))
            for w in e.windows:
                seen = [x for x in past if x[2] >= r[2] - dt.timedelta(seconds=C.WINDOW_SECONDS[w.label])]
                f[f"{e.name}_v_{w.label}_count"] = float(len(seen))
                if w.amount:
                    f[f"{e.name}_v_{w.label}_amount"] = round(sum(x[7] for x in seen), 4)
                if w.distinct:
                    f[f"{e.name}_v_{w.label}_distinct_merchants"] = float(len({x[5] for x in seen if x[5]}))
            n, prev = len(past), past[-1] if past else None
            all_priors = {
                "txn_count_prior": float(n),
                "amount_mean_prior": round(sum(x[7] for x in past) / n, 6) if n else 0.0,
                "time_since_prev_log": round(math.log1p((r[2] - prev[2]).total_seconds()), 6) if prev else 0.0,
                "prev_amount_ratio": round(min(r[7] / prev[7], 50.0), 6) if prev else 1.0}
            f.update({f"{e.name}_{p}": all_priors[p] for p in e.priors})
        out[r[1]] = f
    return out


def check(df, rows):
    want = brute(rows)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["transaction_id"]]
        for name in C.velocity_feature_names() + C.prior_feature_names():
            if name in w:
                assert r[name] == pytest.approx(w[name], abs=1e-6), (r["transaction_id"], name)
            else:
                assert r[name] is None, (r["transaction_id"], name)


def test_sweep_equals_brute_force(spark):
    rows, df = make(spark)
    check(V.velocity_features(df, hot_rows=None), rows)


def test_hot_entities_cut_into_slices_give_the_same(spark):
    rows, df = make(spark)
    check(V.velocity_features(df, hot_rows=40), rows)


def test_input_order_does_not_matter(spark):
    rows, df = make(spark, n=150)
    a = V.velocity_features(df).orderBy("transaction_id").collect()
    b = V.velocity_features(df.repartition(13).orderBy("amount")).orderBy("transaction_id").collect()
    assert a == b


def test_window_ends_are_closed(spark):
    rows = [(i, f"t{i}", T0 + dt.timedelta(seconds=s), "c", "k", "m", None, 10.0) for i, s in enumerate((0, 3600, 3601, 7200))]
    r = {x["transaction_id"]: x for x in V.velocity_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [r[f"t{i}"]["cust_v_1h_count"] for i in range(4)] == [0.0, 1.0, 1.0, 2.0]


def test_first_row_of_every_entity_has_no_past(spark):
    rows = [(1, "t1", T0, "c1", "k1", "m1", None, 100.0), (2, "t2", T0 + dt.timedelta(hours=1), "c1", "k1", "m1", None, 50.0),
            (3, "t3", T0 + dt.timedelta(hours=2), "c1", "k1", "m2", None, 75.0), (4, "t4", T0 + dt.timedelta(hours=3), "c2", "k2", "m1", None, 9.0)]
    h = {x["transaction_id"]: x for x in V.history_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert h["t1"]["cust_txn_count_prior"] == 0 and h["t1"]["cust_time_since_prev_log"] is None
    assert h["t2"]["cust_amount_mean_prior"] == 100.0 and h["t3"]["cust_amount_mean_prior"] == 75.0
    assert h["t4"]["cust_txn_count_prior"] == 0 and h["t4"]["cust_amount_mean_prior"] is None
    assert h["t4"]["merch_txn_count_prior"] == 2


def test_history_with_slices_equals_without(spark):
    _, df = make(spark)
    a = V.history_features(df, hot_rows=None)
    b = V.history_features(df, hot_rows=30)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_positions_with_slices(spark):
    rows, df = make(spark)
    a = {r["transaction_id"]: r["pos"] for r in P.positions(df, "customer_id", hot_rows=20).collect()}
    for c in {r[3] for r in rows}:
        mine = sorted((r for r in rows if r[3] == c), key=lambda r: (r[2], r[0]))
        assert [a[r[1]] for r in mine] == list(range(1, len(mine) + 1))


def test_last_n_keeps_the_newest(spark):
    rows, df = make(spark)
    got = P.last_n(df, "customer_id", 3).collect()
    for c in {r[3] for r in rows}:
        mine = sorted((r for r in rows if r[3] == c), key=lambda r: (r[2], r[0]))[-3:]
        assert {r["transaction_id"] for r in got if r["customer_id"] == c} == {r[1] for r in mine}


def test_queries_of_priors_sweep_their_own_entities_alone(spark, monkeypatch):
    """The marks of other entities and of windows grew the sweep's tasks without being read."""
    from tidewatch.plans import load_all
    from tidewatch.plans.registry import QUERIES

    load_all()
    seen, find_hot = [], V.find_hot
    monkeypatch.setattr(V, "find_hot", lambda base, entities, rows: seen.append(entities) or find_hot(base, entities, rows))
    for name, own in (("win_prev_ratio", {"cust"}), ("win_gap_log", {"cust", "card"}), ("win_prior_mean", {"cust", "card"})):
        seen.clear()
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(seen) == 2 and all({e.name for e in es} == own and not any(e.windows for e in es) for es in seen)
    df = make(spark)[1]
    own = C.priors_alone(["cust_prev_amount_ratio", "card_amount_mean_prior"])
    for features in (lambda e: V.velocity_features(df, e), lambda e: V.history_features(df, entities=e)):
        some = {tuple(r) for r in features(own).select("transaction_id", *C.prior_feature_names(own)).collect()}
        assert some == {tuple(r) for r in features(C.CATALOGUE).select("transaction_id", *C.prior_feature_names(own)).collect()}

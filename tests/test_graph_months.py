"""Monthly totals of all node types, shuffled once, against the grouping entity by entity."""

import random

from tidewatch.operators import graph as G

IDS = ["node_type", "node_id"]


def sides(spark, n=3000):
    rnd = random.Random(5)
    rows = []
    for k in range(n):
        kind = rnd.choice(["customer", "merchant"])
        node = None if rnd.random() < 0.05 else ("n0" if rnd.random() < 0.4 else f"n{rnd.randint(1, 40)}")
        rows.append((kind, node, None if rnd.random() < 0.1 else f"p{rnd.randint(1, 30)}", rnd.randint(300, 305), round(rnd.random() * 99, 2), int(rnd.random() < 0.1)))
    return spark.createDataFrame(rows, "node_type string, node_id string, partner string, month_idx long, amount double, is_fraud int")


def test_months_of_all_entities_are_those_of_each(spark):
    df = sides(spark)
    want = set()
    for kind in ("customer", "merchant"):
        want |= {(kind, *r) for r in G.entity_month(df.where(f"node_type = '{kind}'"), "node_id", "partner").select("node_id", "month_idx", "n", "amt", "extra", "fraud").collect()}
    for hot_rows in (10_000, 100, 1):  # none hot, some, nearly all
        got = G.placed_months(df, IDS, "partner", hot_rows)
        assert {tuple(r) for r in got.select(*IDS, "month_idx", "n", "amt", "extra", "fraud").collect()} == want


def test_rows_are_shuffled_once(spark):
    hist = G.history(G.placed_months(sides(spark), IDS, "partner"), "node_id", True, ("node_type",))
    hist.collect()
    plan = hist._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def cases(spark, sf):
    """name -> (rows of the main input, function that returns the frame to materialise)."""
    from tidewatch.operators import drift as D, graph as G, impact as IM, memory as MEM, metrics as M, velocity as V
    from tidewatch.operators import audit
    from tidewatch.plans.registry import Tables
    from tidewatch.session import scratch_path
    from tidewatch.sources import cards

    t = Tables(spark, sf)
    stored = scratch_path(spark, "bench-scores")  # the score stream is a stored table in practice
    t.scores().write.parquet(stored)
    scores = spark.read.parquet(stored)
    n_events = t.raw("events").count()
    n_lines = t.raw("lineitem").count()
    return {
        "history_lines": (n_lines, lambda: V.history_features(t.lines())),
        "split_lines": (n_lines, lambda: cards.with_split(t.lines(), cards.split_bounds(t.lines()))),
        "metrics_scores": (n_lines, lambda: M.metrics_report(scores)),
        "policy_scores": (n_lines, lambda: M.threshold_policy(scores)),
        "drift_report_scores": (n_lines, lambda: D.monitor_report(scores)),
        "impact_scores": (n_lines, lambda: IM.impact(scores, 17.0)),
        "graph_nodes_lines": (n_lines, lambda: G.snapshot_nodes(t.lines())),
        "graph_edges_lines": (n_lines, lambda: G.edge_attributes(t.lines())),
        "memory_rollup_events": (n_events, lambda: MEM.failure_rollup(t.episodes())),
        "audit_verify_events": (n_events, lambda: audit.verify(audit.chain(audit.from_decisions(t.decisions())))),
        "velocity_events": (n_events, lambda: V.velocity_features(t.txn())),
        "velocity_lines": (n_lines, lambda: V.velocity_features(t.lines())),
    }


def main() -> None:
    from tidewatch.session import build_session

    spark = build_session("bench", master=f"local[{CPUS}]", shuffle_partitions=int(CPUS))
    seconds, rates = {}, {}
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    run(spark.read.parquet(f"{SF_DIR}/orders.parquet").groupBy("o_orderstatus").count())  # starts the executors
    for name, (rows, fn) in cases(spark, SF_DIR).items():
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            run(fn())
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
        seconds[name], rates[name] = round(best, 3), int(rows / best)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "rows_per_sec": rates, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()

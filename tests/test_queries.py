"""A few registered queries against their SQL on the smallest tables; all names are well formed."""

import pytest

import __spark_entry__ as entry
from compare import TABLES, compare, connect

SF = "/root/testdata/sf0.001"
SOME = ["flagship_velocity_band", "win_vel_distinct", "prj_canonical", "jn_asof_backward", "agg_pr_curve", "win_monitor_report",
        "gr_snapshot_nodes", "win_hash_verify", "snk_split_quarantine", "win_threshold_history"]


def test_every_sql_belongs_to_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 250


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    res = compare(name, entry.queries()[name], entry.oracle_sql()[name], spark, SF, connect(SF))
    assert res.startswith("ok"), res


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def with_amounts(tmp_path, values):
    """The smallest tables with the amounts of the first events replaced."""
    import duckdb

    given = ", ".join(f"({i}, {v})" for i, v in values.items())
    for t in TABLES:
        rows = f"SELECT * FROM '{SF}/{t}.parquet'"
        if t == "events":
            rows = f"SELECT e.* REPLACE (coalesce(v.x, e.value) AS value) FROM '{SF}/events.parquet' e LEFT JOIN (VALUES {given}) v(i, x) ON event_id = i"
        duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet'")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["fn_math_log_trig", "prj_validate_event", "snk_split_quarantine"])
def test_amounts_of_zero(spark, tmp_path, name):
    sf = with_amounts(tmp_path, {1: "0.0", 13: "0.0", 17: "0.0", 20: "0.001"})
    res = compare(name, entry.queries()[name], entry.oracle_sql()[name], spark, sf, connect(sf))
    assert res.startswith("ok"), res


def test_page_hinkley_row_without_a_better_candidate(spark):
    from tidewatch.operators import drift as D
    from tidewatch.plans.drift import page_hinkley_row

    none = spark.sql("SELECT 'x' AS name, 1 AS rank WHERE false")
    points = spark.createDataFrame([(i, 0.5 if i < 8 else 0.9) for i in range(14)], "i int, x double")
    assert page_hinkley_row(D.auto_switch(points, "i", "x", none, "c3")).select("triggered", "to_model").first()[:] == (True, None)


@pytest.mark.parametrize("name", ["rp_decision_parity", "agg_psi_sketch", "rp_model_race"])
def test_scores_are_joined_once(spark, name):
    """The result's plan reads the stored scores, not the lines and orders again."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan, plan[:2000]


def test_stacked_scores_are_joined_once(spark, monkeypatch):
    """What the metrics read comes from the stored scores, not from the lines and orders again."""
    from tidewatch.plans import learned

    plans = []
    report = learned.M.metrics_report
    monkeypatch.setattr(learned.M, "metrics_report", lambda df, **how: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or report(df, **how))
    assert entry.queries()["ml_stack"](spark, SF).count() == 2
    assert plans and "l_orderkey" not in plans[0], plans[0][:2000]

"""As-of and positional joins as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch import config as C
from tidewatch.operators import ranking as R
from tidewatch.operators import skew


def asof_backward(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str],
                  hot_rows: int = C.HOT_ROWS) -> DataFrame:
    """Left rows with the latest right row of the same key at or before them.

    Both sides are laid on one timeline and the last right row is carried
    forward, which costs one shuffle and no pairs. `at` is a long; among right
    rows of one instant the largest `values` struct wins.
    """
    carry = F.struct(F.col(at).alias("_at"), *[F.col(v).alias(v) for v in values])
    rt = right.filter(F.col(by).isNotNull()).groupBy(by, at).agg(F.max(F.struct(*values)).alias("_v")).select(by, at, "_v.*")
    r = rt.select(by, at, carry.alias("_r"), F.lit(0).alias("_side"))
    both = left.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).withColumn("_side", F.lit(1)).unionByName(
        r, allowMissingColumns=True)
    hot = skew.find_hot(both.select(by), [by], hot_rows)
    # rows of one side and one instant may stand in any order, so a hash may part them
    order = {"at": F.col(at), "side": F.col("_side"), "seq": F.xxhash64(*left.columns)}
    plan = skew.slice_plan(both, [by], hot, hot_rows, **order)
    s = skew.with_slices(both, [by], plan, **order)
    w = Window.partitionBy(by, skew.SLICE).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = s.withColumn("_m", F.last("_r", ignorenulls=True).over(w))
    if plan is not None:
        before = skew.carried(s, [by], {"_newest": F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col(at)))},
                              {"_b": F.last("_newest", ignorenulls=True)})
        out = skew.join_null_safe(out, before, [by, skew.SLICE]).withColumn("_m", F.coalesce("_m", "_b"))
    return out.filter(F.col("_side") == 1).select(
        *left.columns, F.col("_m._at").alias(f"{at}_matched"), *[F.col(f"_m.{v}").alias(f"{v}_matched") for v in values])


def join_by_position(left: DataFrame, right: DataFrame, at: str, ties: list[str]) -> DataFrame:
    """Join two frames row by row; positions come from an explicit order."""
    a = R.numbered(left, at, ties, name="row_id")
    b = R.numbered(right, at, ties, name="row_id").drop(at, *ties)
    return a.join(b, "row_id")


def parity_report(left: DataFrame, right: DataFrame, key: str, columns: list[str], exact: float = 1e-6) -> DataFrame:
    """Largest absolute difference per column between two engines' outputs."""
    r = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    j = left.select(key, *columns).join(r, key)
    worst = j.agg(F.count(F.lit(1)).alias("rows_compared"), *[
        F.max(F.abs(F.coalesce(c, F.lit(0.0)) - F.coalesce(f"_r_{c}", F.lit(0.0)))).alias(c) for c in columns])
    long = worst.unpivot(["rows_compared"], columns, "column", "max_abs_diff")
    return long.withColumn("exact_match", F.col("max_abs_diff") < exact)

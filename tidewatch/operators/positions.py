"""Row positions inside an entity, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch import config as C
from tidewatch.functions import expr as X
from tidewatch.operators import skew


def positions(txn: DataFrame, id_col: str, hot_rows: int = C.HOT_ROWS) -> DataFrame:
    """1-based position of every row in its entity's (time, seq) order."""
    base = txn.withColumn("at", X.micros("event_time"))
    hot = skew.find_hot(base.select(id_col), [id_col], hot_rows)
    order = {"at": F.col("at"), "seq": F.col("seq")}
    plan = skew.slice_plan(base, [id_col], hot, hot_rows, **order)
    s = skew.with_slices(base, [id_col], plan, **order)
    w = Window.partitionBy(id_col, skew.SLICE).orderBy("at", "seq", "transaction_id")
    out = s.withColumn("pos", F.row_number().over(w).cast("long"))
    if plan is not None:
        before = skew.carried(s, [id_col], {"n": F.count(F.lit(1))}, {"b_n": F.sum("n")})
        out = (skew.join_null_safe(out, before, [id_col, skew.SLICE])
               .withColumn("pos", F.col("pos") + F.coalesce("b_n", F.lit(0))).drop("b_n", "_hot"))
    return out.drop(skew.SLICE, "at")


def running(txn: DataFrame, id_col: str, value: str, hot_rows: int = C.HOT_ROWS) -> DataFrame:
    """`txn` with `pos`, `cum_sum` and the neighbours `before` and `after` of `value`, in (time, seq) order per entity.

    Hot entities are cut into slices; a slice adds what the slices before it hold and
    looks at the nearest row of its neighbours.
    """
    base = txn.withColumn("at", X.micros("event_time"))
    hot = skew.find_hot(base.select(id_col), [id_col], hot_rows)
    order = {"at": F.col("at"), "seq": F.col("seq")}
    plan = skew.slice_plan(base, [id_col], hot, hot_rows, **order)
    s = skew.with_slices(base, [id_col], plan, **order)
    w = Window.partitionBy(id_col, skew.SLICE).orderBy("at", "seq", "transaction_id")
    out = s.withColumns({"pos": F.row_number().over(w).cast("long"), "cum_sum": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                         "before": F.lag(value).over(w), "after": F.lead(value).over(w), "_last": F.lead("transaction_id").over(w).isNull()})
    if plan is not None:
        place = F.struct("at", "seq", "transaction_id")
        ends = s.filter("_hot").groupBy(id_col, skew.SLICE).agg(
            F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"), F.min_by(value, place).alias("low"), F.max_by(value, place).alias("high"))
        slices = Window.partitionBy(id_col).orderBy(skew.SLICE)
        earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(id_col, skew.SLICE, F.sum("n").over(earlier).alias("b_n"), F.sum("sum").over(earlier).alias("b_sum"),
                           F.lag("high").over(slices).alias("b_high"), F.lead("low").over(slices).alias("a_low"))
        out = skew.join_null_safe(out, ends, [id_col, skew.SLICE]).withColumns({
            "before": F.when(F.col("pos") == 1, F.col("b_high")).otherwise(F.col("before")),
            "after": F.when(F.col("_last"), F.col("a_low")).otherwise(F.col("after")),
            "pos": F.col("pos") + F.coalesce("b_n", F.lit(0)), "cum_sum": F.col("cum_sum") + F.coalesce("b_sum", F.lit(0))})
    return out.select(*txn.columns, "pos", "cum_sum", "before", "after")


def next_same(txn: DataFrame, id_col: str, other: str, hot_rows: int = C.HOT_ROWS) -> DataFrame:
    """Position of the entity's next row with the same `other` value; null at the end."""
    p = positions(txn, id_col, hot_rows)
    hot = skew.find_hot(txn.select(id_col), [id_col], hot_rows)
    plan = skew.slice_plan(p, [id_col], hot, hot_rows, F.col("pos"))
    return skew.neighbours(p, [id_col, other], "pos", [], plan, [id_col]).drop("prev_at")


def tie_ranks(txn: DataFrame, id_col: str, hot_rows: int = C.HOT_ROWS) -> DataFrame:
    """0-based rank inside, and size of, each (entity, instant).

    The rank is the row's position less the first one of its instant, so a busy
    instant is no single task either: its first position and size are counted
    before they are shuffled, and a skewed join is dealt anew by the planner.
    """
    p = positions(txn, id_col, hot_rows)
    same = p.groupBy(id_col, "event_time").agg(F.min("pos").alias("_from"), F.count(F.lit(1)).alias("tie_size"))
    ranked = skew.join_null_safe(p, same, [id_col, "event_time"]).withColumn("tie_rank", F.col("pos") - F.col("_from"))
    return ranked.select(*txn.columns, "tie_rank", "tie_size")


def last_n(txn: DataFrame, id_col: str, n: int) -> DataFrame:
    """The newest n rows of every entity, with `back` = 1 for the newest.

    The rank filter is pushed below the shuffle (window group limit), so each
    map task sends at most n rows per entity, whatever the entity's size.
    """
    w = Window.partitionBy(id_col).orderBy(
        F.desc("event_time"), F.desc("seq"), F.desc("transaction_id"))
    return txn.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)

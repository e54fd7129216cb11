"""Hot groups: find them, cut them into slices of bounded rows, carry state between slices.

A window over `partitionBy(entity)` puts an entity into one task. When one
entity may hold a third of all rows that task never ends, so entities above a
row threshold are cut into slices. A histogram over time, refined level by
level where a cell holds too many rows (days, hours, ..., one instant, and
inside an instant by sequence number), says where: cells are joined in order
until a slice is full, so no slice has more than the threshold, even if half of
all rows share one instant. Slices are aggregated once, the slice totals (few
rows) are accumulated per entity, and every row adds the total of the slices
before its own. Ordinary entities keep slice 0 and pay nothing but the lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import stored

SLICE = "_slice"
#: Widths of the cells of time (in units of `at`) and, inside an instant, of the sequence number.
TIME_CELLS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)
SEQ_CELLS = (1 << 48, 1 << 32, 1 << 16, 1 << 8, 1)
_LEAST = -(1 << 63)


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys with more than `hot_rows` rows.

    Counting is partial before the shuffle. The result has fewer than
    rows / hot_rows entries; whether that is small enough to broadcast is for
    the planner to see. A null key counts like any other.
    """
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > hot_rows).select(*keys, F.lit(True).alias("_hot")))


def find_hot(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """`hot_keys` as a stored table, or None when there are none."""
    hot = stored(hot_keys(df, keys, hot_rows), "hot-keys")
    return None if hot.isEmpty() else hot


def _place(at: Column, side: Column | None, seq: Column | None) -> Column:
    """Where a row stands: its time, its side of the instant, its sequence number."""
    return F.struct(at.cast("long").alias("at"), (F.lit(0) if side is None else side).cast("byte").alias("side"),
                    (F.lit(_LEAST) if seq is None else F.coalesce(seq.cast("long"), F.lit(_LEAST))).alias("seq"))


def _cell(place: str, level: int) -> Column:
    """The least place of the cell of a level that holds a place."""
    p = F.col(place)
    time = p["at"]
    if level < len(TIME_CELLS):
        return _place(time - F.pmod(time, F.lit(TIME_CELLS[level])), None, None)
    if level == len(TIME_CELLS):
        return _place(time, p["side"], None)
    return _place(time, p["side"], p["seq"] - F.pmod(p["seq"], F.lit(SEQ_CELLS[level - len(TIME_CELLS) - 1])))


def slice_plan(df: DataFrame, keys: list[str], hot: DataFrame | None, rows: int, at: Column,
               side: Column | None = None, seq: Column | None = None) -> DataFrame | None:
    """Where the hot keys of `df` are cut, so that no slice has more than `rows` rows.

    (keys, `_day`, `_first`, `_edges`) for every day with rows: the slice that is open
    when the day begins, and the places in it where new ones begin. Only rows that
    agree in (at, side, seq) are never parted. None when nothing is hot.
    """
    if hot is None:
        return None
    all_ = stored(join_null_safe(df.select(*keys, _place(at, side, seq).alias("_p")), hot, keys).filter("_hot").drop("_hot"), "hot-places")
    if all_.isEmpty():
        return None
    half, cells, days, full = max(1, rows // 2), [], None, None
    for level in range(len(TIME_CELLS) + 1 + len(SEQ_CELLS)):
        inside = all_
        if full is not None:
            known = full.select(*[F.col(k).alias(f"_on_{k}") for k in keys], F.col("_c").alias("_on"))
            cond = F.col("_up") == F.col("_on")
            for k in keys:
                cond = cond & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
            inside = all_.withColumn("_up", _cell("_p", level - 1)).join(known, cond, "left_semi")
        counted = stored(inside.groupBy(*keys, _cell("_p", level).alias("_c")).agg(F.count(F.lit(1)).alias("_n")), f"cells-{level}")
        days = counted if days is None else days
        full = counted.filter(F.col("_n") > half)
        last = level == len(TIME_CELLS) + len(SEQ_CELLS) or full.isEmpty()
        cells.append(counted if last else counted.filter(F.col("_n") <= half))
        if last:
            break
    every = cells[0]
    for c in cells[1:]:
        every = every.unionByName(c)
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    number = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / half)
    edges = every.withColumn("_s", number).groupBy(*keys, "_s").agg(F.min("_c").alias("_c"))
    day = F.col("_c.at") - F.pmod(F.col("_c.at"), F.lit(TIME_CELLS[0]))
    per_day = edges.groupBy(*keys, day.alias("_day")).agg(F.array_sort(F.collect_list("_c")).alias("_edges"))
    with_rows = days.select(*keys, F.col("_c.at").alias("_day"))
    none = F.array().cast(per_day.schema["_edges"].dataType)
    plan = join_null_safe(with_rows, per_day, [*keys, "_day"]).withColumn("_edges", F.coalesce("_edges", none))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.size("_edges")).over(earlier), F.lit(0)) - 1
    return stored(plan.withColumn("_first", first), "slice-plan")


def with_slices(df: DataFrame, keys: list[str], plan: DataFrame | None, at: Column,
                side: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Add the slice number, in the order of (at, side, seq), and `_hot`; 0 and null for ordinary keys."""
    if plan is None:
        return df.withColumn(SLICE, F.lit(0).cast("long"))
    day = at.cast("long") - F.pmod(at.cast("long"), F.lit(TIME_CELLS[0]))
    joined = join_null_safe(df.withColumn("_day", day).withColumn("_p", _place(at, side, seq)), plan, [*keys, "_day"])
    number = F.col("_first") + F.size(F.filter("_edges", lambda e: e <= F.col("_p")))
    return (joined.withColumn("_hot", F.when(F.col("_edges").isNotNull(), True))
            .withColumn(SLICE, F.coalesce(number, F.lit(0)).cast("long")).drop("_day", "_p", "_first", "_edges"))


def join_null_safe(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on `keys` where a null key matches the null key."""
    named = other.select(*[F.col(k).alias(f"_on_{k}") if k in keys else F.col(k) for k in other.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return df.join(named, cond, "left").drop(*[f"_on_{k}" for k in keys])


def carried(df: DataFrame, keys: list[str], totals: dict[str, Column],
            running: dict[str, Column]) -> DataFrame:
    """Per (key, slice) of hot keys: `running` over the totals of earlier slices.

    `running` columns are evaluated over the earlier slices of a key, so the
    window below sees one row per slice and not one per event. The hot flag is
    tested behind the grouping: then a `df` that is already placed by (keys,
    slice) keeps its plan, and Spark reuses its shuffle instead of making it
    again.
    """
    per_slice = (df.groupBy(*keys, SLICE).agg(F.max("_hot").alias("_hot"), *[c.alias(n) for n, c in totals.items()])
                 .filter(F.col("_hot")))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(*keys, SLICE, *[c.over(before).alias(n) for n, c in running.items()])


def neighbours(df: DataFrame, keys: list[str], at: str, ties: list[str], plan: DataFrame | None, plan_on: list[str]) -> DataFrame:
    """Time of the previous and next row of the same key: `prev_at`, `next_at`.

    `plan_on` are the columns of `plan`, a subset of `keys`; the first of `ties`, if any, is a sequence number.
    """
    seq = F.col(ties[0]) if ties else None
    s = with_slices(df, plan_on, plan, F.col(at), seq=seq)
    w = Window.partitionBy(*keys, SLICE).orderBy(at, *ties)
    placed = s.withColumn("prev_at", F.lag(at).over(w)).withColumn("next_at", F.lead(at).over(w))
    if plan is None:
        return placed.drop(SLICE)
    ends = s.filter(F.col("_hot")).groupBy(*keys, SLICE).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    e = Window.partitionBy(*keys).orderBy(SLICE)
    ends = ends.select(*keys, SLICE, F.lag("_hi").over(e).alias("_before"), F.lead("_lo").over(e).alias("_after"))
    out = join_null_safe(placed, ends, [*keys, SLICE])
    return out.select(*df.columns, F.coalesce("prev_at", "_before").alias("prev_at"), F.coalesce("next_at", "_after").alias("next_at"))

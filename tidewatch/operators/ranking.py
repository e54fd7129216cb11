"""Global order without one global partition: cumulative sums, quantiles, row numbers.

Equal values are merged first, in one pass over the rows. The distinct values are cut
into ranges of similar number (drawn by Spark, on key and value), summed per slice
and accumulated over the slices; inside a slice a window finishes the work.
The ranges only balance the slices, so the results are exact. Row numbers come
from ranges of whole (value, ties) tuples, so a busy instant is cut like
anything else; the k highest rows come from a bound found in histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import stored

SLICES = 32            # at least this many slices
MAX_SLICES = 4096      # for one order over all rows


def slice_count(df: DataFrame, most: int) -> int:
    """As many slices as the session uses shuffle partitions, within bounds."""
    return max(SLICES, min(most, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cumulative(df: DataFrame, value: str, measures: dict[str, Column], keys: list[str] | None = None,
               descending: bool = False, slices: int | None = None) -> DataFrame:
    """One row per (keys, value): each measure, `before_*`, `total_*` and `previous`.

    `before_m` sums measure m over all values earlier in the order, `total_m`
    over all values of the key; `previous` is the value just earlier. `keys`
    must have few combinations (features, models, splits). Null values are left
    out. The merged values are written once: ranges are drawn anew in each run of a
    plan, and several readers need the same ones.
    """
    keys = keys or []
    merged = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[m.alias(n) for n, m in measures.items()])
    laid = merged.repartitionByRange(slices or slice_count(df, MAX_SLICES), *keys, value)
    g = stored(laid.withColumn("_slice", F.spark_partition_id()), "merged")
    order = F.col(value).desc() if descending else F.col(value).asc()
    slice_order = F.col("_slice").desc() if descending else F.col("_slice").asc()
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over_slices = Window.partitionBy(*keys).orderBy(slice_order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.min(value) if descending else F.max(value)
    last_before = (F.min if descending else F.max)("_last").over(over_slices)
    per_slice = g.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(n) for n in measures], last.alias("_last"))
    base = per_slice.select(  # at most `slices` rows per key
        *keys, "_slice", last_before.alias("_carry"),
        *[F.coalesce(F.sum(n).over(over_slices), F.lit(0)).alias(f"_b_{n}") for n in measures],
        *[F.sum(n).over(Window.partitionBy(*keys)).alias(f"total_{n}") for n in measures])
    run = g.select("*", F.last(value).over(inside).alias("_prev"),
                   *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_r_{n}") for n in measures])
    return run.join(F.broadcast(base), [*keys, "_slice"]).select(
        *keys, value, *measures,
        *[(F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(f"before_{n}") for n in measures],
        *[f"total_{n}" for n in measures], F.coalesce("_prev", "_carry").alias("previous"))


def _at_rank(value: str, rank: Column) -> Column:
    hit = (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
    return F.max(F.when(hit, F.col(value)))


def quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None,
              slices: int | None = None, rows: Column | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per key, array column `q`.

    `rows` sums the rows that a line stands for, where equal values are merged already.
    """
    keys = keys or []
    c = cumulative(df, value, {"n": F.count(F.lit(1)) if rows is None else rows}, keys, slices=slices)
    cols = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total_n") - 1)
        cols += [_at_rank(value, F.floor(pos)).alias(f"lo{i}"), _at_rank(value, F.ceil(pos)).alias(f"hi{i}")]
    agg = c.groupBy(*keys).agg(F.max("total_n").alias("n"), *cols)
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi, frac = F.col(f"lo{i}"), F.col(f"hi{i}"), pos - F.floor(pos)
        out.append(lo + (hi - lo) * frac)
    return agg.select(*keys, "n", F.array(*out).alias("q"))


def nearest_rank(df: DataFrame, value: str, probs: list[float], slices: int | None = None) -> DataFrame:
    """Exact nearest-rank quantiles, one column `q0, q1, ...` per probability."""
    c = cumulative(df, value, {"n": F.count(F.lit(1))}, slices=slices)
    return c.agg(F.max("total_n").alias("n"), *[
        _at_rank(value, F.round(F.lit(float(p)) * (F.col("total_n") - 1))).alias(f"q{i}")
        for i, p in enumerate(probs)])


def ordered(df: DataFrame, order: list[str], slices: int | None = None) -> DataFrame:
    """`df` in (order) order as a stored table, with `_slice` and the row's place `_own` in it from 0.

    Spark samples tuples of all columns of `order` for the ranges, so rows of one
    value are parted by the columns after it. The table is written once: ranges
    are drawn anew in each run of a plan, and both readers need the same ones.
    """
    n = slices or slice_count(df, MAX_SLICES)
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(laid.select("*", F.spark_partition_id().alias("_slice"), own.alias("_own")), "ordered")


def numbered(df: DataFrame, at: str, ties: list[str], slices: int | None = None,
             name: str = "row_id") -> DataFrame:
    """Contiguous 0-based row numbers in (at, ties) order, without one big sort task."""
    laid = ordered(df, [at, *ties], slices)
    over = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = (laid.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))  # one row per slice
            .select("_slice", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base")))
    return (laid.join(F.broadcast(base), "_slice")
            .withColumn(name, F.col("_own") + F.col("_base")).drop("_slice", "_own", "_base"))


BINS = 1024  # of one histogram level


def rank_bound(df: DataFrame, value: Column, k: int, bins: int = BINS):
    """A value that at least k rows reach (all, if there are fewer: None), and not many more than k.

    Histograms level by level: the bin that holds rank k is cut again, until it has
    at most k rows or one value. Nulls are below everything. A level sends one row a
    bin to the driver, and its bounds are values of the data, so nothing is rounded.
    """
    rows = df.select(value.alias("v")).filter(F.col("v").isNotNull())
    span = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi, above = span["lo"], span["hi"], 0
    if span["n"] <= k:
        return None
    while lo < hi:
        bin_ = F.least(F.floor((F.col("v") - F.lit(lo)) / (F.lit(hi) - F.lit(lo)) * bins), F.lit(bins - 1))
        found = (rows.filter(F.col("v").between(F.lit(lo), F.lit(hi))).groupBy(bin_.alias("b"))
                 .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        for r in sorted(found, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["n"] <= max(k, bins) or (r["lo"], r["hi"]) == (lo, hi):
            return r["lo"]
        lo, hi = r["lo"], r["hi"]
    return lo


def highest(df: DataFrame, value: Column, k: int) -> DataFrame:
    """The rows of `df` among which the k highest by `value` are, and few others; order and cut them."""
    bound = rank_bound(df, value, k)
    return df if bound is None else df.filter(value >= F.lit(bound))

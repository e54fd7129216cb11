"""Packing by cutting-stock column generation.

Documents are cut into full sequences and a rest. The rests form a histogram of length
classes, and how many sequences of which mix of classes are needed is the cutting-stock
problem: a linear program over patterns, whose columns a knapsack dynamic program
prices by the duals (revised simplex in numpy). The program has at most
`capacity / step` rows whatever the size of the corpus, so it is solved in the driver.
Rounded down, its patterns are dealt to the pieces by their rank within their class;
what rounding leaves is filled largest first, on counts again.

Only lengths and checksums leave the tokenising pass. Ranks come from hash buckets that
are numbered apart, so one length that a third of the pieces have is no single task.

Defined cases: a null or empty text is the closing id alone; a null id is kept; repeated
rows are packed one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import batches, gapless, stored, table, told_apart
from tidewatch.llm.tokens import default_path, token_ids

CAPACITY = 4096
#: The id that closes each document.
CLOSING_ID = 2
#: Lengths are rounded up to this many ids in the program: 256 classes.
STEP = 16
#: The program ends when it is proven to be within this share of the optimum.
GAP = 1e-3

_KINDS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of `docs` (doc_id, text): full sequences first, then the rest."""
    path = tokenizer or default_path()

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tok = token_ids(path)
        for part in parts:
            ids, at = tok.encode(part.column("text"))
            wide = np.insert(ids, at[1:], CLOSING_ID).astype("<u4")
            at = at + np.arange(len(at))
            for doc_id, begin, end in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for start in range(begin, end, capacity):
                    to = min(end, start + capacity)
                    yield doc_id, start - begin, to - start, zlib.crc32(wide[start:to]), end - begin

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(lambda parts: batches(_KINDS, rows(parts)),
                          "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable mix of classes that fits `room`."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = np.searchsorted(sizes, c, side="right")  # sizes ascend
        best[c], took[c] = best[c - 1], -1
        if fit:
            worth = best[c - sizes[:fit]] + values[:fit]
            k = int(np.argmax(worth))
            if worth[k] > best[c]:
                best[c], took[c] = worth[k], k
    mix, c = np.zeros(len(sizes)), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            mix[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[room]), mix


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: how many of each size) and how often each is used, the linear program's optimum.

    Sizes ascend and fit `room`. Column generation: a pattern enters while one of value over 1
    exists; the value of the best also bounds the optimum from below, which ends the work.
    """
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))  # columns: patterns, at first of one size each
    inverse = np.diag(1.0 / np.diag(basis))
    cost = np.ones(m)  # 0 for a column that only leaves a surplus
    used, bound = demand / np.diag(basis), 0.0
    for _ in range(50 * m + 100):
        dual = np.einsum("i,ij->j", cost, inverse)
        worst = int(np.argmin(dual))
        if dual[worst] < -1e-9:
            column, c = np.zeros(m), 0.0
            column[worst] = -1
        else:
            value, column = _price(np.maximum(dual, 0), sizes, room)
            needed = float((cost * used).sum())
            bound = max(bound, needed / max(value, 1.0))
            if needed <= bound * (1 + gap):
                break
            c = 1.0
        along = np.einsum("ij,j->i", inverse, column.astype(float))
        up = along > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = used[up] / along[up]
        out = int(np.argmin(ratio))
        step = ratio[out]
        used -= step * along
        used[out] = step
        np.maximum(used, 0, out=used)
        pivot = inverse[out] / along[out]
        inverse -= np.outer(along, pivot)
        inverse[out] = pivot
        basis[:, out], cost[out] = column, c
    real = cost > 0
    return basis[:, real].T.astype(np.int64), used[real]


def plan(histogram: dict[int, int], room: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Whole-number patterns for all pieces: ({class: how many}, sequences). Classes are in steps."""
    left = {s: n for s, n in histogram.items() if n > 0}
    if not left:
        return []
    sizes = np.array(sorted(left))
    patterns, used = cutting_stock(sizes, np.array([float(left[s]) for s in sizes.tolist()]), room, gap)
    out = []
    for row, times in zip(patterns, np.floor(used + 1e-6).astype(np.int64).tolist(), strict=True):
        mix = {int(s): int(k) for s, k in zip(sizes, row, strict=True) if k > 0}
        times = min([times, *(left[s] // k for s, k in mix.items())])
        if times > 0 and mix:
            out.append((mix, times))
            for s, k in mix.items():
                left[s] -= k * times
    while any(left.values()):
        free, mix = room, {}
        for s in sorted(left, reverse=True):
            if k := min(left[s], free // s):
                mix[s] = k
                free -= k * s
        times = min(left[s] // k for s, k in mix.items())
        out.append((mix, times))
        for s, k in mix.items():
            left[s] -= k * times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, step: int = STEP, gap: float = GAP) -> DataFrame:
    """Give each piece of a stored table (see `pieces`) its sequence_id and offset."""
    spark = cut.sparkSession
    room = capacity // step
    cut = cut.withColumn("_class", F.ceil(F.col("length") / step).cast("int"))
    histogram = {r["_class"]: r["n"] for r in cut.groupBy("_class").agg(F.count("*").alias("n")).collect()}  # at most `room` rows
    runs, sequence, given = [], 0, dict.fromkeys(histogram, 0)
    for mix, times in plan(histogram, room, gap):
        slot = 0
        for size in sorted(mix, reverse=True):
            runs.append((size, given[size], given[size] + mix[size] * times, sequence, mix[size], slot))
            given[size] += mix[size] * times
            slot += mix[size]
        sequence += times
    deal = spark.createDataFrame(runs, "_c int, _lo long, _hi long, _first long, _each long, _slot long")
    ranked = gapless(cut, ["_class"], ["row_no"], "_rank", n_rows=sum(histogram.values()))
    # `deal` has a few rows a pattern, and there are at most twice as many patterns as classes
    dealt = ranked.join(F.broadcast(deal), (F.col("_class") == F.col("_c")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    turn = F.col("_rank") - F.col("_lo")
    placed = dealt.withColumns({
        "sequence_id": F.col("_first") + F.floor(turn / F.col("_each")).cast("long"),
        "_at": F.col("_slot") + turn % F.col("_each"),
    })
    before = Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(stored(told_apart(pieces(docs)), "token-pieces"))


def op2_column_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_column_packing": op2_column_packing}

"""Ranked lexical search by presence masks.

Every item of a query set is ranked against all documents. A first pass over the texts keeps,
per document, its number of terms and how often it holds each term of the query set (a table
without texts); document frequencies and corpus sums come from that table. A second pass takes
its rows in blocks. For each item, one bit a term is set in the mask of every document of the block that
holds the term; documents of equal masks are a group, whose score is at most the sum of the
largest score that each of its terms has in the block. Groups are evaluated from the largest
bound down, until the bound is below the last of the best documents found so far in the task;
a group whose bound equals it is still evaluated, for ties go by document id. The best of all
tasks are merged in two steps. Scores are whole numbers; nothing is estimated.

The terms of the query set are held by every task, so a query set of over ITEM_BYTES is dealt
into blocks of items, one after the other.

Defined cases: null or term-less texts and items have no terms, match nothing and are not
counted; repeated items are ranked once, items of one id with other texts each by itself;
repeated document rows are documents of their own; a null document id comes last among equal
scores; empty tables give no rows; other columns are not read. Very long texts are cut between
terms and read piece by piece.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, table

TOP = 10
#: Text of the items that are searched at once.
ITEM_BYTES = 16 << 20
#: Documents and their terms that one block may have.
BLOCK_DOCS, BLOCK_TERMS = 4096, 2_000_000
#: Bytes of a text that are cut into terms at once.
PIECE = 4 << 20
#: Lots into which the tasks' best are merged first.
LOTS = 64
#: A-Z lowered; ASCII other than letters and digits parts terms.
_SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    cleared = (text or "").encode().translate(_SIGNS)
    at = 0
    while at < len(cleared):
        to = cleared.find(b" ", at + PIECE)
        to = len(cleared) if to < 0 else to
        yield cleared[at:to].split()
        at = to


def presence(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, held, times): all terms of a document, and which of the known ones it holds how often."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.get
        for part in parts:
            rows = []
            for text in part.column("text").to_pylist():
                n, found = 0, []
                for some in terms(text):
                    n += len(some)
                    at = np.fromiter(map(number, some, repeat(-1)), np.int32, len(some))
                    found.append(at[at >= 0])
                held, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32),) * 2
                rows.append((n, held, times.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()),
                 *[pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (1, 2)]], names=["doc_id", "n", "held", "times"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n long, held array<int>, times array<int>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Block:
    """Documents with their terms, by document and by term."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, sizes: np.ndarray, held: np.ndarray, scores: np.ndarray, known: int) -> None:
        self.ids, self.no_id, self.held, self.scores = ids, no_id, held, scores
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(held, kind="stable")
        self.docs = np.repeat(np.arange(len(ids)), sizes)[order]
        self.term_at = np.searchsorted(held[order], np.arange(known + 1))
        self.most = np.zeros(known, np.int64)
        np.maximum.at(self.most, held, scores)

    def masks(self, wanted: list[int]) -> np.ndarray:
        """A row a document: the bits of the terms in `wanted` that it holds."""
        found = np.zeros((len(self.ids), -(-len(wanted) // 64)), np.uint64)
        for bit, term in enumerate(wanted):
            found[self.docs[self.term_at[term]:self.term_at[term + 1]], bit // 64] |= np.uint64(1 << bit % 64)
        return found

    def groups(self, wanted: list[int], often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents with any of the terms in order of their masks' bounds, where each mask's begin, and the bounds."""
        found = self.masks(wanted)
        some = np.flatnonzero(found.any(axis=1))
        found = found[some]
        keys = found[:, 0] if found.shape[1] == 1 else np.ascontiguousarray(found).view(f"V{8 * found.shape[1]}")[:, 0]
        _, first, of, sizes = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        bits = np.unpackbits(found[first].view(np.uint8).reshape(len(first), -1), axis=1, bitorder="little")[:, :len(wanted)]
        bounds = bits.astype(np.int64) @ (often * self.most[wanted])
        order = np.argsort(-bounds, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return some[np.argsort(place[of], kind="stable")], np.concatenate([[0], np.cumsum(sizes[order])]), bounds[order]

    def score(self, docs: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Exact scores; `often`: how often the item has each known term."""
        start, size = self.at[docs], self.at[docs + 1] - self.at[docs]
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(start - end + size, size)
        return np.add.reduceat(often[self.held[at]] * self.scores[at], end - size)


class Best:
    """The best documents of an item so far: scores, ids, and whether there is an id."""

    def __init__(self, top: int) -> None:
        self.top, self.rows = top, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def floor(self) -> int:
        """A bound below this cannot matter any more."""
        return int(self.rows[0][-1]) if len(self.rows[0]) == self.top else 1

    def add(self, *rows: np.ndarray) -> None:
        rows = tuple(np.concatenate(x) for x in zip(self.rows, (x[rows[0] >= self.floor()] for x in rows), strict=True))
        order = np.lexsort((rows[1], rows[2], -rows[0]))[:self.top]
        self.rows = tuple(x[order] for x in rows)


def search(block: Block, wanted: list[int], often: np.ndarray, dense: np.ndarray, best: Best) -> int:
    """Bring a block's documents into `best`; how many of them were scored."""
    wanted_here = [n for n, t in enumerate(wanted) if block.most[t] > 0]
    if not wanted_here:
        return 0
    docs, starts, bounds = block.groups([wanted[n] for n in wanted_here], often[wanted_here])
    done, least = 0, best.top
    while done < len(bounds) and bounds[done] >= best.floor():
        # whole groups, at least as many documents as were scored so far, none below the bound
        to = max(done + 1, int(np.searchsorted(starts, starts[done] + least, "right")) - 1)
        to = min(to, int(np.searchsorted(-bounds, -best.floor(), "right")))
        some = docs[starts[done]:starts[to]]
        best.add(block.score(some, dense), block.ids[some], block.no_id[some])
        done, least = to, max(least, int(starts[to]))
    return int(starts[done])


def _blocks(parts: Iterator[pa.RecordBatch], weights: np.ndarray, norm) -> Iterator[Block]:
    ids, no_id, sizes, held, scores, n_terms = [], [], [], [], [], 0

    def made() -> Block:
        return Block(np.concatenate(ids), np.concatenate(no_id), np.concatenate(sizes), np.concatenate(held), np.concatenate(scores), len(weights))

    for part in parts:
        terms_of, times = part.column("held").flatten().to_numpy(), part.column("times").flatten().to_numpy().astype(np.int64)
        size = part.column("held").value_lengths().to_numpy()
        m = np.array([norm(n) for n in part.column("n").to_pylist()], np.int64)
        ids.append(part.column("doc_id").fill_null(0).to_numpy())
        no_id.append(np.asarray(part.column("doc_id").is_null()))
        sizes.append(size)
        held.append(terms_of)
        scores.append(weights[terms_of] * ((1_000_000_000 * times) // (1000 * times + 8 * np.repeat(m, size))))
        n_terms += len(terms_of)
        if sum(map(len, ids)) >= BLOCK_DOCS or n_terms >= BLOCK_TERMS:
            yield made()
            ids, no_id, sizes, held, scores, n_terms = [], [], [], [], [], 0
    if n_terms:
        yield made()


def _ranked(docs: DataFrame, items: DataFrame, top: int) -> DataFrame | None:
    """(item_no, rank, doc_id, score) for one block of items (item_no, text)."""
    counted = [(r["item_no"], Counter(t for some in terms(r["text"]) for t in some)) for r in items.collect()]
    known = {t: n for n, t in enumerate(sorted({t for _, c in counted for t in c}))}
    if not known:
        return None
    held = stored(presence(docs, known), "presence").where("n > 0")
    documents, total = held.agg(F.count("*"), F.sum("n")).first()
    holding = dict(held.select(F.explode("held").alias("t")).groupBy("t").agg(F.count("*")).collect())  # a row a known term at most
    weights = np.array([weight(documents, holding.get(n, 0)) for n in range(len(known))], np.int64)
    sets = [(no, [known[t] for t in c], np.array(list(c.values()), np.int64)) for no, c in counted if c]
    shared = docs.sparkSession.sparkContext.broadcast((weights, sets))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weights, sets = shared.value
        best = [Best(top) for _ in sets]
        dense = np.zeros(len(weights), np.int64)
        for block in _blocks(parts, weights, lambda n: 25 + 75 * n * documents // total):
            for (_, wanted, often), found in zip(sets, best, strict=True):
                dense[wanted] = often
                search(block, wanted, often, dense, found)
                dense[wanted] = 0
        lot = TaskContext.get().partitionId() % LOTS
        for (no, _, _), found in zip(sets, best, strict=True):
            if n := len(found.rows[0]):
                score, ids, no_id = found.rows
                yield pa.RecordBatch.from_arrays([pa.array([no] * n, pa.int64()), pa.array([lot] * n, pa.int32()), pa.array(ids, mask=no_id), pa.array(score)],
                                                 names=["item_no", "lot", "doc_id", "score"])

    rows = held.mapInArrow(run, "item_no long, lot int, doc_id long, score long")
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_no", "lot").orderBy(*by))).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_no").orderBy(*by))).where(F.col("rank") <= top)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each of `items` (item_id, text) with a score above 0."""
    one = items.select("item_id", F.col("text").cast("string").alias("text")).dropDuplicates()
    numbered = stored(one.withColumn("item_no", F.monotonically_increasing_id()), "search-items")
    size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // ITEM_BYTES)
    found = [_ranked(docs, numbered.where(F.pmod(F.xxhash64("item_no"), F.lit(n_blocks)) == b), top) for b in range(n_blocks)]
    found = [x for x in found if x is not None]
    if not found:
        return numbered.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, found).join(numbered.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")


def op12_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_mask_search": op12_mask_search}

_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = {"op12_mask_search": f"""
WITH items AS (SELECT row_number() OVER () AS no, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT no, term, count(*) AS often FROM (SELECT no, unnest({_CUT}) AS term FROM items) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS row, doc_id, {_CUT} AS w FROM documents),
c AS (SELECT count(*)::bigint AS documents, sum(len(w))::bigint AS total FROM d WHERE len(w) > 0),
h AS (SELECT row, term, count(*)::bigint AS times FROM (SELECT row, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(documents) + 2)::double / (2 * count(*) + 1)::double))::bigint AS weight FROM h, c GROUP BY term),
m AS (SELECT row, doc_id, 25 + (75 * len(w)::bigint * documents) // total AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT no, row, sum(often * weight * ((1000000000 * times) // (1000 * times + 8 * m)))::bigint AS score
      FROM h JOIN f USING (term) JOIN m USING (row) JOIN q USING (term) GROUP BY ALL),
r AS (SELECT no, doc_id, score, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST)::int AS rank FROM s JOIN m USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id::bigint AS doc_id, score FROM r JOIN items USING (no) WHERE rank <= 10"""}

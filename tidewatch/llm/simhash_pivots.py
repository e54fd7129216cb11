"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint has a bit for each bit that over half of its shingle hashes set.
Fingerprints link when at most `bits` of their 64 bits differ, and linked documents form
components. Equal fingerprints are merged before anything else, so copies cost nothing.

Two fingerprints within 3 bits agree on 3 of 6 blocks of bits, so each goes to 20 keys of
some 32 bits, and only those that share a key meet. There the Hamming distances to fixed
reference fingerprints (the pivot table) are compared: the distances to one pivot of a pair
within 3 bits differ by 3 at most, so pairs whose tables differ by more in any coordinate
are discarded, and survivors are verified bit by bit. Of the links found in a group only a
spanning forest leaves it. A crowded key is cut into chunks, and every pair of chunks is a
group of its own, so no task holds an unbounded group and no pair is lost.

Components come from the forest edges by repeated contraction to the smallest neighbour;
each round is written to the shared folder, which cuts lineage. Once few edges (LOCAL) are
left, one task joins them, so the driver is spared rounds of near-empty tasks.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and links
like any other; a null id never names a component unless all its ids are null; repeated
rows share a component; an empty table gives no rows; other columns are kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, table

SHINGLE = 3
SEED = 42
BITS = 3
#: Bit ranges (from, to) of a fingerprint; any 3 of the 6 make a key.
BLOCKS = ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))
PIVOTS = 32
#: Members of a key above which it is cut into chunks of this size.
CHUNK = 1024
#: Edges (16 bytes each) that one task joins by itself, whatever the corpus.
LOCAL = 1 << 16


def pivot_table(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, scattered by a fixed rule."""
    at = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = (at ^ (at >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    at = (at ^ (at >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return at ^ (at >> np.uint64(31))


def simhash(text: str | None) -> int:
    """Fingerprint of one text, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: only A-Z, and white space as asked
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    count, n, ones = np.zeros(64, np.int64), 0, []
    for s in shingles:
        ones.append(digest(s, SEED))
        if len(ones) == 65_536:
            count, n, ones = count + _bit_counts(ones), n + len(ones), []
    if ones:
        count, n = count + _bit_counts(ones), n + len(ones)
    return int(np.packbits(2 * count > n).view(">u8")[0])


def _bit_counts(hashes: list[int] | np.ndarray) -> np.ndarray:
    rows = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return rows.sum(axis=0, dtype=np.int64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Fingerprint of shingles by their hashes, unsigned."""
    count = sum((_bit_counts(hashes[at:at + 65_536]) for at in range(0, len(hashes), 65_536)), np.zeros(64, np.int64))
    return int(np.packbits(2 * count > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """(doc_id, fp, and the longs in `more`): fp is the fingerprint as a signed long."""
    more = more or []

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = np.array([simhash(t) for t in part.column("text").to_pylist()], np.uint64)
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(fps.view(np.int64))], names=[*names, "fp"])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{c} long" for c in [*(c for c in cut.columns if c != "text"), "fp"])
    return cut.mapInArrow(run, kinds)


def _keys(fp: Column) -> Column:
    """The keys of a fingerprint: which blocks, and their bits."""
    out = []
    for number, chosen in enumerate(combinations(BLOCKS, 3)):
        mask = sum(((1 << (to - at)) - 1) << at for at, to in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(number).alias("blocks"), fp.bitwiseAND(F.lit(mask)).alias("part")))
    return F.array(*out)


class _Forest:
    """Sets that are joined; `find` gives the smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, bits: int, pivots: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links inside each group; rows of a group stand together.

    `side`: where a group is a pair of chunks, which of them a row is of; only rows of different
    sides are compared there (side -1: all with all).
    """
    dist = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    forest, n = _Forest(len(fps)), len(fps)
    left, label, stale = np.arange(n), np.arange(n), False
    for gap in range(1, n):
        left = left[left + gap < n]
        left = left[group[left] == group[left + gap]]
        if not len(left):
            return
        a, b = left, left + gap
        if stale and gap & (gap - 1) == 0:  # now and then, pairs that are joined already are put aside
            label[left] = label[left + gap] = -1
            rows = np.flatnonzero(label < 0)
            label[rows], stale = [forest.find(r) for r in rows.tolist()], False
        apart = ((side[a] < 0) | (side[a] != side[b])) & (label[a] != label[b])
        a, b = a[apart], b[apart]
        for k in range(len(pivots)):  # discard by one coordinate after the other
            near = np.abs(dist[a, k] - dist[b, k]) <= bits
            a, b = a[near], b[near]
            if not len(a):
                break
        near = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            if forest.join(x, y):
                stale = True
                yield x, y


def links(distinct: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b), a < b, that connect what links among distinct fingerprints (fp)."""
    if bits > 3:
        raise ValueError("6 blocks, 3 of them equal: at most 3 bits")
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"))).alias("key")).select("fp", "key.blocks", "key.part")
    crowd = keyed.groupBy("blocks", "part").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    crowd = crowd.select(F.col("blocks").alias("_b"), F.col("part").alias("_p"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    # fingerprints alone under a key meet nobody there
    member = keyed.join(crowd, (F.col("blocks") == F.col("_b")) & (F.col("part") == F.col("_p"))).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    group = member.select("fp", "blocks", "part", "own", other.alias("other"))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side")
    dealt = group.select("fp", "blocks", "part", low, high, side)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "blocks", "part", "low", "high").sortWithinPartitions("blocks", "part", "low", "high", "fp")
    pivots = pivot_table()
    columns = ("blocks", "part", "low", "high")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last group, which may go on

        def done(rows: np.ndarray) -> pa.RecordBatch | None:
            new = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
            number = np.concatenate([[0], np.cumsum(new)])
            fps = rows[:, 4].copy().view(np.uint64)
            found = list(_links(fps, number, rows[:, 5], bits, pivots))
            if not found:
                return None
            x, y = (rows[list(c), 4] for c in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for part in parts:
            rows = np.stack([part.column(c).to_numpy().astype(np.int64) for c in (*columns, "fp", "side")], axis=1)
            rows = np.concatenate([*held, rows])
            last = (rows[:, :4] != rows[-1, :4]).any(axis=1)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            held = [rows[cut:]]
            if cut and (out := done(rows[:cut])) is not None:
                yield out
        if held and len(held[0]) and (out := done(held[0])) is not None:
            yield out

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def _grown(edges: DataFrame) -> DataFrame:
    """(node, up) for every node of `edges`, at most LOCAL of them: one task joins them, up is the root."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([p.column(c).to_numpy() for c in ("a", "b")], axis=1) for p in parts]
        nodes, number = np.unique(np.concatenate(ends) if ends else np.zeros((0, 2), np.int64), return_inverse=True)
        forest = _Forest(len(nodes))
        for x, y in number.reshape(-1, 2).tolist():
            forest.join(x, y)
        roots = nodes[np.array([forest.find(x) for x in range(len(nodes))], np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "up"])

    return edges.coalesce(1).mapInArrow(run, "node long, up long")


def contract(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node of its component.

    Rounds go on while more than LOCAL edges are left; the rest is joined at once.
    """
    edges = stored(edges.where("a <> b").select("a", "b"), "edges-0")
    nodes = None
    turn = 0
    while n := edges.count():
        turn += 1
        if n <= LOCAL:
            up = stored(_grown(edges), f"parents-{turn}")
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
            jump = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))  # parents have parents
            up = stored(up.join(jump, "up").select("node", F.col("upper").alias("up")), f"parents-{turn}")
        if nodes is None:
            nodes = up.select("node", F.col("up").alias("root"))
        else:
            step = up.select(F.col("node").alias("root"), "up")
            nodes = stored(nodes.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"roots-{turn}")
        if n <= LOCAL:
            break
        one = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        two = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(one, "a").join(two, "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
        edges = stored(moved.where("a <> b").distinct(), f"edges-{turn}")
    if nodes is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes


def contract_more(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """`roots`, as `contract` gives them, after the further `edges`, a stored table: only the roots that these touch meet again."""
    if edges.isEmpty():
        return roots
    one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    moved = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    step = contract(moved).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    grown = roots.join(step, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root"))
    first = step.join(roots.select("node"), F.col("_node") == F.col("node"), "left_anti").select(F.col("_node").alias("node"), F.col("_root").alias("root"))
    return stored(grown.unionByName(first), "roots")


def components(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """`prints`, a stored table of (doc_id, fp), with root (a fingerprint) and component_id."""
    return with_components(prints, lambda distinct: contract(links(distinct, bits)))


def with_components(prints: DataFrame, rooted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`prints` with the components whose (node, root) `rooted` finds among its distinct fp."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = rooted(distinct)
    grown = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grown.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    named = stored(grown.join(named, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "root", "component_id"), "components")
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Fingerprint and component of every document."""
    found = components(stored(fingerprints(docs), "simhashes"), bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """`docs` with all its columns, one row of each component: one with the smallest id.

    Of rows with that id, the one whose text has the smallest hash stays; a component without
    ids keeps one row likewise.
    """
    prints = stored(fingerprints(docs, [row_keys()[1].alias("text_key")]), "simhashes")
    return keep_one(docs, components(prints, bits))


def row_keys() -> tuple[Column, Column]:
    """What tells rows of documents apart: the id, and a hash of the text."""
    return (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))),
            F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of `docs` for each component of `found` (doc_id, text_key, root, component_id); rows stay as they are."""
    row_id, row_text = row_keys()
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select(
        F.coalesce("k.doc_id", F.lit(-(1 << 63))).alias("keep_id"), F.col("k.text_key").alias("keep_text"))
    rows = docs.select(F.struct("*").alias("row"), row_id.alias("row_id"), row_text.alias("row_text")).join(
        kept.distinct(), (F.col("row_id") == F.col("keep_id")) & (F.col("row_text") == F.col("keep_text")))
    return rows.dropDuplicates(["row_id", "row_text"]).select("row.*")


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash_pivots": op10_simhash_pivots}

"""Near-duplicates by the five-word rule: Jaccard similarity of shingle sets of 0.8 or more.

A document is the set of its 5-word shingles; documents of equal sets are merged first, so
copies cost nothing. The first candidates are those of SimHash: a set's fingerprint has a bit for
each bit that over half of its shingle hashes set, and fingerprints that differ in 3 bits at most
meet by blocks and pivot tables as in `simhash_pivots`. Pairs at 0.8 mostly lie further apart (some
10 bits), beyond what blocks of 64 bits can find, so min-hashes add what SimHash does not reach: BANDS
keys of ROWS samples each. A pair of similarity s shares no key with chance (1 - s^6)^48, which is
5e-7 at 0.8 and less above. Every candidate is verified on the shingle sets themselves, so nothing below 0.8 links.

No crowd makes all its pairs. Each member of a key is first held against one member, the
smallest, which is mostly the same for all keys of a crowd; what that links is contracted. Keys
whose members then still differ are settled pair by pair if they have at most SMALL members.
The members of larger keys take part in an exact join by prefixes: shingles are ordered by how
many of these sets hold them, rarest first. Two sets that are 0.8 alike share one of the first
n - ceil(0.8 n) + 1 shingles of the larger and of the first n - ceil(8/9 n) + 1 of the smaller, early
enough for what is left to suffice; so a passage that a crowd shares, common as it is, brings
nobody together unless there is hardly anything else. Members of a common shingle are again held
against one member first, in ROUNDS rounds with contraction between them, and only pairs of a
shingle whose components still differ after that are verified, all of them.

Defined cases: words are split at ASCII white space, only A-Z is lowered; a text of fewer than
five words is one shingle; null and empty texts and those without words have the empty set and
are alike; repeated rows and equal texts are alike; null ids are allowed, a group without any
other keeps one row; of rows that tie for the smallest id the text with the smallest hash stays;
an empty table gives no rows; all columns of the caller stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import simhash_pivots
from tidewatch.llm.common import stored
from tidewatch.llm.simhash_pivots import contract, contract_more, keep_one, row_keys, with_components

SHINGLE = 5
SEED = 42
#: Links are at least LEAST[0] / LEAST[1] alike.
LEAST = (4, 5)
BANDS, ROWS = 48, 6
#: Members of a key up to which its pairs are verified one by one.
SMALL = 24
#: Rounds in which the members of a common shingle are held against one of them.
ROUNDS = 2
#: Shingles that are sampled at once.
BLOCK = 1024

_AT = np.random.default_rng(SEED)
_FLIP = _AT.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]
_TIMES = (_AT.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]
_MIX = _AT.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest, joined = xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    return np.unique(np.fromiter((digest(s, SEED) for s in joined), np.uint64, len(words) - SHINGLE + 1))


def band_keys(found: np.ndarray) -> np.ndarray:
    """Keys of a shingle set as signed longs; an empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least, short = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), BLOCK):
        drawn = short[None, at:at + BLOCK] ^ _FLIP
        drawn *= _TIMES
        np.minimum(least, drawn.min(axis=1), out=least)
    key = (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(27))).view(np.int64)


def alike(one: np.ndarray, two: np.ndarray) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both * LEAST[1] >= LEAST[0] * (len(one) + len(two) - both)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, n, sim, keys): fp names the shingle set, n is its size, sim its SimHash, keys are its band keys."""
    import xxhash

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps, sizes, sims, keys = [], [], [], []
            for text in part.column("text").to_pylist():
                found = shingles(text)
                fps.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                sims.append(simhash_pivots.fingerprint_of(found))
                keys.append(band_keys(found))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 pa.array(np.array(sims, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_key", "fp", "n", "sim", "keys"])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_keys()[1].alias("text_key"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(run, "doc_id long, text_key long, fp long, n long, sim long, keys array<long>")


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """Candidates (a, b) by SimHash: sets of one fingerprint with the smallest of them, and that with those of linked fingerprints."""
    each = stored(sets.select("sim", "fp", "n").distinct(), "set-simhashes")
    one = each.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("one")).select(F.col("sim").alias("_s"), F.col("one.fp").alias("a"), F.col("one.n").alias("n_a"))
    same = each.join(one, F.col("sim") == F.col("_s")).select("a", "n_a", F.col("fp").alias("b"), F.col("n").alias("n_b"))
    near = simhash_pivots.links(each.select(F.col("sim").alias("fp")).distinct()).withColumnsRenamed({"a": "sim_a", "b": "sim_b"})
    two = one.select(F.col("_s").alias("_t"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    near = near.join(one, F.col("sim_a") == F.col("_s")).join(two, F.col("sim_b") == F.col("_t")).select("a", "n_a", "b", "n_b")
    return _ordered(same.unionByName(near).where(_sized("n_a", "n_b")))


def members(sets: DataFrame) -> DataFrame:
    """(key, fp, n) of keys that several sets share, with the key's smallest set as (centre, centre_n)."""
    keyed = sets.select("fp", "n", "keys").dropDuplicates(["fp"]).select(F.explode("keys").alias("key"), "fp", "n").distinct()
    one = keyed.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("one"), F.max("fp").alias("two")).where("one.fp <> two")
    one = one.select(F.col("key").alias("_k"), F.col("one.fp").alias("centre"), F.col("one.n").alias("centre_n"))
    return keyed.join(one, F.col("key") == F.col("_k")).drop("_k")


def _sized(one: str, two: str) -> Column:
    return F.least(one, two) * LEAST[1] >= F.greatest(one, two) * LEAST[0]


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def verified(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose sets in `of` (fp, found) are alike; each set is fetched once a pair."""

    def side(name: str) -> DataFrame:
        return of.select(F.col("fp").alias(name), F.col("found").alias(f"found_{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "found_a", "found_b")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [[np.frombuffer(x, np.uint64) for x in part.column(c).to_pylist()] for c in ("found_a", "found_b")]
            keep = pa.array([alike(x, y) for x, y in zip(*found, strict=True)], pa.bool_())
            yield part.select(["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a long, b long")


def found_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, found) of the sets in `wanted` (fp): the sorted shingle hashes, from one text of each set."""
    chosen = sets.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("text_key").alias("_key"))
    texts = docs.select(row_keys()[1].alias("_text"), F.col("text").cast("string").alias("text"))
    texts = texts.join(chosen.select("_key").distinct(), F.col("_text") == F.col("_key"), "left_semi").dropDuplicates(["_text"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in parts:
            found = [shingles(t).tobytes() for t in part.column("text").to_pylist()]
            fps = np.array([xxhash.xxh64_intdigest(x, SEED) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(found, pa.binary())], names=["fp", "found"])

    return texts.select("text").mapInArrow(run, "fp long, found binary")


def prefixes(of: DataFrame) -> DataFrame:
    """(token, fp, n, at, short): the shingles by which the sets of `of` (fp, found) have to meet.

    `at` is the place of the shingle in the order by rarity; short: it is in the prefix that does for the smaller set.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for fp, found in zip(part.column("fp").to_pylist(), part.column("found").to_pylist(), strict=True):
                all_ = np.frombuffer(found, np.int64)
                for at in range(0, len(all_), 1 << 16):
                    some = all_[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), fp)), pa.array(np.full(len(some), len(all_))), pa.array(some)], names=["fp", "n", "token"])

    each = stored(of.mapInArrow(run, "fp long, n long, token long"), "crowd-shingles")
    held = each.groupBy("token").agg(F.count("*").alias("df")).withColumnRenamed("token", "_t")
    order = Window.partitionBy("fp").orderBy("df", "token")
    placed = each.join(held, F.col("token") == F.col("_t")).withColumn("at", F.row_number().over(order) - 1)
    # a shingle that one set alone has brings it to nobody
    kept = placed.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * LEAST[0] / LEAST[1])) & (F.col("df") > 1))
    share = 2 * LEAST[0], LEAST[0] + LEAST[1]
    return kept.select("token", "fp", "n", "at", (F.col("at") <= F.col("n") - F.ceil(F.col("n") * share[0] / share[1])).alias("short"))


def _enough(one: str, two: str) -> Column:
    """Sets that meet first at these places can still have enough in common."""
    left = F.least(F.col(f"n{one}") - F.col(f"at{one}"), F.col(f"n{two}") - F.col(f"at{two}"))
    return _sized(f"n{one}", f"n{two}") & (left * sum(LEAST) >= (F.col(f"n{one}") + F.col(f"n{two}")) * LEAST[0])


def _of_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def crowd_links(of: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`edges` and their `roots` with what connects whatever is alike among the sets of `of` (fp, found), by their prefixes."""
    tokens = stored(prefixes(of), "crowd-prefixes")
    found = edges
    for turn in range(ROUNDS):
        parted = stored(_of_root(tokens, roots), f"crowd-parts-{turn}")
        drawn = F.struct(F.xxhash64("fp", F.lit(turn)).alias("by"), "fp", "n", "at", "root")
        centre = parted.where("short").groupBy("token").agg(F.min(drawn).alias("c")).select(
            F.col("token").alias("_t"), F.col("c.fp").alias("a"), F.col("c.n").alias("n_c"), F.col("c.at").alias("at_c"), F.col("c.root").alias("root_c"))
        star = parted.withColumnsRenamed({"n": "n_m", "at": "at_m"}).join(centre, (F.col("token") == F.col("_t")) & (F.col("root") != F.col("root_c")) & _enough("_m", "_c"))
        more = stored(verified(_ordered(star.select("a", F.col("fp").alias("b"))), of), f"crowd-links-{turn}")
        found, roots = found.unionByName(more), contract_more(roots, more)
    parted = stored(_of_root(tokens, roots), "crowd-parts")
    one = parted.where("short").select("token", F.col("fp").alias("a"), F.col("root").alias("ra"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    two = parted.select("token", F.col("fp").alias("b"), F.col("root").alias("rb"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    rest = one.join(two, "token").where((F.col("n_a") <= F.col("n_b")) & (F.col("ra") != F.col("rb")) & _enough("_a", "_b")).select("a", "b")
    more = stored(verified(_ordered(rest), of), "crowd-links-rest")
    return found.unionByName(more), contract_more(roots, more)


def linked(docs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that connect what is alike among the sets of `sets`, a stored table, and the (node, root) of their components."""
    shared = stored(members(sets), "shared-keys")
    near = stored(simhash_pairs(sets), "simhash-pairs")
    wanted = shared.select("fp").unionByName(near.select(F.col("a").alias("fp"))).unionByName(near.select(F.col("b").alias("fp"))).distinct()
    of = stored(found_sets(docs, sets, wanted), "shingles")
    stars = shared.where(_sized("n", "centre_n")).select(F.col("centre").alias("a"), F.col("fp").alias("b"))
    first = stored(verified(_ordered(near.unionByName(stars)), of), "links-drawn")
    roots = contract(first)
    parted = _of_root(shared.select("key", "fp", "n"), roots)
    sizes = parted.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("least"), F.max("root").alias("most"))
    apart = sizes.where("least <> most").select(F.col("key").alias("_k"), "members")
    parted = stored(parted.join(apart, F.col("key") == F.col("_k")).drop("_k"), "shared-parts")
    small = parted.where(F.col("members") <= SMALL).drop("members")
    one, two = (small.withColumnsRenamed({c: f"{c}_{side}" for c in ("fp", "n", "root")}) for side in "ab")
    pairs = one.join(two, "key").where((F.col("fp_a") < F.col("fp_b")) & (F.col("root_a") != F.col("root_b")) & _sized("n_a", "n_b"))
    more = stored(verified(_ordered(pairs.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))), of), "links-small")
    found, roots = first.unionByName(more), contract_more(roots, more)
    crowd = parted.where(F.col("members") > SMALL).select("fp").distinct()
    if crowd.isEmpty():
        return found, roots
    return crowd_links(stored(of.join(crowd, "fp", "left_semi"), "crowd-sets"), found, roots)


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges of `linked`."""
    return linked(docs, sets)[0]


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) of every row of `docs`."""
    sets = stored(shingle_sets(docs), "shingle-sets")
    return with_components(sets.drop("keys", "n", "sim"), lambda _: linked(docs, sets)[1])


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` with all its columns, one row of each component, chosen as by `simhash_pivots.dedup`."""
    return keep_one(docs, components(docs))

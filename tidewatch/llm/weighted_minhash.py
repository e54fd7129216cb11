"""Document fingerprints by consistent weighted sampling.

A text is the bag of its lower-case words, a word's weight is how often it occurs. For each
word and each of SAMPLES samples, gamma variables seeded by the word alone give a number
that falls as the weight grows; the word with the least number, with the step its weight
reached, is the sample. Two texts agree in a sample with probability equal to their
generalised Jaccard similarity (sum of the lesser over sum of the greater weights). The
fingerprint holds 16 bits of each sample, and likeness is the share that agree.

The query also fingerprints an edited text, made of the next document by descending id.
Documents are dealt into ranges of ids, the last document of each range goes to the next
range as well, and each range walks its documents in order: texts are shuffled once, and a
task holds two of them.

Defined cases: a null text is empty; texts without words have a fingerprint of their own
that equals no other; null ids rank below all others; of equal ids the one whose text sorts
first is the lower; a single document follows itself; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewatch.llm.common import batches, table

SAMPLES = 128
#: (word, weight) rows of samples that a Python worker keeps: 100 MB.
CACHE_ROWS = 100_000
_NULL_ID = -(1 << 63)


def _scatter(x: np.ndarray) -> np.ndarray:
    """Mixes `x` in place."""
    for turn, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(turn)
        x *= np.uint64(times)
    x ^= x >> np.uint64(31)
    return x


class Sampler:
    """Signatures of bags of words; rows of samples are kept for words that come again."""

    def __init__(self, samples: int = SAMPLES, rows: int = CACHE_ROWS) -> None:
        self.samples = samples
        #: Row of a word that occurs once, and of one that occurs several times: a word alone is looked up faster than a pair.
        self._once: dict[str, int] = {}
        self._more: dict[tuple[str, int], int] = {}
        self._kept, self._used = np.zeros((rows, samples), np.uint64), 0
        self._steps = (np.arange(1, 3 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(3, samples)

    def _draw(self, words: list[str], times: list[int]) -> np.ndarray:
        """For each term and sample: the number to be least in the high half, the sample's identity in the low.

        Terms that occur once come first.
        """
        seeds = np.array([xxh64_intdigest(w) for w in words], np.uint64)
        one, two, three = (_scatter(seeds[:, None] + s).astype("<u8", copy=False) for s in self._steps)

        def uniform(bits: np.ndarray, half: int) -> np.ndarray:
            """The upper 24 bits of one half (0: low, 1: high)."""
            x = (bits.view(np.uint32)[:, half::2] >> np.uint32(8)).view(np.int32).astype(np.float32)
            x += np.float32(0.5)
            x *= np.float32(2.0**-24)
            return x

        def gamma(bits: np.ndarray) -> np.ndarray:  # gamma(2, 1)
            x = uniform(bits, 1)
            x *= uniform(bits, 0)
            return np.negative(np.log(x, out=x), out=x)

        r, log_a, shift = gamma(one), gamma(two), uniform(three, 1)
        np.log(log_a, out=log_a)
        shift -= np.float32(1)
        if (several := times.count(1)) < len(times):  # a word that occurs once is at step 0
            beta = shift[several:] + np.float32(1)
            step = np.floor(np.log(np.array(times[several:], np.float32))[:, None] / r[several:] + beta)
            shift[several:] -= step
            # the low half has no part in beta
            three[several:] += step.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        shift *= r
        log_a += shift  # log c - r * (step - beta + 1)
        raw = log_a.view(np.int32)
        # as unsigned numbers these order like log_a
        three.view(np.uint32)[:, 1::2] = (raw ^ ((raw >> 31) | np.int32(-(1 << 31)))).view(np.uint32)
        return three

    def _add(self, words: list[str], times: list[int]) -> range:
        """Draw terms that are not kept yet into the next rows."""
        first = self._used
        self._used += len(words)
        for a in range(0, len(words), 256):
            self._kept[first + a:first + a + 256][:len(words) - a] = self._draw(words[a:a + 256], times[a:a + 256])
        return range(first, self._used)

    def _rows(self, once: list[str], more: list[tuple[str, int]]) -> list[int]:
        """The kept rows of some terms, at most as many as can be kept."""
        rows = [*map(self._once.get, once), *map(self._more.get, more)]
        if None in rows:
            new = [i for i, r in enumerate(rows) if r is None]
            if self._used + len(new) > len(self._kept):
                self._once.clear()
                self._more.clear()
                self._used, new = 0, list(range(len(rows)))
            words = [once[i] for i in new if i < len(once)]
            pairs = [more[i - len(once)] for i in new[len(words):]]
            drawn = self._add([*words, *(w for w, _ in pairs)], [1] * len(words) + [n for _, n in pairs])
            for i, r in zip(new, drawn, strict=True):
                rows[i] = r
            self._once.update(zip(words, drawn))
            self._more.update(zip(pairs, drawn[len(words):], strict=True))
        return rows

    def signature(self, text: str | None) -> bytes:
        bag = Counter((text or "").lower().split())
        once = [w for w, n in bag.items() if n == 1]
        more = [t for t in bag.items() if t[1] > 1] if len(once) < len(bag) else []
        least, most = np.full(self.samples, np.iinfo(np.uint64).max), len(self._kept)
        for at in range(0, len(bag), most):
            rest = at - len(once)
            rows = self._rows(once[at:at + most], more[max(0, rest):max(0, rest + most)])
            np.minimum(least, self._kept.take(np.array(rows), axis=0, mode="clip").min(axis=0), out=least)
        return (least & np.uint64(0xFFFF)).astype(">u2").tobytes() if bag else b"\xff" * (2 * self.samples)


_SAMPLERS: dict[int, Sampler] = {}


def sampler(samples: int = SAMPLES) -> Sampler:
    """One per Python worker."""
    if samples not in _SAMPLERS:
        _SAMPLERS.clear()
        _SAMPLERS[samples] = Sampler(samples)
    return _SAMPLERS[samples]


def likeness(one: bytes, two: bytes) -> float:
    return float((np.frombuffer(one, ">u2") == np.frombuffer(two, ">u2")).mean())


def fingerprint(text: str | None, samples: int = SAMPLES) -> str:
    return sampler(samples).signature(text).hex()


def with_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """`docs` with a column `fingerprint` of its column `text`."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, samples))

    return docs.withColumn("fingerprint", made(F.col("text").cast("string")))


def _ranges(docs: DataFrame) -> tuple[list[int], dict[int, list[int]]]:
    """Edges that cut the ids into even ranges, and for the greatest id of each range the ranges it also goes to.

    Both grow with the number of tasks, not of documents.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"))
    n = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = ids.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10 * n).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    found = ids.groupBy(_range_of(edges)(F.col("id")).alias("range")).agg(F.max("id").alias("greatest")).orderBy("range").collect()
    carry: dict[int, list[int]] = {}
    for before, after in zip([found[-1], *found], found, strict=False) if found else []:
        carry.setdefault(before["greatest"], []).append(after["range"])
    return edges, carry


def _range_of(edges: list[int]):
    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(edges, np.int64), ids.to_numpy(np.int64)), dtype="int32")

    return of


_OUT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
        "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of `docs` (doc_id, text), of their edited texts, and how like they are."""
    edges, carry = _ranges(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.col("doc_id").isNull().alias("no_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    @F.pandas_udf("array<int>")
    def also(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: carry.get(i, []))

    own = rows.withColumns({"range": _range_of(edges)(F.col("id")), "also": also(F.col("id"))})
    to = F.explode(F.concat(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("carried"))),
                            F.transform("also", lambda r: F.struct(r.alias("range"), F.lit(True).alias("carried")))))
    dealt = own.select("id", "no_id", "text", to.alias("to")).select("id", "no_id", "text", "to.range", "to.carried")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walked = dealt.repartition(n, "range").sortWithinPartitions("range", F.col("carried").desc(), "id", "text")

    def rows_of(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sign, last, at = sampler(samples).signature, None, None
        for part in parts:
            cols = [part.column(c).to_pylist() for c in ("id", "no_id", "text", "range", "carried")]
            for doc_id, no_id, text, number, carried in zip(*cols, strict=True):
                mine = sign(text)
                if not carried:
                    if number != at or last is None:
                        raise RuntimeError("a range without the document before it")
                    after, after_sign = last
                    cut = len(text) // 2
                    edited = text[:len(text) - cut] + after[:cut]
                    theirs = sign(edited)
                    yield (None if no_id else doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mine.hex(),
                           theirs.hex(), likeness(mine, theirs), likeness(mine, after_sign))
                last, at = (text, mine), number

    types = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return walked.mapInArrow(lambda parts: batches(_OUT, rows_of(parts), at_once=512), types)


def op4_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op4_weighted_minhash": op4_weighted_minhash}

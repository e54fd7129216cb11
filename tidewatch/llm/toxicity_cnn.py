"""Toxicity by a convolutional text classifier.

Words are hashed to embeddings: a word's is the sum of its own and those of its
beginnings, so that forms of one stem are alike. Filters of several widths slide over the
whole text, the greatest answer of each filter is kept (max pooling), and a logistic layer
weighs them. A bucket remembers by a 32-bit tag what it was trained for, so what merely
collides has no embedding, like everything unseen. Training is plain numpy (Adam and
Adagrad, gradients through the pooled positions); scoring is numpy in batches, long texts in
overlapping stretches.

All labelled rows are learned from but those with crc32(id) mod 5 = 0. They are dealt by id
into shards of SHARD_BYTES of text, one task each. In every epoch each shard goes through
its rows, all from the same weights, which are averaged afterwards: a word over the shards
that moved it, the rest over all. A single shard is plain training.

A fifth of the labelled rows is kept from fitting: on it the score is calibrated to the
share of toxic rows among all labelled ones, and each language gets the threshold of the
best F1. Labels, language, source and id are no input of a score; the language only picks
the threshold that `rejected` compares the score with.

Defined cases: a null or empty text has the score of a text without known words; a null id
is held out; several labels of an id count as toxic if one is; without labelled rows of
both classes all scores are 0 or 1, as the labels are; a null or rare language has the
threshold 0.5; repeated rows are scored one by one; of rows that share a labelled id the
smallest text is learned from; an empty table gives no rows; all columns are kept, whatever
their names.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from copy import deepcopy
from itertools import batched, groupby, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewatch.llm import url_cascade
from tidewatch.llm.common import BATCH_ROWS, batches, stored, table

#: Bytes of labelled text in a shard, about.
SHARD_BYTES = 16 << 20
#: Embeddings that are averaged at once.
PIECE = 1 << 11
BUCKETS = 1 << 19
#: Lengths of the beginnings of a word that have embeddings.
STEMS = range(3, 9)
DIMENSION = 16
FILTERS = 16
WIDTHS = (1, 2, 3)
EPOCHS = 8
#: Words and beginnings in fewer of the fitted texts have no embedding.
LEAST_TEXTS = 3
#: Words whose vectors a Python worker keeps.
CACHE_WORDS = 300_000
#: Words of a text that are held at once.
STRETCH = 16_384
#: Rows of each class that a language needs for a threshold of its own.
LEAST_FOR_THRESHOLD = 15
_PAD = max(WIDTHS)
_WORD = re.compile(r"\w+")
#: Of xxHash64.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _lanes(text: np.ndarray, at: int, size: int) -> np.ndarray:
    return np.ascontiguousarray(text[:, at:at + size]).view(f"<u{size}").ravel().astype(np.uint64)


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return h << np.uint64(by) | h >> np.uint64(64 - by)


def hashes(names: pa.Array) -> np.ndarray:
    """xxHash64 of each of `names`, all of one length at once."""
    one, two, three, four, five = (np.uint64(p) for p in _PRIMES)
    starts = np.frombuffer(names.buffers()[1], np.int32)[names.offset:names.offset + len(names) + 1].astype(np.int64)
    data, sizes = np.frombuffer(names.buffers()[2] or b"", np.uint8), np.diff(starts)
    out = np.empty(len(names), np.uint64)
    for size in np.flatnonzero(np.bincount(np.minimum(sizes, 32))).tolist():
        if size == 32:  # and beyond
            for n in np.flatnonzero(sizes >= 32).tolist():
                out[n] = xxh64_intdigest(names[n].as_py())
            continue
        own = np.flatnonzero(sizes == size)
        text = data[starts[own][:, None] + np.arange(size)]
        h, at = np.full(len(own), five + np.uint64(size)), 0
        for at in range(0, size - 7, 8):
            h = _turned(h ^ _turned(_lanes(text, at, 8) * two, 31) * one, 27) * one + four
        at = size // 8 * 8
        if size - at >= 4:
            h = _turned(h ^ _lanes(text, at, 4) * one, 23) * two + three
            at += 4
        for k in range(at, size):
            h = _turned(h ^ text[:, k].astype(np.uint64) * five, 11) * one
        h = (h ^ h >> np.uint64(33)) * two
        h = (h ^ h >> np.uint64(29)) * three
        out[own] = h ^ h >> np.uint64(32)
    return out


def features(words: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The words themselves, then their beginnings of each length: which words have one, and what it is."""
    yield np.ones(len(words), bool), pc.binary_join_element_wise("=", words, "")
    sizes = pc.utf8_length(words).to_numpy()
    for k in STEMS:
        long = sizes >= k
        yield long, pc.utf8_slice_codeunits(words.filter(pa.array(long)), 0, k)


def counted(texts: list[list[str]]) -> tuple[pa.Array, np.ndarray]:
    """The features of tokenised `texts`, and in how many texts each occurs."""
    said = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
    order = pc.sort_indices(said.dictionary)
    words, rank = said.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    # each word of a text once; in their order the words with one beginning are side by side
    text, word = divmod(np.unique(np.repeat(np.arange(len(texts)), [len(t) for t in texts]) * len(words)
                                  + rank[said.indices.to_numpy(zero_copy_only=False)]), max(1, len(words)))
    names, times = [], []
    for has, found in features(words):
        found = found.dictionary_encode()
        number = np.full(len(words), -1)
        number[has] = found.indices.to_numpy(zero_copy_only=False)
        real = number[word] >= 0
        of, own = text[real], number[word[real]]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (own[1:] != own[:-1])
        names.append(found.dictionary)
        times.append(np.bincount(own[new], minlength=len(found.dictionary)))
    return pa.concat_arrays(names), np.concatenate(times)


class TextCnn:
    def __init__(self, texts: list[list[str]], seed: int = 7, owners: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Embeddings for what occurs in tokenised `texts`; the most frequent owns its bucket.

        `owners`: the buckets that are owned and the tags of their owners, the most frequent first, if known already.
        """
        rng = np.random.default_rng(seed)
        self.row, self.tag = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.uint32)
        if owners is None:
            names, times = counted(texts)
            known = sorted((-n, name) for name, n in zip(names.to_pylist(), times.tolist(), strict=True) if n >= LEAST_TEXTS)
            found = hashes(pa.array([name for _, name in known], pa.string()))
            first = np.sort(np.unique(found % np.uint64(BUCKETS), return_index=True)[1])
            owners = (found[first] % np.uint64(BUCKETS)).astype(np.int64), (found[first] >> np.uint64(32)).astype(np.uint32)
        n = 1 + len(owners[0])
        self.row[owners[0]], self.tag[owners[0]] = np.arange(1, n), owners[1]
        self.embedding = rng.normal(0, 0.1, (n, DIMENSION)).astype(np.float32)
        self.embedding[0] = 0
        self.filters = {w: rng.normal(0, 0.25, (w, DIMENSION, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.calibration = (1.0, 0.0)
        self.thresholds: dict[str, float] = {}
        self.constant: float | None = None
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}  # word -> its number; 0 is padding
        self._parts = np.zeros((1, 1 + len(STEMS)), np.int32)  # the embedding rows of word n
        self._vectors: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_number": {}, "_parts": np.zeros((1, 1 + len(STEMS)), np.int32), "_vectors": None}

    def numbers(self, texts: list[list[str]], bounded: bool = True) -> list[np.ndarray]:
        """Each text as numbers of words, which hold until `_forget`."""
        if bounded and len(self._number) > CACHE_WORDS:
            self._forget()
        said = [w for t in texts for w in t]
        numbers = np.fromiter(map(self._number.get, said, repeat(0)), np.int64, len(said))
        if len(unknown := np.flatnonzero(numbers == 0)):
            new = list(dict.fromkeys(said[n] for n in unknown.tolist()))
            block = np.zeros((len(new), self._parts.shape[1]), np.int32)
            for k, (has, names) in enumerate(features(pa.array(new, pa.string()))):
                found = hashes(names)
                at = (found % np.uint64(BUCKETS)).astype(np.int64)
                block[has, k] = np.where(self.tag[at] == (found >> np.uint64(32)).astype(np.uint32), self.row[at], 0)
            first = len(self._parts)
            self._parts = np.concatenate([self._parts, block])
            self._number.update(zip(new, range(first, first + len(new)), strict=True))
            if self._vectors is not None:
                self._vectors = np.concatenate([self._vectors, self._sum(block)])
            numbers[unknown] = [self._number[said[n]] for n in unknown.tolist()]
        return np.split(numbers, np.cumsum([len(t) for t in texts[:-1]], dtype=np.int64))

    def _sum(self, parts: np.ndarray) -> np.ndarray:
        total = self.embedding.take(parts[:, 0], axis=0)
        for k in range(1, parts.shape[1]):
            total += self.embedding.take(parts[:, k], axis=0)
        return total

    def vectors(self) -> np.ndarray:
        """The vector of each numbered word, once training is over."""
        if self._vectors is None:
            self._vectors = self._sum(self._parts)
        return self._vectors

    def _answers(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of each width, what its filters say at each position of the vectors `x`, the padding at the end left out."""
        n = len(x) - _PAD
        for w in WIDTHS:
            answer = x[:n] @ self.filters[w][0]
            for k in range(1, w):
                answer += x[k:n + k] @ self.filters[w][k]
            answer += self.bias[w]
            yield answer

    @staticmethod
    def _lay(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts on end with padding between; where each begins and ends. An empty one is a word of padding."""
        gap = np.zeros(_PAD, np.int64)
        flat = np.concatenate([y for p in parts for y in (p, gap)] + [gap])
        sizes = np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes + _PAD)[:-1]])
        return flat, starts, starts + np.maximum(sizes, 1)

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        pooled = np.full((len(rows), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        parts, owner, size = [], [], 0

        def flush() -> None:
            flat, starts, ends = self._lay(parts)
            ends = np.minimum(ends, starts + STRETCH)  # what overlaps is seen, but begins no window here
            spans = np.stack([starts, ends], axis=1).ravel()
            most = np.concatenate([np.maximum.reduceat(a, spans, axis=0)[::2] for a in self._answers(self.vectors()[flat])], axis=1)
            np.maximum.at(pooled, owner, most)

        for n, r in enumerate(rows):
            for at in range(0, max(1, len(r)), STRETCH):
                parts.append(r[at:at + STRETCH + _PAD - 1])
                owner.append(n)
                size += len(parts[-1])
                if size > 4 * STRETCH:
                    flush()
                    parts, owner, size = [], [], 0
        if parts:
            flush()
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def begin(self) -> None:
        """Nothing is learned yet: sums of squares of the embeddings, moments of the rest."""
        self.squares = np.full(len(self.embedding), 1e-6, np.float32)
        self.mean, self.spread, self.turn = [np.zeros_like(d) for d in self._dense()], [np.zeros_like(d) for d in self._dense()], 0

    def _dense(self) -> list[np.ndarray]:
        return [self.out, self.out_bias, *self.filters.values(), *self.bias.values()]

    def weights(self) -> dict:
        """What training changes."""
        names = ("embedding", "squares", "filters", "bias", "out", "out_bias", "mean", "spread", "turn")
        return {name: getattr(self, name) for name in names}

    @classmethod
    def of(cls, weights: dict) -> TextCnn:
        """A model that knows no words but those it is given numbers of."""
        own = cls.__new__(cls)
        own.__dict__ |= deepcopy(weights) | {"calibration": (1.0, 0.0), "thresholds": {}, "constant": None}
        own._forget()
        return own

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epoch: int, seed: int = 7) -> np.ndarray:
        """Epoch number `epoch` over `rows`; returns which embeddings moved."""
        rng = np.random.default_rng(seed)
        for _ in range(epoch + 1):
            order = rng.permutation(len(rows))
        number_seen, place = np.zeros(len(self._parts), bool), np.zeros(len(self._parts), np.int64)
        row_seen, spot_of, moved_ever = (np.zeros(len(self.embedding), t) for t in (bool, np.int64, bool))
        columns = np.arange(DIMENSION)
        for at in range(0, len(order), 64):
            self.turn += 1
            chosen = order[at:at + 64]
            flat, starts, ends = self._lay([rows[i] for i in chosen])
            number_seen[flat] = True
            used = np.flatnonzero(number_seen)
            number_seen[used] = False
            place[used] = np.arange(len(used))
            spot = place[flat]
            parts = self._parts[used]
            x = self._sum(parts).take(spot, axis=0)
            places, pooled = [], []
            for a in self._answers(x):
                p = np.stack([s + a[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
                places.append(p)
                pooled.append(np.take_along_axis(a, p, axis=0))
            top = np.concatenate(pooled, axis=1)
            hidden = np.maximum(top, 0)
            off = (1 / (1 + np.exp(-(hidden @ self.out + self.out_bias))) - labels[chosen]).astype(np.float32) / len(chosen)
            back = off[:, None] * self.out * (top > 0)
            slopes = [hidden.T @ off + 1e-4 * self.out, off.sum(keepdims=True)]
            moved, by, whose, n_by = [], [], [], 0
            for n, w in enumerate(WIDTHS):
                g = back[:, n * FILTERS:(n + 1) * FILTERS]
                text, of = np.nonzero(g)
                slope = np.zeros_like(self.filters[w])
                for k in range(w):
                    at_k = places[n] + k
                    slope[k] = np.einsum("bf,bfd->df", g, x[at_k])
                    each = parts[spot[at_k[text, of]]]
                    real = each != 0  # the rest is padding or has no embedding
                    moved.append(each[real])
                    whose.append(n_by + np.nonzero(real)[0])
                    by.append(g[text, of][:, None] * self.filters[w][k].T[of])
                    n_by += len(text)
                slopes.append(slope)
            slopes += [back[:, n * FILTERS:(n + 1) * FILTERS].sum(axis=0) for n in range(len(WIDTHS))]
            rows_moved = np.concatenate(moved)
            row_seen[rows_moved] = True
            touched = np.flatnonzero(row_seen)
            row_seen[touched] = False
            moved_ever[touched] = True
            spot_of[touched] = np.arange(len(touched)) * DIMENSION
            change = np.zeros(len(touched) * DIMENSION, np.float32)  # flat, since numpy adds at places of one axis much faster
            np.add.at(change, (spot_of[rows_moved][:, None] + columns).ravel(), np.concatenate(by).take(np.concatenate(whose), axis=0).ravel())
            change = change.reshape(-1, DIMENSION)
            self.squares[touched] += (change**2).sum(axis=1)
            self.embedding[touched] -= 0.1 * change / np.sqrt(self.squares[touched])[:, None]
            for d, s, m, v in zip(self._dense(), slopes, self.mean, self.spread, strict=True):
                m *= 0.9
                m += 0.1 * s
                v *= 0.999
                v += 0.001 * s * s
                d -= 0.01 * (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.999**self.turn)) + 1e-8)
        return moved_ever

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, langs: pd.Series, share: float) -> None:
        """Scale and shift of the least loss whose mean score is the share of toxic rows, then the thresholds."""
        toxic = labels > 0.5
        weight = np.where(toxic, share / max(1, toxic.sum()), (1 - share) / max(1, (~toxic).sum()))
        best = (np.inf, 1.0, 0.0)
        for scale in 2.0 ** np.arange(-4, 3.5, 0.5):
            low, high = -60.0 - scale * np.abs(logits).max(), 60.0 + scale * np.abs(logits).max()
            for _ in range(60):  # the shift at which the mean score is the share
                shift = (low + high) / 2
                p = 1 / (1 + np.exp(-np.clip(scale * logits + shift, -30, 30)))
                low, high = (shift, high) if (weight * p).sum() < share else (low, shift)
            p = np.clip(p, 1e-4, 1 - 1e-4)
            loss = -(weight * np.where(toxic, np.log(p), np.log(1 - p))).sum()
            best = min(best, (float(loss), float(scale), float(shift)))
        self.calibration = best[1:]
        score = self.score_of(logits)
        for lang, rows in sorted(langs.groupby(langs.to_numpy()).indices.items()):
            own, bad, by = score[rows], toxic[rows], weight[rows]
            if min(bad.sum(), (~bad).sum()) < LEAST_FOR_THRESHOLD:
                continue
            top, at = -1.0, 0.5
            for cut in sorted(np.linspace(0.1, 0.9, 33), key=lambda c: abs(c - 0.5)):  # of equal ones, the nearest to 0.5
                hit = own >= cut
                right = by[hit & bad].sum()
                f1 = 2 * right / max(1e-12, by[hit].sum() + by[bad].sum())
                if f1 > top + 1e-9:
                    top, at = f1, float(cut)
            self.thresholds[lang] = at

    def score_of(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * logits.astype(np.float64) + b, -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        # a last digit that depends on the batch does not show
        return np.round(self.score_of(self.logits(self.numbers([words_of(t) for t in texts]))), 6)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _packed(value: object) -> bytes:
    return pa.compress(data := pickle.dumps(value, protocol=5), codec="zstd", asbytes=True) + len(data).to_bytes(8, "little")


def _unpacked(data: bytes) -> object:
    return pickle.loads(pa.decompress(data[:-8], int.from_bytes(data[-8:], "little"), codec="zstd", asbytes=True))


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in parts:
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def sharded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each shard of the labelled rows of `docs`: `n` and `toxic` by `apart` (rows for calibration), and the rows themselves, by id."""
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
    marked = stored(marked.groupBy("id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    # what this filter lets through by chance ends when the rows meet the labels; a full one lets through more
    near = url_cascade.Cascade()
    bits, hashes = 64 * min(url_cascade.MAX_WORDS, marked.count() // 8 + 1), 3
    near.levels.append((stored(url_cascade._level(marked.select(F.col("id").alias("key")), 0, bits, hashes), "toxic-ids"), bits, hashes))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).where(F.col("id").isNotNull() & near.listed(F.col("id")))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, math.ceil(size / SHARD_BYTES))
    both = rows.withColumns({"toxic": F.lit(None).cast("int"), "here": F.lit(True)}).unionByName(
        marked.withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "here": F.lit(False)}))
    # texts are shuffled once: to their shard
    both = both.withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    known = both.groupBy("shard", "id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"), F.max("toxic").alias("toxic"),
                                            F.max("here").alias("here")).where("here AND toxic IS NOT NULL").drop("here")

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packs() -> Iterator[tuple]:
            for shard, own in groupby(_rows(parts), key=lambda r: r[0]):
                n, toxic, held = [0, 0], [0, 0], []
                for some in batched(own, BATCH_ROWS):
                    _, ids, texts, langs, marks = map(list, zip(*some, strict=True))
                    apart = [zlib.crc32(f"apart {i}".encode()) % 5 == 0 for i in ids]
                    for a, m in zip(apart, marks, strict=True):
                        n[a] += 1
                        toxic[a] += m
                    held.append(_packed((texts, langs, marks, apart)))
                yield shard, n, toxic, held

        yield from batches({"shard": pa.int32(), "n": pa.list_(pa.int64()), "toxic": pa.list_(pa.int64()), "rows": pa.list_(pa.binary())}, packs(), 1)

    return stored(known.sortWithinPartitions("shard", "id").mapInArrow(pack, "shard int, n array<long>, toxic array<long>, rows array<binary>"),
                  "toxic-rows")


def owned(packs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a feature of the fitted rows owns and the tags of the owners, the most frequent first."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (held,) in _rows(parts):
            for some in batched(held, 4):
                words = [words_of(t) for texts, _, _, apart in map(_unpacked, some) for t, a in zip(texts, apart, strict=True) if not a]
                names, times = counted(words)
                for at in range(0, len(names), 1 << 16):
                    yield pa.RecordBatch.from_arrays([names[at:at + (1 << 16)], pa.array(times[at:at + (1 << 16)], pa.int64())], ["name", "n"])

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            h = hashes(part.column("name"))
            yield pa.RecordBatch.from_arrays([part.column("name"), part.column("n"), pa.array((h % np.uint64(BUCKETS)).astype(np.int32)),
                                              pa.array((h >> np.uint64(32)).astype(np.int64))], ["name", "n", "bucket", "tag"])

    names = packs.select("rows").mapInArrow(count, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    best = names.mapInArrow(hashed, "name string, n long, bucket int, tag long").groupBy("bucket").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "name", "tag")).alias("owner"))
    got = best.orderBy("owner").select("bucket", "owner.tag").toArrow()  # at most BUCKETS rows of a few bytes
    return got.column("bucket").to_numpy().astype(np.int64), got.column("tag").to_numpy().astype(np.uint32)


def coded(packs: DataFrame, model: TextCnn) -> DataFrame:
    """Each shard with its rows as numbers of words, and what embeddings these have."""
    sent = packs.sparkSession.sparkContext.broadcast(model)

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards() -> Iterator[tuple]:
            for shard, held in _rows(parts):
                sent.value._forget()
                numbers, sizes, langs, marks, apart = [], [], [], [], []
                for texts, *rest in map(_unpacked, held):
                    rows = sent.value.numbers([words_of(t) for t in texts], bounded=False)
                    sizes += map(len, rows)
                    numbers.append(np.concatenate(rows).astype(np.int32))
                    for to, new in zip((langs, marks, apart), rest, strict=True):
                        to += new
                embedded = sent.value._parts
                known = embedded.any(axis=1)  # words without embeddings are like padding
                known[0] = True
                flat = np.where(known, np.cumsum(known) - 1, 0).astype(np.int32)[np.concatenate(numbers)]
                sent.value._forget()
                yield shard, _packed((embedded[known], flat, np.cumsum(sizes)[:-1], np.array(langs, object), np.array(marks, np.float64), np.array(apart, bool)))

        yield from batches({"shard": pa.int32(), "rows": pa.binary()}, shards(), 1)

    out = stored(packs.select("shard", "rows").mapInArrow(code, "shard int, rows binary"), "toxic-codes")
    sent.unpersist()
    return out


def _shard(model: TextCnn, data: bytes, apart: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The rows of a shard that are apart or not, their labels and languages; the model has their words."""
    model._parts, flat, cuts, langs, marks, held = _unpacked(data)
    model._vectors = None
    chosen = np.flatnonzero(held == apart)
    rows = np.split(flat, cuts)
    return [rows[i] for i in chosen], marks[chosen], langs[chosen]


def epoch_of(codes: DataFrame, model: TextCnn, epoch: int) -> None:
    """One epoch of all shards from the weights of `model`, which become the mean of theirs, by rows."""
    sent = codes.sparkSession.sparkContext.broadcast(model.weights())

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            for shard, data in _rows(parts):
                own = TextCnn.of(sent.value)
                rows, marks, _ = _shard(own, data, False)
                if not rows:
                    continue
                moved = np.flatnonzero(own.fit(rows, marks, epoch))
                yield -1, shard, pickle.dumps((len(rows), own.turn, [own._dense(), own.mean, own.spread]))
                for piece in np.split(moved, np.searchsorted(moved, np.arange(PIECE, len(own.embedding), PIECE))):
                    if len(piece):
                        yield int(piece[0]) // PIECE, shard, pickle.dumps((len(rows), piece, np.column_stack([own.embedding[piece], own.squares[piece]])))

        yield from batches({"piece": pa.int32(), "shard": pa.int32(), "data": pa.binary()}, pieces(), 1)

    def mean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def means() -> Iterator[tuple]:
            for piece, own in groupby(_rows(parts), key=lambda r: r[0]):
                got = (pickle.loads(r[2]) for r in own)
                if piece < 0:
                    total, turns, values = 0, 0, None
                    for n, turn, lists in got:
                        total, turns = total + n, max(turns, turn)
                        new = [[n * d.astype(np.float64) for d in x] for x in lists]
                        values = new if values is None else [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(values, new, strict=True)]
                    yield piece, pickle.dumps((turns, [[(d / total).astype(np.float32) for d in x] for x in values]))
                else:
                    total, values = np.zeros(PIECE), np.zeros((PIECE, DIMENSION + 1))
                    for n, rows, new in got:
                        total[rows % PIECE] += n
                        values[rows % PIECE] += n * new.astype(np.float64)
                    moved = np.flatnonzero(total)
                    yield piece, pickle.dumps((piece * PIECE + moved, (values[moved] / total[moved][:, None]).astype(np.float32)))

        yield from batches({"piece": pa.int32(), "data": pa.binary()}, means(), 1)

    each = codes.mapInArrow(learn, "piece int, shard int, data binary")
    made = each.repartition("piece").sortWithinPartitions("piece", "shard").mapInArrow(mean, "piece int, data binary")
    for piece, data in _rows(made.toArrow().to_batches()):  # once the size of the model, whatever the corpus
        if piece < 0:
            model.turn, (dense, model.mean, model.spread) = pickle.loads(data)
            for d, new in zip(model._dense(), dense, strict=True):
                d[...] = new
        else:
            rows, new = pickle.loads(data)
            model.embedding[rows], model.squares[rows] = new[:, :-1], new[:, -1]
    sent.destroy()


def calibrated(codes: DataFrame, model: TextCnn, apart: bool, share: float) -> None:
    """Calibrates by the rows that are apart or not; a few bytes of each meet in one task."""
    sent = codes.sparkSession.sparkContext.broadcast(model.weights())

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TextCnn.of(sent.value)
        for (data,) in _rows(parts):
            rows, marks, langs = _shard(own, data, apart)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(own.logits(rows), pa.float32()), pa.array(marks, pa.float64()), pa.array(langs, pa.string())],
                                                 ["logit", "toxic", "lang"])

    def calibrate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p.astype({"lang": "category"}) for p in parts if len(p)]
        langs = pd.api.types.union_categoricals([p["lang"] for p in held])
        got = pd.concat([p[["logit", "toxic"]] for p in held], ignore_index=True).assign(lang=langs).sort_values(["lang", "toxic", "logit"])
        own = TextCnn.of(sent.value)
        own.calibrate(got["logit"].to_numpy(np.float32), got["toxic"].to_numpy(), got["lang"], share)
        yield pd.DataFrame({"found": [pickle.dumps((own.calibration, own.thresholds))]})

    logits = stored(codes.select("rows").mapInArrow(judge, "logit float, toxic double, lang string"), "toxic-logits")
    made = logits.coalesce(1).mapInPandas(calibrate, "found binary").first()
    model.calibration, model.thresholds = pickle.loads(bytes(made["found"]))
    sent.destroy()


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of each job, so that not all epochs' lie there at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fitted(docs: DataFrame, labels: DataFrame) -> TextCnn:
    """A classifier from all labelled rows."""
    with _shuffles_deleted(docs.sparkSession):
        return _fitted(docs, labels)


def _fitted(docs: DataFrame, labels: DataFrame) -> TextCnn:
    packs = sharded(docs, labels)
    total = lambda c, k: F.coalesce(F.sum(F.col(c)[k]), F.lit(0))
    fit, toxic, held, held_toxic = packs.agg(total("n", 0), total("toxic", 0), total("n", 1), total("toxic", 1)).first()
    if not fit + held:
        model = TextCnn([])
        model.constant = 0.0
        return model
    share = (toxic + held_toxic) / (fit + held)
    model = TextCnn([], owners=owned(packs))
    if toxic in (0, fit):
        model.constant = float(share >= 0.5)
        return model
    codes = coded(packs, model)
    model.begin()
    for epoch in range(EPOCHS):
        epoch_of(codes, model, epoch)
    calibrated(codes, model, 0 < held_toxic < held, share)
    del model.squares, model.mean, model.spread, model.turn  # scoring needs none of them
    return model


def scored(docs: DataFrame, model: TextCnn) -> DataFrame:
    """Per row of `docs`: `row` with all its columns, `score`, `threshold` and `rejected`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(sent.value.score(texts.tolist()))

    threshold = F.lit(0.5)
    if model.thresholds:
        cuts = [F.lit(x) for lang_cut in sorted(model.thresholds.items()) for x in lang_cut]
        threshold = F.coalesce(F.element_at(F.create_map(*cuts), F.col("row.lang").cast("string")), threshold)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.withColumns({"score": score(F.col("row.text").cast("string")), "threshold": threshold}).withColumn(
        "rejected", F.col("score") >= F.col("threshold"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with all their columns, without the rejected."""
    return scored(docs, fitted(docs, labels)).where(~F.col("rejected")).select("row.*")


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return judged.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")


QUERIES = {"op9_toxicity_cnn": op9_toxicity_cnn}

"""Alignment of two tokenizers over the same bytes.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (BPE on pieces with byte
fallback) reads the text and adds that space itself, so both cover the same bytes. The
cumulative ends of A's and of B's tokens go into dictionaries from end to token number; the
ends in both, found by intersecting the two key sets and sorted, slice both lists of ids into
groups. In each slice the tokens of A and B that end together, where the slice ends, are linked
(every token has bytes, which is checked, so that is one of each).

No token of either tokenizer reaches over a space that follows other than white space (A's
rule cuts there; no piece of B has the space mark after another letter, which is checked), so
a text is cut there, each distinct part is aligned once per Python worker and kept in a cache
of bounded size. Where the tokens of new parts do not have their bytes, the whole text is
aligned at once. The pairs of ids that are linked are counted over the corpus. One of two linked
tokens ends with the other's bytes, so there are at most `most_pairs` different pairs,
whatever the corpus; that table is broadcast, and documents are not shuffled.

Defined cases: a text that is null, empty, or whose tokens do not have its bytes (B writes a
space for U+2581) has no tokens, zeros and an empty digest; names of special tokens in a text
are plain text; repeated rows are aligned one by one and all count; null ids stay null; an
empty table gives no rows; other columns are not read. Very long texts are read in stretches.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, table
from tidewatch.llm.tokens import _byte_letters

#: Parts, and letters of them, that the cache of a Python worker may hold; beyond it starts afresh.
CACHE_PARTS, CACHE_LETTERS = 800_000, 20_000_000
#: Parts of a text that are held at once.
STRETCH = 100_000
#: New parts that are aligned in one go.
AT_ONCE = 2_000
#: A cut: a space after what is no white space.
_CUT = re.compile(r"(?<=\S) ")
_UNCUT = re.compile(r"(?:\A|\s) ")
SPACE = "▁"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def cut(text: str) -> list[str]:
    """Parts of a text; each stands for a space and itself."""
    return _CUT.split(text) if _UNCUT.search(text) else text.split(" ")


def slices(sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """The groups in order, a row each: the common end, and how many tokens of A and B lie up to it."""
    of_a, of_b = ({end: n for n, end in enumerate(np.cumsum(x).tolist(), 1)} for x in (sizes_a, sizes_b))
    both = sorted(of_a.keys() & of_b.keys())
    return np.array([both, [of_a[end] for end in both], [of_b[end] for end in both]], np.int64).T


class Aligner:
    """Both tokenizers with the bytes of their tokens, and the parts aligned so far."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, n in self.a.get_vocab().items():
            self.bytes_a[n] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(n) else p.replace(SPACE, " ").encode() for n, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in of]) for of in (self.bytes_a, self.bytes_b))
        if not (self.size_a.all() and self.size_b.all()):
            raise ValueError("a token without bytes has no place of its own")
        #: Each id with each of the signs that may follow it.
        self._said = [f"{n}{sign}" for sign in ",|;\n" for n in range(max(len(self.bytes_a), len(self.bytes_b)))]
        #: False if a piece of B could reach over a cut.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self._clear()

    def _clear(self) -> None:
        self._number: dict[str, int] = {}
        self._letters = 0
        self._digest: list[str] = []
        #: Of part n: tokens of A and B, groups, links; its links are _links[_ends[n]:_ends[n + 1]].
        self._sums = np.zeros((1 << 14, 4), np.int64)
        self._ends = np.zeros(1 << 14, np.int64)
        self._links = np.zeros(1 << 16, np.int64)

    def ids(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B of each text, with the space before it."""
        of_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        of_b = self.b.encode(texts, num_threads=1)
        return [(x.ids, y) for x, y in zip(of_a, of_b, strict=True)]

    def whole(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = b" " + text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw

    def aligned(self, a: list[int], b: list[int], ends: np.ndarray | None = None) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Groups of two lists of ids, their digest text, cut after the groups that end at `ends`, and each group's link a * 2^32 + b."""
        one, two = np.array(a, np.int64), np.array(b, np.int64)
        groups = slices(self.size_a[one], self.size_b[two])
        last_a, last_b = groups[:, 1] - 1, groups[:, 2] - 1
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[last_a], sign_b[last_b] = 1, 2
        if ends is not None:
            sign_b[last_b[np.searchsorted(groups[:, 0], ends)]] = 3
        of = [np.repeat(np.arange(len(groups)), np.diff(groups[:, n], prepend=0)) for n in (1, 2)]
        in_order = np.argsort(np.concatenate([of[0] * 2, of[1] * 2 + 1]), kind="stable")
        at = np.concatenate([one, two]) + np.concatenate([sign_a, sign_b]) * (len(self._said) // 4)
        said = "".join(map(self._said.__getitem__, at[in_order].tolist()))[:-1]
        return groups, said.split("\n"), one[last_a] << 32 | two[last_b]

    def _learn(self, parts: list[str]) -> bool:
        """Align new parts, all in one go; False if they do not keep their bytes."""
        text = " ".join(parts)
        a, b = self.ids([text])[0]
        if not self.whole(text, a, b):
            return False
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        if not (np.isin(ends, np.cumsum(self.size_a[a])).all() and np.isin(ends, np.cumsum(self.size_b[b])).all()):
            return False  # a token reaches over a cut
        groups, said, links = self.aligned(a, b, ends)
        last = np.searchsorted(groups[:, 0], ends)
        upto = np.column_stack([groups[last, 1], groups[last, 2], last + 1, last + 1])
        first = len(self._number)
        self._sums = _room(self._sums, first + len(parts))
        self._ends = _room(self._ends, first + len(parts) + 1)
        self._links = _room(self._links, self._ends[first] + len(links))
        self._sums[first:first + len(parts)] = np.diff(upto, axis=0, prepend=0)
        self._ends[first + 1:first + 1 + len(parts)] = self._ends[first] + upto[:, 3]
        self._links[self._ends[first]:self._ends[first] + len(links)] = links
        self._digest += said
        self._number.update(zip(parts, range(first, first + len(parts)), strict=True))
        self._letters += len(text)
        return True

    def prepare(self, texts: list[str | None]) -> None:
        """Align the new parts of many texts in one go; texts that cannot be cut are left to `document`."""
        if not self.cuts:
            return
        some = [t for t in texts if t and SPACE not in t and len(t) <= STRETCH]
        if len(self._number) > CACHE_PARTS or self._letters > CACHE_LETTERS:
            self._clear()
        new = list({p for t in some for p in cut(t)} - self._number.keys())
        for n in range(0, len(new), AT_ONCE):
            self._learn(new[n:n + AT_ONCE])

    def document(self, text: str | None) -> tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]:
        """(tokens of A, of B, groups, links), digest, distinct pairs and how often each is linked."""
        none = (0, 0, 0, 0), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text or SPACE in text:
            return none
        if not self.cuts:
            return self._at_once(text, none)
        parts = cut(text)
        sums, digest, used = np.zeros(4, np.int64), hashlib.sha256(), []
        for at in range(0, len(parts), STRETCH):
            if len(self._number) > CACHE_PARTS or self._letters > CACHE_LETTERS:
                self._clear()
            some = parts[at:at + STRETCH]
            new = [p for p in dict.fromkeys(some) if p not in self._number]
            for n in range(0, len(new), AT_ONCE):
                if not self._learn(new[n:n + AT_ONCE]):
                    return self._at_once(text, none)
            which = np.fromiter(map(self._number.__getitem__, some), np.int64, len(some))
            sums += self._sums[which].sum(axis=0)
            digest.update(((";" if at else "") + ";".join(map(self._digest.__getitem__, which.tolist()))).encode())
            start, size = self._ends[which], self._sums[which, 3]
            end = np.cumsum(size)
            links = self._links[np.arange(end[-1]) + np.repeat(start - end + size, size)]
            used.append(np.unique(links, return_counts=True))
        pairs = _summed(np.concatenate([x for x, _ in used]), np.concatenate([n for _, n in used])) if len(used) > 1 else used[0]
        return tuple(sums.tolist()), digest.hexdigest(), *pairs

    def _at_once(self, text: str, none: tuple) -> tuple:
        a, b = self.ids([text])[0]
        if not self.whole(text, a, b):
            return none
        groups, said, links = self.aligned(a, b)
        pairs, times = np.unique(links, return_counts=True)
        return (len(a), len(b), len(groups), len(links)), hashlib.sha256(said[0].encode()).hexdigest(), pairs, times


def _room(of: np.ndarray, rows: int) -> np.ndarray:
    """`of`, with room for `rows` rows at least."""
    if rows <= len(of):
        return of
    return np.concatenate([of, np.zeros((max(rows - len(of), len(of)), *of.shape[1:]), of.dtype)])


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, times)
    return found, total


_READY: dict[tuple, Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """One per Python worker."""
    if paths not in _READY:
        _READY.clear()
        _READY[paths] = Aligner(*paths)
    return _READY[paths]


def most_pairs(paths: tuple[str, str] | None = None) -> int:
    """How many pairs of ids can be linked at all: the bytes of one end with the other's."""
    it = aligner(paths or default_paths())
    in_a, in_b = Counter(it.bytes_a), Counter(it.bytes_b)
    return (sum(in_b[x[n:]] for x in it.bytes_a for n in range(len(x)))
            + sum(in_a[x[n:]] for x in it.bytes_b for n in range(1, len(x))))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The alignment itself, per row: ids of both tokenizers, and groups as (end in bytes, tokens of A and of B up to it)."""
    at = paths or default_paths()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = aligner(at)
        kinds = pa.list_(pa.int32()), pa.list_(pa.struct([("end", pa.int64()), ("to_a", pa.int64()), ("to_b", pa.int64())]))
        for part in parts:
            rows = []
            for text in part.column("text").to_pylist():
                a, b = it.ids([text])[0] if text else ([], [])
                a, b = (a, b) if text and it.whole(text, a, b) else ([], [])
                rows.append((a, b, it.aligned(a, b)[0].tolist() if a else []))
            a, b, groups = zip(*rows) if rows else ((), (), ())
            dicts = [[{"end": e, "to_a": m, "to_b": n} for e, m, n in g] for g in groups]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a, kinds[0]), pa.array(b, kinds[0]), pa.array(dicts, kinds[1])],
                                             names=["doc_id", "ids_a", "ids_b", "groups"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids_a array<int>, ids_b array<int>, groups array<struct<end: bigint, to_a: bigint, to_b: bigint>>")


_SUMS = ("n_a", "n_b", "n_groups", "n_links")


def linked(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per row: counts, digest of the groups, and its distinct linked pairs (a * 2^32 + b) with their times."""
    at = paths or default_paths()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = aligner(at)
        for part in parts:
            texts = part.column("text").to_pylist()
            it.prepare(texts)
            rows = [it.document(text) for text in texts]
            sums = np.array([r[0] for r in rows], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(sums[:, n]) for n in range(4)], pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", *_SUMS, "groups_sha256", "pairs", "times"])

    kinds = ", ".join(f"{c} long" for c in _SUMS)
    return _texts(docs).mapInArrow(run, f"doc_id long, {kinds}, groups_sha256 string, pairs array<bigint>, times array<bigint>")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best) of a table from `linked`: best if no other pair with its id of B is linked more often."""
    each = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_b))


def report(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per row: tokens, groups, links, links that are the best of their id of B, and the sum of the links' counts."""
    links = stored(linked(docs, paths), "alignments")
    known = pair_counts(links).toPandas().sort_values("pair")  # at most `most_pairs` rows
    held = docs.sparkSession.sparkContext.broadcast(
        (known["pair"].to_numpy(np.int64), known["count"].to_numpy(np.int64), known["best"].to_numpy(bool)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = held.value
        for part in parts:
            n_best, count_sum = [], []
            for pairs, times in zip(part.column("pairs"), part.column("times"), strict=True):
                at = np.searchsorted(pair, pairs.values.to_numpy())
                n = times.values.to_numpy()
                n_best.append(int(n[best[at]].sum()) if len(n) else 0)
                count_sum.append(int((n * count[at]).sum()) if len(n) else 0)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("doc_id", *_SUMS)], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()),
                 part.column("groups_sha256")], names=["doc_id", *_SUMS, "n_best", "count_sum", "groups_sha256"])

    kinds = ", ".join(f"{c} long" for c in (*_SUMS, "n_best", "count_sum"))
    return links.mapInArrow(run, f"doc_id long, {kinds}, groups_sha256 string")


def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned between the byte-level and the piece tokenizer."""
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op13_cross_alignment": op13_cross_alignment}

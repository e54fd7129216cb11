"""Personal data by fixed rules and a linear-chain conditional random field.

The rules find e-mail and IP addresses, card and phone numbers; what they find stays. The
field reads a text as pieces: words cut at white space and separators, numbers with the
numbers a space after them. It scores a kind for each piece by its shape, by pieces around
it, by words that tell of a kind (`CUES`) and by the kind before, and Viterbi finds the best
sequence. It is trained on the small labelled table of `pii_lines`, by gradient of the exact
likelihood. What it finds is added where it is whole (`whole`) and touches no span of the
rules: addresses and numbers written in other ways.

Decoding is exact but reads little: `open` bounds what any run of kinds can gain, the pieces
in no run that can gain are "nothing" in the best sequence, and the text falls apart into
short runs of the others; runs of a length are decoded together.

Defined cases: a null or empty text has no spans; a null id is kept; repeated rows are
judged one by one; an empty table gives no rows; very long texts are read whole, in linear
time; other columns are kept by `redact`.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import pii_lines
from tidewatch.llm.common import batches, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
            at = text.find("@", done)
        else:
            done = at + 1  # no local part reaches over it
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """What the rules find, by kind as listed and by place."""
    out = list(_emails(text))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split(".") if len(p) < 2000)
            and max(map(len, m.group().split("."))) < 2000]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


_APART = r"\s\x1c-\x1f\"'`{}<>=,;:|&*#$!?%~^\\"
#: A piece: an address with colons, a number with the numbers a space after it, or what stands between separators.
_PIECE = re.compile(
    rf"(?<![0-9A-Za-z:.])(?>(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}})(?![0-9A-Za-z:])"
    rf"|(?<![^{_APART}])(?>\+?(?:\d{{1,3}}[\x20.-])?\(\d{{1,5}}\)\x20?\d[\d.\-/]*|[+(]?\d[\d().\-/]*)(?![^{_APART}])"
    rf"(?:\x20(?>\d[\d.\-/]*)(?![^{_APART}]))*+"
    rf"|[^{_APART}]+")
_SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\dA]+"), "a"), (re.compile(r"\d+"), "9"))
_EDGES = ".-/"
_NUMBER = re.compile(r"[+(]?\d[\d\x20().\-/]*")
_AT = re.compile(r"@|[(\[]at[)\]]|\bat\b", re.IGNORECASE)
_DOT = re.compile(r"\.|[(\[]dot[)\]]|\bdot\b", re.IGNORECASE)
#: Words that tell of a kind some words later.
CUES = {
    "email": ("email", "e-mail", "mail", "write", "contact", "address", "correo", "courriel"),
    "ip": ("ip", "host", "server", "ping", "address", "remote"),
    "phone": ("call", "phone", "tel", "telephone", "telefon", "mobile", "cell", "fax", "dial", "ring", "number", "teléfono", "téléphone"),
    "card": ("card", "cards", "visa", "mastercard", "amex", "credit_card", "karte", "carte", "tarjeta"),
}
#: A cue counts for this many pieces after it.
CUE_REACH = 6
#: A feature is learned if this many lines have it.
LEAST_LINES = 3
#: Places whose pieces a label is scored by: its own and two on each side.
PLACES = (0, -1, 1, -2, 2)
LABELS = ("", *KINDS)


def _shape(word: str) -> str:
    for pattern, letter in _SHAPES:
        word = pattern.sub(letter, word)
    return word


def _is_ip(said: str) -> bool:
    if "[.]" in said:
        parts = said.split("[.]")
        return len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    try:
        return len(said) <= 45 and bool(ipaddress.IPv6Address(said))
    except ValueError:
        return False


def whole(kind: str, said: str) -> bool:
    """Whether `said` can be one of its kind as it stands: neither a part nor a list of them."""
    if kind == "ip":
        return _is_ip(said)
    if kind == "email":
        at = _AT.search(said)
        return bool(at) and at.start() > 0 and at.end() < len(said) and ("@" in said or _DOT.search(said, at.end()) is not None)
    n = sum(map(str.isdecimal, said))
    return _NUMBER.fullmatch(said) is not None and (13 <= n <= 19 if kind == "card" else 7 <= n <= 15)


def features(word: str) -> list[str]:
    """Features of a piece, all of them of the whole piece."""
    core = word.strip(_EDGES)
    low = core.lower()
    cues = [f"cue {k}" for k, said in CUES.items() if low in said]
    if not core or core.isalpha():
        return ["bias", "letters" if core else "signs", f"word {low}", *cues]
    if _NUMBER.fullmatch(core):
        runs = re.findall(r"\d+", core)
        n, signs = sum(map(len, runs)), "".join(sorted(set(re.sub(r"\d", "", core))))
        out = ["bias", "number", f"total {min(n, 20)}", f"signs {signs}", f"total {min(n, 20)} signs {signs}", f"lead {core[0]} {min(n, 20)}"]
        out.append(f"runs {'-'.join(str(min(len(r), 20)) for r in runs)}" if len(runs) <= 6 else "many runs")
        if all(len(r) == 4 and r[:2] in ("19", "20") for r in runs):
            out.append("years")
        if 13 <= n <= 19 and core[0] in "3456":
            out.append("card lead")
        return out + [f"fits {k}" for k in ("phone", "card") if whole(k, core)]
    out = ["bias", "mixed", f"shape {_shape(core)}", *cues]
    if "." in core and (tail := low.rpartition(".")[2]).isalpha():
        out.append(f"tail {tail}")
    if _is_ip(core):
        out += ["address", f"address {core.count(':')} {'::' in core}", f"digits in address {any(map(str.isdecimal, core))}"]
    elif ":" in core:
        out.append("colons")
    if any(c in core for c in "@[("):
        out += [f"{name} inside" for name, p in (("at", _AT), ("dot", _DOT)) if p.search(core)]
        if whole("email", core):
            out.append("fits email")
    return out


def _table(held: bool = False) -> list[tuple[list[str], list[int]]]:
    """Pieces and labels of the labelled table."""
    out = []
    for line in pii_lines.lines(held):
        text, spans = pii_lines.parted(line)
        words, labels = [], []
        for m in _PIECE.finditer(text):
            words.append(m.group())
            labels.append(next((LABELS.index(k) for k, s, e in spans if s < m.end() and m.start() < e), 0))
        if words:
            out.append((words, labels))
    return out


def _near(cues: np.ndarray) -> np.ndarray:
    """For each piece and kind, 1 where one of the CUE_REACH pieces before it is a cue."""
    seen = np.concatenate([np.zeros((1, cues.shape[1]), np.int64), np.cumsum(cues, axis=0)])[:-1]
    before = np.concatenate([np.zeros((min(CUE_REACH, len(seen)), cues.shape[1]), np.int64), seen[:-CUE_REACH]])
    return (seen > before).astype(np.float32)


class Crf:
    """Weights: of features at a piece and around it, of cues before it, and of transitions."""

    def __init__(self, rounds: int = 200, decay: float = 0.1) -> None:
        rows = _table()
        kinds = sorted({tuple(sorted(set(features(w)))) for words, _ in rows for w in words})
        class_of = {c: n for n, c in enumerate(kinds)}
        lines_with = Counter(f for words, _ in rows for f in {f for w in words for f in features(w)})
        self.index = {f: n for n, f in enumerate(sorted(f for f, n in lines_with.items() if n >= LEAST_LINES))}
        k, longest = len(LABELS), max(len(w) for w, _ in rows)
        has = np.zeros((len(kinds) + 1, len(self.index)))  # the last class: no piece there
        for c, n in class_of.items():
            has[n, [self.index[f] for f in c if f in self.index]] = 1
        at = np.full((len(rows), longest + 2 * max(PLACES)), len(kinds))
        gold, there = np.zeros((len(rows), longest), np.int64), np.zeros((len(rows), longest), bool)
        cued = np.zeros((len(rows), longest, len(KINDS)))
        for n, (words, labels) in enumerate(rows):
            size = len(words)
            at[n, max(PLACES):max(PLACES) + size] = [class_of[tuple(sorted(set(features(w))))] for w in words]
            gold[n, :size], there[n, :size] = labels, True
            cued[n, :size] = _near(np.array([[f"cue {c}" in features(w) for c in KINDS] for w in words]))
        around = [at[:, max(PLACES) + p:max(PLACES) + p + longest] for p in PLACES]
        self.weights = np.zeros((len(PLACES), len(self.index), k))
        self.near, self.steps = np.zeros((len(KINDS), k)), np.zeros((k, k))
        params = [self.weights, self.near, self.steps]
        slow = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        hot = np.eye(k)[gold] * there[..., None]
        gold_steps = np.einsum("ntk,ntl->kl", hot[:, :-1] * there[:, 1:, None], hot[:, 1:])
        for turn in range(1, rounds + 1):
            emit = cued @ self.near
            for p, where in enumerate(around):
                emit += (has @ self.weights[p])[where]
            mark, step = self._marginals(emit, there)
            off = mark - hot
            slopes = [np.zeros_like(self.weights), np.einsum("ntc,ntk->ck", cued, off), step - gold_steps]
            for p, where in enumerate(around):
                by_class = np.stack([np.bincount(where.ravel(), off[..., j].ravel(), len(has)) for j in range(k)], axis=1)
                slopes[0][p] = has.T @ by_class
            for p, g, (m, v) in zip(params, slopes, slow, strict=True):
                g = g + decay * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
        self._forget()

    def __getstate__(self) -> dict:
        return {"index": self.index, "weights": self.weights, "near": self.near, "steps": self.steps}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}  # word -> the class of words with its features
        self._class: dict[tuple, int] = {}
        self._scores = np.zeros((0, len(PLACES), len(LABELS)), np.float32)
        self._cues = np.zeros((0, len(KINDS)), bool)

    def _marginals(self, emit: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each piece, and the expected transitions, by forward and backward sums scaled to one."""
        size, go = emit.shape[1], np.exp(self.steps)
        weight = np.exp(emit - emit.max(axis=2, keepdims=True))
        ahead, back = weight.copy(), np.ones_like(emit)
        for t in range(size):
            if t:
                ahead[:, t] *= ahead[:, t - 1] @ go
            ahead[:, t] /= ahead[:, t].sum(axis=1, keepdims=True)
        for t in range(size - 2, -1, -1):
            on = (weight[:, t + 1] * back[:, t + 1]) @ go.T
            back[:, t] = np.where(there[:, t + 1, None], on / on.sum(axis=1, keepdims=True), 1)
        mark = ahead * back
        mark *= there[..., None] / mark.sum(axis=2, keepdims=True)
        after = weight[:, 1:] * back[:, 1:]
        both = np.einsum("ntk,ntk->nt", ahead[:, :-1] @ go, after)
        pair = go * np.einsum("ntk,ntl->kl", ahead[:, :-1] * (there[:, 1:] / both)[..., None], after)
        return mark, pair

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The class of each word: words with the same known features have the same scores."""
        if len(self._number) > 400_000:
            self._forget()
        got = list(map(self._number.get, words))
        if None in got:
            for w in {w for w, g in zip(words, got, strict=True) if g is None}:
                at = tuple(n for f in features(w) if (n := self.index.get(f)) is not None)
                if at not in self._class:
                    self._class[at] = len(self._class)
                    self._scores = np.concatenate([self._scores, self.weights[:, list(at)].sum(axis=1, dtype=np.float32)[None]])
                    self._cues = np.concatenate([self._cues, [[self.index.get(f"cue {k}", -1) in at for k in KINDS]]])
                self._number[w] = self._class[at]
            got = list(map(self._number.__getitem__, words))
        return np.array(got, np.int64)

    def viterbi(self, emit: np.ndarray, first: bool, last: bool) -> np.ndarray:
        """Best labels of runs of one length (run, word, label); `first`, `last`: whether the text ends there, else "nothing" is next."""
        n, size, k = emit.shape
        best = emit[:, 0] + (0 if first else self.steps[0])
        came = np.zeros((n, size, k), np.int8)
        for t in range(1, size):
            by = best[:, :, None] + self.steps
            came[:, t] = by.argmax(axis=1)
            best = by.max(axis=1) + emit[:, t]
        if not last:
            best = best + self.steps[:, 0]
        out = np.zeros((n, size), np.int64)
        out[:, -1] = best.argmax(axis=1)
        for t in range(size - 1, 0, -1):
            out[:, t - 1] = came[np.arange(n), t, out[:, t]]
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of each label at each piece, without transitions."""
        at = self._numbers(words)
        emit = np.zeros((len(at), len(LABELS)), np.float32)
        for n, place in enumerate(PLACES):
            if abs(place) < len(at):
                emit[max(0, -place):len(at) - max(0, place)] += self._scores[at[max(0, place):len(at) + min(0, place)], n]
        cues = self._cues[at]
        if cues.any():
            emit += _near(cues) @ self.near.astype(np.float32)
        return emit

    def open(self, emit: np.ndarray) -> np.ndarray:
        """Pieces that may have a kind in the best sequence; all others surely have none.

        A run of kinds gains over "nothing" at most the sum of what each of its pieces can
        gain: its score's lead, half a transition to a kind beside it or a whole one to
        nothing. In the best sequence no run loses, so its pieces lie in a stretch whose
        gains sum to zero or more.
        """
        over = self.steps - self.steps[0, 0]
        into = np.maximum(over[0, 1:], over[1:, 1:].max(axis=0) / 2)
        out = np.maximum(over[1:, 0], over[1:, 1:].max(axis=1) / 2)
        lead = emit[:, 1:].astype(np.float64) - emit[:, :1]
        gain = (lead + (into + out)).max(axis=1)
        gain[0] = (lead[0] + np.maximum(into, 0) + np.maximum(out, 0)).max()
        gain[-1] = max(gain[-1], (lead[-1] + np.maximum(into, 0) + np.maximum(out, 0)).max())
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        least, most = np.minimum.accumulate(sums[:-1]), np.maximum.accumulate(sums[:0:-1])[::-1]
        return np.flatnonzero(most - least >= -1e-3)

    def labels(self, words: list[str]) -> np.ndarray | None:
        """Best label of each piece, None where all are "nothing"."""
        if not words:
            return None
        emit = self.scores(words)
        open_ = self.open(emit)
        if not len(open_):
            return None
        out = np.zeros(len(words), np.int64)
        cut = np.flatnonzero(np.diff(open_) > 1) + 1
        starts, ends = open_[np.concatenate([[0], cut])], open_[np.concatenate([cut - 1, [len(open_) - 1]])] + 1
        groups: dict[tuple, list[int]] = {}
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            groups.setdefault((e - s, s == 0, e == len(words)), []).append(s)
        for (size, first, last), at in groups.items():
            where = np.array(at)[:, None] + np.arange(size)
            out[where] = self.viterbi(emit[where], first, last)
        return out if out.any() else None


def crf_spans(text: str, model: Crf) -> list[Span]:
    """Pieces the field gives a kind, if they are whole; an address in words is a run of pieces."""
    labels = model.labels(_PIECE.findall(text))
    if labels is None:
        return []
    out: list[Span] = []
    for label, m in zip(labels.tolist(), _PIECE.finditer(text), strict=True):
        if label:
            start, end = m.span()
            if LABELS[label] == "email" and out and out[-1][0] == "email" and text[out[-1][2]:start].isspace():
                out[-1] = ("email", out[-1][1], end)
            else:
                out.append((LABELS[label], start, end))
    return [(k, s, e) for k, s, e in (_bare(text, *span) for span in out) if whole(k, text[s:e])]


def _bare(text: str, kind: str, start: int, end: int) -> Span:
    while start < end and text[start] in _EDGES:
        start += 1
    while end > start and text[end - 1] in _EDGES:
        end -= 1
    if text[start:end].startswith("(") and ")" not in text[start:end]:
        start += 1
    if text[start:end].endswith(")") and "(" not in text[start:end]:
        end -= 1
    return kind, start, end


def find(text: str | None, model: Crf) -> tuple[list[Span], list[Span]]:
    """(spans of the rules, all spans), by kind as listed, then by place."""
    text = text or ""
    base = base_spans(text)
    more = crf_spans(text, model)
    if not more:
        return base, base
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    furthest, reach = [], 0
    for _, e in taken:
        reach = max(reach, e)
        furthest.append(reach)
    free = []
    for kind, s, e in more:
        n = int(np.searchsorted(starts, e))  # spans that begin before this one ends
        if n == 0 or furthest[n - 1] <= s:
            free.append((kind, s, e))
    return base, sorted([*base, *free], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_OUT = {"doc_id": pa.int64(), **{f"n_{k}": pa.int64() for k in KINDS}, "base_sha256": pa.string(), "spans": pa.string()}


def report(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """Counts and digest of the rules' spans, and all spans, of each document (doc_id, text)."""
    crf = model or Crf()

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                base, spans = find(text, crf)
                kinds = [k for k, _, _ in base]
                yield doc_id, *map(kinds.count, KINDS), hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans)

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(lambda parts: batches(_OUT, rows(parts)),
                          "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str | None, model: Crf) -> str | None:
    """`text` with [KIND] for every span; spans that overlap become one."""
    spans = sorted(((s, -e, k) for k, s, e in find(text, model)[1]))
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, -e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """`docs` with all columns, personal data in `text` replaced and `n_chars` following it."""
    crf = model or Crf()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact_text(t, crf))

    made = docs.withColumn("text", clean(F.col("text").cast("string")))
    return made.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else made


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii_crf": op6_pii_crf}

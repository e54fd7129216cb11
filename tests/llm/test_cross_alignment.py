"""Alignment of two tokenizers against a plain form: whole texts, no cache, all pairs of tokens."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import cross_alignment as ca

SF = "/root/testdata/sf0.001"
TEXTS = ["Some plain text.", "", None, "a  b", "  a", "a\n  b \t c ", "it's we'll  ok", "<|endoftext|> <s> </s>x <unk>", "▁x y", "日本語 🙂 naïve  x　 y", "x" * 3000,
         " ", "a ", "\x1c \x1d b", "a\x85 b", "\x00 a", "é  é x", "\n\n \n", "tab\t\t x", "word, word. word!", "long " * 5000, "3.14 1,000 2²"]


def tokens(it, text):
    """Ids and byte ends of both tokenizers, or nothing."""
    if not text:
        return [], [], [], []
    a = it.a.encode(" " + text, add_special_tokens=False).ids
    b = it.b.encode(text)
    ends, at = [], 0
    for ids, of in ((a, it.bytes_a), (b, it.bytes_b)):
        if b"".join(of[n] for n in ids) != (" " + text).encode():
            return [], [], [], []
        at, own = 0, []
        for n in ids:
            at += len(of[n])
            own.append(at)
        ends.append(own)
    return a, ends[0], b, ends[1]


def plain(it, texts):
    all_ = [tokens(it, t) for t in texts]
    links = [[(x, y) for x, e in zip(a, ea) for y, f in zip(b, eb) if e == f] if len(a) < 400 else
             [(a[ea.index(e)], b[eb.index(e)]) for e in sorted(set(ea) & set(eb))] for a, ea, b, eb in all_]
    count = Counter(p for own in links for p in own)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    rows = []
    for (a, ea, b, eb), own in zip(all_, links):
        cuts, said, last = sorted(set(ea) & set(eb)), [], 0
        for c in cuts:
            said.append(",".join(str(x) for x, e in zip(a, ea) if last < e <= c) + "|" + ",".join(str(y) for y, f in zip(b, eb) if last < f <= c))
            last = c
        digest = hashlib.sha256(";".join(said).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(cuts), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), digest))
    return rows


@pytest.fixture(scope="module")
def it():
    return ca.Aligner(*ca.default_paths())


def test_report_is_the_plain_alignment(spark, it):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect() if len(r.text or "") < 4000] + TEXTS[:8]
    docs = spark.createDataFrame([(n if n else None, t, "k", 1) for n, t in enumerate(texts)], "doc_id long, text string, pairs string, n_a int")
    rows = {r.doc_id or 0: tuple(r)[1:] for r in ca.report(docs).collect()}
    want = plain(it, texts)
    assert [rows[n] for n in range(len(texts))] == want


def test_cache_and_stretches_change_nothing(it, monkeypatch):
    whole = [it.document(t) for t in TEXTS]
    for name, n in (("CACHE_PARTS", 5), ("STRETCH", 3), ("AT_ONCE", 2)):
        monkeypatch.setattr(ca, name, n)
    small = ca.Aligner(*ca.default_paths())
    for x, y in zip(whole, (small.document(t) for t in TEXTS), strict=True):
        assert x[:2] == y[:2] and x[2].tolist() == y[2].tolist() and x[3].tolist() == y[3].tolist()
    small.cuts = False  # as if a piece could reach over a cut
    for x, y in zip(whole, (small.document(t) for t in TEXTS), strict=True):
        assert x[:2] == y[:2] and x[2].tolist() == y[2].tolist()


def test_groups_have_the_bytes_of_both(spark, it):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in ca.align(docs).collect():
        at = (0, 0)
        assert bool(r.groups) == bool(r.ids_a)
        for g in r.groups:
            one = b"".join(it.bytes_a[n] for n in r.ids_a[at[0]:g.to_a])
            assert one == b"".join(it.bytes_b[n] for n in r.ids_b[at[1]:g.to_b]) and one
            at = (g.to_a, g.to_b)
        assert at == (len(r.ids_a), len(r.ids_b))


def test_pairs_have_a_bound(spark, it):
    links = ca.stored(ca.linked(spark.read.parquet(f"{SF}/documents.parquet")), "test-links")
    pairs = [r.pair for r in ca.pair_counts(links).collect()]
    assert 0 < len(pairs) <= ca.most_pairs() < 1_000_000
    for p in pairs:
        a, b = it.bytes_a[p >> 32], it.bytes_b[p & 0xFFFFFFFF]
        assert a.endswith(b) or b.endswith(a)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ca.report(docs).collect() == [] and ca.align(docs).collect() == []
    assert ca.report(docs.select(F.col("doc_id"), "text")).columns[0] == "doc_id"

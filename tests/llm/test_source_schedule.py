"""The mix: what is taken of each document, the slots, and odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import source_schedule as mixing

ROWS = [(1, "a b c d", "x"), (2, "", "x"), (3, None, "y"), (4, "one two three " * 700, "y"), (4, "one two three " * 700, "y"), (None, "no id here", "z"),
        (None, "no id here", "z"), (7, "ä ö ü", None), (8, "w " * 9000, None), (9, "é " * 40, "é"), (10, "tab\there\nand\x0bthere\x1cnot", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with names of the operator
    return spark.createDataFrame([(*r, "s", 1, 2) for r in ROWS], "doc_id long, text string, source string, hash string, start int, number int")


def plain_targets(sizes):
    """Sizes by source in order -> targets, by filling round after round."""
    weights = [(5, 2, 1)[n % 3] for n in range(len(sizes))]
    left, capped = 1.5 * sum(sizes), set()
    while True:
        open_ = [n for n in range(len(sizes)) if n not in capped]
        spare = left - sum(2 * sizes[n] for n in capped)
        over = [n for n in open_ if 2 * sizes[n] < spare * weights[n] / sum(weights[m] for m in open_)]
        if not over:
            return [2 * sizes[n] if n in capped else spare * weights[n] / sum(weights[m] for m in open_) for n in range(len(sizes))]
        capped |= set(over)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_targets_and_taken(docs):
    rows = mixing.report(docs, block=64).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted((i is None, i or 0, len(words(t))) for i, t, _ in ROWS)
    order = ["x", "y", "z", "é", None]
    sizes = [sum(len(words(t)) for _, t, s in ROWS if s == source) for source in order]
    by_size = dict(zip(sizes, plain_targets(sizes), strict=True))
    taken = {}
    for r in rows:
        assert r.target == pytest.approx(by_size[r.source_size]) and 0 <= r.taken <= 2 * r.size
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert all(abs(taken[s] - by_size[s]) <= 0.5 for s in sizes)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.report(docs.repartition(5), block=64).collect()), key=str)


def test_pieces_are_the_words_in_equal_blocks(docs):
    pieces = mixing.mixed_texts(docs, block=64).collect()
    texts = {r.doc_id: [] for r in pieces}
    fill = {}
    for r in sorted(pieces, key=lambda r: (r.slot, r.at)):
        assert r.at == fill.get(r.slot, 0) and len(r.text.split(" ")) == r.words
        fill[r.slot] = r.at + r.words
        texts[r.doc_id].append(r.text)
    assert sum(n < 64 for n in fill.values()) <= 5 and max(fill.values()) == 64  # a source's last block may be short
    assert set(" ".join(texts[1]).split()) == {"a", "b", "c", "d"}


def test_slots_follow_the_weights_and_use_each_block_once(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 256)
    monkeypatch.setattr(mixing, "CELLS", 64)
    monkeypatch.setattr(mixing, "SOURCES", 3)
    quotas = [50_000, 1, 20_000, 0, 7_777, 310, 12]
    sources = spark.createDataFrame(list(enumerate(quotas)), "number long, quota long")
    rows = sorted(mixing.schedule(sources, 10).collect())
    blocks = [-(-q // 10) for q in quotas]
    for no, n in enumerate(blocks):
        assert [r["rank"] for r in rows if r.source_no == no] == list(range(n))
    assert len({r.slot for r in rows}) == len(rows)
    seen = [0] * len(quotas)
    for n, r in enumerate(rows, 1):
        seen[r.source_no] += 1
        if n % 500 == 0:  # any beginning of the mix has the shares of the whole
            assert all(abs(s - n * b / sum(blocks)) <= 8 for s, b in zip(seen, blocks, strict=True))


def test_bits_in_reverse(spark):
    for bits in (1, 7, 32, 33, 45):
        numbers = [n for n in (0, 1, 2, 5, 100, (1 << 31) + 5, (1 << 40) + 3) if n < 1 << bits]
        got = spark.createDataFrame([(n,) for n in numbers], "n long").select(mixing._reversed(F.col("n"), bits)).collect()
        assert [r[0] for r in got] == [int(format(n, f"0{bits}b")[::-1], 2) for n in numbers]


def test_a_third_of_all_rows_equal(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 16)
    rows = [(i, f"word{i} and more", "hot" if i % 2 else "b") for i in range(200)] + [(None, "same again here", "hot")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents = mixing.stored(mixing.documents_of(docs), "test-documents")
    sources = mixing.stored(mixing.with_targets(mixing.numbered_sources(documents)), "test-sources")
    place = mixing.placed(documents, sources, 300).collect()
    for no in (0, 1):  # no gap, no overlap
        spans = sorted((r.start, r.start + r["size"]) for r in place if r.source_no == no)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert mixing.report(docs).count() == 300


def test_empty_and_wordless(docs):
    assert mixing.report(docs.where("false")).collect() == []
    rows = mixing.report(docs.where("doc_id IN (2, 3)")).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows) == [(2, 0, 0, 0.0, 0), (3, 0, 0, 0.0, 0)]
    assert mixing.mix(docs.where("false")).collect() == []

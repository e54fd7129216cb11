"""Ranked search against a plain loop over all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import mask_search as ms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UP = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(UP))


def plain_rank(docs, items, top=10):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        rows = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in plain_terms(text) if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -score) for k, (score, none, i) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=str)


def case():
    rng = np.random.default_rng(5)
    words = [f"w{n}" for n in range(150)] + ["Äpfel", "ÄPFEL", "日本", "x1y"]
    docs = [(n, " ".join(words[int(k)] for k in (rng.random(int(rng.integers(0, 60))) ** 2 * len(words)))) for n in range(400)]
    docs += [(500, None), (501, ""), (502, "--- !!"), (None, "w3 w4 W5"), (None, "w3 w4 W5"), (503, "w1 " * 4000), (504, "w7,w8;w9\x00w10_w11")]
    docs += [(n, "w100 w101 w102 copy") for n in range(600, 700)]  # ties beyond the best ten
    items = [(n, " ".join(words[int(k)] for k in rng.integers(0, len(words), 30))) for n in range(12)]
    items += [(20, "copy w100"), (21, ""), (22, None), (23, "nowhere"), (20, "copy w100"), (20, "äpfel"), (None, "w5 w5 w6"), (24, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("limits", [(4096, 16 << 20, 4 << 20), (16, 64, 32)])
def test_ranks_are_those_of_a_plain_loop(spark, monkeypatch, limits):
    docs, items = case()
    for name, n in zip(("BLOCK_DOCS", "ITEM_BYTES", "PIECE"), limits, strict=True):
        if name != "ITEM_BYTES" or n > 64:
            monkeypatch.setattr(ms, name, n)
    if limits[0] == 16:
        monkeypatch.setattr(ms, "ITEM_BYTES", 600)  # several blocks of items
    d = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, n int, rank string").repartition(7)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, score int")
    got = ms.rank(d, q).collect()
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], key=str) == plain_rank(docs, items)


def block(rng, n_docs, known):
    sizes = rng.integers(1, known // 2, n_docs)
    held = np.concatenate([np.sort(rng.choice(known, s, replace=False)) for s in sizes])
    return ms.Block(np.arange(n_docs), np.zeros(n_docs, bool), sizes, held, rng.integers(1, 1000, len(held)), known)


def test_masks_group_and_bound(spark):
    rng = np.random.default_rng(2)
    b, wanted = block(rng, 300, 200), list(range(0, 200, 2))  # 100 bits: two numbers a mask
    often = rng.integers(1, 4, len(wanted))
    dense = np.zeros(200, np.int64)
    dense[wanted] = often
    masks = b.masks(wanted)
    for d in range(300):
        own = set(b.held[b.at[d]:b.at[d + 1]].tolist())
        assert [t for n, t in enumerate(wanted) if int(masks[d, n // 64]) >> (n % 64) & 1] == [t for t in wanted if t in own]
    docs, starts, bounds = b.groups(wanted, often)
    assert (np.diff(bounds) <= 0).all()
    for k, bound in enumerate(bounds):
        some = docs[starts[k]:starts[k + 1]]
        assert len({tuple(masks[d]) for d in some}) == 1 and (b.score(some, dense) <= bound).all()


def test_search_stops_early_and_loses_nothing():
    rng = np.random.default_rng(3)
    # few documents hold the dear terms, so most masks stay below the tenth
    sizes, held, scores = [], [], []
    for d in range(2000):
        own = [0, 1] if d % 50 else [0, 1, 2, 3]
        sizes.append(len(own))
        held += own
        scores += [int(rng.integers(1, 5)) if t < 2 else int(rng.integers(500, 900)) for t in own]
    b = ms.Block(np.arange(2000), np.zeros(2000, bool), np.array(sizes), np.array(held), np.array(scores), 4)
    best, dense = ms.Best(10), np.ones(4, np.int64)
    scored = ms.search(b, [0, 1, 2, 3], np.ones(4, np.int64), dense, best)
    exact = b.score(np.arange(2000), dense)
    order = np.lexsort((np.arange(2000), -exact))[:10]
    assert best.rows[0].tolist() == exact[order].tolist() and best.rows[1].tolist() == order.tolist()
    assert scored <= 40  # of 2,000


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for x, y in ((d.where("false"), q), (d, q.where("false")), (d, q.selectExpr("item_id", "'' AS text"))):
        assert ms.rank(x, y).collect() == [] and ms.rank(x, y).columns == ["item_id", "rank", "doc_id", "score"]

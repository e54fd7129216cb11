"""The near-duplicate stage against all pairs by brute force, on planted edits."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import shingle_pairs, simhash_pivots


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def plain_groups(sets):
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 5 * both >= 4 * (len(a) + len(sets[j]) - both) > 0:
                up[find(i)] = find(j)
    return [find(x) for x in range(len(sets))]


def planted():
    rng = np.random.default_rng(4)
    words = [f"w{n}" for n in range(3000)]
    texts = ["", None, " \n", "one two", "One  two", "one two three four five", "one two three four five six"]
    for family in range(40):
        base = [words[k] for k in rng.integers(0, len(words), int(rng.integers(40, 400)))]
        for _ in range(60 if family == 0 else 8):  # one family crowds its keys
            own = list(base)
            for at in rng.integers(0, len(own), int(rng.integers(0, len(own) // 22 + 2))):
                own[at] = words[rng.integers(0, len(words))]
            texts.append(" ".join(own))
    passage = " ".join(words[:30])
    return texts + [" ".join([passage, *(words[k] for k in rng.integers(0, len(words), 60))]) for _ in range(40)]


def test_near_duplicates_are_those_of_brute_force(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = plain_groups([plain_set(t) for t in texts])
    least = {}
    for i, g in enumerate(groups):
        least[g] = min(least.get(g, i), i)
    assert len(set(groups)) < len(texts) - 100  # links were planted, and pairs on either side of 0.8
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(least.values())
    got = {r.doc_id: r.component_id for r in shingle_pairs.components(docs).collect()}
    assert got == {i: least[g] for i, g in enumerate(groups)}


def test_exactly_four_fifths_links():
    def numbers(n):
        return np.arange(n, dtype=np.uint64)

    assert shingle_pairs.alike(numbers(8), numbers(10)) and not shingle_pairs.alike(numbers(7), numbers(9))


def test_a_crowd_that_shares_half_its_text_makes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{n}" for n in range(60))
    texts = [" ".join([passage, *(f"q{k}" for k in rng.integers(0, 9000, 60))]) for _ in range(1950)]
    base = [f"b{n}" for n in range(100)]
    for n in range(50):  # true copies among them, with one word changed each
        own = list(base)
        own[n] = f"other{n}"
        texts.append(f"{passage} {' '.join(own)}")
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    seen = []
    verified = shingle_pairs.verified
    monkeypatch.setattr(shingle_pairs, "verified", lambda pairs, of: (seen.append(pairs.count()), verified(pairs, of))[1])
    got = {r.doc_id: r.component_id for r in shingle_pairs.components(docs).collect()}
    assert got == {n: min(n, 1950) for n in range(2000)}
    assert sum(seen) < 10 * len(texts)  # of two million


def test_prefixes_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(shingle_pairs, "SMALL", 1)  # every crowded key goes by prefixes
    test_near_duplicates_are_those_of_brute_force(spark)


def test_rows_stay_as_they_are(spark):
    rows = [(None, None), (None, ""), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (3, "a b c d  e f"), (7, "w " * 50_000), (8, "w " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("row", "row_id", "row_text", "_row_id", "_row_text", "_keep_id", "keep_id", "fp", "root", "key", "n", "node")
    docs = docs.select("*", *[F.lit(c).alias(c) for c in names])
    got = shingle_pairs.dedup(docs)
    assert got.schema == docs.schema and got.exceptAll(docs).isEmpty()
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:3]) for r in got.collect()) == [(False, 3, "a b"), (False, 7, "w w"), (True, 0, "")]
    assert shingle_pairs.dedup(docs.where("false")).collect() == []


def test_recall_of_the_keys_at_four_fifths():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 80, np.uint64)
        one, two = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 10, np.uint64)])) for _ in range(2))
        missed += not np.intersect1d(shingle_pairs.band_keys(one), shingle_pairs.band_keys(two)).size
    assert missed == 0


def test_simhash_makes_candidates_of_its_own(spark):
    """Without any min-hash key, what is within 3 bits is still found, and what is not 0.8 alike does not link."""
    from tidewatch.llm import simhash_pivots
    from tidewatch.llm.common import stored

    rng = np.random.default_rng(8)
    base = [[f"w{k}" for k in rng.integers(0, 5000, 1500)] for _ in range(6)]
    texts = [t for b in base for t in (" ".join(b), " ".join([*b[:700], "changed", *b[701:]]), " ".join(b[:900]))] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = stored(shingle_pairs.shingle_sets(docs).withColumn("keys", F.array().cast("array<long>")), "test-sets")
    for r in sets.join(docs, "doc_id").collect():
        found = shingle_pairs.shingles(r.text)
        assert r.sim % (1 << 64) == simhash_pivots.fingerprint_of(found)
    fp = {r.doc_id: r.fp for r in sets.collect()}
    linked = {frozenset(e) for e in shingle_pairs.links(docs, sets).collect()}
    for n in range(len(base)):
        one, two, short = (fp[3 * n + k] for k in range(3))
        bits = bin(simhash_pivots.fingerprint_of(shingle_pairs.shingles(texts[3 * n])) ^ simhash_pivots.fingerprint_of(shingle_pairs.shingles(texts[3 * n + 1]))).count("1")
        assert (frozenset((one, two)) in linked) == (bits <= 3)
        assert frozenset((one, short)) not in linked and frozenset((two, short)) not in linked
    assert linked


def test_later_links_contract_their_own_roots_alone(spark, monkeypatch):
    """No later contraction sees the first links again, and few edges need no rounds: each round was jobs on the driver's books."""
    rng = np.random.default_rng(9)
    pairs = [tuple(map(int, rng.choice(300, 2, replace=False))) for _ in range(200)]
    first, more = (spark.createDataFrame([(min(p), max(p)) for p in part], "a long, b long") for part in (pairs[:180], pairs[180:]))
    rows = lambda df: {r.node: r.root for r in df.collect()}
    names, stored = [], simhash_pivots.stored
    monkeypatch.setattr(simhash_pivots, "stored", lambda df, name: names.append(name) or stored(df, name))
    want, roots = rows(simhash_pivots.contract(first.unionByName(more))), simhash_pivots.contract(first)
    assert names == ["edges-0", "parents-1"] * 2
    seen, contract = [], simhash_pivots.contract
    monkeypatch.setattr(simhash_pivots, "contract", lambda edges: seen.append(edges.count()) or contract(edges))
    for local in (1 << 16, 30, 0):  # at once, at the end, never
        monkeypatch.setattr(simhash_pivots, "LOCAL", local)
        assert rows(contract(first.unionByName(more))) == want
        assert rows(simhash_pivots.contract_more(roots, more)) == want
    assert seen == [20] * 3
    assert rows(simhash_pivots.contract_more(roots, more.where("false"))) == rows(roots)
    assert rows(simhash_pivots.contract_more(contract(more.where("false")), first)) == rows(roots)

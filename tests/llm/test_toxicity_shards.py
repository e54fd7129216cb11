"""The classifier learns from all labelled rows, however they are dealt into shards."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tidewatch.llm import toxicity_cnn
from xxhash import xxh64_intdigest

PLAIN = [f"plain{k}" for k in range(60)]


def corpus(spark, toxic_word):
    """Of the ids that are learned from, one clean to eight toxic ones, whose text has `toxic_word(id)`."""
    rng = np.random.default_rng(2)
    ids = [i for i in range(3400) if zlib.crc32(str(i).encode()) % 5]
    rows, marks = [], []
    for i in ids:
        words = rng.choice(PLAIN, 8).tolist()
        if i % 9:
            words.insert(3, toxic_word(i))
        rows.append((i, " ".join(words), "en"))
        marks.append((i, 1, int(i % 9 > 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_rows_beyond_two_thousand_of_a_class_are_learned_from(spark):
    ids = spark.range(3400).where(~toxicity_cnn.held_out(F.col("id")) & F.expr("id % 9 > 0"))
    last = {r.id for r in ids.orderBy(F.xxhash64("id", F.lit("sample")), "id").collect()[2000:]}
    assert len(last) > 100
    model = toxicity_cnn.fitted(*corpus(spark, lambda i: "seldom" if i in last else "nasty"))
    known = xxh64_intdigest("=seldom")
    assert model.row[known % toxicity_cnn.BUCKETS] and model.tag[known % toxicity_cnn.BUCKETS] == known >> 32
    clean, often, seldom = model.score([f"plain1 plain2 {w}" for w in ("plain3", "nasty", "seldom")])
    assert clean < 0.5 < min(often, seldom)


def test_shards_hold_each_labelled_row_once(spark, monkeypatch):
    docs, marks = corpus(spark, lambda i: "nasty")
    odd = spark.createDataFrame([(1, "zz", None), (1, None, "de"), (None, "nasty", "en"), (7000, "no label", "en")], docs.schema)
    more = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (8000, 1, 1), (None, 1, 1), (7, 1, None), (7000, 1, 5)], marks.schema)
    monkeypatch.setattr(toxicity_cnn, "SHARD_BYTES", 40_000)
    packs = toxicity_cnn.sharded(docs.unionByName(odd), marks.unionByName(more)).collect()
    assert len(packs) > 2 and len({p.shard for p in packs}) == len(packs)
    got = [row for p in packs for held in p.rows for row in zip(*toxicity_cnn._unpacked(bytes(held)), strict=True)]
    label = {r.doc_id: r.toxic for r in marks.collect()}
    want = [(r.text, "" if r.doc_id == 1 else r.lang, label[r.doc_id], zlib.crc32(f"apart {r.doc_id}".encode()) % 5 == 0) for r in docs.collect()]
    assert sorted(got) == sorted(want)
    assert [sum(p.n[a] for p in packs) for a in (0, 1)] == [sum(w[3] == a for w in want) for a in (0, 1)]
    assert [sum(p.toxic[a] for p in packs) for a in (0, 1)] == [sum(w[2] for w in want if w[3] == a) for a in (0, 1)]


def test_weights_are_the_mean_of_the_shards(spark, monkeypatch):
    docs, marks = corpus(spark, lambda i: f"nasty{i % 300}")  # some words are in few shards
    monkeypatch.setattr(toxicity_cnn, "SHARD_BYTES", 40_000)
    packs = toxicity_cnn.sharded(docs, marks)
    model = toxicity_cnn.TextCnn([], owners=toxicity_cnn.owned(packs))
    whole = toxicity_cnn.TextCnn([toxicity_cnn.words_of(t) for p in packs.collect() for held in p.rows
                                  for t, _, _, apart in zip(*toxicity_cnn._unpacked(bytes(held)), strict=True) if not apart])
    assert (model.row == whole.row).all() and (model.tag == whole.tag).all() and (model.embedding == whole.embedding).all()
    codes = toxicity_cnn.coded(packs, model)
    model.begin()
    weights, embedding = np.zeros(len(model.embedding)), np.zeros(model.embedding.shape)
    out, n = 0, 0
    for r in codes.collect():
        own = toxicity_cnn.TextCnn.of(model.weights())
        rows, labels, _ = toxicity_cnn._shard(own, bytes(r.rows), False)
        moved = own.fit(rows, labels, 0)
        weights += len(rows) * moved
        embedding += len(rows) * moved[:, None] * own.embedding.astype(float)
        out, n = out + len(rows) * own.out.astype(float), n + len(rows)
    still = np.where(weights[:, None] > 0, 0, model.embedding)
    toxicity_cnn.epoch_of(codes, model, 0)
    assert len(set(weights[1:])) > 2
    np.testing.assert_allclose(model.embedding, still + embedding / np.maximum(weights, 1)[:, None], atol=1e-6)
    np.testing.assert_allclose(model.out, out / n, atol=1e-6)


def test_hashes_are_xxhash(spark):
    rng = np.random.default_rng(3)
    names = ["", "=a", "日本語"] + ["".join(map(chr, rng.integers(97, 900, n))) for n in rng.integers(0, 40, 400)]
    assert toxicity_cnn.hashes(pa.array(names)).tolist() == [xxh64_intdigest(x) for x in names]
    assert toxicity_cnn.hashes(pa.array(names).slice(9, 50)).tolist() == [xxh64_intdigest(x) for x in names[9:59]]

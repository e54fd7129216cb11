"""The ten text operators against plain forms of the same, on small tables with odd rows."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import compare, connect
from tidewatch import llm
from tidewatch.llm import column_packing, common, decontaminate, jump_shards, pii_crf, pii_lines, separator_scan, simhash_pivots
from tidewatch.llm import tokens, toxicity_cnn, url_cascade, warc_index, weighted_minhash

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over the lazy dog and runs far away " * 900
TEXTS = [(1, "Some plain text about nothing at all, with 12 words in it."), (2, ""), (3, None), (4, LONG), (5, LONG), (6, "   \n\t "),
         (7, "ÄÖÜ naïve façade 日本語 🙂 <|endoftext|> it's"), (8, "one two"), (8, "one two"), (None, "a text without an id"), (10, "x" * 5000),
         (11, "Some plain text about nothing at all, with 12 words in it!")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "a") for i, t in TEXTS]
    # columns that clash with names the operators use
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, key string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(name, llm.queries()[name], llm.oracle_sql()[name], spark, SF, connect(SF)).startswith("ok")


def test_token_ids_are_the_tokenizers(spark, reference):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [t for _, t in TEXTS]
    texts += ["It's we'll 'submarine ''s x'''s", "a\x1cb\x85c 3.5%%", "İ ΟΔΟΣ é", "\xa0\xad ¡que!"]
    ids, at = tokens.TokenIds(tokens.default_path()).encode(pa.array(texts, pa.string()))
    for n, t in enumerate(texts):
        assert ids[at[n]:at[n + 1]].tolist() == reference.encode(t or "", add_special_tokens=False).ids


def test_op1_counts_across_blocks(spark, docs, empty, reference):
    streams = separator_scan.write_streams(docs.coalesce(1), block_ids=100)
    blocks = streams.where("tokens is not null")
    assert blocks.count() > 100
    found = separator_scan.separator_scan(blocks.select("file", "block", "tokens", F.lit(1).alias("start")))
    names = {(r.file, r.ordinal): r.doc_id for r in streams.where("tokens is null").collect()}
    reference.encode_special_tokens = True
    want = sorted((-1 if i is None else i, len(reference.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    reference.encode_special_tokens = False
    got = [(names[r.file, r.ordinal], r.n_tokens) for r in found.collect()]
    assert sorted((-1 if i is None else i, n) for i, n in got) == want
    assert separator_scan.separator_scan(separator_scan.write_streams(empty).where("tokens is not null")).count() == 0


def test_op1_flat_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40, 5000).astype("<u2")  # 0 separates; the last document stays open
    ids[-1] = 7
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(np.array([0, 0, 3, 0], "<u2").tobytes())
    (tmp_path / "c.bin").write_bytes(b"")
    got = separator_scan.separator_scan(separator_scan.read_flat_files(spark, str(tmp_path), block_ids=3), end_id=0).collect()
    ends = [-1, *np.flatnonzero(ids == 0).tolist(), len(ids)]
    own = sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in got if r.file.endswith("a.bin"))
    assert own == [(n, a + 1, b - a - 1, b < len(ids)) for n, (a, b) in enumerate(zip(ends, ends[1:]))]
    assert sorted(r.n_tokens for r in got if r.file.endswith("b.bin")) == [0, 0, 1]
    assert not [r for r in got if r.file.endswith("c.bin")]


def test_op1_flat_files_are_read_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(separator_scan, "TASK_BYTES", 4000)
    ids = np.random.default_rng(4).integers(0, 9, 20_001).astype("<u2")
    for name in ("one file é.bin", "two.bin"):
        (tmp_path / name).write_bytes(ids.tobytes())
    blocks = separator_scan.read_flat_files(spark, str(tmp_path), block_ids=100)
    got = blocks.withColumn("task", F.spark_partition_id()).collect()
    per_task = Counter(r.task for r in got)
    assert len(per_task) > 8 and max(per_task.values()) < 200  # of 402 blocks: no task has a whole file
    for name in {r.file for r in got}:
        mine = sorted((r for r in got if r.file == name), key=lambda r: r.block)
        assert [r.block for r in mine] == list(range(201)) and b"".join(r.tokens for r in mine) == ids.tobytes()
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="half an id"):
        separator_scan.read_flat_files(spark, str(tmp_path)).collect()


def check_packing(rows, want):
    """Every id in one piece, sequences gapless and not too long."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert got == want
    return 1 - sum(r.length for r in rows) / (4096 * len(by_sequence))


def test_op2_packs_every_id_once(spark, docs, empty, reference):
    want = Counter()
    for i, t in TEXTS:
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            want[i, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes()), len(ids)] += 1
    check_packing(column_packing.pack_documents(docs).collect(), want)
    assert column_packing.pack_documents(empty).count() == 0


def test_op2_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    histogram = Counter((rng.lognormal(3.5, 1, 20_000).astype(int) % 256 + 1).tolist())
    made, used = Counter(), 0
    for mix, times in column_packing.plan(dict(histogram), 256):
        assert sum(s * k for s, k in mix.items()) <= 256 and times > 0
        used += times
        for s, k in mix.items():
            made[s] += k * times
    assert made == histogram
    assert used <= 1.01 * sum(s * n for s, n in histogram.items()) / 256 + 2
    assert column_packing.plan({}, 256) == [] and column_packing.plan({256: 3}, 256) == [({256: 3 // 3}, 3)]


def test_op3_round_trip(spark, tmp_path):
    rows = [(1, "http://b.example.com/x", "one"), (2, "http://a.example.com/", "two\r\n\r\nWARC/1.1\r\n"), (5, "HTTP://A.example.com/", "one"),
            (9, None, None), (10, "x", ""), (None, "no id", "one"), (11, "http://a.example.com/\r\nx", "é" * 40_000), (2, "http://a.example.com/", "two\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, hex string")
    warc_index.write_archives(pages, str(tmp_path / "w"), archive_bytes=20_000)
    got = warc_index.capture_index(warc_index.read_archives(spark, str(tmp_path / "w"))).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = last[h or ""]
        again = (-1 if i is None else i) < first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(want)
    ordered = sorted(got, key=lambda r: (r.segment, r.position))
    keys = [(r.key, r.at, r.page_id or 0) for r in ordered]
    assert keys == sorted(keys)
    warc_index.write_archives(pages.where("false"), str(tmp_path / "e"))
    assert warc_index.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_op3_loser_tree():
    rng = np.random.default_rng(2)
    for n in range(12):
        runs = [sorted(rng.integers(0, 30, rng.integers(0, 20)).tolist()) for _ in range(n)]
        assert list(warc_index.merge_runs(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_op4_against_plain(spark, docs, empty):
    rows = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in weighted_minhash.edited_fingerprints(docs).collect()}
    texts = sorted(((-(1 << 63) if i is None else i, t or "") for i, t in TEXTS))
    assert len(rows) >= len(TEXTS) - 1
    for n, (i, t) in enumerate(texts):
        after = texts[n - 1][1]
        cut = len(t) // 2
        edited = t[:len(t) - cut] + after[:cut]
        r = rows[None if i < 0 else i, len(t), hashlib.sha256(edited.encode()).hexdigest()]
        assert r.fingerprint == weighted_minhash.fingerprint(t) and r.edited_fingerprint == weighted_minhash.fingerprint(edited)
        assert 0 <= r.near_edited <= 1 and (t != edited or r.near_edited == 1)
    assert weighted_minhash.edited_fingerprints(empty).count() == 0


def test_op4_rate_is_the_weighted_jaccard():
    a, b = "a a a b c d e f f g h i j".split() * 3, "a b b c d d k l m f g n j".split() * 2
    ca, cb = Counter(a), Counter(b)
    true = sum((ca & cb).values()) / sum((ca | cb).values())
    s = weighted_minhash.Sampler(4096)
    assert abs(weighted_minhash.likeness(s.signature(" ".join(a)), s.signature(" ".join(b))) - true) < 0.035


def test_op5_cascade_is_exact(spark):
    n = 3000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 1700, F.lit(".net/p")).alias("url"), F.lit(1).alias("host"))
    pages = pages.unionByName(spark.createDataFrame([(n, None, 1), (n + 1, "no scheme", 1), (n + 2, "x://A.Example.ORG/en/1?q", 1)], "page_id long, url string, host int"))
    listed = spark.range(1700).where("id % 3 = 0").select(F.concat(F.lit("h"), "id", F.lit(".net/p")).alias("key"))
    listed = listed.unionByName(spark.createDataFrame([(None,), ("not seen",)], "key string"))
    for max_words in (url_cascade.MAX_WORDS, 40):  # whole, and in segments
        got = {r.page_id: r for r in url_cascade.judge(pages, listed, max_words=max_words).collect()}
        assert all((got[i].verdict == "block") == (i % 1700 % 3 == 0) for i in range(n))
        assert (got[n].host, got[n].path, got[n].verdict, got[n + 1].host) == ("", "", "allow", "")
        assert (got[n + 2].host, got[n + 2].rule, got[n + 2].verdict) == ("a.example.org", "example.org/en/1", "block")
    assert url_cascade.judge(pages.where("false"), listed).count() == 0
    assert url_cascade.judge(pages, listed.where("false")).where("verdict = 'block'").count() == 1


def plain_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m.group())
        if 13 <= len(d) <= 19 and pii_crf.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return out


def test_op6_rules_are_the_patterns():
    rng = np.random.default_rng(5)
    for _ in range(4000):
        t = "".join(rng.choice(list("a1@..-+2 9(é"), rng.integers(1, 40)))
        assert pii_crf.base_spans(t) == plain_base(t), t
    assert pii_crf.base_spans("1" * 50_000 + " " + "a" * 50_000 + "@" * 3000 + "+1" + " " * 5000) == []


@pytest.fixture(scope="module")
def crf():
    return pii_crf.Crf()


def test_op6_viterbi_is_the_best_of_all_sequences(crf):
    rng = np.random.default_rng(8)
    words = [w for line, _ in pii_crf._table() for w in line]
    for _ in range(150):
        said = list(rng.choice(words, rng.integers(1, 6)))
        emit, steps = crf.scores(said).astype(float), crf.steps

        def total(seq):
            return sum(emit[t, k] for t, k in enumerate(seq)) + sum(steps[j, k] for j, k in itertools.pairwise(seq))

        best = max(map(total, itertools.product(range(5), repeat=len(said))))
        got = crf.labels(said)
        assert total([0] * len(said) if got is None else got.tolist()) == pytest.approx(best, abs=1e-3)
    for _ in range(20):  # long texts: no piece put aside
        said = list(rng.choice(words, 400))
        got, whole = crf.labels(said), crf.viterbi(crf.scores(said)[None], True, True)[0]
        assert np.array_equal(np.zeros(400) if got is None else got, whole)


def test_op6_scores_are_sums_over_features(crf):
    text = "please call me ( 310 555 0142 ) or mail joe dot li at example dot com , fe80::1"
    words = pii_crf._PIECE.findall(text)
    assert "310 555 0142" in words
    plain = np.zeros((len(words), 5))
    for t in range(len(words)):
        for n, place in enumerate(pii_crf.PLACES):
            if 0 <= t + place < len(words):
                plain[t] += sum(crf.weights[n, crf.index[f]] for f in set(pii_crf.features(words[t + place])) if f in crf.index)
        for n, kind in enumerate(pii_crf.KINDS):
            if any(f"cue {kind}" in pii_crf.features(w) for w in words[max(0, t - pii_crf.CUE_REACH):t]):
                plain[t] += crf.near[n]
    assert np.allclose(crf.scores(words), plain, atol=1e-3)


def test_op6_slopes_are_those_of_the_likelihood(crf):
    rng = np.random.default_rng(3)
    emit, there = rng.normal(size=(2, 4, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    mark, pair = crf._marginals(emit, there)
    want_mark, want_pair = np.zeros_like(mark), np.zeros((5, 5))
    for n in range(2):
        size = int(there[n].sum())
        seqs = list(itertools.product(range(5), repeat=size))
        w = np.array([np.exp(sum(emit[n, t, k] for t, k in enumerate(q)) + sum(crf.steps[j, k] for j, k in itertools.pairwise(q))) for q in seqs])
        for q, p in zip(seqs, w / w.sum(), strict=True):
            for t, k in enumerate(q):
                want_mark[n, t, k] += p
            for j, k in itertools.pairwise(q):
                want_pair[j, k] += p
    assert np.allclose(mark, want_mark) and np.allclose(pair, want_pair)


def test_op6_held_out_lines(crf):
    hit, told, there = (dict.fromkeys(pii_crf.KINDS, 0) for _ in range(3))
    for line in pii_lines.lines(held=True):
        text, gold = pii_lines.parted(line)
        for span in (got := pii_crf.find(text, crf)[1]):
            told[span[0]] += 1
        for span in gold:
            there[span[0]] += 1
            hit[span[0]] += span in got
    for kind in pii_crf.KINDS:
        assert there[kind] >= 30 and hit[kind] >= 0.9 * there[kind] and hit[kind] >= 0.9 * told[kind], (kind, hit, told, there)


def test_op6_planted_in_documents_and_nothing_else(spark, crf):
    lines = [pii_lines.parted(x) for x in pii_lines.lines(held=True) if "{" in x]
    found = planted = added = 0
    texts = [r.text or "" for r in common.table(spark, SF, "documents").select("text").collect()]
    for n, text in enumerate(texts):
        base, spans = pii_crf.find(text, crf)
        added += len(spans) - len(base)
        line, gold = lines[n % len(lines)]
        at = text.find(" ", len(text) // 2) + 1
        got = pii_crf.find(f"{text[:at]}{line}\n{text[at:]}", crf)[1]
        planted += len(gold)
        found += sum((k, s + at, e + at) in got for k, s, e in gold)
    assert planted > 50 and found >= 0.9 * planted and added == 0


def test_op6_numbers_lists_and_long_runs(crf):
    for clean in ("1 2 3 " * 3000, "the year 2010 2011 2012 saw 415 555 people", "4111111111111112 of 4000123412341234 rows", "9" * 30_000,
                  "10 200 3000 | 1.5 | 12:30:45 2020-01-02", "a::b and std::map", "x" * 100_000, "12 34 " * 20_000 + "(", "(" * 20_000 + "1"):
        assert pii_crf.crf_spans(clean, crf) == [], clean[:60]
    run = '{"a":"' + "b" * 5000 + '","phone":"(310)555-0142"}'
    assert [run[s:e] for _, s, e in pii_crf.find(run, crf)[1]] == ["(310)555-0142"]
    two = "my number is 310 555 0142, call (310) 555-0143."
    assert [(k, two[s:e]) for k, s, e in pii_crf.find(two, crf)[1]] == [("phone", "310 555 0142"), ("phone", "(310) 555-0143")]
    assert pii_crf.redact_text("ping 2001:db8::1 from the lab", crf) == "ping [IP] from the lab"


def test_op6_null_ids_and_repeats(spark, crf):
    rows = [(None, "call (310) 555-0142 now"), (None, "call (310) 555-0142 now"), (4, None), (4, ""), (4, "mail a@b.de")]
    got = sorted((str(r.doc_id), r.spans) for r in pii_crf.report(spark.createDataFrame(rows, "doc_id long, text string"), crf).collect())
    assert got == [("4", ""), ("4", ""), ("4", "email:5:11"), ("None", "phone:5:19"), ("None", "phone:5:19")]


def test_op6_report_and_redaction(spark, docs, empty):
    more = docs.limit(0).unionByName(spark.createDataFrame(
        [(1, "Mail jo@example.com or +1 (456) 555-2186.", "en", "s", 1, 1, "a"), (2, None, None, None, None, None, None), (3, "clean text of 3 words", "en", "s", 21, 1, "a")], docs.schema))
    got = {r.doc_id: r for r in pii_crf.report(more).collect()}
    assert (got[1].n_email, got[1].n_phone, got[1].spans) == (1, 1, "email:5:19,phone:23:40")
    assert got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest() and got[2].spans == ""
    kept = {r.doc_id: r for r in pii_crf.redact(more).collect()}
    assert kept[1].text == "Mail [EMAIL] or [PHONE]." and kept[1].n_chars == len(kept[1].text)
    assert kept[2].text is None and kept[3].text == "clean text of 3 words"
    assert pii_crf.report(empty).count() == 0 and pii_crf.redact(empty).columns == empty.columns


def plain_jump(key, shards):
    last, ahead = -1, 0
    while ahead < shards:
        last = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((last + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return last


def test_op7_law_and_slots(spark, docs, empty):
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    for n in (1, 2, 16, 17):
        assert jump_shards.jump(keys.copy(), n).tolist() == [plain_jump(int(k), n) for k in keys]
    rows = jump_shards.assign(docs).collect()
    assert len(rows) == len(TEXTS)
    slots = {}
    for r in rows:
        assert r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {i: t for i, t in TEXTS}
    assert all((r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 1, zlib.crc32((texts[r.doc_id] or "").encode())) for r in rows)
    assert jump_shards.assign(empty).count() == 0


def test_gapless_numbers_across_buckets(spark):
    """A third of all rows equal: they are numbered too, and no window or list of buckets is long."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"))
    table = common.stored(common.told_apart(df), "test-rows")
    got = common.gapless(table, ["g"], ["id", "row_no"], "n").collect()
    assert len(got) == 3000
    for g in (None, 0, 1):
        assert sorted(r.n for r in got if r.g == g) == list(range(1000))
    bucket = F.pmod(F.xxhash64("id", "row_no", F.lit("gapless")), F.lit(55))
    sizes = [r["count"] for r in table.groupBy("g", bucket.alias("b")).count().collect()]
    assert max(sizes) <= 60 and len(sizes) <= 3 * 55


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_op8_against_plain(spark, empty):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, "x, " + item.upper() + " y"), (2, "alpha beta gamma"), (3, "SHORT-item here"), (4, None), (5, ""), (5, "İÀ alpha"),
            (None, "and " + item + " " + item), (7, item[:40]), (8, "short item"), (8, "short item"), (9, "short; ITEM short item")]
    bench = [(10, item), (9, "short item"), (11, None), (12, "..."), (10, item), (None, "beta gamma delta epsilon zeta eta theta iota kappa lambda")]
    d = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, _text string")
    b = spark.createDataFrame([(*r, "c") for r in bench], "item_id long, text string, w string")
    grams = {}
    for i, t in bench:
        w = plain_words(t)
        k = min(10, len(w))
        for at in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[at:at + k]), set()).add("" if i is None else str(i))
    want = Counter()
    for i, t in rows:
        w, hit, items = plain_words(t), set(), set()
        for gram, names in grams.items():
            for at in range(len(w) - len(gram) + 1):
                if tuple(w[at:at + len(gram)]) == gram:
                    hit.update(range(at, at + len(gram)))
                    items |= names
        want[i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
    # names that the operator uses itself
    d = d.withColumns({c: F.lit(c) for c in ("_id", "_t", "_hit", "_items", "_size", "hash", "bytes", "at", "hit", "items", "id", "row", "w", "n")})
    got = decontaminate.report(d, b).collect()
    assert Counter(tuple(r) for r in got) == want
    cleaned = decontaminate.clean(d, b)
    assert {r.doc_id for r in cleaned.collect()} == {2, 4, 5, 7} and cleaned.exceptAll(d).isEmpty() and cleaned.schema == d.schema
    spans = decontaminate.clean(d, b, remove="span")
    assert spans.columns == d.columns and spans.drop("text").exceptAll(d.drop("text")).isEmpty()
    cut = {r.doc_id: r.text for r in spans.collect()}
    assert cut[1] == "x, y" and cut[None] == "and " and cut[2] == "alpha beta gamma" and cut[4] is None
    assert decontaminate.report(empty, b).count() == 0
    assert decontaminate.report(d, b.where("false")).where("contaminated").count() == 0


def test_op8_without_a_broadcast_finds_the_same_in_long_texts(spark):
    rng = np.random.default_rng(8)
    words = [f"v{n}" for n in range(40)]
    passage = [" ".join(rng.choice(words, 30)) for _ in range(20)]
    texts = [" ".join(np.concatenate([rng.choice(words, 20_000), passage[n].split()])) for n in range(3)]
    texts += [f"{' '.join(rng.choice(words, 50))} {passage[n % 20][10:120]} tail" for n in range(60)] + [texts[0], "v1", ""]
    d = spark.createDataFrame([(n if n % 7 else None, t) for n, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(n, p) for n, p in enumerate([*passage, "v1", "v2 v3"])], "item_id long, text string")
    grams = common.stored(decontaminate.windows(b), "test-windows")
    one = decontaminate.hits(d, grams).withColumn("items", F.array_sort("items"))
    two = decontaminate.hits(d, grams, broadcast_bytes=0).withColumn("items", F.array_sort("items"))
    assert "BroadcastExchange" in one._jdf.queryExecution().executedPlan().toString()
    assert one.distinct().count() > 100 and one.distinct().exceptAll(two.distinct()).isEmpty() and two.distinct().exceptAll(one.distinct()).isEmpty()


def test_op9_learns_held_out_rows(spark):
    rng = np.random.default_rng(4)
    plain = [f"w{n}" for n in range(300)]
    rows, labels = [], []
    for i in range(700):
        words = rng.choice(plain, rng.integers(5, 60)).tolist()
        toxic = i % 3 == 0
        if toxic:
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["nasty", "vilest", "vilely"])))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None, None, None), (900, "", "de", "s"), (900, LONG, None, "s")], "doc_id long, text string, lang string, score string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity_cnn.fitted(docs, marks)
    docs = docs.withColumns({"threshold": F.lit("t"), "rejected": F.lit("r"), "row": F.lit(1)})  # names that the operator uses itself
    got = toxicity_cnn.scored(docs, model).collect()
    held = [r for r in got if r.row.doc_id is not None and r.row.doc_id < 700 and zlib.crc32(str(r.row.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([(r.score >= 0.5) == (r.row.doc_id % 3 == 0) for r in held]) > 0.95
    assert toxicity_cnn.clean(docs, marks).exceptAll(docs).isEmpty()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 703
    assert toxicity_cnn.clean(docs, marks).columns == docs.columns
    assert {r.score for r in toxicity_cnn.scored(docs, toxicity_cnn.fitted(docs, marks.where("false"))).collect()} == {0.0}
    assert toxicity_cnn.clean(docs.where("false"), marks).count() == 0


def plain_simhash(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(fps):
        for b in fps[n + 1:]:
            if bin(a ^ b).count("1") <= 3:
                up[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_op10_fingerprints_and_components(spark, docs, empty):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    both = own.unionByName(docs.select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    texts = [(r.doc_id, r.text) for r in both.collect()]
    fps = {i: plain_simhash(t) for i, t in texts if i is not None}
    sets = plain_components(sorted({plain_simhash(t) for _, t in texts}))
    least = {}
    for i, f in fps.items():
        least[sets[f]] = min(least.get(sets[f], i), i)
    got = simhash_pivots.near_duplicates(both).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", least[sets[fps[r.doc_id]]])
    kept = simhash_pivots.dedup(docs).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == sorted(
        {min((-1 if j is None else j) for j, u in TEXTS if sets[plain_simhash(u)] == sets[plain_simhash(t)]
             and (j is not None or all(k is None for k, v in TEXTS if sets[plain_simhash(v)] == sets[plain_simhash(t)]))) for _, t in TEXTS})
    assert kept[0].__fields__ == docs.columns and simhash_pivots.dedup(empty).count() == 0


def test_op10_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(6)
    centre = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    fps = set()
    for c in centre:
        for _ in range(120):
            x = c
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    want = plain_components(fps)
    groups = len(set(want.values()))
    for chunk in (1024, 7):  # whole keys, and keys cut into chunks
        roots = {r.node: r.root for r in simhash_pivots.contract(simhash_pivots.links(df, chunk=chunk)).collect()}
        found = {f: roots.get(s, s) for f, (s,) in zip(fps, signed)}
        assert len(set(found.values())) == groups
        assert len({(want[f], found[f]) for f in fps}) == groups


def test_op4_samples_do_not_depend_on_what_is_kept():
    texts = ["a b c d e f g h a b", "h i j k l a a a", "", "m n o p q r s t u v w x y z a b c", "a b c d e f g h a b"]
    small, large = weighted_minhash.Sampler(64, rows=6), weighted_minhash.Sampler(64, rows=1000)
    assert [small.signature(t) for t in texts] == [large.signature(t) for t in texts]


def test_op4_draws_a_term_from_three_mixes(monkeypatch):
    mixes, mix = [], weighted_minhash._scatter
    monkeypatch.setattr(weighted_minhash, "_scatter", lambda x: mixes.append(x.shape) or mix(x))
    s = weighted_minhash.Sampler(16)
    s.signature("a b b c")
    assert mixes == [(3, 16)] * 3
    s.signature("c b a b")
    assert len(mixes) == 3

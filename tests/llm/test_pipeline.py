"""The pipeline: each stage does what it says to its own input, and keeps the rest."""

import __spark_entry__ as entry
import corpus_pipeline
from tidewatch.llm import decontaminate, pii_crf
from tidewatch.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, columns = table(spark, SF, "documents"), None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (before, docs)
    columns = table(spark, SF, "documents").columns
    assert all(after.columns == columns for _, after in list(seen.values())[:-1])
    for name in ("toxicity", "simhash", "decontamination"):
        before, after = seen[name]
        assert after.exceptAll(before).isEmpty() and 0 < after.count() <= before.count()
    before, after = seen["decontamination"]
    judged = decontaminate.report(before, table(spark, SF, "benchmark"))
    assert {r.doc_id for r in judged.where("NOT contaminated").collect()} == {r.doc_id for r in after.collect()}
    before, after = seen["pii"]
    crf = pii_crf.Crf()
    now = {r.doc_id: r.text for r in after.collect()}
    assert now == {r.doc_id: pii_crf.redact_text(r.text, crf) for r in before.collect()}
    assert all(not pii_crf.base_spans(t) for t in now.values())
    before, after = seen["packing"]
    tokens = {r.doc_id: r.doc_tokens for r in after.collect()}
    assert set(tokens) == set(now)
    assert after.groupBy("doc_id").sum("length").exceptAll(after.select("doc_id", "doc_tokens").distinct()).isEmpty()


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in names)] == []


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0

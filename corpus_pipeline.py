"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's `docs`. All but the last return the columns of
`documents`:

    toxicity         documents that the classifier rejects go
    simhash          of each component of near-duplicates one document stays; linked is what is
                     0.8 alike or more in its 5-word shingles; SimHash (3 bits) makes the first
                     candidates, min-hashes those beyond its reach, the sets themselves decide;
                     components, contraction and the choice of the row are op10's
    decontamination  documents that hold a passage of the benchmark go
    pii              personal data is replaced by its kind, n_chars follows the text
    packing          the pieces of all texts, in sequences of at most 4096 tokens

Stages that keep a document keep it unchanged but for what the stage says. Null and empty
texts are texts without words: they are no duplicates of others but of each other, hold no
passage and no personal data, and are packed as their closing id alone. Rows without an id,
repeated rows and further columns pass through; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import column_packing, decontaminate, pii_crf, shingle_pairs, toxicity_cnn
from tidewatch.llm.common import prepare, stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_cnn.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return shingle_pairs.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii_crf.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return column_packing.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("simhash", near_duplicates), ("decontamination", decontamination),
          ("pii", pii), ("packing", packing)]

#: A trained classifier, fingerprints, a random field and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

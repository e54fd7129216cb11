"""Mixing sources to target weights by a low-discrepancy schedule.

Each source has a weight; the mix holds `share` times all words, dealt by weight, but no
source gives more than `epochs` times its own words (what it cannot give is dealt again). The
documents of a source, shuffled by a hash, stand one behind the other and are cut into blocks of
equal words; a source whose words do not suffice begins again at its first document.

The schedule has 2^k slots, as few as hold all blocks. The van der Corput point of a slot is
its number with the bits in reverse, over 2^k; points are mapped through the cumulative
numbers of blocks of the sources, so a slot belongs to the source in whose stretch its point
lies, or to none. As 2^k points lie one in each of 2^k equal stretches, each source has just as
many slots as blocks, and in any run of slots nearly its share of them. The slots of a source
are ranked, and the block of the same rank is joined to each. All of it is DataFrame functions;
texts stay where they are read, only sizes and hashes travel.

No group is numbered in one task: documents are summed in hash buckets, slots in stretches, and
buckets and stretches are added up. Rows that are equal in everything are summed as one with its
number of copies and told apart again by that number, piece by piece.

Defined cases: a null text has no words; a document without words is in no block and none of it
is taken; null ids and null sources are values of their own (the null source is last); repeated
rows are documents of their own; an empty table gives no rows, a table without words takes
nothing; other columns are not read. The order depends on ids, sources and texts alone, so runs agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, table

#: Weights of the sources in order, repeating: fixed values.
WEIGHTS = (5, 2, 1)
#: Words of the mix over all words; times that a source is read at most.
SHARE, EPOCHS = 1.5, 2
#: Words of a block.
BLOCK = 2048
#: Slots that one window ranks, cells of the grid through which points find their source.
STRETCH, CELLS = 1 << 16, 1 << 12
#: Sources that one window sums up.
SOURCES = 100_000
#: Copies of one row that are told apart at once.
COPIES = 10_000
_WORD = r"[^\x20\x09-\x0D]+"


def documents_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash): what the mix needs of a document; one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"), F.md5(named.cast("binary")).alias("hash"))


def numbered_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, number, weight): sources from 0 by code point, null last.

    Sources are laid in ranges; a range is numbered by itself and starts where the ranges before it end.
    """
    sizes = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    laid = stored(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = laid.groupBy("range").agg(F.count("*").alias("n")).select(
        F.col("range").alias("_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    ranked = laid.withColumn("own", F.row_number().over(own).cast("long") - 1).join(starts, F.col("range") == F.col("_range"))
    number = F.col("own") + F.col("start")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    return stored(ranked.select("source", "source_size", number.alias("number"), weight.cast("long").alias("weight")), "mix-numbered")


def with_targets(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """`sources` with target and quota (whole words) of each, by filling all to one level of words a weight.

    A round sums up the sources that the level fills; there are few, as each round fills one more at least.
    """
    most = F.col("source_size") * epochs
    level, full = None, -1
    while True:
        filled = F.lit(False) if level is None else most <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum("source_size").alias("all"), F.count(F.when(filled, 1)).alias("full"), F.sum(F.when(filled, most)).alias("most"),
                          F.sum(F.when(~filled, F.col("weight"))).alias("weights")).first()
        if row["full"] == full or not row["weights"]:
            break
        full, level = row["full"], (share * (row["all"] or 0) - (row["most"] or 0)) / row["weights"]
    target = F.least(most.cast("double"), F.col("weight") * F.lit(float(level or 0.0)))
    return sources.withColumn("target", target).withColumn("quota", F.least(most, F.floor(target + 0.5)))


def _reversed(number: Column, bits: int) -> Column:
    """The lowest `bits` bits of a number, in reverse; up to 62."""

    def half(x: Column) -> Column:
        for by, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
            x = F.shiftleft(x.bitwiseAND(F.lit(mask).cast("long")), by).bitwiseOR(F.shiftright(x, by).bitwiseAND(F.lit(mask).cast("long")))
        return x

    low = half(number.bitwiseAND(F.lit(0xFFFFFFFF)))
    if bits <= 32:
        return F.shiftright(low, 32 - bits)
    high = half(F.shiftright(number, 32))
    return F.shiftleft(low, bits - 32).bitwiseOR(F.shiftright(high, 64 - bits))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source_no, rank): which block of which source stands in each slot that is used."""
    blocks = sources.select(F.col("number").alias("source_no"), F.ceil(F.col("quota") / block).cast("long").alias("blocks"))
    total = blocks.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(total, 2))))
    upto = _running(sources.sparkSession, blocks)
    cell = max(0, bits - int(math.log2(CELLS)))
    spread = upto.where("blocks > 0").withColumn("cell", F.explode(F.sequence(F.shiftright("first", cell), F.shiftright(F.col("first") + F.col("blocks") - 1, cell))))
    slots = sources.sparkSession.range(1 << bits if total else 0).select(F.col("id").alias("slot"), _reversed(F.col("id"), bits).alias("point"))
    slots = slots.where(F.col("point") < total).withColumn("_cell", F.shiftright("point", cell))
    inside = (F.col("_cell") == F.col("cell")) & (F.col("point") >= F.col("first")) & (F.col("point") < F.col("first") + F.col("blocks"))
    mapped = slots.join(spread, inside).select("slot", "source_no", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    own = Window.partitionBy("source_no", "stretch").orderBy("slot")
    ranked = mapped.withColumn("own", F.row_number().over(own).cast("long") - 1)
    if 1 << bits <= STRETCH:
        return ranked.select("slot", "source_no", F.col("own").alias("rank"))
    before = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = mapped.groupBy("source_no", "stretch").agg(F.count("*").alias("n")).select(
        F.col("source_no").alias("_no"), F.col("stretch").alias("_stretch"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    on = (F.col("source_no") == F.col("_no")) & (F.col("stretch") == F.col("_stretch"))
    return ranked.join(starts, on).select("slot", "source_no", (F.col("own") + F.col("start")).alias("rank"))


def _running(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """`blocks` with `first`: the blocks of all sources before; groups of sources are summed, then added up."""
    grouped = blocks.withColumn("group", F.floor(F.col("source_no") / SOURCES))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row for SOURCES sources
    starts = grouped.groupBy("group").agg(F.sum("blocks").alias("n")).select(
        F.col("group").alias("_group"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("group").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.withColumn("own", F.coalesce(F.sum("blocks").over(own), F.lit(0))).join(starts, F.col("group") == F.col("_group")).select(
        "source_no", "blocks", (F.col("own") + F.col("start")).alias("first"))


def placed(documents: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Every document with words, and `start`: the words of its source before it in the shuffled order."""
    equal = documents.where("size > 0").groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("copies"))
    buckets = max(1, math.ceil(math.sqrt(rows)))  # as many as each has rows, so neither grows as the rows do
    # leading digits of the hash, so buckets follow each other as their hashes do
    dealt = equal.join(sources.select(F.col("source").alias("_source"), F.col("number").alias("source_no"), "source_size", "quota"),
                       F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    lead = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    dealt = dealt.withColumns({"words": F.col("size") * F.col("copies"), "bucket": F.floor(lead * buckets / (1 << 32))})
    own = Window.partitionBy("source_no", "bucket").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("start", F.coalesce(F.sum("words").over(own), F.lit(0)))
    if buckets > 1:
        before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = dealt.groupBy("source_no", "bucket").agg(F.sum("words").alias("n")).select(
            F.col("source_no").alias("_no"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
        summed = summed.join(starts, (F.col("source_no") == F.col("_no")) & (F.col("bucket") == F.col("_bucket"))).withColumn("start", F.col("start") + F.col("_start"))
    single = summed.select("doc_id", "source_no", "source_size", "quota", "size", "start", "hash", "copies")
    many = single.where("copies > 1").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES))))
    many = many.repartition("hash", "lot").withColumn("copy", F.explode(F.sequence(F.col("lot"), F.least(F.col("lot") + (COPIES - 1), F.col("copies") - 1))))
    apart = many.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("lot", "copy")
    return single.where("copies = 1").unionByName(apart).drop("copies")


def _prepared(docs: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, sources with targets, and places, all stored."""
    documents = stored(documents_of(docs), "mix-documents")
    sources = stored(with_targets(numbered_sources(documents, weights), share, epochs), "mix-targets")
    return documents, sources, stored(placed(documents, sources, documents.count()), "mix-places")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, block: int = BLOCK,
        place: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """The mix: pieces in slots. (slot, at: words before it in the slot, doc_id, hash, source_no, start, word: first word of the
    piece in its document, words). Slots in order, and pieces by `at` in each, are the mix; a source's last block may be short.
    """
    if place is None or sources is None:
        _, sources, place = _prepared(docs, weights, share, epochs)
    rounds = place.withColumn("from", F.explode(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: e * F.col("source_size") + F.col("start"))))
    to = F.least(F.col("from") + F.col("size"), F.col("quota"))
    rounds = rounds.withColumn("to", to).where(F.col("to") > F.col("from"))
    pieces = rounds.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    lead = F.greatest(F.col("from"), F.col("block") * block)
    pieces = pieces.select("doc_id", "hash", F.col("source_no").alias("_no"), "start", "block", (lead - F.col("block") * block).alias("at"),
                           (lead - F.col("from")).alias("word"), (F.least(F.col("to"), (F.col("block") + 1) * block) - lead).alias("words"))
    slots = schedule(sources, block)
    return pieces.join(slots, (F.col("_no") == F.col("source_no")) & (F.col("block") == F.col("rank"))).select(
        "slot", "at", "doc_id", "hash", "source_no", "start", "word", "words")


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix with the words themselves: (slot, at, doc_id, words, text), a row a piece; read it in the order of slot and at."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    once = docs.select(F.md5(named.cast("binary")).alias("_hash"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("_w")).dropDuplicates(["_hash"])
    return mix(docs, **how).join(once, F.col("hash") == F.col("_hash")).select(
        "slot", "at", "doc_id", "words", F.array_join(F.slice("_w", (F.col("word") + 1).cast("int"), F.col("words").cast("int")), " ").alias("text"))


def report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    documents, sources, place = _prepared(docs, weights, share, epochs)
    pieces = mix(docs, weights, share, epochs, block, place, sources)
    taken = pieces.groupBy("source_no", "start").agg(F.sum("words").alias("taken")).withColumnsRenamed({"source_no": "_no", "start": "_start"})
    held = place.join(taken, (F.col("source_no") == F.col("_no")) & (F.col("start") == F.col("_start")), "left")
    held = held.select("doc_id", "size", F.col("source_no"), F.coalesce("taken", F.lit(0)).alias("taken"))
    of = sources.select("source", F.col("number").alias("_no"), "source_size", "target")
    wordless = documents.where("size = 0").join(of, documents["source"].eqNullSafe(of["source"])).select(
        "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return held.join(of.drop("source"), F.col("source_no") == F.col("_no")).select("doc_id", "size", "source_size", "target", "taken").unionByName(wordless)


def op11_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by the weights of their sources."""
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_schedule": op11_source_schedule}

ORACLE = {"op11_source_schedule": r"""
WITH d AS (SELECT doc_id::bigint AS doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
                  md5(concat(coalesce(doc_id::varchar, ''), ':', coalesce(text, ''))) AS hash FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int] AS weight FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size AS most, 2.0::double * source_size / weight AS rate FROM s),
f AS (SELECT *, sum(most) OVER upto AS filled, sum(weight) OVER () - sum(weight) OVER upto AS rest FROM c
      WINDOW upto AS (ORDER BY rate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT (1.5::double * (SELECT sum(source_size) FROM s) - coalesce(max(filled) FILTER (full_up), 0)::double)
             / coalesce(min(rest) FILTER (full_up), (SELECT sum(weight) FROM s))::double AS level
      FROM (SELECT *, filled::double + rate * rest::double <= 1.5::double * (SELECT sum(source_size) FROM s) AS full_up FROM f)),
t AS (SELECT source, source_size, least(most::double, weight::double * level) AS target FROM f, l),
q AS (SELECT *, least(2 * source_size, floor(target + 0.5)::bigint) AS quota FROM t),
p AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.quota,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (greatest(least(start + size, quota) - start, 0) + greatest(least(start + source_size + size, quota) - start - source_size, 0))::bigint AS taken FROM p"""}

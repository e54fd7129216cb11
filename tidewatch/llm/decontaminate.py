"""Benchmark decontamination by a broadcast hash set of test n-grams.

Benchmark texts and documents are lower-cased (A-Z) and cut into words the same way. Every
window of `width` consecutive benchmark words goes into a set, keyed by its hash (an item
of fewer words is one window by itself); the set is broadcast while its bytes are proven
few, else joined by shuffles that carry hashes and places, no texts. Documents are cut into
words once: the hash of two words in a row is looked up among the beginnings of all windows,
that of the whole window only then, and a hit is verified word for word. All of it is
DataFrame functions.

Defined cases: a null or empty text, or one without words, has no words, no hits and is
clean; a benchmark item without words has no window; a null item id counts as the empty
id; repeated items or repeated windows count once; repeated documents are judged one by
one; an empty benchmark leaves all documents clean; an empty document table gives no rows;
all columns of the caller stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, table

WIDTH = 10
#: Bytes of windows, items and hashes up to which the set is broadcast.
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of lower-cased text, and of text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z only; `lower` does that, and faster, where there is nothing but ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The set: window (text), size in words, its items, hash of it and of its first two words."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    each = items.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    grams = each.select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("g"))
    one = grams.groupBy(F.array_join("g", " ").alias("window"), "size").agg(
        F.collect_set("item").alias("items"), F.first(F.xxhash64(F.get("g", F.lit(0)), F.get("g", F.lit(1)))).alias("head"))
    return one.withColumn("hash", F.xxhash64("window", "size"))


_KEYS = ("id", "hash", "bytes")


def _keys(text: str = "text", id_: str = "doc_id") -> list[Column]:
    """A document row, or rows that are the same: its id and its text."""
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.col(id_).alias("id"), F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes")]


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Documents without id have hits too, so nulls match."""
    return left["id"].eqNullSafe(right["id"]) & (left["hash"] == right["hash"]) & (left["bytes"] == right["bytes"])


def hits(docs: DataFrame, grams: DataFrame, broadcast_bytes: int | None = None) -> DataFrame | None:
    """Where windows of `grams` (stored, from `windows`) occur: id, hash, bytes, at (from 0), size, items; None without windows."""
    size = grams.agg(F.sum(F.octet_length("window") + F.octet_length(F.array_join("items", ",")) + 64).alias("bytes"),
                     F.min("size").alias("least")).first()
    if size["bytes"] is None:
        return None
    small = size["bytes"] <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)
    hint = F.broadcast if small else (lambda d: d)
    texts = docs.select(*_keys(), words(F.col("text")).alias("w"))
    second = F.get("w", F.col("at") + 1)
    spots = texts.select("*", F.posexplode("w").alias("at", "word")).withColumn("n", F.size("w"))
    if size["least"] == 1:  # windows of one word have no second one
        spots = spots.withColumn("two", F.explode(F.array(F.xxhash64("word", second), F.xxhash64("word", F.lit(None).cast("string")))))
    else:
        spots = spots.withColumn("two", F.xxhash64("word", second))
    heads = hint(grams.groupBy("head").agg(F.collect_set("size").alias("sizes")))
    carried = [*_KEYS, "at", "n", *(["w"] if small else [])]
    near = spots.select(*carried, "two").join(heads, F.col("two") == F.col("head")).select(*carried, F.explode("sizes").alias("size"))
    near = near.where(F.col("at") + F.col("size") <= F.col("n"))
    if not small:  # the words come back to the places that are left, once a document
        places = near.groupBy(*_KEYS).agg(F.collect_set(F.struct("at", "size")).alias("places"))
        # rows that are the same share their places
        back = texts.dropDuplicates(list(_KEYS))
        near = places.join(back, _same(places, back)).select(*[places[k] for k in _KEYS], "w", F.explode("places").alias("p")).select(*_KEYS, "w", "p.*")
    near = near.select(*_KEYS, "at", "size", F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ").alias("spot"))
    known = hint(grams.select(F.col("hash").alias("gram"), "window", F.col("size").alias("of"), "items"))
    found = near.join(known, (F.xxhash64("spot", "size") == F.col("gram")) & (F.col("spot") == F.col("window")) & (F.col("size") == F.col("of")))
    return found.select(*_KEYS, "at", "size", "items")


def _judged(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame | None:
    """Per distinct document with hits: its keys, hit word numbers and items."""
    found = hits(docs, stored(windows(benchmark, width), "benchmark-windows"))
    if found is None:
        return None
    return found.groupBy(*_KEYS).agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1)))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: words, hit words, items found in it, and whether it is contaminated."""
    n_words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD_ANY_CASE)).cast("long")
    all_ = docs.select(*_keys(), n_words.alias("n_words"))
    judged = _judged(docs, benchmark, width)
    none = F.array().cast("array<string>")
    if judged is None:
        all_ = all_.withColumns({"hit": none, "items": none})
    else:
        all_ = all_.join(judged, _same(all_, judged), "left").select(all_["id"], "n_words", "hit", "items")
    n_hit = F.when(F.col("hit").isNull(), 0).otherwise(F.size("hit"))
    return all_.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, remove: str = "document") -> DataFrame:
    """`docs` with all its columns, without contaminated documents, or without the hit words in them.

    With `remove="span"` each hit word goes together with what stands between it and the word after it.
    """
    if remove not in ("document", "span"):
        raise ValueError("remove is 'document' or 'span'")
    judged = _judged(docs, benchmark, width)
    if judged is None:
        return docs
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_keys())
    if remove == "document":
        return rows.join(judged, _same(rows, judged), "left_anti").select("row.*")
    joined = rows.join(judged, _same(rows, judged), "left").select("row", "hit")
    text = F.col("row.text")
    lead = F.regexp_extract(text, f"^{_GAP_ANY_CASE}", 0)
    parts = F.regexp_extract_all(text, F.lit(f"{_WORD_ANY_CASE}(?:{_GAP_ANY_CASE})?"), F.lit(0))
    kept = F.filter(parts, lambda part, n: ~F.array_contains(F.col("hit"), n))
    left = F.when(F.col("hit").isNull(), text).otherwise(F.concat(lead, F.array_join(kept, "")))
    return joined.withColumn("row", F.col("row").withField("text", left)).select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against every benchmark item."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontaminate": op8_decontaminate}

_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {"op8_decontaminate": f"""
WITH items AS (SELECT item_id::varchar AS item, {_CUT} AS w FROM benchmark),
grams AS (SELECT DISTINCT item, least(len(w), 10) AS size,
                 unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS gram
          FROM items WHERE len(w) > 0),
d AS (SELECT doc_id, {_CUT} AS w FROM documents),
spots AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d, (SELECT DISTINCT size FROM grams) WHERE len(w) >= size),
found AS (SELECT doc_id, pos, s.size, item FROM (SELECT doc_id, pos, size, array_to_string(w[pos:pos + size - 1], ' ') AS gram FROM spots) s
          JOIN grams g ON s.gram = g.gram AND s.size = g.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(c.n, 0)::bigint AS n_hit, coalesce(m.n, 0)::bigint AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id"""}

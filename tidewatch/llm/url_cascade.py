"""URL filters by a cascade of Bloom filters.

Level 0 encodes the listed keys. Over the complete universe of keys, the unlisted ones that
level 0 lets through are encoded in level 1, the listed ones that level 1 lets through in
level 2, and so on, until none are left. A key of the universe is listed exactly if the
first level that rejects it has an odd number. Each level is a word array, built by
aggregates and read as a scalar subquery, so pages are judged without any join, in
DataFrame functions alone. Levels beyond MAX_WORDS are cut by key hash into segments, each
judged with its own cascade.

Before the cascade come a few fixed rules of (host, path prefix); the longest that fits a
URL decides, and only URLs that none fits are judged by the cascade.

Defined cases: a null URL or one without `://` has an empty host and path and is allowed;
repeated pages are judged one by one; an empty list allows all; an empty table gives no
rows; other columns are not read. Null listed keys are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, table

#: (host, path prefix, verdict): fixed values.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Host labels whose pages the query lists: fixed values.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: 64-bit words that one level may have before keys are cut into segments: 16 MB.
MAX_WORDS = 1 << 21
#: Each level halves what is left at least, so this many are never needed.
MAX_LEVELS = 100


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def _by_rule(host: Column, path: Column, rules, value) -> Column:
    """`value(rule)` of the longest rule that fits, null if none does."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        found = F.when(_fits(host, path, rule), value(rule)) if found is None else found.when(_fits(host, path, rule), value(rule))
    return F.lit(None).cast("string") if found is None else found


def _spots(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Bits of a key: double hashing, other bits at every level."""
    one, two = (F.xxhash64(key, F.lit(2 * level + k)).bitwiseAND(F.lit((1 << 48) - 1)) for k in (0, 1))  # sums fit 64 bits
    return [(one + F.lit(n) * two) % F.lit(bits).cast("long") for n in range(hashes)]


def _level(keys: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
    """One row: the words of a Bloom filter of `keys` (key)."""
    words = bits // 64
    spots = keys.select(F.explode(F.array(*_spots(F.col("key"), level, bits, hashes))).alias("bit"))
    set_bits = F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))"))
    full = spots.groupBy(F.floor(F.col("bit") / 64).cast("long").alias("word")).agg(set_bits.alias("set"))
    empty = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set"))
    each = full.unionByName(empty).groupBy("word").agg(F.bit_or("set").alias("set"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("words"))


class Cascade:
    """The levels over one universe; `listed(key)` is exact for its keys."""

    def __init__(self) -> None:
        self.levels: list[tuple[DataFrame, int, int]] = []

    def _inside(self, key: Column, level: int) -> Column:
        words, bits, hashes = self.levels[level]
        held, all_set = words.scalar(), None
        for spot in _spots(key, level, bits, hashes):
            one = F.getbit(F.get(held, F.floor(spot / 64).cast("int")), (spot % 64).cast("int")) == 1
            all_set = one if all_set is None else all_set & one
        return all_set

    def listed(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(~self._inside(key, level), F.lit(level % 2 == 1)).otherwise(answer)
        return answer


def sizes(n_in: int, n_out: int, level: int) -> tuple[int, int]:
    """Bits (whole words) and hashes for `n_in` keys against `n_out` others."""
    rate = 0.5 if level else min(0.5, max(1e-4, n_in * math.sqrt(0.5) / max(1, n_out)))
    hashes = max(1, round(-math.log2(rate)))
    return 64 * max(1, math.ceil(n_in * hashes / math.log(2) / 64)), hashes


def build(universe: DataFrame) -> Cascade:
    """Cascade over a stored table of distinct keys (key, listed)."""
    out = Cascade()
    counts = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    inner, outer = universe.where("listed").select("key"), universe.where("NOT listed").select("key")
    n_in, n_out = counts.get(True, 0), counts.get(False, 0)
    while n_in:
        level = len(out.levels)
        if level == MAX_LEVELS:
            raise RuntimeError("the cascade does not end: are the keys distinct?")
        bits, hashes = sizes(n_in, n_out, level)
        out.levels.append((stored(_level(inner, level, bits, hashes), f"cascade-{level}"), bits, hashes))
        passed = stored(outer.where(out._inside(F.col("key"), level)), f"cascade-passed-{level}")
        inner, outer, n_in, n_out = passed, inner, passed.count(), n_in
    return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, max_words: int = MAX_WORDS) -> DataFrame:
    """Verdict for every row of `pages` (page_id, url); `listed`: column key, as host and path."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", "path"))
    names = listed.select(F.col("key").cast("string").alias("key")).where(F.col("key").isNotNull())
    both = seen.select("key", F.lit(False).alias("listed")).unionByName(names.select("key", F.lit(True).alias("listed")))
    # before the shuffle a task keeps one row a key, however often a page occurs
    universe = stored(both.groupBy("key").agg(F.max("listed").alias("listed")), "url-universe")
    n = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    words = sizes(n.get(True, 0), n.get(False, 0), 0)[0] // 64
    segments = max(1, math.ceil(words / max_words))
    segment = F.pmod(F.xxhash64("key", F.lit("segment")), F.lit(segments).cast("long"))
    rule = _by_rule(F.col("host"), F.col("path"), rules, lambda r: F.lit(r[0] + r[1]))
    ruled = _by_rule(F.col("host"), F.col("path"), rules, lambda r: F.lit(r[2]))
    out = None
    for k in range(segments):
        own, rows = (universe, seen) if segments == 1 else (universe.where(segment == k), seen.where(segment == k))
        cascade = build(own)
        verdict = F.coalesce(ruled, F.when(cascade.listed(F.col("key")), "block").otherwise("allow"))
        part = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
        out = part if out is None else out.unionByName(part)
    return out


def listed_pages(pages: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """Keys of all pages on a host with one of these labels."""
    host = host_of(F.col("url"))
    on_list = F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, labels)))
    return pages.where(on_list).select(F.concat(host, path_of(F.col("url"))).alias("key"))


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed_pages(pages))


QUERIES = {"op5_url_cascade": op5_url_cascade}

ORACLE = {"op5_url_cascade": r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                     WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                     WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
            ELSE 'allow' END AS verdict
FROM r"""}

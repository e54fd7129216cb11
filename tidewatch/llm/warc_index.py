"""WARC archives and an externally merged capture index.

Every page becomes a WARC record; Spark's text writer, given the record terminator as line
separator, writes plain WARC files to the shared folder. Pages with equal payloads share a
response record, the others are revisit records that name it. Reading the archives back
parses each file, checks every payload against its digest, and leaves a run: the captures
of one archive sorted by URL key and timestamp. Runs are dealt into key ranges, and each
range merges its runs with a loser tree, so captures come out in global order: ranges in
turn, rows in turn within a range.

Defined cases: a null html is the empty payload; a null URL has the empty URL and key; null
page ids have records of their own and stay null; repeated rows are captured one by one,
and of equal ids with equal payloads each is a response; line ends in a URL become spaces; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import batches, prepare, stored, table
from tidewatch.session import scratch_path

#: Payload bytes that one archive holds, about: an archive is parsed as a whole.
ARCHIVE_BYTES = 4 << 20
#: Payloads of at least this many bytes are written once.
REVISIT_FROM = 0
_EPOCH = 1_577_836_800  # captures are dated one second a page id after 2020-01-01
_END = "\r\n\r\n"
#: Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _base32_of(hexes: Column) -> Column:
    @F.pandas_udf("string")
    def coded(h: pd.Series) -> pd.Series:
        return h.map(lambda x: base32(bytes.fromhex(x)))

    return coded(hexes)


def url_key(url: Column) -> Column:
    """Sort key: host labels from the last to the first, then the rest, lower case."""
    low = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


def captures(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """`pages` (page_id, url, html) with digest, and refers_to for revisits."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    one = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                       body.alias("html")).withColumns({
                           "hex": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html").cast("long")})
    # per digest one row leaves each task, however many pages share it; only payloads that repeat are joined
    first = one.groupBy("hex").agg(F.max("page_id").alias("first_id"), F.count("*").alias("times"), F.max("n").alias("_n"))
    again = first.where((F.col("times") > 1) & (F.col("_n") >= revisit_from)).select(F.col("hex").alias("_hex"), "first_id")
    told = one.join(again, F.col("hex") == F.col("_hex"), "left")
    return told.select("page_id", "url", "html", "n", "hex",
                       F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first_id")), F.col("first_id")).alias("refers_to"))


def _record(c: DataFrame) -> DataFrame:
    """The text of each record, without its terminator, as `value`."""
    pid = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    second = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)) + _EPOCH
    date = F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    uri = F.regexp_replace("url", r"[\r\n]", " ")  # a header is one line
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), pid, F.lit(">\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: sha1:"),
        _base32_of(F.col("hex")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END))
    return c.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """WARC files of all pages below `path`, of as many records as `archive_bytes` hold on average."""
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) + 700
    seen = pages.agg(F.avg(size).alias("each")).first()["each"] or archive_bytes
    # a task cuts what it holds into files; payloads move for the join at most, not to be dealt out again
    _record(captures(pages)).select("value").write.option("maxRecordsPerFile", max(1, int(archive_bytes / seen))).option(
        "lineSep", _END).option("compression", "gzip").text(path)


def _parse(whole: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive."""
    at = 0
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at)
        lines = whole[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield at, headers, whole[end + 4:end + 4 + size]
        if whole[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        at = end + 8 + size


def _page_of(urn: str) -> int | None:
    number = urn.rpartition(":")[2].rstrip(">")
    return None if number == "null" else int(number)


_RUN = {"archive": pa.string(), "start": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "at": pa.string(),
        "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
_RUN_TYPES = ("archive string, start long, page_id long, url string, at string, payload_bytes long, "
              "payload_digest string, record_type string, refers_to long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: what the headers say, checked against the payload where there is one."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import zlib

        for part in parts:
            for name, content in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
                whole = zlib.decompress(content.as_py(), 47) if content.as_py()[:2] == b"\x1f\x8b" else content.as_py()
                for start, h, block in _parse(whole):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.lower().rpartition(b"content-length: ")[2].split(b"\r\n")[0])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
                        raise ValueError(f"{name}: the payload at byte {start} is not what its record says")
                    to = _page_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                    yield name, start, _page_of(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Date"], size, digest, h["WARC-Type"], to

    files = prepare(spark).read.format("binaryFile").load(path).select("path", "content")
    # one archive in a task's hands at a time, not a batch of them
    return files.mapInArrow(lambda parts: batches(_RUN, rows(b.slice(i, 1) for b in parts for i in range(b.num_rows))), _RUN_TYPES)


def merge_runs(runs: list[list], key: Callable) -> Iterator:
    """Merge sorted runs with a tree of losers: a step replays one path from a leaf to the root."""
    n = len(runs)
    if n == 0:
        return
    feeds = [iter(r) for r in runs]
    heads: list = [next(f, None) for f in feeds]

    def before(a: int, b: int) -> bool:  # an ended run loses; ties go to the lower run
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        ka, kb = key(heads[a]), key(heads[b])
        return ka < kb or (ka == kb and a < b)

    losers = [-1] * n  # losers[0]: the winner of all
    for leaf in range(n):
        winner, node = leaf, (leaf + n) // 2
        while node > 0:
            if losers[node] < 0:  # waits for its opponent
                losers[node], winner = winner, -1
                break
            if before(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        if winner >= 0:
            losers[0] = winner
    while heads[losers[0]] is not None:
        winner = losers[0]
        yield heads[winner]
        heads[winner] = next(feeds[winner], None)
        node = (winner + n) // 2
        while node > 0:
            if before(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner


def capture_index(records: DataFrame) -> DataFrame:
    """`records` in global order of (url key, timestamp, page id): columns segment and position say where."""
    keyed = records.withColumn("key", url_key(F.col("url")))
    runs = stored(keyed.sortWithinPartitions("archive", "key", "at", "page_id", "start"), "capture-runs")
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(n, "key", "at", "page_id", "start").sortWithinPartitions("archive", "key", "at", "page_id", "start")
    out = {**_RUN, "key": pa.string(), "segment": pa.int64(), "position": pa.int64()}

    def merged(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        segment, by_run = TaskContext.get().partitionId(), {}
        for part in parts:  # a range's share of the index: short rows, no payloads
            for row in zip(*(part.column(c).to_pylist() for c in (*_RUN, "key")), strict=True):
                by_run.setdefault(row[0], []).append(row)
        in_order = merge_runs([by_run[a] for a in sorted(by_run)], lambda r: (r[9].encode(), r[4], r[2] is not None, r[2] or 0, r[1]))
        for position, row in enumerate(in_order):
            yield *row, segment, position

    return dealt.mapInArrow(lambda parts: batches(out, merged(parts)), f"{_RUN_TYPES}, key string, segment long, position long")


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives, read back, and found in the merged index."""
    path = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return capture_index(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc_index": op3_warc_index}

ORACLE = {"op3_warc_index": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, max(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, n::bigint AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first_id THEN first_id END AS refers_to
FROM p JOIN f USING (hex)"""}

"""Token counts by separator scan.

Flat token files are plain id streams: documents on end, each closed by an
end-of-document id, no index. A stream is held as rows (file, block, tokens), each
block the bytes of a fixed number of 16-bit ids, cut without regard to documents.

The scan looks for the separator in every block by itself, then stitches: a prefix
scan over the blocks of a file gives where each block begins, how many documents
ended before it and where the last of them ended. The scan has two levels, so a file
of any length is no single task. Tokens never move; only one small row a block does.

Defined cases: a null or empty text is a document of no tokens; ids left after the
last separator of a file are a document of their own, marked as not closed; a file
without blocks or a table without rows gives no rows; a null document id stays null;
repeated rows are counted one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import batches, prepare, stored, table
from tidewatch.llm.tokens import default_path, token_ids

#: The end-of-document id of word_bpe_49k.json; text that spells it is encoded as text.
END_OF_DOCUMENT = 49407
#: Ids of a block: half a megabyte.
BLOCK_IDS = 1 << 18
#: Bytes of flat files that a task reads, about.
TASK_BYTES = 64 << 20
#: Blocks that one window of the prefix scan may hold.
BLOCKS_PER_SPAN = 1024

_BLOCK = "file long, block long, tokens binary, ordinal long, doc_id long"


def write_streams(docs: DataFrame, tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token streams of `docs` (doc_id, text), one file a partition, as a stored table.

    Rows with `tokens` are blocks; the others say which document is the n-th of its file.
    """
    path = tokenizer or default_path()

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        file, block, held, size, ordinal = TaskContext.get().partitionId(), 0, [], 0, 0
        tok = token_ids(path, special_as_text=True)
        for part in parts:
            ids, at = tok.encode(part.column("text"))
            for doc_id in part.column("doc_id").to_pylist():
                yield file, None, None, ordinal, doc_id
                ordinal += 1
            stream = np.insert(ids, at[1:], END_OF_DOCUMENT)
            held.append(stream)
            size += len(stream)
            if size >= block_ids:
                whole = np.concatenate(held)
                for n in range(size // block_ids):
                    yield file, block, whole[n * block_ids:(n + 1) * block_ids].astype("<u2").tobytes(), None, None
                    block += 1
                held = [whole[size // block_ids * block_ids:]]
                size = len(held[0])
        if size:
            yield file, block, np.concatenate(held).astype("<u2").tobytes(), None, None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"file": pa.int64(), "block": pa.int64(), "tokens": pa.binary(), "ordinal": pa.int64(), "doc_id": pa.int64()}
        yield from batches(kinds, rows(parts), at_once=512)

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(cut.mapInArrow(run, _BLOCK), "token-streams")


def read_flat_files(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of flat files of little-endian 16-bit ids below `path`, of any size.

    Spark lists the files and deals byte ranges as rows; a task reads one range at a time by
    seeking, so no file is held whole. Tasks open files with `pyarrow.fs`, which must know the
    path's scheme. An empty file has no blocks, one of an odd number of bytes is an error.
    """
    step = 2 * block_ids

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            name, opened = None, None
            for part in parts:
                for path, block, length in zip(*(part.column(c).to_pylist() for c in ("path", "block", "length")), strict=True):
                    if length % 2:
                        raise ValueError(f"{path}: half an id at the end")
                    if path != name:
                        system, where = pa_fs.FileSystem.from_uri(quote(path, safe="/:@"))  # Spark names files unescaped
                        name, opened = path, system.open_input_file(where)
                    size = min(step, length - block * step)
                    raw = opened.read_at(size, block * step)
                    if len(raw) != size:
                        raise ValueError(f"{path}: shorter than listed")
                    yield path, block, raw

        # as many rows at once as make up about 16 MB
        yield from batches({"file": pa.string(), "block": pa.int64(), "tokens": pa.binary()}, rows(), at_once=max(1, (16 << 20) // step))

    files = prepare(spark).read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    tasks = max(1, -(-(files.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    last = F.floor((F.col("length") - 1) / step).cast("long")
    dealt = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    stretch = F.floor(F.col("block") * step / TASK_BYTES)
    dealt = dealt.repartition(tasks, "path", stretch).sortWithinPartitions("path", "block")
    return dealt.mapInArrow(run, "file string, block long, tokens binary")


def separator_scan(blocks: DataFrame, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """Documents of token streams: (file, ordinal, start, n_tokens, closed), the separator not counted.

    `blocks`: (file, block, tokens), blocks of a file numbered in their order. Extra
    columns are ignored. A null or empty block has no ids.
    """
    file_type = blocks.schema["file"].dataType.simpleString()

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ends, sizes = [], []
            for raw in part.column("tokens"):
                ids = np.frombuffer(raw.as_buffer() or b"", "<u2") if raw.is_valid else np.zeros(0, "<u2")
                ends.append(np.flatnonzero(ids == end_id))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [part.column("file"), part.column("block"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                names=["file", "block", "size", "ends"])

    # a row of a few numbers for each block; stored, so that all that follows reads no block again
    found = stored(blocks.select("file", F.col("block").cast("long").alias("block"), "tokens").mapInArrow(
        find, f"file {file_type}, block long, size long, ends array<long>"), "block-ends")
    each = found.withColumns({
        "n_ends": F.size("ends").cast("long"),
        "span": F.floor(F.col("block") / BLOCKS_PER_SPAN).cast("long"),
    })
    spans = each.groupBy("file", "span").agg(F.sum("size").alias("span_size"), F.sum("n_ends").alias("span_ends"))
    earlier = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    spans = spans.select("file", "span", F.coalesce(F.sum("span_size").over(earlier), zero).alias("span_at"),
                         F.coalesce(F.sum("span_ends").over(earlier), zero).alias("span_ordinal"))
    inside = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.join(spans, ["file", "span"]).withColumns({
        "at": F.col("span_at") + F.coalesce(F.sum("size").over(inside), zero),
        "first": F.col("span_ordinal") + F.coalesce(F.sum("n_ends").over(inside), zero),
    }).select("file", "span", "block", "size", "at", "first", "n_ends",
              F.transform("ends", lambda e: e + F.col("at")).alias("ends"))
    # where the last document before a block ended: the greatest end so far, again span by span
    last = placed.withColumn("last_end", F.try_element_at("ends", F.lit(-1)))
    span_last = last.groupBy("file", "span").agg(F.max("last_end").alias("span_last"), F.max(F.col("at") + F.col("size")).alias("span_to"))
    span_last = span_last.select("file", "span", F.max("span_last").over(earlier).alias("before_span"),
                                 F.lead("span").over(Window.partitionBy("file").orderBy("span")).isNull().alias("final_span"),
                                 F.col("span_to"))
    known = last.join(span_last, ["file", "span"]).withColumns({
        "carried": F.coalesce(F.max("last_end").over(inside), F.col("before_span"), zero - 1),
        "final": F.col("final_span") & F.lead("block").over(Window.partitionBy("file", "span").orderBy("block")).isNull(),
    })
    closed = known.select(
        "file", "first", F.posexplode(F.arrays_zip(
            F.concat(F.array("carried"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))).alias("from"),
            F.col("ends").alias("to"))).alias("n", "d"), "n_ends",
    ).where(F.col("n_ends") > 0).select(
        "file", (F.col("first") + F.col("n")).alias("ordinal"), (F.col("d.from") + 1).alias("start"),
        (F.col("d.to") - F.col("d.from") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    open_start = F.coalesce(F.col("last_end"), F.col("carried")) + 1
    left = F.col("at") + F.col("size") - open_start
    trailing = known.where(F.col("final") & (left > 0)).select(
        "file", (F.col("first") + F.col("n_ends")).alias("ordinal"), open_start.alias("start"),
        left.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(trailing)


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, found by scanning the flat streams of all of them."""
    streams = write_streams(table(spark, sf_dir, "documents"))
    found = separator_scan(streams.where(F.col("tokens").isNotNull()))
    names = streams.where(F.col("tokens").isNull()).select("file", "ordinal", "doc_id")
    return names.join(found, ["file", "ordinal"], "left").select("doc_id", "n_tokens", "file", "ordinal", "start")


QUERIES = {"op1_separator_scan": op1_separator_scan}

"""What several text operators share: table access, batches, gapless numbers."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import stored

#: Rows of an Arrow batch: documents are long, so batches are small.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what a Python task holds at once; a smaller setting of the caller stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def batches(columns: dict[str, pa.DataType], rows: Iterable[tuple], at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows that come one after the other."""
    schema, held = pa.schema(columns.items()), []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def told_apart(df: DataFrame, name: str = "row_no") -> DataFrame:
    """`df` with a number that no other row has; it holds once the table is stored."""
    return df.withColumn(name, F.monotonically_increasing_id())


def same_key(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def gapless(df: DataFrame, by: list[str], order: list[str], name: str, first: int = 0, n_rows: int | None = None) -> DataFrame:
    """Number the rows of each group of `by` without gaps, however large a group is.

    Rows are dealt into as many hash buckets as a bucket has rows; a bucket is numbered
    by itself and starts where the buckets before it end. So neither a bucket nor the list
    of buckets has more than about the square root of all rows. The order is by bucket, then
    by `order`, which also decides the bucket: end it with a stored number that tells equal
    rows apart (`told_apart`). `df` is read twice, so pass a stored table.
    """
    n = df.count() if n_rows is None else n_rows
    buckets = max(1, math.ceil(math.sqrt(n)))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit("gapless")), F.lit(buckets)).cast("int"))
    own = Window.partitionBy(*by, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_own", F.row_number().over(own).cast("long") - 1)
    if buckets == 1:
        return ranked.withColumn(name, F.col("_own") + first).drop("_bucket", "_own")
    sizes = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_b"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    on = F.col("_bucket") == F.col("_b")
    for c in by:
        on &= same_key(F.col(c), F.col(f"_by_{c}"))
    return (ranked.join(starts, on).withColumn(name, F.col("_own") + F.col("_start") + first)
            .drop("_bucket", "_own", "_b", "_start", *[f"_by_{c}" for c in by]))


__all__ = ["BATCH_ROWS", "batches", "gapless", "prepare", "same_key", "stored", "table", "told_apart"]

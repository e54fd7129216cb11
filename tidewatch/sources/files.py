"""File sources and sinks beyond the raw card table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewatch import config as C
from tidewatch.operators import ranking as R
from tidewatch.schemas import EPISODE_SCHEMA, MODEL_CONFIG_SCHEMA


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Feedback episodes from JSON lines, tolerant: blank and corrupt lines and
    lines without a transaction id are skipped."""
    schema = T.StructType([*EPISODE_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    line = F.trim(F.col("value"))
    whole = spark.read.text(path).filter(line.startswith("{") & line.endswith("}"))
    parsed = whole.select(F.from_json(line, schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select("e.*")
    return parsed.filter(F.col("_corrupt").isNull() & F.col("transaction_id").isNotNull()).drop("_corrupt")


def read_registry(spark: SparkSession, root: str, file_name: str = "model_config.json") -> DataFrame:
    """One row per readable model config below `root/<model>/`; corrupt files are skipped."""
    schema = T.StructType([*MODEL_CONFIG_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    df = (spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt").schema(schema).json(f"{root}/*/{file_name}"))
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    # The corrupt-record column may only be read next to another one, hence the order.
    return (df.withColumn("name", F.url_decode(F.regexp_replace(folder, "^[a-z_]+=", "")))
            .filter(F.col("_corrupt").isNull()).drop("_corrupt"))


def row_range(df: DataFrame, row_id: str, lo: int, hi: int) -> DataFrame:
    return df.filter((F.col(row_id) >= lo) & (F.col(row_id) < hi))


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """A uniform sample of n rows that is the same on every run: the n smallest hashes.

    A bound on the hash comes first, so about n rows reach the final sort, not n of every partition.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    lead = -F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return R.highest(df, lead, n).orderBy(digest, id_col).limit(n)


def keep_newest(df: DataFrame, seq: str, above: int = C.MEMORY_MAX_EPISODES, keep: int = C.MEMORY_KEEP_EPISODES) -> DataFrame:
    """Retention: with more than `above` rows only the newest `keep` stay."""
    if df.count() <= above:
        return df
    near = R.highest(df, F.col(seq), keep)
    bound = near.orderBy(F.desc(seq)).limit(keep).agg(F.min(seq)).first()[0]
    return df.filter(F.col(seq) >= F.lit(bound))


def append_new(existing: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """The requests whose keys the queue does not hold yet, one per key."""
    return requests.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def with_missing_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Project to `columns`; what is absent becomes a null float."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("float").alias(c) for c in columns])


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert or overwrite by key: incoming values win, other rows stay."""
    cols = [c for c in current.columns if c != key]
    j = current.alias("c").join(incoming.alias("i").withColumn("_new", F.lit(True)), key, "full_outer")
    pick = [F.when(F.col("_new"), F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in cols]
    return j.select(key, *pick)


def adapt(df: DataFrame, mapping: dict[str, Column | str]) -> DataFrame:
    """Rename or compute columns of a foreign table into canonical ones."""
    return df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in mapping.items()])


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None,
               batch_rows: int = 5000) -> None:
    """Append to a SQL table in batches; the driver jar comes with the cluster."""
    df.write.option("batchsize", batch_rows).jdbc(url, table, mode="append", properties=properties or {})


def read_jdbc(spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int,
              properties: dict[str, str] | None = None) -> DataFrame:
    """Read a ledger table in parallel by `seq` ranges; filters and limits are pushed down."""
    return spark.read.jdbc(url, table, column="seq", lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})

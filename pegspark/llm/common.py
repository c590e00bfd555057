"""What the operators share: reading tables, scratch tables in the shared folder, and slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents handled at once inside a task; bounds a Python worker's memory whatever Spark's batch size is.
SLICE_ROWS = 256
SLICE_BYTES = 8 << 20
#: Rows of a few numbers up to which a counted table is broadcast, some 50 MB; beyond it is joined.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one is made only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pegspark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: work is done once and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, to be broadcast only if it is counted to have at most limit rows, which must be small each."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if limit is None else limit) else df


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """The same as a table bucketed by key: a later grouping by key reads it without a shuffle.

    Its name leaves the session's catalogue at once; the files stay, and what is returned goes on reading them.
    """
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_text(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """row, a struct of the columns keep, and text unless row has it: what an Arrow function needs, clash-free."""
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    return df.select(row) if text_col in keep and df.schema[text_col].dataType == T.StringType() else df.select(row, text)


def text_of(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    return batch["text"] if "text" in batch.schema.names else pc.struct_field(batch["row"], text_col)


def map_rows(df: DataFrame, function, ddl: str) -> DataFrame:
    """mapInArrow of the rows of with_text: function yields row and the columns of ddl."""
    return df.mapInArrow(function, T.StructType([df.schema["row"], *T.StructType.fromDDL(ddl).fields]))


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has few rows and, but for a single longer row, few bytes of text."""
    for batch in batches:
        texts = batch[text_col] if text_col in batch.schema.names else text_of(batch, text_col)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= SLICE_ROWS or held + n > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, per name of sums, that column's sum over all rows before a row in the order, which must be total.

    Rows are dealt to ranges of the order; sums within a range are windows, and one row of totals per range is summed for
    what lies before it. So no task holds more than its range, however the rows are spread.
    """
    keys = [f"_order{k}" for k in range(len(order))]
    keyed = df.select("*", *(c.alias(k) for c, k in zip(order, keys)), *(c.cast("long").alias(f"_of_{n}") for n, c in sums.items()))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(keyed.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*(F.sum(f"_of_{n}").alias(f"_all_{n}") for n in sums))
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = totals.select("_range", *(F.coalesce(F.sum(f"_all_{n}").over(ranges), F.lit(0)).alias(f"_base_{n}") for n in sums))
    inside = dealt.withColumns({n: F.coalesce(F.sum(f"_of_{n}").over(before), F.lit(0)) for n in sums})
    found = inside.join(F.broadcast(bases), "_range")
    return found.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(n) + F.col(f"_base_{n}")).alias(n) for n in sums))

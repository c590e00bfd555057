"""Unbounded streams of lines: hits per line, and line numbers per label kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.grammar import Grammar
from ..operators.search import with_matches

STREAM = "<stream>"


def search_stream(lines: DataFrame, grammar: Grammar, content_col: str = "value", label: Column | None = None) -> DataFrame:
    """The lines of a stream that have a hit: file, content, matches. Stateless: each line is judged alone."""
    named = lines.select((F.lit(STREAM) if label is None else label).alias("file"), F.regexp_replace(content_col, "\r$", "").alias("content"))
    return with_matches(named, grammar)


def _count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = state.get[0] if state.exists else 0
    for batch in batches:
        yield pd.DataFrame({"file": key[0], "line": range(seen + 1, seen + 1 + len(batch)), "content": batch["content"].to_numpy()})
        seen += len(batch)
    state.update((seen,))


def number_lines(lines: DataFrame, content_col: str = "value", label: Column | None = None, start_line: int | None = None, end_line: int | None = None) -> DataFrame:
    """file, line (from 1, in order of arrival) and content; lines outside start_line..end_line are left out.

    The number of lines so far is kept per label, so labels are counted in parallel; one label is one task, as its lines
    have one order. `numbered_writer` counts one label in many tasks.
    """
    named = lines.select((F.lit(STREAM) if label is None else label).alias("file"), F.regexp_replace(content_col, "\r$", "").alias("content"))
    numbered = named.groupBy("file").applyInPandasWithState(_count, "file string, line long, content string", "seen long", "append", GroupStateTimeout.NoTimeout)
    if start_line is not None:
        numbered = numbered.filter(F.col("line") >= start_line)
    return numbered if end_line is None else numbered.filter(F.col("line") <= end_line)


def numbered_writer(lines: DataFrame, out: str, content_col: str = "value", label: Column | None = None, grammar: Grammar | None = None, start_line: int | None = None, end_line: int | None = None) -> DataStreamWriter:
    """A writer, to be started, of file, line, content (and matches: the lines with a hit, where there is a grammar).

    Rows come as Parquet below <out>/rows, a folder for each micro-batch; <out>/totals holds the lines of each label after
    each batch, <out>/state the stream's checkpoint. out is in storage that driver and executors share. A micro-batch counts
    its lines per partition, and sums of those counts give every partition its first number, so one label is numbered by as
    many tasks as read it; all that is kept is a label's total. A batch that is run again writes the same folders again.
    Lines are numbered in the order of the partitions of their batch. A label beyond end_line is no longer counted.
    """
    named = lines.select((F.lit(STREAM) if label is None else label).alias("file"), F.regexp_replace(content_col, "\r$", "").alias("content"))

    def totals(spark: SparkSession, number: int) -> DataFrame:
        kept = "file string, total long"
        return spark.createDataFrame([], kept) if number < 0 else spark.read.schema(kept).parquet(f"{out}/totals/{number}")

    def run(batch: DataFrame, number: int) -> None:
        before = totals(batch.sparkSession, number - 1)
        placed = batch.select("file", "content", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
        if end_line is not None:
            placed = placed.join(before.filter(F.col("total") >= end_line).select("file"), "file", "left_anti")
        counts = placed.groupBy("file", "part").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
        shifts = counts.select("file", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
        shifts = shifts.join(before, "file", "left").select("file", "part", (F.col("shift") + F.coalesce("total", F.lit(0))).alias("shift"))
        inside = placed.withColumn("place", F.row_number().over(Window.partitionBy("file", "part").orderBy("at")))
        rows = inside.join(shifts, ["file", "part"]).select("file", (F.col("shift") + F.col("place")).alias("line"), "content")
        rows = rows if start_line is None else rows.filter(F.col("line") >= start_line)
        rows = rows if end_line is None else rows.filter(F.col("line") <= end_line)
        rows = rows if grammar is None else with_matches(rows, grammar)
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        now = before.select("file", "total").unionByName(counts.select("file", F.col("n").alias("total")))
        now.groupBy("file").agg(F.sum("total").alias("total")).write.mode("overwrite").parquet(f"{out}/totals/{number}")

    return named.writeStream.foreachBatch(run).option("checkpointLocation", f"{out}/state")


def search_numbered(lines: DataFrame, grammar: Grammar, content_col: str = "value", label: Column | None = None, start_line: int | None = None, end_line: int | None = None) -> DataFrame:
    """The lines of a stream that have a hit, with their numbers: file, line, content, matches.

    All lines are counted, also those outside start_line..end_line, which are then not searched.
    """
    numbered = number_lines(lines, content_col, label, start_line, end_line)
    return with_matches(numbered, grammar)

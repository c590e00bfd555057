"""Files of any size as numbered lines.

Spark's own text reader cuts a file into splits at line ends, so a large file is read by many tasks, each holding one line
at a time. Numbers come from two passes: lines are counted per split, the counts are summed along each file, and a line's
number is that sum plus its place in its split. A line longer than a split belongs to the split that it begins in.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grammar import Grammar
from .files import SNIFFED, not_skipped

#: Splits whose sums, a short row each, are broadcast; beyond, they are joined.
BROADCAST_SPLITS = 200_000


def _scan(spark: SparkSession, path: str, glob: str | None, line_sep: str) -> DataFrame:
    """file, split (its first byte), at (rising within a split) and content, in the order of the file."""
    if line_sep not in ("lf", "universal"):
        raise ValueError("line_sep must be lf or universal")
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("lineSep", "\n") if line_sep == "lf" else reader
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    where = F.col("_metadata.file_path")
    found = lines.filter(not_skipped(where, path)) if _is_folder(path) else lines
    return found.select(where.alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("content"))


def _is_folder(path: str) -> bool:
    return not os.path.isfile(path.removeprefix("file://").removeprefix("file:"))


def _bases(lines: DataFrame) -> DataFrame:
    """Per split: its first place, and the lines of its file before it."""
    counts = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    return counts.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def _binary(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """Files with a NUL among their first bytes. Offsets are summed only in files that have a NUL in their first split."""
    start = _scan(spark, path, glob, "lf").filter("split = 0")
    suspect = start.filter(F.contains("content", F.lit("\0"))).select("file").distinct()
    own = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = start.join(suspect, "file").withColumn("begin", F.coalesce(F.sum(F.octet_length("content") + 1).over(own), F.lit(0)))
    to_nul = F.octet_length(F.substring_index("content", "\0", 1))
    return lines.filter(F.contains("content", F.lit("\0")) & (F.col("begin") + to_nul < SNIFFED)).select("file").distinct()


def numbered(spark: SparkSession, path: str, glob: str | None = None, line_sep: str = "lf", keep: Column | None = None) -> DataFrame:
    """file, line (from 1) and content of a file, or of the files of a folder, of any size, by many tasks a file.

    keep: a condition on content; only lines that meet it are joined to the sums of their split. lf parts lines at line
    feeds only, universal also at carriage returns. Files with a NUL near their start are left out; empty files have no
    lines; an empty line is a line, and a line feed at the end of a file begins no further one. A path that does not exist
    raises. Bytes that are no UTF-8 stay as they are. A path may be in any store that Spark reads; folders that are skipped
    are those of `read_folder`.
    """
    lines = _scan(spark, path, glob, line_sep)
    bases = _bases(lines)
    size, files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    few = size // _smallest_split(spark) + files <= BROADCAST_SPLITS
    wanted = lines if keep is None else lines.filter(keep)
    wanted = wanted.join(_binary(spark, path, glob), "file", "left_anti")
    found = wanted.join(F.broadcast(bases) if few else bases, ["file", "split"])
    local = F.regexp_replace("file", "^file:/+", "/")
    return found.select(local.alias("file"), (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "content")


def _smallest_split(spark: SparkSession) -> int:
    """Spark cuts a file into splits of at least one of these two sizes, but for its last."""

    def size(setting: str) -> int:
        number, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", spark.conf.get(setting).strip().lower()).groups()
        return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]

    return max(1, min(size("spark.sql.files.maxPartitionBytes"), size("spark.sql.files.openCostInBytes")))


def search_lines_of(spark: SparkSession, grammar: Grammar, path: str, glob: str | None = None, start_line: int | None = None, end_line: int | None = None, line_sep: str = "lf") -> DataFrame:
    """Lines with at least one hit: file, line (from 1), content, matches, of a file of any size or of a folder.

    Each line is searched where it is read; only lines with a hit get their number.
    """
    content = F.col("content")
    found = numbered(spark, path, glob, line_sep, grammar.has_hit(content))
    if start_line is not None:
        found = found.filter(F.col("line") >= start_line)
    if end_line is not None:
        found = found.filter(F.col("line") <= end_line)
    return found.withColumn("matches", grammar.find(content))

"""Line dedup by site-relative frequency.

Per host, the pages that contain a line divided by the host's pages; a line above the boilerplate ratio is dropped from
every page of that host. Lines travel as two 64-bit hashes and are counted before the shuffle, so texts are never
shuffled for counting, and a host with many pages has no more rows than distinct lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: A line is boilerplate if it is on more than this share of its host's pages, and on at least MIN_PAGES of them.
MAX_RATIO = 0.01
MIN_PAGES = 5
#: Dropped lines of all hosts (two longs each) up to which they are broadcast; beyond it they are joined.
BROADCAST_LINES = 1_000_000
#: A line counts if it has a character that is not one of these.
BLANKS = " \t\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _has_words(line: Column) -> Column:
    return F.length(F.translate(line, BLANKS, "")) > 0


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate(df: DataFrame, host: str, text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host with boilerplate: site, and lines, the keys of its boilerplate lines.

    A host has fewer than (distinct lines of its average page) / max_ratio of them.
    """
    site = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("site")
    pages = df.select(site, F.array_distinct(F.filter(lines(F.col(text_col).cast("string")), _has_words)).alias("lines"))
    totals = pages.groupBy("site").agg(F.count("*").alias("total"))
    counts = pages.select("site", F.explode("lines").alias("line")).select("site", _key(F.col("line")).alias("key"))
    counts = counts.groupBy("site", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    often = counts.join(totals, "site").filter(F.col("n") > F.lit(max_ratio) * F.col("total"))
    return often.groupBy("site").agg(F.collect_list("key").alias("lines"))


def dedup(df: DataFrame, host: str, text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """df with boilerplate lines taken out of text_col; all other columns and all rows stay.

    A text of any length is one page, with all its lines. A null host is one host, with the empty one; a null text counts as a page without lines and stays null; repeated
    rows are pages of their own; an empty table stays empty; blank lines are never counted or dropped. A clash of
    column names cannot arise: helper columns are held in one struct with a name that df lacks.
    """
    own = "_line_dedup"
    while own in df.columns:
        own += "_"
    drops = table(boilerplate(df, host, text_col, max_ratio, min_pages), "line-dedup")
    size = drops.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    drops = drops.select(F.struct("site", "lines").alias(own))
    drops = F.broadcast(drops) if size <= BROADCAST_LINES else drops
    joined = df.join(drops, F.coalesce(df[host].cast("string"), F.lit("")) == drops[own]["site"], "left")
    found, text = F.col(own)["lines"], F.col(f"`{text_col}`").cast("string")
    # a page's lines are first looked up in the host's list as a hash set, so that only drops of this page are compared
    met = F.array_intersect(F.transform(lines(text), lambda x: F.xxhash64(x)), found["a"])
    here = lambda shared: F.filter(found, lambda d: F.array_contains(shared, d["a"]))
    without = lambda drop: F.array_join(F.filter(lines(text), lambda x: ~(_has_words(x) & F.array_contains(drop, _key(x)))), "\n")
    kept = F.when(F.size(met) == 0, text).otherwise(_bound(_bound(met, here), without))
    return joined.withColumn(text_col, F.when(found.isNull(), F.col(f"`{text_col}`")).otherwise(F.when(text.isNotNull(), kept))).select(*df.columns)


def _bound(value: Column, use) -> Column:
    """use(value), with value evaluated once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))

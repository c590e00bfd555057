"""Search as DataFrame operators: lines with hits, and one row per hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import Grammar

COLOR, PLAIN = "\x1b[1;31m", "\x1b[0m"


def hits(df: DataFrame, grammar: Grammar, text_col: str, tree: bool = False) -> DataFrame:
    """One row per hit: the columns of df, hit (from 0), start, end, text (and nodes)."""
    found = df.withColumn("_hits", grammar.find(F.col(text_col), tree=tree))  # a column first: a generator cannot hold Python
    found = found.select("*", F.posexplode("_hits").alias("hit", "_hit"))
    return found.select(*(found[c] for c in [*df.columns, "hit"]), "_hit.start", "_hit.end", F.col("_hit.text").alias("hit_text"), *(["_hit.nodes"] if tree else []))


def split_lines(text: Column, line_sep: str = "lf") -> Column:
    """Lines of a text; lf parts at line feeds only, universal also at carriage returns."""
    if line_sep not in ("lf", "universal"):
        raise ValueError("line_sep must be lf or universal")
    return F.split(text, "\n" if line_sep == "lf" else "\r\n|\n|\r", -1)


def search_lines(df: DataFrame, grammar: Grammar, text_col: str, label: Column | None = None, start_line: int | None = None, end_line: int | None = None, line_sep: str = "lf") -> DataFrame:
    """Lines with at least one hit: file, line (from 1), content, matches; start_line and end_line are inclusive.

    A whole text that cannot have a hit is left out before it is split.
    """
    file = (F.lit("<stdin>") if label is None else label).alias("file")
    whole = df.select(file, F.col(text_col).alias("text"))
    needed = grammar._needed(F.col("text"))
    whole = whole if needed is None else whole.filter(needed)
    lines = whole.select("file", F.posexplode(split_lines(F.col("text"), line_sep)).alias("line", "content")).withColumn("line", F.col("line") + 1)
    if start_line is not None:
        lines = lines.filter(F.col("line") >= start_line)
    if end_line is not None:
        lines = lines.filter(F.col("line") <= end_line)
    return with_matches(lines, grammar)


def with_matches(lines: DataFrame, grammar: Grammar) -> DataFrame:
    """The lines that have a hit, and their hits. Where Python finds them it is asked once a line."""
    content = F.col("content")
    if grammar.native_hits:
        return lines.filter(grammar.has_hit(content)).withColumn("matches", grammar.find(content))
    return lines.withColumn("matches", grammar.find(content)).filter(F.size("matches") > 0)


def search_hits(df: DataFrame, grammar: Grammar, text_col: str, label: Column | None = None, **lines) -> DataFrame:
    """One row per hit in a line: file, line (from 1), col and end_col (from 0, in bytes of the line)."""
    found = search_lines(df, grammar, text_col, label, **lines)
    found = found.select("file", "line", grammar.find(F.col("content"), unit="byte").alias("hits"))
    return found.select("file", "line", F.explode("hits").alias("hit")).select("file", "line", F.col("hit.start").alias("col"), F.col("hit.end").alias("end_col"))


def format_results(lines: DataFrame, color: bool = True) -> DataFrame:
    """`file:line: content` as column shown, hits highlighted."""
    found = F.array_sort("matches")
    before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(found, k - 1)["end"])
    pieces = F.transform(found, lambda h, k: F.concat(F.substring(F.col("content"), before(k) + 1, h["start"] - before(k)), F.lit(COLOR), h["text"], F.lit(PLAIN)))
    marked = F.concat(F.array_join(pieces, ""), F.substr("content", F.coalesce(F.get(found, F.size(found) - 1)["end"], F.lit(0)) + 1))
    return lines.select(F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), marked if color else F.col("content")).alias("shown"))

"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed per source; weights share the total, and a source takes at most LIMIT times its size, the rest being
shared again by weight. That share is found in one ordered pass: sources in the order of limit per weight, with running
sums of limits and weights, are full up to the first one that the level reached there does not fill. A document is taken
floor(rate) times, and once more if a hash of it, as a number in [0, 1), lies below the rate's fraction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, running, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
LIMIT = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target and rate, of rows (source, size).

    Sources in code-point order, null last, have the whole numbers `weights`, again and again.
    """
    sources = table(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mixing-sources")
    placed = running(sources, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    weighed = placed.withColumns({"weight": weight, "most": F.col("source_size") * limit})
    per_weight = F.element_at(F.array(*(F.lit(math.lcm(*weights) // w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    filled = table(running(weighed, [F.col("most") * per_weight, F.col("place")], {"most_before": F.col("most"), "weight_before": F.col("weight")}), "mixing-filled")
    total, whole = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of sizes and weights pass 64 bits
    full = wide(F.col("most")) * wide(F.lit(whole or 0) - F.col("weight_before")) < wide(F.lit(total or 0) - F.col("most_before")) * wide(F.col("weight"))
    held, heavy = filled.filter(full).agg(F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    open_size, open_weight = (total or 0) - held, max(1, (whole or 0) - heavy)
    target = F.when(full, F.col("most").cast("double")).otherwise((F.lit(open_size) * F.col("weight")).cast("double") / F.lit(float(open_weight)))
    found = filled.select("source", "source_size", target.alias("target"))
    return found.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def coin(key: Column, number: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) of a key and a row's number among equal rows."""
    bits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), key, number.cast("string"))), 1, 13)
    return F.conv(bits, 16, 10).cast("long") / F.lit(float(1 << 52))


def _numbered(keyed: DataFrame) -> DataFrame:
    """keyed with number, from 0, among rows of the same key; rows that differ have 0 and stay where they are.

    Equal rows are numbered within the part of the scan they come from, then shifted by what earlier parts hold, so that a
    key with very many rows is counted in as many tasks as read it.
    """
    again = keyed.groupBy("key").count().filter("count > 1").select("key")
    again = table(again, "mixing-repeats")
    if again.isEmpty():
        return keyed.withColumn("number", F.lit(0).cast("long")).drop("part")
    again = few(again)
    single = keyed.join(again, "key", "left_anti").withColumn("number", F.lit(0).cast("long")).drop("part")
    own = Window.partitionBy("key", "part").orderBy("key")
    inside = keyed.join(again, "key", "left_semi").withColumn("inside", F.row_number().over(own) - 1)
    counts = keyed.join(again, "key", "left_semi").groupBy("key", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    numbered = inside.join(shifts, ["key", "part"]).withColumn("number", F.col("shift") + F.col("inside"))
    return single.unionByName(numbered.select(*single.columns))


def plan(df: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """Per row: row (a struct of the columns keep, all by default), size, source, source_size, target, rate and copies.

    A null text, an empty one or one of blanks has size 0; a text of any length counts whole. A null source is a source,
    the last. Where all sizes are 0, so are all targets, and nothing is taken. Rows equal in id, source and text are
    numbered, so that each has a coin of its own; which of them is taken makes no difference. Reruns agree, however the
    rows are spread. An empty table gives no rows; columns of any name may stand beside those named.
    """
    own = {n: F.col(f"`{c}`").cast("string") for n, c in (("id", id_col), ("source", source_col), ("text", text_col))}
    row = F.struct(*(F.col(f"`{c}`") for c in (df.columns if keep is None else keep))).alias("row")
    given = lambda c: F.coalesce(F.md5(c), F.lit("-"))
    key = F.concat_ws(" ", F.coalesce(own["id"], F.lit("-")), given(own["source"]), given(own["text"]))
    keyed = df.select(row, own["source"].alias("source"), n_words(own["text"]).alias("size"), key.alias("key"), F.spark_partition_id().alias("part"))
    rates = few(targets(keyed.select("source", "size"), weights, limit))
    numbered = _numbered(keyed)
    found = numbered.join(rates.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    whole = F.floor("rate")
    copies = whole + (coin(F.col("key"), F.col("number"), seed) < F.col("rate") - whole).cast("long")
    return found.select("row", "size", "source", "source_size", "target", "rate", copies.alias("copies"))


def mix(df: DataFrame, **options) -> DataFrame:
    """The rows of the mix: those of df, each as often as `plan` takes it, copy (from 0) last."""
    taken = plan(df, **options).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_copy")).select("row.*", F.col("_copy").alias("copy"))

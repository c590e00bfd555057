"""A prefix trie of conversations, built level by level.

At each depth the live conversations, those that share their node with another, are grouped by (node, next turn); a group
becomes a node, named by its smallest conversation. A conversation alone in its node is no longer live: all nodes below
are its own and follow from its turns without any grouping. Then the levels are rolled up in reverse: children are counted
and leaves and savings summed by parent and joined to the level above. Turns are compared by a 128-bit digest of role and
text, so no text is moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, running, table

#: Characters of joined conversation ids in one row, on their way to a digest.
CHUNK = 1 << 16


def item(role: Column, text: Column) -> Column:
    """The digest by which turns are the same."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def numbered(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, depth (from 1, by turn, null first), length (turns of the conversation), item and size (code points).

    A null role or text counts as empty. Turns with one number come by role, then by digest; repeated rows are turns of
    their own. Rows without a conversation are left out. Places are running counts over ranges, so a conversation of any
    length is numbered by many tasks.
    """
    c = lambda name: F.col(f"`{name}`")
    role, text = (F.coalesce(c(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    turns = df.filter(c(conv_col).isNotNull()).select(c(conv_col).cast("long").alias("conv"), c(turn_col).alias("turn"), role.alias("role"), item(role, text).alias("item"), F.length(text).cast("long").alias("size"))
    placed = table(running(turns, [F.col("conv"), F.col("turn").isNotNull(), F.col("turn"), F.col("role"), F.col("item")], {"place": F.lit(1)}).drop("role", "turn"), "trie-turns")
    firsts = placed.groupBy("conv").agg(F.min("place").alias("first"), F.count("*").alias("length"))
    return placed.join(few(firsts), "conv").select("conv", (F.col("place") - F.col("first") + 1).alias("depth"), "length", "item", "size")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which each conversation begins with the first turns of its group's first one.

    Conversation c takes h = crc32(decimal c) % most turns of conversation c - c % group (all if it has fewer, none if it
    is absent) in place of its own first h. Turns are (conv, depth, item, size), conversations (conv, length).
    """
    turns = table(turns, "trie-numbered")
    lengths = turns.filter("depth = 1").select("conv", "length")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = lengths.select("conv", "length", (F.col("conv") - F.col("conv") % group).alias("base"), head.alias("head"))
    bases = lengths.select(F.col("conv").alias("base"), F.col("length").alias("base_length"))
    convs = table(convs.join(bases, "base", "left").withColumn("given", F.least("head", F.coalesce("base_length", F.lit(0)))), "trie-conversations")
    own = turns.join(few(convs.select("conv", "head", "given")), "conv").filter("depth > head").select("conv", (F.col("given") + F.col("depth") - F.col("head")).alias("depth"), "item", "size")
    heads = turns.filter((F.col("depth") < most) & (F.col("conv") % group == 0)).select(F.col("conv").alias("base"), "depth", "item", "size")
    lent = convs.filter("given > 0").select("conv", "base", "given").join(heads, "base").filter("depth <= given").select("conv", "depth", "item", "size")
    after = F.greatest(F.col("length") - F.col("head"), F.lit(0))
    return own.unionByName(lent), convs.select("conv", (F.col("given") + after).alias("length"))


def build(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of turns (conv, depth from 1, item, size) and of conversations (conv, length), each one row.

    nodes: depth, conv_id (the smallest member), parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, each node's members but one times the size of its last turn), longest (turns of its
    longest member). ends: depth, conv_id and conv, a row for each member that has no further turn. No conversation, no
    root. There is a step per depth at which two conversations still agree, whatever the depth of the others.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = table(turns.repartitionByRange(parts, "depth", "conv").sortWithinPartitions("depth", "conv"), "trie-by-depth")
    convs = table(convs, "trie-lengths")
    root = table(convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("length").alias("longest")).filter("n_convs > 0"), "trie-root")
    levels = [root.select(F.lit(0).cast("long").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent"), "n_convs", "longest", F.lit(0).cast("long").alias("size"))]
    first = root.first()
    at_root = convs.withColumn("node", F.lit(first["conv_id"] if first else None).cast("long"))
    ends = [at_root.filter("length = 0").select(F.lit(0).cast("long").alias("depth"), "node", "conv")]
    live = at_root.filter("length > 0")
    while True:
        depth = F.lit(len(levels)).cast("long")
        here = turns.filter(F.col("depth") == len(levels)).select("conv", "item", "size")
        step = table(live.join(here, "conv"), f"trie-step-{len(levels)}")
        groups = step.groupBy("node", "item").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("length").alias("longest"), F.first("size").alias("size"))
        groups = table(groups, f"trie-level-{len(levels)}")
        shared = groups.filter("n_convs > 1").select("node", "item", "conv_id")
        if groups.isEmpty():
            break
        levels.append(groups.select(depth.alias("depth"), "conv_id", F.col("node").alias("parent"), "n_convs", "longest", "size"))
        if shared.isEmpty():
            break
        onward = step.join(few(shared), ["node", "item"])
        ends.append(onward.filter(F.col("length") == len(levels) - 1).select(depth.alias("depth"), F.col("conv_id").alias("node"), "conv"))
        live = onward.filter(F.col("length") > len(levels) - 1).select("conv", "length", F.col("conv_id").alias("node"))
    rolled, up = [], None
    for level in reversed(levels):
        alone = (F.col("n_convs") == 1) & (F.col("longest") > F.col("depth"))  # its one child is below the levels
        here = level if up is None else level.join(up, level["conv_id"] == up["of"], "left").drop("of")
        below = (lambda c: F.lit(0)) if up is None else (lambda c: F.coalesce(c, F.lit(0)))
        here = here.select(
            "depth", "conv_id", "parent", "n_convs", "longest", F.when(alone, F.lit(1)).otherwise(below(F.col("children"))).cast("long").alias("n_children"),
            F.greatest(F.lit(1), below(F.col("leaves"))).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size") + below(F.col("saved"))).cast("long").alias("saved_tokens"),
        )
        rolled.append(table(here, "trie-rolled"))
        up = rolled[-1].groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    top = _all(rolled)
    alone = top.filter("n_convs = 1 AND longest > depth").select(F.col("conv_id").alias("conv"), F.col("depth").alias("since"), "longest")
    chain = turns.select("conv", "depth").join(few(alone), "conv").filter("depth > since")
    one = F.lit(1).cast("long")
    chains = chain.select("depth", F.col("conv").alias("conv_id"), F.col("conv").alias("parent"), one.alias("n_convs"), "longest", (F.col("depth") < F.col("longest")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    nodes = top.unionByName(chains).withColumnRenamed("parent", "parent_conv_id")
    single = nodes.filter((F.col("n_convs") == 1) & (F.col("depth") == F.col("longest")) & (F.col("depth") > 0)).select("depth", F.col("conv_id").alias("node"), F.col("conv_id").alias("conv"))
    return nodes, _all([*ends, single]).withColumnRenamed("node", "conv_id")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


_KEYS = "depth long, conv_id long"


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (depth, conv_id, conv) as rows of comma-joined ids of at most about CHUNK characters."""
    key, first, held, size = None, None, [], 0
    for batch in batches:
        out = []
        for depth, node, conv in zip(batch["depth"].tolist(), batch["conv_id"].tolist(), batch["conv"].tolist()):
            if key != (depth, node) or size > CHUNK:
                if held:
                    out.append((*key, first, ",".join(held)))
                key, first, held, size = (depth, node), conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        yield pd.DataFrame(out, columns=["depth", "conv_id", "first", "ids"])
    if held:
        yield pd.DataFrame([(*key, first, ",".join(held))], columns=["depth", "conv_id", "first", "ids"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest per (depth, conv_id) of its sorted rows, which are hashed as they pass."""
    key, running_hash = None, None
    for batch in batches:
        out = []
        for depth, node, ids in zip(batch["depth"].tolist(), batch["conv_id"].tolist(), batch["ids"].tolist()):
            if key != (depth, node):
                if key is not None:
                    out.append((*key, running_hash.hexdigest()))
                key, running_hash = (depth, node), hashlib.sha256(ids.encode())
            else:
                running_hash.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["depth", "conv_id", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, running_hash.hexdigest())], columns=["depth", "conv_id", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, conv_id and ends_sha256: of each node's ends their ids, in ascending order, joined by commas.

    Ids are joined to long rows where they lie, in ranges of (node, id), so that even the ends of one node are joined by
    many tasks; a node's few long rows are then hashed one after the other, in memory of one batch.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ends = ends.repartitionByRange(parts, "depth", "conv_id", "conv").sortWithinPartitions("depth", "conv_id", "conv")
    rows = sorted_ends.mapInPandas(_joined, f"{_KEYS}, first long, ids string")
    return rows.repartition(parts, "depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first").mapInPandas(_hashed, f"{_KEYS}, ends_sha256 string")

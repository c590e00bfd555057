"""Near copies by the Jaccard similarity of their word shingles: operator 4 where a similarity is asked for.

A text is the set of the hashes of its shingles of SHINGLE words; equal sets are one node. Each node gets a SimHash of
some words of 64 bits, embedded as the counts of its two-bit segments, and operator 4's tables of segments
(simhash.wide_families) give its cells: a pair at the similarity or above shares a cell and is near enough there but for
about one in a million. The families of a cell, joined by Manhattan and then Hamming distance, are candidates, verified on
the whole sets in two steps. First every node is compared with the leaders of its families only, which costs a group of
copies its size, not its square. Then, in each star (a leader and all that share a family with it) that is not yet one
component, what lies outside the largest component is compared with all the rest, in blocks of bounded size: members lie
in one block each, only what lies outside is sent to every block. A block returns a spanning forest of its links, never
its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, slices, table
from .simhash import _LOWER, _WORD, SEED, WIDE, choose_tables, keep_first, long_fingerprint, mark, roots, wide_cells, wide_families

SHINGLE = 5
SIMILARITY = 0.8
#: Sets in a block of a star, and their shingles; a larger set is a block of its own.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
WORDS = [f"w{k}" for k in range(WIDE)]


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, ascending; a text of fewer words is one shingle, without words none."""
    import xxhash

    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    made = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else (b" ".join(words),)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in made), np.uint64))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], pa.Array]]:
    """Slices of the batches with the texts' sets and their nodes (a hash of the set)."""
    import xxhash

    for batch in slices(batches):
        sets = [shingles(t or b"", size) for t in batch["text"].cast(pa.binary()).to_pylist()]
        yield batch, sets, pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))


def _nodes(size: int, tables: int, width: int):
    """Each row's node, the size of its set, its fingerprint's first words and its cells; of the empty set none."""
    words = max(WIDE, -(-tables * width // 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets, node in _sets(batches, size):
            fps = np.array([long_fingerprint(s, words) for s in sets], np.uint64).reshape(-1, words)
            cells = pa.array([c if len(s) else () for c, s in zip(wide_cells(fps, tables, width), sets)], pa.list_(pa.int64()))
            first = [pa.array(fps[:, k].copy().view(np.int64)) for k in range(WIDE)]
            yield pa.record_batch([batch["id"], batch["mark"], node, pa.array([len(s) for s in sets], pa.int64()), *first, cells], ["id", "mark", "node", "n", *WORDS, "cells"])

    return run


def _held(size: int):
    """Each row's node and its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, node in _sets(batches, size):
            yield pa.record_batch([node, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "held"])

    return run


def forest(root: np.ndarray, size: np.ndarray, values: np.ndarray, similarity: float, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of components (root) joined by sets of at least the similarity; values are all sets, one after another.

    The sets that ask (those outside the largest component, if left out) are compared with all others by counting what
    they share; pairs within one component are not looked at.
    """
    ends = np.cumsum(size)
    which = np.unique(values, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(root)), size)[np.argsort(which, kind="stable")]  # of each shingle, the sets that hold it
    first = np.concatenate(([0], np.cumsum(np.bincount(which))))
    label = np.unique(root, return_inverse=True)[1]
    out = []
    for p in np.nonzero(label != np.bincount(label).argmax() if asks is None else asks)[0]:
        mine = which[ends[p] - size[p] : ends[p]]
        begin, many = first[mine], first[mine + 1] - first[mine]
        places = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        common = np.bincount(owner[places], minlength=len(root))
        near = (common / np.maximum(size[p] + size - common, 1) >= similarity) & (label != label[p])
        for other in np.unique(label[near]):
            out.append((int(root[p]), int(root[np.nonzero(near & (label == other))[0][0]])))
            label[label == other] = label[p]
    return out


def _block(similarity: float):
    def run(group: pa.Table) -> pa.Table:
        held = group["held"].combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        size = np.diff(held.offsets.to_numpy())
        found = forest(group["root"].to_numpy(), size, held.flatten().to_numpy(), similarity, group["asks"].to_numpy())
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _dealt(parts: DataFrame) -> DataFrame:
    """Members (star, node, n, root) of stars of more than one component, dealt to blocks: star, i, j, asks, node, root.

    Each member lies in one block i. What lies outside the largest component asks: it is sent to all blocks, in as many
    shares j as keep a share as small as a block. With few outside, that is each member once.
    """
    of = parts.groupBy("star", "root").agg(F.count("*").alias("m"), F.sum("n").alias("held_n"))
    largest = F.max(F.struct("m", "root", "held_n")).alias("largest")
    stars = of.groupBy("star").agg(largest, F.count("*").alias("roots"), F.sum("m").alias("m"), F.sum("held_n").alias("held_n")).filter("roots > 1 and m > 2")
    shares = lambda m, held: F.greatest(F.lit(1), F.ceil(m / BLOCK), F.ceil(held / BLOCK_SHINGLES)).cast("int")
    stars = stars.select("star", F.col("largest.root").alias("main"), shares(F.col("m"), F.col("held_n")).alias("k"), shares(F.col("m") - F.col("largest.m"), F.col("held_n") - F.col("largest.held_n")).alias("shares"))
    inside = table(parts.join(few(table(stars, "near-open")), "star"), "near-parts")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    members = inside.select("star", placed("k", 1).alias("i"), each("shares").alias("j"), F.lit(False).alias("asks"), "node", "root")
    outside = inside.filter("root <> main").select("star", each("k").alias("i"), placed("shares", 2).alias("j"), F.lit(True).alias("asks"), "node", "root")
    return members.unionByName(outside)


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return df.select(F.col(f"`{id_col}`").alias("id"), mark(text).alias("mark"), text.alias("text"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """id, mark (a hash of the text) and component_id of each row."""
    kind = df.schema[id_col].dataType.simpleString()
    texts = _named(df, id_col, text_col)
    ddl = f"id {kind}, mark long, node long, n long, {', '.join(f'{w} long' for w in WORDS)}, cells array<long>"
    rows = table(texts.mapInArrow(_nodes(size, *choose_tables(df.count(), similarity)), ddl), "near-rows")
    least = F.min(F.struct(F.col("id").isNull(), "id", "mark"))  # the row that stands for a node
    points = table(rows.groupBy("node").agg(least.alias("row"), *(F.first(c).alias(c) for c in ("n", *WORDS, "cells"))), "near-points")
    met = table(wide_families(points, similarity), "near-stars")

    # each node against its leaders; no similarity exceeds that of the sizes
    pairs = met.filter((F.col("node") != F.col("star")) & (F.least("n", "star_n") / F.greatest("n", "star_n") >= similarity)).select("star", "node")
    some = points.join(met.select("node").distinct(), "node").select(F.col("row.id").alias("id_"), F.col("row.mark").alias("mark_"))
    some = few(table(some, "near-wanted"))
    again = texts.join(some, texts["id"].eqNullSafe(some["id_"]) & (texts["mark"] == some["mark_"]), "left_semi")
    sets = table(again.mapInArrow(_held(size), "node long, held array<long>").dropDuplicates(["node"]), "near-sets")
    both = pairs.join(sets.withColumnRenamed("held", "x"), "node").join(sets.select(F.col("node").alias("star"), F.col("held").alias("y")), "star")
    common = F.size(F.array_intersect("x", "y"))
    links = table(both.filter(common / (F.size("x") + F.size("y") - common) >= similarity).select(F.col("node").alias("a"), F.col("star").alias("b")), "near-links")
    found = roots(links)

    # stars of more than one component, in blocks
    parts = met.select("star", "node", "n").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    dealt = table(_dealt(parts), "near-dealt")
    if not dealt.isEmpty():
        rest = dealt.join(sets, "node").groupBy("star", "i", "j").applyInArrow(_block(similarity), "a long, b long")
        higher = roots(rest).select(F.col("node").alias("root"), F.col("root").alias("top"))  # of components, so few
    else:
        higher = found.select("root", F.col("root").alias("top")).limit(0)
    named = points.join(found, "node", "left").select("node", F.col("row.id").alias("first"), F.coalesce("root", "node").alias("root"))
    named = named.join(few(higher), "root", "left").withColumn("root", F.coalesce("top", "root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("id", "mark", "node").join(named.join(smallest, "root").select("node", "component_id"), "node").select("id", "mark", "component_id")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id_col and component_id, the smallest id reachable by pairs of at least the similarity, of each row.

    Null and wordless texts are one node, linked to no other. Repeated rows give repeated results; null ids are linked
    but never smallest (a component of null ids only has a null component_id); an empty table gives no rows; other
    columns are not read. A very long text is one set of hashes of 8 bytes a word. A lower similarity takes more tables and
    wider distances, so that more unrelated texts meet.
    """
    return classes(df, id_col, text_col, **options).select(F.col("id").alias(id_col), "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df without near copies: of each component the document with the smallest id stays, once.

    Rows with a null id take no part: they stay, and no row goes because of them.
    """
    return keep_first(df, classes(df.filter(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, **options), id_col, text_col)

"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the number of set bits in each of its 32 two-bit segments. The Manhattan distance of
two such points never exceeds the fingerprints' Hamming distance, so points farther apart than the limit cannot link. The
grid: the segments are cut into parts; a distance of at most 3 leaves all but 3 parts equal, so a pair meets in the cell
of some choice of parts without those 3. More parts make finer and more cells; their number follows from the number of
fingerprints. Pairs that meet are tested by Manhattan distance and verified on the full fingerprints. Only distinct
fingerprints are joined; a cell with very many is compared in bounded blocks, each of which returns a spanning forest of
its links instead of the pairs.

Where a similarity below that is asked for (families), the distance is too wide for one such grid. Fingerprints are then
longer, and the grid is many tables of a few segments each: a pair meets where all segment counts of some table agree.
Within a cell, pairs are again tested by Manhattan distance and verified on the fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, log1p, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, few, slices, table

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 3
#: Fingerprints in one cell beyond which the cell is compared in blocks of BLOCK rows.
HOT_CELL = 1000
BLOCK = 2048
#: Nodes of a task's links contracted at once, and partitions of a round with few links.
CHUNK = 1 << 18
LITTLE_PARTS = 8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EVEN = 0x5555555555555555
SEGMENTS = 32
#: Numbers of parts to choose from, and the chance that two unrelated fingerprints have one segment count in common.
PARTS = (6, 8, 10, 12, 14)
SAME_COUNT = 0.375
#: Long fingerprints: words whose distance is tested, the odds that no table has a pair, and what small sets add to the
#: odds that a bit differs (four of five shingles: 0.1875, not 0.1515).
WIDE = 4
MISS = 1e-6
SMALL_SETS = 1.25
#: Fingerprints of one block of a cell, and those compared at once with so many others.
CELL_BLOCK = 1 << 16
STRIP, COLUMNS = 128, 1 << 13
#: Rows of a cell that take as long to compare with one as that one's move to the cell.
MOVE = 30_000


def fingerprint(text: bytes) -> int:
    """Of a UTF-8 text, as a signed 64-bit number; 0 if it has no word."""
    import xxhash

    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else (b" ".join(words),)
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], ">u8")
    return int(np.packbits(_ones(hashes) * 2 > len(hashes)).view(">i8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set, highest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return total


def mark(text: Column) -> Column:
    """A hash of a text that tells rows of one id apart."""
    return F.xxhash64(text)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch["text"].cast(pa.binary()).to_pylist()
        yield pa.record_batch([batch["id"], batch["mark"], pa.array([fingerprint(t or b"") for t in texts], pa.int64())], ["id", "mark", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, mark and fp (signed 64-bit) of each row; a null text counts as empty."""
    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), mark(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(_fingerprints, f"id {kind}, mark long, fp long")


def embedding(fp: Column) -> Column:
    """The 32 segment counts in one long, two bits each: 0 as 00, 1 as 01, 2 as 11.

    So written, the Manhattan distance of two points is the number of bits in which they differ.
    """
    other = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseOR(other).bitwiseAND(F.lit(_EVEN))
    return one.bitwiseOR(F.shiftleft(fp.bitwiseAND(other).bitwiseAND(F.lit(_EVEN)), 1))


def grids(parts: int, limit: int) -> list[int]:
    """For each choice of parts that may be the equal ones, the mask (signed) of their segments."""
    edges = [SEGMENTS * k // parts for k in range(parts + 1)]
    masks = [(1 << 2 * b) - (1 << 2 * a) for a, b in zip(edges, edges[1:])]
    return [m - (m >> 63 << 64) for chosen in combinations(masks, parts - limit) for m in [sum(chosen)]]


def choose_parts(n: int, limit: int) -> int:
    """The number of parts with the fewest cells and expected meetings of n unrelated fingerprints."""

    def cost(parts: int) -> float:
        edges = [SEGMENTS * k // parts for k in range(parts + 1)]
        least = sum(sorted(b - a for a, b in zip(edges, edges[1:]))[: parts - limit])
        return comb(parts, limit) * (n + n * n / 2 * SAME_COUNT**least)

    return min((p for p in PARTS if p > limit and comb(p, limit) <= 1000), key=cost)


def _forest(values: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct values: breadth first, each value compared with the unreached."""
    rest, out = values.view(np.uint64), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            v = queue.pop()
            near = np.bitwise_count(rest ^ v) <= limit
            if near.any():
                out += [(int(v.astype(np.int64)), int(x.astype(np.int64))) for x in rest[near]]
                queue += list(rest[near])
                rest = rest[~near]
    return out


def _block_links(limit: int):
    def run(group: pa.Table) -> pa.Table:
        found = _forest(np.unique(group["fp"].to_numpy()), limit)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def deal(rows: DataFrame, by: str, group: list[str]) -> DataFrame:
    """rows, of groups in k blocks each, once for every pair of blocks i <= j of the group that has the row's own."""
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64(by), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("mine", "other", "k")


def links(points: DataFrame, limit: int = MAX_DISTANCE, hot_cell: int = HOT_CELL, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints: every pair within limit is linked or joined by a chain of links.

    parts is chosen by the count of points if left out; results are the same for any.
    """
    if not 0 <= limit <= 6:
        raise ValueError("distances up to 6 can be searched")
    masks = grids(parts or choose_parts(points.count(), limit), limit)
    own = points.select("fp", embedding(F.col("fp")).alias("point"))
    own = own.select("fp", "point", F.posexplode(F.array(*(F.col("point").bitwiseAND(F.lit(m)) for m in masks))).alias("grid", "cell"))
    hot = table(own.groupBy("grid", "cell").agg(F.count("*").alias("m")).filter(F.col("m") > hot_cell), "simhash-hot")
    crowded = not hot.isEmpty()
    cool = own.join(few(hot), ["grid", "cell"], "left_anti") if crowded else own
    pairs = cool.select("grid", "cell", F.col("fp").alias("a"), F.col("point").alias("p")).join(cool.select("grid", "cell", F.col("fp").alias("b"), F.col("point").alias("q")), ["grid", "cell"])
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= limit
    found = pairs.filter((F.col("a") < F.col("b")) & apart("p", "q") & apart("a", "b")).select("a", "b")
    if crowded:  # all in a hot cell, in blocks; each pair of blocks is one group of about 2 * block rows
        many = own.select("fp", "grid", "cell").join(few(hot), ["grid", "cell"]).withColumn("k", F.ceil(F.col("m") / F.lit(block)).cast("int")).drop("m")
        found = found.unionByName(deal(many, "fp", ["grid", "cell"]).groupBy("grid", "cell", "i", "j").applyInArrow(_block_links(limit), "a long, b long"))
    return found


def differing(similarity: float) -> float:
    """The odds that a bit of the fingerprints of two sets of that Jaccard similarity differs, at most."""
    return SMALL_SETS * acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def wide_limit(similarity: float) -> int:
    """The distance in WIDE words that two sets of the similarity exceed once in some million times."""
    q = differing(similarity)
    return ceil(64 * WIDE * q + 5 * (64 * WIDE * q * (1 - q)) ** 0.5)


def choose_tables(n: int, similarity: float) -> tuple[int, int]:
    """Tables and segments in each, for n fingerprints: those with the least to move and to compare."""
    q = differing(similarity)
    same = (1 - q) ** 2 + q * q / 2
    tables = lambda width: max(1, ceil(log(MISS) / log1p(-(same**width))))

    def cost(width: int) -> float:
        cell = n * SAME_COUNT**width
        return tables(width) * (MOVE * (1 + cell / CELL_BLOCK) + cell / 2)

    width = min(range(3, 14), key=cost)
    return tables(width), width


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """Of a set of 64-bit hashes, in words of 64 bits: the first of the hashes' own bits, the others of those mixed anew."""
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 1 << 11):
        z = hashes[at : at + (1 << 11), None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        mixed[:, 0] = z[:, 0]
        total += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def points(fps: np.ndarray) -> np.ndarray:
    """embedding of an array of fingerprints."""
    even, other = np.uint64(_EVEN), fps >> np.uint64(1)
    return ((fps | other) & even) | ((fps & other & even) << np.uint64(1))


def wide_cells(fps: np.ndarray, tables: int, width: int) -> np.ndarray:
    """The cells of long fingerprints (a row each), one for each table: its number and its segments' counts."""
    counts = (points(fps)[:, :, None] >> np.arange(0, 64, 2, dtype=np.uint64)).reshape(len(fps), -1)[:, : tables * width] & np.uint64(3)
    own = (counts.reshape(len(fps), tables, width) * np.uint64(4) ** np.arange(width, dtype=np.uint64)).sum(2)
    return (own + np.arange(tables, dtype=np.uint64) * np.uint64(4**width)).view(np.int64)


def families(fps: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """A label for each set of a cell: sets joined by chains of pairs within wide_limit share one; fps has WIDE columns.

    Only sizes that the similarity allows are compared. A family once found is not compared within itself, so that a
    crowd of copies costs its size.
    """
    limit, m = wide_limit(similarity), len(size)
    order = np.argsort(size, kind="stable")
    fps, size = fps[order], size[order]
    at, up = points(fps), list(range(m))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    alive, label, family = np.ones(m, bool), np.arange(m), -1  # equal labels: one family; not always the reverse
    while True:
        rest = np.nonzero(alive)[0]
        strip = rest[label[rest] == family][:STRIP] if family >= 0 else rest[:0]
        of = family if len(strip) else -1
        strip = strip if len(strip) else rest[:STRIP]
        if not len(strip):
            break
        alive[strip] = False
        others = rest[label[rest] != of] if of >= 0 else rest
        low, high = np.searchsorted(size[others], [size[strip[0]] * similarity * (1 - 1e-9), size[strip[-1]] / similarity * (1 + 1e-9)])
        family = of
        for begin in range(low, high, COLUMNS):
            cols = others[begin : min(begin + COLUMNS, high)]
            apart = np.zeros((len(strip), len(cols)), np.uint8)  # 256 becomes 0, which the fingerprints then refuse
            for w in range(fps.shape[1]):
                apart += np.bitwise_count(at[strip, w][:, None] ^ at[cols, w])
            r, c = np.nonzero(apart <= limit)  # the Manhattan distance never exceeds that of the fingerprints
            near = (strip[r] != cols[c]) & (np.bitwise_count(fps[strip[r]] ^ fps[cols[c]]).sum(1, dtype=np.int64) <= limit)
            r, c = r[near], c[near]
            if not len(r):
                continue
            first = np.full(len(cols), STRIP)
            np.minimum.at(first, c, r)
            hit = np.unique(c)
            pairs = np.unique(r * STRIP + first[c])  # rows of the strip that meet in a column
            joined = [(strip[p // STRIP], strip[p % STRIP]) for p in pairs] + list(zip(strip[first[hit]], cols[hit]))
            for a, b in joined:
                a, b = top(int(a)), top(int(b))
                up[max(a, b)] = min(a, b)
            tops = {int(k): top(int(strip[k])) for k in np.unique(first[hit])}
            label[cols[hit]] = [tops[k] for k in first[hit].tolist()]
            label[strip] = [top(int(x)) for x in strip]
            many = np.bincount(label[cols[hit]])
            if many.max() >= STRIP or of >= 0:
                family = int(many.argmax()) if of < 0 else of
    out = np.empty(m, np.int64)
    out[order] = [top(x) for x in range(m)]
    return out


def _cell_families(similarity: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node").combine_chunks()  # so a family's first row is its smallest node
        node, n = group["node"].to_numpy(), group["n"].to_numpy()
        fps = np.stack([group[f"w{k}"].to_numpy().view(np.uint64) for k in range(WIDE)], axis=1)
        _, first, which, many = np.unique(families(fps, n, similarity), return_index=True, return_inverse=True, return_counts=True)
        some = many[which] > 1
        star = first[which[some]]
        return pa.table({"star": node[star], "star_n": n[star], "node": node[some], "n": n[some]})

    return run


def wide_families(rows: DataFrame, similarity: float) -> DataFrame:
    """star, star_n, node, n: each family of each cell under its smallest node, itself included.

    rows has node, n (the set's size), w0, w1, ... (WIDE words of its long fingerprint) and cells. Two sets of at least
    the similarity are in one family but for MISS and the odds of wide_limit. A cell of more than CELL_BLOCK rows is
    compared in blocks, each pair of them in its own group.
    """
    own = rows.select("node", "n", *(f"w{k}" for k in range(WIDE)), F.explode("cells").alias("cell"))
    crowded = own.groupBy("cell").agg(F.count("*").alias("m")).filter(F.col("m") > CELL_BLOCK)
    hot = table(crowded.select("cell", F.ceil(F.col("m") / CELL_BLOCK).cast("int").alias("k")), "simhash-crowded")
    if not hot.isEmpty():
        own = deal(own.join(few(hot), "cell", "left").fillna(1, ["k"]), "node", ["cell"])
    else:
        own = own.withColumns({"i": F.lit(0), "j": F.lit(0)})
    return own.groupBy("cell", "i", "j").applyInArrow(_cell_families(similarity), "star long, star_n long, node long, n long").distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task as stars: within at most CHUNK nodes at once, each node is linked to the smallest it reaches."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, top(x)) for x in list(up)]
        up.clear()
        return pa.record_batch([pa.array([x for x, r in pairs if x != r], pa.int64()), pa.array([r for x, r in pairs if x != r], pa.int64())], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            x, y = sorted((top(x), top(y)))
            up[y] = x
        if len(up) >= CHUNK:
            yield stars()
    yield stars()


def roots(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each linked node's component, by alternating large and small stars.

    Links are first contracted within their tasks. Each round replaces links by links to smaller nodes; minima are taken
    by aggregation, so that no task holds a node's neighbours. Rounds grow with the logarithm of the longest chain; each
    is written to the shared folder.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = table(edges.mapInArrow(_contract, "a long, b long").distinct(), "links")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        little = mark[0] <= BROADCAST_ROWS  # what is joined then has at most two rows for each link
        hint = F.broadcast if little else lambda x: x
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(hint(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        joined = large.join(hint(large.groupBy("a").agg(F.min("b").alias("m"))), "a")
        edges = joined.select("a", F.col("m").alias("b")).unionByName(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = table(edges.coalesce(LITTLE_PARTS) if little else edges, "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free sums that change when a link does."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _classes(rows: DataFrame, limit: int, **options) -> DataFrame:
    """rows (id, fp and more) with component_id."""
    points = table(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-points")
    found = roots(links(points.select("fp"), limit, **options))
    named = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "fp")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_DISTANCE, **options) -> DataFrame:
    """id_col, fingerprint (16 lowercase hex digits) and component_id, the smallest id reachable, of each row.

    Null and wordless texts share the fingerprint zero. Repeated rows give repeated results; null ids are linked but
    never smallest (a component of null ids only has a null component_id); an empty table gives no rows; other columns
    are not read. A very long text is read whole, its shingles counted in pieces.
    """
    found = _classes(table(fingerprints(df, id_col, text_col), "simhash-fingerprints"), limit, **options)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_DISTANCE, **options) -> DataFrame:
    """The rows of df without near copies: of each component the document with the smallest id stays, once.

    Rows with a null id take no part: they stay, and no row goes because of them.
    """
    known = df.filter(F.col(f"`{id_col}`").isNotNull())
    return keep_first(df, _classes(table(fingerprints(known, id_col, text_col), "simhash-fingerprints"), limit, **options), id_col, text_col)


def keep_first(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df but those that found (id, mark, component_id) puts behind another id; repeated rows stay once.

    What goes is joined, not what stays, so that texts are shuffled only where very much goes.
    """
    found = table(found.select("id", "mark", "component_id"), "near-classes")

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        key = few(keys.select(F.struct("id", "mark").alias("_key")))
        text = rows[text_col].cast("string")
        return rows.join(key, (rows[id_col] == key["_key"]["id"]) & (mark(text) == key["_key"]["mark"]), how)

    kept = among(df, found.filter("id <> component_id"), "left_anti")
    again = table(found.filter("id = component_id").groupBy("id", "mark").count().filter("count > 1"), "near-repeated")
    if again.isEmpty():
        return kept
    return among(kept, again, "left_anti").unionByName(among(kept, again, "left_semi").dropDuplicates([id_col, text_col]))

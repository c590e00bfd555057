"""Nearest neighbours by largest inner product with vantage-point trees, one per shard.

Vectors get one more component, so that the largest inner product is the smallest Euclidean distance. A bounded number of
rows are vantage points on two levels: heads, and under each head the vantage points nearest to it. Every row belongs to
the region of the vantage point that it is led to, whose radius is kept, and a region is cut into shards of bounded size,
each with a tree. A query first searches its own region; the distance of its
last place there is its radius, and it is sent on only to heads, and under them to regions, that the triangle inequality, with
the radius times the relaxation factor, cannot rule out; the same test skips subtrees. Factor one is exact, smaller factors skip more. A
shard's rows come before its queries in one sorted partition, so a tree is built once and queries stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, table

NEAREST = 20
#: Search radius factor of the triangle inequality: 1 is exact on any vectors; how much less loses depends on the table.
FACTOR = 1.0
#: Vantage points at most: a sample of rows by a hash, one for each shard of smaller tables. With shards of SHARD rows a
#: region is one shard up to 10^9 rows, and ten at 10^10.
PIVOTS = 65_536
#: Heads under which the nearest vantage point of a row is looked for.
LED = 4
#: Queries whose visits leave a task together.
ONWARD = 256
#: Expected rows of a shard, queries that meet one tree before it is built again elsewhere, and rows of a leaf.
SHARD = 16_384
BLOCK = 262_144
LEAF = 128
#: Scores this close to the last place, for vectors of unit length, are measured exactly before they are dropped.
SLACK = 1e-9


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    vantage: int = -1
    near: Node | None = None
    far: Node | None = None
    near_max: float = 0.0
    far_min: float = 0.0


def build(points: np.ndarray, leaf: int = LEAF) -> Node:
    """A tree over the rows of points. Halves are cut by rank, so equal points cannot unbalance it."""
    rng = np.random.default_rng(11)

    def grow(rows: np.ndarray) -> Node:
        if len(rows) <= leaf:
            return Node(rows=rows)
        vantage = int(rows[rng.integers(len(rows))])
        far_off = np.linalg.norm(points[rows] - points[vantage], axis=1)
        order = np.argsort(far_off, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return Node(None, vantage, grow(rows[near]), grow(rows[far]), float(far_off[near[-1]]), float(far_off[far[0]]))

    return grow(np.arange(len(points)))


class Search:
    """The best k rows of each query so far, and the walk down a tree with all queries at once."""

    def __init__(self, points: np.ndarray, queries: np.ndarray, k: int, factor: float, longest: float = 1.0, bound: np.ndarray | float = np.inf):
        self.points, self.queries, self.k, self.factor = points, queries, k, factor
        self.slack, self.square_slack = SLACK * max(1.0, longest), SLACK * max(1.0, longest * longest)
        self.norms = np.einsum("ij,ij->i", points, points)
        # squared distances less the query's own square, ascending; none beyond bound is wanted
        self.best = np.full((len(queries), k), np.inf) if np.isscalar(bound) else np.repeat(bound[:, None], k, axis=1)
        self.own = np.einsum("ij,ij->i", queries, queries)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def radius(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.best[q, -1] + self.own[q], 0.0))

    def leaf(self, rows: np.ndarray, q: np.ndarray) -> None:
        got = self.norms[rows][None, :] - 2.0 * (self.queries[q] @ self.points[rows].T)
        both = np.concatenate([self.best[q], got], axis=1)
        self.best[q] = np.sort(np.partition(both, self.k - 1, axis=1)[:, : self.k], axis=1)
        a, b = np.nonzero(got <= self.best[q, -1][:, None] + self.square_slack)
        self.rows.append((q[a], rows[b], got[a, b]))

    def walk(self, node: Node, q: np.ndarray) -> None:
        if not len(q):
            return
        if node.rows is not None:
            return self.leaf(node.rows, q)
        d = np.linalg.norm(self.queries[q] - self.points[node.vantage], axis=1)
        inner = d <= (node.near_max + node.far_min) / 2
        self.walk(node.near, q[inner])
        self.walk(node.far, q[~inner])
        reach = self.factor * self.radius(q)
        self.walk(node.near, q[~inner & (d - reach <= node.near_max + self.slack)])
        self.walk(node.far, q[inner & (d + reach >= node.far_min - self.slack)])

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all that may be among the k best."""
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, r, d = (np.concatenate(x) for x in zip(*self.rows))
        keep = d <= self.best[q, -1] + self.square_slack
        return q[keep], r[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass(frozen=True)
class Map:
    """The regions: lifted vantage points, those of one head side by side; radii, first shard of each and number of its
    shards; heads, the first vantage point of each (with the end as last), and radii; longest vector."""

    pivots: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    many: np.ndarray
    heads: np.ndarray
    begins: np.ndarray
    head_radius: np.ndarray
    longest: float

    @staticmethod
    def of(pivots: np.ndarray, longest: float) -> Map:
        """A map of lifted vantage points, about as many under each head as there are heads; nothing placed yet."""
        none = np.zeros(0, np.int64)
        heads = pivots[np.linspace(0, len(pivots) - 1, max(1, round(len(pivots) ** 0.5))).astype(np.int64)]
        nearest = np.concatenate([_distances(pivots[at : at + 4096], heads).argmin(axis=1) for at in range(0, len(pivots), 4096)])
        order = np.argsort(nearest, kind="stable")
        begins = np.searchsorted(nearest[order], np.arange(len(heads) + 1))
        return Map(pivots[order], none, none, none, heads, begins, none, longest)

    def placed(self, radius: np.ndarray, first: np.ndarray, many: np.ndarray) -> Map:
        """The map with what the regions hold; a head reaches as far as any of its regions."""
        far = np.full(len(self.heads), -np.inf)
        for h, (a, b) in enumerate(zip(self.begins, self.begins[1:])):
            if b > a:
                far[h] = (_distances(self.heads[h : h + 1], self.pivots[a:b])[0] + radius[a:b]).max()
        return Map(self.pivots, radius, first, many, self.heads, self.begins, far, self.longest)

    def led(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vantage point that each lifted point is led to, by way of its LED nearest heads, and the distance to it."""
        region, far = np.zeros(len(z), np.int64), np.full(len(z), np.inf)
        to_heads = _distances(z, self.heads)
        to_heads[:, self.begins[1:] == self.begins[:-1]] = np.inf
        for head in np.argsort(to_heads, axis=1, kind="stable")[:, :LED].T:
            for h in np.unique(head):
                if self.begins[h + 1] == self.begins[h]:
                    continue
                own = np.nonzero(head == h)[0]
                d = _distances(z[own], self.pivots[self.begins[h] : self.begins[h + 1]])
                best = d.argmin(axis=1)
                least = d[np.arange(len(own)), best]
                nearer = least < far[own]
                region[own[nearer]], far[own[nearer]] = best[nearer] + self.begins[h], least[nearer]
        return region, far

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows, all as long as the longest."""
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0.0))])

    def aim(self, y: np.ndarray) -> np.ndarray:
        """Queries, which have no such component; their length does not change an order, so they are made as long."""
        return np.column_stack([y * (self.longest / np.linalg.norm(y, axis=1))[:, None], np.zeros(len(y))])


def _distances(z: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", z, z)[:, None] + np.einsum("ij,ij->i", points, points)[None, :] - 2.0 * (z @ points.T)
    return np.sqrt(np.maximum(square, 0.0))


def _regions(shared, lifted: bool):
    """tag, id, v, region and the distance from its vantage point, of rows (lifted) or queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["v"])
                region, far = shared.value.led(shared.value.lift(x) if lifted else shared.value.aim(x))
                yield pa.record_batch([batch["tag"], batch["id"], batch["v"], pa.array(region, pa.int32()), pa.array(far)], ["tag", "id", "v", "region", "far"])

    return run


def _onward(shared, factor: float):
    """Queries (with region, kth: the score of their last place, or null) for each other shard that may hold better rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slack = SLACK * max(1.0, m.longest)
        for whole in batches:
            for batch in (whole.slice(at, ONWARD) for at in range(0, whole.num_rows, ONWARD)):
                y, home = _matrix(batch["v"]), batch["region"].to_numpy()
                aimed = m.aim(y)
                kth = batch["kth"].to_numpy(zero_copy_only=False).astype(np.float64)
                bound = np.where(np.isnan(kth), np.inf, m.longest**2 - 2.0 * kth * (m.longest / np.linalg.norm(y, axis=1)))
                reach = factor * np.sqrt(np.maximum(bound + m.longest**2, 0.0)) + slack
                to_heads = _distances(aimed, m.heads)
                for h, (a, b) in enumerate(zip(m.begins, m.begins[1:])):
                    asks = np.nonzero(to_heads[:, h] - m.head_radius[h] <= reach)[0]
                    if b == a or not len(asks):
                        continue
                    near = _distances(aimed[asks], m.pivots[a:b]) - m.radius[None, a:b] <= reach[asks, None]
                    near &= home[asks, None] != np.arange(a, b)[None, :]
                    q, r = np.nonzero(near)
                    q, r = asks[q], r + a
                    to = np.repeat(np.arange(len(q)), m.many[r])
                    shard = m.first[r][to] + np.arange(len(to)) - (np.cumsum(m.many[r]) - m.many[r])[to]
                    rows = pa.array(q[to])
                    yield pa.record_batch([batch["tag"].take(rows), batch["id"].take(rows), batch["v"].take(rows), pa.array(shard, pa.int32()), pa.array(bound[q[to]])], ["tag", "id", "v", "shard", "bound"])

    return run


def _walked(shared, k: int, factor: float, leaf: int):
    """A sorted partition: of each shard and block first the rows, then the queries (asks), which stream past the tree."""

    def answer(index: tuple[np.ndarray, ...], tree: Node, points: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        tags, ids, x = index
        y, asked = _matrix(batch["v"]), batch["tag"].to_numpy()
        search = Search(points, shared.value.aim(y), min(k + 1, len(x)), factor, shared.value.longest, batch["bound"].to_numpy())
        search.walk(tree, np.arange(len(y)))
        q, r = search.found()
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for part in np.array_split(np.arange(len(q)), max(1, len(q) >> 16)):
            a, b = q[part], r[part]
            other = tags[b] != asked[a]
            for column, values in zip(out, (a[other], b[other], (y[a[other]] * x[b[other]]).sum(axis=1))):
                column.append(values)
        query, row, score = (np.concatenate(c) for c in out)
        order = np.lexsort((tags[row], ids[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        top = np.arange(len(query)) - np.searchsorted(query, query) < k
        query, row = query[top], row[top]
        return pa.record_batch([pa.array(asked[query]), batch["id"].take(pa.array(query)), pa.array(tags[row]), pa.array(ids[row]), pa.array(score[top])], ["q_tag", "query_id", "tag", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, built = None, [], None
        for batch in batches:
            keys = np.stack([batch["shard"].to_numpy(), batch["block"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False).astype(np.int32)], 1)
            edges = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if now != (key := tuple(keys[a, :2])):
                    now, parts, built = key, [], None
                part = batch.slice(a, b - a)
                if not keys[a, 2]:
                    parts.append((part["tag"].to_numpy(), part["id"].to_numpy(), _matrix(part["v"])))
                elif parts:
                    if built is None:
                        index = tuple(np.concatenate(c) for c in zip(*parts))
                        points = shared.value.lift(index[2])
                        built = index, build(points, leaf), points
                    yield answer(*built, part)

    return run


_FOUND = "q_tag long, query_id long, tag long, vec_id long, score double"


def _search(index: DataFrame, asked: DataFrame, block: int, walked) -> DataFrame:
    """asked (with shard and bound) sent past the trees of index; a shard's rows are copied for each block of its queries."""
    asked = table(asked, "ann-visits")
    blocks = few(asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("k")))
    rows = index.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), F.lit(False).alias("asks"), "tag", "id", "v", F.lit(0.0).alias("bound"))
    sent = asked.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("tag"), F.col("k")).cast("int").alias("block"), F.lit(True).alias("asks"), "tag", "id", "v", "bound")
    return rows.unionByName(sent).repartition("shard", "block").sortWithinPartitions("shard", "block", "asks").mapInArrow(walked, _FOUND)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF, pivots: int = PIVOTS) -> DataFrame:
    """For each row where queries holds: query_id, rank (from 1), vec_id and score of its k nearest among all other rows.

    Ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    rows with a null id; vectors of another length than the query's are no candidates of it, so each length is a table of
    its own. Repeated rows and rows that share an id are rows of their own: each asks, and each may be found. Fewer
    candidates give fewer rows, an empty table none; other columns are not read. Every row is indexed but those that no
    answer can hold: of equal vectors the k + 1 with the smallest ids. With factor 1 the result is exact.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = table(rows.withColumn("tag", F.monotonically_increasing_id()), "ann-vectors")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(size).alias("longest")).orderBy("n").collect()
    found = None
    for one in lengths:  # one a length of vectors
        part = _one_length(rows.filter(F.size("v") == one["n"]), one["rows"], one["longest"] * (1 + 1e-12), k, factor, shard, block, leaf, pivots)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found.select("query_id", "rank", "vec_id", "score")


def _one_length(rows: DataFrame, n: int, longest: float, k: int, factor: float, shard: int, block: int, leaf: int, pivots: int) -> DataFrame:
    spark = rows.sparkSession
    twin = Window.partitionBy("v").orderBy("id", "tag")
    index = rows.withColumn("place", F.row_number().over(twin)).filter(F.col("place") <= k + 1)
    many = max(1, min(pivots, n // shard))
    chosen = _matrix(rows.select("v").orderBy(F.xxhash64("tag", F.lit(1))).limit(many).toArrow()["v"].combine_chunks())
    lift = Map(*(np.zeros(0),) * 7, longest).lift
    start = spark.sparkContext.broadcast(Map.of(lift(np.unique(chosen, axis=0)), longest))
    placed = "tag long, id long, v array<double>, region int, far double"
    index = table(index.select("tag", "id", "v").mapInArrow(_regions(start, True), placed), "ann-regions")
    facts = {r["region"]: r for r in index.groupBy("region").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # one of each vantage point
    places = range(len(start.value.pivots))
    sizes = np.array([-(-facts[p]["n"] // shard) if p in facts else 0 for p in places], np.int64)
    radius = np.array([facts[p]["far"] if p in facts else -np.inf for p in places]) + SLACK * max(1.0, longest)
    shared = spark.sparkContext.broadcast(start.value.placed(radius, np.cumsum(sizes) - sizes, sizes))
    known = [(p, int(shared.value.first[p]), int(sizes[p])) for p in places if sizes[p]]
    shards = F.broadcast(spark.createDataFrame(known, "region int, first int, many int"))  # one row of each vantage point
    index = index.join(shards, "region").select("tag", "id", "v", (F.col("first") + F.pmod(F.xxhash64("tag"), F.col("many"))).cast("int").alias("shard"))

    walked = _walked(shared, k, factor, leaf)
    asked = table(rows.filter("asks").select("tag", "id", "v").mapInArrow(_regions(shared, False), placed).drop("far"), "ann-queries")
    home = F.explode(F.sequence("first", F.col("first") + F.col("many") - 1)).alias("shard")
    own = asked.join(shards, "region").select("tag", "id", "v", home, F.lit(float("inf")).alias("bound"))
    best = Window.partitionBy("q_tag").orderBy(F.desc("score"), "vec_id", "tag")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = _search(index, own, block, walked)
    if len(known) > 1:
        first = table(top(found), "ann-home")
        kth = first.filter(F.col("rank") == k).select(F.col("q_tag").alias("tag"), F.col("score").alias("kth"))
        onward = asked.join(kth, "tag", "left").mapInArrow(_onward(shared, factor), "tag long, id long, v array<double>, shard int, bound double")
        found = first.drop("rank").unionByName(_search(index, onward, block, walked))
    return top(table(found, "ann-found") if sizes.sum() > 1 else found)

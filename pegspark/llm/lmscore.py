"""Stupid-backoff language-model scores, computed relationally.

The n-grams of all documents are exploded, counted in tables partitioned by hash, joined back and summed per document.
The relations are packed: documents are gathered in batches, a row holds the distinct n-grams of one batch in one
partition (bucket) of the hash space as arrays, and a frequent n-gram is there once per batch, not once per document.
One shuffle by bucket counts all orders; the counts return by batch, to a table of batches that is bucketed by batch and
so not shuffled, where tokens and counts are joined and the logarithms are summed. fit() gives the count tables of a
corpus by themselves, a row per n-gram, to be kept and joined when other texts are scored under them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed

ORDER = 3
#: What each step back to a shorter n-gram costs.
BACKOFF = 0.4
#: An n-gram of two words or more is in the tables if the corpus has it this often; else a text would vouch for itself.
MIN_COUNT = 2
#: Text per batch, and n-grams per bucket that the number of buckets is chosen for.
BATCH_BYTES = 12 << 20
BUCKET_NGRAMS = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits of an n-gram's hash that travel, beside its bucket.
HASH_BITS = 48
_ZSTD = pa.Codec("zstd", compression_level=1)


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case."""
    return _WORD.findall(text.translate(_LOWER))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in few bytes: the least width that holds them, byte plane by byte plane, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return width.to_bytes(1, "little") + len(values).to_bytes(8, "little") + _ZSTD.compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(_ZSTD.decompress(data[9:], n * width), np.uint8).reshape(width, n).T
    return wide.view("<u8").ravel()


def _batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batch, ids, words, lens (words per document), vocab (hashes of the batch's words), tokens (places in vocab)."""
    import xxhash

    task, number = TaskContext.get().partitionId(), count()
    place: dict[bytes, int] = {}
    ids: list = []
    lens: list[int] = []
    tokens: list[np.ndarray] = []
    held, kind = 0, pa.null()

    def full() -> pa.RecordBatch:
        vocab = np.fromiter((xxhash.xxh64_intdigest(w) for w in place), np.uint64, len(place))
        found = np.concatenate([np.zeros(0, np.uint32), *tokens])
        order = np.argsort(-np.bincount(found, minlength=len(vocab)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        packed = [pa.array([pack(x)], pa.binary()) for x in (np.array(lens, np.uint64), vocab[order], rank[found])]
        return pa.record_batch([pa.array([task << 32 | next(number)], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([len(found)], pa.int64()), *packed], ["batch", "ids", "words", "lens", "vocab", "tokens"])

    for batch in batches:
        kind = batch["id"].type
        for row in range(batch.num_rows):
            text = (batch["text"][row].as_py() or "").encode()
            found = words(text)
            ids.append(batch["id"][row].as_py())
            lens.append(len(found))
            tokens.append(np.fromiter((place.setdefault(w, len(place)) for w in found), np.uint32, len(found)))
            held += len(text)
            if held >= BATCH_BYTES:
                yield full()
                place, ids, lens, tokens, held = {}, [], [], [], 0
    if ids:
        yield full()


def _since(size: np.ndarray) -> np.ndarray:
    """Each token's place in its document."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _ngrams(size: np.ndarray, vocab: bytes, tokens: bytes, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: sorted distinct hashes, the distinct n-gram that ends at each token that has one, and where those are."""
    hashes = unpack(vocab)[unpack(tokens)]
    rolling, since = _mix(hashes), _since(size)
    for n in range(1, order + 1):
        if n > 1:
            longer = np.zeros_like(rolling)
            longer[1:] = _mix(rolling[:-1] * np.uint64(3) + hashes[1:])
            rolling = longer
        there = np.nonzero(since >= n - 1)[0]
        distinct, which = np.unique(rolling[there], return_inverse=True)
        yield distinct, which.astype(np.uint32), there


def _edges(buckets: int) -> list[int]:
    """The first hash of each bucket, an equal part of the hash space."""
    step = (1 << 64) // buckets + 1
    return [k * step for k in range(buckets)]


def _explode(order: int, buckets: int):
    begins = _edges(buckets)
    shift = np.uint64(max(0, ((1 << 64) // buckets).bit_length() - HASH_BITS))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for n, (distinct, which, _) in enumerate(_ngrams(unpack(row["lens"]).astype(np.int64), row["vocab"], row["tokens"], order), 1):
                    times = np.bincount(which, minlength=len(distinct))
                    cuts = [*np.searchsorted(distinct, np.array(begins, np.uint64), "left"), len(distinct)]
                    columns: list[list] = [[], [], [], [], []]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        if a < b:
                            inside = (distinct[a:b] - np.uint64(begins[k])) >> shift
                            for column, value in zip(columns, (row["batch"], n, k, pack(np.diff(inside, prepend=np.uint64(0))), pack(times[a:b]))):
                                column.append(value)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["batch", "n", "bucket", "hashes", "times"])

    return run


def _count(group: pa.Table) -> pa.Table:
    """One partition of the count table of one order; returns each batch's n-grams' counts, in the batch's order."""
    parts = [np.cumsum(unpack(x), dtype=np.uint64) for x in group["hashes"].to_pylist()]
    ends = np.cumsum([len(p) for p in parts])
    times = np.concatenate([unpack(x) for x in group["times"].to_pylist()])
    _, which = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(which, weights=times).astype(np.int64)[which]
    back = [pack(part) for part in np.split(total, ends[:-1])]
    return pa.table({"batch": group["batch"], "n": group["n"], "bucket": group["bucket"], "counts": pa.array(back, pa.binary())})


def _tabled(min_count: int, buckets: int):
    """One partition of the count table of one order, a row per n-gram; longer n-grams below min_count are left out."""

    def run(group: pa.Table) -> pa.Table:
        n, bucket = group["n"][0].as_py(), group["bucket"][0].as_py()
        distinct, which = np.unique(np.concatenate([np.cumsum(unpack(x), dtype=np.uint64) for x in group["hashes"].to_pylist()]), return_inverse=True)
        seen = np.bincount(which, weights=np.concatenate([unpack(x) for x in group["times"].to_pylist()])).astype(np.int64)
        kept = seen >= (min_count if n > 1 else 1)
        same = lambda value: pa.array(np.full(kept.sum(), value, np.int32))
        return pa.table({"n": same(n), "bucket": same(bucket), "buckets": same(buckets), "hash": pa.array(distinct[kept].view(np.int64)), "seen": pa.array(seen[kept])})

    return run


def _look_up(group: pa.Table, known: pa.Table) -> pa.Table:
    """The counts that a partition of kept tables has for each batch's n-grams; 0 for those that it lacks."""
    order = np.argsort(hashes := known["hash"].to_numpy().view(np.uint64), kind="stable")
    hashes, seen = np.append(hashes[order], np.uint64(0)), np.append(known["seen"].to_numpy()[order], 0)
    back = []
    for x in group["hashes"].to_pylist():
        asked = np.cumsum(unpack(x), dtype=np.uint64)
        at = np.searchsorted(hashes[:-1], asked)
        back.append(pack(np.where((at < len(hashes) - 1) & (hashes[at] == asked), seen[at], 0)))
    return pa.table({"batch": group["batch"], "n": group["n"], "bucket": group["bucket"], "counts": pa.array(back, pa.binary())})


def _score(order: int, total: int, min_count: int, backoff: float):
    names = ["n_words", "log_score", *(f"n_order{n}" for n in range(1, order + 1))]

    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        ids, out = [], [[] for _ in names]
        for row in docs.to_pylist():
            size = unpack(row["lens"]).astype(np.int64)
            since = _since(size)
            log, level, shorter = np.zeros(len(since)), np.ones(len(since), np.int8), np.zeros(0, np.int64)
            longest = np.minimum(since + 1, order)
            for n, (_, which, there) in enumerate(_ngrams(size, row["vocab"], row["tokens"], order), 1):
                own = counted.filter(pc.and_(pc.equal(counted["batch"], row["batch"]), pc.equal(counted["n"], n))).sort_by("bucket")
                seen = np.zeros(len(since), np.int64)
                seen[there] = np.concatenate([np.zeros(0, np.uint64), *map(unpack, own["counts"].to_pylist())])[which]
                if n == 1:
                    log = np.log(np.maximum(seen, 1) / max(1, total))
                else:
                    hit = np.nonzero(seen >= min_count)[0]
                    log[hit] = np.log(seen[hit] / shorter[hit - 1])  # the shorter n-gram ends one word before
                    level[hit] = n
                shorter = seen
            log += (longest - level) * np.log(backoff)
            doc = np.repeat(np.arange(len(size)), size)
            ids += row["ids"]
            for column, values in zip(out, (size, np.bincount(doc, weights=log, minlength=len(size)), *(np.bincount(doc[level == n], minlength=len(size)) for n in range(1, order + 1)))):
                column.append(values)
        columns = [np.concatenate([np.zeros(0), *c]) for c in out]
        values = {name: pa.array(c if name == "log_score" else c.astype(np.int64)) for name, c in zip(names, columns)}
        return pa.table({"id": pa.array(ids, docs.schema.field("ids").type.value_type), **values})

    return run


def _batches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = T.StructType([T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("words", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("lens", "vocab", "tokens"))])
    return bucketed(rows.mapInArrow(_batch, packed), "lm_batches", "batch")


def _grams(batches: DataFrame, order: int, buckets: int) -> DataFrame:
    return batches.select("batch", "lens", "vocab", "tokens").mapInArrow(_explode(order, buckets), "batch long, n int, bucket int, hashes binary, times binary")


def fit(df: DataFrame, text_col: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, bucket_ngrams: int = BUCKET_NGRAMS) -> DataFrame:
    """The count tables of a corpus: n, bucket (of buckets), hash (in the bucket) and seen of each n-gram.

    A row with n = 0 has the number of words as seen. An empty table, or one without words, gives that row alone, with 0.
    """
    batches = _batches(df.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text")
    total = batches.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_ngrams))
    ddl = "n int, bucket int, buckets int, hash long, seen long"
    words = df.sparkSession.createDataFrame([(0, 0, buckets, 0, total)], ddl)
    return _grams(batches, order, buckets).groupBy("n", "bucket").applyInArrow(_tabled(min_count, buckets), ddl).unionByName(words)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF, bucket_ngrams: int = BUCKET_NGRAMS, tables: DataFrame | None = None) -> DataFrame:
    """Per row: id_col, n_words, log_score (natural logarithm, summed over words), and n_order1.. (words scored there).

    A word's score is the relative frequency of the longest n-gram that ends in it and that the tables have, times
    backoff for every order given up; the tables are those of all rows of df, or those given (of fit, with the same order
    and min_count), where a word that they lack counts as seen once. A null or wordless text has n_words 0 and log_score
    0. Repeated rows are texts of their own; an empty table gives no rows; other columns are not read. A very long text
    is a batch of its own, held by one task at a time.
    """
    batches = _batches(df, id_col, text_col)
    if tables is None:
        total = batches.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        grams = _grams(batches, order, max(1, -(-total // bucket_ngrams)))
        counts = grams.groupBy("n", "bucket").applyInArrow(_count, "batch long, n int, bucket int, counts binary")
    else:
        one = tables.filter("n = 0").first()
        total, known = one["seen"], tables.filter("n > 0").select("n", "bucket", "hash", "seen")
        grams = _grams(batches, order, one["buckets"])
        counts = grams.groupBy("n", "bucket").cogroup(known.groupBy("n", "bucket")).applyInArrow(_look_up, "batch long, n int, bucket int, counts binary")
    kind = df.schema[id_col].dataType
    result = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), *(T.StructField(f"n_order{n}", T.LongType()) for n in range(1, order + 1))])
    scored = batches.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(_score(order, total, min_count, backoff), result)
    return scored.withColumnRenamed("id", id_col)

"""Packing by concatenation: documents become one stream of tokens that fixed windows cut.

The stream's order is that of the scan: tasks, then rows within a task. The first pass tokenises each document once and
writes its ids with its place inside its task; totals per task, prefix-summed, give each task's first token; the second
pass cuts documents at window boundaries without moving any row. All windows but the last are full.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, table

WINDOW = 2048
END_ID = 1
SPECIAL = "<|endoftext|>"
#: One row of 16 bytes per task of the scan; beyond this many tasks the totals are joined instead of broadcast.
BROADCAST_TASKS = 1_000_000
#: Characters encoded at once. A longer text is cut where a word ends and a space and a letter follow, which no word spans.
LONG = 1 << 19
#: Runs of equal bytes up to which a word beyond LONG is merged run by run.
MANY_RUNS = 10_000
_CUT = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z])")


class Coder:
    """A byte-level BPE from a rank file; the special token takes the id after the last rank."""

    def __init__(self, ranks_path: str, pattern: str, special: str = SPECIAL):
        import tiktoken

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.special, self.special_id = pattern, special, max(self.ranks.values()) + 1
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={special: self.special_id})

    @property
    def size(self) -> int:
        return self.fast.n_vocab

    def token_bytes(self, k: int) -> bytes:
        return self.fast.decode_single_token_bytes(k)

    def encode(self, text: str, special: bool = True) -> np.ndarray:
        """Ids of a text of any length; special says whether the special token's text stands for its id."""
        one = (lambda t: self.fast.encode(t, allowed_special="all")) if special else self.fast.encode_ordinary
        if len(text) <= LONG:
            return np.array(one(text), np.uint32)
        out = []
        for piece in self._pieces(text):
            if len(piece) <= LONG:
                out.append(np.array(one(piece), np.uint32))
                continue
            parts = piece.split(self.special) if special else [piece]
            for k, part in enumerate(parts):
                out += [np.array([self.special_id], np.uint32)] * (k > 0) + self._words(part)
        return np.concatenate(out)

    @staticmethod
    def _pieces(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > LONG:
            found = None
            for begin in (at + LONG - LONG // 64, at + LONG // 2, at + LONG):  # just before LONG, before it, or wherever it can be
                found = _CUT.search(text, begin, at + LONG if begin < at + LONG else len(text))
                if found:
                    break
            if not found:
                break
            yield text[at : found.end()]
            at = found.end()
        yield text[at:]

    def _words(self, text: str) -> list[np.ndarray]:
        """The same for a text with words so long that the library's splitter or merging cannot take them."""
        import regex

        out = []
        for word in regex.finditer(self.pattern, text):
            data = word[0].encode()
            runs = [(bytes([b]), sum(1 for _ in g)) for b, g in groupby(data)] if len(data) > LONG and len(set(data)) < 8 else []
            if runs and len(runs) <= MANY_RUNS:
                out.append(self._merge_runs(runs))
            else:
                out.append(np.array(self.fast._encode_single_piece(data), np.uint32))
        return out

    def _merge_runs(self, runs: list[tuple[bytes, int]]) -> np.ndarray:
        """A word of few runs of equal bytes: the pair of lowest rank is merged, everywhere, until no pair has a rank."""
        while True:
            pairs = {t + t for t, n in runs if n > 1} | {a + b for (a, _), (b, _) in zip(runs, runs[1:])}
            best = min((p for p in pairs if p in self.ranks), key=self.ranks.__getitem__, default=None)
            if best is None:
                return np.concatenate([np.full(n, self.ranks[t], np.uint32) for t, n in runs])
            made: list[tuple[bytes, int]] = []

            def put(token: bytes, n: int) -> None:
                if n and made and made[-1][0] == token:
                    made[-1] = (token, made[-1][1] + n)
                elif n:
                    made.append((token, n))

            for token, n in runs:
                if made and made[-1][0] != token and made[-1][0] + token == best:
                    last, m = made.pop()
                    put(last, m - 1)
                    put(best, 1)
                    n -= 1
                if token + token == best:
                    put(best, n // 2)
                    n %= 2
                put(token, n)
            runs = made


@lru_cache(2)
def byte_bpe(ranks_path: str, pattern: str, special: str = SPECIAL) -> Coder:
    return Coder(ranks_path, pattern, special)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _encode(ranks: tuple[str, str], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, start = byte_bpe(*ranks), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, starts, counts = [], [], []
            for text in batch["text"].to_pylist():
                one = np.append(coder.encode(text or ""), np.uint32(end_id))
                ids.append(one.astype("<u2" if coder.size <= 65536 else "<u4").tobytes())
                starts.append(start)
                counts.append(len(one))
                start += len(one)
            yield pa.record_batch([batch["id"], pa.array([task] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["id", "task", "task_start", "doc_tokens", "ids"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            source, begin, size, cut = [], [], [], []
            first = batch["first"].to_numpy()
            counts = batch["doc_tokens"].to_numpy()
            for k, blob in enumerate(batch["ids"].to_pylist()):
                n, at, g = int(counts[k]), 0, int(first[k])
                words = np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")
                while at < n:
                    step = min(n - at, window - (g + at) % window)
                    source.append(k)
                    begin.append(at)
                    size.append(step)
                    cut.append(words[at : at + step].tobytes())
                    at += step
            where = pa.array(source, pa.int32())
            start = np.array(begin, np.int64)
            place = first[np.array(source, np.int64)] + start
            columns = [batch["id"].take(where), start, np.array(size, np.int64), counts[np.array(source, np.int64)], place // window, place % window, pa.array(cut, pa.binary())]
            yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, ranks: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: id_col, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A null or empty text has only end_id. Repeated rows are packed each; an empty table gives no pieces; other columns
    are not read. Ids are those of the byte-level BPE in ranks (a rank file and its splitting pattern). A text of any
    length is one document: it is encoded in parts, and its pieces fill as many sequences as they need.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    coded = table(rows.mapInArrow(_encode(ranks or default_ranks(), end_id), f"id {kind}, task long, task_start long, doc_tokens long, ids binary"), "packing-ids")
    totals = coded.groupBy("task").agg(F.max(F.col("task_start") + F.col("doc_tokens")).alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the scan
    bases = table(totals.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-bases")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_TASKS else bases
    placed = coded.join(bases, "task").select("id", (F.col("base") + F.col("task_start")).alias("first"), "doc_tokens", "ids")
    pieces = placed.mapInArrow(_cut(window), f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces.withColumnRenamed("id", id_col)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

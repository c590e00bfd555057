"""Token counts of parts of a document by offset mapping.

A document is encoded once, as a whole; the tokens' spans are joined to the spans of its parts (fields, or sections of a
text), and a token that crosses a boundary is allocated by an explicit rule. Byte-level BPE tokens spell out their bytes,
so spans are running sums of token lengths, and both sides are in order: the interval join is a merge inside the task
that holds the document, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .packing import byte_bpe, default_ranks

#: Who gets a token that crosses boundaries: the part of its first byte, of its last byte, the part with most of its
#: bytes (ties: the earliest), or all its parts in proportion to bytes.
RULES = ("first", "last", "largest", "split")


def allocate(sizes: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per part, and tokens that cross into or out of it, given token sizes and the parts' ends in bytes.

    Parts are contiguous from byte 0; an empty part gets nothing.
    """
    n = len(ends)
    stop = np.cumsum(sizes)
    start = stop - sizes
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, stop - 1, "right")
    whole = first == last
    got = np.bincount(first[whole], minlength=n).astype(float)
    s, e, a, b = start[~whole], stop[~whole], first[~whole], last[~whole]
    if not len(s):
        return got, np.zeros(n, np.int64)
    many = b - a + 1  # a row for each crossing token and part from its first to its last
    head = np.cumsum(many) - many
    token = np.repeat(np.arange(len(s)), many)
    part = np.arange(many.sum()) - head[token] + a[token]
    share = np.minimum(ends[part], e[token]) - np.maximum(np.concatenate(([0], ends))[part], s[token])
    crossing = np.bincount(part[share > 0], minlength=n)
    if rule == "first":
        got += np.bincount(a, minlength=n)
    elif rule == "last":
        got += np.bincount(b, minlength=n)
    elif rule == "largest":
        most = np.nonzero(share == np.maximum.reduceat(share, head)[token])[0]
        got += np.bincount(part[most[np.unique(token[most], return_index=True)[1]]], minlength=n)
    else:
        got += np.bincount(part, weights=share / (e - s)[token], minlength=n)
    return got, crossing


#: Parts in one Arrow batch of results.
OUTPUT_ROWS = 1 << 16


def _batches(ranks: tuple[str, str], rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(*ranks)
        sizes = np.array([len(coder.token_bytes(k)) for k in range(coder.size)], np.int64)
        held: list[list[np.ndarray]] = []

        def full(ids: pa.Array) -> pa.RecordBatch:
            of, *columns = (np.concatenate(c) for c in zip(*held))
            held.clear()
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            return pa.record_batch([ids.take(pa.array(of)), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "part", "start_byte", "end_byte", "n_tokens", "n_crossing", "doc_tokens"])

        for batch in slices(batches):
            rows = 0
            for row in range(batch.num_rows):
                lengths = batch["lengths"][row].values
                if lengths is None or not len(lengths):
                    continue
                lengths = lengths.to_numpy()
                ids = coder.encode(batch["text"][row].as_py() or "", special=False)
                ends = np.cumsum(lengths)
                got, crossed = allocate(sizes[ids], ends, rule)
                for at in range(0, len(ends), OUTPUT_ROWS):
                    own = slice(at, at + OUTPUT_ROWS)
                    n = len(ends[own])
                    held.append([np.full(n, row, np.int32), np.arange(at, at + n), (ends - lengths)[own], ends[own], got[own], crossed[own], np.full(n, len(ids))])
                    rows += n
                    if rows >= OUTPUT_ROWS:
                        yield full(batch["id"])
                        rows = 0
            if held:
                yield full(batch["id"])

    return run


_SCHEMA = "part int, start_byte long, end_byte long, n_tokens double, n_crossing long, doc_tokens long"


def _count(rows: DataFrame, kind: str, rule: str, ranks: tuple[str, str] | None) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    return rows.mapInArrow(_batches(ranks or default_ranks(), rule), f"id {kind}, {_SCHEMA}")


def _bytes(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.octet_length(x).cast("long"))


def count_sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", rule: str = "first", ranks: tuple[str, str] | None = None) -> DataFrame:
    """One row per section of each text: id_col, part (from 0), start_byte, end_byte, n_tokens, n_crossing, doc_tokens.

    A section is a stretch between separators, with the separator that ends it. A null or empty text is one empty
    section with no tokens. Special tokens written out in a text are ordinary text. Repeated rows give repeated results,
    an empty table no rows; other columns are not read. A text of any length is one document, and its sections, however
    many, leave the task in batches of OUTPUT_ROWS.
    """
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    last = F.size("pieces") - 1
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("pieces", F.split("text", _literal(separator), -1))
    gap = len(separator.encode())
    rows = rows.select("id", "text", F.transform("pieces", lambda x, i: F.octet_length(x).cast("long") + F.when(i < last, F.lit(gap)).otherwise(F.lit(0))).alias("lengths"))
    return _count(rows, kind, rule, ranks).withColumnRenamed("id", id_col)


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def count_fields(df: DataFrame, id_col: str, fields: list[str], joiner: str = "\n", rule: str = "first", ranks: tuple[str, str] | None = None) -> DataFrame:
    """The same for fields of a row, encoded as one text: each field but the last is followed by joiner, which counts as
    part of it. A null field counts as empty. The column `field` names the part."""
    kind = df.schema[id_col].dataType.simpleString()
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    parts = F.array(*(F.concat(v, F.lit(joiner)) for v in values[:-1]), values[-1])
    rows = df.select(F.col(id_col).alias("id"), parts.alias("parts")).select("id", F.array_join("parts", "").alias("text"), _bytes(F.col("parts")).alias("lengths"))
    names = F.array(*(F.lit(f) for f in fields))
    return _count(rows, kind, rule, ranks).withColumn("field", F.element_at(names, F.col("part") + 1)).withColumnRenamed("id", id_col)

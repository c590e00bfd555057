"""Alignment of two tokenizers by byte intervals, and how many documents of a corpus link each pair of their tokens.

White space that follows anything else begins a unit, and is a certain cut in both tokenizers: A's splitter spans no such
place, nor does a piece of B (white space that some piece of its vocabulary has after another sign begins no unit). So a text is a row of units, each distinct unit is
encoded and aligned once, and a document's groups, links and pairs are those of its units. New units of a slice of
documents are laid end to end and aligned by DuckDB inside the task: interval tables of the tokens, an as-of join for the
B token under the first byte of an A token, a range join for the B tokens that begin inside it, and window sums of common
ends for the groups. Documents' pairs are a join of their units with the units' pairs.

Documents are counted per pair within a batch in the task; Spark merges the counts, and each batch gets back the counts of
its own pairs, so that nothing but distinct pairs per batch is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, few, slices, table
from .packing import byte_bpe, default_ranks

#: Units remembered per Python worker; beyond, all are forgotten between two pieces of text, which changes no result.
MEMORY = 300_000
#: Characters of text whose new units are aligned at once.
LEARNT = 1 << 20
#: Bytes of text whose documents' pairs are counted together and get their counts back together.
BATCH_BYTES = 12 << 20
#: White space as A's splitter sees it, and all that is not; \x1c to \x1f are no white space there.
_WHITE, _OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
_PLAIN = re.compile(r"[^\s\x1c-\x1f]").fullmatch
_BYTE = re.compile("<0x([0-9A-F]{2})>")
_SPACE = "▁"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """B: a sentencepiece model that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = [self._bytes(self.model.id_to_piece(k)) for k in range(self.size)]
        plain = [self.model.id_to_piece(k).replace(_SPACE, " ") for k in range(self.size) if not self.model.is_byte(k)]
        glued = {w for p in plain for w in re.findall(r"(?<=\S)\s|(?<= )[^\S ]", p)}
        if " " in glued:
            raise ValueError("a piece spans the space between two words")
        more = f"(?:[{re.escape(''.join(glued))}]{_WHITE}*{_OTHER}*)*" if glued else ""
        self.units = re.compile(f"{_WHITE}*{_OTHER}+{more}|{_WHITE}+")

    @staticmethod
    def _bytes(piece: str) -> bytes:
        found = _BYTE.fullmatch(piece)
        return bytes([int(found[1], 16)]) if found else piece.replace(_SPACE, " ").encode()

    def encode(self, unit: str) -> list[int]:
        """Ids of a unit; where it begins with no space, the one that the model puts before it is a piece of its own."""
        if unit == " ":  # the model puts no space before nothing
            return [self.model.piece_to_id(_SPACE)]
        return self.model.encode(unit[1:], num_threads=1) if unit[0] == " " else self.model.encode(unit, num_threads=1)[1:]


_PAIRS = """
SELECT u, a * $size + b AS code, count(*) AS n FROM (
    SELECT a.u, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.s >= b.s
    UNION ALL SELECT a.u, a.id, b.id FROM a JOIN b ON b.s > a.s AND b.s < a.e) GROUP BY ALL"""
#: The last token of each side of every group; the window sum of tokens numbers the groups.
_GROUPS = """
SELECT sum(1) OVER (ORDER BY a.k ROWS UNBOUNDED PRECEDING) AS g, a.k AS ka, b.k AS kb FROM a JOIN b USING (e) ORDER BY ka"""
_DOCUMENTS = """
SELECT doc, code, sum(n * times) AS n FROM (SELECT doc, u, count(*) AS times FROM seen GROUP BY ALL) JOIN pairs USING (u)
GROUP BY ALL ORDER BY doc, code"""


class Aligner:
    """Units met so far, and per unit its groups as text, its counts and its linked pairs."""

    def __init__(self, ranks: tuple[str, str], pieces: str):
        self.a, self.b = byte_bpe(*ranks), Pieces(pieces)
        self.sizes_a = np.array([len(self.a.token_bytes(k)) for k in range(self.a.size)], np.int64)
        self.sizes_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.text: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links; all 0 for a unit that B does not keep
        self.db.execute("CREATE OR REPLACE TEMP TABLE pairs (u INT, code BIGINT, n BIGINT)")

    def learn(self, new: list[str]) -> None:
        """Align units not met before, all at once.

        Units that do not end in white space are laid end to end and encoded as one text, as their ends are certain
        cuts; the others are encoded one by one.
        """
        first = len(self.units)
        self.units.update(zip(new, range(first, first + len(new))))
        plain = [k for k, unit in enumerate(new) if _PLAIN(unit[-1])]
        rest = [k for k, unit in enumerate(new) if not _PLAIN(unit[-1])]
        ids_a, ids_b, of_a, of_b = [], [], [], []

        def encode(own: list[int]) -> bool:
            """Whether B's tokens spell out these units; if so, their ids are kept."""
            joined = "".join(map(new.__getitem__, own))
            b = self.b.encode(joined)
            if b"".join(map(self.b.bytes.__getitem__, b)) != joined.encode():
                return False
            stops = np.cumsum([len(new[k].encode()) for k in own])
            for ids, sizes, all_ids, all_of in ((self.a.encode(joined, special=False), self.sizes_a, ids_a, of_a), (b, self.sizes_b, ids_b, of_b)):
                all_ids.append(np.asarray(ids, np.int64))
                all_of.append(np.array(own)[np.searchsorted(stops, np.cumsum(sizes[all_ids[-1]]))])
            return True

        if plain and not encode(plain):
            rest += plain
        for k in rest:
            encode([k])
        texts, counts = [""] * len(new), np.zeros((len(new), 4), np.int64)
        if ids_a:
            sides = []
            for name, ids, of, sizes in (("a", ids_a, of_a, self.sizes_a), ("b", ids_b, of_b, self.sizes_b)):
                whole, of = np.concatenate(ids), np.concatenate(of)
                ends = np.cumsum(sizes[whole])
                self.db.register(f"new_{name}", pa.table({"k": np.arange(len(whole)), "u": of + first, "id": whole, "s": ends - sizes[whole], "e": ends}))
                self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM new_{name}")
                sides.append((of, whole))
            self.db.execute(f"INSERT INTO pairs {_PAIRS}", {"size": self.b.size})
            cuts = self.db.execute(_GROUPS).fetchnumpy()
            groups = [np.searchsorted(cuts[k], np.arange(len(of))) for k, (of, _) in zip(("ka", "kb"), sides)]
            for unit, text in self._said(sides, groups):
                texts[unit] = text
            per_unit = (sides[0][0], sides[1][0], sides[0][0][cuts["ka"]])
            for column, of in enumerate(per_unit):
                counts[:, column] = np.bincount(of, minlength=len(new))
            links = self.db.execute("SELECT u, sum(n) AS n FROM pairs WHERE u >= $first GROUP BY u", {"first": first}).fetchnumpy()
            counts[links["u"] - first, 3] = links["n"]
        self.text += texts
        self.counts = np.concatenate((self.counts, counts))

    @staticmethod
    def _said(sides: list[tuple[np.ndarray, np.ndarray]], groups: list[np.ndarray]) -> Iterator[tuple[int, str]]:
        """Per unit its groups: ids of A, a bar, ids of B; groups parted by semicolons."""
        unit, ids, g = (np.concatenate(x) for x in (*zip(*sides), groups))
        side = np.repeat((0, 1), [len(x) for x in groups])
        order = np.argsort(2 * g + side, kind="stable")
        unit, side, g = unit[order], side[order], g[order]
        fresh = np.concatenate(([True], (np.diff(g) > 0) | (np.diff(side) > 0)))
        mark = np.where(fresh, np.where(side == 0, ";", "|"), ",")
        said = list(map("".join, zip(mark.tolist(), map(str, ids[order].tolist()))))
        starts = np.flatnonzero(np.concatenate(([True], np.diff(unit) != 0))).tolist()
        for at, to in zip(starts, [*starts[1:], len(said)]):
            yield int(unit[at]), "".join(said[at:to])[1:]

    def pairs(self, seen: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links) of documents with the numbers of their units, in this order."""
        self.db.register("seen", pa.table({"doc": np.repeat([d for d, _ in seen], [len(x) for _, x in seen]).astype(np.int64), "u": np.concatenate([x for _, x in seen])}))
        found = self.db.execute(_DOCUMENTS).fetchnumpy()
        return found["doc"], found["code"], found["n"].astype(np.int64)


@lru_cache(2)
def aligner(ranks: tuple[str, str], pieces: str) -> Aligner:
    return Aligner(ranks, pieces)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of (document, pair, links) as one, in the order of document and pair."""
    if len(parts) == 1:
        return parts[0]
    doc, code, n = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((code, doc))
    doc, code, n = doc[order], code[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(code) != 0))))[: len(doc)]
    return doc[first], code[first], np.add.reduceat(n, first) if len(n) else n


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_LISTS = "codes array<long>, n array<long>"


def _aligned(ranks: tuple[str, str], pieces: str, digest: bool):
    """Rows of documents, with their pairs, and after each batch a row with its pairs and their documents."""

    def of_slice(work: Aligner, texts: list[str | None]):
        rows = len(texts)
        counts, broken, parts, seen = np.zeros((rows, 4), np.int64), np.zeros(rows, bool), [], []
        groups: list[list[str]] = [[] for _ in texts]
        shas = [hashlib.sha256() for _ in texts]

        def settle(waiting: list[tuple[int, list[str]]]) -> None:
            """Learn what is new in these pieces of documents at once, and add them to their documents."""
            if len(work.units) > MEMORY:
                if seen:
                    parts.append(work.pairs(seen))
                    seen.clear()
                work.forget()
            work.learn(list(dict.fromkeys(u for _, found in waiting for u in found if u not in work.units)))
            for doc, found in waiting:
                units = np.array(list(map(work.units.__getitem__, found)), np.int64)
                own = work.counts[units]
                broken[doc] |= not own[:, 0].all()
                now = ";".join(map(work.text.__getitem__, units.tolist()))
                if digest:
                    shas[doc].update((";" * bool(counts[doc, 0]) + now).encode())
                else:
                    groups[doc].append(now)
                counts[doc] += own.sum(0)
                seen.append((doc, units))

        waiting, size = [], 0
        for doc, text in enumerate(texts):
            for piece in work.a._pieces(" " + text) if text and _SPACE not in text else ():
                waiting.append((doc, work.b.units.findall(piece)))
                size += len(piece)
                if size >= LEARNT:
                    settle(waiting)
                    waiting, size = [], 0
        settle(waiting)
        if seen:
            parts.append(work.pairs(seen))
        counts[broken] = 0
        said = ["" if not counts[k, 0] else shas[k].hexdigest() if digest else ";".join(groups[k]) for k in range(rows)]
        doc, code, n = _merged(parts) if parts else (np.zeros(0, np.int64),) * 3
        kept = ~broken[doc]
        return counts, said, doc[kept], code[kept], n[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, task, size, number, held = aligner(ranks, pieces), TaskContext.get().partitionId(), 0, 0, []
        kind = None

        def packed(ids: pa.Array, counts: np.ndarray, groups: list, offsets: np.ndarray, code: np.ndarray, n: np.ndarray, counted: bool) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int64())) for x in (code, n)]
            rows = len(ids)
            key = pa.array([(task << 24) + number] * rows, pa.int64())
            return pa.record_batch([key, pa.array([counted] * rows), ids, *(pa.array(c) for c in counts.T), pa.array(groups, pa.string()), *lists], ["batch", "counted", "id", *_COUNTS, "groups", "codes", "n"])

        def ended() -> pa.RecordBatch:
            codes, docs = np.unique(np.concatenate(held), return_counts=True)
            return packed(pa.nulls(1, kind), np.zeros((1, 4), np.int64), [None], np.array([0, len(codes)]), codes, docs, True)

        for batch in slices(batches):
            kind = batch["id"].type
            texts = batch["text"].to_pylist()
            counts, groups, doc, code, n = of_slice(work, texts)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))
            yield packed(batch["id"], counts, groups, offsets, code, n, False)
            held.append(code)
            size += sum(len(t or "") for t in texts)
            if size >= BATCH_BYTES:
                yield ended()
                held, size, number = [], 0, number + 1
        if held:
            yield ended()

    return run


def _with_counts(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of a batch with the counts of its pairs looked up and summed."""
    order = np.argsort(counts["code"].to_numpy())
    code, docs_of, best = (counts[c].to_numpy(zero_copy_only=False)[order] for c in ("code", "n_docs", "best"))
    lists = docs["codes"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(docs)), sizes)
    at = np.searchsorted(code, lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()])
    held = docs["n"].combine_chunks()
    n = held.values.to_numpy()[held.offsets[0].as_py() : held.offsets[-1].as_py()]
    total = np.zeros(len(docs), np.int64)
    winners = np.zeros(len(docs), np.int64)
    if len(n):
        np.add.at(total, owner, n * docs_of[at])
        np.add.at(winners, owner, n * best[at])
    return pa.table({"id": docs["id"], **{c: docs[c] for c in _COUNTS}, "n_best": winners, "count_sum": total, "groups": docs["groups"]})


def _reply(docs: pa.Table, counts: pa.Table) -> pa.Table:
    return _with_counts(docs.combine_chunks(), counts.combine_chunks())


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: tuple[str, str] | None = None, pieces: str | None = None, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). Documents: id_col, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair is the most
    frequent of its A token, ties included), count_sum (over links, the documents of their pair) and groups, as text
    `a1,a2|b1;a3|b2,b3` or, with digest, as its SHA-256. Pairs: a, b, n_docs and best, over the whole table.

    A row counts as one document, repeated rows each. A null or empty text, and one that B's tokens do not spell byte for
    byte, has zeros and empty groups, and links nothing. Special tokens written out are plain text. Texts of any length are
    taken whole, in pieces; only a stretch without white space is held at once. An empty table gives no rows; other columns
    are not read.
    """
    ranks, pieces = ranks or default_ranks(), pieces or default_pieces()
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([*T.StructType.fromDDL("batch long, counted boolean").fields, T.StructField("id", kind), *T.StructType.fromDDL(f"{', '.join(f'{c} long' for c in _COUNTS)}, groups string, {_LISTS}").fields])
    aligned = bucketed(rows.mapInArrow(_aligned(ranks, pieces, digest), schema), "alignment", "batch")
    own = aligned.filter("counted").select("batch", F.explode(F.arrays_zip("codes", "n")).alias("pair")).select("batch", F.col("pair.codes").alias("code"), F.col("pair.n").alias("n"))
    b_size = Pieces(pieces).size
    merged = own.groupBy("code").agg(F.sum("n").alias("n_docs")).withColumns({"a": F.floor(F.col("code") / b_size), "b": F.col("code") % b_size})
    merged = table(merged, "alignment-counts")
    highest = merged.groupBy("a").agg(F.max("n_docs").alias("most"))
    pairs = merged.join(few(highest), "a").select("code", "a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    pairs = table(pairs, "alignment-pairs")
    back = own.select(F.col("batch").alias("to"), "code").join(few(pairs.select("code", "n_docs", "best")), "code")
    result = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL(f"{', '.join(f'{c} long' for c in _COUNTS)}, n_best long, count_sum long, groups string").fields])
    found = aligned.filter("NOT counted").groupBy("batch").cogroup(back.groupBy("to")).applyInArrow(_reply, result)
    return found.withColumnRenamed("id", id_col), pairs.drop("code")

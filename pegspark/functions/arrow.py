"""Arrow functions over the matcher. A grammar is compiled once per Python worker; inputs come in Arrow batches."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from ..plans import matcher as m
from . import text as drawn

NODES = "array<struct<id:int,parent:int,depth:int,rule:string,start:int,end:int,text:string>>"
EXTRACTS = "array<struct<rule:string,start:int,end:int,text:string>>"
#: Bytes of node texts of one tree; beyond, a node with children has no text, only its place (a deep tree would hold its
#: input once a level).
TREE_TEXT = 16 << 20
RESULT = f"matched boolean, consumed int, nodes {NODES}, extracts {EXTRACTS}, offset int, line int, column int, expected array<string>, found string, rule_stack array<string>"


@dataclass(frozen=True)
class Key:
    """A grammar as it travels to executors."""

    source: str
    modules: tuple[tuple[str, str], ...]


@lru_cache(64)
def _matcher(key: Key) -> m.Matcher:
    from .grammar import compiled

    return m.Matcher(compiled(key.source, key.modules))


def _data(value) -> bytes:
    return bytes(value) if isinstance(value, (bytes, bytearray, memoryview)) else value.encode()


def _said(data: bytes, start: int, end: int) -> str:
    return data[start:end].decode("utf-8", "replace")


def flat(nodes, data: bytes, shift: int = 0) -> list[dict]:
    """A tree in pre-order; parent is a node's place in the list, -1 for a root."""
    out, inner, held, todo = [], [], 0, [(n, -1, 0) for n in reversed(nodes)]
    while todo:
        (rule, start, end, children), parent, depth = todo.pop()
        own = len(out)
        held += end - start if children else 0
        if children:
            inner.append(own)
        text = _said(data, start, end) if not children or held <= TREE_TEXT else None
        out.append({"id": own, "parent": parent, "depth": depth, "rule": rule, "start": start + shift, "end": end + shift, "text": text})
        todo += [(c, own, depth + 1) for c in reversed(children)]
    if held > TREE_TEXT:
        for own in inner:
            out[own]["text"] = None
    return out


def _udf(kind: str, one):
    """An Arrow-batched function of one value, null for null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else one(v) for v in values], dtype=object)

    return run


def _result(key: Key, partial: bool):
    names = [part.split()[0] for part in RESULT.replace(NODES, "x").replace(EXTRACTS, "x").split(", ")]

    def one(value) -> dict:
        data = _data(value)
        got = dict.fromkeys(names) | m.whole(_matcher(key), data)
        if not got["matched"] and not partial:
            got |= {"nodes": None, "extracts": None}
        for column, make in (("nodes", lambda x: flat(x, data)), ("extracts", lambda x: [{"rule": r, "start": a, "end": b, "text": _said(data, a, b)} for r, a, b, _ in x])):
            got[column] = None if got[column] is None else make(got[column])
        return got

    return one


def match(key: Key, partial: bool = False):
    one = _result(key, partial)

    @F.pandas_udf(RESULT)
    def run(values: pd.Series) -> pd.DataFrame:
        empty = None
        rows = [empty if v is None else one(v) for v in values]
        names = list(rows[next((k for k, r in enumerate(rows) if r), 0)] or one(b""))
        return pd.DataFrame({n: pd.Series([None if r is None else r[n] for r in rows], dtype=object) for n in names})

    return lambda col: F.when(col.isNotNull(), run(col))


@lru_cache(64)
def _whole(key: Key) -> re.Pattern | None:
    """The grammar as an expression over bytes for whole texts, where it is regular."""
    from ..plans import lowering
    from .grammar import compiled

    try:
        return re.compile(rf"(?:{lowering.lower(compiled(key.source, key.modules), True)[0]})\Z".encode("latin-1"))
    except lowering.NotRegular:
        return None


def accepts_one(key: Key, value: str | bytes) -> bool:
    """Whether a whole text matches, by the expression where there is one, else by the matcher."""
    found = _whole(key)
    return found.match(_data(value)) is not None if found is not None else m.accepts(_matcher(key), _data(value))


def accepts(key: Key):
    return _udf("boolean", lambda value: m.accepts(_matcher(key), _data(value)))


def accepts_each(key: Key):
    def each(values) -> list:
        return [None if v is None else m.accepts(_matcher(key), _data(v)) for v in values]

    return _udf("array<boolean>", each)


def prefix(key: Key):
    return _udf("int", lambda value: m.prefix(_matcher(key), _data(value)))


def _units(data: bytes, unit: str):
    """A function from byte offsets, asked in rising order, to offsets in another unit."""
    if unit == "byte":
        return lambda at: at
    state = [0, 0]
    size = (lambda s: len(s)) if unit == "codepoint" else (lambda s: len(s.encode("utf-16-le")) // 2)

    def to(at: int) -> int:
        state[1] += size(data[state[0] : at].decode("utf-8", "ignore"))
        state[0] = at
        return state[1]

    return to


@lru_cache(64)
def _expression(key: Key) -> re.Pattern | None:
    """The grammar as an expression over bytes for Python, where it is regular and reads whole characters."""
    from ..plans import lowering
    from .grammar import compiled

    program = compiled(key.source, key.modules)
    try:
        found = None if lowering.needs_bytes(program) else lowering.lower(program, True)[0]
    except lowering.NotRegular:
        return None
    return None if found is None else re.compile(rf"(?![\x80-\xBF])(?:{found})".encode("latin-1"))


def spans(key: Key, data: bytes) -> list[tuple[int, int]]:
    """Places of all hits in bytes, by the expression where there is one, else by the matcher."""
    found = _expression(key)
    if found is not None:
        return [h.span() for h in found.finditer(data) if h.end() > h.start()]
    return [h[:2] for h in m.hits(_matcher(key), data)]


def find_one(key: Key, text: str | bytes, unit: str = "codepoint") -> list[dict]:
    data = _data(text)
    to = _units(data, unit)
    return [{"start": to(a), "end": to(b), "text": _said(data, a, b)} for a, b in spans(key, data)]


def find(key: Key, tree: bool, unit: str):
    if unit not in ("codepoint", "utf16", "byte"):
        raise ValueError("unit must be codepoint, utf16 or byte")
    kind = f"array<struct<start:int,end:int,text:string{',nodes:' + NODES if tree else ''}>>"

    def with_trees(value) -> list:
        data = _data(value)
        to = _units(data, unit)
        return [{"start": to(a), "end": to(b), "text": _said(data, a, b), "nodes": flat(nodes, data)} for a, b, nodes, _ in m.hits(_matcher(key), data)]

    return _udf(kind, with_trees if tree else lambda value: find_one(key, value, unit))


def texts(key: Key):
    return _udf("array<string>", lambda value: [h["text"] for h in find_one(key, value)])


def count(key: Key):
    return _udf("bigint", lambda value: len(spans(key, _data(value))))


def scan_bytes(key: Key):
    return _udf("array<struct<start:int,end:int>>", lambda v: [{"start": h[0], "end": h[1]} for h in m.hits(_matcher(key), _data(v), every_byte=True)])


def replace(key: Key, before: str, after: str, with_text: str | None):
    def one(value) -> str:
        data = _data(value)
        out, at = [], 0
        for start, end in spans(key, data):
            out += [data[at:start], (before + _said(data, start, end) + after if with_text is None else with_text).encode()]
            at = end
        return b"".join([*out, data[at:]]).decode("utf-8", "replace")

    return _udf("string", one)


def diagnose(key: Key):
    def one(value):
        data = _data(value)
        got = m.whole(_matcher(key), data)
        return None if got["matched"] else drawn.failure(got, data)

    return _udf("string", one)


def tree_text(key: Key):
    def one(value):
        data = _data(value)
        got = m.whole(_matcher(key), data)
        return drawn.tree(flat(got["nodes"], data)) if got["matched"] else None

    return _udf("string", one)

"""A compiled grammar and the columns it makes.

Acceptance, texts, counts, spans, replacement and static extracts are Catalyst expressions over a regular expression when
the grammar allows, those of a recursion through a pair of signs too; trees, repeated extracts, other recursion and reports
of failure run in an Arrow function on the executors. Null input gives null.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import cached_property, lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import analysis, envelope, lowering, matcher, shapes
from ..plans.syntax import Program, parse
from . import arrow, progress

VERSION = 1
_HITS = "array<struct<start:int,end:int,text:string>>"
#: Hits whose offsets are summed in one piece; appending to an array costs its length, so long lists go in pieces.
PIECE = 256


def _bind(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _utf16(text: Column) -> Column:
    """UTF-16 code units of a text: characters beyond U+FFFF have two."""
    return F.shiftright(F.octet_length(F.encode(text, "UTF-16BE")), 1)


def _spans(text: Column, pattern: str, with_text: bool, length=F.length) -> Column:
    """Offsets of all hits of a pattern that never matches nothing, in characters of text, or as length measures."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _placed(text, _bind(hits, lambda h: F.arrays_zip(F.slice(gaps, 1, F.size(h)).alias("gap"), h.alias("hit"))), with_text, length)


def _placed(text: Column, zipped: Column, with_text: bool, length) -> Column:
    """Offsets of the hits of a text, each given with the gap before it."""
    size = lambda p: length(p["gap"]) + length(p["hit"])
    kind = _HITS if with_text else "array<struct<start:int,end:int>>"

    def step(state: Column, p: Column) -> Column:
        start, end = state["at"] + length(p["gap"]), state["at"] + size(p)
        hit = F.struct(start.alias("start"), end.alias("end"), *([p["hit"].alias("text")] if with_text else []))
        return F.struct(end.alias("at"), F.concat(state["hits"], F.array(hit)).alias("hits"))

    def offsets(piece: Column, begin: Column) -> Column:
        return F.aggregate(piece, F.struct(begin.alias("at"), F.array().cast(kind).alias("hits")), step, lambda s: s["hits"])

    def in_pieces(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda q: F.aggregate(q, F.lit(0), lambda n, p: n + size(p)))
        begins = F.aggregate(totals, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return _bind(begins, lambda at: F.flatten(F.transform(pieces, lambda q, k: offsets(q, F.get(at, k)))))

    def whole(pairs: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / PIECE).cast("int")), lambda k: F.slice(pairs, k * PIECE + 1, PIECE))
        return F.when(F.size(pairs) <= PIECE, offsets(pairs, F.lit(0))).otherwise(_bind(pieces, in_pieces))

    return F.when(text.isNotNull(), _bind(zipped, whole))


def _from_bytes(hit: Column) -> Column:
    """A hit found in bytes as characters, with its text read as UTF-8."""
    return F.struct(hit["start"].alias("start"), hit["end"].alias("end"), F.decode(F.encode(hit["text"], "ISO-8859-1"), "UTF-8").alias("text"))


@lru_cache(256)
def compiled(source: str, modules: tuple[tuple[str, str], ...]) -> Program:
    return analysis.check(parse(source, dict(modules)))


class Grammar:
    """`Grammar(source)`; source is grammar text, modules the sources of the modules it uses."""

    def __init__(self, source: str, modules: Mapping[str, str] | None = None):
        self.source, self.modules = source, tuple(sorted((modules or {}).items()))
        self.program = compiled(self.source, self.modules)

    def to_bytes(self) -> bytes:
        """A portable form; from_bytes reads it in any session."""
        return json.dumps({"version": VERSION, "source": self.source, "modules": dict(self.modules)}).encode()

    @staticmethod
    def from_bytes(data: bytes) -> Grammar:
        found = json.loads(data)
        if found["version"] != VERSION:
            raise ValueError(f"cannot read version {found['version']}")
        return Grammar(found["source"], found["modules"])

    @property
    def key(self) -> arrow.Key:
        return arrow.Key(self.source, self.modules)

    # -- what regular expressions can do ------------------------------------------------------------------------------

    @property
    def native(self) -> bool:
        """Whether the grammar is one expression, so that acceptance runs inside the JVM."""
        try:
            lowering.lower(self.program)
        except lowering.NotRegular:
            return False
        return True

    @property
    def native_hits(self) -> bool:
        """Whether hits in a text are found inside the JVM: hits are never empty and start at code points."""
        return self.native and not lowering.can_be_empty(self.program) and not lowering.needs_bytes(self.program)

    def regex(self, as_bytes: bool | None = None) -> str:
        return lowering.lower(self.program, as_bytes)[0]

    def search_regex(self, as_bytes: bool = False) -> str:
        """The expression for a search by the JVM's engine, which tries no start that cannot be one."""
        return lowering.search_start(self.program, as_bytes) + self.regex(True if as_bytes else None)

    def _text(self, col: Column, as_bytes: bool) -> Column:
        """The text, or its bytes as characters below 0x100."""
        return F.decode(F.encode(col, "UTF-8"), "ISO-8859-1") if as_bytes else col

    def _needed(self, col: Column) -> Column | None:
        """A cheap condition that every text with a hit meets: it contains the rarest-looking literal."""
        found = analysis.literals(self.program)
        rare = max(found, key=lambda t: (len(t), not t.isalnum()), default=None)
        if rare is None or rare in (" ", "\n", "\t"):
            return None
        return F.contains(col, F.lit(rare))

    def _likely(self, col: Column, hit: bool) -> Column:
        """Whether a text can have a hit, or can match from its start: what the JVM asks before a grammar that it cannot run.

        True for a null text, so that null stays null.
        """
        asked = F.lit(True)
        begins, literal = envelope.beginning(self.program), envelope.rarest(self.program)
        if begins is not None and (hit or not lowering.can_be_empty(self.program)):
            asked &= col.rlike(begins if hit else rf"\A{begins}")
        if literal is not None:
            asked &= F.contains(col, F.lit(literal))
        return F.coalesce(asked, F.lit(True))

    def _of_likely(self, col: Column, hit: bool, run, otherwise: Column) -> Column:
        """run(col) for texts that may match; others, which are not sent to Python, give otherwise."""
        likely = self._likely(col, hit)
        return F.when(likely, run(F.when(likely, col))).otherwise(otherwise)

    @cached_property
    def pairs(self) -> shapes.Pairs | None:
        """The grammar as a run of opening signs, what is inside, and a run of closing signs, which the JVM compares."""
        return self._shape(shapes.pairs)

    def _paired(self, opened: Column, closed: Column) -> Column:
        """Of two runs of so many signs, how many belong together; as elsewhere, no more than DEEPEST rules within rules."""
        return F.least(opened, closed, F.lit(matcher.DEEPEST - self.pairs.levels))

    def is_match(self, col: Column) -> Column:
        """Whether the whole text matches."""
        if self.pairs is not None:
            opened, closed = (F.length(F.regexp_extract(col, rf"\A{self.pairs.start}\z", k)) for k in (1, 3))
            return (opened > 0) & (opened == closed) & (self._paired(opened, closed) == opened)
        if not self.native:
            return self._of_likely(col, False, arrow.accepts(self.key), F.lit(False))
        as_bytes = lowering.needs_bytes(self.program)
        return self._text(col, as_bytes).rlike(rf"\A(?:{self.regex()})\z")

    def has_hit(self, col: Column) -> Column:
        """Whether some part of the text matches (and is not empty)."""
        if self.pairs is not None:
            return col.rlike(self.pairs.innermost)
        if not self.native_hits:
            return F.size(self.find(col)) > 0
        hit, needed = col.rlike(self.search_regex()), self._needed(col)
        return hit if needed is None else needed & hit

    def prefix_length(self, col: Column) -> Column:
        """Bytes matched from the start of the text; -1 if its start does not match."""
        if self.pairs is not None:
            opened, inside, closed = (F.octet_length(F.regexp_extract(col, rf"\A{self.pairs.start}", k)) for k in (1, 2, 3))
            size = 2 * opened + (inside if self.pairs.inside else 0)
            return F.when((opened > 0) & (self._paired(opened, closed) == opened), size).when(col.isNotNull(), F.lit(-1))
        if not self.native:
            return self._of_likely(col, False, arrow.prefix(self.key), F.lit(-1))
        as_bytes = lowering.needs_bytes(self.program)
        text, start = self._text(col, as_bytes), rf"\A(?>{self.regex()})"
        size = F.length if as_bytes else F.octet_length
        return F.when(text.rlike(start), size(F.regexp_extract(text, start, 0))).when(col.isNotNull(), F.lit(-1))

    def texts(self, col: Column) -> Column:
        """All hits of a text, left to right without overlap, empty ones left out."""
        if not self.native or lowering.needs_bytes(self.program):
            return F.transform(self.find(col), lambda h: h["text"])
        if self.native_hits:
            found = F.regexp_extract_all(col, F.lit(self.search_regex()), F.lit(0))
        else:
            found = F.filter(F.regexp_extract_all(col, F.lit(self.regex()), F.lit(0)), lambda t: t != "")
        needed = self._needed(col)
        return found if needed is None else F.when(needed, found).when(col.isNotNull(), F.array().cast("array<string>"))

    def count(self, col: Column) -> Column:
        """Number of hits of a text."""
        if not self.native_hits:
            return F.size(self.texts(col)).cast("long")
        found, needed = F.regexp_count(col, F.lit(self.search_regex())).cast("long"), self._needed(col)
        return found if needed is None else F.when(needed, found).when(col.isNotNull(), F.lit(0).cast("long"))

    def find(self, col: Column, tree: bool = False, unit: str = "codepoint") -> Column:
        """Hits as array<struct<start, end, text>>; unit: codepoint, utf16 or byte; with tree also nodes.

        Native where hits cannot be empty: the pieces between hits and the hits alternate, and running lengths give the
        offsets. Other regular grammars run as an expression in an Arrow function.
        """
        if tree and unit in ("codepoint", "utf16", "byte") and self.native_hits and self.fixed_tree and not shapes.looks_ahead(self.program):
            pairs = F.arrays_zip(self.find(col, unit=unit).alias("hit"), self.find(col, unit="byte").alias("place"))
            with_nodes = lambda p: F.struct(p["hit"]["start"].alias("start"), p["hit"]["end"].alias("end"), p["hit"]["text"].alias("text"), self._nodes(p["hit"]["text"], p["place"]["start"]).alias("nodes"))
            return F.transform(pairs, with_nodes)
        if not tree and unit in ("codepoint", "utf16", "byte") and self.pairs is not None:
            return self._find_pairs(col, unit)
        if tree or unit not in ("codepoint", "utf16", "byte") or not self.native_hits:
            if unit not in ("codepoint", "utf16", "byte"):
                raise ValueError("unit must be codepoint, utf16 or byte")
            kind = _HITS if not tree else _HITS.replace("text:string", f"text:string,nodes:{arrow.NODES}")
            return self._of_likely(col, True, arrow.find(self.key, tree, unit), F.array().cast(kind))
        if unit == "byte":  # hits start at code points, not inside them
            spans = F.transform(_spans(self._text(col, True), rf"(?![\x80-\xBF])(?:{self.search_regex(True)})", True), _from_bytes)
        else:
            spans = _spans(col, self.search_regex(), True, _utf16 if unit == "utf16" else F.length)
        needed = self._needed(col)
        return spans if needed is None else F.when(needed, spans).when(col.isNotNull(), F.array().cast(_HITS))

    def _find_pairs(self, col: Column, unit: str) -> Column:
        """Hits of a recursion through a pair of signs: of two runs of signs, the inner ones that belong together."""
        text, pattern = self._text(col, unit == "byte"), self.pairs.search(unit == "byte")
        gaps, hits, opened, closed = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2, 3, 5))
        runs = _placed(text, F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), True, _utf16 if unit == "utf16" else F.length)

        def inner(z: Column) -> Column:
            n, m, run = F.length(z["opened"]), F.length(z["closed"]), z["run"]
            paired = self._paired(n, m)
            said = F.substr(run["text"], n - paired + 1, F.length(run["text"]) - n - m + 2 * paired)
            return F.struct((run["start"] + n - paired).alias("start"), (run["end"] - m + paired).alias("end"), said.alias("text"))

        found = F.transform(F.arrays_zip(runs.alias("run"), opened.alias("opened"), closed.alias("closed")), inner)
        found = F.transform(found, _from_bytes) if unit == "byte" else found
        needed = self._needed(col)
        return found if needed is None else F.when(needed, found).when(col.isNotNull(), F.array().cast(_HITS))

    def scan_bytes(self, col: Column) -> Column:
        """Hits in a binary column as array<struct<start, end>> in bytes; every byte may start one."""
        if not self.native or lowering.can_be_empty(self.program):
            return arrow.scan_bytes(self.key)(col)
        return _spans(F.decode(col, "ISO-8859-1"), self.search_regex(True), False)

    def count_bytes(self, col: Column) -> Column:
        """Number of hits in a binary column; every byte may start one."""
        if not self.native or lowering.can_be_empty(self.program):
            return F.size(self.scan_bytes(col)).cast("long")
        return F.regexp_count(F.decode(col, "ISO-8859-1"), F.lit(self.search_regex(True))).cast("long")

    def replace(self, col: Column, before: str = "", after: str = "", with_text: str | None = None) -> Column:
        """The text with each hit replaced by with_text, or wrapped in before and after."""
        if not self.native_hits:
            return arrow.replace(self.key, before, after, with_text)(col)
        safe = lambda t: t.replace("\\", "\\\\").replace("$", "\\$")
        new = safe(with_text) if with_text is not None else f"{safe(before)}$0{safe(after)}"
        return F.regexp_replace(col, self.search_regex(), new)

    def extract_columns(self, col: Column, names: list[str]) -> list[Column]:
        """One column per `extract` of the grammar, null where the text does not match; needs a fixed number of them."""
        pattern, found = lowering.lower(self.program, None, captures=True)
        if len(found) != len(names):
            raise ValueError(f"the grammar has {len(found)} extracts: {', '.join(found)}")
        as_bytes = lowering.needs_bytes(self.program)
        text, whole = self._text(col, as_bytes), rf"\A(?:{pattern})\z"
        got = [F.regexp_extract(text, whole, k + 1) for k in range(len(names))]
        back = (lambda c: F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")) if as_bytes else (lambda c: c)
        return [F.when(text.rlike(whole), back(c)).alias(n) for c, n in zip(got, names)]

    # -- what needs the matcher ---------------------------------------------------------------------------------------

    def match(self, col: Column) -> Column:
        """Struct of matched, consumed, nodes (tree in pre-order), extracts, and the report of a failure."""
        return progress.result(self.program, col, False) if self.simple_sequence else arrow.match(self.key)(col)

    def try_parse(self, col: Column) -> Column:
        """The same, with the tree and extracts of the longest part that matched where the whole does not."""
        return progress.result(self.program, col, True) if self.simple_sequence else arrow.match(self.key, partial=True)(col)

    @property
    def fixed_tree(self) -> bool:
        """Whether every match has the same rules in the same order, so that trees are made inside the JVM."""
        return self._shape(shapes.tree) is not None

    @property
    def fixed_extracts(self) -> bool:
        """Whether extracts, also those of the rounds of a loop, are taken inside the JVM."""
        return self._shape(shapes.extracts) is not None

    @property
    def simple_sequence(self) -> bool:
        """Whether results, partial results and reports of failure are made inside the JVM."""
        return self._shape(progress.steps) is not None

    def _shape(self, of):
        try:
            return of(self.program)
        except lowering.NotRegular:
            return None

    def _nodes(self, text: Column, shift: Column) -> Column:
        """The tree of a text that matches, with places in bytes from shift on."""
        found = []
        for k, p in enumerate(shapes.tree(self.program)):
            part = lambda group, p=p: F.regexp_extract(text, rf"(?s)\A({p.before})({p.own})", group) if k else text  # noqa: B023, E731
            start = shift + F.octet_length(part(1)) if k else shift
            said = part(2)
            values = {"id": F.lit(k), "parent": F.lit(p.parent), "depth": F.lit(p.depth), "rule": F.lit(p.rule), "start": start, "end": start + F.octet_length(said), "text": said}
            found.append(F.struct(*(v.alias(n) for n, v in values.items())))
        return F.array(*found).cast(arrow.NODES)

    def tree(self, col: Column) -> Column:
        """The tree of a text that matches as nodes in pre-order; null for one that does not."""
        if self.fixed_tree:
            return F.when(self.is_match(col), self._nodes(col, F.lit(0)))
        return self.match(self._only(col, True))["nodes"]

    def _only(self, col: Column, matching: bool) -> Column:
        """The text where it matches, or where it does not, and null elsewhere, which the matcher passes over."""
        if not self.native:
            return col
        return F.when(self.is_match(col) == F.lit(matching), col)

    def extract(self, col: Column) -> Column:
        """Texts of all extracts of a text that matches, in order."""
        parts = self._shape(shapes.extracts)
        if parts is None:
            return F.transform(self.match(self._only(col, True))["extracts"], lambda x: x["text"])
        found = [self._rounds(col, p) if isinstance(p, shapes.Rounds) else F.array(F.regexp_extract(col, rf"\A(?:{p.before})({p.own})", 1)) for p in parts]
        return F.when(self.is_match(col), F.concat(*found) if found else F.array().cast("array<string>"))

    @staticmethod
    def _rounds(col: Column, p: shapes.Rounds) -> Column:
        """Extracts of all rounds of a loop, each round beginning where the one before ends."""
        rest = F.regexp_extract(col, rf"\A(?:{p.before})((?s:.*))", 1)
        each = [F.regexp_extract_all(rest, F.lit(p.each), F.lit(k + 1)) for k in range(p.captures)]
        if p.high is not None:
            each = [F.slice(e, 1, p.high) for e in each]
        if len(each) == 1:
            return each[0]
        names = [f"c{k}" for k in range(p.captures)]
        return F.flatten(F.transform(F.arrays_zip(*(e.alias(n) for e, n in zip(each, names))), lambda z: F.array(*(z[n] for n in names))))

    def diagnose(self, col: Column) -> Column:
        """The report of why a text does not match, as text; null for one that matches."""
        return progress.report(self.program, col) if self.simple_sequence else arrow.diagnose(self.key)(self._only(col, False))

    def tree_text(self, col: Column) -> Column:
        """The tree of a text that matches, drawn with lines."""
        return arrow.tree_text(self.key)(self._only(col, True))

    def match_many(self, col: Column) -> Column:
        """For an array of texts, whether each matches."""
        if not self.native and self.pairs is None:
            return arrow.accepts_each(self.key)(col)
        return F.transform(col, self.is_match)

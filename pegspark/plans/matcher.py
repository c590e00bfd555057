"""Matches with trees, extracts, partial results and reports of failure: what a regular expression cannot return.

A program becomes nested functions once per worker; each takes a position and returns (end, nodes, extracts) or None.
Results of rules are remembered per rule and position, so a rule is followed once where it stands. A node is (rule, start,
end, children); positions are bytes.

Nesting costs no Python frames beyond a few: where LEVELS rules are open within one another, the next is set aside, solved
from an empty stack, and remembered; then what waited for it begins again and finds it. Only a search that may have to
report a failure notes how far it came; what is looked at behind `isn't` and the like notes nothing, and remembers apart.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from .syntax import Alt, Any, Byte, Expr, Extract, Isnt, Joined, Minus, NoneOf, OneOf, Program, Ref, Repeat, Seq, Text, Until
from .vocabulary import CHARACTERS, SAME_CHARACTER

EXTRACT = "<extract>"
#: Rules within rules beyond which a text is refused, which bounds the memory that one text can take.
DEEPEST = 1_000_000
#: Rules open within one another on the stack of Python's own calls.
LEVELS = 1000
Found = tuple[int, tuple, tuple]
#: Signs that a report names.
NAMED = {c: name for name, c in CHARACTERS.items() if name not in SAME_CHARACTER}


class TooDeep(Exception):
    """A text nests deeper than DEEPEST; at is where."""

    def __init__(self, at: int):
        self.at = at


class _Later(Exception):
    """LEVELS rules are open; the one that this names is to be solved first."""


def describe(byte: int) -> str:
    if 0x20 <= byte <= 0x7E:
        return f'"{chr(byte)}" (0x{byte:02X})'
    return NAMED.get(chr(byte), f"byte 0x{byte:02X}")


def _point(data: bytes, at: int) -> int | None:
    """The end of the UTF-8 sequence at a position, by its lead byte."""
    if at >= len(data):
        return None
    lead = data[at]
    end = at + (1 if lead < 0xC0 or lead >= 0xF8 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
    return end if end <= len(data) else None


class Matcher:
    """One input at a time: begin() sets it, entry() matches at a position."""

    def __init__(self, program: Program):
        self.program = program
        self.rules = {name: self._rule(name, self._expr(body)) for name, body in program.rules.items()}
        self.frames = LEVELS * (3 + max(_height(body) for body in program.rules.values()))
        self.begin(b"")

    def begin(self, data: bytes, quiet: bool = False) -> None:
        """quiet: nothing is noted for a report. limited: rules within rules beyond DEEPEST end the match."""
        self.data, self.quiet, self.limited = data, quiet, True
        self.known: dict[bool, dict[str, dict[int, tuple[Found | None, int]]]] = {k: {name: {} for name in self.rules} for k in (False, True)}
        self.furthest, self.expected, self.where = 0, set(), None
        self.best: Found = (0, (), ())
        self.stack, self.level, self.open, self.deepest = None, 0, 0, 0

    def entry(self, at: int) -> Found | None:
        """The entry rule at a position, by way of all rules that are set aside."""
        with _frames(self.frames):
            return self._solve(at)

    def _solve(self, at: int) -> Found | None:
        waiting, got = [(self.program.entry, at, self.quiet, None, 0)], None
        while waiting:
            name, place, self.quiet, self.stack, self.level = waiting[-1]
            self.open = self.deepest = 0
            try:
                got = self.rules[name](place)
                waiting.pop()
            except _Later as later:
                waiting.append(later.args)
        return got

    def miss(self, at: int, label: str) -> None:
        if self.quiet or at < self.furthest:
            return
        if at > self.furthest:
            self.furthest, self.expected, self.where = at, set(), self.stack
        self.expected.add(label)

    def _rule(self, name: str, body: Callable[[int], Found | None]):
        def run(at: int) -> Found | None:
            known = self.known[self.quiet][name].get(at)
            if known is None:
                if self.open == LEVELS:
                    raise _Later(name, at, self.quiet, self.stack, self.level)
                known = follow(at)
            self.deepest = max(self.deepest, known[1])
            return known[0]

        def follow(at: int) -> tuple[Found | None, int]:
            if self.level >= DEEPEST and self.limited:
                raise TooDeep(at)
            outside, deepest, self.deepest = self.stack, self.deepest, 0
            self.stack, self.level, self.open = (name, outside), self.level + 1, self.open + 1
            got = body(at)
            self.stack, self.level, self.open = outside, self.level - 1, self.open - 1
            found = None if got is None else (got[0], ((name, at, got[0], got[1]),), got[2])
            result = self.known[self.quiet][name][at] = found, self.deepest + 1
            self.deepest = deepest
            return result

        return run

    def _set(self, found: frozenset[int], label: str):
        table = bytes(b in found for b in range(256))

        def run(at: int) -> Found | None:
            if at < len(self.data) and table[self.data[at]]:
                return at + 1, (), ()
            return self.miss(at, label)

        return run

    def _point(self, label: str, barred: list, barred_label: str):
        def run(at: int) -> Found | None:
            end = _point(self.data, at)
            if end is None:
                return self.miss(at, label)
            if any(self._silent(b, at) for b in barred):
                return self.miss(at, barred_label)
            return end, (), ()

        return run

    def _silent(self, part, at: int) -> Found | None:
        before, self.quiet = self.quiet, True
        got = part(at)
        self.quiet = before
        return got

    def _expr(self, e):
        match e:
            case Byte(found, label):
                return self._set(found, label)
            case Any():
                return self._point("any character", [], "")
            case OneOf(options) | Alt(options):
                return self._first([self._expr(x) for x in options])
            case NoneOf(items):
                return self._point("none of (...)", [self._expr(x) for x in items], "none of (...)")
            case Minus(base, items):
                return self._minus(self._expr(base), [self._expr(x) for x in items])
            case Text(text):
                return self._text(text)
            case Seq(elements):
                return self._sequence([self._expr(x) for x in elements])
            case Repeat(body, low, high):
                return self._repeat(self._expr(body), low, high)
            case Joined(body, separator, lenient):
                return self._joined(self._expr(body), self._expr(separator), lenient)
            case Until(body, end, including):
                return self._until(self._expr(body), self._expr(end), including)
            case Isnt(body, negated):
                return self._isnt(self._expr(body), self._expr(negated), _label(negated))
            case Extract(body):
                return self._extract(self._expr(body), isinstance(body, Ref))
            case Ref(name):
                return lambda at: self.rules[name](at)
        raise TypeError(e)

    def _first(self, options):
        def run(at: int) -> Found | None:
            for option in options:
                if (got := option(at)) is not None:
                    return got
            return None

        return run

    def _minus(self, base, barred):
        def run(at: int) -> Found | None:
            if at >= len(self.data):
                return self.miss(at, "character")
            if any(self._silent(b, at) for b in barred):
                return self.miss(at, "character (excluded)")
            return base(at)

        return run

    def _text(self, text: str):
        want = text.encode()

        def run(at: int) -> Found | None:
            if self.data.startswith(want, at):
                return at + len(want), (), ()
            if at + len(want) > len(self.data):
                return self.miss(at, f'"{text}"')
            return self.miss(next(k for k, b in enumerate(want, at) if self.data[k] != b), f'"{text}"')

        return run

    def _sequence(self, elements):
        def run(at: int) -> Found | None:
            end, nodes, extracts = at, (), ()
            for element in elements:
                got = element(end)
                if got is None:
                    self.partial((end, nodes, extracts) if end > at else self.best)
                    return None
                end, nodes, extracts = got[0], nodes + got[1], extracts + got[2]
            return end, nodes, extracts

        return run

    def partial(self, got: Found) -> None:
        if got[0] > self.best[0] and not self.quiet:
            self.best = got

    def _repeat(self, body, low: int, high: int | None):
        def run(at: int) -> Found | None:
            end, nodes, extracts, times = at, [], [], 0
            while high is None or times < high:
                got = body(end)
                if got is None or high is None and got[0] == end:
                    break
                end = got[0]
                nodes += got[1]
                extracts += got[2]
                times += 1
            return (end, tuple(nodes), tuple(extracts)) if times >= low else None

        return run

    def _joined(self, body, separator, lenient: bool):
        def run(at: int) -> Found | None:
            got = body(at)
            if got is None:
                return None
            end, nodes, extracts = got[0], [*got[1]], [*got[2]]
            while (between := separator(end)) is not None and (got := body(between[0])) is not None and got[0] > end:
                end = got[0]
                nodes += between[1] + got[1]
                extracts += between[2] + got[2]
            if lenient and (between := separator(end)) is not None:
                end = between[0]
            return end, tuple(nodes), tuple(extracts)

        return run

    def _until(self, body, stop, including: bool):
        def run(at: int) -> Found | None:
            end, nodes, extracts = at, [], []
            while (last := stop(end)) is None:
                got = body(end)
                if got is None or got[0] == end:
                    return None
                end = got[0]
                nodes += got[1]
                extracts += got[2]
            if including:
                end, nodes, extracts = last[0], [*nodes, *last[1]], [*extracts, *last[2]]
            return end, tuple(nodes), tuple(extracts)

        return run

    def _isnt(self, body, negated, label: str):
        def run(at: int) -> Found | None:
            return body(at) if self._silent(negated, at) is None else self.miss(at, f"not {label}")

        return run

    def _extract(self, body, rule: bool):
        def run(at: int) -> Found | None:
            got = body(at)
            if got is None:
                return None
            node = got[1][0] if rule else (EXTRACT, at, got[0], got[1])
            return got[0], got[1], (*got[2], node)

        return run


def _height(e: Expr) -> int:
    return 1 + max(map(_height, e.parts()), default=0)


@contextmanager
def _frames(more: int) -> Iterator[None]:
    """Room for so many more calls within calls, while it lasts."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(limit + more)
    try:
        yield
    finally:
        sys.setrecursionlimit(limit)


def _names(stack) -> list[str]:
    out = []
    while stack is not None:
        out.append(stack[0])
        stack = stack[1]
    return out[::-1]


def _label(e) -> str:
    match e:
        case Byte(_, label):
            return label
        case Any():
            return "any character"
        case Text(text):
            return f'"{text}"'
        case Ref(name):
            return name
    return "pattern"


def accepts(m: Matcher, data: bytes) -> bool:
    """Whether the whole input matches; one that nests too deep does not."""
    return prefix(m, data) == len(data)


def prefix(m: Matcher, data: bytes) -> int:
    """Bytes matched from the start, or -1."""
    m.begin(data, quiet=True)
    try:
        got = m.entry(0)
    except TooDeep:
        return -1
    return -1 if got is None else got[0]


def whole(m: Matcher, data: bytes) -> dict:
    """A full match, or the report of the furthest failure and of what was matched before it.

    Where the input nests too deep, that is the failure, with nothing matched before it.
    """
    m.begin(data)
    try:
        got = m.entry(0)
    except TooDeep as deep:
        got, m.best = None, (0, (), ())
        m.quiet, m.furthest, m.expected, m.where = False, deep.at, {f"at most {DEEPEST} rules within rules"}, (m.program.entry, None)
    if got is not None and got[0] == len(data):
        return {"matched": True, "consumed": got[0], "nodes": got[1], "extracts": got[2]}
    if got is not None:
        m.partial(got)
        m.miss(got[0], "end of input")
    far = m.furthest
    end, nodes, extracts = m.best
    if end and not (len(nodes) == 1 and nodes[0][0] == m.program.entry):
        nodes = ((m.program.entry, 0, end, nodes),)
    line = data.count(b"\n", 0, far) + 1
    return {
        "matched": False, "consumed": end, "nodes": nodes if end else (), "extracts": extracts, "offset": far, "line": line,
        "column": far - data.rfind(b"\n", 0, far), "expected": sorted(m.expected),
        "found": describe(data[far]) if far < len(data) else "end of input", "rule_stack": _names(m.where),
    }


def hits(m: Matcher, data: bytes, every_byte: bool = False) -> list[Found]:
    """All matches that are not empty, left to right without overlap; starts are code points, or every byte.

    What is remembered of places that the search has passed is dropped. A match that nests too deep is none.
    """
    m.begin(data, quiet=True)
    out, at, m.limited = [], 0, False
    known = list(m.known[True].values())
    with _frames(m.frames):
        while at < len(data):
            got, before = m._solve(at), at
            if got is not None and got[0] > at and m.deepest <= DEEPEST:
                out.append((at, *got))
                at = got[0]
            else:
                at = at + 1 if every_byte else (_point(data, at) or len(data))
            for of_rule in known:
                for place in range(before, at) if of_rule else ():
                    of_rule.pop(place, None)
    return out

"""Programs of fixed shape: where each rule and each extract of a match lies, as expressions that capture it.

What stands before a rule or extract, outside loops and choices, is a sequence of patterns that is the same for every
match. As patterns are deterministic, an expression for that sequence stops where the rule begins, so its length is the
rule's place. A loop that holds extracts is captured from its start on and gone through once more, round by round.

A recursion through a pair of signs is a run of opening signs, what is inside them all, and a run of closing signs. An
expression cannot compare the two runs, but their lengths can be compared after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from . import envelope
from .analysis import nullable, nullable_rules
from .lowering import Lowering, NotRegular, byte_set, char_class, lower, needs_bytes
from .syntax import Alt, Expr, Extract, Isnt, Joined, Minus, NoneOf, OneOf, Program, Ref, Repeat, Seq, Until, walk

#: Rules or extracts of one match beyond which the matcher is the shorter way.
MOST = 40


@dataclass(frozen=True)
class Place:
    """A rule or extract: what comes before it and what it is itself; parent is its place in the list, -1 for the root."""

    rule: str
    parent: int
    depth: int
    before: str
    own: str


@dataclass(frozen=True)
class Rounds:
    """A loop with `captures` extracts in each round, the first after `before`; at most `high` rounds."""

    before: str
    each: str
    captures: int
    high: int | None


@dataclass(frozen=True)
class Pairs:
    """Classes of opening signs, all other signs and closing signs, and what is inside, as characters and as bytes.

    levels: rules within one another that the place after the last opening sign takes.
    """

    opening: str
    other: str
    inside: str
    inside_bytes: str
    closing: str
    levels: int

    @property
    def start(self) -> str:
        """Groups: opening signs, what is inside, closing signs."""
        return f"({self.opening}++)({self.inside})({self.closing}++)"

    @property
    def innermost(self) -> str:
        """What every hit has in its middle."""
        return f"{self.opening}{self.inside}{self.closing}"

    def search(self, as_bytes: bool = False) -> str:
        """From the end of the hit before. Groups: what is passed, where a run of opening signs is passed as a whole; the two
        runs and what is inside, together and each."""
        inside = self.inside_bytes if as_bytes else self.inside
        passed = f"(?:{self.other}++|{self.opening}++(?!{inside}{self.closing}))*+"
        return rf"\G({passed})(({self.opening}++)({inside})({self.closing}++))"


class _Spine:
    def __init__(self, program: Program):
        lower(program, False)  # raises where the program is not regular, or needs bytes
        self.program, self.empty = program, nullable_rules(program)
        self.text = lambda e: Lowering(program, False).expr(e)

    def holds(self, e: Expr, kind: type) -> bool:
        return any(isinstance(x, kind) or isinstance(x, Ref) and kind is not Ref and self.holds(self.program.rules[x.name], kind) for x in walk(e))

    def steps(self, e: Expr, kind: type):
        """The parts of a pattern in order: expressions that hold none of kind as text, others as patterns."""
        match e:
            case _ if not self.holds(e, kind):
                yield self.text(e)
            case Seq(elements):
                for x in elements:
                    yield from self.steps(x, kind)
            case Isnt(body, negated):
                yield f"(?!{self.text(negated)})"
                yield from self.steps(body, kind)
            case Repeat(body, low, high) if low == high and low <= MOST and kind is Ref:
                for _ in range(low):
                    yield from self.steps(body, kind)
            case Extract(body) if kind is Ref:
                yield from self.steps(body, kind)
            case Ref(name) if kind is Extract:
                yield from self.steps(self.program.rules[name], kind)
            case _:
                yield e


def tree(program: Program) -> list[Place]:
    """The rules of every match, in pre-order; NotRegular if they differ from match to match."""
    spine, found = _Spine(program), []

    def add(name: str, parent: int, depth: int, before: str) -> None:
        if len(found) == MOST:
            raise NotRegular
        own, body = len(found), program.rules[name]
        found.append(Place(name, parent, depth, before, spine.text(body)))
        for step in spine.steps(body, Ref):
            if isinstance(step, str):
                before += step
            elif isinstance(step, Ref):
                add(step.name, own, depth + 1, before)
                before += spine.text(step)
            else:
                raise NotRegular

    add(program.entry, -1, 0, "")
    return found


def extracts(program: Program) -> list[Place | Rounds]:
    """The extracts of every match in order, single or in rounds; NotRegular if some are in choices or loops in loops."""
    spine, found = _Spine(program), []

    def go(e: Expr, before: str) -> str:
        for step in spine.steps(e, Extract):
            if isinstance(step, str):
                before += step
                continue
            match step:
                case Extract(body):
                    if spine.holds(body, Extract):
                        go(body, before)
                    found.append(Place("", -1, 0, before, spine.text(body)))
                case Repeat(body, _, high):
                    found.append(rounds(before, body, "", high))
                case Joined(body, separator) if not spine.holds(separator, Extract):
                    found.append(rounds(before, body, rf"(?>\A|{spine.text(separator)})", None))
                case _:
                    raise NotRegular
            if len(found) > MOST:
                raise NotRegular
            before += spine.text(step)
        return before

    def rounds(before: str, body: Expr, between: str, high: int | None) -> Rounds:
        if nullable(body, spine.empty):
            raise NotRegular
        work = Lowering(program, False, captures=True)
        each = work.expr(body)
        return Rounds(before, rf"\G{between}{each}", len(work.names), high)

    go(program.rules[program.entry], "")
    return found


def looks_ahead(program: Program) -> bool:
    """Whether some pattern can look at what comes after the match."""
    plain = lambda e: byte_set(e.items) is not None
    return any(isinstance(e, Isnt) or isinstance(e, Until) and not e.including or isinstance(e, (NoneOf, Minus)) and not plain(e) for body in program.rules.values() for e in walk(body))


def pairs(program: Program) -> Pairs:
    """A rule `opening then itself, something else or nothing, then closing`; NotRegular for any other.

    The rule follows opening signs as far as they go. Nothing else that it tries can begin with one, so where a closing
    sign is missing, every rule outside fails too: n opening signs match if n closing ones or more come after what is
    inside, and else the innermost ones match, as many as there are closing signs.
    """
    match program.rules[program.entry]:
        case Seq((opening, inside, closing)):
            opens, closes = _signs(program, opening), _signs(program, closing)
        case _:
            raise NotRegular
    optional = isinstance(inside, Repeat) and (inside.low, inside.high) == (0, 1)
    choice = inside.body if optional else inside
    options = choice.options if isinstance(choice, Alt) else (choice,)
    others = tuple(x for x in options if not _is(x, program.entry))
    if len(others) + 1 != len(options) or not opens or not closes or opens & closes or needs_bytes(program):
        raise NotRegular
    core = Alt(others) if others else None
    if core is None and not optional:
        raise NotRegular
    found = ["", ""]
    if core is not None:
        if nullable(core, nullable_rules(program)) or any(isinstance(x, Ref) and not _flat(program, x) for x in walk(core)):
            raise NotRegular
        own = Program({**program.rules, program.entry: core}, program.entry)
        if opens & envelope.first(own):
            raise NotRegular
        rest = Program({**own.rules, own.entry: Repeat(core, 0, 1)}, own.entry) if optional else own
        found = [lower(rest, as_bytes)[0] for as_bytes in (False, True)]
    return Pairs(char_class(opens), char_class(opens, negated=True), *found, char_class(closes), 1 + any(isinstance(x, Ref) for x in walk(opening)))


def _is(e: Expr, name: str) -> bool:
    return isinstance(e, Ref) and e.name == name or isinstance(e, Extract) and _is(e.body, name)


def _flat(program: Program, e: Ref) -> bool:
    """Whether a rule follows no other."""
    return not any(isinstance(x, Ref) for x in walk(program.rules[e.name]))


def _signs(program: Program, e: Expr) -> frozenset[int]:
    """The signs of a pattern that is one ASCII sign."""
    match e:
        case Extract(body):
            return _signs(program, body)
        case Ref() if _flat(program, e):
            return _signs(program, program.rules[e.name])
        case OneOf(items):
            found = byte_set(items)
        case _:
            found = byte_set((e,))
    if found is None or max(found, default=0) > 127:
        raise NotRegular
    return found

"""What every match of a program looks like where it begins: a condition for the JVM before a recursive grammar's matcher.

Of the first LOOK characters of a match the possible ones are found per place, by following the program from each place to
the places that it can end at, rules within rules too, until nothing new is found. Together with the least length this is
an expression that every match begins with, whatever the recursion does later.
"""

from __future__ import annotations

from .analysis import literals
from .lowering import byte_set, char_class, needs_bytes
from .syntax import Alt, Any, Byte, Expr, Extract, Isnt, Joined, Minus, NoneOf, OneOf, Program, Ref, Repeat, Seq, Text, Until

#: Characters of a match that are looked at.
LOOK = 12
#: A character beyond ASCII, as a member of a set of code points.
BEYOND = 128


class _Starts:
    def __init__(self, program: Program):
        self.program = program
        self.at: list[set[int]] = [set() for _ in range(LOOK)]
        self.ends: dict[tuple[str, int], set[int]] = {}
        self.changed = True
        while self.changed:
            self.changed, self.passed = False, set()
            self.rule(program.entry, 0)
        self.least = min(self.ends[program.entry, 0], default=LOOK)

    def rule(self, name: str, place: int) -> set[int]:
        """Places where a rule that begins at a place can end, as far as they are known; gone through once a pass."""
        key = name, place
        known = self.ends.setdefault(key, set())
        if key not in self.passed:
            self.passed.add(key)
            found = self.expr(self.program.rules[name], {place})
            if not found <= known:
                known |= found
                self.changed = True
        return set(known)

    def one(self, places: set[int], signs: set[int]) -> set[int]:
        for p in places:
            if p < LOOK and not signs <= self.at[p]:
                self.at[p] |= signs
                self.changed = True
        return {min(p + 1, LOOK) for p in places} if signs else set()

    def expr(self, e: Expr, places: set[int]) -> set[int]:
        go = self.expr
        match e:
            case _ if not places:
                return set()
            case Byte(found):
                return self.one(places, {b for b in found if b < BEYOND})
            case Any():
                return self.one(places, set(range(BEYOND + 1)))
            case NoneOf(items):
                return self.one(places, set(range(BEYOND + 1)) - (byte_set(items) or set()))
            case Minus(base):
                return go(base, places)
            case Text(text):
                for c in text:
                    places = self.one(places, {min(ord(c), BEYOND)})
                return places
            case Seq(elements):
                for x in elements:
                    places = go(x, places)
                return places
            case Alt(options) | OneOf(options):
                return set().union(*(go(x, places) for x in options))
            case Repeat(body, low, high):
                for _ in range(min(low, LOOK + 1)):
                    places = go(body, places)
                rounds = LOOK + 1 if high is None else min(high - low, LOOK + 1)
                return self.rounds(lambda at: go(body, at), places, rounds)
            case Joined(body, separator, lenient):
                ends = self.rounds(lambda at: go(body, go(separator, at)), go(body, places), LOOK + 1)
                return ends | go(separator, ends) if lenient else ends
            case Until(body, end, including):
                ends = self.rounds(lambda at: go(body, at), places, LOOK + 1)
                return go(end, ends) if including else ends
            case Isnt(body) | Extract(body):
                return go(body, places)
            case Ref(name):
                return set().union(*(self.rule(name, p) for p in places))
        raise TypeError(e)

    @staticmethod
    def rounds(step, places: set[int], most: int) -> set[int]:
        all_, fresh = set(places), places
        for _ in range(most):
            fresh = step(fresh) - all_
            if not fresh:
                break
            all_ |= fresh
        return all_


def beginning(program: Program) -> str | None:
    """An expression that every match of at least one character begins with; None where nothing can be said."""
    if needs_bytes(program):
        return None
    starts = _Starts(program)
    places = [_class(s) for s in starts.at[: max(1, min(starts.least, LOOK))]]
    while places and places[-1] == _CHAR:
        places.pop()
    return "".join(places) or None


def first(program: Program) -> set[int]:
    """Signs that a match can begin with; BEYOND stands for all beyond ASCII."""
    return _Starts(program).at[0]


_CHAR = "(?s:.)"


def _class(signs: set[int]) -> str:
    if len(signs) > BEYOND:
        return _CHAR
    if BEYOND in signs:
        return char_class(frozenset(set(range(BEYOND)) - signs), negated=True)
    return char_class(frozenset(signs))


def rarest(program: Program) -> str | None:
    """The longest text that every match contains."""
    return max(literals(program), key=len, default=None)

"""A program as one regular expression for Java and Python.

Without recursion a pattern grammar is deterministic: with atomic choices and possessive loops a backtracking engine
decides as the grammar does. Two domains: characters of the text, or bytes, where each byte of the UTF-8 text is one
character below 0x100.
"""

from __future__ import annotations

from .analysis import endless, high_bytes, nullable, nullable_rules, recursive
from .syntax import Alt, Any, Byte, Extract, Isnt, Joined, Minus, NoneOf, OneOf, Program, Ref, Repeat, Seq, Text, Until

#: Expressions longer than this are left to the matcher.
LONGEST = 32_768
NEVER = "(?!)"
_CHAR = "(?s:.)"
#: One UTF-8 sequence by its lead byte.
_SEQUENCE = r"(?:[\x00-\xBF\xF8-\xFF]|[\xC0-\xDF][\x00-\xFF]|[\xE0-\xEF][\x00-\xFF]{2}|[\xF0-\xF7][\x00-\xFF]{3})"


class NotRegular(Exception):
    """The program needs the matcher."""


def char_class(found: frozenset[int], negated: bool = False) -> str:
    if not found:
        return _CHAR if negated else NEVER
    runs, values = [], sorted(found)
    for v in values:
        if runs and v == runs[-1][1] + 1:
            runs[-1][1] = v
        else:
            runs.append([v, v])
    if not negated and len(values) == 1:
        return rf"\x{values[0]:02X}"
    body = "".join(rf"\x{a:02X}" if a == b else rf"\x{a:02X}-\x{b:02X}" for a, b in runs)
    return f"[{'^' if negated else ''}{body}]"


def quote(text: str, as_bytes: bool) -> str:
    """A literal: ASCII letters and digits as they are, other ASCII as \\xHH, the rest as itself (or its bytes)."""
    units = [chr(b) for b in text.encode()] if as_bytes else text
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 and not as_bytes else rf"\x{ord(c):02X}" for c in units)


def byte_set(items) -> frozenset[int] | None:
    """The union of items that are all sets of single bytes."""
    sets = [i.bytes if isinstance(i, Byte) else minus if isinstance(i, Minus) and (minus := _minus_set(i)) is not None else None for i in items]
    return None if any(s is None for s in sets) else frozenset().union(*sets)


def _minus_set(e: Minus) -> frozenset[int] | None:
    taken = byte_set(e.items)
    return e.base.bytes - taken if isinstance(e.base, Byte) and taken is not None else None


class Lowering:
    def __init__(self, program: Program, as_bytes: bool, captures: bool = False):
        self.program, self.as_bytes, self.captures = program, as_bytes, captures
        self.point = _SEQUENCE if as_bytes else _CHAR
        self.size, self.names = 0, []

    def one(self, items) -> str:
        found = byte_set(items)
        return char_class(found) if found is not None else f"(?>{'|'.join(map(self.expr, items))})"

    def without(self, items, base: str) -> str:
        found = byte_set(items)
        if found is not None and base == _CHAR:
            return char_class(found, negated=True)
        return f"(?!{self.one(items)}){base}"

    def expr(self, e, loop: bool = False) -> str:
        """loop: under a loop, choice or lookahead, where a capture may not stand."""
        self.size += 1
        if self.size > LONGEST:
            raise NotRegular
        match e:
            case Byte(found):
                return char_class(found)
            case Any():
                return self.point
            case OneOf(items):
                return self.one(items)
            case NoneOf(items):
                return self.without(items, self.point)
            case Minus(base, items):
                found = _minus_set(e)
                return char_class(found) if found is not None else self.without(items, self.expr(base, True))
            case Text(text):
                return quote(text, self.as_bytes)
            case Seq(elements):
                return "".join(self.expr(x, loop) for x in elements)
            case Alt(options):
                return f"(?>{'|'.join(self.expr(x, True) for x in options)})"
            case Repeat(body, low, high):
                inner = f"(?:{self.expr(body, True)})"
                return inner + {(0, None): "*+", (1, None): "++", (0, 1): "?+"}.get((low, high), f"{{{low},{high}}}+")
            case Joined(body, separator, lenient):
                element, between = self.expr(body, True), self.expr(separator, True)
                return f"{element}(?:{between}{element})*+" + (f"(?:{between})?+" if lenient else "")
            case Until(body, end, including):
                stop = self.expr(end, True)
                return f"(?:(?!{stop}){self.expr(body, True)})*+" + (stop if including else f"(?={stop})")
            case Isnt(body, negated):
                return f"(?!{self.expr(negated, True)}){self.expr(body, loop)}"
            case Extract(body):
                if not self.captures:
                    return self.expr(body, loop)
                if loop:
                    raise NotRegular
                self.names.append(body.name if isinstance(body, Ref) else "<extract>")
                return f"({self.expr(body, loop)})"
            case Ref(name):
                return f"(?:{self.expr(self.program.rules[name], loop)})"
        raise TypeError(e)


def lower(program: Program, as_bytes: bool | None = None, captures: bool = False) -> tuple[str, list[str]]:
    """(expression, names of its captures); as_bytes None: bytes only if the program needs them."""
    if recursive(program) or endless(program):
        raise NotRegular
    own = needs_bytes(program)
    if as_bytes is False and own:
        raise NotRegular
    work = Lowering(program, own if as_bytes is None else as_bytes, captures)
    text = work.expr(program.rules[program.entry])
    if len(text) > LONGEST:
        raise NotRegular
    return text, work.names


def search_start(program: Program, as_bytes: bool = False) -> str:
    """A condition, as an expression to put before the program's own, that every hit's start meets in a search.

    Where a program begins with a loop without end over one class of characters, the loop takes all of a stretch of them
    wherever it begins, and what follows does not know where that was. So a hit that could start inside a stretch could
    start with it, unless the hit before ends there: a start is a place with no such character before it, or the end of
    the hit before. Without such a loop the condition is empty.
    """
    found = _leading_class(program, program.rules[program.entry], as_bytes, set())
    return "" if found is None else rf"(?:\G|(?<!{found}))"


def _leading_class(program: Program, e, as_bytes: bool, seen: set[str]) -> str | None:
    more = lambda x: _leading_class(program, x, as_bytes, seen)
    match e:
        case Repeat(body, _, None) if (found := _class_of(program, body, as_bytes)) is not None:
            return found
        case Repeat(body, low, _) if low > 0:
            return more(body)
        case Seq(elements):
            return more(elements[0])
        case Joined(body) | Extract(body):
            return more(body)
        case Ref(name) if name not in seen:
            return _leading_class(program, program.rules[name], as_bytes, seen | {name})
    return None


def _class_of(program: Program, e, as_bytes: bool) -> str | None:
    """The class of a pattern that is one character of a class."""
    match e:
        case NoneOf(items) if not as_bytes and (found := byte_set(items)) is not None:
            return char_class(found, negated=True)
        case Byte() | Minus():
            found = byte_set((e,))
            return None if not found else char_class(found)
        case OneOf(items):
            found = byte_set(items)
            return None if not found else char_class(found)
        case Extract(body):
            return _class_of(program, body, as_bytes)
        case Ref(name) if not isinstance(program.rules[name], Ref):
            return _class_of(program, program.rules[name], as_bytes)
    return None


def needs_bytes(program: Program) -> bool:
    return any(high_bytes(body) for body in program.rules.values())


def can_be_empty(program: Program) -> bool:
    return nullable(program.rules[program.entry], nullable_rules(program))

"""Grammar text to a tree of expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from .vocabulary import ANY, CHARACTERS, class_bytes, phrase


class GrammarError(ValueError):
    """A grammar that cannot be used; line and column count from 1."""

    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"{message} at line {line}, column {column}")
        self.line, self.column = line, column


@dataclass(frozen=True)
class Expr:
    at: tuple[int, int] = field(default=(1, 1), compare=False, kw_only=True)

    def parts(self) -> tuple[Expr, ...]:
        return ()


@dataclass(frozen=True)
class Byte(Expr):
    """One byte of a set."""

    bytes: frozenset[int]
    label: str


@dataclass(frozen=True)
class Any(Expr):
    """One code point."""


@dataclass(frozen=True)
class OneOf(Expr):
    items: tuple[Expr, ...]

    def parts(self):
        return self.items


@dataclass(frozen=True)
class NoneOf(Expr):
    items: tuple[Expr, ...]

    def parts(self):
        return self.items


@dataclass(frozen=True)
class Minus(Expr):
    base: Expr
    items: tuple[Expr, ...]

    def parts(self):
        return (self.base, *self.items)


@dataclass(frozen=True)
class Text(Expr):
    text: str


@dataclass(frozen=True)
class Seq(Expr):
    elements: tuple[Expr, ...]

    def parts(self):
        return self.elements


@dataclass(frozen=True)
class Alt(Expr):
    options: tuple[Expr, ...]

    def parts(self):
        return self.options


@dataclass(frozen=True)
class Repeat(Expr):
    """low to high times (None: without end); a loop without end stops at an empty iteration and does not count it."""

    body: Expr
    low: int
    high: int | None

    def parts(self):
        return (self.body,)


@dataclass(frozen=True)
class Joined(Expr):
    body: Expr
    separator: Expr
    lenient: bool

    def parts(self):
        return (self.body, self.separator)


@dataclass(frozen=True)
class Until(Expr):
    body: Expr
    end: Expr
    including: bool

    def parts(self):
        return (self.body, self.end)


@dataclass(frozen=True)
class Isnt(Expr):
    body: Expr
    negated: Expr

    def parts(self):
        return (self.body, self.negated)


@dataclass(frozen=True)
class Extract(Expr):
    body: Expr

    def parts(self):
        return (self.body,)


@dataclass(frozen=True)
class Ref(Expr):
    name: str


@dataclass(frozen=True)
class Program:
    """Rules by name, in order; the entry is the last rule of the source."""

    rules: Mapping[str, Expr]
    entry: str


@dataclass(frozen=True)
class Token:
    kind: str  # operator, character, class, byte, number, text, name, mark, end
    value: str
    at: tuple[int, int]


_RAW = re.compile(r"""\s*(?:(?P<text>"[^"]*")|(?P<mark>[(),:])|(?P<word>isn't(?![\w-])|[A-Za-z0-9_-]+))""", re.ASCII)
_HEADER = re.compile(r"\s*([A-Za-z0-9 \-]*[A-Za-z0-9\-])\s*:")
_HEX = re.compile(r"0x[0-9A-Fa-f]{2}")


def _uncommented(line: str) -> str:
    """A quote mark toggles; -- outside quotes begins a comment."""
    pieces = re.split(r'("[^"]*(?:"|$))', line)
    out = ""
    for k, piece in enumerate(pieces):
        if k % 2 == 0 and "--" in piece:
            return out + piece[: piece.index("--")]
        out += piece
    return out


def _statements(source: str) -> list[list[tuple[int, str]]]:
    """Lines grouped into statements: an indented line continues one, a blank line ends it."""
    groups: list[list[tuple[int, str]]] = []
    fresh = True
    for number, line in enumerate(source.split("\n"), 1):
        line = _uncommented(line).rstrip()
        if not line.strip():
            fresh = True
        elif fresh or line[0] not in " \t":
            groups.append([(number, line)])
            fresh = False
        else:
            groups[-1].append((number, line))
    return groups


def _tokens(lines: list[tuple[int, str]]) -> list[Token]:
    raw: list[Token] = []
    for number, line in lines:
        at = 0
        while line[at:].strip():
            m = _RAW.match(line, at)
            column = len(line) - len(line[at:].lstrip()) + 1
            if not m:
                message = "Unterminated quoted text" if line[column - 1] == '"' else f"Unexpected character {line[column - 1]!r}"
                raise GrammarError(message, number, column)
            raw.append(Token(m.lastgroup, m[m.lastgroup], (number, column)))
            at = m.end()
    out, k = [], 0
    while k < len(raw):
        token, used = raw[k], 1
        if token.kind == "text":
            if token.value == '""':
                raise GrammarError("Empty quoted text", *token.at)
            token = Token("text", token.value[1:-1], token.at)
        elif token.kind == "word":
            run = [t.value for t in raw[k : k + 3] if t.kind == "word"]
            run = run[: next((j for j, t in enumerate(raw[k : k + 3]) if t.kind != "word"), len(run))]
            if run[0] == "byte" and len(run) > 1 and _HEX.fullmatch(run[1]):
                token, used = Token("byte", run[1], token.at), 2
            else:
                for used in (3, 2, 1):
                    found = phrase(" ".join(run[:used])) if len(run) >= used else None
                    if found:
                        token = Token(*found, token.at)
                        break
                else:
                    token = Token("number" if token.value.isdigit() else "name", token.value, token.at)
        out.append(token)
        k += used
    return out


class _Reader:
    """One rule's body, by recursive descent; loosest: or, joined by, then / until, isn't, repetition, atom."""

    def __init__(self, tokens: list[Token], names: set[str], end: tuple[int, int]):
        self.tokens, self.k, self.names = [*tokens, Token("end", "end of rule", end)], 0, names

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def take(self, *values: str, kinds: tuple[str, ...] = ("operator", "mark")) -> Token | None:
        token = self.now
        if token.kind in kinds and (not values or token.value in values):
            self.k += 1
            return token
        return None

    def need(self, *values: str, kinds: tuple[str, ...] = ("operator", "mark")) -> Token:
        return self.take(*values, kinds=kinds) or self.fail(f"Expected {' or '.join(values or kinds)}, found {self.now.value!r}")

    def fail(self, message: str, token: Token | None = None):
        raise GrammarError(message, *(token or self.now).at)

    def whole(self) -> Expr:
        out = self.alternatives()
        if self.now.kind != "end":
            self.fail(f"Unexpected {self.now.value!r}")
        return out

    def alternatives(self) -> Expr:
        at, options = self.now.at, [self.joined()]
        while self.take("or"):
            options.append(self.joined())
        return options[0] if len(options) == 1 else Alt(tuple(options), at=at)

    def joined(self) -> Expr:
        at, body = self.now.at, self.sequence()
        if self.take("joined by"):
            return Joined(body, self.sequence(), bool(self.take("lenient")), at=at)
        return body

    def sequence(self) -> Expr:
        at, elements = self.now.at, [self.repeated()]
        while self.take("then", ","):
            elements.append(self.repeated())
        body = elements[0] if len(elements) == 1 else Seq(tuple(elements), at=at)
        if token := self.take("until"):
            how = self.take("including", "excluding") or self.fail('Expected "including" or "excluding" after "until"', token)
            return Until(body, self.repeated(), how.value == "including", at=at)
        return body

    def repeated(self) -> Expr:
        body = self.counted()
        while self.take("isn't"):
            body = Isnt(body, self.atom(), at=body.at)
        return body

    def number(self) -> int:
        token = self.now
        if token.kind == "number" or token.value == "one" and token.kind == "operator":
            self.k += 1
            return 1 if token.value == "one" else int(token.value)
        return self.fail(f"Expected a number, found {token.value!r}")

    def counted(self) -> Expr:
        token = self.now
        if loop := self.take("one or more", "zero or more"):
            low = int(loop.value == "one or more")
            if self.take("of"):
                return Repeat(OneOf(self.items(), at=token.at), low, None, at=token.at)
            if self.now.kind == "name" and self.now.value == "characters":
                self.k += 1
                if not self.take("except"):
                    self.fail('Expected "except" after "characters"')
                return Repeat(NoneOf(self.items(), at=token.at), low, None, at=token.at)
            return Repeat(self.atom(), low, None, at=token.at)
        if self.take("optional"):
            return Repeat(self.atom(), 0, 1, at=token.at)
        if self.take("between"):
            low = self.number()
            self.need("and")
            high = self.number()
            if low > high:
                self.fail(f"between {low} and {high}: the least is greater than the most", token)
            return Repeat(self.atom(), low, high, at=token.at)
        if token.kind == "number" or token.kind == "operator" and token.value == "one":
            times = self.number()
            body = self.atom()
            if self.now.value == "or" and self.tokens[self.k + 1].value == "more":
                self.k += 2
                if times != 1:
                    self.fail(f'"{token.value} ... or more" only valid with "one"', token)
                return Repeat(body, 1, None, at=token.at)
            return Repeat(body, times, times, at=token.at)
        return self.atom()

    def atom(self) -> Expr:
        token = self.now
        if self.take("extract"):
            return Extract(self.repeated(), at=token.at)
        if self.take("("):
            body = self.alternatives()
            self.need(")")
            return body
        if self.take("any of"):
            return OneOf(self.items(), at=token.at)
        if self.take("none of"):
            return NoneOf(self.items(), at=token.at)
        if token.kind == "name":
            return Ref(self.reference(), at=token.at)
        return self.single("Unexpected")

    def single(self, complaint: str) -> Expr:
        """A character, class, text, byte or range."""
        token = self.now
        self.k += token.kind != "end"
        if token.kind == "character":
            return Byte(frozenset((ord(CHARACTERS[token.value]),)), token.value, at=token.at)
        if token.kind == "class":
            base = Any(at=token.at) if token.value == ANY else Byte(class_bytes(token.value), token.value, at=token.at)
            return Minus(base, self.items(), at=token.at) if self.take("except") else base
        if token.kind == "text" and len(token.value.encode("utf-16-le")) > 2:
            return Text(token.value, at=token.at)
        if token.kind in ("text", "byte"):
            low = self.code(token)
            if self.take("to"):
                last = self.now
                self.k += 1
                high = self.code(last) if last.kind == "byte" or last.kind == "text" and len(last.value) == 1 else self.fail("Expected the end of a range", last)
                if low > high:
                    self.fail(f"Range 0x{low:02X} to 0x{high:02X} is inverted", token)
                return Byte(frozenset(range(low, min(high, 255) + 1)), f"0x{low:02X}..0x{high:02X}", at=token.at)
            label = f'"{token.value}"' if token.kind == "text" else f"byte 0x{low:02X}"
            return Byte(frozenset((low,)) if low < 256 else frozenset(), label, at=token.at)
        return self.fail(f"{complaint} {token.value!r}", token)

    @staticmethod
    def code(token: Token) -> int:
        return int(token.value, 16) if token.kind == "byte" else ord(token.value)

    def items(self) -> tuple[Expr, ...]:
        self.need("(")
        found = [self.single("Not a set item:")]
        while self.take(","):
            found.append(self.single("Not a set item:"))
        self.need(")")
        for item in found:
            if isinstance(item, Text):
                raise GrammarError(f'Not a set item: "{item.text}"', *item.at)
        return tuple(found)

    def reference(self) -> str:
        """The longest run of names that names a rule; a name that is no rule is left to the checks."""
        run = []
        while self.tokens[self.k + len(run)].kind == "name":
            run.append(self.tokens[self.k + len(run)].value)
        size = next((n for n in range(len(run), 0, -1) if " ".join(run[:n]) in self.names), 1)
        self.k += size
        return " ".join(run[:size])


def parse(source: str, modules: Mapping[str, str] | None = None) -> Program:
    """Read a grammar; modules gives the sources of the modules it uses."""
    uses, bodies, starts = [], {}, {}
    for lines in _statements(source):
        number, first = lines[0]
        header = _HEADER.match(first)
        if not header:
            tokens = _tokens(lines)
            if tokens[0].value != "use" or bodies:
                raise GrammarError("Expected a rule, `name: pattern`", *tokens[0].at)
            uses.append(_use(tokens))
            continue
        name = " ".join(header[1].split())
        if phrase(name):
            raise GrammarError(f"Rule name {name!r} is a word of the language", number, header.start(1) + 1)
        if name in bodies:
            raise GrammarError(f"Duplicate rule {name!r}", number, header.start(1) + 1)
        lines = [(number, " " * header.end() + first[header.end() :]), *lines[1:]]
        bodies[name], starts[name] = _tokens(lines), (number, header.end() + 1)
    if not bodies:
        raise GrammarError("Empty file: no rules defined", 1, 1)
    rules: dict[str, Expr] = {}
    for module, wanted, at in uses:
        if module not in (modules or {}):
            raise GrammarError(f'Unknown module "{module}"', *at)
        inner = parse(modules[module], None)
        for name in wanted:
            if name not in inner.rules:
                raise GrammarError(f'Module "{module}" has no rule {name!r}', *at)
        rules |= {n: inner.rules[n] for n in inner.rules if n in _reachable(inner, wanted) and n not in bodies}
    names = {*rules, *bodies}
    rules |= {name: _Reader(tokens, names, starts[name]).whole() for name, tokens in bodies.items()}
    return Program(rules, [*bodies][-1])


def _use(tokens: list[Token]) -> tuple[str, list[str], tuple[int, int]]:
    reader = _Reader(tokens, set(), tokens[0].at)
    reader.need("use")
    module = reader.need(kinds=("text",)).value
    reader.need("(")
    wanted = []
    while True:
        name = [reader.need(kinds=("name",)).value]
        while more := reader.take(kinds=("name",)):
            name.append(more.value)
        wanted.append(" ".join(name))
        if not reader.take(","):
            break
    reader.need(")")
    return module, wanted, tokens[0].at


def walk(expr: Expr):
    yield expr
    for part in expr.parts():
        yield from walk(part)


def _reachable(program: Program, names: list[str]) -> set[str]:
    seen, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in seen and name in program.rules:
            seen.add(name)
            todo += [e.name for e in walk(program.rules[name]) if isinstance(e, Ref)]
    return seen

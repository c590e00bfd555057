"""Facts about a program, and the checks it must pass."""

from __future__ import annotations

from .syntax import Any, Alt, Byte, Extract, GrammarError, Isnt, Joined, NoneOf, Program, Ref, Repeat, Seq, Text, Until, walk


def nullable_rules(program: Program) -> set[str]:
    """Rules that can match nothing."""
    found: set[str] = set()
    while True:
        more = {name for name, body in program.rules.items() if name not in found and nullable(body, found)}
        if not more:
            return found
        found |= more


def nullable(expr, rules: set[str]) -> bool:
    match expr:
        case Ref(name):
            return name in rules
        case Seq(elements):
            return all(nullable(e, rules) for e in elements)
        case Alt(options):
            return any(nullable(e, rules) for e in options)
        case Repeat(body, low, high):
            return low == 0 or high is not None and nullable(body, rules)
        case Joined(body) | Isnt(body) | Extract(body):
            return nullable(body, rules)
        case Until(_, end, including):
            return not including or nullable(end, rules)
    return False


def _leftmost(expr, rules: set[str]):
    """Rules that may be tried where expr begins."""
    match expr:
        case Ref(name):
            yield name
        case Seq(elements):
            for e in elements:
                yield from _leftmost(e, rules)
                if not nullable(e, rules):
                    break
        case Alt(options):
            for e in options:
                yield from _leftmost(e, rules)
        case Joined(body, separator):
            yield from _leftmost(body, rules)
            if nullable(body, rules):
                yield from _leftmost(separator, rules)
        case Repeat(body) | Extract(body):
            yield from _leftmost(body, rules)
        case Until(body, other) | Isnt(body, other):
            yield from _leftmost(other, rules)
            yield from _leftmost(body, rules)


def references(program: Program) -> dict[str, set[str]]:
    return {name: {e.name for e in walk(body) if isinstance(e, Ref)} for name, body in program.rules.items()}


def cycle(graph: dict[str, set[str]], start: str) -> bool:
    """Whether start can be reached from itself."""
    seen, todo = set(), [*graph.get(start, ())]
    while todo:
        name = todo.pop()
        if name == start:
            return True
        if name not in seen:
            seen.add(name)
            todo += graph.get(name, ())
    return False


def recursive(program: Program) -> bool:
    """Whether a rule that the entry needs is recursive."""
    graph = references(program)
    used, todo = set(), [program.entry]
    while todo:
        name = todo.pop()
        if name not in used:
            used.add(name)
            todo += graph[name]
    return any(cycle(graph, name) for name in used)


def high_bytes(expr) -> bool:
    """Whether a set of single bytes reaches beyond ASCII."""
    return any(isinstance(e, Byte) and max(e.bytes, default=0) > 127 for e in walk(expr))


def check(program: Program) -> Program:
    empty = nullable_rules(program)
    graph = {name: set(_leftmost(body, empty)) for name, body in program.rules.items()}
    for name, body in program.rules.items():
        for e in walk(body):
            if isinstance(e, Ref) and e.name not in program.rules:
                raise GrammarError(f"Undefined rule {e.name!r}", *e.at)
        points = next((e for e in walk(body) if isinstance(e, (Any, NoneOf))), None)
        if points is not None and high_bytes(body):
            raise GrammarError(f"Rule {name!r} mixes codepoint-aware patterns with bytes of 0x80 or above", *points.at)
        if cycle(graph, name):
            raise GrammarError(f"Left recursion in rule {name!r}", *body.at)
    return program


def endless(program: Program) -> bool:
    """Whether a loop's body can match nothing, which regular-expression engines treat in their own ways."""
    empty = nullable_rules(program)
    for body in program.rules.values():
        for e in walk(body):
            match e:
                case Repeat(inner, _, None) | Until(inner):
                    if nullable(inner, empty):
                        return True
                case Joined(inner, separator):
                    if nullable(inner, empty) and nullable(separator, empty):
                        return True
    return False


def literals(program: Program) -> list[str]:
    """Texts that every match contains: of the entry's sequence its literal elements, neighbours joined (for a cheap filter
    before it)."""

    def exact(expr, depth: int) -> str | None:
        """The one text that a pattern matches, if it is so."""
        match expr:
            case Text(text):
                return text
            case Byte(found) if len(found) == 1 and max(found) < 128:
                return chr(min(found))
            case Seq(elements):
                parts = [exact(e, depth) for e in elements]
                return None if None in parts else "".join(parts)
            case Extract(body):
                return exact(body, depth)
            case Repeat(body, low, high) if low == high:
                once = exact(body, depth)
                return None if once is None else once * low
            case Ref(name) if depth < 20:
                return exact(program.rules[name], depth + 1)
        return None

    def of(expr, depth: int) -> list[str]:
        if (whole := exact(expr, depth)) is not None:
            return [whole] if whole else []
        match expr:
            case Seq(elements):
                out, beside = [], False
                for e in elements:
                    one = exact(e, depth)
                    if one is None:
                        out += of(e, depth)
                    elif beside:
                        out[-1] += one
                    elif one:
                        out.append(one)
                    beside = one is not None and bool(out) and (beside or bool(one))
                return out
            case Repeat(body, low) if low > 0:
                return of(body, depth)
            case Joined(body) | Extract(body) | Isnt(body):
                return of(body, depth)
            case Until(_, end, True):
                return of(end, depth)
            case Ref(name) if depth < 20:
                return of(program.rules[name], depth + 1)
        return []

    return list(dict.fromkeys(of(program.rules[program.entry], 0)))

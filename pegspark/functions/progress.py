"""How far a sequence of simple patterns came in a text, as columns: results and reports without the matcher.

A grammar of one rule that is a sequence of characters of classes, loops over them, and literal texts either matches, or
stops in exactly one step: the first whose prefix of the sequence does not match the text's start. Where that step stopped,
and which loops before it ended at the same place, tells what was expected there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.lowering import Lowering, NotRegular, byte_set, lower
from ..plans.matcher import NAMED
from ..plans.syntax import Any, Byte, Expr, NoneOf, OneOf, Program, Repeat, Seq, Text
from . import arrow

#: Steps beyond which the matcher is the shorter way.
MOST = 16
END = "end of input"


@dataclass(frozen=True)
class Step:
    """One pattern of the sequence: what it was waiting for where it stops, and, of a loop, its least and most rounds."""

    regex: str
    labels: tuple[str, ...]
    text: str | None = None
    one: str | None = None
    low: int = 1
    high: int | None = 1

    @property
    def loop(self) -> bool:
        return self.one is not None


def steps(program: Program) -> list[Step]:
    """The sequence; NotRegular for any other grammar."""
    lower(program, False)
    body = program.rules[program.entry]
    found = [_step(program, e) for e in _flat(body)]
    if len(found) > MOST:
        raise NotRegular
    return found


def _flat(e: Expr) -> list[Expr]:
    return [x for part in e.elements for x in _flat(part)] if isinstance(e, Seq) else [e]


def _step(program: Program, e: Expr) -> Step:
    regex = Lowering(program, False).expr(e)
    match e:
        case Text(text) if text.isascii():
            return Step(regex, (f'"{text}"',), text)
        case Repeat(body, low, high):
            return Step(regex, _labels(body), None, Lowering(program, False).expr(body), low, high)
    return Step(regex, _labels(e))


def _labels(e: Expr) -> tuple[str, ...]:
    """What a pattern of one character waits for."""
    match e:
        case Byte(_, label):
            return (label,)
        case Any():
            return ("any character",)
        case NoneOf(items) if byte_set(items) is not None and all(isinstance(x, Byte) for x in items):
            return ("none of (...)",)
        case OneOf(options) if all(isinstance(x, Byte) for x in options):
            return tuple(x.label for x in options)
    raise NotRegular


def result(program: Program, text: Column, partial: bool) -> Column:
    """The struct of `match`, or with partial of `try_parse`."""
    sequence, entry = steps(program), program.entry
    starts = [""]
    for step in sequence:
        starts.append(starts[-1] + step.regex)
    done = [F.regexp_extract(text, rf"\A(?:{s})", 0) if s else F.lit("") for s in starts]
    whole = _struct(text, entry, F.lit(True), text, None, None, partial)
    found = F.when(text.rlike(rf"\A(?:{starts[-1]})\z"), whole)
    for k in range(len(sequence), -1, -1):
        stop, labels = _stop(text, sequence, starts, done, k)
        failed = _struct(text, entry, F.lit(False), done[k], stop, labels, partial)
        found = found.when(text.rlike(rf"\A(?:{starts[k]})"), failed) if k else found.when(text.isNotNull(), failed)
    return found.cast(f"struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _fields())}>")


def _fields() -> list[str]:
    names = arrow.RESULT.replace(arrow.NODES, "\0").replace(arrow.EXTRACTS, "\1").split(", ")
    return [n.replace("\0", arrow.NODES).replace("\1", arrow.EXTRACTS) for n in names]


def _stop(text: Column, sequence: list[Step], starts: list[str], done: list[Column], k: int) -> tuple[Column, Column]:
    """The part of the text before the furthest failure when k steps matched, and what was expected there, sorted."""
    if k == len(sequence):
        stop, labels = done[k], (END,)
    else:
        step, labels = sequence[k], sequence[k].labels
        if step.text is not None:
            rest = F.substring(text, F.length(done[k]) + 1, F.lit(len(step.text)))
            same = "".join(f"(?:{_sign(c)}" for c in step.text) + ")?+" * len(step.text)
            enough = F.octet_length(text) - F.octet_length(done[k]) >= len(step.text)
            stop = F.when(enough, F.concat(done[k], F.regexp_extract(rest, rf"\A{same}", 0))).otherwise(done[k])
        elif step.loop:
            stop = F.regexp_extract(text, rf"\A(?:{starts[k]})(?:{step.one}){{0,{max(0, step.low - 1)}}}+", 0)
        else:
            stop = done[k]
    wanted = [F.array(*map(F.lit, labels))]
    for j in range(k, 0, -1):
        before = sequence[j - 1]
        if before.loop:
            ended = F.length(done[j]) == F.length(stop)
            if before.high is not None:
                ended &= F.length(done[j]) - F.length(done[j - 1]) < before.high
            wanted.append(F.when(ended, F.array(*map(F.lit, before.labels))).otherwise(F.array().cast("array<string>")))
    return stop, F.array_sort(F.array_distinct(F.concat(*wanted)))


def _sign(c: str) -> str:
    return rf"\x{ord(c):02X}"


def _struct(text: Column, entry: str, matched: Column, consumed: Column, stop: Column | None, labels: Column | None, partial: bool) -> Column:
    size = F.octet_length(consumed)
    root = F.struct(F.lit(0).alias("id"), F.lit(-1).alias("parent"), F.lit(0).alias("depth"), F.lit(entry).alias("rule"), F.lit(0).alias("start"), size.alias("end"), consumed.alias("text"))
    null = F.lit(None)
    values: dict[str, Column] = {"matched": matched, "consumed": size, "nodes": null, "extracts": null, "offset": null, "line": null, "column": null, "expected": null, "found": null, "rule_stack": null}
    if stop is None or partial:
        some = F.array(root) if stop is None else F.when(size > 0, F.array(root)).otherwise(F.array().cast(arrow.NODES))
        values |= {"nodes": some, "extracts": F.array().cast(arrow.EXTRACTS)}
    if stop is not None:
        line = F.substring_index(stop, "\n", -1)
        inside = (F.octet_length(stop) > 0) & ((F.size(labels) > 1) | (F.element_at(labels, 1) != END))  # not with the rule behind it
        stack = F.when(inside, F.array(F.lit(entry))).otherwise(F.array().cast("array<string>"))
        values |= {
            "offset": F.octet_length(stop), "line": F.length(stop) - F.length(F.replace(stop, F.lit("\n"), F.lit(""))) + 1, "column": F.octet_length(line) + 1,
            "expected": labels, "found": _described(F.substring(text, F.length(stop) + 1, F.lit(1))), "rule_stack": stack,
        }
    kinds = dict(c.split(" ", 1) for c in _fields())
    return F.struct(*(v.cast(kinds[n]).alias(n) for n, v in values.items()))


def _described(sign: Column) -> Column:
    """A character as a report says it, by its first byte."""
    code = F.hex(F.substring(F.encode(sign, "UTF-8"), 1, 1))
    names = F.create_map(*(F.lit(x) for c, name in NAMED.items() for x in (f"{ord(c):02X}", name)))
    shown = F.concat(F.lit('"'), sign, F.lit('" (0x'), code, F.lit(")"))
    return F.when(sign == "", END).when(sign.between(" ", "~") & (F.octet_length(sign) == 1), shown).otherwise(F.coalesce(names[code], F.concat(F.lit("byte 0x"), code)))


def report(program: Program, text: Column) -> Column:
    """The report of a text that does not match, as text; null for one that does."""

    def said(got: Column) -> Column:
        expected = got["expected"]
        n = F.size(expected)
        listed = F.when(n > 3, F.concat(F.array_join(F.slice(expected, 1, n - 1), ", "), F.lit(", or "), F.element_at(expected, -1))).otherwise(F.array_join(expected, ", "))
        before = F.length(F.substring_index(_head(text, got["offset"]), "\n", -1))
        place = F.length(_head(text, got["offset"])) - before
        line = F.substring_index(F.substr(text, place + 1), "\n", 1)
        lines = [
            F.format_string("match failed at byte %d (line %d, column %d):", got["offset"], got["line"], got["column"]),
            F.concat(F.lit("  expected: "), listed),
            F.concat(F.lit("  found: "), got["found"]),
            F.when(F.size(got["rule_stack"]) > 0, F.concat(F.lit("  in: "), F.array_join(got["rule_stack"], " > "))),
            F.when(text != "", F.concat(F.lit("\n  "), line, F.lit("\n  "), F.repeat(F.lit(" "), before), F.lit("^"))),
        ]
        return F.when(~got["matched"], F.concat_ws("\n", *lines))

    return F.get(F.transform(F.array(result(program, text, False)), said), F.lit(0))


def _head(text: Column, size: Column) -> Column:
    """The first bytes of a text, which end where a character does."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), size), "UTF-8")

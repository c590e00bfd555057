"""Trees, extracts, failures, partial results and hits."""

import random

import pytest

from pegspark.functions import arrow
from pegspark.functions import text as drawn
from pegspark.plans import analysis, lowering, matcher
from pegspark.plans.syntax import parse


def whole(source, text):
    return matcher.whole(matcher.Matcher(analysis.check(parse(source))), text.encode())


def nodes(source, text):
    got = whole(source, text)
    return [(n["depth"], n["rule"], n["text"]) for n in arrow.flat(got["nodes"], text.encode())]


def extracts(source, text):
    got = whole(source, text)
    return [(r, text.encode()[a:b].decode()) for r, a, b, _ in got["extracts"]]


def hits(source, text):
    m = matcher.Matcher(analysis.check(parse(source)))
    return [text.encode()[a:b].decode() for a, b, _, _ in matcher.hits(m, text.encode())]


def test_tree():
    assert nodes("tok: one or more letters\nmain: tok then hyphen then tok", "abc-def") == [(0, "main", "abc-def"), (1, "tok", "abc"), (1, "tok", "def")]
    assert nodes("a: digit\nb: a\nmain: b", "1") == [(0, "main", "1"), (1, "b", "1"), (2, "a", "1")]
    assert nodes("d: digit\nmain: d joined by comma lenient", "1,2,") == [(0, "main", "1,2,"), (1, "d", "1"), (1, "d", "2")]


@pytest.mark.parametrize(
    "source, text, expected",
    [
        ('num: one or more digits\nmain: "value=" then extract num', "value=42", [("num", "42")]),
        ("main: ((extract letter) then letter then digit) or letter then letter then comma", "ab,", []),
        ("main: one or more (extract digit)", "12", [("<extract>", "1"), ("<extract>", "2")]),
        ("main: extract one or more digits", "12", [("<extract>", "12")]),
        ("pair: extract letter then digit\nmain: pair then pair", "a1b2", [("<extract>", "a"), ("<extract>", "b")]),
        ("main: (optional (extract letter then digit)) then letter", "a", []),
    ],
)
def test_extracts(source, text, expected):
    assert extracts(source, text) == expected


def test_failures():
    got = whole("main: letter then digit", "ax")
    assert (got["offset"], got["found"], got["expected"], got["rule_stack"]) == (1, '"x" (0x78)', ["digit"], ["main"])
    assert whole("main: letter then digit", "a")["found"] == "end of input"
    assert whole("main: one or more (letter or newline)", "ab\nc1")["line"] == 2
    assert whole("main: digit", "12")["expected"] == ["end of input"]
    assert whole("main: any character isn't comma", ",")["expected"] == ["not comma"]
    assert whole('main: "abc" or "abd"', "abx")["expected"] == ['"abc"', '"abd"']
    report = whole("main: letter then digit", "éx")
    assert report["offset"] == 0 and report["found"] == "byte 0xC3"
    text = "ab\ncé!"
    got = whole("main: one or more (letter or newline or byte 0xC3 or byte 0xA9)", text)
    assert drawn.failure(got, text.encode()).endswith("  cé!\n    ^")


def test_partial():
    got = whole("main: one or more letters then one or more digits", "abc")
    assert (got["consumed"], got["offset"], got["nodes"][0][:3]) == (3, 3, ("main", 0, 3))
    got = whole("main: (extract one or more letters) then digit then comma", "ab1;")
    assert got["consumed"] == 3 and [e[1:3] for e in got["extracts"]] == [(0, 2)]


def test_hits():
    assert hits("main: one or more digits", "a1b22c333") == ["1", "22", "333"]
    assert hits("main: zero or more digits", "a1b") == ["1"]
    assert hits('main: "a" or "bc"', "xbca") == ["bc", "a"]
    assert hits("main: none of (comma)", "é,🎉") == ["é", "🎉"]


NESTED = "main: open paren then optional main then close paren"


@pytest.mark.parametrize("n", [300_000, 1_000_000])
def test_hits_of_long_unclosed_runs(n):
    """One pass whatever the length: what is known of a place is kept until the search has passed it."""
    import time

    m, began = matcher.Matcher(analysis.check(parse(NESTED))), time.perf_counter()
    assert [h[:2] for h in matcher.hits(m, b"(" * n + b"x(())")] == [(n + 1, n + 5)]
    assert time.perf_counter() - began < 60
    assert not any(m.known[True].values())


def test_depth_costs_no_frames():
    import sys

    limit, m = sys.getrecursionlimit(), matcher.Matcher(analysis.check(parse(NESTED)))
    got = matcher.whole(m, b"(" * 50_000 + b"x")
    assert (got["offset"], len(got["rule_stack"]), got["expected"]) == (50_000, 50_001, ["close paren", "open paren"])
    assert sys.getrecursionlimit() == limit < 10_000


def test_set_aside_is_the_same(monkeypatch):
    """Whatever number of rules may be open at once, results and reports are those of plain recursion."""
    grammars = [
        "word: one or more lowercase\nlist: open paren then (item joined by comma) then close paren\nitem: list or word\nmain: item",
        "quiet: open paren then optional quiet then close paren\nmain: any character isn't quiet then optional main",
        "a: \"a\" then optional b\nb: open paren then zero or more a then close paren\nmain: extract b or one or more (extract a)",
    ]
    rng = random.Random(3)
    for source in grammars:
        program = analysis.check(parse(source))
        for _ in range(150):
            text = "".join(rng.choice("(((a)),") for _ in range(rng.randint(0, 14))).encode()
            seen = []
            for levels in (1, 2, 3, 1000):
                monkeypatch.setattr(matcher, "LEVELS", levels)
                m = matcher.Matcher(program)
                seen.append((matcher.whole(m, text), matcher.hits(m, text), matcher.prefix(m, text)))
            assert all(x == seen[-1] for x in seen), (source, text)


def test_tree_text():
    got = whole("tok: one or more letters\nmain: tok then hyphen then tok", "ab-c")
    assert drawn.tree(arrow.flat(got["nodes"], b"ab-c")) == 'main [0..4] "ab-c"\n├── tok [0..2] "ab"\n└── tok [3..4] "c"'


ATOMS = ["letter", "digit", '"a"', '"b"', '"ab"', "comma", "any character", "none of (comma)", 'any of ("a", digit)', 'letter except ("b")', '"a" to "c"']


def random_expression(rng, depth):
    if depth == 0:
        return rng.choice(ATOMS)
    one = lambda: f"({random_expression(rng, rng.randint(0, depth - 1))})"
    return rng.choice(
        [
            lambda: f"{one()} then {one()}",
            lambda: f"{one()} or {one()}",
            lambda: f"one or more {one()}",
            lambda: f"zero or more {one()}",
            lambda: f"optional {one()}",
            lambda: f"2 {one()}",
            lambda: f"between 1 and 2 {one()}",
            lambda: f"{one()} joined by {one()}",
            lambda: f"{one()} joined by {one()} lenient",
            lambda: f"{one()} until including {one()}",
            lambda: f"{one()} until excluding {one()}",
            lambda: f"{one()} isn't {one()}",
        ]
    )()


def random_cases(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        source = f"main: {random_expression(rng, 3)}"
        yield source, ["".join(rng.choice("ab1,é") for _ in range(rng.randint(0, 8))) for _ in range(8)]


def test_regex_agrees_with_matcher():
    import re

    compared = 0
    for source, texts in random_cases(1500, 5):
        program = analysis.check(parse(source))
        try:
            pattern = re.compile(lowering.lower(program)[0])
        except lowering.NotRegular:
            continue
        m = matcher.Matcher(program)
        for text in texts:
            m.begin(text.encode())
            got = m.entry(0)
            found = pattern.match(text)
            assert (None if found is None else len(found[0].encode())) == (None if got is None else got[0]), (source, text)
            if not lowering.can_be_empty(program):
                assert [x[0] for x in pattern.finditer(text)] == [text.encode()[a:b].decode() for a, b, _, _ in matcher.hits(m, text.encode())], (source, text)
            compared += 1
    assert compared > 4000

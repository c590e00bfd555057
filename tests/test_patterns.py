"""Accept and reject, by both plans; each case is (grammar, accepted, rejected)."""

import re

import pytest

from pegspark.plans import analysis, lowering, matcher
from pegspark.plans.syntax import GrammarError, parse
from pegspark.plans.vocabulary import CHARACTERS, CLASSES, class_bytes

CASES = [
    ("main: one or more digits then digit", [], ["123"]),
    ("main: letter then letter or digit", ["ab", "5"], ["a", "a5"]),
    ("main: 4 any characters", ["café", "🎉abc"], ["caf", "cafés"]),
    ("main: digit joined by comma", ["1", "1,2"], ["1,2,", ""]),
    ("main: digit joined by comma lenient", ["1,2,", "1"], [",", "1,,"]),
    ("main: zero or more (zero or more letters)", ["", "abc"], ["1"]),
    ("main: one or more (zero or more letters)", ["abc"], [""]),
    ('main: any character until including "x"', ["abcx", "x"], ["abc", "xa"]),
    ('main: (any character until excluding "x") then "x"', ["x", "ax"], ["a"]),
    ('main: one or more (any character isn\'t "END") then "END"', ["helloEND"], ["END", "hello"]),
    ("main: byte 0xC3 then byte 0xA9", ["é"], ["e", "è"]),
    ("main: byte 0xC3 then byte 0x80 to byte 0xBF", ["é", "è"], ["e"]),
    ("octet: between 1 and 3 digits\nmain: octet joined by period", ["192.168.1.1"], ["192.", "1921.1"]),
    ("main: open paren then zero or more main then close paren", ["()", "(())", "(()())"], ["(()", ")"]),
    ('main: ("ab" or "a") then optional "bc"', ["ab", "abbc", "a"], ["abc"]),
    ('main: ("ab" or "a") then "c"', ["abc", "ac"], ["ab"]),
    ('main: "a" or "bc"', ["a", "bc"], ["b"]),
    ('main: "é"', [], ["é", "e"]),
    ('main: "éa"', ["éa"], ["e"]),
    ("main: none of (double quote, newline)", ["a", "é", "\0"], ['"', "\n", ""]),
    ("main: any character except (comma)", ["é", "a"], [",", "ab"]),
    ("main: letter except (\"q\", uppercase)", ["a"], ["q", "A"]),
    ("main: one digit or more", ["1", "12"], ["", "a"]),
    ("main: between 2 and 3 letters", ["ab", "abc"], ["a", "abcd"]),
    ("main: optional hyphen then digit", ["-1", "1"], ["--1"]),
    ("main: one or more of (letter, digit, underscore)", ["a_1"], ["", "-"]),
    ("main: one or more characters except (double quote, newline)", ["é!"], ['a"']),
    ('main: digit isn\'t "0"', ["1"], ["0"]),
    ('main: one or more digits isn\'t "0"', ["10"], ["01"]),
    ("main: any of (letter, digit, \"-\", \"0\" to \"5\")", ["a", "-"], ["_"]),
    ("token char: letter or digit\nquoted value: double quote then one or more token char then double quote\nmain: token char or quoted value", ["a", '"a1"'], ['"a']),
    ("a: digit -- comment\n\nmain: a\n  then a\n  then \"--\"", ["12--"], ["12"]),
    ("main: key\n  , equals, key\nkey: one or more letters\nlast: main", ["a=b"], ["a="]),
    ("main: 0 digits", [""], ["1"]),
    ("main: zero or more any characters", ["", "a\nb"], []),
    ("main: \"a\" then extract one or more digits", ["a12"], ["a"]),
    ("main: whitespace", [" ", "\t", "\n", "\r"], ["\x0b", "\x0c"]),
]


def accepts(source, text):
    program = analysis.check(parse(source))
    m = matcher.Matcher(program)
    m.begin(text.encode())
    got = m.entry(0)
    by_matcher = got is not None and got[0] == len(text.encode())
    try:
        pattern, _ = lowering.lower(program)
    except lowering.NotRegular:
        return by_matcher
    subject = text.encode().decode("latin-1") if lowering.needs_bytes(program) else text
    assert (re.fullmatch(pattern, subject) is not None) == by_matcher, (pattern, text)
    return by_matcher


@pytest.mark.parametrize("source, yes, no", CASES)
def test_accepts(source, yes, no):
    assert [t for t in yes if not accepts(source, t)] == []
    assert [t for t in no if accepts(source, t)] == []


@pytest.mark.parametrize("name", CHARACTERS)
def test_named_characters(name):
    assert accepts(f"main: {name}", CHARACTERS[name])
    assert not accepts(f"main: {name}", "a")


@pytest.mark.parametrize("name", CLASSES)
def test_class_members(name):
    members = {chr(b) for b in range(128) if accepts(f"main: {name}", chr(b))}
    assert members == {chr(b) for b in class_bytes(name)}


@pytest.mark.parametrize(
    "source, message",
    [
        ("main: main then digit", "Left recursion"),
        ("main: (zero or more letters) then main", "Left recursion"),
        ("a: b\nb: a\nmain: a", "Left recursion"),
        ("main: digit until including main", "Left recursion"),
        ("main: any character then byte 0x80 to byte 0xFF", "mixes codepoint-aware"),
        ("a: digit\na: letter", "Duplicate rule"),
        ("main: nothing", "Undefined rule"),
        ('main: "z" to "a"', "inverted"),
        ("main: between 3 and 2 digits", "between 3 and 2"),
        ('main: ""', "Empty quoted text"),
        ('main: "abc', "Unterminated"),
        ("main: digit $ digit", "Unexpected character"),
        ("main: digit until letter", '"including" or "excluding"'),
        ("main: 2 digits or more", 'only valid with "one"'),
        ("", "Empty file"),
        ("main: one or more characters", '"except"'),
        ('main: any of ("ab")', "Not a set item"),
        ("main: digit digit", "Unexpected"),
        ("digit one or more", "Expected a rule"),
        ("digit: one or more letters", "is a word of the language"),
        ('use "x" (a)\nmain: a', "Unknown module"),
    ],
)
def test_refused(source, message):
    with pytest.raises(GrammarError, match=re.escape(message)) as e:
        analysis.check(parse(source))
    assert e.value.line >= 1 and e.value.column >= 1


def test_modules():
    modules = {"mail": "name part: one or more letters\ndomain: name part joined by period\nunused: digit"}
    program = analysis.check(parse('use "mail" (domain)\nmain: letter then at then domain', modules))
    assert list(program.rules) == ["name part", "domain", "main"]
    with pytest.raises(GrammarError, match="has no rule"):
        parse('use "mail" (host)\nmain: host', modules)


def test_joined_by_of_empty_parts_ends():
    assert accepts("main: (zero or more letters) joined by (optional comma)", "a,b")
    assert accepts("main: (zero or more letters) joined by (optional comma)", "")


def test_deep_recursion(monkeypatch):
    nested = "main: open paren then optional main then close paren"
    assert accepts(nested, "(" * 200_000 + ")" * 200_000)
    m = matcher.Matcher(analysis.check(parse(nested)))
    monkeypatch.setattr(matcher, "DEEPEST", 50)
    assert matcher.accepts(m, b"(" * 49 + b")" * 49) and not matcher.accepts(m, b"(" * 50 + b")" * 50)
    assert matcher.prefix(m, b"(" * 60 + b")" * 60) == -1
    report = matcher.whole(m, b"(" * 60 + b")" * 60)
    assert not report["matched"] and report["offset"] == 50 and report["expected"] == ["at most 50 rules within rules"] and report["nodes"] == ()
    assert [h[:2] for h in matcher.hits(m, b"(" * 60 + b")" * 60 + b"()")] == [(11, 109), (120, 122)]
    assert matcher.whole(m, b"()")["matched"]

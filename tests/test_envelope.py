"""The condition that the JVM asks before a recursive grammar's matcher never turns away what the matcher accepts."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_matcher import random_expression

from pegspark.functions import Grammar
from pegspark.plans import analysis, envelope, lowering, matcher
from pegspark.plans.syntax import GrammarError, parse

NESTED = "main: open paren then optional main then close paren"


@pytest.mark.parametrize(
    "source, begins",
    [
        (NESTED, r"\x28[\x28-\x29]"),
        ('word: 2 lowercase\nmain: "x" then (word or main) then digit', r"\x78[\x61-\x7A][\x61-\x7A][\x30-\x39\x61-\x7A]"),
        ("main: one or more any characters", None),
        ('item: digit or list\nlist: open bracket then (item joined by comma) then close bracket\nmain: list', r"\x5B[\x30-\x39\x5B][\x2C\x30-\x39\x5B\x5D]"),
    ],
)
def test_beginnings(source, begins):
    got = envelope.beginning(analysis.check(parse(source)))
    assert got == begins


def test_never_turns_away():
    rng, kept, seen = random.Random(9), 0, 0
    for _ in range(700):
        inner = random_expression(rng, 2)
        source = f"main: {rng.choice(ATOMS)} then optional ({rng.choice(['main', 'main then main', f'({inner}) then main'])}) then ({random_expression(rng, 1)})"
        try:
            program = analysis.check(parse(source))
        except GrammarError:
            continue
        begins, literal = envelope.beginning(program), envelope.rarest(program)
        start = re.compile(begins or "")
        m = matcher.Matcher(program)
        for _ in range(12):
            text = "".join(rng.choice("ab1,é(") for _ in range(rng.randint(0, 10)))
            for a, b, *_ in matcher.hits(m, text.encode()):
                hit = text.encode()[a:b].decode()
                assert start.match(hit) and (literal is None or literal in hit), (source, hit, begins, literal)
                seen += 1
            kept += bool(start.search(text))
    assert seen > 500


ATOMS = ["letter", "digit", '"a"', "comma", 'any of ("a", digit)', '"ab"']


def test_python_sees_few_rows(spark):
    """Texts that cannot have a hit are not sent to Python, and get the same answers."""
    g = Grammar('item: one or more lowercase or list\nlist: open bracket then (item joined by comma) then close bracket\nmain: list')
    assert not g.native
    texts = ["[a,[b,c]]", "none [", "x]", "", None, "[[]", "see [a] and [b,[c]]", "[1]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = df.select(g._likely(t, True).alias("l"), g.is_match(t).alias("m"), g.count(t).alias("n"), g.prefix_length(t).alias("p"), g.has_hit(t).alias("h"), g.find(t, tree=True).alias("f")).collect()
    m = matcher.Matcher(g.program)
    for text, r in zip(texts, rows):
        if text is None:
            assert r["l"] and r["m"] is None and r["n"] is None and r["p"] is None and r["f"] is None
            continue
        hits = matcher.hits(m, text.encode())
        assert (r["m"], r["n"], r["p"], r["h"], len(r["f"])) == (matcher.accepts(m, text.encode()), len(hits), matcher.prefix(m, text.encode()), bool(hits), len(hits))
        assert r["l"] or not hits
    assert sum(r["l"] for r in rows) <= 4
    assert lowering.can_be_empty(g.program) is False

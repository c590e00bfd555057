"""A recursion through a pair of signs runs inside the JVM and says what the matcher says."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_columns import plan_of
from test_matcher import NESTED, random_expression

from pegspark.functions import Grammar, arrow
from pegspark.plans import matcher
from pegspark.plans.syntax import GrammarError
from pegspark.queries import QUERIES

GRAMMARS = [
    NESTED,
    "item: one or more digits\nmain: open paren then (item or main) then close paren",
    'main: "(" then optional (main or one or more none of ("(", ")")) then ")"',
    'main: any of ("(", "[") then optional (main or one or more of (lowercase, ")")) then any of (")", "]")',
    'open: "("\nword: lowercase then optional "("\nmain: extract open then (main or (word isn\'t "ab")) then extract (digit except ("9"))',
    "main: lowercase then optional main then digit",
    'main: "(" then optional (main or (lowercase then (any character until excluding "1)"))) then digit',
]


def some(seed, count):
    rng, out = random.Random(seed), []
    while len(out) < count:
        core = random_expression(rng, 2)
        inside = rng.choice([f"(main or ({core}))", f"(({core}) or main)", f"optional (main or ({core}))"])
        try:
            g = Grammar(f"main: {rng.choice(['open paren', 'any of (open paren, open bracket)'])} then {inside} then {rng.choice(['close paren', 'digit', 'comma'])}")
        except GrammarError:
            continue
        if g.pairs is not None:
            out.append(g.source)
    return out


def texts(seed):
    rng = random.Random(seed)
    out = ["".join(rng.choice(rng.choice(["()", "(((1", ")))a", "()[]ab19,é🎉"])) for _ in range(rng.randint(0, 16))) for _ in range(250)]
    return [*out, "((((" * 9 + "1)))", "(" * 30 + "ab" + ")" * 40, "é🎉((a))🎉((1))()(", None, ""]


def check(spark, source, seed):
    g, t = Grammar(source), F.col("t")
    assert not g.native and g.pairs is not None
    found = [g.is_match(t).alias("m"), g.prefix_length(t).alias("p"), g.has_hit(t).alias("h"), g.count(t).alias("n"), *(g.find(t, unit=u).alias(u) for u in ("codepoint", "utf16", "byte"))]
    df = spark.createDataFrame([(x,) for x in texts(seed)], "t string").select("t", *found, g.match_many(F.array(t)).alias("e"))
    assert "Python" not in plan_of(df)
    m, hits = matcher.Matcher(g.program), 0
    for r in df.collect():
        if r["t"] is None:
            assert all(r[c] is None for c in ("m", "p", "h", "codepoint", "byte")) and r["e"] == [None]
            continue
        data = r["t"].encode()
        for unit in ("codepoint", "utf16", "byte"):
            assert [x.asDict() for x in r[unit]] == arrow.find_one(g.key, r["t"], unit), (source, r["t"])
        spans = matcher.hits(m, data)
        assert (r["m"], r["p"], r["h"], r["n"], r["e"]) == (matcher.accepts(m, data), matcher.prefix(m, data), bool(spans), len(spans), [matcher.accepts(m, data)]), (source, r["t"])
        hits += len(spans)
    return hits


@pytest.mark.parametrize("source", GRAMMARS)
def test_says_what_the_matcher_says(spark, source):
    assert check(spark, source, 4) > 5


def test_random_grammars(spark):
    assert sum(check(spark, source, 5) for source in some(6, 8)) > 50


@pytest.mark.parametrize(
    "source",
    [
        "main: open paren then zero or more main then close paren",
        "main: open paren then (main joined by comma) then close paren",
        "main: open paren then main then close paren",
        "main: letter then optional main then alphanumeric",
        "main: open paren then optional (main or open paren) then close paren",
        "main: open paren then (zero or more digits or main) then close paren",
        "main: open paren then optional (main or any character) then close paren",
        'main: "begin" then optional main then "end"',
        "item: open bracket then main then close bracket\nmain: open paren then (main or item) then close paren",
        "main: byte 0xC3 then optional main then close paren",
        "main: open paren then digit then close paren",
    ],
)
def test_other_recursion_is_left_to_the_matcher(source):
    assert Grammar(source).pairs is None


def test_too_deep(spark, monkeypatch):
    """The same depth is refused, also where the opening sign is a rule of its own."""
    monkeypatch.setattr(matcher, "DEEPEST", 8)
    for source in (NESTED, 'open: "("\nmain: open then optional main then ")"', 'word: digit\nmain: "(" then optional (main or word) then ")"'):
        g, t = Grammar(source), F.col("t")
        m, data = matcher.Matcher(g.program), ["(" * n + inside + ")" * k + "()" for n in range(5, 11) for k in range(5, 11) for inside in ("", "1")]
        rows = spark.createDataFrame([(x,) for x in data], "t string").select("t", g.is_match(F.expr("left(t, length(t) - 2)")).alias("m"), g.prefix_length(t).alias("p"), g.find(t).alias("f")).collect()
        for r in rows:
            assert r["m"] == matcher.accepts(m, r["t"][:-2].encode()) and r["p"] == matcher.prefix(m, r["t"].encode())
            assert [(h["start"], h["end"]) for h in r["f"]] == [h[:2] for h in matcher.hits(m, r["t"].encode())], (source, r["t"])


def test_long_runs(spark):
    """Runs of a million signs, closed and not, take one pass; deep texts are no slower for each sign."""
    g, t = Grammar(NESTED), F.col("t")
    df = spark.sql("SELECT repeat('(', 999999) || repeat(')', 999999 + id) || repeat('(', 900000) || 'x((' || repeat(')', 3) AS t FROM range(3)")
    began = time.perf_counter()
    rows = df.select(g.is_match(t).alias("m"), g.prefix_length(t).alias("p"), F.transform(g.find(t), lambda h: F.struct(h["start"], h["end"], F.length(h["text"]))).alias("f")).collect()
    assert [(r["m"], r["p"]) for r in rows] == [(False, 1_999_998)] * 3
    assert [[tuple(h) for h in r["f"]] for r in rows] == [[(0, 1_999_998, 1_999_998), (2_899_999 + k, 2_900_003 + k, 4)] for k in range(3)]
    assert time.perf_counter() - began < 60


def test_query_finds_hits_once(spark, tables):
    """Each of the four groups that a search takes stands in the plan once, so no filter searches again."""
    plan = QUERIES["recursive_hits"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and plan.count("regexp_extract_all") == 4

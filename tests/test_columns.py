"""Columns, operators, sources and streams on Spark."""

import os
import re

import pytest
from pyspark.sql import functions as F

from pegspark.functions import Catalogue, Grammar, arrow, register
from pegspark.functions.sql import register_grammar
from pegspark.plans import analysis, matcher
from pegspark.plans.syntax import parse
from pegspark.operators import format_results, hits, search_hits, search_lines
from pegspark.sources import numbered, read_folder, search_folder, search_folder_hits, search_lines_of
from pegspark.streaming import number_lines, numbered_writer, search_numbered, search_stream

from test_matcher import random_cases

DIGITS = Grammar("main: one or more digits")


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(0, "a1b22 café42 🎉 7"), (1, "abc"), (2, None), (3, ""), (4, "99")], "id int, t string")


def test_native_columns(texts):
    t = F.col("t")
    got = values(texts.select(DIGITS.is_match(t), DIGITS.has_hit(t), DIGITS.texts(t), DIGITS.count(t), DIGITS.prefix_length(t)).orderBy("id"))
    assert got == [
        (False, True, ["1", "22", "42", "7"], 4, -1),
        (False, False, [], 0, -1),
        (None, None, None, None, None),
        (False, False, [], 0, -1),
        (True, True, ["99"], 1, 2),
    ]
    assert DIGITS.native and DIGITS.native_hits


def test_spans_in_three_units(texts):
    row = texts.filter("id = 0")
    spans = lambda unit: [(h["start"], h["end"], h["text"]) for h in row.select(DIGITS.find(F.col("t"), unit=unit)).first()[0]]
    assert spans("codepoint") == [(1, 2, "1"), (3, 5, "22"), (10, 12, "42"), (15, 16, "7")]
    assert spans("utf16") == [(1, 2, "1"), (3, 5, "22"), (10, 12, "42"), (16, 17, "7")]
    assert spans("byte") == [(1, 2, "1"), (3, 5, "22"), (11, 13, "42"), (19, 20, "7")]
    assert texts.filter("id = 2").select(DIGITS.find(F.col("t"), unit="byte")).first()[0] is None


def test_trees_of_hits(spark):
    texts = spark.createDataFrame([("é 1-2, 34-5 x",), ("none",), (None,)], "t string")
    g = Grammar("num: one or more digits\nmain: num then hyphen then num")
    for unit in ("codepoint", "byte", "utf16"):
        got = [r[0] for r in texts.select(g.find(F.col("t"), tree=True, unit=unit)).collect()]
        assert got[1:] == [[], None]
        assert [(n["parent"], n["rule"], n["start"], n["end"], n["text"]) for n in got[0][1]["nodes"]] == [(-1, "main", 8, 12, "34-5"), (0, "num", 8, 10, "34"), (0, "num", 11, 12, "5")]


def test_hit_columns(spark):
    df = spark.createDataFrame([("a\né1 22\n",)], "t string")
    assert sorted(values(search_hits(df, DIGITS, "t"))) == [("<stdin>", 2, 2, 3), ("<stdin>", 2, 4, 6)]


def test_replace_and_special_characters(spark):
    df = spark.createDataFrame([("a1b22",)], "t string")
    assert values(df.select(DIGITS.replace(F.col("t"), "$<", "\\>"), DIGITS.replace(F.col("t"), with_text="$1"))) == [("a$<1\\>b$<22\\>", "a$1b$1")]


def test_match_struct_and_nulls(spark):
    g = Grammar("num: one or more digits\nmain: one or more letters then extract num")
    df = spark.createDataFrame([("abc12",), ("abc",), (None,)], "t string")
    got = [r[0] for r in df.select(g.match(F.col("t"))).collect()]
    assert got[0]["matched"] and [n["rule"] for n in got[0]["nodes"]] == ["main", "num"] and got[0]["extracts"][0]["text"] == "12"
    assert not got[1]["matched"] and got[1]["nodes"] is None and got[1]["expected"] == ["digit", "letter"] and got[2] is None
    partial = [r[0] for r in df.select(g.try_parse(F.col("t"))).collect()]
    assert partial[1]["nodes"][0]["text"] == "abc" and partial[1]["consumed"] == 3
    assert [r[0] for r in df.select(g.extract(F.col("t"))).collect()] == [["12"], None, None]
    assert values(df.select(*g.extract_columns(F.col("t"), ["n"]))) == [("12",), (None,), (None,)]
    assert df.select(g.diagnose(F.col("t"))).collect()[0][0] is None
    with pytest.raises(ValueError, match="1 extracts"):
        g.extract_columns(F.col("t"), ["a", "b"])


def test_recursive_and_byte_grammars(spark):
    g = Grammar("group: open paren then zero or more group then close paren\nmain: one or more group")
    df = spark.createDataFrame([("(())()",), ("(()",), (None,)], "t string")
    assert [r[0] for r in df.select(g.is_match(F.col("t"))).collect()] == [True, False, None]
    assert not g.native
    accent = Grammar("main: byte 0xC3 then byte 0xA9")
    df = spark.createDataFrame([("é",), ("e",)], "t string")
    assert [r[0] for r in df.select(accent.is_match(F.col("t"))).collect()] == [True, False]
    assert [r[0] for r in df.select(accent.prefix_length(F.col("t"))).collect()] == [2, -1]
    raw = spark.createDataFrame([(bytearray(b"\xff\xc3\xa9\xc3"),), (None,)], "b binary")
    got = [r[0] for r in raw.select(accent.scan_bytes(F.col("b"))).collect()]
    assert [(h["start"], h["end"]) for h in got[0]] == [(1, 3)] and got[1] is None


def test_native_agrees_with_matcher_in_spark(spark):
    for source, texts in random_cases(25, 9):
        g = Grammar(source)
        if not g.native:
            continue
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        from pegspark.functions import arrow

        rows = df.select(g.is_match(F.col("t")), arrow.accepts(g.key)(F.col("t")), g.texts(F.col("t")), F.transform(arrow.find(g.key, False, "codepoint")(F.col("t")), lambda h: h["text"]))
        for r in rows.collect():
            assert r[0] == r[1] and r[2] == r[3], source


def test_match_many_and_portable(spark):
    df = spark.createDataFrame([(["42", "abc", None],)], "t array<string>")
    assert values(df.select(DIGITS.match_many(F.col("t")))) == [([True, False, None],)]
    again = Grammar.from_bytes(DIGITS.to_bytes())
    assert values(df.select(again.match_many(F.col("t")))) == [([True, False, None],)]


def test_sql_functions(spark):
    register(spark)
    register_grammar(spark, "digits", DIGITS)
    register_grammar(spark, "nested", Grammar("main: open paren then optional main then close paren"))
    bound = spark.sql("select digits_count('a1b22'), digits_texts('a1b22'), nested_match('(())'), nested_count('()(())'), nested_texts('x()'), digits_match(null)").first()
    assert tuple(bound) == (2, ["1", "22"], True, 2, ["()"], None)
    plan = spark.sql("select digits_match(t), digits_count(t), digits_texts(t) from values ('a1') as x(t)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert values(spark.sql("select hit, start, end, hit_text from grammar_hits('a1 b22', 'main: one or more digits')")) == [(0, 1, 2, "1"), (1, 4, 6, "22")]
    row = spark.sql("select grammar_is_match('123', 'main: 3 digits'), grammar_find('a12', 'main: one or more digits'), digits_match('1'), digits_find('x9')").first()
    assert row[0] and row[1][0]["text"] == "12" and row[2] and row[3][0]["start"] == 1


def test_search_lines(spark):
    g = Grammar('main: "error:" then space then one or more digits')
    df = spark.createDataFrame([("line one\nerror: 42\nline three\nerror: 500\n",), (None,), ("",)], "t string")
    assert values(search_lines(df, g, "t").select("file", "line", "content")) == [("<stdin>", 2, "error: 42"), ("<stdin>", 4, "error: 500")]
    five = spark.createDataFrame([("1\n2\n3\n4\n5",)], "t string")
    assert [r["line"] for r in search_lines(five, DIGITS, "t", start_line=2, end_line=4).collect()] == [2, 3, 4]
    assert [r["content"] for r in search_lines(spark.createDataFrame([("1\r\na",)], "t string"), DIGITS, "t", line_sep="universal").collect()] == ["1"]
    shown = format_results(search_lines(spark.createDataFrame([("a 1 b 22",)], "t string"), DIGITS, "t"))
    assert values(shown) == [("<stdin>:1: a \x1b[1;31m1\x1b[0m b \x1b[1;31m22\x1b[0m",)]


def test_hits_keep_columns(spark):
    df = spark.createDataFrame([(7, "a1", "x")], "start int, t string, hit_text2 string")
    row = hits(df.withColumnRenamed("start", "own"), DIGITS, "t").first()
    assert (row["own"], row["hit"], row["start"], row["end"], row["hit_text"]) == (7, 0, 1, 2, "1")


@pytest.fixture()
def folder(tmp_path):
    for name, data in {"a.ts": b"x 1\n", "b.js": b"none\n", "c.md": b"22\n", "bin.ts": b"1\0", ".hidden.ts": b"3"}.items():
        (tmp_path / name).write_bytes(data)
    for skipped in (".git", "dist", "node_modules", "build"):
        (tmp_path / skipped).mkdir()
        (tmp_path / skipped / "z.ts").write_bytes(b"9")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.ts").write_bytes(b"\n4 and 5")
    os.symlink(tmp_path / "sub", tmp_path / "link")
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    return tmp_path


def test_folder(spark, folder):
    lines, errors = search_folder(spark, DIGITS, str(folder))
    assert sorted((os.path.basename(r["file"]), r["line"]) for r in lines.collect()) == [(".hidden.ts", 1), ("a.ts", 1), ("c.md", 1), ("d.ts", 2)]
    assert errors.count() == 0
    lines, _ = search_folder(spark, DIGITS, str(folder), glob="*.?s")
    assert sorted(os.path.basename(r["file"]) for r in lines.collect()) == [".hidden.ts", "a.ts", "d.ts"]
    assert read_folder(spark, str(folder / "a.ts")).count() == 1
    found = search_folder_hits(spark, DIGITS, str(folder), start_line=2, end_line=9)
    assert sorted((os.path.basename(r["file"]), r["line"], r["col"], r["end_col"]) for r in found.collect()) == [("d.ts", 2, 0, 1), ("d.ts", 2, 6, 7)]


def test_stream(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("one 1\nnone\ntwo 2\n")
    lines = spark.readStream.text(str(tmp_path / "in"))
    numbered = number_lines(lines, label=F.lit("f"))
    for name, df in (("found", search_stream(lines, DIGITS)), ("numbered", numbered)):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["content"] for r in spark.table("found").collect()) == ["one 1", "two 2"]
    assert sorted((r["line"], r["content"]) for r in spark.table("numbered").collect()) == [(1, "one 1"), (2, "none"), (3, "two 2")]
    files, _ = search_folder(spark, DIGITS, str(folder / "sub"), glob="*.ts", stream=True)
    files.writeStream.format("memory").queryName("files").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["line"] for r in spark.table("files").collect()) == [1, 1, 2]  # the loop leads to the files above


def test_folder_stream(spark, tmp_path):
    """Executors read the files; what comes late with an old time, or changes, is new; nothing comes twice."""
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.txt").write_text("1")
    os.utime(folder / "a.txt", (2_000_000_000, 2_000_000_000))

    def batch():
        files = read_folder(spark, str(folder), stream=True)
        files.writeStream.format("parquet").option("checkpointLocation", state).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        return sorted((os.path.basename(r["file"]), r["text"]) for r in spark.read.schema(files.schema).parquet(str(tmp_path / "out")).collect())

    assert batch() == [("a.txt", "1")]
    (folder / "late.txt").write_text("2")
    os.utime(folder / "late.txt", (1_000_000_000, 1_000_000_000))
    assert batch() == [("a.txt", "1"), ("late.txt", "2")]
    (folder / "a.txt").write_text("13")
    assert batch() == batch() == [("a.txt", "1"), ("a.txt", "13"), ("late.txt", "2")]


def test_folder_through_sparks_own_source(spark, folder):
    """As for a store that only Spark reads: the same but for names with a dot."""
    from pegspark.sources import files

    os.remove(folder / "sub" / "loop")
    got = files._stored(spark, f"file://{folder}", None, False).collect()
    assert {os.path.basename(r["file"]) for r in got} - {"d.ts"} == {"a.ts", "b.js", "c.md"}


def test_missing_file_is_an_error_row(spark, tmp_path):
    lines, errors = search_folder(spark, DIGITS, str(tmp_path / "gone.txt"))
    assert lines.count() == 0 and [os.path.basename(r["file"]) for r in errors.collect()] == ["gone.txt"]


def test_numbered_stream(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.txt").write_text("one 1\nnone\ntwo 2\nthree 3\n")
    found = search_numbered(spark.readStream.text(str(tmp_path / "lines")), DIGITS, start_line=2, end_line=3)
    found.writeStream.format("memory").queryName("numbered_search").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [(r["file"], r["line"], r["content"], r["matches"][0]["text"]) for r in spark.table("numbered_search").collect()] == [("<stream>", 3, "two 2", "2")]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io

    from pegspark import __main__ as cli

    grammar, text = tmp_path / "g.txt", tmp_path / "t.txt"
    grammar.write_text("main: one or more digits")
    text.write_text("a 1\nb\nc 22\n")
    assert cli.main([str(grammar), str(text)]) == 0
    assert capsys.readouterr().out == f"{text}:1: a 1\n{text}:3: c 22\n"  # no colour: the output is no terminal
    assert cli.main([str(grammar), str(text), "lines", "2", "to", "3"]) == 0 and capsys.readouterr().out == f"{text}:3: c 22\n"
    monkeypatch.setattr(cli, "CHUNK_LINES", 2)
    monkeypatch.setattr("sys.stdin", io.StringIO("x\ny 5\nz 6\n"))
    assert cli.main([str(grammar)]) == 0 and capsys.readouterr().out == "<stdin>:2: y 5\n<stdin>:3: z 6\n"
    monkeypatch.setattr("sys.stdin", io.StringIO("x\ny 5\nz 6\n"))
    assert cli.main([str(grammar), "-", "lines", "3", "to", "9"]) == 0 and capsys.readouterr().out == "<stdin>:3: z 6\n"
    monkeypatch.setattr("sys.stdin", io.StringIO(""))
    assert cli.main([str(grammar)]) == 1 and capsys.readouterr().out == "no matches found\n"
    monkeypatch.setattr("sys.stdout", type("Terminal", (io.StringIO,), {"isatty": lambda self: True})())
    assert cli.main([str(grammar), str(text)]) == 0 and "\x1b[1;31m22\x1b[0m" in __import__("sys").stdout.getvalue()
    assert cli.main([]) == 2


def test_deep_trees(spark, monkeypatch):
    """A tree that nests deep keeps places, and texts only where it ends; a report says where one is too deep."""
    from pegspark.functions import arrow

    g, n = Grammar("leaf: digit\nmain: open paren then (main or leaf) then close paren"), 6000
    df = spark.createDataFrame([("(" * n + "7" + ")" * n,)], "t string")
    nodes = df.select(F.inline(g.match(F.col("t"))["nodes"])).agg(F.count("*"), F.count("text"), F.max("depth"), F.max(F.struct("id", "text"))["text"]).first()
    assert tuple(nodes) == (n + 1, 1, n, "7")
    assert [x["text"] for x in arrow.flat((("main", 0, 3, (("leaf", 1, 2, ()),)),), b"(7)")] == ["(7)", "7"]


def test_plan_stays_in_the_jvm(texts):
    plan = texts.select(DIGITS.find(F.col("t"), unit="utf16"), DIGITS.count(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    plan = texts.select(DIGITS.find(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_hits_keep_their_offsets(spark):
    text = "".join(f"x{'é' * (k % 3)}{k}" for k in range(1500))
    df = spark.createDataFrame([(text,)], "t string")
    import re

    found = df.select(DIGITS.find(F.col("t")), DIGITS.find(F.col("t"), unit="byte"), DIGITS.scan_bytes(F.encode("t", "UTF-8"))).first()
    assert [(h["start"], h["end"], h["text"]) for h in found[0]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
    wanted = [(m.start(), m.end()) for m in re.finditer(b"[0-9]+", text.encode())]
    assert [(h["start"], h["end"]) for h in found[1]] == wanted and [(h["start"], h["end"]) for h in found[2]] == wanted


def test_search_starts(spark):
    """Starts inside a leading run are not tried; hits are those of the matcher, in every unit and function."""
    import random

    from pegspark.plans import lowering, matcher

    rng = random.Random(11)
    sources = [
        "local: one or more of (lowercase, period)\nmain: local then at then one or more lowercase then optional (period then lowercase)",
        "main: one or more lowercase then digit",
        "word: lowercase\nmain: one or more (one or more word then period) then at",
        "main: (zero or more digits then comma) joined by lowercase",
        "main: one or more characters except (comma, digit) then digit",
        "main: extract one or more lowercase then 2 digits",
    ]
    for source in sources:
        g = Grammar(source)
        assert lowering.search_start(g.program).startswith(r"(?:\G|")
        texts = ["".join(rng.choice("ab.@1,é🎉") for _ in range(rng.randint(0, 30))) for _ in range(120)]
        m = matcher.Matcher(g.program)
        want = [[t.encode()[a:b].decode() for a, b, *_ in matcher.hits(m, t.encode())] for t in texts]
        df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
        t = F.col("t")
        got = df.select(g.texts(t).alias("a"), g.count(t).alias("n"), g.has_hit(t).alias("h"), g.find(t).alias("f"), g.find(t, unit="byte").alias("b"), g.find(t, unit="utf16").alias("u"), g.replace(t, "<", ">").alias("r")).collect()
        assert [r["a"] for r in got] == want and [r["n"] for r in got] == [len(w) for w in want] and [r["h"] for r in got] == [bool(w) for w in want]
        for r, text, w in zip(got, texts, want):
            assert [h["text"] for h in r["f"]] == [h["text"] for h in r["b"]] == [h["text"] for h in r["u"]] == w
            assert all(text[h["start"] : h["end"]] == h["text"] for h in r["f"]) and all(text.encode()[h["start"] : h["end"]].decode() == h["text"] for h in r["b"])
            assert r["r"].replace("<", "").replace(">", "") == text and r["r"].count("<") == len(w)
    for source in ("main: 3 lowercase then digit", 'main: "a" then one or more digits', "main: one or more any characters", "main: (one or more lowercase isn't digit) then digit", "main: one or more (lowercase or digit) then comma"):
        assert lowering.search_start(Grammar(source).program) == ""


def test_endless_input():
    """Standard input is searched as it comes: a piece is answered before the next line is there, and nothing is read in vain."""
    from pegspark import __main__ as cli

    def endless(asked):
        k = 0
        while True:
            asked.append(k)
            yield f"line {k}\n"
            k += 1

    asked, few = [], []
    pieces = cli.chunks(endless(asked))
    got = [next(pieces) for _ in range(3)]
    assert [line for _, held in got for line in held] == [f"line {k}" for k in range(sum(len(h) for _, h in got))] and got[1][0] == len(got[0][1])
    assert len(asked) <= 5 * cli.CHUNK_LINES  # of another thread, which waits once a piece is ahead
    assert [line for _, held in cli.chunks(endless(few), 7) for line in held] == [f"line {k}" for k in range(7)] and len(few) == 7


def test_sql_many_grammars(spark):
    """A column of grammars, regular and recursive, null and not, in one batch."""
    register(spark)
    sources = ["main: one or more digits", "main: open paren then optional main then close paren", None, "main: zero or more (any character)", "main: byte 0xC3 then byte 0xA9"]
    texts = ["12", "(())", "é", "", None, "a1"]
    df = spark.createDataFrame([(t, s) for t in texts for s in sources], "t string, s string").selectExpr("t", "s", "grammar_is_match(t, s) AS m", "grammar_find(t, s) AS f")
    for r in df.collect():
        if r["t"] is None or r["s"] is None:
            assert r["m"] is None and r["f"] is None
        else:
            m = matcher.Matcher(analysis.check(parse(r["s"])))
            assert r["m"] == matcher.accepts(m, r["t"].encode()) and [h["text"] for h in r["f"]] == [r["t"].encode()[a:b].decode() for a, b, *_ in matcher.hits(m, r["t"].encode())]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_file(spark, tmp_path, small_splits):
    """One file in many splits: lines longer than a split, empty lines, CRLF, characters across a cut, NUL beyond the start."""
    lines = [f"{k} é🎉 {'x' * (k * 37 % 200)}" + ("\r" if k % 5 == 0 else "") for k in range(300)] + ["", "9" * 5000 + " end", "", "\0 late"] + ["tail 7"] * 3
    (tmp_path / "large.log").write_text("\n".join(lines) + "\n", newline="")
    path = str(tmp_path / "large.log")
    scan = numbered(spark, path)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() >= 8
    assert sorted((r["line"], r["content"]) for r in scan.collect()) == list(enumerate(lines, 1)) and {r["file"] for r in scan.collect()} == {path}
    assert sorted((r["line"], r["content"]) for r in numbered(spark, path, line_sep="universal").collect()) == [(k, x.rstrip("\r")) for k, x in enumerate(lines, 1)]
    g = Grammar("main: 2 digits then space")
    got = search_lines_of(spark, g, path, start_line=20, end_line=301).collect()
    assert sorted(r["line"] for r in got) == [k for k, x in enumerate(lines, 1) if re.search("[0-9]{2} ", x) and 20 <= k <= 301]
    assert all(r["matches"][0]["text"] in r["content"] for r in got)


def test_large_files_of_a_folder(spark, tmp_path, small_splits):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a" / "one.txt").write_text("x1\n" * 900)
    (tmp_path / "two.txt").write_text("no end 2")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "binary.txt").write_bytes(b"5 lines\n" * 20 + b"\0 6\n" + b"7\n" * 3000)
    (tmp_path / "late.txt").write_bytes(b"8 word\n" * 1200 + b"\0 9\n")
    (tmp_path / "a" / ".git" / "skipped.txt").write_text("3")
    (tmp_path / "other.md").write_text("4")
    got = search_lines_of(spark, Grammar("main: digit"), str(tmp_path), "*.txt")
    per_file = {r["name"]: (r["n"], r["last"]) for r in got.groupBy(F.element_at(F.split("file", "/"), -1).alias("name")).agg(F.count("*").alias("n"), F.max("line").alias("last")).collect()}
    assert per_file == {"one.txt": (900, 900), "two.txt": (1, 1), "late.txt": (1201, 1201)}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        numbered(spark, str(tmp_path / "gone.txt"))


def test_catalogue(spark):
    """Candidates are few, none that has a hit is missing, and hits are those of each grammar alone."""
    import random

    rng = random.Random(2)
    grammars = {f"g{k}": f'main: "{a}{b}" then {rest}' for k, (a, b, rest) in enumerate((a, b, rest) for a in "abcdefgh" for b in "abcdefgh" for rest in ("digit", "comma then digit", "one or more lowercase then period"))}
    grammars |= {"open": "main: 2 digits", "nested": 'main: "(" then optional main then ")"', "imported": 'use "m" (pair)\nmain: pair then "xyz"'}
    catalogue = Catalogue(grammars, {"m": "pair: 2 lowercase"})
    texts = ["".join(rng.choice("abcdefgh1,.()é🎉xyz ") for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, "", "abxyz(())"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = df.select("k", catalogue.candidates(F.col("t")).alias("c"), catalogue.find(F.col("t")).alias("f")).collect()
    for r in rows:
        text = texts[r["k"]]
        if text is None:
            assert r["c"] is None and r["f"] is None
            continue
        want = [(name, n, h["start"], h["end"], h["text"]) for name, key in catalogue.entries for n, h in enumerate(arrow.find_one(key, text))]
        assert [tuple(h) for h in r["f"]] == want and {w[0] for w in want} <= set(r["c"])
    assert sum(len(r["c"] or []) for r in rows) < 0.15 * len(rows) * len(grammars)
    assert catalogue.hits(df, "t").count() == sum(len(r["f"] or []) for r in rows)


def test_joined_literals():
    def literals(source):
        return analysis.literals(analysis.check(parse(source)))

    assert literals('main: "ab" then period then digit then 2 "x" then "y"') == ["ab.", "xxy"]
    assert literals('tail: "c" then (extract "d")\nmain: "ab" then tail then optional "e" then "f"') == ["abcd", "f"]
    assert literals('main: digit then ("a" or "b") then "c" then (any character until including "end") then "x"') == ["c", "end", "x"]


def plan_of(df):
    return df._jdf.queryExecution().toString()


FIXED = [
    "word: one or more lowercase\nnum: one or more digits\nmain: word then comma then num",
    'a: "a" or "b"\nb: a then optional digit\nmain: b then (2 a) then (one or more characters except (comma)) then comma then b',
    "tail: any character until including comma\nmain: (lowercase isn't (\"b\")) then tail then extract tail",
    "x: digit joined by comma lenient\nmain: x then one or more lowercase",
]


@pytest.mark.parametrize("source", FIXED)
def test_fixed_trees(spark, source):
    """Trees made inside the JVM are those of the matcher, of whole texts and of hits."""
    import random

    rng, g = random.Random(4), Grammar(source)
    texts = ["".join(rng.choice("ab1,é") for _ in range(rng.randint(0, 9))) for _ in range(300)] + ["abc,12", "a1abé1,b", "bab1é,a1", "aaaa,b", "xb1bbbb,a1 ", "ab,1,", "1,2,ab", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert g.fixed_tree
    got = df.select(g.tree(F.col("t")).alias("n"), g.find(F.col("t"), tree=True).alias("h"))
    assert g.native_hits is False or "Python" not in plan_of(df.select(g.tree(F.col("t"))))
    found = 0
    for text, r in zip(texts, got.collect()):
        if text is None:
            assert r["n"] is None and r["h"] is None
            continue
        data = text.encode()
        whole = matcher.whole(matcher.Matcher(g.program), data)
        assert r["n"] is None if not whole["matched"] else [x.asDict() for x in r["n"]] == arrow.flat(whole["nodes"], data)
        hits = matcher.hits(matcher.Matcher(g.program), data)
        assert [(h["text"].encode(), [x.asDict() for x in h["nodes"]]) for h in r["h"]] == [(data[a:b], arrow.flat(nodes, data)) for a, b, nodes, _ in hits]
        found += whole["matched"] + len(hits)
    assert found > 5


def test_hit_trees_without_python(spark):
    g = Grammar(FIXED[0])
    df = spark.createDataFrame([("ab,1 éx,22",)], "t string").select(g.find(F.col("t"), tree=True, unit="utf16").alias("h"))
    assert "Python" not in plan_of(df) and [[n["start"] for n in h["nodes"]] for h in df.first()["h"]] == [[0, 0, 3], [7, 7, 9]]
    assert not Grammar("w: digit\nmain: one or more w").fixed_tree and not Grammar("w: digit\nmain: w or letter").fixed_tree


ROUNDS = [
    'label: one or more of (lowercase, digit)\nmain: "x" then (extract label joined by period) then zero or more comma',
    "pair: (extract lowercase) then (extract one or more digits)\nmain: one or more pair then optional (comma then extract lowercase)",
    "main: (extract lowercase) then (between 1 and 2 (comma then extract digit)) then zero or more any characters",
    "main: extract ((extract lowercase) then one or more digits) then (optional extract comma) then zero or more lowercase",
    "a: extract letter\nmain: 2 (a then comma) then zero or more (extract digit then comma)",
]


@pytest.mark.parametrize("source", ROUNDS)
def test_extracts_of_rounds(spark, source):
    import random

    rng, g = random.Random(8), Grammar(source)
    signs = "xab12,." if "joined" in source else "ab12,"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) for _ in range(400)] + ["xa.b2.c,", "xa.b.", "a1b22c3,d", "a,1,2zz", "a1", "a,b,1,2,", "a,b,", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(g.extract(F.col("t")).alias("e"))
    assert g.fixed_extracts and "Python" not in plan_of(df)
    matched = 0
    for text, r in zip(texts, df.collect()):
        whole = matcher.whole(matcher.Matcher(g.program), (text or "").encode())
        matched += text is not None and whole["matched"]
        assert r["e"] == ([text.encode()[a:b].decode() for _, a, b, _ in whole["extracts"]] if text is not None and whole["matched"] else None), text
    assert matched > 1
    assert not Grammar("main: (extract digit) or letter").fixed_extracts


def test_reports_only_where_needed(spark):
    """The matcher sees only rows that have something to report."""
    g = Grammar("d: one or more digits\nmain: one or more (d then comma)")
    got = spark.createDataFrame([("1,2,",), ("1,x",), (None,)], "t string").select(g.tree_text(F.col("t")).alias("t"), g.diagnose(F.col("t")).alias("d"), g.tree(F.col("t")).alias("n")).collect()
    assert [r["t"] is None for r in got] == [False, True, True] and [r["d"] is None for r in got] == [True, False, True]
    assert [len(r["n"] or []) for r in got] == [3, 0, 0]


SEQUENCES = [
    'main: optional newline then "ab1" then 3 digits',
    "main: one or more letters then comma then one or more digits then period",
    "main: zero or more lowercase then optional comma then between 1 and 2 digits then zero or more whitespace then any of (comma, digit)",
    "main: any character then one or more characters except (comma, newline) then 2 comma",
    'main: digit',
    'main: "ab" then zero or more any characters',
    "main: optional digit then optional letter then tab",
    'main: "a" to "b" then 2 (none of (comma)) then newline',
]


@pytest.mark.parametrize("source", SEQUENCES)
def test_progress(spark, source):
    """Results, partial results and reports of simple sequences are those of the matcher, without Python."""
    import random

    from pegspark.functions import text as drawn

    rng, g = random.Random(6), Grammar(source)
    texts = ["".join(rng.choice("ab1,\n é🎉\t.") for _ in range(rng.randint(0, 9))) for _ in range(250)]
    texts += ["ab1123", "\nab1123", "\nab112x", "ab", "abx", "ab1", "a,1.", "é,1", "abc,12..", "a\nb,1", "\x00", "a\r", None, "xy,,", "x\ny,,", "1", "12", "abé\n", "1b\t"]
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(g.match(t).alias("m"), g.try_parse(t).alias("p"), g.diagnose(t).alias("d"))
    assert g.simple_sequence and "Python" not in plan_of(df)
    for text, r in zip(texts, df.collect()):
        if text is None:
            assert r["m"] is None and r["p"] is None and r["d"] is None
            continue
        data, key = text.encode(), g.key
        for got, partial in ((r["m"], False), (r["p"], True)):
            assert got.asDict(recursive=True) == arrow._result(key, partial)(text), (source, text)
        whole = matcher.whole(matcher.Matcher(g.program), data)
        assert r["d"] == (None if whole["matched"] else drawn.failure(whole, data)), (source, text)


def test_no_simple_sequence():
    for source in ("w: digit\nmain: w then comma", "main: digit or letter", "main: extract digit then comma", 'main: "é!" then digit', "main: digit joined by comma", "main: letter except (\"b\") then digit"):
        assert not Grammar(source).simple_sequence


def test_numbered_writer(spark, tmp_path):
    """Dense numbers in order of arrival over batches and a restart, several labels, many tasks a label, and an end."""
    import json

    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def add(name, lines):
        (source / name).write_text("".join(json.dumps({"of": of, "value": text}) + "\n" for of, text in lines))

    def run(where, **options):
        lines = spark.readStream.schema("of string, value string").option("maxFilesPerTrigger", 4).json(str(source))
        numbered_writer(lines, f"file://{where}", label=F.col("of"), **options).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema("file string, line long, content string").parquet(f"{where}/rows").collect()

    for k in range(9):
        add(f"a{k}", [("hot", f"h{k}-{j}\r") for j in range(100)] + [("cold", f"c{k}")] * (k % 2))
    first = run(out)
    for k in range(3):
        add(f"b{k}", [("hot", f"late{k}-{j}") for j in range(50)] + [("new", "n")])
    rows = run(out)
    assert len(first) == 904 and len(rows) == 904 + 153
    per = {of: sorted((r["line"], r["content"]) for r in rows if r["file"] == of) for of in ("hot", "cold", "new")}
    assert all([n for n, _ in found] == list(range(1, len(found) + 1)) for found in per.values()) and len(per["hot"]) == 1050
    assert {(r["file"], r["line"], r["content"]) for r in first} <= {(r["file"], r["line"], r["content"]) for r in rows}
    inside = [text for _, text in per["hot"]]
    assert all(inside[inside.index(x) + 1] == f"{x.split('-')[0]}-{int(x.split('-')[1]) + 1}" for x in inside if not x.endswith(("-99", "-49")) or x.startswith("h") and x.endswith("-49"))
    ended = run(tmp_path / "ended", grammar=Grammar('main: "0"'), start_line=5, end_line=150)
    assert all(5 <= r["line"] <= 150 and "0" in r["content"] for r in ended) and {r["file"] for r in ended} == {"hot"} | ({"cold"} if any("0" in f"c{k}" for k in range(9) if k % 2) else set())
    totals = {r["file"]: r["total"] for r in spark.read.parquet(f"{tmp_path}/ended/totals/2").collect()}
    assert 150 <= totals["hot"] < 1050


def test_logged_folder_stream(spark, tmp_path, monkeypatch):
    """Offsets of a few bytes whatever the number of files; late old and changed files are found, nothing comes twice."""
    from pegspark.sources.files import SeenLog

    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        files = read_folder(spark, str(source), "*.txt", stream=True, log=str(tmp_path / "log"))
        files.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
        return sorted((os.path.basename(r["file"]), r["text"]) for r in spark.read.parquet(f"{out}/rows").collect())

    for k in range(500):
        (source / f"{k:03}.txt").write_text(f"one {k}")
    want = [(f"{k:03}.txt", f"one {k}") for k in range(500)]
    assert run() == want and run() == want
    (source / "late.txt").write_text("late")
    os.utime(source / "late.txt", (1, 1))
    (source / "007.txt").write_text("changed 7")
    want = sorted([*want, ("late.txt", "late"), ("007.txt", "changed 7")])
    assert run() == want and run() == want
    assert all((out / "state" / "offsets" / n).stat().st_size < 4000 for n in os.listdir(out / "state" / "offsets") if not n.startswith("."))
    log = SeenLog(str(tmp_path / "log"))
    assert log.between(0, log.number) == log.between(0, log.number) and len(log.seen) == 501
    monkeypatch.setattr(SeenLog, "COMPACT", 3)
    for k in range(7):
        log.add([(f"more{k}", k, 0.0)])
    again = SeenLog(str(tmp_path / "log"))
    assert again.seen == log.seen and again.number == log.number and any(n.endswith(".all") for n in os.listdir(tmp_path / "log"))
    assert again.between(log.number - 2, log.number) == [("more5", 5), ("more6", 6)]

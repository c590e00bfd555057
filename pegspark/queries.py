"""Queries that show each operator on the driver's tables, with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import Catalogue, Grammar, register
from .functions.sql import register_grammar
from .operators import format_results, hits, search_hits, search_lines
from .sources import read_folder, search_folder, search_lines_of
from .streaming import number_lines, numbered_writer, search_numbered, search_stream

Query = Callable[[SparkSession, str], DataFrame]
#: Bytes of a split of the large file: far less than a cluster's, so that the tables' files have many.
LARGE_FILE_SPLIT = 1 << 14
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def _matches(name: str, grammar: str, source: str, key: str, column: str, sql: str, modules: dict | None = None) -> None:
    """A query of key and whether the whole column matches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, Grammar(grammar, modules).is_match(F.col(column)).alias("matched"))

    query(f"SELECT {key}, {sql} AS matched FROM {source}", name)(run)


def _texts(name: str, grammar: str, source: str, key: str, column: str, regex: str) -> None:
    """A query of one row per hit: key, its place, and its text; column is a column or an expression that both engines know."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Grammar(grammar).texts(F.expr(column))
        return table(spark, sf_dir, source).select(key, F.posexplode(found).alias("hit", "hit_text")).withColumn("hit", F.col("hit").cast("long"))

    query(f"SELECT {key}, generate_subscripts(h, 1) - 1 AS hit, unnest(h) AS hit_text FROM (SELECT {key}, regexp_extract_all({column}, '{regex}') AS h FROM {source})", name)(run)


# -- whole matches: one for each kind of pattern --------------------------------------------------------------------------

_matches("match_literal_and_count", 'main: "Customer#" then 9 digits', "customer", "c_custkey", "c_name", "regexp_full_match(c_name, 'Customer#[0-9]{9}')")
_matches("match_named_characters", "main: digit then hyphen then one or more (uppercase or space)", "orders", "o_orderkey", "o_orderpriority", "regexp_full_match(o_orderpriority, '[0-9]-[A-Z ]+')")
_matches("match_comma_sequence", 'main: digit, dash, "URGENT"', "orders", "o_orderkey", "o_orderpriority", "o_orderpriority IN ('0-URGENT','1-URGENT','2-URGENT','3-URGENT','4-URGENT','5-URGENT','6-URGENT','7-URGENT','8-URGENT','9-URGENT')")
_matches("match_alternatives", 'main: "A" or "R"', "lineitem", "l_orderkey", "l_returnflag", "l_returnflag IN ('A', 'R')")
_matches("match_ordered_choice", 'main: ("ECO" or "ECONOMY") then zero or more uppercase', "part", "p_partkey", "p_type", "regexp_full_match(p_type, 'ECO[A-Z]*')")
_matches("match_range", 'main: "Brand#" then "1" to "5" then optional digit', "part", "p_partkey", "p_brand", "regexp_full_match(p_brand, 'Brand#[1-5][0-9]?')")
_matches("match_between", 'main: "Brand#" then between 2 and 3 digits', "part", "p_partkey", "p_brand", "regexp_full_match(p_brand, 'Brand#[0-9]{2,3}')")
_matches("match_exactly", "main: 6 uppercase", "part", "p_partkey", "p_type", "regexp_full_match(p_type, '[A-Z]{6}')")
_matches("match_infix_repeat", "main: one uppercase or more", "customer", "c_custkey", "c_mktsegment", "regexp_full_match(c_mktsegment, '[A-Z]+')")
_matches("match_any_of", 'main: one or more of (lowercase, space, "A" to "M")', "part", "p_partkey", "p_name", "regexp_full_match(p_name, '[a-z A-M]+')")
_matches("match_none_of", 'main: one or more none of ("g", whitespace) then space then one or more lowercase', "part", "p_partkey", "p_name", "regexp_full_match(p_name, '[^g \\t\\n\\r]+ [a-z]+')")
_matches("match_characters_except", 'main: one or more characters except ("i", "o")', "part", "p_partkey", "p_name", "regexp_full_match(p_name, '[^io]+')")
_matches("match_class_except", 'main: one or more letter except ("e", "E")', "customer", "c_custkey", "c_mktsegment", "regexp_full_match(c_mktsegment, '[A-DF-Za-df-z]+')")
_matches("match_joined_by", "word: one or more lowercase\nmain: word joined by space", "part", "p_partkey", "p_name", "regexp_full_match(p_name, '[a-z]+( [a-z]+)*')")
_matches("match_isnt", 'main: one or more (any character isn\'t "g")', "part", "p_partkey", "p_name", "regexp_full_match(p_name, '[^g]+')")
_matches("match_until_including", 'main: (any character until including "#") then one or more digits', "customer", "c_custkey", "c_name", "regexp_full_match(c_name, '[^#]*#[0-9]+')")
_matches("match_until_excluding", 'main: (any character until excluding "#") then hash then one or more digits', "customer", "c_custkey", "c_name", "regexp_full_match(c_name, '[^#]*#[0-9]+')")
_matches("match_multi_word_rule", "-- a comment\nbrand number: one or more digits\nmain: \"Brand\" then hash\n  then brand number", "part", "p_partkey", "p_brand", "regexp_full_match(p_brand, 'Brand#[0-9]+')")
_matches("match_modules", 'use "numbers" (whole number)\nmain: "Brand#" then whole number', "part", "p_partkey", "p_brand", "regexp_full_match(p_brand, 'Brand#[0-9]+')", {"numbers": "cipher: digit\nwhole number: one or more cipher"})
_matches("match_optional_nested", 'main: optional ((optional ("1" or "3")) then hyphen) then one or more (uppercase or space)', "orders", "o_orderkey", "o_orderpriority", "regexp_full_match(o_orderpriority, '([13]?-)?[A-Z ]+')")


_CSV = "c_name || repeat(',', CAST(c_custkey % 3 AS INT)) || CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN ',' ELSE '' END"


@query(f"SELECT c_custkey, csv, regexp_full_match(csv, '[^,]+(,[^,]+)*') AS strict, regexp_full_match(csv, '[^,]+(,[^,]+)*,?') AS lenient FROM (SELECT c_custkey, {_CSV} AS csv FROM customer)")
def match_joined_by_lenient(spark, sf_dir):
    field = "field: one or more characters except (comma)\n"
    csv = F.expr(_CSV)
    rows = table(spark, sf_dir, "customer").select("c_custkey", csv.alias("csv"))
    return rows.select("c_custkey", "csv", Grammar(field + "main: field joined by comma").is_match(F.col("csv")).alias("strict"), Grammar(field + "main: field joined by comma lenient").is_match(F.col("csv")).alias("lenient"))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{r}')) AS {n}" for n, r in (
    ("letters", "[A-Za-z]+"), ("digits", "[0-9]+"), ("hex_digits", "[0-9A-Fa-f]+"), ("whitespace", "[ \\t\\n\\r]+"), ("visible", "[!-~]+"),
    ("printable", "[ -~]+"), ("alphanumerics", "[A-Za-z0-9]+"), ("word_characters", "[A-Za-z0-9_]+"), ("uppercase", "[A-Z]+"), ("lowercase", "[a-z]+"))) + " FROM documents")
def count_class_runs(spark, sf_dir):
    names = ("letters", "digits", "hex digits", "whitespace", "visible", "printable", "alphanumerics", "word characters", "uppercase", "lowercase")
    return table(spark, sf_dir, "documents").select("doc_id", *(Grammar(f"main: one or more {n}").count(F.col("text")).alias(n.replace(" ", "_")) for n in names))


@query("SELECT page_id, length(url) AS n FROM pages")
def count_any_character(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", Grammar("main: any character").count(F.col("url")).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[À-ÿ]')) AS n FROM documents")
def scan_bytes(spark, sf_dir):
    g = Grammar("main: byte 0xC3 then byte 0x80 to byte 0xBF")
    return table(spark, sf_dir, "documents").select("doc_id", g.count_bytes(F.encode("text", "UTF-8")).alias("n"))


@query(
    """WITH x AS (SELECT c_custkey, 'é' || c_name || 'Ü' || c_custkey || 'ß' AS t FROM customer),
    g AS (SELECT c_custkey, k, strlen(list_extract(regexp_split_to_array(t, '[À-ÿ]'), k)) AS gap FROM (SELECT c_custkey, t, unnest(range(1, 4)) AS k FROM x))
    SELECT c_custkey, CAST(sum(gap + 2) OVER w - 2 AS BIGINT) AS start_at, CAST(sum(gap + 2) OVER w AS BIGINT) AS end_at FROM g WINDOW w AS (PARTITION BY c_custkey ORDER BY k)"""
)
def scan_byte_spans(spark, sf_dir):
    g = Grammar("main: byte 0xC3 then byte 0x80 to byte 0xBF")
    data = F.encode(F.concat(F.lit("é"), "c_name", F.lit("Ü"), F.col("c_custkey").cast("string"), F.lit("ß")), "UTF-8")
    found = table(spark, sf_dir, "customer").select("c_custkey", F.inline(g.scan_bytes(data)).alias("start_at", "end_at"))
    return found.select("c_custkey", F.col("start_at").cast("long").alias("start_at"), F.col("end_at").cast("long").alias("end_at"))


# -- hits in texts ----------------------------------------------------------------------------------------------------------

EMAIL = "local: one or more of (alphanumeric, period, underscore, percent, plus, hyphen)\nlabel: one or more of (alphanumeric, hyphen)\nmain: local then at then label then one or more (period then label)"
URI = 'scheme: "https" or "http"\nmain: scheme then "://" then one or more characters except (whitespace, double quote, less than, greater than)'
IP = "octet: between 1 and 3 digits\nmain: octet then period then octet then period then octet then period then octet"
DATE = "main: 4 digits then hyphen then 2 digits then hyphen then 2 digits"
HEX_COLOR = "main: hash then 6 hex digits"
_texts("find_digits", "main: one or more digits", "documents", "doc_id", "text", "[0-9]+")
_texts("find_email", EMAIL, "documents", "doc_id", "text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+")
#: Texts of the tables with addresses, dates and colours of their own rows between them.
URI_TEXT = "concat(text, ' see http://', lang, '.example/', doc_id, ' or \"https://x.example/?q=', n_chars, '\"')"
URI_HTML = "concat('<a href=\"', url, '\">', html, '</a> <b>https://', page_id, '</b>')"
DATE_TEXT = "concat('due 19', 70 + o_orderkey % 30, '-0', 1 + o_orderkey % 9, '-1', o_orderkey % 10, ', not ', o_orderkey, '-0', o_orderkey % 10, '-00; ', o_orderpriority, ' 2001-02-03')"
COLOR_TEXT = "concat('a #', 100000 + c_custkey, 'ff b #', 'abcdef', ' c #12 ', c_name)"
_texts("find_uri", URI, "documents", "doc_id", URI_TEXT, 'https?://[^ \\t\\n\\r"<>]+')
_texts("find_uri_in_html", URI, "pages", "page_id", URI_HTML, 'https?://[^ \\t\\n\\r"<>]+')
_texts("find_ip", IP, "documents", "doc_id", "text", "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}")
_texts("find_uri_in_urls", URI, "pages", "page_id", "url", 'https?://[^ \\t\\n\\r"<>]+')
_texts("find_date", DATE, "orders", "o_orderkey", DATE_TEXT, "[0-9]{4}-[0-9]{2}-[0-9]{2}")
_texts("find_hex_color", HEX_COLOR, "customer", "c_custkey", COLOR_TEXT, "#[0-9A-Fa-f]{6}")
_texts("find_title", 'main: "<title>" then (any character until including "</title>")', "pages", "page_id", "html", "<title>(?:[^<]|<[^/])*</title>")

_SPANS = """WITH g AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS t, generate_subscripts(regexp_extract_all(text, '[0-9]+'), 1) AS k,
    unnest(list_slice(regexp_split_to_array(text, '[0-9]+'), 1, len(regexp_extract_all(text, '[0-9]+')))) AS gap FROM documents)
SELECT doc_id, CAST(k - 1 AS BIGINT) AS hit, CAST(sum({gap} + {t}) OVER w - {t} AS BIGINT) AS start_at, CAST(sum({gap} + {t}) OVER w AS BIGINT) AS end_at, t AS hit_text
FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY k)"""


def _span_sql(size: str) -> str:
    return _SPANS.format(gap=size.format("gap"), t=size.format("t"))


def _spans(df: DataFrame, grammar: str, unit: str) -> DataFrame:
    found = Grammar(grammar).find(F.col("text"), unit=unit)
    return df.select("doc_id", F.posexplode(found).alias("hit", "h")).select("doc_id", F.col("hit").cast("long").alias("hit"), F.col("h.start").cast("long").alias("start_at"), F.col("h.end").cast("long").alias("end_at"), F.col("h.text").alias("hit_text"))


@query(_span_sql("length({0})"))
def spans_codepoints(spark, sf_dir):
    return _spans(table(spark, sf_dir, "documents"), "main: one or more digits", "codepoint")


@query(_span_sql("strlen({0})"))
def spans_bytes(spark, sf_dir):
    return _spans(table(spark, sf_dir, "documents"), "main: one or more digits", "byte")


@query(_span_sql("(length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"))
def spans_utf16(spark, sf_dir):
    return _spans(table(spark, sf_dir, "documents"), "main: one or more digits", "utf16")


_PAIR = "regexp_extract_all(url, '[a-z]+/[0-9]+')"


@query(
    "SELECT page_id, hit, unnest([{'rule': 'main', 'depth': 0, 'node_text': h}, {'rule': 'word', 'depth': 1, 'node_text': split_part(h, '/', 1)}, {'rule': 'num', 'depth': 1, 'node_text': split_part(h, '/', 2)}], recursive := true)"
    f" FROM (SELECT page_id, CAST(generate_subscripts({_PAIR}, 1) - 1 AS BIGINT) AS hit, unnest({_PAIR}) AS h FROM pages)"
)
def scan_tree(spark, sf_dir):
    g = Grammar("word: one or more lowercase\nnum: one or more digits\nmain: word then slash then num")
    found = hits(table(spark, sf_dir, "pages").select("page_id", "url"), g, "url", tree=True)
    nodes = found.select("page_id", F.col("hit").cast("long").alias("hit"), F.inline("nodes").alias("id", "parent", "depth", "rule", "start", "end", "node_text"))
    return nodes.select("page_id", "hit", "rule", "depth", "node_text")


@query("SELECT doc_id, regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS has_hit, len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS n FROM documents")
def has_hit_and_count(spark, sf_dir):
    g = Grammar("main: 3 digits then hyphen then 4 digits")
    return table(spark, sf_dir, "documents").select("doc_id", g.has_hit(F.col("text")).alias("has_hit"), g.count(F.col("text")).alias("n"))


@query("SELECT page_id, regexp_replace(url, '[0-9]+', '<\\0>', 'g') AS marked, regexp_replace(url, '[0-9]+', 'N', 'g') AS plain FROM pages")
def replace_hits(spark, sf_dir):
    g = Grammar("main: one or more digits")
    return table(spark, sf_dir, "pages").select("page_id", g.replace(F.col("url"), "<", ">").alias("marked"), g.replace(F.col("url"), with_text="N").alias("plain"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[a-z]+ ') THEN length(regexp_extract(p_name, '^[a-z]+ ')) ELSE -1 END AS consumed FROM part")
def prefix_length(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", Grammar("main: one or more lowercase then space").prefix_length(F.col("p_name")).cast("long").alias("consumed"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, regexp_full_match(unnest(string_split(p_name, ' ')), '[a-l]+') AS matched FROM part")
def match_many(spark, sf_dir):
    words = F.split("p_name", " ")
    pairs = F.arrays_zip(words.alias("word"), Grammar('main: one or more "a" to "l"').match_many(words).alias("matched"))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(pairs).alias("word", "matched"))


# -- extracts, trees, failures ------------------------------------------------------------------------------------------------

_KV = 'num: one or more digits\nmain: open brace then double quote then "k" then double quote then colon then space then extract num then close brace'
_URL = 'word: one or more lowercase\nhost: one or more characters except (slash, question, hash)\nrest: zero or more any characters\nmain: extract word then "://" then extract host then extract rest'
_URL_SQL = "regexp_extract(url, '^([a-z]+)://([^/?#]+)(.*)$', {k})"


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def extract_value(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *(c.cast("long").alias("k") for c in Grammar(_KV).extract_columns(F.col("props"), ["k"])))


@query("SELECT page_id, " + ", ".join(f"{_URL_SQL.format(k=k)} AS {n}" for k, n in enumerate(("scheme", "host", "rest"), 1)) + " FROM pages")
def extract_columns(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *Grammar(_URL).extract_columns(F.col("url"), ["scheme", "host", "rest"]))


@query("SELECT page_id, generate_subscripts(h, 1) - 1 AS place, unnest(h) AS label FROM (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.') AS h FROM pages)")
def extract_repeated(spark, sf_dir):
    g = Grammar('label: one or more of (alphanumeric, hyphen)\nmain: one or more lowercase then "://" then (extract label joined by period) then zero or more any characters')
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(g.extract(F.col("url"))).alias("place", "label")).withColumn("place", F.col("place").cast("long"))


@query(
    "SELECT page_id, unnest([{'rule': 'main', 'depth': 0, 'start_at': 0, 'end_at': length(url), 'node_text': url}, {'rule': 'word', 'depth': 1, 'start_at': 0, 'end_at': length(a), 'node_text': a},"
    " {'rule': 'host', 'depth': 1, 'start_at': length(a) + 3, 'end_at': length(a) + 3 + length(b), 'node_text': b}, {'rule': 'rest', 'depth': 1, 'start_at': length(a) + 3 + length(b), 'end_at': length(url), 'node_text': c}], recursive := true)"
    f" FROM (SELECT page_id, url, {_URL_SQL.format(k=1)} AS a, {_URL_SQL.format(k=2)} AS b, {_URL_SQL.format(k=3)} AS c FROM pages)"
)
def tree_nodes(spark, sf_dir):
    nodes = table(spark, sf_dir, "pages").select("page_id", F.inline(Grammar(_URL).tree(F.col("url"))))
    return nodes.select("page_id", "rule", F.col("depth").cast("int").alias("depth"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), F.col("text").alias("node_text"))


@query("SELECT c_custkey, (c_custkey % 3) <> 0 AS matched, CAST(CASE WHEN c_custkey % 3 <> 0 THEN 2 * (c_custkey % 7 + 1) END AS BIGINT) AS consumed FROM customer")
def recursive_nested(spark, sf_dir):
    deep = (F.col("c_custkey") % 7 + 1).cast("int")
    text = F.concat(F.repeat(F.lit("("), deep), F.repeat(F.lit(")"), F.when(F.col("c_custkey") % 3 == 0, deep - 1).otherwise(deep)))
    got = Grammar("main: open paren then optional main then close paren").match(text)
    return table(spark, sf_dir, "customer").select("c_custkey", got["matched"].alias("matched"), F.when(got["matched"], got["consumed"]).cast("long").alias("consumed"))


#: Depths of some rules within rules for most rows, and of thousands for some.
_DEEP = "CASE WHEN c_custkey % 50 = 7 THEN 5000 + c_custkey % 90 ELSE 20 + c_custkey % 40 END"


@query(f"SELECT c_custkey, c_custkey % 4 <> 0 AS matched, CAST(CASE WHEN c_custkey % 4 <> 0 THEN 2 * ({_DEEP}) ELSE -1 END AS BIGINT) AS consumed FROM customer")
def recursive_deep(spark, sf_dir):
    """Thousands of rules within rules."""
    deep = F.expr(f"CAST({_DEEP} AS INT)")
    text = F.concat(F.repeat(F.lit("("), deep), F.repeat(F.lit(")"), F.when(F.col("c_custkey") % 4 == 0, deep - 1).otherwise(deep)))
    g = Grammar("main: open paren then optional main then close paren")
    return table(spark, sf_dir, "customer").select("c_custkey", g.is_match(text).alias("matched"), g.prefix_length(text).cast("long").alias("consumed"))


@query(f"SELECT c_custkey, CAST({_DEEP} + 1 AS BIGINT) AS start_at, CAST({_DEEP} + 1 + 2 * (1 + c_custkey % 7) AS BIGINT) AS end_at FROM customer")
def recursive_hits(spark, sf_dir):
    """Hits of a recursive grammar behind long runs that are never closed."""
    text = F.expr(f"repeat('(', CAST({_DEEP} AS INT)) || 'x' || repeat('(', CAST(1 + c_custkey % 7 AS INT)) || repeat(')', CAST(1 + c_custkey % 7 AS INT))")
    found = Grammar("main: open paren then optional main then close paren").find(text)
    rows = table(spark, sf_dir, "customer").select("c_custkey", found.alias("hits"))
    rows = rows.select("c_custkey", F.inline_outer("hits")).filter(F.col("start").isNotNull())  # else Spark filters by the hits first, and finds them three times
    return rows.select("c_custkey", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


#: Names with a sign put in somewhere, sometimes after a line break.
_BROKEN = "CASE WHEN c_custkey % 4 = 0 THEN chr(10) ELSE '' END || substr(c_name, 1, CAST(c_custkey % 19 AS INT)) || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '-' END || 'zzzzzzzzz'"
_AT = "(c_custkey % 19)"
_LINE = "(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END)"
_WANT = f"CASE WHEN {_AT} < 9 THEN '\"Customer#\"' WHEN {_AT} < 18 THEN 'digit' ELSE 'end of input' END"
_SIGN = "CASE WHEN c_custkey % 3 = 0 THEN '\"x\" (0x78)' ELSE '\"-\" (0x2D)' END"
_NAME = 'main: optional newline then "Customer#" then 9 digits'


@query(f"SELECT c_custkey, CAST({_AT} + {_LINE} AS BIGINT) AS failed_at, CAST(1 + {_LINE} AS BIGINT) AS line, CAST({_AT} + 1 AS BIGINT) AS col, CASE WHEN {_AT} = 0 AND {_LINE} = 0 THEN '\"Customer#\", newline' ELSE {_WANT} END AS expected, {_SIGN} AS found FROM customer")
def diagnose_offset(spark, sf_dir):
    got = Grammar(_NAME).match(F.expr(_BROKEN))
    return table(spark, sf_dir, "customer").select("c_custkey", got["offset"].cast("long").alias("failed_at"), got["line"].cast("long").alias("line"), got["column"].cast("long").alias("col"), F.array_join(got["expected"], ", ").alias("expected"), got["found"].alias("found"))


@query(
    f"SELECT c_custkey, 'match failed at byte ' || ({_AT} + {_LINE}) || ' (line ' || (1 + {_LINE}) || ', column ' || ({_AT} + 1) || '):' || chr(10) || '  expected: ' || CASE WHEN {_AT} + {_LINE} = 0 THEN '\"Customer#\", newline' ELSE {_WANT} END || chr(10) || '  found: ' || {_SIGN} || chr(10)"
    f" || CASE WHEN {_AT} < 18 AND {_AT} + {_LINE} > 0 THEN '  in: main' || chr(10) ELSE '' END || chr(10) || '  ' || ltrim({_BROKEN}, chr(10)) || chr(10) || '  ' || repeat(' ', CAST({_AT} AS INT)) || '^' AS report FROM customer"
)
def diagnose_report(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", Grammar(_NAME).diagnose(F.expr(_BROKEN)).alias("report"))


@query("SELECT c_custkey, CAST(n AS BIGINT) AS consumed, CASE WHEN n > 0 THEN substr(t, 1, CAST(n AS INT)) END AS partial_text FROM (SELECT c_custkey, t, length(regexp_extract(t, '^[A-Za-z]+#?[0-9]*')) AS n FROM (SELECT c_custkey, substr(c_name, CAST(1 + c_custkey % 10 AS INT)) || '!' AS t FROM customer))")
def try_parse(spark, sf_dir):
    got = Grammar("main: one or more letters then hash then one or more digits then period").try_parse(F.expr("substr(c_name, CAST(1 + c_custkey % 10 AS INT)) || '!'"))
    return table(spark, sf_dir, "customer").select("c_custkey", got["consumed"].cast("long").alias("consumed"), F.get(got["nodes"], F.lit(0))["text"].alias("partial_text"))


@query("SELECT c_custkey, 'main [0..18] \"' || c_name || '\"' || chr(10) || '└── num [9..18] \"' || substr(c_name, 10) || '\"' AS drawn FROM customer")
def tree_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", Grammar('num: 9 digits\nmain: "Customer#" then num').tree_text(F.col("c_name")).alias("drawn"))


@query("SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[0-9]+') AS matched FROM part")
def portable_program(spark, sf_dir):
    g = Grammar.from_bytes(Grammar('main: "Brand#" then one or more digits').to_bytes())
    return table(spark, sf_dir, "part").select("p_partkey", g.is_match(F.col("p_brand")).alias("matched"))


@query("SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[0-9]{2}') AS matched FROM part")
def sql_function(spark, sf_dir):
    register(spark)
    return table(spark, sf_dir, "part").select("p_partkey", F.expr("grammar_is_match(p_brand, 'main: \"Brand#\" then 2 digits')").alias("matched"))


@query("SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[0-9]+') AS matched, len(regexp_extract_all(p_name, '[a-z]+')) AS n, list_extract(regexp_extract_all(p_name, '[a-z]+'), 2) AS second FROM part")
def sql_bound_functions(spark, sf_dir):
    """SQL functions bound to grammars stay inside the JVM."""
    register_grammar(spark, "brand", Grammar('main: "Brand#" then one or more digits'))
    register_grammar(spark, "lower", Grammar("main: one or more lowercase"))
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "brand_match(p_brand) AS matched", "lower_count(p_name) AS n", "get(lower_texts(p_name), 1) AS second")


@query(
    "SELECT g.name, p_partkey, hit, hit_text FROM (SELECT 'digits' AS name, p_partkey, unnest(regexp_extract_all(p_brand, '[0-9]+')) AS hit_text, generate_subscripts(regexp_extract_all(p_brand, '[0-9]+'), 1) - 1 AS hit FROM part"
    " UNION ALL SELECT 'letters', p_partkey, unnest(regexp_extract_all(p_brand, '[A-Za-z]+')), generate_subscripts(regexp_extract_all(p_brand, '[A-Za-z]+'), 1) - 1 FROM part) g"
)
def sql_table_function(spark, sf_dir):
    """A catalogue of grammars joined to texts, and a table function with a row per hit."""
    register(spark)
    catalogue = spark.createDataFrame([("digits", "main: one or more digits"), ("letters", "main: one or more letters")], "name string, source string")
    table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.explode(F.array(F.lit("digits"), F.lit("letters"))).alias("name")).join(F.broadcast(catalogue), "name").createOrReplaceTempView("grammar_catalogue_texts")
    return spark.sql("SELECT name, p_partkey, CAST(hit AS BIGINT) AS hit, hit_text FROM grammar_catalogue_texts, LATERAL grammar_hits(p_brand, source)")


#: Pairs of letters, for a catalogue of some 200 grammars that find them at the end of a sentence.
_ENDINGS = [a + b for a in "nrtldshgbcemouk" for b in "aehinorstdlguyc" if a != b]
_CATALOGUE = {f"ends in {x}": f'main: "{x}" then period' for x in _ENDINGS} | {"shouted": "main: 2 uppercase then period", "number": "main: 3 digits then period"}


@query(
    "WITH g AS (SELECT * FROM (VALUES " + ", ".join(f"('ends in {x}', '{x}\\.')" for x in _ENDINGS) + ", ('shouted', '[A-Z]{2}\\.'), ('number', '[0-9]{3}\\.')) AS v(grammar, regex))"
    " SELECT grammar, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM (SELECT grammar, doc_id, unnest(regexp_extract_all(text, regex)) FROM documents, g) GROUP BY grammar"
)
def catalogue_hits(spark, sf_dir):
    """All grammars of the catalogue over every document in one pass."""
    found = Catalogue(_CATALOGUE).hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.groupBy("grammar").agg(F.count("*").alias("n_hits"), F.countDistinct("doc_id").alias("n_docs"))


# -- search by lines --------------------------------------------------------------------------------------------------------

_LINES = "SELECT conv_id || '/' || turn AS file, CAST(k AS BIGINT) AS line, content FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM conversations) WHERE regexp_matches(content, '[A-Z][a-z]+\\.'){more}"


def _lines(spark, sf_dir, **options) -> DataFrame:
    label = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    found = search_lines(table(spark, sf_dir, "conversations"), Grammar("main: uppercase then one or more lowercase then period"), "text", label, **options)
    return found.withColumn("line", F.col("line").cast("long"))


@query(_LINES.format(more=""))
def search_text_lines(spark, sf_dir):
    return _lines(spark, sf_dir).drop("matches")


@query(_LINES.format(more=" AND k BETWEEN 2 AND 4"))
def search_line_range(spark, sf_dir):
    return _lines(spark, sf_dir, start_line=2, end_line=4).drop("matches")


@query("SELECT file || ':' || line || ': ' || regexp_replace(content, '[A-Z][a-z]+\\.', chr(27) || '[1;31m\\0' || chr(27) || '[0m', 'g') AS shown FROM (" + _LINES.format(more="") + ")")
def format_search_results(spark, sf_dir):
    return format_results(_lines(spark, sf_dir))


@query("SELECT file || ':' || line || ': ' || content AS shown FROM (" + _LINES.format(more="") + ")")
def format_plain_results(spark, sf_dir):
    return format_results(_lines(spark, sf_dir), color=False)


_WORD = "[A-Z][a-z]+\\."


@query(
    f"WITH l AS (SELECT file, line, regexp_extract_all(content, '{_WORD}') AS h, regexp_split_to_array(content, '{_WORD}') AS g FROM ({_LINES.format(more='')})),"
    " x AS (SELECT file, line, k, strlen(h[k]) AS t, strlen(g[k]) AS gap FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM l))"
    " SELECT file, line, CAST(sum(gap + t) OVER w - t AS BIGINT) AS col, CAST(sum(gap + t) OVER w AS BIGINT) AS end_col FROM x WINDOW w AS (PARTITION BY file, line ORDER BY k)"
)
def search_hit_columns(spark, sf_dir):
    label = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    found = search_hits(table(spark, sf_dir, "conversations"), Grammar("main: uppercase then one or more lowercase then period"), "text", label)
    return found.select("file", *(F.col(c).cast("long").alias(c) for c in ("line", "col", "end_col")))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder's address in the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pegspark-query-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _nested_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The conversations as text files, a folder for each role, with folders that a search skips and files that are binary."""
    out, texts = _scratch(spark, name), table(spark, sf_dir, "conversations")
    texts.select("text", "role").write.partitionBy("role").text(out)
    for skipped in ("node_modules", ".git"):
        texts.select("text").limit(10).coalesce(1).write.text(f"{out}/deep/{skipped}")
    texts.select("conv_id").limit(10).coalesce(1).write.parquet(f"{out}/deep/binary")
    return out


@query(f"SELECT content, count(*) AS n FROM ({_LINES.format(more='')}) GROUP BY content")
def search_folder_files(spark, sf_dir):
    """A tree of folders is walked and searched: each conversation's text is found once, whatever else lies there."""
    lines, _ = search_folder(spark, Grammar("main: uppercase then one or more lowercase then period"), _nested_folder(spark, sf_dir, "folder-search"), glob="*")
    return lines.groupBy("content").agg(F.count("*").alias("n"))


@query(
    "WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM conversations),"
    " n AS (SELECT content, row_number() OVER (ORDER BY conv_id, turn, k) AS line FROM l) SELECT CAST(line AS BIGINT) AS line, content FROM n WHERE regexp_matches(content, '[A-Z][a-z]+\\.')"
)
def search_large_file(spark, sf_dir):
    """All conversations as one file, cut into many splits, each searched by its own task; lines are numbered through it."""
    out = _scratch(spark, "large-file")
    texts = table(spark, sf_dir, "conversations").repartition(1).sortWithinPartitions("conv_id", "turn").select("text")
    texts.write.text(f"{out}/in")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(LARGE_FILE_SPLIT))
    try:
        found = search_lines_of(spark, Grammar("main: uppercase then one or more lowercase then period"), f"{out}/in", "*.txt").select("line", "content")
        found.write.parquet(f"{out}/rows")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return spark.read.schema(found.schema).parquet(f"{out}/rows")


@query("SELECT role, count(*) AS n_lines FROM (SELECT role, unnest(string_split(text, chr(10))) AS content FROM conversations) WHERE content <> '' GROUP BY role")
def folder_stream(spark, sf_dir):
    """The same tree as a stream of files, which executors read; blank lines aside, every line of every role comes once."""
    folder, out = _nested_folder(spark, sf_dir, "folder-stream"), _scratch(spark, "folder-stream-out")
    files = read_folder(spark, folder, "*.txt", stream=True)
    lines = files.select(F.regexp_extract("file", "role=([a-z_]+)", 1).alias("role"), F.explode(F.split("text", "\n", -1)).alias("content")).filter("content <> ''")
    lines.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(lines.schema).parquet(f"{out}/rows").groupBy("role").agg(F.count("*").alias("n_lines"))


@query("SELECT role, count(*) AS n_lines, CAST(0 AS BIGINT) AS n_binary, CAST(1 AS BIGINT) AS n_errors FROM (SELECT role, unnest(string_split(text, chr(10))) AS content FROM conversations) WHERE content <> '' GROUP BY role")
def folder_errors(spark, sf_dir):
    """Per folder of a role: its text files are read, binary files beside them give no row, and a file that is gone is a row
    with an error and stops nothing."""
    folder = _nested_folder(spark, sf_dir, "folder-errors")
    of = lambda c: F.regexp_extract(c, "role=([a-z_]+)", 1).alias("role")
    texts = table(spark, sf_dir, "conversations")
    texts.select("conv_id", "role").write.partitionBy("role").mode("append").parquet(folder)
    roles = [r["role"] for r in texts.select("role").distinct().collect()]
    kinds = [(read_folder(spark, folder, "*"), "text")] + [(read_folder(spark, f"{folder}/role={role}/gone.txt"), "gone") for role in roles]
    found = None
    for files, kind in kinds:
        rows = files.select(of("file"), F.explode(F.split(F.coalesce("text", F.lit("?")), "\n", -1)).alias("content"), F.col("error").isNotNull().cast("long").alias("e"), F.col("file").contains(".parquet").cast("long").alias("b")).filter("role <> '' AND content <> ''")
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("role").agg(F.sum(1 - F.col("e") - F.col("b")).alias("n_lines"), F.sum("b").alias("n_binary"), F.sum("e").alias("n_errors"))


@query("SELECT event_type AS file, count(*) AS n_lines, CAST(1 AS BIGINT) AS first_line, count(*) AS last_line, count(*) AS n_numbers FROM events GROUP BY event_type")
def stream_line_numbers(spark, sf_dir):
    """The events as a stream of lines, numbered per type with the count so far as state."""
    lines = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    numbered, out = number_lines(lines, "props", F.col("event_type")), _scratch(spark, "line-numbers")
    numbered.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(numbered.schema).parquet(f"{out}/rows").groupBy("file")
    return rows.agg(F.count("*").alias("n_lines"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.countDistinct("line").alias("n_numbers"))


@query("SELECT '<stream>' AS file, count(*) AS n_lines, CAST(count(*) AS BIGINT) AS last_line, count(*) AS n_numbers, CAST(sum(event_id) AS BIGINT) AS total FROM events")
def stream_numbers_of_one_label(spark, sf_dir):
    """All events as one stream of lines under one label, numbered by many tasks in micro-batches of some files."""
    events, out = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("value")), _scratch(spark, "one-label")
    events.repartition(12).write.parquet(f"{out}/in")
    lines = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 5).parquet(f"{out}/in")
    numbered_writer(lines, out).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("file string, line long, content string").parquet(f"{out}/rows").groupBy("file")
    return rows.agg(F.count("*").alias("n_lines"), F.max("line").alias("last_line"), F.countDistinct("line").alias("n_numbers"), F.sum(F.col("content").cast("long")).alias("total"))


@query("SELECT event_type AS file, count(*) AS n_hits, CAST(max(n) AS BIGINT) AS longest FROM (SELECT *, len(regexp_extract_all(props, '[5-9][0-9]')) AS n FROM events) WHERE n > 0 GROUP BY event_type")
def stream_search_numbered(spark, sf_dir):
    """The events as a stream of lines, numbered per type and searched from line 1 on."""
    lines = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    found, out = search_numbered(lines, Grammar('main: "5" to "9" then digit'), "props", F.col("event_type"), 1), _scratch(spark, "numbered-search")
    done = found.select("file", "line", F.size("matches").alias("n"))
    done.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(done.schema).parquet(f"{out}/rows").groupBy("file")
    return rows.agg(F.countDistinct("line").alias("n_hits"), F.max("n").cast("long").alias("longest"))


@query("SELECT event_id, props AS content FROM events WHERE regexp_matches(props, '[5-9][0-9]')")
def stream_search(spark, sf_dir):
    """The events as a stream of lines, searched and written batch by batch, then read back."""
    lines = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    out = _scratch(spark, "stream-search")
    found = search_stream(lines, Grammar('main: "5" to "9" then digit'), "props", F.col("event_id").cast("string"))
    done = found.select(F.col("file").cast("long").alias("event_id"), "content")
    done.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{out}/rows")


# -- hits with the rest of Spark ----------------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS n_hits FROM documents GROUP BY lang")
def hits_per_language(spark, sf_dir):
    n = Grammar("main: one or more digits").count(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_hits"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 20")
def top_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Grammar("main: one or more digits").count(F.col("text")).alias("n")).orderBy(F.desc("n"), "doc_id").limit(20)


@query("SELECT quality, count(*) AS n, CAST(sum(CAST(regexp_matches(text, '[%&*$#]{3}') AS INT)) AS BIGINT) AS marked FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def hits_join_labels(spark, sf_dir):
    g = Grammar("main: 3 any of (percent, ampersand, asterisk, dollar, hash)")
    found = table(spark, sf_dir, "documents").select("doc_id", g.has_hit(F.col("text")).cast("int").alias("hit"))
    return found.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.sum("hit").alias("marked"))


@query("SELECT * FROM (SELECT source, doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n, CAST(row_number() OVER (PARTITION BY source ORDER BY len(regexp_extract_all(text, '[0-9]+')) DESC, doc_id) AS INT) AS place FROM documents) WHERE place <= 3")
def hits_window_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", Grammar("main: one or more digits").count(F.col("text")).alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "doc_id"))).filter("place <= 3")


@query("SELECT hit_text, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS hit_text FROM documents) GROUP BY hit_text")
def distinct_hits(spark, sf_dir):
    return hits(table(spark, sf_dir, "documents"), Grammar("main: one or more digits"), "text").groupBy("hit_text").agg(F.count("*").alias("n"))

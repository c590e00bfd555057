"""Queries of the numbered operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, langid, linededup, lmscore, mixing, packing, quality, simhash, tokencounts, trie, urlfilter
from .common import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return tokencounts.count_sections(read(spark, sf_dir, "documents"))


def field_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the fields of every document, encoded as one text; a token across two fields goes to the larger part."""
    return tokencounts.count_fields(read(spark, sf_dir, "documents"), "doc_id", ["lang", "source", "text"], rule="largest")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(quality.ledger(read(spark, sf_dir, "documents")))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule of the production policy, the documents that fail it and those that only it rejects."""
    return quality.ablation(quality.ledger(read(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the boilerplate lines of its source taken out, as counts and a digest."""
    df = read(spark, sf_dir, "documents")
    clean = linededup.dedup(df.select("doc_id", "source", "text", F.col("text").alias("clean")), "source", "clean")
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.split(c, "\n", -1))).cast("long")
    return clean.select("doc_id", "source", n("text").alias("n_lines"), n("clean").alias("n_kept"), F.md5("clean").alias("clean_md5"))


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the trigram model of all documents."""
    return lmscore.score(read(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 6))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir, "documents")))


#: The rules of the URL query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; the last number in a path names the document it shows, whose labels say whether the page is bad."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    shown = F.regexp_extract(urlfilter.path(F.col("url")), "([0-9]+)[^0-9]*$", 1)
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES, labels, label_key=shown)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    found = mixing.plan(read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    nodes, ends = trie.build(*trie.rebuilt(trie.numbered(read(spark, sf_dir, "conversations"))))
    shown = nodes.drop("longest").join(trie.end_digests(ends), ["depth", "conv_id"], "left")
    return shown.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document aligned, and its links judged by the counts of all documents."""
    found, _ = alignment.align(read(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_quality_rules, op4_simhash, op5_line_dedup, op6_vector_search, op7_bpe, op8_lm_scores, op9_packing, op10_url_filter, op11_mixing, op12_prefix_trie, op13_alignment, field_token_counts, quality_ablation)}


_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
#: SQL of the queries that it can express. Others need a trained model (1), a tokenizer (2, 7, 9, 13), a seeded hash (4), or
#: are approximate (6); their tests hold them against brute force, a round trip or held-out accuracy.
_SQL = {
    "op3_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
t AS (SELECT r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
again AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS n FROM t) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM again) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_upper,
    CAST(len(regexp_extract_all(text, '[^\x00-@\[-`{{-\x7F]')) AS BIGINT) AS n_letters FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, CAST({" + ".join(f"(CASE WHEN {sql} THEN {1 << k} ELSE 0 END)" for k, sql in enumerate(quality.RULES.values()))} AS INT) AS fail_bits FROM m)
SELECT *, fail_bits & {quality.mask(quality.BASE)} <> 0 AS base_failed, fail_bits & {quality.mask(quality.BASE) | quality.mask(quality.PRODUCTION)} = 0 AS kept FROM b""",
    "op5_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT DISTINCT r, site, x FROM (SELECT r, coalesce(source, '') AS site, unnest(ls) AS x FROM d) WHERE regexp_matches(x, '[^ \\t\\x0B\\x0C\\r]')),
t AS (SELECT coalesce(source, '') AS site, count(*) AS total FROM documents GROUP BY 1),
b AS (SELECT site, list(x) AS drops FROM (SELECT site, x, count(*) AS n FROM l GROUP BY site, x) JOIN t USING (site)
    WHERE n >= {linededup.MIN_PAGES} AND n > CAST({linededup.MAX_RATIO} AS DOUBLE) * total GROUP BY site),
c AS (SELECT doc_id, source, ls, list_filter(ls, lambda x: drops IS NULL OR NOT list_contains(drops, x)) AS kept FROM d LEFT JOIN b ON coalesce(source, '') = site)
SELECT doc_id, source, coalesce(len(ls), 0) AS n_lines, coalesce(CASE WHEN len(kept) = 0 THEN 1 ELSE len(kept) END, 0) AS n_kept,
    md5(array_to_string(kept, chr(10))) AS clean_md5 FROM c""",
    "op8_lm_scores": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
t AS (SELECT r, k, w[k] AS c, CASE WHEN k > 1 THEN w[k - 1] END AS b, CASE WHEN k > 2 THEN w[k - 2] END AS a FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
one AS (SELECT c AS w, count(*) AS n FROM t GROUP BY 1), two AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2),
three AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT r, CASE WHEN three.n >= 2 THEN 3 WHEN two.n >= 2 THEN 2 ELSE 1 END AS level, CASE WHEN k > 2 THEN 3 ELSE k END AS top,
    CASE WHEN three.n >= 2 THEN ln(three.n / ctwo.n) WHEN two.n >= 2 THEN ln(two.n / cone.n) ELSE ln(one.n / (SELECT sum(n) FROM one)) END AS logp
    FROM t JOIN one ON one.w = t.c LEFT JOIN two ON two.b = t.b AND two.c = t.c LEFT JOIN three ON three.a = t.a AND three.b = t.b AND three.c = t.c
    LEFT JOIN two AS ctwo ON ctwo.b = t.a AND ctwo.c = t.b LEFT JOIN one AS cone ON cone.w = t.b),
g AS (SELECT r, count(*) AS n, sum(logp + (top - level) * ln(0.4)) AS score, count(*) FILTER (level = 1) AS n1, count(*) FILTER (level = 2) AS n2, count(*) FILTER (level = 3) AS n3 FROM s GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, round(coalesce(score, 0), 6) AS log_score, coalesce(n1, 0) AS n_order1, coalesce(n2, 0) AS n_order2, coalesce(n3, 0) AS n_order3 FROM d LEFT JOIN g USING (r)""",
}

_SQL["op11_mixing"] = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format(text="text")}) AS BIGINT) AS size,
    coalesce(CAST(doc_id AS VARCHAR), '-') || ' ' || coalesce(md5(source), '-') || ' ' || coalesce(md5(text), '-') AS key FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY key) - 1 AS number FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s),
w AS (SELECT *, list_extract({list(mixing.WEIGHTS)}, CAST(place % {len(mixing.WEIGHTS)} + 1 AS INT)) AS weight, source_size * {mixing.LIMIT} AS most FROM p),
f AS (SELECT *, sum(most) OVER () / {mixing.LIMIT} AS total, sum(weight) OVER () AS whole, coalesce(sum(most) OVER before, 0) AS most_before, coalesce(sum(weight) OVER before, 0) AS weight_before
    FROM w WINDOW before AS (ORDER BY most * {math.lcm(*mixing.WEIGHTS)} // weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CAST(most AS HUGEINT) * CAST(whole - weight_before AS HUGEINT) < CAST(total - most_before AS HUGEINT) * CAST(weight AS HUGEINT) AS filled FROM f),
h AS (SELECT *, total - coalesce(sum(most) FILTER (filled) OVER (), 0) AS open_size, greatest(1, whole - coalesce(sum(weight) FILTER (filled) OVER (), 0)) AS open_weight FROM g),
t AS (SELECT source, source_size, CASE WHEN filled THEN CAST(most AS DOUBLE) ELSE CAST(open_size * weight AS DOUBLE) / CAST(open_weight AS DOUBLE) END AS target FROM h),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('{mixing.SEED}:' || key || ':' || number), 1, 13) AS BIGINT) / CAST({1 << 52} AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source"""

#: The checksum of a decimal number, bit by bit.
_CRC32 = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, CAST(i AS INT), 1)) AS BIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
_SQL["op12_prefix_trie"] = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, turn, role, length(text) AS size, md5(length(role) || ':' || role || text) AS item FROM t),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, item) AS place, item, size FROM i),
q AS (SELECT c, count(*) AS turns, c - c % 100 AS base, {_CRC32.format("CAST(c AS VARCHAR)")} % 6 AS head FROM n GROUP BY c),
g AS (SELECT q.*, least(q.head, coalesce(b.turns, 0)) AS given FROM q LEFT JOIN q b ON b.c = q.base),
r AS (SELECT c, given + place - head AS depth, item, size FROM n JOIN g USING (c) WHERE place > head
    UNION ALL SELECT g.c, place, item, size FROM g JOIN n ON n.c = g.base WHERE place <= given),
s AS (SELECT g.c, coalesce(list(item ORDER BY depth) FILTER (item IS NOT NULL), []) AS items, list(size ORDER BY depth) AS sizes FROM g LEFT JOIN r USING (c) GROUP BY g.c),
m AS (SELECT c, depth, items[1:depth] AS prefix, len(items) = depth AS ended, CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS size FROM (SELECT *, unnest(range(len(items) + 1)) AS depth FROM s)),
k AS (SELECT prefix, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256 FROM m GROUP BY prefix, depth),
u AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL),
v AS (SELECT k.*, coalesce(n_children, 0) AS n_children, up.conv_id AS parent_conv_id FROM k LEFT JOIN u USING (prefix) LEFT JOIN k up ON k.depth > 0 AND up.prefix = k.prefix[1:k.depth - 1]),
x AS (SELECT prefix[1:above] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS above FROM v) GROUP BY ALL)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM v JOIN x USING (prefix)"""


#: Levels of the tree that the SQL spells out; the operator has no such limit, and the tables have two.
SQL_LEVELS = 4


def _url_sql() -> str:
    """The template tree level by level, then its branches, as one statement."""
    u, steps = urlfilter, []
    for k in range(1, SQL_LEVELS + 1):
        child = f"template || '/' || rest[{k}]"
        steps.append(
            f"c{k} AS (SELECT *, CASE WHEN len(rest) >= {k} AND NOT over THEN {child} END AS child FROM l{k - 1}),"
            f" w{k} AS (SELECT *, CASE WHEN child IS NOT NULL AND sum(pages) OVER (PARTITION BY child) < {u.MIN_PAGES} THEN template || '/*' END AS wild FROM c{k}),"
            f" l{k} AS (SELECT host, lexical, pages, rest, wild IS NOT NULL AND sum(pages) OVER (PARTITION BY wild) < {u.MIN_PAGES} OR over AS over,"
            f" CASE WHEN wild IS NOT NULL AND sum(pages) OVER (PARTITION BY wild) < {u.MIN_PAGES} THEN template || '/**' ELSE coalesce(wild, child, template) END AS template FROM w{k})"
        )
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
    best = sorted(URL_RULES, key=lambda r: -len(r[1]))
    case = lambda give: "CASE " + " ".join(f"WHEN {fits(*r.split('/', 1))} THEN '{give(v, r)}'" for v, r in best) + " END"
    prefixes = "list_transform(range(1, len(string_split(template, '/')) + 1), lambda k: array_to_string(list_slice(string_split(template, '/'), 1, k), '/'))"
    return f"""
WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS tail FROM pages),
q AS (SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), '{u.UPPER}', '{u.LOWER}') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS item,
    array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: '/' || regexp_replace(s, '[0-9]+', '*', 'g')), '') AS lexical FROM q),
known AS (SELECT CAST(doc_id AS VARCHAR) AS item, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
paths AS (SELECT host, lexical, count(*) AS pages, count(bad) AS labels, coalesce(sum(bad), 0) AS bad FROM r LEFT JOIN known USING (item) GROUP BY ALL),
l0 AS (SELECT host, lexical, pages, string_split(lexical, '/')[2:] AS rest, false AS over, host AS template FROM paths),
{", ".join(steps)},
tree AS (SELECT host, template, sum(labels) AS labels, sum(bad) AS bad FROM l{SQL_LEVELS} JOIN paths USING (host, lexical) GROUP BY ALL),
ends AS (SELECT host, template, labels, bad, unnest({prefixes}) AS node FROM tree),
nodes AS (SELECT node, sum(labels) AS n, sum(bad) AS b FROM ends WHERE labels > 0 GROUP BY node),
own AS (SELECT c.node FROM nodes c JOIN nodes u ON u.node = regexp_replace(c.node, '/[^/]*$', '') AND u.node <> c.node
    WHERE c.n >= {u.MIN_LABELS} AND abs(c.b - c.n * (u.b / u.n)) > {u.MERGE_Z} * sqrt(greatest(c.n * (u.b / u.n) * (1 - u.b / u.n), 0.25))),
cut AS (SELECT template, arg_max(node, length(node)) AS branch FROM ends JOIN own USING (node) GROUP BY template),
merged AS (SELECT host, template, labels, bad, coalesce(branch, host) AS branch FROM tree LEFT JOIN cut USING (template)),
share AS (SELECT CAST(sum(bad) AS DOUBLE) / greatest(1, sum(labels)) AS s FROM tree),
hosts AS (SELECT host, (sum(bad) + CAST({u.SMOOTHING} AS DOUBLE) * (SELECT s FROM share)) / (sum(labels) + CAST({u.SMOOTHING} AS DOUBLE)) AS prior FROM tree GROUP BY host),
judged AS (SELECT branch, sum(labels) >= {u.MIN_LABELS} AND (sum(bad) + CAST({u.SMOOTHING} AS DOUBLE) * any_value(prior)) / (sum(labels) + CAST({u.SMOOTHING} AS DOUBLE)) > {u.MAX_BAD} AS blocked FROM merged JOIN hosts USING (host) GROUP BY branch),
final AS (SELECT l.host, l.lexical, l.template, blocked FROM l{SQL_LEVELS} l JOIN merged USING (template) JOIN judged USING (branch))
SELECT page_id, r.host, path, {case(lambda _, r: r)} AS rule, coalesce({case(lambda verdict, _: verdict)}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, template
FROM r JOIN final f ON r.host = f.host AND r.lexical = f.lexical""".replace("(host = ", "(r.host = ").replace("ends_with(host", "ends_with(r.host")


def _ablation_sql() -> str:
    whole, names = quality.mask(quality.PRODUCTION), list(quality.RULES)
    ledger, _, _ = _SQL["op3_quality_rules"].rpartition("SELECT *, fail_bits")
    one = lambda rule, bit: f"SELECT '{rule}' AS rule, CAST(count(*) FILTER (fail_bits & {bit} <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (fail_bits & {whole} = {bit}) AS BIGINT) AS n_only FROM b"
    return ledger + " UNION ALL ".join(one(rule, 1 << names.index(rule)) for rule in quality.POLICIES[quality.PRODUCTION])


def oracle_sql() -> dict[str, str]:
    return _SQL | {"op10_url_filter": _url_sql(), "quality_ablation": _ablation_sql()}

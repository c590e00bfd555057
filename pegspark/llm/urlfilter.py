"""URL filters by a path-template tree.

Per host, paths become templates level by level: digit runs in a segment are wildcards, a child of a tree node with few
pages is variable and becomes the wildcard child, and where that has few pages too, the rest of the path is one wildcard.
Children with enough pages stay apart however many there are, and the tree is as deep as they reach. Labels are summed
over the subtree of every node; a branch whose share of bad labels can be told apart from that of its parent stands
alone, all others are merged with their parent, with all that hangs below. What remains is rejected as a whole if its
smoothed share of bad labels is too high. Explicit rules come before the tree. Pages are aggregated to distinct paths
before anything is joined, so the tree's tables hold paths, not pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, table

#: Pages from which a child of a node stays apart; 1 generalises nothing but digits.
MIN_PAGES = 10
#: A branch within MERGE_Z standard errors of its parent's share of bad labels is merged with it.
MERGE_Z = 2.0
#: Pseudo-labels at the host's share (itself smoothed towards all pages'), and when a branch is rejected.
SMOOTHING = 10.0
MAX_BAD = 0.5
#: Labels that a branch needs to stand alone, and to be rejected.
MIN_LABELS = 5
#: Paths, prefixes or templates of the tree up to which a table is broadcast; beyond it is joined.
BROADCAST_PATHS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://` or for null."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def match_rule(rules: list[tuple[str, str]], host_col: Column, path_col: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits; rules are (allow or block, host/path)."""

    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith("/" + rest)

    best = sorted(rules, key=lambda r: -len(r[1]))
    chosen = F.coalesce(*(F.when(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, rule in best), F.lit(None).cast("struct<rule:string,verdict:string>"))
    return chosen["rule"], chosen["verdict"]


def lexical(path_col: Column) -> Column:
    """A path's segments that are not empty, each after a /, digit runs as *."""
    parts = F.filter(F.split(path_col, "/", -1), lambda s: s != "")
    return F.concat_ws("", F.transform(parts, lambda s: F.concat(F.lit("/"), F.regexp_replace(s, "[0-9]+", "*"))))


def templates(paths: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Of distinct paths (host, lexical, pages): host, lexical, pages and template, level by level of the tree.

    A path leaves the loop where it ends or where too few pages remain, so the loop ends with the deepest supported node.
    """
    segments = F.slice(F.split("lexical", "/", -1), 2, 1 << 30)
    live = paths.select("host", "lexical", "pages", segments.alias("rest"), F.col("host").alias("template"))
    done = None
    while True:
        over = live.filter(F.size("rest") == 0).select("host", "lexical", "pages", "template")
        done = over if done is None else done.unionByName(over)
        live = live.filter(F.size("rest") > 0).withColumn("child", F.concat("template", F.lit("/"), F.get("rest", F.lit(0))))
        if live.isEmpty():
            return done
        often = lambda df, c: few(table(df.groupBy(c).agg(F.sum("pages").alias("n")).filter(F.col("n") >= min_pages).select(F.col(c).alias("known")), "url-nodes"), BROADCAST_PATHS)
        nodes = often(live, "child")
        live = live.join(nodes, F.col("child") == nodes["known"], "left").withColumn("node", F.when(F.col("known").isNotNull(), F.col("child")).otherwise(F.concat("template", F.lit("/*")))).drop("child")
        live = table(live.withColumn("wild", F.when(F.col("known").isNull(), F.col("node"))).drop("known"), "url-level")
        wilds = often(live.filter("wild is not null"), "wild")
        live = live.join(wilds, F.col("wild") == wilds["known"], "left").withColumn("rare", F.col("wild").isNotNull() & F.col("known").isNull())
        template = F.when(F.col("rare"), F.concat("template", F.lit("/**"))).otherwise(F.col("node"))
        rest = F.when(F.col("rare"), F.array().cast("array<string>")).otherwise(F.slice("rest", 2, 1 << 30))
        live = table(live.select("host", "lexical", "pages", rest.alias("rest"), template.alias("template")), "url-level")


def _prefixes(template: Column) -> Column:
    """All nodes from the host to the template itself."""
    parts = F.split(template, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))


def rejected(tree: DataFrame, merge_z: float = MERGE_Z, smoothing: float = SMOOTHING, max_bad: float = MAX_BAD, min_labels: int = MIN_LABELS) -> DataFrame:
    """Of templates (host, template, labels, bad): template, branch (the node it is merged into) and blocked."""
    tree = table(tree.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad")), "url-templates")
    nodes = tree.filter("labels > 0").select("labels", "bad", F.explode(_prefixes(F.col("template"))).alias("node"))
    nodes = table(nodes.groupBy("node").agg(F.sum("labels").alias("n"), F.sum("bad").alias("b")), "url-branches")
    up = nodes.select(F.col("node").alias("parent"), (F.col("b") / F.col("n")).alias("p"))
    inner = nodes.filter(F.col("n") >= min_labels).filter(F.contains("node", F.lit("/"))).withColumn("parent", F.expr("substring_index(node, '/', size(split(node, '/', -1)) - 1)"))
    own = inner.join(up, "parent").filter(F.abs(F.col("b") - F.col("n") * F.col("p")) > F.lit(merge_z) * F.sqrt(F.greatest(F.col("n") * F.col("p") * (1 - F.col("p")), F.lit(0.25))))
    own = few(table(own.select("node"), "url-distinct"), BROADCAST_PATHS)
    cut = tree.select("template", F.posexplode(_prefixes(F.col("template"))).alias("depth", "node")).join(own, "node").groupBy("template").agg(F.max_by("node", "depth").alias("branch"))
    tree = tree.join(cut, "template", "left").withColumn("branch", F.coalesce("branch", "host"))
    branches = tree.groupBy("host", "branch").agg(F.sum("labels").alias("n"), F.sum("bad").alias("b"))
    hosts = table(tree.groupBy("host").agg(F.sum("labels").alias("h_n"), F.sum("bad").alias("h_b")), "url-hosts")
    total = hosts.agg(F.sum("h_n"), F.sum("h_b")).first()
    share = float(total[1] or 0) / max(1, total[0] or 0)
    prior = (F.col("h_b") + F.lit(smoothing * share)) / (F.col("h_n") + F.lit(smoothing))
    purity = (F.col("b") + F.lit(smoothing) * prior) / (F.col("n") + F.lit(smoothing))
    verdicts = branches.join(hosts, "host").select("branch", ((F.col("n") >= min_labels) & (purity > max_bad)).alias("blocked"))
    return tree.join(verdicts, "branch").select("template", "branch", "blocked")


def judge(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame, url_col: str = "url", id_col: str = "page_id", label_key: Column | None = None, min_pages: int = MIN_PAGES, **limits) -> DataFrame:
    """id_col, host, path, rule, verdict and template of every page; limits are those of rejected().

    labels has item and bad (0 or 1), and label_key gives a page's item (its id if left out; null or empty: none); of
    repeated labels the worst holds. A null url, or one without ://, has an empty host and path, and a template like any
    other. Without labels nothing is blocked by the tree. Repeated rows give repeated results, an empty table no rows;
    other columns are not read, so their names cannot clash. A very long url is judged whole; only as much of it is in
    the tree as pages support. A path or item that very many pages share is aggregated before it is joined; the last
    join, of pages with their templates, is a broadcast up to BROADCAST_PATHS paths and relies on Spark's splitting of
    skewed partitions beyond.
    """
    known = labels.filter(F.col("item").isNotNull() & F.col("bad").isNotNull()).groupBy(F.col("item").cast("string").alias("item")).agg(F.max("bad").cast("long").alias("bad"))
    key = (F.col(f"`{id_col}`") if label_key is None else label_key).cast("string")
    host_, path_ = (F.coalesce(c, F.lit("")) for c in (host(F.col(url_col)), path(F.col(url_col))))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_.alias("host"), path_.alias("path"), F.when(key != "", key).alias("item"))
    rows = rows.withColumn("lexical", lexical(F.col("path")))
    seen = table(rows.groupBy("host", "lexical", "item").agg(F.count("*").alias("pages")), "url-paths")
    labelled = seen.filter("item is not null").join(known, "item").groupBy("host", "lexical").agg(F.sum("pages").alias("labels"), F.sum(F.col("pages") * F.col("bad")).alias("bad"))
    placed = table(templates(seen.groupBy("host", "lexical").agg(F.sum("pages").alias("pages")), min_pages), "url-tree")
    stats = placed.join(labelled, ["host", "lexical"], "left").select("host", "template", F.coalesce("labels", F.lit(0)).alias("labels"), F.coalesce("bad", F.lit(0)).alias("bad"))
    tree = table(placed.join(rejected(stats, **limits).select("template", "blocked"), "template").select("host", "lexical", "template", "blocked"), "url-verdicts")
    rule, verdict = match_rule(rules, F.col("host"), F.col("path"))
    judged = rows.join(few(tree, BROADCAST_PATHS), ["host", "lexical"])
    method = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template")

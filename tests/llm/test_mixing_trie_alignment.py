"""Mixing, the prefix trie and token alignment against brute force and SQL, and their answers to odd input."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pegspark.llm import alignment, common, entries, mixing, trie

CLASHING = ("id", "row", "key", "part", "number", "place", "rate", "copies", "batch", "codes", "n", "groups", "conv", "depth", "item", "of", "_range")
LONG = "long word\n" * 90_000
ODD = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (3, "", "s"), (None, " \n\t ", "t"), (5, LONG, "t"), (None, "x\x0by", None), (7, "Σίσυφος ▁ <|endoftext|> 🎉", "s")]


def with_clashes(df):
    return df.withColumns({c: F.lit(1) for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="module")
def odd(spark):
    return with_clashes(spark.createDataFrame(ODD, "doc_id long, text string, source string"))


def rows(df):
    df = df[sorted(df.columns)]
    return Counter(tuple(None if pd.isna(x) else x for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["op11_mixing", "op12_prefix_trie"])
def test_same_as_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    assert rows(entries.queries()[name](spark, tables).toPandas()) == rows(con.sql(entries.oracle_sql()[name]).df())


# -- running sums -------------------------------------------------------------------------------------------------------------


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    data = [(int(k), int(x), None if x % 7 == 0 else "abc"[x % 3]) for k, x in enumerate(rng.integers(0, 50, 500))]
    got = common.running(spark.createDataFrame(data, "k long, x long, s string"), [F.col("s").isNull(), F.col("s"), F.col("k")], {"before": F.col("x"), "place": F.lit(1)}).collect()
    want, total = {}, 0
    for n, (k, x, _) in enumerate(sorted(data, key=lambda r: (r[2] is None, r[2] or "", r[0]))):
        want[k] = (total, n)
        total += x
    assert {r["k"]: (r["before"], r["place"]) for r in got} == want


# -- mixing ---------------------------------------------------------------------------------------------------------------------


def shared(sizes, weights, limit):
    """Targets by the rounds of the definition."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    open_names, held, total = set(names), {}, sum(sizes.values())
    while True:
        whole = sum(weight[s] for s in open_names)
        level = {s: (total - sum(held.values())) * weight[s] / whole for s in open_names}
        above = {s for s in open_names if level[s] > limit * sizes[s]}
        if not above:
            return held | level
        held |= {s: limit * sizes[s] for s in above}
        open_names -= above


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {name: int(x) for name, x in zip(["b", "a", None, "ä", "Z", "aa", "", "c", "d", "e"], 10 ** rng.uniform(0, 5, 10))}
    got = mixing.targets(spark.createDataFrame([(s, x) for s, x in sizes.items()], "source string, size long")).collect()
    want = shared(sizes, mixing.WEIGHTS, mixing.LIMIT)
    assert {r["source"]: r["source_size"] for r in got} == sizes
    assert {r["source"]: r["target"] for r in got} == pytest.approx(want)
    assert sum(r["target"] for r in got) == pytest.approx(sum(sizes.values()))
    assert all(r["rate"] <= mixing.LIMIT for r in got)


def test_mix_comes_near(spark):
    """Equal rows have coins of their own: a third of all rows is one document, and still about its share is taken."""
    data = [(0, "same words here", "hot")] * 3000 + [(k, "w " * (k % 9), f"s{k % 4}") for k in range(6000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7)
    got = mixing.plan(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max(F.col("copies")).alias("most")).collect()
    assert len(got) == 5 and all(abs(r["taken"] / r["target"] - 1) < 0.06 and r["most"] <= 3 for r in got)
    again = mixing.plan(df.repartition(3, "doc_id")).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert {r["source"]: r["taken"] for r in again} == {r["source"]: r["taken"] for r in got}


def test_mix_odd(odd):
    got = mixing.plan(odd).collect()
    assert sorted(r["size"] for r in got) == sorted(len([w for w in (t or "").replace("\x0b", " ").split(" ") for w in w.split()]) if t != LONG else 180_000 for _, t, _ in ODD)
    assert {r["source"] for r in got} == {"s", "t", None} and got[0]["row"].asDict().keys() == set(odd.columns)
    mixed = mixing.mix(odd)
    assert mixed.columns == [*odd.columns, "copy"] and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.plan(odd.filter("false")).count() == 0 and mixing.mix(odd.filter("text = ''")).count() == 0


def test_mix_is_native(spark, tables):
    plan = entries.op11_mixing(spark, tables)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# -- prefix trie ------------------------------------------------------------------------------------------------------------------


def brute_trie(sequences):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, digest of ends) of every prefix."""
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(sequences[c]) == len(p))
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()}


def shown(nodes, ends):
    got = nodes.join(trie.end_digests(ends), ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return [tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


def test_trie_random(spark):
    """Few distinct turns, so that many conversations share long prefixes, end inside others, or are copies."""
    rng = np.random.default_rng(5)
    convs = {int(c): [("uua"[x], "xyz"[x] * int(x + 1)) for x in rng.choice(3, rng.integers(0, 7), p=[0.8, 0.15, 0.05])] for c in rng.choice(5000, 300, replace=False)}
    turns = spark.createDataFrame([(c, d, r, t) for c, ts in convs.items() for d, (r, t) in enumerate(ts, 1)], "conv long, depth long, role string, text string")
    lengths = spark.createDataFrame([(c, len(ts)) for c, ts in convs.items()], "conv long, length long")
    got = shown(*trie.build(turns.select("conv", "depth", trie.item(F.col("role"), F.col("text")).alias("item"), F.length("text").cast("long").alias("size")), lengths))
    assert len(got) == len(set(got)) and set(got) == brute_trie(convs)


def rebuilt(conv):
    return {c: conv.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + conv[c][h:] for c in conv}


def test_trie_odd(spark):
    """Nulls, ties, repeated rows, gaps, clashing columns, absent first conversations, one that another begins with, and no turns left."""
    data = [(7, None, "u", "b"), (7, 2, None, None), (7, 2, "a", "é"), (7, 2, "a", "é"), (None, 1, "u", "lost"), (200, -5, "u", "x"), (205, 1, "u", "own"), (199, 0, "", "")]
    data += [(300, k, "u", f"{k}") for k in range(14)] + [(341, k, "u", f"{k}") for k in range(12)] + [(c, 0, "u", "x") for c in range(900, 960)]
    df = with_clashes(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    conv = defaultdict(list)
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()
    for c, k, r, t in sorted((x for x in data if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", digest(x[2] or "", x[3] or ""))):
        conv[c].append((r or "", t or ""))
    got = shown(*trie.build(*trie.rebuilt(trie.numbered(df))))
    assert len(got) == len(set(got)) and set(got) == brute_trie(rebuilt(conv))
    assert shown(*trie.build(*trie.rebuilt(trie.numbered(df.filter("false"))))) == []


def test_end_digests_in_pieces(spark, monkeypatch):
    """A node whose ends are joined in many rows has the digest of all of them, in numeric order."""
    ids = [*range(-50, 4000, 3)]
    ends = spark.createDataFrame([(1, 0, c) for c in reversed(ids)] + [(2, 9, 9)], "depth long, conv_id long, conv long").repartition(5)
    assert [r["conv"] for r in trie.end_digests(ends.withColumn("conv", F.col("conv"))).withColumn("conv", F.col("ends_sha256")).orderBy("depth").collect()] == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in (ids, [9])]
    parts = list(trie._joined(iter([pd.DataFrame({"depth": [1] * 30_000, "conv_id": [0] * 30_000, "conv": range(30_000)})])))
    whole = pd.concat(parts)
    assert len(whole) > 1 and ",".join(whole["ids"]) == ",".join(map(str, range(30_000))) and whole["ids"].str.len().max() < trie.CHUNK + 20


# -- alignment ----------------------------------------------------------------------------------------------------------------------


def brute_alignment(texts):
    """Groups and counts by loops over the libraries' own tokens."""
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    letters = {chr(b if b in plain else next(spare)): b for b in range(256)}
    a_bytes = lambda k: bytes(letters[c] for c in a_model.id_to_token(k))

    def b_bytes(k):
        piece = b_model.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(k) else piece.replace("▁", " ").encode()

    def spans(ids, of):
        at, out = 0, []
        for k in ids:
            out.append((k, at, at + len(of(k))))
            at = out[-1][2]
        return out

    found, counts, best = [], Counter(), Counter()
    for text in texts:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        if not text or any(b"".join(map(of, ids)) != (" " + text).encode() for ids, of in ((a, a_bytes), (b, b_bytes))):
            found.append(None)
            continue
        sa, sb = spans(a, a_bytes), spans(b, b_bytes)
        links, j = [], 0
        for k, s, e in sa:
            while sb[j][2] <= s:
                j += 1
            i = j
            while i < len(sb) and sb[i][1] < e:
                links.append((k, sb[i][0]))
                i += 1
        groups, x, y = [], 0, 0
        for end in sorted({e for *_, e in sa} & {e for *_, e in sb}):
            sides = ([], [])
            while x < len(sa) and sa[x][2] <= end:
                sides[0].append(str(sa[x][0]))
                x += 1
            while y < len(sb) and sb[y][2] <= end:
                sides[1].append(str(sb[y][0]))
                y += 1
            groups.append("|".join(map(",".join, sides)))
        found.append((len(sa), len(sb), len(groups), links, ";".join(groups)))
        counts.update(set(links))
    for (k, _), n in counts.items():
        best[k] = max(best[k], n)
    return [(0,) * 6 + ("",) if f is None else (*f[:3], len(f[3]), sum(counts[p] == best[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]) for f in found], counts


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
HARD = ["", None, "▁x", "a\r\n b;\r  c \r", " lead", "trail  ", "\n\n x", "\t\ty\tz\x1c q\x1f\x85r\xa0s　t", "<s>hi</s> <unk> <|endoftext|> <0x41>", "ﬁne ½ Ａ é", "a\x00b", "🎉🎉 漢字かな", "'s 'S don't", " ", "   ", "\n", "x" * 3000, "ab " * 5]


def test_alignment_brute(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    hard = spark.createDataFrame([(-k, t) for k, t in enumerate([*HARD, *HARD], 1)], "doc_id long, text string")
    df = docs.unionByName(hard)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    found, pairs = alignment.align(df)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    want, counts = brute_alignment(list(texts.values()))
    assert got == dict(zip(texts, want))
    assert {(r["a"], r["b"]): r["n_docs"] for r in pairs.collect()} == counts


def test_alignment_forgets(spark, tables, monkeypatch):
    """Small memory and small pieces, so that documents span pieces and units are forgotten inside a document."""
    work = alignment._aligned(alignment.default_ranks(), alignment.default_pieces(), False)
    monkeypatch.setattr(alignment, "MEMORY", 50)
    monkeypatch.setattr(alignment, "LEARNT", 300)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 5000)
    monkeypatch.setattr(alignment, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    monkeypatch.setattr("pegspark.llm.packing.LONG", 400)
    import pyarrow as pa

    texts = [r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").limit(40).collect()] + ["some good words " * 50 + "▁ " + "and more of them " * 50, None]
    alignment.aligner.cache_clear()
    out = pa.Table.from_batches(list(work(pa.record_batch([pa.array(range(k, k + len(texts[k : k + 9]))), pa.array(texts[k : k + 9])], ["id", "text"]) for k in range(0, len(texts), 9))))
    alignment.aligner.cache_clear()
    rows = [r for r in out.to_pylist() if not r["counted"]]
    want, counts = brute_alignment(texts)
    assert [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) for r in rows] == [(*w[:4], w[6]) for w in want]
    got = Counter()
    for r in out.to_pylist():
        if r["counted"]:
            got.update(dict(zip(r["codes"], r["n"])))
    assert got == {a * 32_000 + b: n for (a, b), n in counts.items()} and len({r["batch"] for r in rows}) > 1
    assert all(r["codes"] == sorted(set(r["codes"])) and sum(r["n"]) == r["n_links"] for r in rows)


def test_alignment_odd(odd):
    found, pairs = alignment.align(odd, digest=True)
    got = found.collect()
    assert len(got) == len(ODD) and found.columns == ["doc_id", *COLUMNS]
    assert sum(r["n_a"] == 0 for r in got) == 3 and {r["groups"] for r in got if r["n_a"] == 0} == {""}
    assert all(len(r["groups"]) == 64 for r in got if r["n_a"])
    none, no_pairs = alignment.align(odd.filter("false"))
    assert none.count() == 0 and no_pairs.count() == 0


# -- language ID: its sample --------------------------------------------------------------------------------------------------------


def test_language_sample_of_like_ids(spark):
    """One id for all rows, null ids, or one row many times: every language is learnt, from a bounded number of texts."""
    from pegspark.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 60")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    for same in (F.lit(3), F.lit(1), F.lit(None).cast("long")):
        model = langid.fit(docs.withColumn("doc_id", same))
        assert sorted(v for votes in model.within.values() for v in votes.labels) == sorted({x for x in truth.values() if x})
        got = langid.predict(docs, model).collect()
        assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) > 0.95 * len(got)
    one = docs.filter("lang = 'en'").limit(1)
    many = docs.unionByName(one.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("k"))
    assert langid.predict(docs.limit(20), langid.fit(many)).count() == 20


def test_language_labels_are_bounded(spark, monkeypatch):
    from pegspark.llm import langid

    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 30)
    rows = [(k, f"{'abcd'[k % 4] * 3} word{k}", ["aa", "bb", "cc", "dd"][k % 4 if k < 400 else 0]) for k in range(403)] + [(k, "typo", f"x{k}") for k in range(50)]
    seen, train = [], langid._train
    monkeypatch.setattr(langid, "_train", lambda x, y: (seen.append(len(x)), train(x, y))[1])
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len([v for votes in model.within.values() for v in votes.labels]) == 3 and max(seen) <= 60


# -- vector search: two levels of vantage points ------------------------------------------------------------------------------------


@pytest.mark.parametrize("pivots, shard", [(400, 10), (30, 10), (2, 10), (400, 100_000)])
def test_vector_regions_on_two_levels(spark, monkeypatch, pivots, shard):
    """Exact for any number of vantage points; with as many as shards a query visits few of them, however many rows there are."""
    from pegspark.llm import ann

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    data = (centres[rng.integers(40, size=3000)] + rng.normal(scale=0.05, size=(3000, 12))) * rng.uniform(0.5, 1.5, size=(3000, 1))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<double>")
    visits, table = [], ann.table
    monkeypatch.setattr(ann, "table", lambda d, name: (visits.append(out.count()), out)[1] if (out := table(d, name)) is not None and name == "ann-visits" else out)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10, pivots=pivots, shard=shard, leaf=4).collect()}
    score = data[::20] @ data.T
    score[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :10]
    assert got == {(20 * q, k + 1): int(v) for q, row in enumerate(best) for k, v in enumerate(row)}
    if (pivots, shard) == (400, 10):
        assert sum(visits) <= 0.7 * 150 * 300  # of 150 queries and 300 shards


# -- near copies: stars with few sets outside ---------------------------------------------------------------------------------------


def test_star_with_few_outsiders(spark):
    """A star of 50,000 sets with three outside its largest component is moved about once; every outsider meets every set."""
    from pegspark.llm import nearcopies

    m, blocks = 50_000, -(-50_000 // nearcopies.BLOCK)
    parts = spark.range(m).select(F.lit(7).cast("long").alias("star"), F.col("id").alias("node"), F.lit(20).cast("long").alias("n"), F.when(F.col("id") < 3, F.col("id")).otherwise(F.lit(99)).alias("root"))
    closed = spark.range(500).select(F.lit(8).cast("long").alias("star"), F.col("id").alias("node"), F.lit(20).cast("long").alias("n"), F.lit(5).cast("long").alias("root"))
    dealt = nearcopies._dealt(parts.unionByName(closed)).toPandas()
    assert len(dealt) <= 3 * m and set(dealt["star"]) == {7}
    assert sorted(dealt[~dealt["asks"]]["node"]) == list(range(m)) and set(dealt["j"]) == {0}
    assert dealt[dealt["asks"]].groupby("node")["i"].nunique().to_dict() == dict.fromkeys(range(3), blocks)


@pytest.mark.parametrize("block", [8, 40, 1000])
def test_star_blocks_lose_no_link(spark, monkeypatch, block):
    """Stars in blocks of any size join the components that comparing every outsider with all would join."""
    from pegspark.llm import nearcopies

    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rng = np.random.default_rng(block)
    base = rng.integers(0, 1 << 40, 100)
    sets = [np.unique(np.where(rng.random(100) < rng.choice([0.02, 0.1, 0.13]), rng.integers(0, 1 << 40, 100), base)) for _ in range(90)]
    root = [int(x) for x in rng.integers(0, 4, 90) * (np.arange(90) < 40) + np.arange(90) * (np.arange(90) >= 40)]
    parts = spark.createDataFrame([(1, k, len(s), root[k]) for k, s in enumerate(sets)], "star long, node long, n long, root long")
    held = spark.createDataFrame([(k, [int(x) for x in s]) for k, s in enumerate(sets)], "node long, held array<long>")
    found = nearcopies._dealt(parts).join(held, "node").groupBy("star", "i", "j").applyInArrow(nearcopies._block(0.8), "a long, b long").collect()

    def united(links):
        top = list(range(90))

        def end(k):
            while top[k] != k:
                k = top[k]
            return k

        for a, b in [*links, *((k, root.index(root[k])) for k in range(90))]:
            a, b = end(a), end(b)
            top[max(a, b)] = min(a, b)
        return [end(k) for k in range(90)]

    near = [(a, b) for a in range(90) for b in range(a) if root[a] != root[b] and (n := len(np.intersect1d(sets[a], sets[b]))) / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
    assert found and united(near) == united([(root.index(r["a"]), root.index(r["b"])) for r in found])


# -- token counts of fields -----------------------------------------------------------------------------------------------------------


def test_field_token_counts(spark, tables):
    """Per field the tokens that brute force gives it: most bytes first, the earlier field on a tie."""
    from pegspark.llm import packing

    coder = packing.byte_bpe(*packing.default_ranks())
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = entries.field_token_counts(spark, tables).toPandas()
    assert len(got) == 3 * len(docs)
    for doc_id, fields in got.groupby("doc_id"):
        row = docs[doc_id]
        parts = [(row["lang"] or "") + "\n", (row["source"] or "") + "\n", row["text"] or ""]
        owner = [k for k, p in enumerate(parts) for _ in p.encode()]
        at, want = 0, [0, 0, 0]
        for token in coder.encode("".join(parts), special=False):
            own = Counter(owner[at : at + len(coder.token_bytes(int(token)))])
            want[min(own, key=lambda k: (-own[k], k))] += 1
            at += sum(own.values())
        assert fields.sort_values("part")["n_tokens"].tolist() == want and fields.sort_values("part")["field"].tolist() == ["lang", "source", "text"]

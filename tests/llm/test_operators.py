"""The corpus operators against brute force, round trips and held-out accuracy, and their answers to odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pegspark.llm import ann, bpe, common, entries, langid, linededup, lmscore, nearcopies, packing, quality, simhash, tokencounts, urlfilter

W = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "long word " * 60_000
ODD = [
    (1, "The quick brown fox.\nAll rights reserved.\n", "en", "a"),
    (1, "The quick brown fox.\nAll rights reserved.\n", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (None, " \n\t ", "de", "b"),
    (5, LONG, "en", "b"),
    (6, "%%% ### 123", None, "b"),
    (7, "Σίσυφος ñandú <|endoftext|> 'S 🎉", "xx", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in ("id", "row", "fp", "batch", "site", "lines", "score", "kept", "_line_dedup", "_chosen", "template")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# -- language ID ------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    got = langid.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert both.score.between(0, 1).all()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in both.itertuples())


def test_language_odd(odd, none, spark, docs):
    model = langid.fit(docs)
    got = langid.predict(odd, model).collect()
    assert len(got) == len(ODD)
    assert [(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (2, 3, 6) or r["doc_id"] is None] == [("und", 0.0)] * 4
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 5)} == {"en"}
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict_rows(odd, model).select("row.*").columns == odd.columns


def test_language_hierarchy(docs):
    model = langid.fit(docs)
    assert model.families.labels == ("germanic", "romance") and model.within["romance"].labels == ("es", "fr")
    one = langid.fit(docs.filter("lang = 'en'"))
    assert one.predict(["the"])[0] == ["en"]


def brute_language(model, text):
    """The same weights, by plain loops over letters and pairs."""
    data = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b"  "
    grams = [((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 2654435761 % (1 << 32)) >> 20 for k in range(len(data) - 2) if data[k + 1] != 32]

    def vote(v):
        won, least, k = dict.fromkeys(v.labels, 0), dict.fromkeys(v.labels, math.inf), 0
        for a, x in enumerate(v.labels):
            for y in v.labels[a + 1 :]:
                margin = sum(float(v.weights[g, k]) for g in grams) / max(1, len(grams)) + float(v.bias[k])
                won[x if margin > 0 else y] += 1
                least[x], least[y], k = min(least[x], margin), min(least[y], -margin), k + 1
        best = max(v.labels, key=lambda name: won[name] + 1e-3 * math.tanh(least[name]))
        return best, 1 if len(v.labels) == 1 else 1 / (1 + math.exp(-3 * max(-10, min(10, least[best]))))

    group, sure = vote(model.families)
    lang, more = vote(model.within[group])
    return lang, sure * more


def test_language_brute(docs, texts):
    model = langid.fit(docs.filter(~langid.held_out()))
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for k in sorted(texts)[:60]:
        lang, score = brute_language(model, texts[k]) if langid.has_letter(texts[k]) else ("und", 0.0)
        assert got[k]["lang_pred"] == lang and math.isclose(got[k]["score"], score, rel_tol=1e-4, abs_tol=1e-6)


# -- token counts --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts(docs, texts, rule):
    coder = packing.byte_bpe(*packing.default_ranks())
    got = tokencounts.count_sections(docs.filter("doc_id < 20"), rule=rule).toPandas()
    for doc_id, parts in got.groupby("doc_id"):
        text = texts[doc_id].encode()
        ends = [len(b"\n".join(text.split(b"\n")[: k + 1])) + 1 for k in range(text.count(b"\n") + 1)]
        ends[-1] -= 1
        want, at = [0.0] * len(ends), 0
        for token in coder.encode(texts[doc_id], special=False).tolist():
            size = len(coder.token_bytes(token))
            share = [max(0, min(at + size, e) - max(at, b)) for b, e in zip([0, *ends], ends)]
            owners = [k for k, s in enumerate(share) if s]
            if rule == "split":
                for k in owners:
                    want[k] += share[k] / size
            else:
                want[{"first": owners[0], "last": owners[-1], "largest": max(owners, key=lambda k: (share[k], -k))}[rule]] += 1
            at += size
        assert np.allclose(parts.sort_values("part").n_tokens, want)
        assert math.isclose(parts.n_tokens.sum(), parts.doc_tokens.iloc[0])


def test_token_counts_crossing():
    got, crossing = tokencounts.allocate(np.array([2, 4, 1]), np.array([3, 3, 5, 7]), "split")
    assert got.tolist() == [1.25, 0, 0.5, 1.25] and crossing.tolist() == [1, 0, 1, 1]
    assert tokencounts.allocate(np.array([4]), np.array([2, 4]), "largest")[0].tolist() == [1, 0]


def test_token_counts_odd(odd, none):
    got = tokencounts.count_sections(odd).toPandas()
    assert got.groupby("doc_id").n_tokens.sum().to_dict()[2] == 0
    assert len(got[got.doc_id == 1]) == 6 and tokencounts.count_sections(none).count() == 0
    fields = tokencounts.count_fields(odd, "doc_id", ["lang", "text"]).toPandas()
    assert set(fields.field) == {"lang", "text"} and len(fields) == 2 * len(ODD)
    with pytest.raises(ValueError):
        tokencounts.count_sections(odd, rule="other")


# -- quality rules -----------------------------------------------------------------------------------------------------------


def brute_repeat(words):
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {p for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    return len(hit)


@pytest.mark.parametrize("seed", range(3))
def test_quality_measures(seed):
    rng = random.Random(seed)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "é", "#", " ", " ", "\n", "\xa0", "B", "\x0b", "🎉"]) for _ in range(rng.randint(0, 60)))
        words = W.findall(text)
        lines = [x for x in text.split("\n") if W.search(x)]
        got = quality.measure(text.encode())
        letters = sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in text)
        assert got == (len(words), sum(map(len, words)), text.count("#"), len(lines) - len(set(lines)), brute_repeat(words), len(lines), text.count("B"), letters)


def test_quality_many_words():
    words = [str(k) for k in range(50)] * 2
    assert quality._repeat_words([w.encode() for w in words]) == brute_repeat(words) == 100


def test_quality_ledger_and_ablation(odd, none, spark):
    rows = quality.verdicts(quality.ledger(odd))
    got = {r["doc_id"]: r for r in rows.collect()}
    assert not got[2]["kept"] and got[2]["base_failed"] and got[2]["n_words"] == 0
    assert got[5]["n_words"] == 120_000 and got[5]["base_failed"]
    assert quality.ledger(none).count() == 0
    ledger = quality.ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    bits = [r["fail_bits"] for r in ledger.collect()]
    for r in quality.ablation(ledger, "v2").collect():
        bit, whole = 1 << list(quality.RULES).index(r["rule"]), quality.mask("v2")
        assert r["n_failed"] == sum(b & bit != 0 for b in bits) and r["n_only"] == sum(b & whole == bit for b in bits)


def test_quality_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.verdicts(quality.ledger(docs)).join(labels, "doc_id").toPandas()
    assert got[(got.quality == 1) & ~got.base_failed].kept.all() and not got[got.quality == 0].kept.any()


# -- SimHash ---------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    words = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, limit=3):
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= limit:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(k) for k in range(len(fps))]


def test_simhash(docs, texts):
    got = {r["doc_id"]: r for r in simhash.components(docs).collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[k]) for k in ids]
    assert [got[k]["fingerprint"] for k in ids] == [f"{f:016x}" for f in fps]
    assert [got[k]["component_id"] for k in ids] == [ids[r] for r in brute_components(fps)]


@pytest.mark.parametrize("hot_cell, block", [(1000, 2048), (2, 3), (0, 1)])
def test_simhash_links(spark, hot_cell, block):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(170):  # chains of near values, and a crowd around the first
        f = rng.choice([fps[0], rng.choice(fps)])
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = sorted({f - (f >> 63 << 64) for f in fps})
    points = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in simhash.roots(simhash.links(points, hot_cell=hot_cell, block=block)).collect()}
    want = brute_components([f & (1 << 64) - 1 for f in fps])
    smallest = {}
    for f, r in zip(fps, want):
        smallest.setdefault(r, f)
    assert [found.get(f, f) for f in fps] == [smallest[r] for r in want]


@pytest.mark.parametrize("parts", [6, 8, 14])
def test_simhash_grid_is_whole(parts):
    """Any three changed bits leave two fingerprints in a common cell, and the lower bound never exceeds the distance."""
    rng, masks = random.Random(parts), [m & (1 << 64) - 1 for m in simhash.grids(parts, 3)]

    def point(f):
        pairs = [(f >> 2 * k & 1) + (f >> 2 * k + 1 & 1) for k in range(32)]
        return sum((0, 1, 3)[c] << 2 * k for k, c in enumerate(pairs)), pairs

    for _ in range(300):
        f = rng.getrandbits(64)
        g = f
        for _ in range(rng.randint(1, 3)):
            g ^= 1 << rng.randrange(64)
        (p, a), (q, b) = point(f), point(g)
        assert any(p & m == q & m for m in masks)
        assert bin(p ^ q).count("1") == sum(abs(x - y) for x, y in zip(a, b)) <= bin(f ^ g).count("1")


def test_simhash_parts_follow_the_count():
    assert [simhash.choose_parts(n, 3) for n in (100, 10**6, 10**8, 10**10)] == sorted(simhash.choose_parts(n, 3) for n in (100, 10**6, 10**8, 10**10))
    assert simhash.choose_parts(10**5, 3) < simhash.choose_parts(10**10, 3)


def test_simhash_wider_distance(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), 5)) for f in fps[:20]]
    signed = [f - (f >> 63 << 64) for f in fps]
    points = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(points, limit=5).collect()}
    assert found == {tuple(sorted((signed[a], signed[b]))) for a in range(60) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 5}


def test_simhash_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert {r["root"] for r in simhash.roots(edges).collect()} == {0}


def test_simhash_odd(odd, none):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.components(odd).collect()]
    assert len(got) == len(ODD)
    assert {g for g in got if g[1] == "0" * 16} == {(2, "0" * 16, 2), (3, "0" * 16, 2), (None, "0" * 16, 2)}
    assert simhash.components(none).count() == 0
    kept = simhash.representatives(odd)
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 2, 5, 6, 7] and kept.columns == odd.columns
    assert kept.filter("doc_id is null").count() == 1


@pytest.mark.parametrize("keep", [simhash.representatives, nearcopies.representatives])
def test_representatives_without_ids(spark, keep, monkeypatch):
    """Rows without an id stay, whatever else is there; a repeated id goes only with the text that is a copy."""
    a, b, c = ("the quick brown fox jumps over lazy dogs", "other words stand here and go on for a while", "nothing like the rest of them at all my friend")
    rows = [(1, a), (None, a), (None, b), (None, b), (2, a), (2, c), (3, c), (3, c), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, id int")
    for limit in (500_000, 0):  # broadcast and joined
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        assert Counter(tuple(r)[:2] for r in keep(df).collect()) == Counter([(1, a), (None, a), (None, b), (None, b), (2, c), (4, None)])


# -- line dedup --------------------------------------------------------------------------------------------------------------------


def test_line_dedup_brute(docs, texts):
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs, "source", max_ratio=0.15, min_pages=2).collect()}
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    total, pages = Counter(sources.values()), Counter()
    for k, t in texts.items():
        pages.update((sources[k], line) for line in set(t.split("\n")) if line.strip(" \t\x0b\x0c\r"))
    bad = {key for key, n in pages.items() if n >= 2 and n > 0.15 * total[key[0]]}
    assert bad
    assert got == {k: "\n".join(x for x in t.split("\n") if (sources[k], x) not in bad) for k, t in texts.items()}


def test_line_dedup_odd(odd, none, spark, monkeypatch):
    for limit in (10**6, -1):  # broadcast and shuffled
        monkeypatch.setattr(linededup, "BROADCAST_LINES", limit)
        got = linededup.dedup(odd, "source", max_ratio=0.3, min_pages=2)
        assert got.columns == odd.columns and got.count() == len(ODD)
        by_id = {r["doc_id"]: r["text"] for r in got.collect()}
        assert by_id[1] == "" and by_id[2] is None and by_id[3] == "" and by_id[5] == LONG
    assert linededup.dedup(none, "source").count() == 0


def test_line_dedup_default_ratio(spark):
    """Planted lines on 2, 3 and 9 % of a host's pages go, whatever the host's size; lines of one or two pages stay."""
    rows, want = [], {}
    for host, pages in (("small", 400), ("hot", 2000)):
        for k in range(pages):
            clean = [f"{host} sentence {k // 2 if k < 20 else k}"]
            planted = [f"planted {every}" for every in (11, 33, 50) if k % every == 0]
            rows.append((len(rows), host, "\n".join(planted + clean)))
            want[len(rows) - 1] = "\n".join(clean)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup(df, "source").collect()} == want


# -- vector search ------------------------------------------------------------------------------------------------------------------


def brute_search(ids, vectors, k):
    out = {}
    for i, q in zip(ids, vectors):
        if i % 20 == 0:
            scores = [(-float((q * v).sum()), j) for j, v in zip(ids, vectors) if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def vectors(spark, tables):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")


@pytest.mark.parametrize("shard, block", [(16_384, 262_144), (100, 10)])
def test_search_exact(vectors, shard, block):
    rows = vectors.collect()
    want = brute_search([r["vec_id"] for r in rows], [np.array(r["embedding"], float) for r in rows], 20)
    got = found(ann.search(vectors, F.col("vec_id") % 20 == 0, factor=1.0, shard=shard, block=block, leaf=16))
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}
    assert all(math.isclose(a[1], b[1], rel_tol=1e-12) for q in want for a, b in zip(got[q], want[q]))


def test_search_recall(spark):
    big = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = big.collect()
    want = brute_search([r["vec_id"] for r in rows], [np.array(r["embedding"], float) for r in rows], 20)
    got = found(ann.search(big, F.col("vec_id") % 20 == 0))
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize("latent", [5, 8, 16])
def test_search_recall_of_few_dimensions(spark, latent):
    rng = np.random.default_rng(latent)
    x = rng.standard_normal((4000, latent)) @ rng.standard_normal((latent, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute_search(range(len(x)), x, 20)
    got = found(ann.search(df, F.col("vec_id") % 20 == 0))
    assert min(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want) >= 0.9


def test_search_odd(spark):
    rows = [(k, [1.0, 0.0]) for k in range(1, 30)] + [(0, [2.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [1.0, None]), (120, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(df, F.col("vec_id") % 20 == 0, factor=1.0, leaf=4))
    assert set(got) == {0, 20}
    assert [v for v, _ in got[0]] == list(range(1, 21)) and got[20][0] == (0, 2.0) and [v for v, _ in got[20][1:]] == list(range(1, 20))
    assert ann.search(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_search_twins(spark):
    """A hundred equal vectors, near to all that point their way."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(200)] + [(k, [100.0] * 8) for k in range(200, 300)]
    want = brute_search([k for k, _ in rows], [np.array(v) for _, v in rows], 20)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (16_384, 40):
        got = found(ann.search(df, F.col("vec_id") % 20 == 0, factor=1.0, leaf=8, shard=shard))
        assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}


def test_search_skips_regions(spark, monkeypatch):
    """On clustered vectors most regions are never visited, and the answer is exact all the same."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 10
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    visits, table = [], ann.table
    monkeypatch.setattr(ann, "table", lambda d, name: (visits.append(out) if name == "ann-visits" else None, out)[1] if (out := table(d, name)) is not None else None)
    got = found(ann.search(df, F.col("vec_id") % 20 == 0, shard=100, leaf=16))
    want = brute_search(range(3000), x, 20)
    assert {q: [v for v, _ in y] for q, y in got.items()} == {q: [v for v, _ in y] for q, y in want.items()}
    shards = sum(v.select("shard").distinct().count() for v in visits[:1])
    assert sum(v.count() for v in visits) < 0.6 * len(want) * shards


def test_search_shared_ids_lengths_and_clashing_columns(spark):
    """Rows that share an id are rows of their own, vectors of another length another table; other columns are not read."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (20, [3.0]), (21, [2.0]), (22, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, id int, tag string, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == sorted([(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 0, 0.0)] * 2 + [(20, 1, 21, 6.0)])


# -- BPE ------------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(P.path(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k")}


def hard_texts():
    rng = random.Random(1)
    pool = "aAbBéÉ \n\t'sStTreÑüß<|endoftext|>0129²½ΣςİĲ\u0301\u00a0\u3000漢字🎉!!..--\u201c\u2019\u2014\x1c\x0b"
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>", "<|startoftext|> x", "'S it'LL"]) for _ in range(1500)]
    return made + ["a" * 5000, "ab" * 3000, "", " ", "xq" * 200, *(f"a{chr(c)}b" for c in range(1, 0x700))]


def test_bpe_equals_library(library, texts):
    coder, want = bpe.codec(bpe.default_vocabulary()), library["word_bpe_49k"]
    for text in [*texts.values(), *hard_texts()]:
        ids, said = coder.encode(text)
        right = want.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(ids), "<u4").tolist() == right, text[:80]
        assert " ".join(said) == want.decode(right, skip_special_tokens=False)


def test_bpe_stretches():
    """Only what touches a character beyond Latin letters leaves the fast path, and nothing is lost."""
    for text in hard_texts():
        found = list(bpe.stretches(text))
        assert "".join(x for x, _ in found) == text
        assert all(foreign == bool(re.search("[^\x00-\u017f]", x)) and not (foreign and re.search(r"[ \t-\r]", x)) for x, foreign in found if len(found) > 1)
    assert list(bpe.stretches("It is so. \u201cYes,\u201d he said\n")) == [("It is so. ", False), ("\u201cYes,\u201d", True), (" he said\n", False)]


def test_bpe_cuts_are_certain(library):
    coder = bpe.codec(bpe.default_vocabulary())
    word = "".join(coder.letters[b] for b in "xqzjé漢vwq".encode())
    pieces = coder.cuts(word)
    assert len(pieces) > 1 and "".join(pieces) == word
    assert [k for i, p in enumerate(pieces) for k in coder.merge(p, i == len(pieces) - 1)] == list(coder.merge(word, True))


def test_bpe_digests(odd, none, library):
    got = {r["doc_id"]: r for r in bpe.digests(odd).collect()}
    want = library["word_bpe_49k"]
    for doc_id, text, _, _ in ODD:
        ids = want.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(want.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(none).count() == 0


# -- language model -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order, bucket, size", [(3, 1 << 20, 12 << 20), (3, 500, 5000), (2, 900, 3000), (1, 100, 100)])
def test_lm_scores(spark, docs, texts, monkeypatch, order, bucket, size):
    monkeypatch.setattr(lmscore, "BATCH_BYTES", size)
    counts = [Counter() for _ in range(order + 1)]
    split = {k: lmscore.words(t.encode()) for k, t in texts.items()}
    for w in split.values():
        for n in range(1, order + 1):
            counts[n].update(zip(*(w[k:] for k in range(n))))
    total = sum(counts[1].values())
    got = {r["doc_id"]: r for r in lmscore.score(docs, order=order, bucket_ngrams=bucket).collect()}
    for doc_id, w in split.items():
        score = 0.0
        for k in range(len(w)):
            top = min(k + 1, order)
            n = next((n for n in range(top, 1, -1) if counts[n][tuple(w[k + 1 - n : k + 1])] >= 2), 1)
            gram = tuple(w[k + 1 - n : k + 1])
            score += math.log(counts[n][gram] / (counts[n - 1][gram[:-1]] if n > 1 else total)) + (top - n) * math.log(0.4)
        assert math.isclose(got[doc_id]["log_score"], score, rel_tol=1e-9, abs_tol=1e-9) and got[doc_id]["n_words"] == len(w)


def test_lm_kept_tables(spark, docs, texts, none, monkeypatch):
    """Tables of one corpus, kept and joined: the corpus scores as before, other texts as brute force has it."""
    monkeypatch.setattr(lmscore, "BATCH_BYTES", 20_000)
    tables = lmscore.fit(docs, bucket_ngrams=3000).cache()
    own, again = (sorted((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in lmscore.score(docs, bucket_ngrams=3000, tables=t).collect()) for t in (None, tables))
    assert own == again
    one, two, three = Counter(), Counter(), Counter()
    for t in texts.values():
        w = lmscore.words(t.encode())
        one.update(w), two.update(zip(w, w[1:])), three.update(zip(w, w[1:], w[2:]))
    asked = " ".join([*texts[1].split()[:30], "never-seen", *texts[2].split()[:30]])
    w, score = lmscore.words(asked.encode()), 0.0
    for k in range(len(w)):
        a, b, c = (None, None, w[k]) if not k else (None, w[k - 1], w[k]) if k == 1 else tuple(w[k - 2 : k + 1])
        if k > 1 and three[a, b, c] > 1:
            score += math.log(three[a, b, c] / two[a, b])
        elif k and two[b, c] > 1:
            score += math.log(two[b, c] / one[b]) + math.log(0.4) * (k > 1)
        else:
            score += math.log(max(1, one[c]) / sum(one.values())) + math.log(0.4) * min(k, 2)
    got = lmscore.score(spark.createDataFrame([(9, asked)], "doc_id long, text string"), tables=tables).first()
    assert got["n_words"] == len(w) and math.isclose(got["log_score"], score, rel_tol=1e-9)
    assert [tuple(r) for r in lmscore.fit(none).collect()] == [(0, 0, 1, 0, 0)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lm_batches")]


def test_lm_odd(odd, none):
    got = [(r["doc_id"], r["n_words"], r["log_score"]) for r in lmscore.score(odd).collect()]
    assert len(got) == len(ODD) and {g for g in got if g[0] in (2, 3, None)} == {(2, 0, 0.0), (3, 0, 0.0), (None, 0, 0.0)}
    assert lmscore.score(none).count() == 0


def test_lm_packing():
    for values in (np.zeros(0, np.uint64), np.array([0]), np.array([1, 255, 256, (1 << 64) - 1], np.uint64)):
        assert lmscore.unpack(lmscore.pack(values)).tolist() == values.tolist()


# -- packing ------------------------------------------------------------------------------------------------------------------------


def check_packing(pieces, texts, library, window):
    ids = {k: [*library["byte_bpe_50k"].encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    for k, own in pieces.groupby("doc_id", dropna=False):
        own, at = own.sort_values("start"), 0
        for p in own.itertuples():
            part = np.array(ids[k][p.start : p.start + p.length], "<u4")
            assert p.start == at and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[k])
            at += p.length
        assert at == len(ids[k])
    sizes = []
    for _, own in pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (own.offset.to_numpy() == np.concatenate(([0], own.length.cumsum()[:-1]))).all()
        sizes.append(own.length.sum())
    assert sizes[:-1] == [window] * (len(sizes) - 1) and 0 < sizes[-1] <= window


@pytest.mark.parametrize("window", [2048, 100])
def test_packing(docs, texts, library, window):
    check_packing(packing.digest(packing.pack(docs, window=window)).toPandas(), texts, library, window)


def test_packing_many_tasks(docs, texts, library, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_TASKS", 0)
    check_packing(packing.digest(packing.pack(docs.repartition(7, "doc_id"))).toPandas(), texts, library, 2048)


def test_packing_odd(odd, none, library):
    once = odd.dropDuplicates(["doc_id", "text"]).filter("doc_id is not null")
    check_packing(packing.digest(packing.pack(once)).toPandas(), {k: t for k, t, _, _ in ODD if k is not None}, library, 2048)
    assert packing.pack(none).count() == 0 and packing.pack(odd).select("doc_id").distinct().count() == 7


def test_byte_bpe_equals_library(library):
    coder = packing.byte_bpe(*packing.default_ranks())
    for text in hard_texts():
        assert coder.encode(text).tolist() == library["byte_bpe_50k"].encode(text, add_special_tokens=False).ids


def long_texts():
    """Texts whose words are longer than the splitter and the merging of a byte-level BPE library can take."""
    rng = random.Random(8)
    return [
        "x" + " " * 1_200_000 + "y", "\n" * 1_100_001, "\t" * 1_000_001 + "end", "a" * 1_500_003, "x <|endoftext|>" + "Z" * 700_001 + "'s " + "é" * 600_000,
        " \n" * 600_000 + "b", "".join(rng.choice(["word ", "Two words. ", "\n\n", "12 ", "<|endoftext|>", "é漢 "]) for _ in range(250_000)), "=" * 900_000 + " - " + "!" * 600_000,
    ]


@pytest.mark.parametrize("k", range(8))
def test_byte_bpe_of_long_texts(library, k):
    """Any text is encoded, as the library does."""
    coder, text = packing.byte_bpe(*packing.default_ranks()), long_texts()[k]
    assert np.array_equal(coder.encode(text), library["byte_bpe_50k"].encode(text, add_special_tokens=False).ids)


def test_byte_bpe_in_parts(library, monkeypatch):
    coder = packing.byte_bpe(*packing.default_ranks())
    for long, runs in ((40, 10_000), (8, 3)):
        monkeypatch.setattr(packing, "LONG", long)
        monkeypatch.setattr(packing, "MANY_RUNS", runs)
        for text in [*hard_texts()[:400], "It's 5 o'clock  here.\n\n And there  " * 20, "aaaaaaaab" * 30, "  \n\n\n   \n" * 20 + "z"]:
            assert coder.encode(text).tolist() == library["byte_bpe_50k"].encode(text, add_special_tokens=False).ids, text[:80]


def test_long_texts_in_spark(spark, library):
    """Packing and token counts of a document of blanks, one of a letter, and one of very many lines."""
    texts = {1: "x" + " " * 1_200_000 + "y", 2: "a" * 1_500_003, 3: "b\n" * 300_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packing(packing.digest(packing.pack(df)).toPandas(), texts, library, 2048)
    got = tokencounts.count_sections(df).toPandas()
    assert got.groupby("doc_id").size().to_dict() == {1: 1, 2: 1, 3: 300_001}
    assert (got.groupby("doc_id").n_tokens.sum() == got.groupby("doc_id").doc_tokens.first()).all()
    third = got[got.doc_id == 3].sort_values("part")
    assert third.part.tolist() == list(range(300_001)) and (third.n_tokens[:-1] == 2).all()


# -- URL filter -----------------------------------------------------------------------------------------------------------------------


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path, rules):
    fits = [(len(r), r, v) for v, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://a.b.com/fr/", "https://a.b.com/de", "https://a.b.com/de/x",
        "https://notexample.org/es/1", "http://x.net?q=/a", "http://x.net#f", "http://ÄX.com/fr/é", "a://b://c/d", "http://h.net/a/b/c/d/e/f", "http://com/fr/x"]


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    labels = spark.createDataFrame([], "item long, bad int")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, entries.URL_RULES, labels).collect()}
    for k, url in enumerate(URLS):
        host, path = brute_url(url)
        rule, verdict = brute_rule(host, path, entries.URL_RULES)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, rule, verdict or "allow"), url
    assert urlfilter.judge(pages.filter("false"), entries.URL_RULES, labels).count() == 0


def brute_templates(pages, min_pages=urlfilter.MIN_PAGES):
    """host, path, bad -> template and verdict of the tree, by recursion over nested lists of pages."""
    rows = [(host, [re.sub("[0-9]+", "*", p) for p in path.split("/") if p]) for host, path, _ in pages]
    template = [""] * len(rows)

    def descend(own, prefix, level):
        kids, nodes, wild = {}, {}, []
        for i in own:
            if len(rows[i][1]) == level:
                template[i] = prefix
            else:
                kids.setdefault(rows[i][1][level], []).append(i)
        for segment, inside in kids.items():
            if len(inside) >= min_pages:
                nodes[segment] = inside
            else:
                wild += inside
        if len(wild) >= min_pages:
            nodes["*"] = nodes.get("*", []) + wild
        else:
            for i in wild:
                template[i] = f"{prefix}/**"
        for segment, inside in nodes.items():
            descend(inside, f"{prefix}/{segment}", level + 1)

    for host in {h for h, _ in rows}:
        descend([i for i, r in enumerate(rows) if r[0] == host], host, 0)
    up = lambda t: ["/".join(t.split("/")[: k + 1]) for k in range(t.count("/") + 1)]
    count, bad = Counter(), Counter()
    for (_, _, b), t in zip(pages, template):
        if b is not None:
            count.update(up(t))
            bad.update(up(t) * b)

    def stands_alone(node):
        n, parent = count[node], node.rpartition("/")[0]
        if "/" not in node or n < urlfilter.MIN_LABELS:
            return False
        share = bad[parent] / count[parent]
        return abs(bad[node] - n * share) > urlfilter.MERGE_Z * math.sqrt(max(n * share * (1 - share), 0.25))

    branch = [next((n for n in reversed(up(t)) if stands_alone(n)), t.split("/")[0]) for t in template]
    n, b = Counter(), Counter()
    for (_, _, x), own in zip(pages, branch):
        if x is not None:
            n[own] += 1
            b[own] += x
    share = sum(b.values()) / max(1, sum(n.values()))
    verdicts = []
    for (host, _), own in zip(rows, branch):
        prior = (bad[host] + urlfilter.SMOOTHING * share) / (count[host] + urlfilter.SMOOTHING)
        verdicts.append("block" if n[own] >= urlfilter.MIN_LABELS and (b[own] + urlfilter.SMOOTHING * prior) / (n[own] + urlfilter.SMOOTHING) > urlfilter.MAX_BAD else "allow")
    return template, verdicts


def url_pages():
    """Wide nodes with one bad section, sections that differ only far below, branches alike, rare children, odd hosts."""
    rng, pages = random.Random(2), []
    for _ in range(6000):
        host = rng.choice(["a.net", "b.net", "a.net", ""])
        kind = rng.choice(["spam", "news", "user", "", "deep", "wide", "shop"])
        name = chr(97 + rng.randrange(26)) + chr(97 + rng.randrange(26))
        wide, low = f"s{chr(97 + rng.randrange(8))}{chr(97 + rng.randrange(8))}", rng.choice(["good", "bad"])
        path = {"spam": f"/spam/{rng.randint(0, 999)}", "news": f"/news/{rng.choice('pq')}/{rng.randint(0, 9)}.html", "user": f"/user/n{name}/posts", "deep": f"/a/b/c/d/e/f/g/{low}/x",
                "wide": f"/wide/{wide}/{rng.randint(0, 9)}", "shop": f"/shop/{rng.choice(['one', 'two', 'three', f'{name}q'])}//{low}"}.get(kind, "/")
        often = 0.95 if kind == "spam" or kind == "user" and host == "b.net" or kind in ("deep", "shop") and low == "bad" or wide == "sab" and kind == "wide" else 0.03
        pages.append((host, path, int(rng.random() < often) if rng.random() < 0.6 else None))
    return pages + [("a.net", f"/wide/k{chr(97 + k // 8)}{chr(97 + k % 8)}/{n}", int(k == 50) if n % 2 else None) for k in range(60) for n in range(14)]


def test_url_tree(spark):
    pages = url_pages()
    rows = [(k, f"http://{h}{p}" if h else None if p == "/" else f"://{p}", b, "clash", 1) for k, (h, p, b) in enumerate(pages)]
    rows += rows[:5]  # repeated rows
    pages = [(h, p if h or p != "/" else "", b) for h, p, b in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int, template string, id int")
    got = urlfilter.judge(df, [], df.select(F.col("page_id").alias("item"), "bad"))
    assert got.count() == len(rows) and got.columns == ["page_id", "host", "path", "rule", "verdict", "template"]
    got = {r["page_id"]: r for r in got.collect()}
    template, verdict = brute_templates([*pages, *pages[:5]])
    assert [got[k]["template"] for k in range(len(pages))] == template[: len(pages)]
    assert [got[k]["verdict"] for k in range(len(pages))] == verdict[: len(pages)]
    seen = {(h, p): got[k]["verdict"] for k, (h, p, _) in enumerate(pages)}
    assert seen["a.net", "/a/b/c/d/e/f/g/bad/x"] == "block" and seen["a.net", "/a/b/c/d/e/f/g/good/x"] == "allow"  # however deep
    assert {v for (h, p), v in seen.items() if h == "a.net" and p.startswith("/wide/")} == {"allow", "block"}  # however wide
    assert {v for (h, p), v in seen.items() if h == "b.net" and p.startswith("/user/")} == {"block"}  # rare children together
    assert len({t.split("/")[2] for t in template if t.startswith("a.net/user/")}) < 676


def test_url_branches_merge(spark):
    """Two subtrees that are bad alike are one branch: a template with few labels below them goes too; a good one stays."""
    pages = [("h.net", f"/x/{side}/{leaf}", 1 if side != "r" else 0) for side in "pqr" for leaf in "abcdef" for _ in range(12)]
    pages = [(h, p, b if p[-1] != "f" else None) for h, p, b in pages] + [("h.net", "/y", 0)] * 100
    df = spark.createDataFrame([(k, f"http://{h}{p}", b) for k, (h, p, b) in enumerate(pages)], "page_id long, url string, bad int")
    got = {r["path"]: r["verdict"] for r in urlfilter.judge(df, [], df.select(F.col("page_id").alias("item"), "bad")).collect()}
    assert got["/x/p/f"] == got["/x/q/f"] == "block" and got["/x/r/f"] == got["/y"] == "allow"
    tree = df.select(F.lit("h.net").alias("host"), F.concat(F.lit("h.net"), urlfilter.path(F.col("url"))).alias("template"), F.col("bad").isNotNull().cast("int").alias("labels"), F.coalesce("bad", F.lit(0)).alias("bad"))
    branch = {r["template"]: r["branch"] for r in urlfilter.rejected(tree).collect()}
    assert branch["h.net/x/p/a"] == branch["h.net/x/p/f"]


@pytest.mark.parametrize("limit", [100_000, -1])
def test_url_odd(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "BROADCAST_PATHS", limit)
    long = "http://h.net/" + "/".join(["seg"] * 3000) + "?" + "q" * 100_000
    df = spark.createDataFrame([(k, u) for k, u in enumerate([*URLS, long, None])] + [(None, long)], "page_id long, url string")
    none = spark.createDataFrame([], "item long, bad int")
    got = urlfilter.judge(df, [], none).collect()
    assert len(got) == len(URLS) + 3 and {r["verdict"] for r in got} == {"allow"}
    assert {r["template"] for r in got if "seg" in r["path"]} == {"h.net/**"}
    if limit > 0:
        short = df.filter("page_id = 14")  # http://h.net/a/b/c/d/e/f
        assert [r["template"] for r in urlfilter.judge(short, [], none, min_pages=1).collect()] == ["h.net/a/b/c/d/e/f"]
    labels = spark.createDataFrame([(k, 1) for k in range(len(URLS))], "item long, bad int")
    assert urlfilter.judge(df.filter("false"), [], labels).count() == 0


# -- near copies in the pipeline ----------------------------------------------------------------------------------------------------


def brute_shingles(text):
    words = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def unite(n, pairs):
    """The smallest member of each number's component."""
    root = list(range(n))
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return root


def brute_near(texts):
    """id -> smallest id reachable by pairs of 0.8 or more."""
    ids, sets = sorted(texts), []
    sets = [brute_shingles(texts[k]) for k in ids]
    near = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return {k: ids[r] for k, r in zip(ids, unite(len(ids), near))}


def test_pipeline_drops_near_copies(spark, monkeypatch):
    """Planted near copies of 0.8 to 0.95 go, less similar texts stay, chains and a group of many join."""
    rng, rows = random.Random(5), []
    for base in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 400))]
        rows.append(words)
        for _ in range(60 if base == 0 else 3):
            changed = list(rows[-1] if base % 7 == 0 else words)
            for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.choice([0.006, 0.015, 0.022, 0.06])))):
                changed[at] = f"x{rng.randrange(10**6)}"
            rows.append(changed)
    texts = {k: " ".join(w) for k, w in enumerate(rows)}
    sets = [brute_shingles(t) for t in texts.values()]
    planted = sum(0.8 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.95 for a in range(len(sets)) for b in range(a))
    roots = set(brute_near(texts).values())
    assert planted > 100 and 60 < len(roots) < len(texts) / 2
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (1024, 7):  # whole stars, and stars in many blocks
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == roots


def test_near_copies_by_simhash(spark, monkeypatch):
    """The stage's candidates are operator 4's families and nothing else: without them no near copy is found."""
    words = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(k, " ".join([*words[:100], f"x{k}", *words[101:]])) for k in range(9)], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [0]
    monkeypatch.setattr(nearcopies, "wide_families", lambda rows, similarity: rows.selectExpr("node star", "n star_n", "node", "n").limit(0))
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 9


@pytest.mark.parametrize("block", [1 << 16, 60])
def test_wide_families_are_whole(spark, monkeypatch, block):
    """Every pair at 0.8 or above, of 4 to 500 shingles, lies in a family, also where cells are cut into blocks."""
    rng, sets = np.random.default_rng(8), []
    for k in range(200):
        base = rng.integers(0, 1 << 63, rng.integers(5, 500), np.uint64) * np.uint64(2)
        sets += [base, base[: -(-len(base) * 4 // 5)], base[len(base) // 5 :], rng.integers(0, 1 << 63, 100, np.uint64)]
    tables, width = simhash.choose_tables(len(sets), 0.8)
    fps = np.array([simhash.long_fingerprint(s, -(-tables * width // 32)) for s in sets])
    cells = simhash.wide_cells(fps, tables, width).tolist()
    signed = fps[:, : simhash.WIDE].copy().view(np.int64).tolist()
    ddl = "node long, n long, " + "".join(f"w{k} long, " for k in range(simhash.WIDE)) + "cells array<long>"
    rows = spark.createDataFrame([(k, len(s), *signed[k], cells[k]) for k, s in enumerate(sets)], ddl)
    monkeypatch.setattr(simhash, "CELL_BLOCK", block)
    met = simhash.wide_families(rows, 0.8).toPandas()
    stars = met.groupby("node").star.agg(set)
    assert set(met.n) <= {len(s) for s in sets} and not any(k in stars.index for k in range(3, len(sets), 4))
    assert all(stars[k] & stars[k + other] for k in range(0, len(sets), 4) for other in (1, 2))


def test_families_join_what_chains_join():
    """A crowd, chains and strangers of one cell: labels equal those of all pairs compared one by one."""
    rng = np.random.default_rng(9)
    fps, size = rng.integers(0, 1 << 63, (1500, simhash.WIDE), np.uint64), rng.integers(50, 500, 1500)
    for k in range(1, 900):  # 0 to 599 a crowd around the first, 600 to 899 chains of 10
        if k % 10 or k < 600:
            fps[k] = fps[0 if k < 600 else k - 1]
            size[k] = size[0 if k < 600 else k - 1]
            for bit in rng.choice(64 * simhash.WIDE, 30, replace=False):
                fps[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    limit, close = simhash.wide_limit(0.8), lambda a, b: min(size[a], size[b]) >= 0.8 * max(size[a], size[b])
    near = [(a, int(b)) for a in range(1500) for b in np.nonzero(np.bitwise_count(fps[:a] ^ fps[a]).sum(1, dtype=int) <= limit)[0] if close(a, b)]
    got, want = simhash.families(fps, size, 0.8), unite(1500, near)
    assert len(near) > 100_000 and len(set(want)) == len(set(got.tolist())) == len(set(zip(want, got.tolist())))


def test_near_copies_forest():
    """Of stars with crowds just below and above the similarity, the links join what brute force joins."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = rng.integers(0, 1 << 40, 100)
        sets = [np.unique(np.where(rng.random(100) < rng.choice([0.02, 0.1, 0.13]), rng.integers(0, 1 << 40, 100), base)) for _ in range(80)]
        root = rng.integers(0, 4, 80) * (np.arange(80) < 30) + np.arange(80) * (np.arange(80) >= 30)
        found = nearcopies.forest(root, np.array([len(s) for s in sets]), np.concatenate(sets), 0.8)
        near = [(a, b) for a in range(80) for b in range(a) if (n := len(np.intersect1d(sets[a], sets[b]))) / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
        first = {int(r): int(np.nonzero(root == r)[0][0]) for r in np.unique(root)}  # found links components, not sets
        own = [(k, first[int(root[k])]) for k in range(80)]
        assert found and unite(80, near + own) == unite(80, [(first[a], first[b]) for a, b in found] + own)


# -- queries and pipeline ----------------------------------------------------------------------------------------------------------


def test_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", entries.oracle_sql())
def test_oracle(spark, tables, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    got, want = entries.queries()[name](spark, tables).toPandas(), con.sql(entries.oracle_sql()[name]).df()
    key = sorted(got.columns)
    assert key == sorted(want.columns)
    pd.testing.assert_frame_equal(*(x[key].sort_values(key, ignore_index=True) for x in (got, want)), check_dtype=False)


def test_pipeline(spark, tables, texts, library):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    kept = {k: t for k, t in texts.items() if not quality_fails(t)}
    total, pages = Counter(source[k] for k in kept), Counter()
    for k, t in kept.items():
        pages.update((source[k], x) for x in set(t.split("\n")) if x.strip(" \t\x0b\x0c\r"))
    bad = {key for key, n in pages.items() if n >= linededup.MIN_PAGES and n > linededup.MAX_RATIO * total[key[0]]}
    kept = {k: "\n".join(x for x in t.split("\n") if (source[k], x) not in bad) for k, t in kept.items()}
    kept = {k: kept[k] for k in set(brute_near(kept).values())}
    got = corpus_pipeline.run(spark, tables).toPandas()
    assert set(got.doc_id) == set(kept)
    check_packing(got, kept, library, 2048)


def quality_fails(text):
    n_words, chars, symbols, dup, repeat, lines, upper, letters = quality.measure(text.encode())
    return (n_words < 50 or 100 * repeat > 50 * n_words or 10 * symbols > n_words or dup >= 3 and 10 * dup > 3 * lines
            or chars < 2 * n_words or chars > 15 * n_words or upper > 0 and 2 * upper > letters or 2 * letters < chars)


def test_stages_on_odd_documents(spark, odd, none):
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.filter("false"), "").count() == 0, name


def test_language_stage_without_labels(spark, odd):
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 5, 7] and all(r["lang"] is None for r in got)

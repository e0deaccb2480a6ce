"""The methods of the operators, their recall and their edge cases, against brute force."""

import glob
import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eigenlake.llm import bpe, decontam, embeddings, graph, lengths, licenses, minhash, queries, sharding, substring, toxicity, urls
from eigenlake.llm import wordhash as W
from eigenlake.llm.queries import tokenizer

WORDS = [f"w{i}" for i in range(300)]
DIR = "/root/testdata/sf0.001"


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_fool_sums_of_powers(spark):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    assert W.hash_word(a) != W.hash_word(b)
    filler = [f"x{i}" for i in range(60)]
    one, two = [*filler[:30], a, *filler[30:]], [*filler[:30], b, *filler[30:]]
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, " ".join([a] * 5)), (4, " ".join([b] * 5))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}  # 1 and 2 share 52 of 62


def test_word_slices():
    rng = random.Random(0)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for _ in range(50)] + ["", None, " a\n\nb\tc ", "é" * 200 + " z", "w1"]
    (part,) = W.words(pa.array(texts))
    words = [w for t in texts for w in (t or "").split()]
    assert [part.word(i).decode() for i in range(len(words))] == words
    assert len(set(part.codes.tolist())) == len(set(words)) == len(set(part.hashes.tolist()))
    assert part.hashes.tolist() == [W.hash_word(w) for w in words]
    assert part.between(part.bound[:-1], part.bound[1:]) == [" ".join((t or "").split()).encode() for t in texts]
    rank = W.ranked(part.codes, 7)
    seven = [tuple(part.codes[i : i + 7]) for i in range(len(words) - 6)]
    assert [sorted(set(seven)).index(x) for x in seven] == rank.tolist()
    x = np.array([3, 1, 1, 2, 0, 5, 0])
    assert W.first_min(x, 3).tolist() == [1, 1, 4, 4, 4]


def test_fingerprints_and_index(spark):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(20)]
    for p in list(prints):
        for k in (1, 10, 23, 24, 30):
            flip = 0
            for bit in rng.sample(range(64), k):
                flip |= 1 << bit
            prints.append(((p + (1 << 63)) ^ flip) - (1 << 63))
    df = spark.createDataFrame([(7, i, p) for i, p in enumerate(prints)], "m int, i int, print long")
    found = decontam.near_pairs(df, df.select("m", F.col("i").alias("j"), F.col("print").alias("item_print"))).collect()
    want = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(prints) if bin((p ^ q) & (1 << 64) - 1).count("1") <= 23}
    assert len(found) == len(want) and {(r.i, r.j) for r in found} == want
    row = spark.createDataFrame([([5, 5, 9, 5, -3],)], "s array<long>").select(decontam.features_of(F.col("s")).alias("f"), decontam.fingerprint(decontam.features_of(F.col("s"))).alias("p")).first()
    assert row.f[0] == -3 and row.f[1] == 5 and row.f[4] == 9 and len(set(row.f)) == 5
    bits = [sum((x >> b) & 1 for x in row.f) * 2 > 5 for b in range(64)]
    assert row.p & (1 << 64) - 1 == sum(1 << b for b, y in enumerate(bits) if y)


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def test_recall_of_leaks(spark):
    """Planted windows at a similarity of 0.75 to 0.85, some with a repeated word."""
    rng = random.Random(2)
    items, rows = [], []
    for i in range(60):
        size = rng.choice([24, 40, 80])
        words = [f"i{i}x{j}" for j in range(size)]
        items.append((i, " ".join(words)))
        for v in range(5):
            while True:
                w = list(words)
                if v % 2:
                    w[-rng.randint(1, size // 6) :] = []
                    w += ["same"] * (size - len(w))
                else:
                    for _ in range(rng.randint(1, 3)):
                        w[rng.randrange(size)] = "new"
                a, b = grams(w, 5), grams(words, 5)
                if 0.75 <= sum((a & b).values()) / sum((a | b).values()) <= 0.85:
                    break
                if v % 2 == 0 and size == 24:  # one inner word takes five of 20 shingles
                    w = [*words[:-2], "new", "other"]
                    break
            rows.append((5 * i + v, " ".join([*rng.choices(WORDS, k=20), *w, *rng.choices(WORDS, k=20)])))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got) >= 0.99 * len(rows) and all(d // 5 == i for d, i in got)


def test_leaks_in_repeated_rows_and_long_texts(spark):
    rng = random.Random(3)
    item = " ".join(WORDS[:30])
    long = rng.choices(WORDS[100:], k=20_000)
    long[15_000:15_000] = item.split()
    rows = [(1, item, "a"), (1, item, "b"), (2, " ".join(long), "c"), (3, None, "d"), (None, item, "e"), (None, item, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")  # a column named as one of the items'
    alone = {r.doc_id: r for r in decontam.leaks(docs, spark.createDataFrame([(9, item, "x"), (9, item, "y")], "item_id long, text string, doc_id string")).collect()}
    once = decontam.leaks(spark.createDataFrame([(1, item)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert set(alone) == {1, 2, None} and alone[1].n_windows == alone[None].n_windows == once.n_windows
    assert alone[2].first_word == 15_000 and alone[2].similarity == 1.0


def test_recall_of_embeddings(spark):
    rng = np.random.default_rng(4)
    n, d = 1500, 32
    base = rng.standard_normal((n, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((n, d))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.96, n)[:, None]
    v = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[i + n] == got[i] for i in range(n)) >= 0.998 * n
    tables, projections = embeddings.settings(1 << 20)
    assert projections == 22 and tables > embeddings.settings(100)[0]


@pytest.mark.parametrize("hub", [100, 2])
def test_components(spark, hub, monkeypatch):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(5)
    pairs = [(0, i) for i in range(1, 40)] + [(99, i) for i in range(50, 80)] + [(i, i + 1) for i in range(100, 130)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7), (None, 3), (50, 70), (50, 70)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(top)}


def test_ordinal_fit_is_a_minimum():
    rng = np.random.default_rng(6)
    n, penalty = 400, 5e-3
    has = rng.random((n, 6)) < 0.4
    score = has @ np.array([2.0, 1.0, 0.0, 0.0, -1.5, 0.0])
    grade = (score + rng.logistic(size=n) > 0.5).astype(int) + (score + rng.logistic(size=n) > 2.5)
    doc, bucket = np.nonzero(has)
    model = toxicity.fit(grade, doc, bucket, penalty, steps=4000)

    def cost(w, t):
        m = toxicity.Model(w, t)
        return toxicity.loss(m, grade, toxicity._scores(w, doc, bucket, n)) + penalty * np.abs(w).sum()

    best = cost(model.weights, model.thresholds)
    for j in range(6):
        for step in (-1e-2, 1e-2):
            w = model.weights.copy()
            w[j] += step
            assert cost(w, model.thresholds) >= best - 1e-7
    for j in range(len(model.thresholds)):
        for step in (-1e-2, 1e-2):
            t = model.thresholds.copy()
            t[j] += step
            assert cost(model.weights, t) >= best - 1e-7
    e = toxicity.Model(np.zeros(4), np.array([0.0, 1.0])).expected(np.array([0.0]))
    assert abs(e[0] - (0.5 + 1 / (1 + np.e))) < 1e-12


def scalar_jump(key, shards):
    state, at, to = key % 2**64, -1, 0
    while to < shards:
        at = to
        state = (state * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (2**31 / ((state >> 33) + 1)))
    return at


def test_sharding_against_the_scalar_walk(spark):
    rows = [(i * 7919 - 3, "t" * (i % 5), "x") for i in range(300)] + [(None, "n", "x"), (None, None, "x"), (5, "again", "x"), (5, "again", "x")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.shard, r.grown_shard) == (scalar_jump(r.doc_id or 0, 8), scalar_jump(r.doc_id or 0, 9))
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    keys = [0, 1, 2**40, 2**63 - 1, -1]
    assert sharding.jump(np.array(keys), 1000).tolist() == [scalar_jump(k, 1000) for k in keys]


def test_whole_licences(spark):
    rows = [(i, f"# Copyright (c) {2000 + i} Somebody\n" + re.sub(r"\s+", "\n * ", text) + "\nint main() {}", "x") for i, (_, _, text) in enumerate(licenses.TEXTS)]
    rows += [(100, "This is not a licence and says nothing of permissions", "x"), (None, licenses.TEXTS[0][2], "x"), (101, licenses.TEXTS[0][2], "x"), (101, licenses.TEXTS[0][2], "x")]
    got = licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    by = {r.doc_id: r for r in got}
    for i, (label, _, _) in enumerate(licenses.TEXTS):
        assert label in by[i].labels.split(",") and by[i].score > 0.9
    assert by[100].labels == "" and by[100].score == 0 and "mit" in by[None].labels and len(got) == len(rows)
    assert "bsd-2" not in by[2].labels.split(",") and "gpl-3" not in by[5].labels.split(",")


def test_urls_with_unseen_suffixes():
    rng = random.Random(7)

    def url(bad, suffix):
        host = "".join(rng.choices("abcdefgh", k=rng.randint(5, 9)))
        if bad:
            return f"http://{host}{rng.randint(100, 99999)}-{rng.randint(1, 99)}.{suffix}/{'/'.join(str(rng.getrandbits(40)) for _ in range(3))}?id={rng.getrandbits(30)}&s={rng.randint(1, 9)}"
        return f"http://{host}.{suffix}/{'/'.join(rng.choice(['about', 'news', 'team', 'shop']) for _ in range(rng.randint(0, 3)))}"

    import pandas as pd

    train, test = ([url(i % 2, s[i % len(s)]) for i in range(600)] for s in (["org", "com", "fr"], ["info", "de"]))
    model = urls.fit(train, np.arange(600) % 2.0)
    p = model.probability(pd.Series(test))
    assert np.mean((p >= 0.5) == np.arange(600) % 2) > 0.97


def test_url_edges(spark):
    rows = [(None, "http://net/", "x"), (1, None, "x"), (1, None, "x"), (2, "HTTP://WWW.NET/" + "a" * 20_000, "x"), (3, "http://éx.org/fr/é", "x"), (4, "a://b://net/", "x")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} <= {"allow", "block"}
    by = {r.page_id: r for r in got}
    assert (by[None].rule, by[None].verdict) == ("net/", "block") and by[2].host == "www.net" and by[2].rule == "net/"
    assert (by[3].host, by[3].rule, by[3].verdict) == ("éx.org", "org/fr/", "allow") and by[4].host == "b:"


def test_token_counts_equal_tiktoken(spark):
    import tiktoken

    path, pattern = tokenizer()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    counts = {r.doc_id: r.n_tokens for r in bpe.count_documents(docs, path, pattern).collect()}
    want = {r.doc_id: len(theirs.encode_ordinary(r.text or "")) for r in docs.collect()}
    assert counts == want
    sums = queries.op8_token_counts(spark, DIR).collect()
    n = list(want.values())
    for r in sums:
        assert (r.n_docs, r.docs_over, r.truncated_total) == (n.count(r.length), sum(x > r.length for x in n), sum(min(x, r.length) for x in n))
    assert {r.length for r in sums} == set(n)
    for r in queries.op9_bpe_round_trip(spark, DIR).limit(50).collect():
        text = docs.where(F.col("doc_id") == r.doc_id).first().text or ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_tokens == want[r.doc_id]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        duck.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, DIR)
    q = duck.execute(queries.ORACLES[name])
    have, cols = [x[0] for x in q.description], sorted(df.columns)
    assert sorted(have) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[have.index(c)] for c in cols) for r in q.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLES.keys()))
def test_query_covers_its_table(spark, name):
    out = queries.QUERIES[name](spark, DIR)
    table = {"op7": "pages", "op4": "documents", "op5": "documents", "op6": "documents", "op9": "documents"}.get(name[:3])
    if table:
        assert out.count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()
    else:
        assert out.count() > 0


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c d e f", "k"), (1, "a b c d e f", "k"), (None, "a b c d e f", "k"), (2, None, "k"), (2, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumn("n", F.lit(1)).withColumn("severity", F.lit("s"))
    path, pattern = tokenizer()
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0), (None, 1), (1, None)], "doc_id long, grade int"))
    for out in (toxicity.score(docs, model), toxicity.keep_clean(docs, model), bpe.digest_documents(docs, path, pattern), bpe.count_documents(docs, path, pattern), licenses.scan_documents(docs), sharding.assign(docs), minhash.near_duplicates(docs), substring.remove_repeats(docs)):
        assert out.count() <= 5 and out.where("doc_id = 1").count() in (0, 2)
    sums = lengths.suffix_sums(lengths.length_histogram(bpe.count_documents(docs, path, pattern)))
    assert sums.agg(F.sum("n_docs")).first()[0] == 5
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "k"), (1, [1.0, 0.0], "k"), (None, [1.0, 0.0], "k"), (2, None, "k")], "vec_id long, embedding array<double>, id string")
    assert sorted((r.vec_id or 0, r.n_links) for r in embeddings.near_duplicates(vectors).collect()) == [(0, 0), (1, 1), (1, 1), (2, 0)]


def test_units_of_texts_are_digested_once_and_as_matches_alone():
    own, draw = bpe.encoder(*queries.tokenizer()), random.Random(1)
    some = [" ", "  ", "\n", "\t", "a", "Bc", "é", "1", ".", "'s", "'", "\x85", "\xa0", "　", "\x1c", "​", "中", "\r\n", ""]
    texts = ["".join(draw.choice(some) for _ in range(draw.randrange(12))) for _ in range(3000)] + [None, "", " ", "one word, " * 500]
    got = [x.to_pylist() for x in own.digests(pa.array(texts, pa.string()))]
    want = [own.encode(x or "") for x in texts]
    assert got[0] == [len(x) for x in want]
    assert got[1] == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in want]
    assert got[2] == [hashlib.sha256((x or "").encode()).hexdigest() for x in texts]
    units, unit, bound = own._units(pa.array(["one word, " * 500]))
    assert len(unit) == bound[-1] == 1000 and len(units) < 10


def test_components_need_few_jobs(spark):
    draw = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(0, 400)] + [(1000, int(x)) for x in range(1001, 1400)] + [(int(x), int(y)) for x, y in draw.integers(2000, 2600, (400, 2))] + [(5, 5)]
    nodes, root = graph.roots(*(np.array(x) for x in zip(*pairs, strict=True)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components", "")
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(7), "a", "b").collect()}
    jobs = len(tracker.getJobIdsForGroup("components"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {int(n): int(r) for n, r in zip(nodes, root, strict=True) if n != 5 or r != 5}
    assert jobs < 90  # 188 when each round took two plans of the whole step

"""The operators of llm against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from eigenlake.llm import bpe, decontam, embeddings, lengths, licenses, minhash, sharding, substring, toxicity, urls
from eigenlake.llm.queries import tokenizer

WORDS = [f"w{i}" for i in range(300)]


def texts(rng, n=60):
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(60, 150))) for _ in range(6)]
    out = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w) if i % 7 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 80))))
    return [*out, out[3], out[3], None, "", " \t\n", "one", "One two", "one two"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra", i) for i, t in enumerate(texts(random.Random(1)))]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n long")


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(nodes, links):
    top = {i: i for i in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {i: find(i) for i in nodes}


@pytest.mark.parametrize("block", [2048, 4])
def test_minhash(docs, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = docs.collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {i: (len(s), want[i], want[i] == i) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_settling_needs_no_first_pivot():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 10, 20, 500)]
    linked = minhash._linked(sets, np.array([0, 3]), 75)  # of a member with itself it says nothing
    assert linked[0, 1:].tolist() == [True, False, False] and not linked[1, :3].any()


@pytest.mark.parametrize("budget", [1 << 22, 5000, 1])
def test_substring(docs, budget, monkeypatch):
    monkeypatch.setattr(substring, "BUDGET", budget)
    seen, want = set(), {}
    for r in sorted(docs.collect()):
        w = (r.text or "").split()
        windows = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        gone = {j for i, x in enumerate(windows) if x in seen for j in range(i, i + 50)}
        seen |= set(windows)
        want[r.doc_id] = len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)
    assert want == {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs).collect()}
    kept = {r.doc_id: r.text for r in substring.strip_repeats(docs).collect()}
    assert all(kept[i] == x[2] for i, x in want.items() if x[1])


def test_null_and_repeated_ids(spark):
    t = " ".join(WORDS[:60])
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.remove_repeats(df).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 60)]
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(df).collect()) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    for f in (substring.remove_repeats, minhash.near_duplicates, sharding.assign, licenses.scan_documents, lambda d: toxicity.score(d, toxicity.train(d, spark.createDataFrame([], "doc_id long, grade int"))), lambda d: decontam.leaks(d, spark.createDataFrame([], "item_id long, text string")), lambda d: bpe.digest_documents(d, *tokenizer()), lambda d: lengths.suffix_sums(lengths.length_histogram(bpe.count_documents(d, *tokenizer())))):
        assert f(docs).collect() == []
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_leaks(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 40)))) for i in range(8)] + [(8, None), (9, ""), (10, "Only three words")]
    rows = []
    for i in range(40):
        w = items[i % 8][1].split()
        for _ in range(i // 8):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join([*rng.choices(WORDS, k=30), *w, *rng.choices(WORDS, k=30)])))
    rows += [(40, None), (41, ""), (42, "x ONLY three, words y"), (43, items[0][1])]
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = {}
    for d, t in rows:
        w = split(t)
        for i, it in items:
            m = len(split(it))
            if not m or not w:
                continue
            own, n = grams(split(it), min(m, 5)), 0
            for at in range(max(1, len(w) - m + 1)):
                g = grams(w[at : at + m], min(m, 5))
                n += 100 * sum((g & own).values()) >= 75 * sum((g | own).values()) > 0
            if n:
                want[d, i] = n
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert want == {(r.doc_id, r.item_id): r.n_windows for r in got.collect()}


def test_leaks_with_a_repeated_word(spark):
    items = [(n, " ".join(f"v{n}x{i}" for i in range(n + 4))) for n in (100, 300, 600, 1000)]
    rows, want = [], {}
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    for n, text in items:
        cut = n // 8
        words = ["before"] * 3 + text.split()[:-cut] + ["again"] * cut + ["after"] * 3
        rows.append((n, " ".join(words)))
        own = grams(text.split())
        similar = [sum((g & own).values()) / sum((g | own).values()) for at in range(len(words) - n - 3) for g in [grams(words[at : at + n + 4])]]
        want[n, n] = sum(x >= 0.75 for x in similar), similar.index(max(similar)), max(similar)
    assert all(x[0] for x in want.values())
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert want == {(r.doc_id, r.item_id): (r.n_windows, r.first_word, r.similarity) for r in got.collect()}


def test_leaks_without_ids(spark, tmp_path):
    import corpus_pipeline

    a, b = " ".join(WORDS[:30]), " ".join(WORDS[40:80])
    items = spark.createDataFrame([(None, a), (None, b), (1, b)], "item_id long, text string")
    docs = spark.createDataFrame([(None, a), (None, "clean words of no item at all"), (None, None), (5, b), (6, "more clean words"), (7, "first text"), (7, a)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontam.leaks(docs, items).collect()}
    assert set(got) == {(None, None), (5, None), (5, 1), (7, None)}
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, "clean words of no item at all"), (6, "more clean words")]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 16))
    v = [*(b + 0.1 * rng.standard_normal(16) for b in base for _ in range(5)), *base[:3], *base[:3]]
    rows = [(i, [float(np.float32(y)) for y in x]) for i, x in enumerate(v)] + [(200, None), (201, [0.0] * 16), (202, [1.0, float("nan")]), (203, [1.0, None]), (204, [1.0]), (205, [])]
    good = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if x and None not in x and np.isfinite(x).all() and any(x)}
    links = [(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    want, n = roots([i for i, _ in rows], links), Counter(a for a, _ in links)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {i: (n[i], want[i]) for i, _ in rows} == {r.vec_id: (r.n_links, r.component_id) for r in got}


def test_vectors_that_share_an_id(spark):
    a, b, c = ([float(i == j) for i in range(4)] for j in range(3))
    near = lambda v: [x + 0.05 for x in v]
    rows = [(0, near(b)), (1, a), (1, b), (2, near(a)), (3, b), (4, None), (4, c), (4, None), (5, near(c))]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    want = [(0, 2, 0), (1, 1, 1), (1, 2, 0), (2, 1, 1), (3, 2, 0), (4, 0, 4), (4, 0, 4), (4, 1, 4), (5, 1, 4)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, k=40) + (["vile"] * (i % 3 > 0) + ["worst"] * (i % 3 > 1)))) for i in range(600)] + [(600, None), (601, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 3) for i in range(300)], "doc_id long, grade int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[i].rejected == (i % 3 > 0) for i in range(300, 600)) >= 290
    assert not got[600].rejected and not got[601].rejected and len(got) == 602
    assert np.mean([got[i].severity for i in range(301, 600, 3)]) < np.mean([got[i].severity for i in range(302, 600, 3)])
    assert (np.diff(model.thresholds) >= 0).all()


def test_sharding(docs):
    rows = sharding.assign(docs).collect()
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in rows)
    keys = np.arange(100_000)
    before, after = sharding.jump(keys, 10), sharding.jump(keys, 11)
    assert set(after[before != after]) == {10} and abs((before != after).mean() - 1 / 11) < 0.01


def test_licenses(spark):
    rows = [(0, "x Under the MIT-License, and under the mit license"), (1, None), (2, "Apache License, Version 2.0"), (3, "a under b the mit license"), (4, "é cc by nc"), (5, "Redistribution and use in source and binary forms, with or without modification, are permitted."), (6, "under the mit"), (7, "license under the mit")]
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (rows[r.doc_id][1] or "").lower())
        at = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert r.labels == "bsd" if r.doc_id == 5 else True


def test_urls(spark):
    rows = [(0, "http://A.Example.NET/en/x?y"), (1, "https://net/"), (2, "http://x.net"), (3, None), (4, "no scheme"), (5, "http://example.com/de/1#t"), (6, "https://m.a.org/fr/"), (7, "http://notnet/")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(8)] == [("a.example.net", "/en/x", "example.net/en/"), ("net", "/", "net/"), ("x.net", "", None), ("", "", None), ("", "", None), ("example.com", "/de/1", "example.com/de/"), ("m.a.org", "/fr/", "org/fr/"), ("notnet", "/", None)]
    assert all(got[i].verdict in ("allow", "block") for i in got)
    rng = random.Random(5)
    many = [f"http://{rng.choice('abc')}{rng.randint(0, 99)}.example.org/{'/'.join('x' * rng.randint(1, 5) for _ in range(3))}{'?a=1&b=2' * (i % 2)}" for i in range(800)]
    model = urls.fit(many[:400], np.array([i % 2 for i in range(400)], float))
    import pandas as pd

    assert np.mean((model.probability(pd.Series(many[400:])) >= 0.5) == np.arange(400, 800) % 2) > 0.97


def test_repeated_urls_are_one_example(spark):
    rows = [(f"http://a{i}.org/{'x' * (i % 5)}", i % 2) for i in range(10)]
    rows = sorted(rows * 30)
    got = urls.train(spark.createDataFrame(rows, "url string, blocked int"), sample=10)
    assert got.trees and got.default == 5.5 / 11


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path, pattern = tokenizer()
    own = bpe.encoder(path, pattern)
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(6)
    chars = [chr(c) for c in (9, 10, 13, 28, 32, 32, 0x85, 0xA0, 0x200B, 0x3000)] + list("abcst'sre LL0129²Ⅷé漢😀_-!%")
    for _ in range(1000):
        s = "".join(rng.choice(chars) for _ in range(rng.randint(0, 30)))
        assert own.encode(s) == theirs.encode_ordinary(s)
    for s in ("a" * 20_000, "ab" * 9000, " " * 20_000):
        assert own.encode(s) == theirs.encode_ordinary(s)
    df = spark.createDataFrame([(1, "ab c"), (2, None), (3, "")], "doc_id long, text string")
    for r in bpe.digest_documents(df, path, pattern).collect():
        t = {1: "ab c"}.get(r.doc_id, "")
        ids = theirs.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = bpe.decode_documents(bpe.encode_documents(df, path, pattern), path, pattern).collect()
    assert {r.doc_id: bytes(r.data) for r in back} == {1: b"ab c", 2: b"", 3: b""}


def test_length_sums(spark):
    n = [0, 3, 3, 5000, 1023, 1024, 2, 0]
    got = lengths.suffix_sums(lengths.length_histogram(spark.createDataFrame([(x,) for x in n] + [(None,)], "n_tokens long")))
    n.append(0)
    for r in got.collect():
        x = r.length
        assert (r.n_docs, r.docs_over, r.tokens_over, r.truncated_total) == (n.count(x), sum(y > x for y in n), sum(y for y in n if y > x), sum(min(x, y) for y in n))
        assert (r.docs_up_to, r.tokens_up_to) == (sum(y <= x for y in n), sum(y for y in n if y <= x))
    assert lengths.length_at_quantile(got, 0.5).first().length == sorted(n)[4]

"""Each stage of the pipeline, and all of them, against brute force on a small table."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from eigenlake.llm.queries import tokenizer

WORDS = [f"w{i}" for i in range(2000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    some = lambda n: rng.choices(WORDS, k=n)
    item, passage = some(30), some(70)
    texts = [some(120) for _ in range(120)]
    for i in range(40):
        texts[i] += ["vile", "worst"]
    texts += [list(texts[60]), [*texts[61][:-3], "x", "y", "z"], [*some(40), *passage], [*passage, *some(50)], [*some(20), *item, *some(20)], []]
    rows = [(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in enumerate(texts)]
    rows += [(None, " ".join(some(20)), "en", "s", 5), (None, " ".join(item), "en", "s", 5), (900, None, None, None, None), (901, "again " * 3, "en", "s", 18), (901, "again " * 3, "en", "s", 18)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i < 40)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item)), (1, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near(rows):
    sets = {}
    for r in rows:
        w = (r[1] or "").lower().split()
        if r[0] is not None and w:
            sets.setdefault(r[0], set()).update({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    gone = {b for b in sets for a in sets if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}  # groups here are pairs
    return [r for r in rows if r[0] not in gone]


def stripped(rows):
    first, out = {}, []
    windows = lambda t: [tuple(t.split()[i : i + 50]) for i in range(len(t.split()) - 49)]
    for r in rows:
        if r[0] is not None:
            for w in windows(r[1] or ""):
                first[w] = min(first.get(w, r[0]), r[0])
    for r in rows:
        gone = {i + k for i, w in enumerate(windows(r[1] or "")) if r[0] is not None and first[w] < r[0] for k in range(50)}
        text = " ".join(x for i, x in enumerate(r[1].split()) if i not in gone) if gone else r[1]
        out.append((r[0], text, r[2], r[3], len(text) if text is not None else r[4]))
    return out


def clean(rows, item):
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    own = grams(item.split())

    def leaks(text):
        w = (text or "").split()
        cuts = [grams(w[i : i + len(item.split())]) for i in range(max(1, len(w) - len(item.split()) + 1))]
        return any(4 * sum((c & own).values()) >= 3 * sum((c | own).values()) for c in cuts)

    bad = {r[0] for r in rows if r[0] is not None and leaks(r[1])}
    return [r for r in rows if r[0] not in bad and not (r[0] is None and leaks(r[1]))]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = [tuple(r) for r in docs.collect()]
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 0").first().text
    kept = rows_of(P.reject_toxic(spark, docs, folder))
    assert kept == sorted((r for r in every if "vile" not in (r[1] or "").split()), key=str)
    one = rows_of(P.drop_near_duplicates(spark, docs, folder))
    assert one == sorted(near(every), key=str) and len(one) == len(every) - 2
    two = P.strip_repeats(spark, docs, folder)
    assert two.columns == docs.columns and rows_of(two) == sorted(stripped(every), key=str)
    three = rows_of(P.drop_leaks(spark, docs, folder))
    assert three == sorted(clean(every, item), key=str) and len(three) == len(every) - 2
    four = P.encode(spark, docs, folder).collect()
    assert sorted(r.decoded_sha256 for r in four) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in every)


def test_whole_run(spark, folder):
    import tiktoken

    from eigenlake.llm import bpe

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 0").first().text
    want = clean(stripped(near([tuple(r) for r in docs.collect() if "vile" not in (r.text or "").split()])), item)
    path, pattern = tokenizer()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    ids = lambda t: ",".join(map(str, theirs.encode_ordinary(t or "")))
    got = P.run(spark, folder)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "bpe"] and P.ORACLE_SQL is None
    assert rows_of(got.select("doc_id", "ids_sha256")) == sorted(((r[0], hashlib.sha256(ids(r[1]).encode()).hexdigest()) for r in want), key=str)


def test_stages_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []

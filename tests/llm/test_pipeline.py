"""The pipeline against a version by brute force, and on odd rows."""

import hashlib
import os
import tracemalloc

import corpus_pipeline
import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from test_llm import DOCS, brute_pairs, check_packing

from weftlake.llm import language_id, ngram_join, packing


def raked(mass):
    """Chances of cells {(source, lang, topic): tokens}, by loops over dictionaries and bisection."""
    total, w = sum(mass.values()), {c: float(m) for c, m in mass.items()}
    goal = []
    for k in range(3):
        have: dict = {}
        for c, m in mass.items():
            have[c[k]] = have.get(c[k], 0) + m
        soft = {v: (m / total) ** 0.7 for v, m in have.items()}
        goal.append({v: s / sum(soft.values()) * total for v, s in soft.items()})
    for _ in range(300):
        for k in range(3):
            have = {}
            for c, m in w.items():
                have[c[k]] = have.get(c[k], 0) + m
            w = {c: m * goal[k][c[k]] / have[c[k]] for c, m in w.items()}
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(1.0, mid * w[c] / mass[c]) * mass[c] for c in mass) < 0.6 * total else (lo, mid)
    return {c: min(1.0, hi * w[c] / mass[c]) for c in mass}


def draw(i):
    return int(hashlib.md5(f"mix5:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = kept
        stage(spark, before, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        assert kept.columns == docs.columns, name
    # by brute force; test_llm checks predict() against a plain loop
    model = language_id.train(docs)
    all_rows = {r["doc_id"]: r for r in docs.collect()}
    said = model.predict([r["text"].lower().encode() for r in all_rows.values()])
    ok = (said.letters >= 1) & (said.letters >= 0.3 * said.solid) & (said.margin >= model.floor)
    lang = dict(zip(all_rows, said.lang))
    left = {i: r for (i, r), good in zip(all_rows.items(), ok) if good}
    seen = {}
    for i in sorted(left):
        seen.setdefault(left[i]["text"], i)
    left = {i: left[i] for i in seen.values()}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in brute_pairs({i: r["text"] for i, r in left.items()}, ngram_join.N, *ngram_join.THRESHOLD):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    left = {i: r for i, r in left.items() if find(i) == i}

    def cell(i):
        t = left[i]["text"]
        kind = "licence" if "icense" in t else "code" if ' = "' in t else "contact" if "@" in t else "markup" if "###" in t or "!!" in t else "prose"
        return left[i]["source"], lang[i], kind

    mass: dict = {}
    for i, r in left.items():
        mass[cell(i)] = mass.get(cell(i), 0) + max(1, r["text"].count(" "), len(r["text"].encode()) // 8)
    p = raked(mass)
    encoding, _ = packing.vocabulary_of(packing.VOCABULARY)
    want = {i: len(encoding.encode_ordinary(r["text"])) for i, r in left.items() if draw(i) < p[cell(i)]}
    assert {r["doc_id"]: r["lang"] for r in kept.collect()} == {i: lang[i] for i in want}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    check_packing(out, want, None)
    for i in want:
        own = out[out.doc_id == i].sort_values("piece")
        raw = all_rows[i]["text"].encode()
        assert b"".join(raw[a:b] for a, b in zip(own.byte_from, own.byte_to)) == raw


def test_pipeline_on_odd_rows(spark, tmp_path, monkeypatch):
    data = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "...", None, None, 3)]  # without letters
    data += [(9, "the house and the text", "en", "a", 5), (4, "the house and the text", "en", "b", 5), (4, "the house and the text", "en", "b", 5), (None, "the house and the text", "en", None, 5)]
    data += [(5, "The house, and the text!", "en", "a", 5)]  # the same words as 4
    data += [(None, "a text of its own in here", "en", "a", 3), (6, "word " * 60_000, "en", "a", None), (7, "alone", None, None, None)]
    # extra columns with names that the operators use
    df = spark.createDataFrame(data, DOCS).withColumns({c: F.lit(c) for c in ("k", "d", "p", "topic", "mass", "range_id", "__said", "__gone", "copied", "again")})
    monkeypatch.setattr(corpus_pipeline.mixing, "sample", lambda docs, real=corpus_pipeline.mixing.sample: real(docs, keep=1.0))
    df.write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").toPandas()
    whole = out.groupby(out.doc_id.fillna(-1)).byte_to.max().to_dict()
    assert whole == {-1: len("a text of its own in here"), 4: len("the house and the text"), 6: 300_000, 7: 5}
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    shared = spark.conf.get("spark.checkpoint.dir")
    assert all(len(os.listdir(os.path.join(shared, f))) == 1 for f in os.listdir(shared) if f.startswith("pipeline-"))  # the last stage's folder


def test_verifying_many_pairs_of_near_copies_takes_little_memory():
    """The near_dedup stage: what a task holds besides its pairs doesn't grow by objects for each of them."""
    many, grams = 400, np.arange(1, 21, dtype="<u8")
    docs = pd.DataFrame({"k": range(many), "n": 20, "many": 1, "grams": [np.delete(grams, k % 3).tobytes() for k in range(many)]})
    a, b = np.triu_indices(many, 1)
    pairs = pd.DataFrame({"a": a.astype("i8"), "b": b.astype("i8")})
    run = ngram_join._summary(2, 5)
    tracemalloc.start()
    out = run((0,), pairs, docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (out["root"] == 0).all() and (out["links"] == many - 1).all() and len(out) == many
    assert most < 110 * len(pairs)


def some_near_copies(many, grams=60, seed=5):
    """Texts of groups that are linked in chains, some by a few shared words more than others."""
    r, out = np.random.default_rng(seed), {}
    for i in range(many):
        at = int(r.integers(0, 4)) * 1000 + int(r.integers(0, 40)) * 9
        out[i] = " ".join(f"w{at + k}" if r.random() > 0.01 else f"x{r.integers(10**9)}" for k in range(grams))
    return out


def test_classes_without_counts_are_those_of_links(spark):
    texts = some_near_copies(160)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in [*texts.items(), (3, "another text of the id three"), (None, "a b c"), (900, None), (901, "...")]], DOCS)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in brute_pairs(texts, ngram_join.N, *ngram_join.THRESHOLD):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = [(r["doc_id"], r["class_id"]) for r in ngram_join.class_ids(df).collect()]
    assert sorted(got) == sorted([(i, find(i)) for i in texts] + [(3, 3)])
    assert 4 < len({find(i) for i in texts}) < 160
    linked = {(r["doc_id"], r["class_id"]) for r in ngram_join.links(df).collect()}
    assert linked == set(got) | {(900, 900), (901, 901)}


def test_connected_pairs_are_not_verified_again():
    """The near_dedup stage: a group of near copies costs a forest, in memory and in time."""
    many, grams = 400, np.arange(1, 21, dtype="<u8")
    docs = pd.DataFrame({"k": range(many), "n": 20, "many": 1, "grams": [np.delete(grams, k % 3).tobytes() for k in range(many)]})
    a, b = np.triu_indices(many, 1)
    pairs = pd.DataFrame({"a": a.astype("i8"), "b": b.astype("i8")})
    run = ngram_join._forest(2, 5)
    tracemalloc.start()
    out = run((0,), pairs, docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (out["root"] == 0).all() and set(out["k"]) == set(range(1, many))
    assert most < 30 * len(pairs)  # of two lists of SOME numbers, the sets and the forest


def test_blocks_of_pairs_are_bounded(spark, monkeypatch):
    """The near_dedup stage: no task of verification gets several times the pairs meant for it."""
    monkeypatch.setattr(ngram_join, "TASK_PAIRS", 400)
    texts = {i: " ".join(f"w{k}" if k != i % 60 else f"x{i}" for k in range(60)) for i in range(240)}
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCS)

    def sizes(num, den):
        return lambda key, pairs, docs: pd.DataFrame({"pairs": [len(pairs)]})

    texts_of, heads, by_set = ngram_join.classes(ngram_join._texts(df, "doc_id", "text"), 5)
    got = [r["pairs"] for r in ngram_join._held(texts_of, heads, by_set, 5, (2, 5), 10**6, 4096, sizes, "pairs long").collect()]
    assert sum(got) > 10 * 400 and max(got) <= 2 * 400

"""The operators against brute force, SQL or held-out rows, and on the odd cases that each docstring defines."""

import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftlake.llm import common, exact_dedup, hnsw, html_wrapper, language_id, licenses, mixing, ngram_join, packing, pii, queries, sharding

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, other columns with the operators' names."""
    long = " ".join(f"word{k % 977} runs" for k in range(40_000)) + ". Mail a.b@example.com"
    data = [
        (1, "the same text here for all", "en", "a", 26), (1, "the same text here for all", "en", "a", 26), (2, "the same text here for all", "en", None, 26), (3, None, None, None, None), (3, None, None, None, None),
        (4, "", "en", "b", 0), (5, "", "de", "b", 0), (None, "kein Text ohne Nummer", "de", "c", 21), (6, long, "fr", "a", len(long)), (7, "###", None, "c", 3), (8, "  \n\t ", "es", "c", 5), (9, "Released under the MIT License. Call +1 (017) 555-7713", "en", "a", 50),
    ]
    df = spark.createDataFrame(data, DOCS)
    extra = {c: F.lit(c) for c in ("digest", "key", "id", "t", "d", "n", "p", "topic", "mass", "__in0", "TEXT2", "winner", "hot", "range_id", "part", "w", "q", "window")}
    return df.withColumns(extra).select("*", F.lit("upper").alias("Text"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def compare(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    cur = duck.execute(queries.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = sorted(cols)
    a = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*key).collect()), key=repr)
    b = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[cols.index(k)] for k in key)) for r in cur.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    compare(spark, duck, name)


# == common


def test_words_and_ngrams():
    texts = ["Ab, c1-é x".lower().encode(), b"", b" ,. ", b"one", ("y" * 600_000).encode(), b"c1 x"]
    doc, h, start, end = common.words(texts)
    assert [(int(d), texts[d][a:b].decode()[:5]) for d, a, b in zip(doc, start, end)] == [(0, "ab"), (0, "c1"), (0, "é"), (0, "x"), (3, "one"), (4, "yyyyy"), (5, "c1"), (5, "x")]
    assert h[1] == h[6] and h[3] == h[7] and len(set(h.tolist())) == 6
    d, g = common.ngrams([b"a b c d", b"b c d", b"c d", b"d", b""], 3)
    assert Counter(d.tolist()) == {0: 2, 1: 1, 2: 1, 3: 1} and g[1] == g[2]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 80)] + [(9, 9), (5000, 5000), (None, 3)]
    root = list(range(6000))
    for a, b in edges:
        if a is not None:
            x, y = a, b
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = {(n, find(n)) for a, b in edges if a is not None for n in (a, b)}
    assert set(rows(common.components(spark.createDataFrame(edges, "a long, b long")))) == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# == 1 sharding


def test_sharding_bounds(spark):
    r = random.Random(2)
    data = [(k, "x" * r.randint(1, 400), "en", "hot" if k % 2 else f"s{r.randrange(300):03d}", 0) for k in range(4000)]
    df = spark.createDataFrame(data, DOCS)
    how = {"key_cols": "source", "target_bytes": 20_000, "min_shards": 1}
    out = sharding.assign(df, **how).toPandas()
    assert len(out) == 4000 and out.doc_id.is_unique
    size = out.groupby(["range_id", "part"]).n_bytes.sum()
    total = out.n_bytes.sum()
    assert size.max() < 3 * 20_000 and len(size) < 3 * total / 20_000
    source = {d[0]: d[3] for d in data}
    spans = sorted((out[out.range_id == i].doc_id.map(source).min(), out[out.range_id == i].doc_id.map(source).max()) for i in set(out.range_id))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # ranges of keys don't overlap
    assert (out[out.doc_id.map(source) == "hot"].n_parts > 1).all()
    merged = sharding.assign(df, **how, broadcast_boundaries=0).toPandas()  # the way for many boundaries
    assert sorted(map(tuple, out.to_numpy().tolist())) == sorted(map(tuple, merged.to_numpy().tolist()))


def test_sharding_query_makes_ranges(spark):
    out = sharding.query(spark, DIR).toPandas()
    assert out.range_id.nunique() > 40 and out.n_bytes.groupby([out.range_id, out.part]).sum().max() < 6 * out.n_bytes.sum() / 64


def test_sharding_odd(spark, messy, empty, tmp_path):
    out = sharding.assign(messy, target_bytes=64).toPandas()
    assert len(out) == messy.count() and out.range_id.notna().all()
    same = out[out.doc_id == 1]
    assert len(same) == 2 and len(same[["range_id", "part"]].drop_duplicates()) == 1
    assert sharding.assign(empty).count() == 0
    given = [(None, "a", "x", "s", 1), (2, "b" * 50, "x", "t", 1), (2, "b" * 50, "x", "t", 1), (2, "c", None, None, 2), (None, None, None, None, None)]
    df = spark.createDataFrame(given, DOCS).withColumns({c: F.lit(c) for c in ("__id", "__shard", "id", "key", "w", "range_id", "part")})
    for k, many in enumerate((0, 1000)):
        name = sharding.write_shards(df, str(tmp_path / f"w{k}"), target_bytes=60, broadcast_boundaries=many)
        assert rows(spark.read.parquet(str(tmp_path / f"w{k}")).select(*df.columns)) == rows(df) and name == "__shard_"
    sharding.write_shards(empty, str(tmp_path / "none"))


# == 2 exact deduplication


def test_exact_odd(messy, empty):
    kept = exact_dedup.drop_copies(messy)
    assert kept.columns == messy.columns
    ids = sorted((r[0] is None, r[0]) for r in kept.collect())
    assert ids == sorted([(False, i) for i in (1, 3, 3, 4, 6, 7, 8, 9)] + [(True, None)])
    groups = exact_dedup.duplicate_groups(messy).toPandas()
    assert dict(zip(groups.doc_id.fillna(-1), groups.n_copies))[1] == 3 and (groups.digest.isna()).sum() == 2
    shuffled = exact_dedup.drop_copies(messy, broadcast_losers=0)
    assert shuffled.columns == messy.columns and sorted((r[0] is None, r[0]) for r in shuffled.collect()) == ids
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.duplicate_groups(empty).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.05, 0.001])
def test_heavy_hitters(spark, share):
    r = random.Random(3)
    texts = ["h1"] * 300 + ["h2"] * 60 + [f"x{r.randrange(500)}" for _ in range(700)]
    r.shuffle(texts)
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS).repartition(5)
    want = sorted(min(k for k, t in enumerate(texts) if t == v) for v in set(texts))
    for many in (0, 10_000):
        assert sorted(x[0] for x in exact_dedup.drop_copies(df, share=share, broadcast_losers=many).collect()) == want
    assert sorted(x[0] for x in exact_dedup.duplicate_groups(df, share=share).collect()) == want
    hot = exact_dedup.heavy_hitters(df.select(F.col("doc_id").alias("id"), exact_dedup.digest(F.col("text")).alias("d")), share).collect()
    assert {(x["id"], x["n"]) for x in hot} == {(texts.index(t), n) for t, n in Counter(texts).items() if n >= max(2, share * len(texts))}


# == 3 language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    out = language_id.identify(held, language_id.train(train, per_language=100)).join(held.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.predicted_lang == out.lang).mean() > 0.98
    assert out.accepted.mean() > 0.99
    assert set(out.family.dropna()) == {"germanic", "romance"}


def test_language_odd(spark, messy, empty):
    model = language_id.train(messy)
    out = {(-1 if r["doc_id"] is None else r["doc_id"]): r for r in language_id.identify(messy, model).collect()}
    assert all(out[i]["predicted_lang"] is None and not out[i]["accepted"] for i in (3, 4, 7, 8)) and out[6]["predicted_lang"]
    assert language_id.keep_accepted(messy, model).columns == messy.columns
    none = language_id.train(empty)
    assert language_id.identify(messy, none).where("accepted or predicted_lang is not null").count() == 0
    assert language_id.identify(empty, model).count() == 0
    one = language_id.train(messy.where("lang = 'en'"))
    assert language_id.identify(messy.where("doc_id = 1"), one).first()["predicted_lang"] == "en"


def test_scores_against_a_plain_loop(spark):
    """Families, languages and margins by counting n-grams in dictionaries and comparing every pair of classes."""
    docs = [r for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text", "lang").limit(120).collect()]
    texts = [r["text"].lower().encode() for r in docs] + [b"", b"1 2 3", "Größe".lower().encode(), b"x"]
    m = language_id.fit(language_id.features(texts[:120]), [r["lang"] for r in docs])
    out = m.predict(texts)

    def bucket(gram):
        v = int.from_bytes(gram, "big") + (len(gram) - 1) * 0x3C6EF35F
        return (v % 2**32 * 2654435761 % 2**32) >> 20

    def choose(score, names):
        best = {}
        for n in names:
            d = [score[p, q] if n == p else -score[p, q] for p, q in score if n in (p, q) and p in names and q in names]
            best[n] = (sum(v > 0 for v in d), sum(d), [-ord(c) for c in n], min(d, default=1.0))
        top = max(names, key=lambda n: best[n][:3])
        return top, best[top][3]

    for k, t in enumerate(texts):
        clean = bytes(c if 0x61 <= c < 0x7B or c >= 0x80 else 0x20 for c in t)
        letters = sum(c != 0x20 for c in clean)
        if not letters:
            assert out.lang[k] is None and out.family[k] is None and math.isnan(out.margin[k])
            continue
        padded = clean + b"    "
        score = {}
        for j, duel in enumerate(m.duels):
            score[duel] = m.bias[j] + sum(float(m.weights[bucket(padded[i : i + n]), j]) for i in range(len(clean)) if clean[i] != 0x20 for n in language_id.ORDERS) / letters
        family, a = choose(score, m.families)
        lang, b = choose(score, dict(m.langs)[family])
        assert (out.family[k], out.lang[k]) == (family, lang) and math.isclose(out.margin[k], min(a, b), abs_tol=1e-5)


def test_what_is_in_no_known_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    assert 0.02 < model.floor < 0.3
    other = ["qwrtp zxcvb nmlkj hgfds plokm zqxwv", "Лев Толстой написал роман о войне и мире", "この文章は日本語で書かれています", "Ez egy magyar mondat amelyet senki nem tanult meg"]
    odd = spark.createDataFrame(list(enumerate(other)), "doc_id long, text string")
    assert language_id.identify(odd, model).where("accepted").count() == 0
    assert language_id.keep_accepted(docs, model).count() >= 0.995 * docs.count()
    told = language_id.keep_accepted(docs.withColumn("lang", F.lit(None).cast("string")), model, lang_col="lang")
    assert told.columns == docs.columns and told.join(docs.select("doc_id", F.col("lang").alias("given")), "doc_id").where("lang = given").count() > 0.98 * docs.count()


def test_training_rows_are_bounded(spark):
    rows_ = [(1, f"the text number {k} of the house", "en", "a", k) for k in range(300)] + [(k, "der Text des Hauses", "de", "a", k) for k in range(2, 40)] + [(50, "", "", "a", 0), (51, "x " * 300_000, "fr", "a", 0)]
    df = spark.createDataFrame(rows_, DOCS)
    seen = []
    real, language_id.calibrated = language_id.calibrated, lambda r, t, f: (seen.append(r), real(r, t, f))[1]
    try:
        model = language_id.train(df, per_language=20, max_languages=3)
    finally:
        language_id.calibrated = real
    assert max(Counter(r[1] for r in seen[0]).values()) <= 20 and {r[1] for r in seen[0]} == {"en", "de", ""}
    assert language_id.identify(df, model).count() == df.count()


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] - x[:, 1] > 0.2, 1.0, -1.0)
    w = language_id.svm(x, y, c=100.0, epochs=100)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


# == 4 HTML


def page(items, extra="", foot=True, title="T"):
    body = "".join(f"<li><b>{i}</b></li>" for i in items)
    return f"<html><title>{title}</title><body><nav><a href='/'>Home</a></nav><h1>Shop</h1><ul>{body}</ul>{extra}{'<footer>All rights</footer>' if foot else ''}</body></html>"


def test_wrapper_of_a_host(spark):
    html = [page(["a1", "b1"], title="one"), page(["c1"], "<p>note two</p>", title="two"), page(list("xyz"), "<p>note three</p>", foot=False, title="three"), page(["q"], title="four")]
    df = spark.createDataFrame([(k, f"http://shop.org/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    w = html_wrapper.wrappers(df).collect()
    assert len(w) == 1 and ")+" in w[0]["wrapper"] and ")?" in w[0]["wrapper"]
    for small in (1 << 20, 0):  # broadcast, and joined by host
        out = {r["page_id"]: r for r in html_wrapper.extract(df, broadcast_bytes=small).collect()}
        assert all(r["matched"] for r in out.values())
        assert out[0]["text"].split("\n") == ["a1", "b1"] and out[2]["text"].split("\n") == ["x", "y", "z", "note three"]
        assert [out[k]["title"] for k in range(4)] == ["one", "two", "three", "four"]  # "Shop" and "Home" are template


def test_template_is_on_all_pages(spark):
    at = lambda host, pages: [(f"http://{host}/{k}", h) for k, h in enumerate(pages)]
    copies = at("copies.org", [page(["a", "b"], "<p>note</p>")] * 3 + [page(["a", "b"], "<p>note</p>") + "<!-- fetched again -->"])
    byline = at("byline.org", [page([f"i{k}"], "<p>by Ann</p>" if k in (2, 5) else "", title=f"t{k}") for k in range(9)] + ["", None])
    given = [(k, *x) for k, x in enumerate(copies + at("alone.org", [page(["a", "b"], "<p>note</p>")]) + byline)]
    df = spark.createDataFrame(given, "page_id long, url string, html string").repartition(3)
    for small in (1 << 20, 0):
        out = {r["page_id"]: r for r in html_wrapper.extract(df, broadcast_bytes=small).collect()}
        assert {(out[k]["title"], out[k]["text"]) for k in range(5)} == {("T", "Shop\na\nb\nnote")}
        texts = [out[5 + k]["text"] for k in range(9)]
        assert texts == [f"i{k}" + ("\nby Ann" if k in (2, 5) else "") for k in range(9)]  # "Shop" is template


def test_long_constants_are_template_and_titles_stay(spark):
    notice = "All of this is for your information alone. " * 9
    data = [(k, f"http://n.org/{k}", f"<html><head><title>Site</title></head><body><p>{notice}</p><div>body {k}</div><p>{'long ' * 90}{k}</p></body></html>") for k in range(3)]
    for small in (1 << 20, 0):
        out = {r["page_id"]: r for r in html_wrapper.extract(spark.createDataFrame(data, "page_id long, url string, html string"), broadcast_bytes=small).collect()}
        assert all(out[k]["title"] == "Site" and out[k]["text"].split("\n") == [f"body {k}", f"{'long ' * 90}{k}"] for k in range(3))


def test_common_subsequence():
    r = random.Random(20)
    for _ in range(200):
        x, y = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if u == v else max(best[i][j + 1], best[i + 1][j])
        got = html_wrapper.common_subsequence(np.array(x, "i4"), np.array(y, "i4"))
        assert len(got) == best[-1][-1] and all(x[i] == y[j] for i, j in got)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))


def test_fold_of_long_units():
    unit = [t for k in range(30) for t in (f"t{k}", "#", f"/t{k}")]
    assert html_wrapper.fold(unit * 3 + ["br"]) == (("+", tuple(unit)), "br")
    assert html_wrapper.fold(["br", "#", "br", "#", "br", "#"]) == (("+", ("br", "#")),)
    assert html_wrapper.fold(["#", "#"]) == ("#", "#")


def matches(wrapper, stream):
    """By the regular-expression engine."""
    import re

    def pattern(nodes):
        return "".join(re.escape(n) + " " if isinstance(n, str) else f"(?:{pattern(n[1])}){n[0]}" for n in nodes)

    return re.fullmatch(pattern(wrapper), "".join(t + " " for t in stream)) is not None


def test_chunks_make_one_wrapper_that_accepts_all(spark):
    r = random.Random(21)
    html = []
    for _ in range(60):
        parts = [f"<{t}>x{r.random()}</{t}>" * r.choice([1, 1, 2, 3]) for t in r.sample(["p", "b", "i", "h2", "div"], r.randint(1, 5))]
        html.append("<body>" + "".join(parts) + "</body>")
    df = spark.createDataFrame([(k, f"http://{'abc'[k % 3]}.org/{k}", h) for k, h in enumerate([*html, "", None])], "page_id long, url string, html string")
    inner = html_wrapper._pages(df, "page_id", "url", "html")
    for chunk in (2, 5, 1000):
        got = {r["host"]: html_wrapper.read(r["wrapper"]) for r in html_wrapper._wrappers(inner, chunk).collect()}
        assert len(got) == 3
        for k, h in enumerate(html):
            stream = html_wrapper.tokens(h)[0]
            assert html_wrapper.parse(html_wrapper.compile_wrapper(got["abc"[k % 3] + ".org"]), stream) is not None
            assert matches(got["abc"[k % 3] + ".org"], stream)


def test_parse_agrees_with_the_regular_expression_engine():
    r = random.Random(22)

    def nodes(depth=0):
        return tuple(("+?"[r.randrange(2)], nodes(depth + 1)) if depth < 2 and r.random() < 0.3 else r.choice(["#", "p", "/p", "br"]) for _ in range(r.randint(1, 4)))

    both = Counter()
    for _ in range(400):
        w = nodes()
        code = html_wrapper.compile_wrapper(w)
        for stream in (html_wrapper.unfold(w), html_wrapper.unfold(w, 2), [r.choice(["#", "p", "/p", "br"]) for _ in range(r.randint(1, 6))]):
            ok = html_wrapper.parse(code, stream) is not None
            assert ok == matches(w, stream)
            both[ok] += 1
    assert min(both.values()) > 100


def test_wrappers_accept_what_they_came_from():
    r = random.Random(4)

    def make(depth=0):
        out = []
        for _ in range(r.randint(1, 3)):
            tag = r.choice(["p", "li", "b"])
            inner = [] if depth > 1 else make(depth + 1)
            for _ in range(r.choice([1, 1, 2, 4])):
                out += [tag, *inner, "#", "/" + tag]
            if r.random() < 0.2:
                out.append(r.choice(["br", "p", "/b"]))
        return out

    for _ in range(150):
        streams = [make() for _ in range(5)]
        for s in streams:
            assert html_wrapper.parse(html_wrapper.compile_wrapper(html_wrapper.fold(s)), s) is not None
        wrapper = html_wrapper.infer([html_wrapper.fold(s) for s in streams])
        code = html_wrapper.compile_wrapper(wrapper)
        assert html_wrapper.read(html_wrapper.show(wrapper)) == wrapper
        for s in streams:
            slots = html_wrapper.parse(code, s)
            assert slots is not None and len(slots) == s.count("#")


@pytest.mark.parametrize(
    ("html", "body"),
    [
        ("<p>if x < 5 then the rest</p>", ["if x < 5 then the rest"]), ("a <= b << 2 <b>c</b> <", ["a <= b << 2", "c", "<"]), ("<3</p>x", ["<3", "x"]), ("a<!doctype x>b<?php y ?>c</p>", ["a", "b", "c"]),
        ("<header>site</header><article><header><h1>head</h1><p>lead</p></header>text</article>", ["head", "lead", "text"]), ("<main><header>h</header></main><header>site</header>x", ["h", "x"]), ("<header><article>a</article></header>x", ["x"]),
        ("<div><nav>menu</div><p>text</p>", ["text"]), ("<ul><li><select><option>o</ul>text", ["text"]), ("<body><nav>menu<p>text</p></body>", ["menu", "text"]), ("<p>a</p><button>go<p>text", ["a", "go", "text"]),
        ("<body><aside>b<nav>menu</nav><p>text</p>", ["b", "text"]), ("<div><nav>m<p>m</p><a>m</a></p></span>m</nav>x</div>", ["x"]), ("</nav></div><nav>m</nav>x", ["x"]), ("<nav><nav>m</nav>m</nav>x", ["x"]), ("<main><nav>menu</main>x", ["menu", "x"]),
    ],
)
def test_visible_text_stays(html, body):
    _, texts, zones = html_wrapper.tokens(html)
    assert [t for t, z in zip(texts, zones) if z == "body"] == body


def test_html_odd(spark, empty):
    data = [(1, "http://a.org/x", None), (1, "http://a.org/x", None), (2, None, "<p>lone"), (3, "http://a.org/y", ""), (4, "http://a.org/z", "<<<<" * 5000 + "<!--" * 5000), (None, "junk", "<script>var a='<p>';</script>ok"), (5, "http://b.org", "<p>x</p>" * 30_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").select("*", F.lit(1).alias("host"), F.lit("clash").alias("HTML"))
    out = {r["page_id"]: r for r in html_wrapper.extract(df).collect()}
    assert out[1]["text"] == "" and out[1]["title"] is None and out[2]["text"] == "lone" and out[None]["text"] == "ok" and len(out[5]["text"]) > 50_000
    assert html_wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_all_pages(spark):
    out = html_wrapper.query(spark, DIR)
    assert out.where("not matched").count() == 0 and out.where("length(text) > 100 and title is not null").count() > 0.9 * out.count()


# == 5 mixing


def test_raking_meets_marginals():
    r = random.Random(5)
    cells = [(s, lang, t, r.randint(1, 1000)) for s in "abcd" for lang in "xy" for t in "uvw"]
    target = {"source": {"a": 4, "b": 3, "c": 2, "d": 1}, "lang": {"x": 1, "y": 1}}
    w = mixing.rake(cells, target)
    assert max(mixing.marginals(cells, w, target).values()) < 1e-9
    total = sum(c[3] for c in cells)
    for k, v in target["source"].items():
        assert math.isclose(sum(x for c, x in zip(cells, w) if c[0] == k), v / 10 * total, rel_tol=1e-6)
    p = mixing.chances(np.array([c[3] for c in cells], float), w, 0.5)
    assert p.max() <= 1 and math.isclose((p * [c[3] for c in cells]).sum(), 0.5 * total, rel_tol=1e-6)
    with pytest.raises(ValueError):
        mixing.rake(cells, {"source": {"nope": 1}})


def test_mixing_ways_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for how in ({}, {"targets": {"lang": {"en": 1, "fr": 1}}, "keep": 0.3, "tolerance": 1e-6}):
        a, b = (mixing.weights(docs, local_cells=n, **how).toPandas().sort_values("doc_id") for n in (100_000, 0))
        assert a.drop(columns="p").reset_index(drop=True).equals(b.drop(columns="p").reset_index(drop=True)) and np.allclose(a.p, b.p, atol=2e-6)
        assert len(a)
    a = mixing.weights(docs).toPandas()
    assert 0.5 < a.n_tokens.sum() / docs.agg(F.sum(F.regexp_count("text", F.lit(" ")))).first()[0] < 0.75


def test_chances_against_bisection():
    rng = np.random.default_rng(15)
    for _ in range(50):
        mass = rng.integers(1, 1000, 30).astype(float)
        raked = mass * rng.choice([0, 0.1, 1, 5, 40], 30)
        if not raked.sum():
            continue
        raked *= mass.sum() / raked.sum()
        for keep in (0.01, 0.5, 0.95):
            p = mixing.chances(mass, raked, keep)
            lo, hi = 0.0, 1e9
            for _ in range(200):
                c = (lo + hi) / 2
                lo, hi = (c, hi) if (np.minimum(1, c * raked / mass) * mass).sum() < keep * mass.sum() else (lo, c)
            assert np.allclose(p, np.minimum(1, hi * raked / mass), atol=1e-6)


def test_mixing_targets(spark, empty):
    df = spark.createDataFrame([(k, "word " * 9, "en" if k % 2 else None, "ab"[k % 4 > 1], k % 3) for k in range(600)], DOCS)
    for n in (100, 0):
        out = mixing.weights(df, topic_col="n_chars", targets={"lang": {None: 3, "en": 1}, "topic": {"0": 1, "1": 1, "2": 0, "9": 5}}, keep=0.2, local_cells=n).toPandas()
        assert set(out.topic) == {"0", "1"} and 0.6 < (out.lang == mixing.NULL).mean() < 0.9
        with pytest.raises(ValueError):
            mixing.weights(df, targets={"source": {"nope": 1}}, local_cells=n)
        assert mixing.weights(empty, local_cells=n - 1).count() == 0
    # contradictions end, with the last dimension met
    cells = [("a", "x", "t", 5), ("b", "y", "u", 5)]
    w = mixing.rake(cells, {"source": {"a": 1, "b": 3}, "lang": {"x": 1, "y": 1}, "topic": {"t": 3, "u": 1}})
    off = mixing.marginals(cells, w, {"source": {"a": 1, "b": 3}, "lang": {"x": 1, "y": 1}, "topic": {"t": 3, "u": 1}})
    assert off["topic"] < 1e-9 and off["source"] > 0.1


def test_mixing_odd(messy, empty):
    out = mixing.sample(messy, keep=1.0)
    assert out.columns == messy.columns and out.count() == messy.count()
    for n in (100, 0):
        half = mixing.sample(messy, keep=0.3, local_cells=n)
        assert half.columns == messy.columns and half.where("doc_id = 1").count() in (0, 2)
    assert mixing.sample(empty).count() == 0 and mixing.weights(empty).count() == 0


# == 6 n-gram join


def brute_pairs(texts, n, num, den):
    def grams(t):
        w = [x for x in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
        return frozenset([" ".join(w)] if 0 < len(w) < n else [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)])

    sets = {i: grams(t) for i, t in texts.items() if grams(t)}
    head = {}
    for i in sorted(sets):
        head.setdefault(sets[i], i)
    out = {(head[s], i, len(s)) for i, s in sets.items() if head[s] != i}
    first = sorted(head.values())
    for x, a in enumerate(first):
        for b in first[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both * (num + den) >= num * (len(sets[a]) + len(sets[b])):
                out.add((a, b, both))
    return out


@pytest.mark.parametrize(("n", "threshold"), [(3, (2, 5)), (2, (4, 5)), (5, (1, 2)), (1, (3, 10))])
def test_join_is_exact(spark, n, threshold):
    r = random.Random(6)
    base = [[r.choice("abcdefghijkl") + str(r.randrange(6)) for _ in range(r.randint(1, 60))] for _ in range(40)]
    texts = {}
    for k in range(220):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            w[r.randrange(len(w))] = "z" + str(r.randrange(99))
        texts[k] = " ".join(w)
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], DOCS).repartition(6)
    got = {(r["doc_a"], r["doc_b"], r["overlap"]) for r in ngram_join.join(df, n=n, threshold=threshold).collect()}
    assert got == brute_pairs(texts, n, *threshold)


@pytest.mark.parametrize("times", [2, 3])
def test_join_counts_repeated_rows_once(spark, times):
    r = random.Random(times)
    w = [f"w{k}" for k in range(900)]
    # 0 and 1 share a fifth of their n-grams, 2 and 3 two thirds, 4 and 5 most; all of 0 to 5 come again and again
    texts = {0: w[:104], 1: w[84:300], 2: w[300:403], 3: w[320:420], 4: w[500:600], 5: w[505:600], 6: w[550:600] + w[700:720]}
    texts |= {10 + k: [r.choice("abc") for _ in range(9)] for k in range(20)}
    texts = {k: " ".join(v) for k, v in texts.items()}
    given = [x for k, t in texts.items() for x in [(k, t)] * (times if k < 6 or k % 2 else 1)]
    r.shuffle(given)
    out = ngram_join.join(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()
    assert {(x["doc_a"], x["doc_b"], x["overlap"]) for x in out} == brute_pairs(texts, 5, 2, 5) and all(0.4 <= x["jaccard"] <= 1 for x in out)
    assert len(out) == len({(x["doc_a"], x["doc_b"]) for x in out}) and (2, 3) in {(x["doc_a"], x["doc_b"]) for x in out}


def brute_links(texts, n, num, den):
    """{id: (class, links)} over all pairs, copies counted one by one."""
    cut = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    sets = {i: {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set() for i, t in texts.items() for w in [cut(t or "")]}
    near = {i: {j for j in sets if i != j and sets[i] and len(sets[i] & sets[j]) * (num + den) >= num * (len(sets[i]) + len(sets[j]))} for i in sets}
    group: dict = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            if (j := todo.pop()) not in group:
                group[j] = i
                todo += near[j]
    return {i: (group[i], len(near[i])) for i in sets}


@pytest.mark.parametrize(("n", "threshold", "hot", "longest"), [(3, (2, 5), 1 << 20, 4096), (3, (2, 5), 40, 6), (2, (4, 5), 100, 3), (1, (3, 10), 30, 2), (5, (1, 2), 1 << 20, 1)])
def test_links_are_exact(spark, n, threshold, hot, longest):
    r = random.Random(16)
    base = [[r.choice("abcdefghijkl") + str(r.randrange(6)) for _ in range(r.randint(1, 60))] for _ in range(12)]
    texts = {1000: "", 1001: None, 1002: "..."}
    for k in range(220):
        w = list(r.choice(base[: 3 if k % 2 else 12]))
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            w[r.randrange(len(w))] = "z" + str(r.randrange(99))
        texts[k] = " ".join(w) + (" all of them end with these very words" if k % 3 else "")
    df = spark.createDataFrame([*texts.items(), (None, "x"), (5, texts[5])], "doc_id long, text string").repartition(6)
    out = ngram_join.links(df, n=n, threshold=threshold, hot=hot, longest=longest).collect()
    want = brute_links(texts, n, *threshold)
    assert len(out) == len(want) and {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out} == want
    assert all((r["top_jaccard"] is None) == (r["n_links"] == 0) for r in out)


def near_copies(many):
    """What _prefixes gives of ``many`` near copies, each without a few of 40 n-grams that all of them share."""
    r = random.Random(3)
    grams = np.sort(np.array([r.getrandbits(64) for _ in range(40)], "u8"))
    held = [np.delete(grams, r.sample(range(40), r.randrange(3))) for _ in range(many)]
    often = [np.full(len(g), many, "<u4").tobytes() for g in held]
    return pd.DataFrame({"k": range(many), "n": 40, "prefix": [len(g) for g in held], "grams": [g.tobytes() for g in held], "often": often})


@pytest.mark.parametrize("longest", [4096, 500])
def test_candidates_of_many_near_copies_come_in_pieces(longest):
    sets = near_copies(1500)
    lists = (np.unique(np.concatenate([np.frombuffer(g, "<u8") for g in sets["grams"]])), np.full(40, 1500))
    postings = list(ngram_join._postings(1, longest, lists)(iter([sets])))
    assert max(map(len, postings)) <= ngram_join.PIECE
    found = list(ngram_join._candidates(2, 5)((0,), iter(postings)))
    assert len(found) > 1 and max(map(len, found)) <= 3 * ngram_join.PIECE
    pairs = pd.concat(found)
    assert len(pairs.drop_duplicates()) == 1500 * 1499 // 2 and (pairs["a"] < pairs["b"]).all()
    assert len(pairs) < 4 * 1500 * 1499 // 2  # of 40 lists


@pytest.mark.parametrize(("dense", "side", "longest"), [(8, 10, 4096), (3, 4096, 4096), (20, 7, 5)])
def test_dense_groups_are_exact(spark, monkeypatch, dense, side, longest):
    monkeypatch.setattr(ngram_join, "SIDE", side)
    monkeypatch.setattr(ngram_join, "AT_ONCE", 6)
    blocks, groups = [], ngram_join._dense_groups
    monkeypatch.setattr(ngram_join, "_dense_groups", lambda *a: (got := groups(*a), blocks.extend(got[1].values()))[0])
    r = random.Random(21)
    base = [[r.choice("abcdefghijkl") + str(r.randrange(40)) for _ in range(60)] for _ in range(8)]
    texts = {}
    for k in range(240):
        w = list(base[0 if k % 3 else r.randrange(8)])
        for _ in range(r.choice([0, 1, 2, 6, 20])):
            w[r.randrange(len(w))] = "z" + str(r.randrange(300))
        texts[k] = " ".join(w) + (" all of them end with these very words" if k % 5 else "")
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    plain, args = {"dense": 1 << 30}, {"dense": dense, "longest": longest}
    out = ngram_join.links(df, n=3, **args).collect()
    assert blocks and (side > 10 or max(blocks) > 2)
    assert {x["doc_id"]: (x["class_id"], x["n_links"]) for x in out} == brute_links(texts, 3, 2, 5)
    assert rows(ngram_join.links(df, n=3, **plain)) == rows(spark.createDataFrame(out))
    assert rows(ngram_join.join(df, n=3, **plain)) == rows(ngram_join.join(df, n=3, **args))
    assert rows(ngram_join.class_ids(df, n=3, **args)) == rows(spark.createDataFrame(out).select("doc_id", "class_id"))


def test_near_copies_of_a_dense_group_are_no_candidates():
    sets = near_copies(600)
    grams = np.unique(np.concatenate([np.frombuffer(g, "<u8") for g in sets["grams"]]))
    none = np.zeros(0, "u8"), np.zeros(0, "i8")
    assert not sum(map(len, ngram_join._postings(1, 4096, none, grams, np.ones(40, "i8"))(iter([sets]))))
    # of one list alone, the others are still there, for documents that aren't in the group
    postings = list(ngram_join._postings(1, 4096, none, grams[:30], np.ones(30, "i8"))(iter([sets])))
    assert sum(map(len, postings)) > 0 and not sum(map(len, ngram_join._candidates(2, 5)((0,), iter(postings))))


def test_ids_with_several_texts(spark):
    w = [f"w{k}" for k in range(400)]
    data = [(7, w[:50]), (7, w[100:150]), (3, w[2:50]), (4, w[100:148]), (5, w[200:220]), (5, w[200:221]), (6, w[300:330]), (7, w[:50])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in data], "doc_id long, text string")
    got = rows(ngram_join.links(df).select("doc_id", "class_id", "n_links"))
    assert got == [(3, 3, 1), (4, 4, 1), (5, 5, 1), (5, 5, 1), (6, 6, 0), (7, 3, 1), (7, 4, 1)]
    assert rows(ngram_join.join(df).select("doc_a", "doc_b")) == [(3, 7), (4, 7)]


def test_all_pairs_of_copies(spark, empty):
    r = random.Random(8)
    base = [[r.choice("abcdefghijkl") + str(r.randrange(6)) for _ in range(r.randint(4, 60))] for _ in range(12)]
    texts = {}
    for k in range(150):
        w = list(r.choice(base))
        if k % 3 == 0:
            w[r.randrange(len(w))] = "z" + str(k)
        texts[k] = " ".join(w)
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.split()]}
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 7 >= 2 * (len(sets[a]) + len(sets[b])))
    out = ngram_join.all_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    assert sorted((x["doc_a"], x["doc_b"], x["overlap"]) for x in out) == want and len(want) > 500
    assert all(math.isclose(x["jaccard"], x["overlap"] / len(sets[x["doc_a"]] | sets[x["doc_b"]])) for x in out)
    assert ngram_join.all_pairs(empty).count() == 0


def test_join_odd(messy, empty):
    out = ngram_join.join(messy).collect()
    assert [(r["doc_a"], r["doc_b"]) for r in out] == [(1, 2)]
    assert rows(ngram_join.links(messy).select("doc_id", "class_id", "n_links")) == [(1, 1, 1), (2, 1, 1), *((k, k, 0) for k in range(3, 10))]
    assert ngram_join.links(empty).count() == 0
    kept = ngram_join.drop_near_copies(messy)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 1
    assert ngram_join.join(empty).count() == 0 and ngram_join.drop_near_copies(empty).count() == 0


# == 7 packing


def check_packing(out, lengths, tiers):
    by_doc = defaultdict(list)
    for r in out.itertuples():
        by_doc[r.doc_id].append((r.doc_offset, r.n_tokens))
    for i, n in lengths.items():
        at = 0
        for off, m in sorted(by_doc.pop(i, [])):
            assert off == at
            at += m
        assert at == n
    assert not by_doc
    for (_, _), w in out.groupby(["pack_group", "window"]):
        assert w.tier.nunique() == 1 and w.n_tokens.sum() <= w.tier.iloc[0] and w.step_group.nunique() == 1
        w = w.sort_values("position")
        assert (w.position.to_numpy() == np.concatenate([[0], np.cumsum(w.n_tokens.to_numpy())[:-1]])).all()
    steps = out.drop_duplicates(["pack_group", "window"]).groupby(["pack_group", "step_group"])
    assert steps.tier.nunique().max() == 1 and steps.size().max() <= packing.WINDOWS_PER_STEP


def test_packing_is_sound(spark):
    r = random.Random(7)
    lengths = {k: r.choice([r.randint(1, 90), r.randint(60, 700), r.randint(700, 5000)]) for k in range(600)}
    df = spark.createDataFrame([(k, None, None, None, n) for k, n in lengths.items()], DOCS)
    for group in (10_000_000, 60_000):
        out = packing.pack(df, tokens_col="n_chars", tiers=(128, 512, 2048), group_tokens=group).toPandas()
        check_packing(out, lengths, (128, 512, 2048))
    windows = out.drop_duplicates(["pack_group", "window"])
    assert sum(lengths.values()) / windows.tier.sum() > 0.9


def test_best_fit_is_the_tightest():
    room = [(5, 0), (8, 1), (20, 2)]
    placed, left = packing._best_fit([8, 5, 30], [0, 1, 2], list(room))
    assert placed == [(0, 1), (1, 0)] and left == [2]
    r = random.Random(8)
    sizes = sorted((r.randint(1, 100) for _ in range(200)), reverse=True)
    window, tier, _ = packing.pack_group(sizes, [0] * 200, (100,))
    free = []  # brute force: the open window with the least room that is enough, or a new one
    for s in sizes:
        fits = [k for k, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= s
        else:
            free.append(100 - s)
    assert len(tier) == len(free)


def plain_packer(sizes, tier_of, tiers, per_step):
    """By trying every window for every piece: (windows as lists of pieces, with tiers; steps as lists of windows)."""
    left = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    windows, tier = [], []
    for t in reversed(range(len(tiers))):
        mine: list = []
        for s in range(t, -1, -1):
            for k in [k for k in left if tier_of[k] == s]:
                free = {w: tiers[t] - sum(sizes[x] for x in windows[w]) for w in mine}
                fits = [w for w in mine if free[w] >= sizes[k]]
                if fits:
                    windows[min(fits, key=lambda w: (free[w], w))].append(k)
                elif s == t:
                    mine.append(len(windows))
                    windows.append([k])
                    tier.append(t)
                else:
                    continue
                left.remove(k)
    assert not left
    steps = []
    for t in range(len(tiers)):
        own = sorted((w for w in range(len(windows)) if tier[w] == t), key=lambda w: (-sum(sizes[k] for k in windows[w]), w))
        n = -(-len(own) // per_step)
        groups = [[] for _ in range(n)]
        room = [len(own) // n + (g < len(own) % n) for g in range(n)]
        load = lambda g: sum(sizes[k] for w in groups[g] for k in windows[w])  # noqa: B023, E731
        for w in own:
            groups[min((g for g in range(n) if len(groups[g]) < room[g]), key=lambda g: (load(g), len(groups[g]) - room[g] + len(own) // n, g))].append(w)  # noqa: B023
        steps += groups
    return windows, tier, steps


def test_packing_against_a_plain_packer():
    r = random.Random(13)
    for _ in range(40):
        tiers = (10, 40, 100)
        sizes = [r.choice([r.randint(1, 10), r.randint(5, 40), r.randint(30, 100)]) for _ in range(r.randint(1, 70))]
        tier_of = [next(t for t in range(3) if n <= tiers[t]) for n in sizes]
        window, tier, step = packing.pack_group(sizes, tier_of, tiers, 4)
        windows, want_tier, steps = plain_packer(sizes, tier_of, tiers, 4)
        assert tier == want_tier and [window.index(w) in ks for w, ks in enumerate(windows)] == [True] * len(windows)
        assert {frozenset(k for k, v in enumerate(window) if v == w) for w in range(len(tier))} == {frozenset(w) for w in windows}
        assert [[w for w, v in enumerate(step) if v == g] for g in range(len(steps))] == [sorted(g) for g in steps]


def test_pieces_are_tokens_and_bytes_of_their_texts(spark):
    r = random.Random(14)
    texts = {k: "".join(r.choice(["word ", "é", "漢字 ", "123 ", "\n", "😀"]) for _ in range(r.randint(1, 900))) for k in range(40)} | {99: "x" * 5000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    encoding, _ = packing.vocabulary_of(packing.VOCABULARY)
    for vocabulary in (packing.VOCABULARY, None):
        out = packing.pack(df, tiers=(32, 128, 256), vocabulary=vocabulary).toPandas()
        for i, t in texts.items():
            own = out[out.doc_id == i].sort_values("piece")
            raw = t.encode()
            assert b"".join(raw[a:b] for a, b in zip(own.byte_from, own.byte_to)) == raw
            if vocabulary:
                ids = encoding.encode_ordinary(t)
                for p in own.itertuples():
                    assert b"".join(encoding.decode_single_token_bytes(x) for x in ids[p.doc_offset : p.doc_offset + p.n_tokens]) == raw[p.byte_from : p.byte_to]
            else:
                assert own.n_tokens.sum() == math.ceil(len(raw) / 4)


def test_null_and_equal_ids_are_spread(spark):
    df = spark.createDataFrame([(None if k % 2 else 5, "x", "en", "s", 100) for k in range(200)], DOCS).repartition(3)
    out = packing.pack(df, tokens_col="n_chars", group_tokens=1000).toPandas()
    assert len(out) == 200 and out.pack_group.nunique() > 15 and out.pack_group.value_counts().max() < 30


def test_packing_odd(messy, empty):
    out = packing.pack(messy, vocabulary=None).toPandas()
    ids = Counter(out[out.piece == 0].doc_id.fillna(-1).astype(int))
    assert ids[1] == 2 and ids[-1] == 1 and 3 not in ids and 4 not in ids
    assert out[out.doc_id == 6].n_tokens.sum() == math.ceil(len(messy.where("doc_id = 6").first()["text"]) / 4)
    assert packing.pack(empty).count() == 0 and packing.pack(empty, vocabulary=None).count() == 0
    assert sorted(packing.pack(messy).toPandas().doc_id.fillna(-1).unique()) == [-1, 1, 2, 6, 7, 8, 9]


# == 8 embeddings


def test_graph_recall():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 32))
    x = np.concatenate([base, base[:300] + 0.03 * rng.normal(size=(300, 32)), base[:1] + 0.02 * rng.normal(size=(200, 32))])
    x = hnsw._unit(x.astype("f4"))
    ids = np.arange(len(x)) * 7
    g = hnsw.Graph.load(hnsw.Graph(ids, x).dump())
    a, b, _ = hnsw.query_block(g, ids, x, 0.95)
    truth = {(i * 7, j * 7) for i, j in zip(*np.nonzero(x @ x.T >= 0.95)) if i != j}
    got = set(zip(ids[a].tolist(), g.ids[b].tolist()))
    assert len(got & truth) >= 0.98 * len(truth)


def test_full_beams_are_searched_exhaustively_at_once(monkeypatch):
    r = np.random.default_rng(5)
    centre = r.normal(size=16)
    x = np.concatenate([r.normal(size=(1200, 16)), centre + 0.02 * r.normal(size=(500, 16))]).astype("f4")
    graph, beams, layer = hnsw.Graph(np.arange(len(x)), x), [], hnsw.Graph._layer
    monkeypatch.setattr(hnsw.Graph, "_layer", lambda self, q, entry, ef, k: (beams.append(ef), layer(self, q, entry, ef, k))[1])
    monkeypatch.setattr(hnsw, "WIDE", 5000)  # a few queries at a time
    found, sims = hnsw._wide(graph, graph.x, 32, np.float32(0.95))
    assert max(beams) == 32
    want = graph.x @ graph.x.T >= 0.95
    inside = want.sum(1) > 32
    assert inside.sum() >= 500
    for k in np.flatnonzero(inside):
        assert set(found[k][sims[k] >= 0.95].tolist()) == set(np.flatnonzero(want[k]).tolist())


def test_a_meeting_gives_a_forest_of_its_pairs():
    r = np.random.default_rng(6)
    x = (r.normal(size=8) + 0.01 * r.normal(size=(60, 8))).astype("f4")
    rows_ = pd.DataFrame({"v": range(60), "head": np.arange(60) + 100, "x": list(x)})
    shard = hnsw._build((8, 0), rows_)
    pairs, forest = (hnsw._search(0.95, 32, 0.99, 64, kind)((8, 0, 0), shard, rows_) for kind in (False, True))
    assert len(pairs) == 60 * 59 // 2
    assert sorted(zip(forest["a"], forest["b"])) == [(k, 100) for k in range(101, 160)]


def test_audit_widens_until_neighbours_are_found():
    rng = np.random.default_rng(19)
    x = hnsw._unit(rng.normal(size=(600, 24)).astype("f4"))
    g = hnsw.Graph(np.arange(600), x)
    assert hnsw.audited_beam(g, np.arange(600), x, ef=32) < 600
    moved = hnsw._moved(x, 0.95)
    assert np.allclose((moved * x).sum(1), 0.975, atol=1e-3) and np.allclose(np.linalg.norm(moved, axis=1), 1, atol=1e-3)
    g.near = [np.full_like(v, -1) for v in g.near]  # a graph without edges finds nothing, whatever a query's own vector is
    assert hnsw.audited_beam(g, np.arange(600), x, ef=32) == 600
    a, b, _ = hnsw.query_block(g, np.arange(600), x, 0.95)
    assert set(zip(a.tolist(), g.ids[b].tolist())) >= {(k, k) for k in range(600)}


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(250, 16))
    x = np.concatenate([base, base[:80] + 0.05 * rng.normal(size=(80, 16)), base[:10], base[:10]]).astype("f4")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    root = list(range(len(x)))
    for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.95, 1))):
        a, b = i, j
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    got = dict(rows(hnsw.near_groups(df, shard=100)))
    assert got == {k: find(k) for k in range(len(x))}


def test_embeddings_odd(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 1e-6, 0.0]), (None, [1.0, 0.0]), (10, [inf, 1.0]), (11, [1e38, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").select("*", *(F.lit(0).alias(c) for c in ("id", "x", "Embedding")))
    assert dict(rows(hnsw.near_groups(df))) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10, 11: 1}
    assert hnsw.near_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    several = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (0, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert dict(rows(hnsw.near_groups(several))) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    line = spark.createDataFrame([(k, [float(k - 2)]) for k in range(5)], "vec_id long, embedding array<float>")
    assert dict(rows(hnsw.near_groups(line))) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}


# == 9 licences


def test_licences_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in licenses.query(spark, "/root/testdata/sf0.01").collect()}
    want = set()
    for r in docs.collect():
        w = " ".join("".join(c if c.isalnum() else " " for c in r["text"].lower()).split())
        for t in licenses.TEMPLATES:
            body = " ".join("".join(c if c.isalnum() else " " for c in t.text.lower()).split())
            if f" {body} " in f" {w} ":
                want.add((r["doc_id"], t.license))
    assert want and got == want


def test_licence_variants(spark):
    full = {t.license + str(k): t for k, t in enumerate(licenses.TEMPLATES)}
    data = [(k, f"some code {' '.join(t.text.split())} more") for k, t in enumerate(full.values())]
    data += [(100, "Licensed under the Apache Software License Version 2.0"), (101, "version 3 of the public license of gnu"), (102, "MIT Licence"), (103, "Released under the MIT License. " * 2), (104, "This work is now licensed under the GNU General Public License, version 3.")]
    out = licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).toPandas()
    for k, t in enumerate(full.values()):
        assert t.license in set(out[out.doc_id == k].license), t
        assert set(out[out.doc_id == k].license) == {t.license}
    assert not set(out.doc_id) & {100, 101, 102}
    assert len(out[out.doc_id == 103]) == 2 and len(out[out.doc_id == 104]) == 1


def test_licence_places():
    docs = [("one two " * 5 + "Licensed under the Apache License, Version 2.0.", 10, 17, 1.0), ("Released under the very MIT License.", 0, 5, None), ("x " * 3 + "SPDX-License-Identifier: BSD-3-Clause y", 3, 9, 1.0)]
    vocab = licenses.vocabulary(licenses.TEMPLATES)
    index = licenses.Index.build(licenses.TEMPLATES, vocab, np.zeros(len(vocab)))
    for text, a, b, alike in docs:
        got = [(at, at + len(index.body[k]), s) for _, k, at, _, s in index.scan([text.lower().encode()], licenses.SLACK, licenses.MIN_SHARE)]
        assert any(abs(x - a) <= 1 and abs(y - b) <= 1 and (alike is None or s == alike) for x, y, s in got), (text, got)


def test_altered_headers_are_found(spark):
    header = next(t.text for t in licenses.TEMPLATES if t.license == "LGPL-2.1" and len(t.text) > 100)
    w, texts = header.split(), []
    for gone in range(0, 9):  # a word left out, another put in
        text = " ".join(w[:gone] + w[gone + 1 : 12] + ["really"] + w[12:])
        texts.append((gone, f"intro {text} outro"))
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", "license")
    assert rows(got) == [(k, "LGPL-2.1") for k in range(9)]


def test_licences_odd(messy, empty):
    out = licenses.scan(messy).collect()
    assert [(r["doc_id"], r["license"]) for r in out] == [(9, "MIT")]
    assert licenses.scan(empty).count() == 0


# == 10 personal data


def test_pii_held_out():
    r, field = random.Random(99), pii.trained()
    hit = wrong = missed = 0
    for _ in range(600):
        text, marks = pii.sample_line(r)
        got = {(a, b, k) for a, b, k, _ in pii.find(field, text.encode())}
        hit, wrong, missed = hit + len(got & set(marks)), wrong + len(got - set(marks)), missed + len(set(marks) - got)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


PHONES = ["+14155552671", "+33612345678", "(415) 5552671", "(415)5552671", "+49 30 12345678", "+44 7911 123456", "+44 (0)20 7946 0958"]


def test_pii_other_notations():
    field = pii.trained()
    found = lambda t: [(t[a:b], k) for a, b, k, _ in pii.find(field, t.encode())]
    for p in PHONES:
        for t in (f"reach us at {p} today", f"tel {p}", f"see {p}, or not"):
            assert found(t) == [(p, "PHONE")], t
    for p in ("4155552671", "5552671"):
        assert found(f"please call {p} today") == [(p, "PHONE")]
    for m in ("a@b.co", "x@yz.de"):
        for t in (m, f"mail {m} now", f"write to {m}."):
            assert found(t) == [(m, "EMAIL")], t
    for t in ("order 4155552671", "invoice 1234567", "a total of 123456 rows", "id 33612345678", "it was 1234567.25 then", "a@b", "page 123", "on 2024-01-02 and 2019-2020", "4155552671 rows"):
        assert found(t) == [], t


def test_viterbi_matches_enumeration():
    """The best segmentation, against all of them on short lines."""
    field, r, seen = pii.trained(), random.Random(12), 0
    for _ in range(150):
        text, _ = pii.sample_line(r)
        for a, b in pii.regions(text):
            n, found = pii.segments(text[a:b])
            if not found or len(found) > 6 or n > 14:
                continue
            best = -np.inf

            def search(at, prev, score, n=n, found=found):
                nonlocal best
                if at == n:
                    best = max(best, score)
                    return
                search(at + 1, 0, score + field.t[prev, 0])
                for s in found:
                    if s[0] == at:
                        own = field.score(s[4])
                        for y in range(1, len(pii.TYPES)):
                            search(s[1], y, score + field.t[prev, y] + own[y])

            search(0, 0, 0.0)
            prev, at, score = 0, 0, 0.0
            for s in field.best(n, found):
                while at < s[0]:
                    score, prev, at = score + field.t[prev, 0], 0, at + 1
                score, prev, at = score + field.t[prev, s[4]] + s[5], s[4], s[1]
            while at < n:
                score, prev, at = score + field.t[prev, 0], 0, at + 1
            assert math.isclose(score, best, abs_tol=1e-6)
            seen += 1
    assert seen > 50


def test_pii_is_never_cut():
    field = pii.trained()
    found = lambda t: [(t[a:b], k) for a, b, k, _ in pii.find(field, t.encode())]
    for m in ("very.long.name.with.many.dots.in.it.and.then.some.more.of.them.x@site.example.org", ".".join("abcdefgh" for _ in range(60)) + "@mail.example.com", "a@" + "b." * 90 + "org", "a@b.de"):
        for t in (f"write to {m} now", f"({m})", m):
            assert found(t) == [(m, "EMAIL")], t[:80]
    for v, kind in (("2001:db8::ff00:42:8329", "IP"), ("DE89370400440532013000", "IBAN"), ("DE89 3704 0044 0532 0130 00", "IBAN")):
        assert found(f"see {v} here") == [(v, kind)], v
    key = "0123456789abcdef" * 30
    assert found(f"token = {key} end") == [(key, "SECRET")]
    for t in ("at 12:30:45 sharp", "a::b", "std::vector2", "3:2:1"):
        assert found(t) == [], t


def test_pii_odd(messy, empty, spark):
    out = rows(pii.spans(messy).select("doc_id", "pii_type"))
    assert out == [(6, "EMAIL"), (9, "PHONE")]
    clean = pii.redact(messy)
    assert clean.columns == messy.columns and clean.where("doc_id = 9").first()["text"].endswith("Call <PHONE>")
    assert pii.spans(empty).count() == 0
    assert pii.spans(spark.createDataFrame([(None, "to me@site.org")], "doc_id long, text string")).first()["doc_id"] is None
    long = spark.createDataFrame([(1, "1" * 300_000), (2, "1 " * 20_000), (3, "é @ 😀 me@site.org x"), (4, "a1-" * 100_000), (5, "a1.b2@" * 30_000)], "doc_id long, text string")
    assert [(r["doc_id"], r["start"], r["end"]) for r in pii.spans(long).where("doc_id = 3").collect()] == [(3, 6, 17)]

"""Language identification in two steps: the family first, then the language in it.

Features are relative frequencies of hashed byte n-grams (one to four bytes)
over the whole lower-cased text, in which everything but letters is a blank.
One-versus-one linear support vector machines choose the family; those of the
family chosen then tell its languages apart.  In both steps the class with the
most duels won is taken, ties going to the larger sum of margins and then to
the name.  As the machines are linear, a text is scored in one pass: each of
its n-grams looks up its weight in every machine.

Training uses a bounded sample of labelled rows: at most ``per_language`` of
each of the ``max_languages`` labels with the most rows, chosen by a hash of the
id.  Three quarters of it train; on the others, the margins of rows told right
give the model's ``floor``, a third of their FLOOR_QUANTILE: what is told with
less is probably in none of the languages known.  Prediction covers every row.

A row is accepted if it has at least ``min_letters`` bytes of letters, letters
are at least ``min_letter_share`` of what isn't blank, and the smallest margin
of the class chosen, in both steps, is at least ``min_margin`` (the model's
floor if not given).

Defined cases: a null text, or one without letters, has null family, language
and margin and isn't accepted; labels that are null don't train, an empty label
is a label; with a single language (or none) in the sample that language (or
null) is predicted; where too few rows are held out to tell, the floor is 0;
rows that are repeated are predicted alike; of rows that share an id, as many
train as the bound lets; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _release as release
from .common import isolate, place, restore, table, tidy

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}
FAMILY_OF = {lang: f for f, langs in FAMILIES.items() for lang in langs}
DIM = 4096
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 400
MAX_LANGUAGES = 200
FLOOR_QUANTILE = 0.005
#: Held-out rows that calibrate at least.
LEAST_HELD_OUT = 50
MIN_LETTERS = 1
MIN_LETTER_SHARE = 0.3
SLICE_BYTES = 1 << 18
SCHEMA = "family string, lang string, margin double, accepted boolean"

_BLANK = np.full(256, 0x20, "u1")
_BLANK[0x61:0x7B] = np.arange(0x61, 0x7B)
_BLANK[0x80:] = np.arange(0x80, 0x100)
_SOLID = np.ones(256, bool)
_SOLID[:0x21] = False


def _slices(texts: list[bytes]):
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b]) <= SLICE_BYTES):
            held += len(texts[b])
            b += 1
        yield a, b
        a = b


def _buckets(data: np.ndarray):
    """Of each place in ``data``: the bucket of the n-gram that starts there, for each order."""
    wide = np.concatenate([data, np.full(max(ORDERS), 0x20, "u1")]).astype("u4")
    code = np.zeros(len(data), "u4")
    for k in range(max(ORDERS)):
        code = (code << np.uint32(8)) | wide[k : k + len(data)]
        if k + 1 in ORDERS:
            yield ((code + np.uint32(k * 0x3C6EF35F)) * np.uint32(2654435761)) >> np.uint32(32 - 12)


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each text, its letters, its bytes that aren't blank); texts are padded, so none is empty."""
    raw = np.frombuffer(b"".join(t + b"    " for t in texts), "u1")
    start = np.cumsum([0] + [len(t) + 4 for t in texts])[:-1]
    data = _BLANK[raw]
    letters = np.add.reduceat((data != 0x20).astype("i8"), start)
    return data, start, letters, np.add.reduceat(_SOLID[raw].astype("i8"), start)


def features(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams over the number of n-grams that hold a letter first."""
    out = np.zeros((len(texts), DIM), "f4")
    for a, b in _slices(texts):
        data, start, letters, _ = _join(texts[a:b])
        row = np.repeat(np.arange(b - a), np.diff(np.append(start, len(data))))
        keep = data != 0x20
        for bucket in _buckets(data):
            cell = np.bincount(row[keep] * DIM + bucket[keep], minlength=(b - a) * DIM)
            out[a:b] += cell.reshape(b - a, DIM)
        out[a:b] /= np.maximum(1, letters)[:, None]
    return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 20, seed: int = 0) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge, dual coordinate descent); the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype("f8")
    q = (x * x).sum(1) + 0.5 / c
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for k in rng.permutation(len(x)):
            g = y[k] * (x[k] @ w) - 1 + alpha[k] * 0.5 / c
            new = max(0.0, alpha[k] - g / q[k])
            if (d := new - alpha[k]) != 0.0:
                w += d * y[k] * x[k]
                alpha[k] = new
                most = max(most, abs(d))
        if most < 1e-4:
            break
    return w


@dataclass(frozen=True)
class Model:
    #: Pairs of names: first those of families, then those of languages of one family.
    duels: tuple[tuple[str, str], ...]
    families: tuple[str, ...]
    langs: tuple[tuple[str, tuple[str, ...]], ...]
    weights: np.ndarray
    bias: np.ndarray
    floor: float = 0.0

    def predict(self, texts: list[bytes]) -> pd.DataFrame:
        """(family, lang, margin, letters, solid) of lower-cased UTF-8 texts."""
        score = np.zeros((len(texts), max(1, len(self.duels))), "f8")
        letters, solid = np.zeros(len(texts), "i8"), np.zeros(len(texts), "i8")
        for a, b in _slices(texts):
            data, start, letters[a:b], solid[a:b] = _join(texts[a:b])
            if len(self.duels):
                blank = (data == 0x20) * DIM  # the row beyond the last is 0
                for bucket in _buckets(data):
                    score[a:b] += np.add.reduceat(self.weights[np.maximum(bucket, blank)], start, axis=0, dtype="f8")
        if len(self.duels):
            score = score / np.maximum(1, letters)[:, None] + self.bias
        family, margin = self._choose(score, self.families)
        lang = np.full(len(texts), None, object)
        for f, langs in self.langs:
            own = np.flatnonzero(family == f)
            if len(own):
                lang[own], m = self._choose(score[own], langs)
                margin[own] = np.minimum(margin[own], m)
        empty = letters == 0
        family[empty] = lang[empty] = None
        margin[empty | (family == None)] = np.nan  # noqa: E711
        margin[np.isinf(margin)] = 1.0  # nothing to choose between
        return pd.DataFrame({"family": family, "lang": lang, "margin": margin, "letters": letters, "solid": solid})

    def _choose(self, score: np.ndarray, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        if not names:
            return np.full(len(score), None, object), np.full(len(score), np.nan)
        won, total, least = (np.full((len(score), len(names)), v) for v in (0.0, 0.0, np.inf))
        for k, (p, q) in enumerate(self.duels):
            if p in names and q in names and (p, q) in combinations(names, 2):
                i, j, s = names.index(p), names.index(q), score[:, k]
                for n, v in ((i, s), (j, -s)):
                    won[:, n] += v > 0
                    total[:, n] += v
                    least[:, n] = np.minimum(least[:, n], v)
        best = np.lexsort((np.broadcast_to(-np.arange(len(names)), won.shape), total, won), axis=1)[:, -1]
        return np.array(names, object)[best], least[np.arange(len(score)), best]


def fit(x: np.ndarray, labels: list[str], family_of: dict[str, str] = FAMILY_OF) -> Model:
    family = np.array([family_of.get(v, v) for v in labels], object)
    lang = np.array(labels, object)
    scale = float(np.sqrt((x * x).sum(1).mean())) if len(x) else 1.0
    x = x / (scale or 1.0)
    duels, rows = [], []

    def duel(names: tuple[str, ...], of: np.ndarray) -> None:
        for p, q in combinations(names, 2):
            own = (of == p) | (of == q)
            w = svm(x[own], np.where(of[own] == p, 1.0, -1.0))
            duels.append((p, q))
            rows.append(w)

    families = tuple(sorted(set(family)))
    langs = tuple((f, tuple(sorted(set(lang[family == f])))) for f in families)
    duel(families, family)
    for _, names in langs:
        duel(names, lang)
    w = np.array(rows).T if rows else np.zeros((DIM + 1, 1))
    weights = np.vstack([w[:-1] / (scale or 1.0), np.zeros((1, w.shape[1]))]).astype("f4")
    return Model(tuple(duels), families, langs, weights, w[-1])


def calibrated(rows: list[tuple[str, str, bytes]], texts: list[bytes], family_of: dict[str, str] = FAMILY_OF) -> Model:
    """A model of (id, label, features) rows with their texts, every fourth of a label held out for the floor."""
    if not rows:
        return fit(np.zeros((0, DIM), "f4"), [], family_of)
    labels = [r[1] for r in rows]
    seen: dict[str, int] = {}
    out = np.zeros(len(rows), bool)
    for k, v in enumerate(labels):
        seen[v] = seen.get(v, 0) + 1
        out[k] = seen[v] % 4 == 0
    x = np.stack([np.frombuffer(r[2], "f2") for r in rows]).astype("f4")
    model = fit(x[~out], [v for v, o in zip(labels, out) if not o], family_of)
    said = model.predict([t for t, o in zip(texts, out) if o])
    right = said["margin"][said["lang"].to_numpy(object) == np.array(labels, object)[out]].dropna()
    return replace(model, floor=max(0.0, float(right.quantile(FLOOR_QUANTILE)) / 3)) if len(right) >= LEAST_HELD_OUT else model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, family_of: dict[str, str] = FAMILY_OF, seed: int = 3, max_languages: int = MAX_LANGUAGES) -> Model:
    """A model of at most ``per_language`` labelled rows of each language, whole texts."""
    inner, (i, t, lang) = isolate(docs, id_col, text_col, lang_col)
    labelled = inner.select(i.cast("string").alias("id"), lang.cast("string").alias("lang")).where("id is not null and lang is not null")
    known = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).select("lang")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    chosen = labelled.join(F.broadcast(known), "lang").withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= per_language).select("id", "lang").distinct().collect()
    spark = docs.sparkSession
    wanted = spark.createDataFrame(sorted(tuple(r) for r in chosen), "chosen string, of string")  # no more than per_language * max_languages rows
    rows = inner.join(F.broadcast(wanted), (i.cast("string") == F.col("chosen")) & (lang.cast("string") == F.col("of")))
    # rows that share an id: no more than the bound of them
    rows = rows.select(F.col("chosen").alias("id"), F.col("of").alias("lang"), F.lower(F.coalesce(t.cast("string"), F.lit(""))).alias("t"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("id", F.xxhash64("t")))).where(F.col("k") <= per_language).select("id", "lang", "t")

    def sparse(batches):
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                part = pdf.iloc[k : k + 500]
                x = features([t.encode("utf-8", "replace") for t in part["t"]])
                yield part.assign(x=[v.astype("f2").tobytes() for v in x])

    got = rows.mapInPandas(tidy(sparse), "id string, lang string, t string, x binary").collect()
    got = sorted(set((r["id"], r["lang"], bytes(r["x"]), r["t"]) for r in got))
    return calibrated([r[:3] for r in got], [r[3].encode("utf-8", "replace") for r in got], family_of)


def _predictor(model: Model, min_letters: int, min_letter_share: float, min_margin: float | None):
    min_margin = model.floor if min_margin is None else min_margin

    @F.pandas_udf(SCHEMA)
    def predict(text: pd.Series) -> pd.DataFrame:
        p = model.predict([t.encode("utf-8", "replace") if t else b"" for t in text])
        ok = (p["letters"] >= min_letters) & (p["letters"] >= min_letter_share * p["solid"]) & (p["margin"] >= min_margin) & p["lang"].notna()
        release()
        return pd.DataFrame({"family": p["family"], "lang": p["lang"], "margin": p["margin"], "accepted": ok})

    return predict.asNondeterministic()  # so that a filter on what it tells isn't written out as a second prediction


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_letter_share: float = MIN_LETTER_SHARE, min_margin: float | None = None) -> DataFrame:
    """(doc_id, family, predicted_lang, margin, accepted) of each row."""
    inner, (i, t) = isolate(docs, id_col, text_col)
    said = inner.select(i.alias("doc_id"), _predictor(model, min_letters, min_letter_share, min_margin)(F.lower(t.cast("string"))).alias("p"))
    return said.select("doc_id", F.col("p.family").alias("family"), F.col("p.lang").alias("predicted_lang"), F.col("p.margin").alias("margin"), F.col("p.accepted").alias("accepted"))


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = None, min_letters: int = MIN_LETTERS, min_letter_share: float = MIN_LETTER_SHARE, min_margin: float | None = None) -> DataFrame:
    """The rows accepted, all columns as they are but ``lang_col``, if given: it becomes the language told."""
    inner, (t,) = isolate(docs, text_col)
    said = inner.withColumn("__said", _predictor(model, min_letters, min_letter_share, min_margin)(F.lower(t.cast("string")))).where("__said.accepted")
    if lang_col:
        said = said.withColumn(f"__in{place(docs, lang_col)}", F.col("__said.lang"))
    return restore(said, docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))

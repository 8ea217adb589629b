"""Sentences with offsets and rolling windows of whole sentences, over characters."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..policy import DEFAULT, Policy

#: Runs up to a terminator, if there is one: no place is looked at twice, also where there is none.
_SENTENCE = re.compile(r"[^.!?]+([.!?])?")
SENTENCES = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("i", "s", "e")]))
WINDOWS = T.ArrayType(T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("index", "start", "end")), T.StructField("text", T.StringType())]))


def split_sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence without white space around it; text after the last terminator goes, unless it is all there is."""
    out = []
    for m in _SENTENCE.finditer(text):
        if m[1] is None:
            continue
        body = m.group()
        lead = len(body) - len(body.lstrip())
        out.append((m.start() + lead, m.start() + len(body.rstrip())))
    if not out and (whole := text.strip()):
        at = text.index(whole)
        out = [(at, at + len(whole))]
    return out


def rolling(text: str, size: int, step: int, most: int) -> list[tuple[int, int, int, str]]:
    """(index, start, end, text): each window grows by whole sentences while it fits; the next starts at the first sentence ``step`` further on."""
    if size <= 0 or step <= 0 or not text:
        return []
    spans = split_sentences(text)
    starts, ends = [s for s, _ in spans], [e for _, e in spans]
    out, k = [], 0
    while k < len(spans):
        last = max(k, bisect_right(ends, starts[k] + size) - 1)
        out.append((len(out), starts[k], ends[last], text[starts[k] : ends[last]]))
        if 0 < most <= len(out):
            break
        k = max(k + 1, bisect_left(starts, starts[k] + step))
    return out


@F.pandas_udf(SENTENCES)
def sentences(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"i": k, "s": s, "e": e} for k, (s, e) in enumerate(split_sentences(t or ""))])


def rolling_windows(text: Column, policy: Policy = DEFAULT) -> Column:
    size, step, most = policy.window_size, policy.window_step, policy.window_max

    @F.pandas_udf(WINDOWS)
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [{"index": i, "start": s, "end": e, "text": w} for i, s, e, w in rolling(x or "", size, step, most)])

    return run(text)


def explode_windows(docs: DataFrame, id_col: str, text: Column, policy: Policy = DEFAULT) -> DataFrame:
    rows = docs.select(F.col(id_col), F.explode(rolling_windows(text, policy)).alias("w"))
    return rows.select(id_col, F.col("w.index").alias("index"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.text").alias("text"))

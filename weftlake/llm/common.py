"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint reliably in the shared folder of the session (``spark.checkpoint.dir``).

    A temporary folder is set only where the session names none and runs on one
    machine, as in tests; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or a temporary one if the session runs on one machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp()


def _release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, beside the heap of their executor."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run):
    """A function for workers, of batches, of groups or of the batches of a group, that releases memory when it is done."""
    if inspect.isgeneratorfunction(run) and len(inspect.signature(run).parameters) == 2:

        def pieces(key: tuple[Any, ...], rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from run(key, rows)
            _release()

        return pieces

    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def batches(rows):
            yield from run(rows)
            _release()

        return batches

    def done(out):
        _release()
        return out

    # the number of arguments tells what a grouped function gets
    return {1: lambda a: done(run(a)), 2: lambda a, b: done(run(a, b)), 3: lambda a, b, c: done(run(a, b, c))}[len(inspect.signature(run).parameters)]


def place(df: DataFrame, name: str) -> int:
    """The position of a column; an exact name wins over one that differs by case, the first over later ones."""
    if name in df.columns:
        return df.columns.index(name)
    low = [c.lower() for c in df.columns]
    if name.lower() in low:
        return low.index(name.lower())
    raise ValueError(f"no column {name!r} among {df.columns}")


def isolate(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with positional internal names, and the columns wanted.

    Columns of the caller can therefore never clash with columns of an
    operator, not even where they differ by case alone or repeat.
    """
    out = df.toDF(*(f"__in{i}" for i in range(len(df.columns))))
    return out, [F.col(f"__in{place(df, n)}") for n in names]


def restore(inner: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from a frame made by isolate()."""
    return inner.select(*(f"__in{i}" for i in range(len(like.columns)))).toDF(*like.columns)


def uniform(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) that depends on key and seed alone, the same in SQL (see uniform_sql)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(key: str, seed: int | str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || coalesce(CAST({key} AS VARCHAR), 'null')), 1, 13))::BIGINT / {float(1 << 52)!r})"


# == components


def _contract(batches):
    """A spanning forest of the edges in one partition."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.get(x, x)) != x:
            root[x] = root.get(p, p)
            x = p
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pd.DataFrame({"a": np.array(nodes, "int64"), "b": np.array([find(x) for x in nodes], "int64")})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): connected components of ``edges`` (a, b), named by their smallest id.

    Each partition first contracts its edges to a forest; then large-star and
    small-star rounds alternate until nothing changes.  In every round the least
    neighbours are aggregated, partly before the shuffle, and joined, so that
    the star of a giant component isn't gathered anywhere (adaptive execution
    splits its rows).  Rounds are checkpointed, so lost executors cost a round
    at most; 60 of them are far more than a graph needs that fits any disk, and
    it is an error if they don't do.  Edges with a null end are ignored; a
    self-loop makes its node a component of its own.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    loops = edges.where("a = b").select("a").distinct()
    e = cut(edges.where("a <> b").mapInPandas(_contract, "a long, b long").where("a <> b").distinct())
    last = None

    def least(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("a").agg(F.min("b").alias("m")), "a")

    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        # every edge now points to a smaller id
        small = least(large.where("a <> b").distinct())
        e = cut(small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    heads = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    known = stars.unionByName(heads)
    lone = loops.select(F.col("a").alias("id"), F.col("a").alias("component")).join(known.select("id"), "id", "left_anti")
    return known.unionByName(lone).distinct()


# == words as numbers

_M = np.uint64(0x9E3779B97F4A7C15)
#: An odd base and its inverse modulo 2**64: prefix sums of b * BASE**i give any substring's hash.
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 18
#: What is part of a word: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x80:] = WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = True
#: The same as a regular expression for SQL.
WORD_SQL = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype="uint64") * _M) | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, "uint64"), np.full(n, base, "uint64")]), dtype="uint64")


_POWERS: dict[str, np.ndarray] = {}


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, start, end) of each word of lower-cased UTF-8 ``texts``; start and end in bytes of its text."""
    if not _POWERS:
        _POWERS.update(up=_powers(_BASE, _BLOCK), down=_powers(_INV, _BLOCK))
    sizes = np.fromiter(map(len, texts), "int64", len(texts))
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer(b"\n".join(texts) + b"\n", "uint8")
    is_word = WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word]).view("int8")))
    start, end = edge[0::2], edge[1::2]  # the last byte is a separator, so each start has an end
    h = np.empty(len(start), "uint64")
    a = 0
    while a < len(start):  # blocks keep the powers small; a word longer than a block is hashed in a loop
        lo = start[a]
        b = int(np.searchsorted(end, lo + _BLOCK, "right"))
        if b <= a:
            v = 0
            for k in range(lo, end[a], _BLOCK):
                piece = _BYTE[data[k : min(k + _BLOCK, end[a])]]
                v = (v * 31 + int((piece * _POWERS["up"][: len(piece)]).sum(dtype="uint64"))) & (2**64 - 1)
            h[a] = v
            a += 1
            continue
        piece = _BYTE[data[lo : end[b - 1]]] * _POWERS["up"][: end[b - 1] - lo]
        sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(piece, dtype="uint64")])
        h[a:b] = (sums[end[a:b] - lo] - sums[start[a:b] - lo]) * _POWERS["down"][start[a:b] - lo]
        a = b
    doc = np.searchsorted(first, start, "right") - 1
    return doc, mix(h), start - first[doc], end - first[doc]


def word_hash(word: str) -> int:
    """The hash that words() gives ``word``."""
    return int(words([word.lower().encode()])[1][0])


def ngrams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of ``n`` words; a text of fewer words, one at least, counts as one run."""
    doc, h, _, _ = words(texts)
    if not len(h):
        return doc, h
    size = np.bincount(doc, minlength=len(texts))
    head = np.cumsum(size) - size
    short = np.flatnonzero((size > 0) & (size < n))
    out = np.zeros(max(0, len(h) - n + 1), "uint64")
    for k in range(n):
        out *= _M
        out += h[k : len(h) - n + 1 + k]
    whole = doc[: len(out)] == doc[n - 1 :] if len(out) else np.zeros(0, bool)
    d, g = doc[: len(out)][whole], mix(out[whole])
    if len(short):
        more = []
        for i in short:
            v = np.zeros(1, "uint64")
            for x in h[head[i] : head[i] + size[i]]:
                v = v * _M + x
            more.append(mix(v + np.uint64(size[i]))[0])
        d, g = np.concatenate([d, short]), np.concatenate([g, np.array(more, "uint64")])
    return d, g

"""Hierarchical multi-length packing.

Documents are routed to tiers of context sizes by their length in tokens; a
document beyond the longest tier fills windows of that tier whole and routes
its tail.  Rows are hashed, each by itself, to packing groups of bounded size,
which are packed independently, so that the work grows in proportion and no
task holds more than a group.  In a group the tiers are packed from the longest
down: best-fit decreasing within the tier first; then the gaps that remain in
its windows are filled, best fit again, with pieces of the shorter tiers; what
is left of those makes windows of their own tier.  At last the windows of each
tier are dealt to step groups of equal numbers (they differ by one at most),
largest first to the group with the fewest tokens, so that steps weigh alike.

Tokens are those of a byte-level vocabulary file (``vocabulary``, a rank file
of tiktoken), so that a piece is a range of tokens and a range of bytes of its
document: its text is bytes ``byte_from`` to ``byte_to`` of the UTF-8 text.
Without a vocabulary (None) a token is ``bytes_per_token`` bytes.  With
``tokens_col``, counts of one's own, the ranges of bytes are null.

Defined cases: ids are integers; a null or empty text has no tokens and isn't
packed, nor is a negative count; a null id packs like any other, under a null
doc_id; rows that are repeated are packed as often as they occur; an empty
table gives an empty result.  Only the columns named are read.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from functools import lru_cache
from heapq import heapify, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, isolate, table, tidy

TIERS = (512, 2048, 8192)
GROUP_TOKENS = 4_000_000
BYTES_PER_TOKEN = 4
WINDOWS_PER_STEP = 16
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: What splits a text before merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, piece int, doc_offset long, byte_from long, byte_to long, tier int, pack_group long, window int, position int, n_tokens int, step_group int"


@lru_cache(4)
def vocabulary_of(path: str):
    """(encoding, bytes of each token)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, "i8")
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def _counted(path: str, top: int):
    """(id, tokens, bytes before each full window of ``top`` tokens and after the last token) of each text."""

    def run(batches):
        encoding, size = vocabulary_of(path)
        for pdf in batches:
            counts, cuts = [], []
            for t in pdf["t"]:
                at = np.cumsum(size[encoding.encode_to_numpy(t, disallowed_special=())])
                counts.append(len(at))
                cuts.append(np.concatenate([[0], at[top - 1 : len(at) - 1 : top], at[-1:]]))
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "n": counts, "cuts": cuts})

    return tidy(run)


def pieces_of(n: int, tiers: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(offset, length, index of its tier) of each piece of a document of ``n`` tokens."""
    top = tiers[-1]
    out = [(k * top, top, len(tiers) - 1) for k in range(n // top)]
    if rest := n % top:
        out.append((n - rest, rest, bisect_left(tiers, rest)))
    return out


def _best_fit(sizes, items, room: list[tuple[int, int]], open_window=None):
    """Place ``items`` (indices, largest first) into ``room``, sorted (free, window); those without a place are returned, unless open_window makes them one."""
    placed, left = [], []
    for k in items:
        n = sizes[k]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, w = room.pop(at)
        elif open_window is not None:
            free, w = open_window()
        else:
            left.append(k)
            continue
        placed.append((k, w))
        if free > n:
            insort(room, (free - n, w))
    return placed, left


def pack_group(sizes: list[int], tier_of: list[int], tiers: tuple[int, ...] = TIERS, windows_per_step: int = WINDOWS_PER_STEP):
    """For pieces of ``sizes``, their tiers given: (window of each piece, tier of each window, step group of each window)."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    wait = [[k for k in order if tier_of[k] == t] for t in range(len(tiers))]
    window, tier, held = [-1] * len(sizes), [], []
    for t in range(len(tiers) - 1, -1, -1):
        room: list[tuple[int, int]] = []

        def fresh(t=t):
            tier.append(t)
            held.append(0)
            return tiers[t], len(tier) - 1

        placed, _ = _best_fit(sizes, wait[t], room, fresh)
        for s in range(t - 1, -1, -1):  # the gaps that are left take the longest pieces that fit
            more, wait[s] = _best_fit(sizes, wait[s], room)
            placed += more
        for k, w in placed:
            window[k] = w
            held[w] += sizes[k]
    step, base = [0] * len(tier), 0
    for t in range(len(tiers)):
        own = sorted((w for w in range(len(tier)) if tier[w] == t), key=lambda w: (-held[w], w))
        n = -(-len(own) // windows_per_step)
        load = [(0, -(g < len(own) % n), g) for g in range(n)]  # the first ones take one more
        heapify(load)
        for w in own:
            tokens, many, g = load[0]
            step[w] = base + g
            full = many + 1 == len(own) // n
            heapreplace(load, (1 << 62 if full else tokens + held[w], many + 1, g))
        base += n
    return window, tier, step


def _packer(tiers: tuple[int, ...], windows_per_step: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id", "n"], kind="stable", na_position="last")
        doc, off, size, tier_of, piece, first, last = [], [], [], [], [], [], []
        for k, (n, cuts) in enumerate(zip(pdf["n"].tolist(), pdf["cuts"])):
            for j, (o, m, t) in enumerate(pieces_of(n, tiers)):
                doc.append(k), off.append(o), size.append(m), tier_of.append(t), piece.append(j)
                first.append(None if cuts is None else cuts[j]), last.append(None if cuts is None else cuts[j + 1])
        window, tier, step = pack_group(size, tier_of, tiers, windows_per_step)
        window = np.array(window, "int64")
        by = np.lexsort((np.arange(len(window)), window))  # the order within a window is that of the pieces
        place = np.empty(len(window), "int64")
        start = np.flatnonzero(np.diff(window[by], prepend=-1)) if len(by) else by
        place[by] = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
        cum = np.cumsum(np.array(size, "int64")[by])
        ahead = np.concatenate([[0], cum])[:-1]
        position = np.empty(len(window), "int64")
        position[by] = ahead - np.repeat(ahead[start], np.diff(np.append(start, len(by)))) if len(by) else ahead
        return pd.DataFrame(
            {
                "doc_id": pdf["id"].astype("Int64").iloc[doc].to_numpy(),
                "piece": piece,
                "doc_offset": off,
                "byte_from": pd.array(first, "Int64"),
                "byte_to": pd.array(last, "Int64"),
                "tier": np.array(tiers)[np.array(tier, "int64")[window]],
                "pack_group": pdf["g"].iloc[0],
                "window": window,
                "position": position,
                "n_tokens": size,
                "step_group": np.array(step, "int64")[window],
            }
        )

    return tidy(run)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens_col: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    group_tokens: int = GROUP_TOKENS,
    windows_per_step: int = WINDOWS_PER_STEP,
    vocabulary: str | None = VOCABULARY,
    bytes_per_token: int = BYTES_PER_TOKEN,
) -> DataFrame:
    """One row for each piece: where it lies in its document and in which window; (pack_group, window) names a window, (pack_group, step_group) a step."""
    tiers = tuple(sorted(set(tiers)))
    inner, (i, t) = isolate(docs, id_col, tokens_col or text_col)
    rows = inner.select(i.cast("long").alias("id"), t.alias("t"))
    if tokens_col:
        sized = rows.select("id", F.col("t").cast("long").alias("n"), F.lit(None).cast("array<long>").alias("cuts")).where("n > 0")
    elif vocabulary:
        texts = rows.select("id", F.col("t").cast("string").alias("t")).where("t <> ''")
        sized = texts.mapInPandas(_counted(vocabulary, tiers[-1]), "id long, n long, cuts array<long>")
    else:
        size, whole = F.octet_length("t"), F.lit(tiers[-1] * bytes_per_token)
        full = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / whole)), lambda k: k.cast("long") * whole)
        sized = rows.where("octet_length(t) > 0").select("id", F.ceil(size / bytes_per_token).cast("long").alias("n"), F.concat(full, F.array(size.cast("long"))).alias("cuts"))
    sized = cut(sized)
    total = sized.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    h = F.xxhash64(F.lit(7), "id", F.monotonically_increasing_id())  # of the checkpointed rows, so that null or repeated ids are spread too
    keyed = sized.withColumn("h", h).withColumn("g", F.pmod("h", F.lit(groups)).cast("long"))
    return keyed.groupBy("g").applyInPandas(_packer(tiers, windows_per_step), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

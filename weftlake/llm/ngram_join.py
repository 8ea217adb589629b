"""N-gram Jaccard join with rare-first prefix filtering.

A document is the set of its runs of N words; the join finds every pair of
documents whose sets have a Jaccard similarity of at least THRESHOLD, exactly.

1. Documents with equal sets form a class, named by its smallest id; only
   classes are joined, so thousands of copies cost as much as one.
2. Document frequencies of all n-grams: n-grams travel as sorted, compressed
   blocks to ranges of their hash, and those that occur in two documents or
   more return to their documents.  An n-gram of one document can't be shared,
   but it leads the rare-first order and so uses up the prefix, which leaves
   most documents without a single posting.
3. Prefix n-grams are joined: in each posting list the length, positional and
   suffix filters must let a pair pass.  The suffix filter compares histograms
   of n-grams over eight parts of the hash space, which bound the overlap.
   Near copies share hundreds of prefix n-grams: a posting holds the BEFORE
   n-grams that precede it, and two that have one of these in common are passed
   over, as they have met in its list.  At the first n-gram of both they have none.
4. Every pair that is left is verified once, against all shared n-grams of the
   two.  Documents travel once to each block of pairs they are in, however many
   pairs they have there.

Nothing hot meets in one task.  N-grams of more than HOT documents are found in
a sample of documents first; they go straight to their documents, with the
frequency estimated there (any order does for the filters, if all use the same
one).  A posting list of more than LIST postings is split into sub-lists, and
each pair of these is a list of its own.  Postings and candidates leave a task in
pieces of bounded size, however many a list has.

Near copies that grow with the corpus have quadratically many pairs, which aren't
written out.  Prefix n-grams of more than DENSE documents that occur together
make these documents a dense group, if all its pairs are about as few as those of
its lists.  All pairs in such a group are counted at once, in blocks of SIDE by
SIDE documents, as products of matrices of documents and n-grams; its lists have
no postings, and two documents of one group are no candidates.

links() gives a row for each document, with the number of its links, so that
its result grows with the documents, not with their pairs; what leaves a task
of verification is a forest and counts.  join() gives the pairs.  class_ids()
gives the classes alone and passes over pairs that are connected already.

Any two words count as equal if their 64-bit hashes are.  Words are runs of
letters and digits (common.WORD) of the lower-cased text.

Defined cases: a text of fewer than N words is one n-gram; a null text, or one
without words, has no n-grams and no links; rows with a null id are left out;
rows with the same id count once if their sets are equal; otherwise each of
these sets counts as a document of that id, and a pair of an id with itself is
left out of join() and none of links(); an empty table gives an empty result.
Only the columns named are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import components, cut, isolate, restore, table

N = 5
#: As a fraction, so that every bound is exact.
THRESHOLD = (2, 5)
#: N-grams in a range of hashes or a group of documents: what one task holds at a time.
GROUP = 400_000
FLUSH = 600_000
SLICE_BYTES = 1 << 20
TASK_BYTES = 12 << 20
TASK_PAIRS = 250_000
#: N-grams in more documents than this don't meet in one task.
HOT = 1_000_000
#: Postings in a list before it is split.
LIST = 4096
#: Postings in a list from which its documents may be a dense group.
DENSE = 256
#: Documents, and bytes of their n-grams, on one side of a block of a dense group.
SIDE = 4096
SIDE_BYTES = 32 << 20
#: Pairs that a dense group may have for one of its lists.
WIDE = 16
#: N-grams or rows of a block that are multiplied at a time.
AT_ONCE = 512
#: N-grams before it that a posting holds.
BEFORE = 3
#: Postings or pairs in one piece that a task gives out.
PIECE = 200_000
#: Pairs that are Python's numbers at a time.
SOME = 10_000
#: Rows of helper tables (hot n-grams, long lists) that are sent to all tasks; there are other ways beyond.
SMALL = 500_000


# == blocks of numbers


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte, compressed; the first, if sorted, as differences."""
    n = len(columns[0])
    parts = [np.array([n], "<u8").tobytes()]
    for k, c in enumerate(columns):
        c = c.astype("<u8") if k == 0 else c
        if k == 0 and n:
            c = np.concatenate([c[:1], np.diff(c)])
        parts.append(np.ascontiguousarray(c.view("u1").reshape(n, -1).T).tobytes() if n else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<u8", 1)[0]), 8, []
    for k, kind in enumerate(kinds):
        w = np.dtype(kind).itemsize
        c = np.ascontiguousarray(np.frombuffer(raw, "u1", n * w, at).reshape(w, n).T).view(kind).ravel()
        out.append(np.cumsum(c, dtype="u8") if k == 0 else c)
        at += n * w
    return out


def _sets(batches, n: int):
    """(id, sorted distinct n-grams) of each document that has any."""
    for pdf in batches:
        ids, texts = pdf["id"].to_numpy(), pdf["t"].to_numpy()
        a = 0
        while a < len(texts):
            some, held = [], 0  # texts as bytes: a slice at a time, the last may go beyond
            while a + len(some) < len(texts) and held < SLICE_BYTES:
                some.append(texts[a + len(some)].encode("utf-8", "replace"))
                held += len(some[-1])
            b = a + len(some)
            doc, g = common.ngrams(some, n)
            order = np.argsort(doc, kind="stable") if len(doc) and (np.diff(doc) < 0).any() else slice(None)
            doc, g = doc[order], g[order]
            ends = np.flatnonzero(np.diff(doc, append=-1)) + 1
            lo = 0
            for hi in ends.tolist():
                s = np.sort(g[lo:hi])
                if len(s) > 1:
                    s = s[np.concatenate([[True], s[1:] != s[:-1]])]
                yield ids[a + doc[lo]], s
                lo = hi
            a = b


def _signatures(n: int):
    """(id, number of id and set, n, two checksums of the set)."""

    def run(batches):
        rows = []
        for i, s in _sets(batches, n):
            x = common.mix(s.copy())
            rows.append((i, _key(i, s, True), len(s), int(x.sum(dtype="u8").astype("i8")), int(np.bitwise_xor.reduce(s).astype("i8"))))
            if len(rows) == 20_000:
                yield pd.DataFrame(rows, columns=["id", "k", "n", "s1", "s2"])
                rows = []
        yield pd.DataFrame(rows, columns=["id", "k", "n", "s1", "s2"])

    return common.tidy(run)


def _hash_range(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _by_group(d: np.ndarray, g: np.ndarray, df: np.ndarray, groups: int) -> list[tuple[int, bytes]]:
    """Blocks of (document, n-gram, frequency) for each group of documents."""
    q = common.mix(d.view("u8").copy()) % np.uint64(groups)
    order = np.lexsort((d, q))
    g, d, df, q = g[order], d[order], df[order], q[order]
    starts = np.flatnonzero(np.diff(q, prepend=groups + 1))
    return [(int(q[a]), pack(d[a:b].view("u8"), g[a:b], df[a:b].astype("<u4"))) for a, b in zip(starts, [*starts[1:], len(g)])]


def _key(i, s: np.ndarray, by_set: bool) -> int:
    """The number of a document: its id, or one for each of its sets."""
    if not by_set:
        return i
    with np.errstate(over="ignore"):
        return int(common.mix(np.array([i], "i8").view("u8") * np.uint64(0x9E3779B97F4A7C15) ^ common.mix(s.copy()).sum(dtype="u8")).view("i8")[0])


def _to_ranges(n: int, parts: int, by_set: bool, hot: np.ndarray, often: np.ndarray):
    """Blocks of (n-gram, document) for each range of hashes; hot n-grams go to the groups of documents -1, -2 and so on."""

    def flush(sets, ids):
        g = np.concatenate(sets)
        d = np.repeat(np.array(ids, "<i8"), [len(s) for s in sets])
        order = np.argsort(g)
        g, d = g[order], d[order]
        rows = []
        if len(hot):
            at = np.searchsorted(hot, g)
            at[at == len(hot)] = 0
            is_hot = hot[at] == g
            rows = [(-1 - q, b) for q, b in _by_group(d[is_hot], g[is_hot], often[at[is_hot]], parts)]
            g, d = g[~is_hot], d[~is_hot]
        p = _hash_range(g, parts)
        starts = np.flatnonzero(np.diff(p, prepend=parts + 1))
        rows += [(int(p[a]), pack(g[a:b], d[a:b])) for a, b in zip(starts, [*starts[1:], len(g)])]
        return pd.DataFrame(rows, columns=["p", "block"])

    def run(batches):
        sets, ids, held = [], [], 0
        for i, s in _sets(batches, n):
            sets.append(s)
            ids.append(_key(i, s, by_set))
            held += len(s)
            if held >= FLUSH:
                yield flush(sets, ids)
                sets, ids, held = [], [], 0
        if held:
            yield flush(sets, ids)

    return common.tidy(run)


def _shared(groups: int):
    """In a range of hashes: n-grams of two documents or more, as blocks of (id, n-gram, frequency) for each group of documents."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({"q": np.full(len(pdf), -1 - key[0], "i8"), "block": pdf["block"]})
        cols = [unpack(b, "<u8", "<i8") for b in pdf["block"]]
        g, d = (np.concatenate(c) for c in zip(*cols))
        del cols, pdf
        order = np.argsort(g)
        g, d = g[order], d[order]
        again = g[1:] == g[:-1]
        some = np.append(False, again) | np.append(again, False)
        g, d = g[some], d[some]
        order = np.lexsort((d, g))
        g, d = g[order], d[order]
        # rows that are repeated count once
        new = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]))[: len(g)]
        g, d = g[new], d[new]
        starts = np.flatnonzero(np.diff(g, prepend=~g[:1]))
        many = np.diff(np.append(starts, len(g)))
        df = np.repeat(many, many)
        some = df > 1
        return pd.DataFrame(_by_group(d[some], g[some], np.minimum(df[some], 2**32 - 1), groups), columns=["q", "block"]).astype({"q": "int64"})

    return common.tidy(run)


def _prefixes(num: int, den: int):
    """Of the classes in a group of documents: shared n-grams in rare-first order, how many are in the prefix, and the frequencies of those; none if none is."""

    def run(key: tuple, blocks: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(blocks) and len(heads):
            d, g, df = (np.concatenate(c) for c in zip(*(unpack(b, "<u8", "<u8", "<u4") for b in blocks["block"])))
            d = d.view("i8")
            size = {k: (n, many) for k, n, many in zip(heads["k"].tolist(), heads["n"].tolist(), heads["many"].tolist())}
            mine = np.isin(d, heads["k"].to_numpy())
            d, g, df = d[mine], g[mine], df[mine]
            order = np.lexsort((g, df, d))
            d, g, df = d[order], g[order], df[order]
            # hot n-grams of repeated rows come as often as these
            new = np.append(True, (d[1:] != d[:-1]) | (g[1:] != g[:-1]))[: len(d)]
            d, g, df = d[new], g[new], df[new]
            starts = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else []
            for a, b in zip(starts, [*starts[1:], len(d)]):
                n, many = size[int(d[a])]
                lone = n - (b - a)
                prefix = n - -(-num * n // den) + 1 - lone
                if prefix > 0:
                    prefix = int(min(prefix, b - a))
                    out.append((int(d[a]), n, many, prefix, g[a:b].astype("<u8").tobytes(), df[a : a + prefix].astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["k", "n", "many", "prefix", "grams", "often"])

    return common.tidy(run)


def _long_lists(least: int):
    """Prefix n-grams that may have a long list."""

    def run(batches):
        for pdf in batches:
            out = [np.frombuffer(g, "<u8")[:p][np.frombuffer(o, "<u4") > least] for p, g, o in zip(pdf["prefix"], pdf["grams"], pdf["often"])]
            if out:
                yield pd.DataFrame({"h": np.concatenate(out).view("i8")})

    return common.tidy(run)


# == dense groups


def _places(all_: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where those of ``some`` that are in ``all_``, which is sorted, are."""
    if not len(all_):
        return np.zeros(0, "i8")
    at = np.searchsorted(all_, some)
    at[at == len(all_)] = 0
    return at[all_[at] == some]


def _together(grams: np.ndarray):
    """(a, b): places in ``grams`` that follow one another in a prefix."""

    def run(batches):
        for pdf in batches:
            ends = [np.zeros(0, "i8")]
            for p, g in zip(pdf["prefix"], pdf["grams"]):
                at = _places(grams, np.frombuffer(g, "<u8")[:p])
                ends.append(np.minimum(at[:-1], at[1:]) * len(grams) + np.maximum(at[:-1], at[1:]))
            pair = np.unique(np.concatenate(ends))
            yield pd.DataFrame({"a": pair // len(grams), "b": pair % len(grams)})

    return common.tidy(run)


def _members(grams: np.ndarray, label: np.ndarray):
    """(label, documents, bytes of their n-grams) of the groups in a batch."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, g in zip(pdf["prefix"], pdf["grams"]):
                if len(at := _places(grams, np.frombuffer(g, "<u8")[:p])):
                    rows.append((int(label[at[0]]), 1, len(g)))
            yield pd.DataFrame(rows, columns=["label", "docs", "bytes"], dtype="int64").groupby("label", as_index=False).sum()

    return common.tidy(run)


def _dense_groups(sets: DataFrame, grams: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
    """(the label of each of ``grams``, n-grams of long lists of ``many`` postings, 0 if it is in no dense group; blocks of each label)."""
    label = np.arange(len(grams)) + 1
    if not len(grams):
        return label, {}
    docs = sets.select("prefix", "grams")
    for i, c in components(docs.mapInPandas(_together(grams), "a long, b long").distinct()).toLocalIterator(prefetchPartitions=True):
        label[i] = c + 1
    met = np.bincount(label, many.astype("f8") ** 2, len(grams) + 1)
    blocks = {}
    for r in docs.mapInPandas(_members(grams, label), "label long, docs long, bytes long").groupBy("label").agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes")).toLocalIterator():
        if r["docs"] ** 2 <= WIDE * met[r["label"]]:
            blocks[r["label"]] = max(-(-r["docs"] // SIDE), -(-r["bytes"] // SIDE_BYTES))
    return np.where(np.isin(label, list(blocks)), label, 0), blocks


def _cells(grams: np.ndarray, label: np.ndarray, blocks: dict[int, int]):
    """A row for each block of pairs that a document of a dense group is in; ``own`` is its part of the group."""

    def run(batches):
        names = ["label", "lo", "hi", "own", "k", "n", "many", "grams"]
        for pdf in batches:
            rows, held = [], 0
            for k, n, many, p, g in zip(pdf["k"].tolist(), pdf["n"].tolist(), pdf["many"].tolist(), pdf["prefix"], pdf["grams"]):
                at = _places(grams, np.frombuffer(g, "<u8")[:p])
                if len(at) and (of := int(label[at[0]])):
                    own = int(common.mix(np.array([k], "i8").view("u8"))[0] % np.uint64(blocks[of]))
                    for other in range(blocks[of]):
                        rows.append((of, min(own, other), max(own, other), own, k, n, many, g))
                        held += len(g)
                        if held >= SIDE_BYTES:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return common.tidy(run)


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The number of n-grams that each of ``a`` has in common with each of ``b``."""
    out = np.zeros((len(a), len(b)), "f4")
    sides = []
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    for s in (a, b):
        row, g = np.repeat(np.arange(len(s)), [len(x) for x in s]), np.concatenate(s)
        at = np.searchsorted(both, g)
        at[at == len(both)] = 0
        ok = both[at] == g if len(both) else np.zeros(len(g), bool)
        row, at = row[ok], at[ok]
        order = np.argsort(at, kind="stable")
        size = np.bincount(at, minlength=len(both))
        sides.append((row[order], at[order], size, np.cumsum(size) - size))
    (ra, ca, na, _), (rb, cb, nb, sb) = sides
    # n-grams of many pairs are columns of matrices, the others' pairs are counted one by one
    thick = na * nb > len(a) * len(b) // 100
    place = np.where(thick, np.cumsum(thick) - 1, -1)
    xa, xb = place[ca], place[cb]
    for c in range(0, int(thick.sum()), AT_ONCE):
        x, y = np.zeros((len(a), AT_ONCE), "f4"), np.zeros((len(b), AT_ONCE), "f4")
        for m, r, p in ((x, ra, xa), (y, rb, xb)):
            mine = (p >= c) & (p < c + AT_ONCE)
            m[r[mine], p[mine] - c] = 1
        for r in range(0, len(a), AT_ONCE):
            out[r : r + AT_ONCE] += x[r : r + AT_ONCE] @ y.T
    ra, ca = ra[xa < 0], ca[xa < 0]
    times, flat = nb[ca], out.reshape(-1)
    ends, at = np.cumsum(times), 0
    while at < len(ra):  # so many pairs at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 10 * PIECE, "right")))
        t = times[at:to]
        right = rb[np.repeat(sb[ca[at:to]] - np.cumsum(t) + t, t) + np.arange(t.sum())]
        np.add.at(flat, np.repeat(ra[at:to], t) * len(b) + right, np.float32(1))
        at = to
    return out


def _roots(a: np.ndarray, b: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least of the ids ``a`` of rows and ``b`` of columns that each is connected with."""
    of_a, of_b, least = np.full(len(a), -1), np.full(len(b), -1), []
    for s in np.flatnonzero(held.any(1)).tolist():
        if of_a[s] >= 0:
            continue
        rows, low = np.array([s]), int(a[s])
        while len(rows):
            of_a[rows] = len(least)
            cols = np.flatnonzero(held[rows].any(0) & (of_b < 0))
            of_b[cols] = len(least)
            low = min([low, int(a[rows].min()), *b[cols].tolist()])
            rows = np.flatnonzero(held[:, cols].any(1) & (of_a < 0))
        least.append(low)
    to = np.array([*least, 0], "i8")
    return np.where(of_a < 0, a, to[of_a]), np.where(of_b < 0, b, to[of_b])


def _all_in_block(num: int, den: int, kind: str):
    """What is known of all pairs of a block of a dense group: ``pairs`` as _verify(), ``links`` as _summary(), ``forest`` as _forest()."""

    def run(key: tuple, batches):
        docs = pd.concat(list(batches), ignore_index=True).sort_values("k", ignore_index=True)
        alone = key[1] == key[2]
        a, b = docs[docs["own"] == key[1]], docs[docs["own"] == key[2]]
        if not len(a) or not len(b):
            return
        overlap = _common(*([np.frombuffer(g, "<u8") for g in d["grams"]] for d in (a, b)))
        (ka, na, ma), (kb, nb, mb) = ([d[c].to_numpy("i8") for c in ("k", "n", "many")] for d in (a, b))
        del docs, a, b
        held = np.zeros(overlap.shape, bool)
        links_a, links_b, top_a, top_b = (np.zeros(len(k)) for k in (ka, kb, ka, kb))
        for r in range(0, len(ka), AT_ONCE):
            o = overlap[r : r + AT_ONCE].astype("f8")
            size = na[r : r + AT_ONCE, None] + nb[None]
            ok = o * (num + den) >= num * size
            if alone:
                ok[np.arange(len(o)), r + np.arange(len(o))] = False
            held[r : r + AT_ONCE] = ok
            if kind == "pairs":
                i, j = np.nonzero(np.triu(ok, r + 1) if alone else ok)
                yield pd.DataFrame({"a": np.minimum(ka[r + i], kb[j]), "b": np.maximum(ka[r + i], kb[j]), "overlap": o[i, j].astype("i8"), "jaccard": o[i, j] / (size[i, j] - o[i, j])})
            elif kind == "links":
                jaccard = np.where(ok, o / (size - o), 0.0)
                links_a[r : r + AT_ONCE], top_a[r : r + AT_ONCE] = ok @ mb.astype("f8"), jaccard.max(1)
                links_b += ma[r : r + AT_ONCE].astype("f8") @ ok
                np.maximum(top_b, jaccard.max(0), out=top_b)
        del overlap
        if kind == "pairs":
            return
        if alone:  # a document is both a row and a column
            held[np.arange(len(ka)), np.arange(len(ka))] = True
        roots = _roots(ka, kb, held)
        for k, root, links, top in zip((ka, kb)[: 1 if alone else 2], roots, (links_a, links_b), (top_a, top_b)):
            if kind == "links":
                some = links > 0
                yield pd.DataFrame({"k": k[some], "root": root[some], "links": links[some].astype("i8"), "top": top[some]})
            else:
                yield pd.DataFrame({"k": k, "root": root})

    return common.tidy(run)


def _postings(parts: int, least: int, lists: tuple[np.ndarray, np.ndarray] | None, grams_of: np.ndarray = np.zeros(0, "u8"), label: np.ndarray = np.zeros(0, "i8")):
    """A row for each prefix n-gram: (range, list, document, n and position from the start and side, histogram of what follows, n-grams before it, 0 if none).

    A long list is split into m sub-lists by document; each pair of sub-lists
    is a list, in which the one is side 1 and the other 2, and so is each with
    itself, side 0.  ``grams_of`` are n-grams of long lists with their ``label``:
    those of dense groups have no postings.
    """

    def splits(g: np.ndarray, often: np.ndarray) -> np.ndarray:
        if lists is None:
            return -(-often.astype("i8") // least)
        if not len(lists[0]):
            return np.ones(len(g), "i8")
        at = np.searchsorted(lists[0], g)
        at[at == len(lists[0])] = 0
        return np.where(lists[0][at] == g, -(-lists[1][at] // least), 1)

    def flush(docs: list[tuple]):
        cols: list[list] = [[] for _ in range(7)]
        for i, n, prefix, grams, often in docs:
            g = np.frombuffer(grams, "<u8")
            part = (g & np.uint64(7)).astype("i8")
            # counts after each prefix position; lone n-grams all come before the shared ones
            after = np.bincount(part, minlength=8) - np.cumsum(part[:prefix, None] == np.arange(8), axis=0)
            cols[0].append(g[:prefix])
            cols[1].append(np.full(prefix, i, "i8"))
            cols[2].append(np.full(prefix, n, "i8"))
            cols[3].append(np.arange(prefix) + 1)
            cols[4].append(np.minimum(after, 255).astype("u1").view("<i8").ravel())
            cols[5].append(np.frombuffer(often, "<u4"))
            at = _places(grams_of, g[:prefix])
            cols[6].append(np.full(prefix, label[at[0]] if len(at) else 0, "i8"))
        g, i, n, rank, after, often, of = (np.concatenate(c) for c in cols)
        m = splits(g, often)
        if len(grams_of):
            at = np.searchsorted(grams_of, g)
            at[at == len(grams_of)] = 0
            m[(grams_of[at] == g) & (label[at] > 0)] = 0
        ends = np.cumsum(m)
        a = 0
        while a < len(g):  # so many rows at a time
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
            times = m[a:b]
            row = np.repeat(np.arange(a, b), times)
            h, side = g[row], np.zeros(len(row), "i8")
            if (times > 1).any():
                own = common.mix(i[a:b].view("u8") ^ g[a:b]) % np.maximum(times, 1).astype("u8")
                own = np.repeat(own, times)
                other = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)).astype("u8")
                split = m[row] > 1
                side = np.where(~split | (own == other), 0, np.where(own < other, 1, 2))
                cell = np.minimum(own, other) * np.uint64(1 << 32) + np.maximum(own, other)
                h = np.where(split, common.mix(h ^ common.mix(cell + np.uint64(1))), h)
            before = {f"p{j}": np.where(rank[row] > j, g[np.maximum(row - j, 0)], np.uint64(0)).view("i8") for j in range(1, BEFORE + 1)}
            yield pd.DataFrame({"r": _hash_range(h, parts).astype("i8"), "h": h.view("i8"), "k": i[row], "at": n[row] << 32 | rank[row] << 2 | side, "after": after[row], "of": of[row], **before})
            a = b

    def run(batches):
        docs, held = [], 0
        for pdf in batches:
            for doc in pdf.itertuples(index=False, name=None):
                docs.append(doc)
                held += doc[2]
                if held >= PIECE:
                    yield from flush(docs)
                    docs, held = [], 0
        if docs:
            yield from flush(docs)

    return common.tidy(run)


def _candidates(num: int, den: int):
    """Pairs of a range's posting lists that the length, positional and suffix filters let pass; some of them more than once."""

    def run(key: tuple, batches):
        pdf = pd.concat(list(batches), ignore_index=True)
        n = pdf["at"].to_numpy() >> 32
        order = np.lexsort((n, pdf["h"].to_numpy()))
        n, h, i, at, after, of = n[order], *(pdf[c].to_numpy()[order] for c in ("h", "k", "at", "after", "of"))
        before = [pdf[f"p{j}"].to_numpy()[order] for j in range(1, BEFORE + 1)]
        del pdf
        x = np.arange(len(h))
        most = den * n // num
        first = np.append(True, h[1:] != h[:-1])
        which = np.cumsum(first) - 1
        size = np.bincount(which)
        ends = np.cumsum(size)[which]
        # either: sizes ascend in a list, so the partners of a posting that may be long enough are a run behind it
        many = np.maximum(np.searchsorted(which << 40 | n, (which << 40) + most, "right") - x - 1, 0)
        # or: those with the same n-gram before them, which have met in its list, are a block, and their partners are what is behind the block
        by = np.lexsort((before[0], which))
        p = before[0][by]
        new = np.append(True, (p[1:] != p[:-1]) | (which[by][1:] != which[by][:-1])) | (p == 0)
        block = np.empty(len(h), "i8")
        block[by] = np.cumsum(new) - 1
        same = np.bincount(block)[block]
        # whichever has fewer pairs
        blocks = ((size**2 - np.bincount(which, same)) / 2 < np.bincount(which, many))[which]
        order = np.lexsort((np.where(blocks, block, 0), which))
        n, i, at, after, of, most, block, many = (c[order] for c in (n, i, at, after, of, most, block, many))
        before = [c[order] for c in before]
        edge = np.flatnonzero(np.append(block[1:] != block[:-1], True)) + 1
        start = np.where(blocks, edge[np.searchsorted(edge, x, "right")], x + 1)
        many = np.where(blocks, ends - start, many)
        rank, side = at >> 2 & (1 << 30) - 1, at & 3
        after = after.view("u1").reshape(-1, 8)
        full = (after == 255).any(1)  # a histogram that is full bounds nothing
        most_common = rank + np.where(full, 1 << 40, after.sum(1, dtype="i8"))
        ids, own = np.unique(i, return_inverse=True)
        total = np.cumsum(many)
        found, held, a = [], 0, 0
        while a < len(n):  # so many pairs at a time
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PIECE, "right")))
            m = many[a:b]
            left = np.repeat(x[a:b], m)
            right = start[left] + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
            # what is common can't be more than what is up to here and behind it, for either of the two
            ok = (np.minimum(most_common[left], most_common[right]) * (num + den) >= num * (n[left] + n[right])) & (own[left] != own[right])
            ok &= (n[right] <= most[left]) & (n[left] <= most[right]) & ((side[left] == 0) | (side[left] != side[right])) & ((of[left] == 0) | (of[left] != of[right]))
            left, right = left[ok], right[ok]
            met = np.zeros(len(left), bool)
            there = [c[right] for c in before]
            for c in before:
                mine = c[left]
                for other in there:
                    met |= (mine == other) & (mine != 0)
            left, right = left[~met], right[~met]
            u, v = own[left], own[right]
            # the bounds hold at every common n-gram, so one of each pair is enough to look at
            pair, one = np.unique(np.minimum(u, v) * len(ids) + np.maximum(u, v), return_index=True)
            left, right = left[one], right[one]
            room = np.minimum(after[left], after[right]).sum(1, dtype="i8")
            passed = ((np.minimum(rank[left], rank[right]) + room) * (num + den) >= num * (n[left] + n[right])) | full[left] | full[right]
            found.append(pair[passed])
            held += len(found[-1])
            a = b
            if held >= 2 * PIECE or a == len(n):
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
                if held >= PIECE or a == len(n):
                    yield pd.DataFrame({"a": ids[found[0] // len(ids)], "b": ids[found[0] % len(ids)]})
                    found, held = [], 0

    return common.tidy(run)


def _verified(num: int, den: int, pairs: pd.DataFrame, docs: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    """((a, b, overlap, jaccard) of the pairs that hold, the class size of each document)."""
    sets = {k: (n, np.sort(np.frombuffer(g, "<u8"))) for k, n, g in zip(docs["k"].tolist(), docs["n"].tolist(), docs["grams"])}
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    overlap, sizes = np.zeros(len(a), "i8"), np.zeros(len(a), "i8")
    for x in range(len(a)):
        (na, ga), (nb, gb) = sets[int(a[x])], sets[int(b[x])]
        if len(ga) > len(gb):
            ga, gb = gb, ga
        at = np.searchsorted(gb, ga)
        at[at == len(gb)] = 0
        overlap[x] = (gb[at] == ga).sum() if len(gb) else 0
        sizes[x] = na + nb
    held = overlap * (num + den) >= num * sizes
    overlap = overlap[held]
    return pd.DataFrame({"a": a[held], "b": b[held], "overlap": overlap, "jaccard": overlap / (sizes[held] - overlap)}), dict(zip(docs["k"].tolist(), docs["many"].tolist()))


def _verify(num: int, den: int):
    def run(key: tuple, pairs: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        return _verified(num, den, pairs, docs)[0]

    return common.tidy(run)


def _summary(num: int, den: int):
    """Of each document with links in a task: (k, the least document it is connected with there, links, greatest Jaccard)."""

    def run(key: tuple, pairs: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        held, many = _verified(num, den, pairs, docs)
        root: dict[int, int] = {}
        links: dict[int, int] = {}
        top: dict[int, float] = {}

        def find(x: int) -> int:
            while (p := root.get(x, x)) != x:
                root[x] = root.get(p, p)
                x = p
            return x

        for a, b, _, j in held.itertuples(index=False, name=None):
            x, y = find(a), find(b)
            root[max(x, y)] = root[min(x, y)] = min(x, y)
            for u, v in ((a, b), (b, a)):
                links[u] = links.get(u, 0) + many[v]
                top[u] = max(top.get(u, 0.0), j)
        return pd.DataFrame([(k, find(k), n, top[k]) for k, n in links.items()], columns=["k", "root", "links", "top"])

    return common.tidy(run)


def _forest(num: int, den: int):
    """(k, the least document it is connected with in a task) of each document that has such a one; pairs that are connected by earlier ones aren't verified."""

    def run(key: tuple, pairs: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        sets = {k: (n, np.sort(np.frombuffer(g, "<u8"))) for k, n, g in zip(docs["k"].tolist(), docs["n"].tolist(), docs["grams"])}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := root.get(x, x)) != x:
                root[x] = root.get(p, p)
                x = p
            return x

        for at in range(0, len(pairs), SOME):
            for a, b in zip(pairs["a"].iloc[at : at + SOME].tolist(), pairs["b"].iloc[at : at + SOME].tolist()):
                x, y = find(a), find(b)
                if x == y:
                    continue
                (na, ga), (nb, gb) = sets[a], sets[b]
                if len(np.intersect1d(ga, gb, assume_unique=True)) * (num + den) >= num * (na + nb):
                    root[max(x, y)] = min(x, y)
        return pd.DataFrame([(k, find(k)) for k in root], columns=["k", "root"], dtype="int64")

    return common.tidy(run)


def _hot(texts: DataFrame, n: int, docs: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, frequencies), sorted, of those that seem to be in more than ``most`` documents, by a sample that sees each of them 64 times."""
    if docs <= most:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    rate = min(1.0, 64 / most)

    def grams(batches):
        for _, s in _sets(batches, n):
            yield pd.DataFrame({"g": s.view("i8")})

    sampled = texts.where(common.uniform(F.col("id"), "hot") < rate)
    seen = sampled.mapInPandas(common.tidy(grams), "g long").groupBy("g").count().where(F.col("count") >= 32 * min(1.0, most / 64))
    got = sorted((int(np.int64(r["g"]).view("u8")), round(r["count"] / rate)) for r in seen.orderBy(F.desc("count"), "g").limit(SMALL).collect())
    return np.array([g for g, _ in got], "u8"), np.array([c for _, c in got], "i8")


def classes(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame, bool]:
    """(ids and lower-cased texts, (id, k, n, head, many) of each document with n-grams, whether ids have several sets); k is the number of the document, head that of the one that stands for its class of ``many``."""
    texts = docs.where("id is not null and t is not null").select("id", F.lower("t").alias("t"))
    heads = cut(texts.mapInPandas(_signatures(n), "id long, k long, n long, s1 long, s2 long").distinct())
    if by_set := not heads.groupBy("id").count().where("count > 1").isEmpty():
        heads = heads.withColumn("id_k", F.col("k"))
    else:
        heads = heads.withColumn("id_k", F.col("id"))
    first = heads.groupBy("n", "s1", "s2").agg(F.min_by("id_k", F.struct("id", "id_k")).alias("head"), F.count("*").alias("many"))
    return texts, cut(heads.join(first, ["n", "s1", "s2"]).select("id", F.col("id_k").alias("k"), "n", "head", "many")), by_set


def _held(texts: DataFrame, heads: DataFrame, by_set: bool, n: int, threshold: tuple[int, int], hot: int, longest: int, dense: int, last, kind: str, schema: str) -> DataFrame:
    """What ``last`` makes of the candidates, in blocks of pairs, and _all_in_block() of those in dense groups."""
    num, den = threshold
    total, docs = heads.agg(F.sum("n"), F.count("*")).first()
    parts = max(1, -(-(total or 0) // GROUP))
    ranges = texts.mapInPandas(_to_ranges(n, parts, by_set, *_hot(texts, n, docs, hot)), "p int, block binary")
    shared = ranges.groupBy("p").applyInPandas(_shared(parts), "q long, block binary")
    # the same function of the document as in _by_group
    q = _group_of(parts)
    keyed = heads.where("k = head").select(q("k").alias("of"), "k", "n", "many")
    sets = cut(shared.groupBy("q").cogroup(keyed.groupBy("of")).applyInPandas(_prefixes(num, den), "k long, n long, many long, prefix int, grams binary, often binary"))
    held = sets.agg(F.sum("prefix"), F.sum(F.length("grams"))).first()
    counted = cut(sets.select("prefix", "grams", "often").mapInPandas(_long_lists(min(longest, dense)), "h long").groupBy("h").count().where(F.col("count") > min(longest, dense)))

    def longer(than: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(n-grams, postings) of lists; none if they are too many to send them to all tasks."""
        rows = counted.where(F.col("count") > than).limit(SMALL + 1).collect()
        if len(rows) > SMALL:
            return None
        rows = sorted((int(np.int64(r["h"]).view("u8")), r["count"]) for r in rows)
        return np.array([h for h, _ in rows], "u8"), np.array([c for _, c in rows], "i8")

    for than in (dense, 4 * dense, 16 * dense):
        if thick := longer(than):
            break
    thick = thick or (np.zeros(0, "u8"), np.zeros(0, "i8"))
    label, parts_of = _dense_groups(sets, *thick)
    more = -int(thick[1][label > 0].sum())
    lists = longer(longest)  # if too many, lists are split by the frequencies of their n-grams
    if lists is not None:
        gone = np.isin(lists[0], thick[0][label > 0])
        lists = lists[0][~gone], lists[1][~gone]
        more += sum(c * (-(-c // longest) - 1) for c in lists[1].tolist())
    ranges = max(1, -(-((held[0] or 0) + more) // (GROUP // 2)))
    postings = sets.select("k", "n", "prefix", "grams", "often").mapInPandas(_postings(ranges, longest, lists, thick[0], label), "r long, h long, k long, at long, after long, of long" + "".join(f", p{j} long" for j in range(1, BEFORE + 1)))
    found = cut(postings.groupBy("r").applyInPandas(_candidates(num, den), "a long, b long").distinct())
    # pairs in blocks, about two for each of so many tasks: a document travels once to each block it has pairs in.
    # Blocks aren't put together by a hash, as those that meet by chance would be several times as large as the mean.
    tasks = max(1, -(-(held[1] or 0) * 2 // TASK_BYTES), -(-found.count() // TASK_PAIRS))
    blocks = max(8, int(np.ceil((4 * tasks) ** 0.5)))
    side = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(blocks))
    placed = found.withColumn("task", F.least(side("a"), side("b")) * blocks + F.greatest(side("a"), side("b")))
    wanted = placed.select(F.col("a").alias("k"), F.col("task").alias("at")).unionByName(placed.select(F.col("b").alias("k"), F.col("task").alias("at"))).distinct()
    sent = wanted.join(sets.select("k", "n", "many", "grams"), "k")
    near = placed.groupBy("task").cogroup(sent.groupBy("at")).applyInPandas(last(num, den), schema)
    if not parts_of:
        return near
    # a task for each block, whatever its size in bytes
    cells = sets.select("k", "n", "many", "prefix", "grams").mapInPandas(_cells(thick[0], label, parts_of), "label long, lo int, hi int, own int, k long, n long, many long, grams binary")
    cells = cells.repartition(min(100_000, sum(p * (p + 1) // 2 for p in parts_of.values())), "label", "lo", "hi")
    return near.unionByName(cells.groupBy("label", "lo", "hi").applyInPandas(_all_in_block(num, den, kind), schema))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    inner, (i, t) = isolate(docs, id_col, text_col)
    return inner.select(i.cast("long").alias("id"), t.cast("string").alias("t"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: tuple[int, int] = THRESHOLD, hot: int = HOT, longest: int = LIST, dense: int = DENSE) -> DataFrame:
    """(doc_a, doc_b, overlap, jaccard), doc_a < doc_b, of all pairs at the threshold or above.

    Documents with equal sets are given as pairs of the smallest id of their
    class with each other, and stand for one another in all other pairs, which
    are given for the smallest ids alone.  So x and y are similar if and only
    if their classes are one or form a pair here.
    """
    texts, heads, by_set = classes(_texts(docs, id_col, text_col), n)
    name = heads.select(F.col("k").alias("of"), F.col("id").alias("name"))
    near = _held(texts, heads, by_set, n, threshold, hot, longest, dense, _verify, "pairs", "a long, b long, overlap long, jaccard double")
    same = heads.where("k <> head").select(F.col("head").alias("a"), F.col("k").alias("b"), F.col("n").alias("overlap"), F.lit(1.0).alias("jaccard"))
    pairs = near.unionByName(same)
    if by_set:
        for c in "ab":
            pairs = pairs.join(name, F.col(c) == F.col("of")).withColumn(c, F.col("name")).drop("of", "name")
        pairs = pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max_by(F.struct("overlap", "jaccard"), F.struct("jaccard", "overlap")).alias("v")).select("a", "b", "v.*")
    return pairs.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "overlap", "jaccard")


def _named(each: DataFrame, by_set: bool) -> DataFrame:
    """Classes named by their smallest id, where they are named by a document's number."""
    if not by_set:
        return each
    named = each.groupBy("class_id").agg(F.min("doc_id").alias("name"))
    return each.join(named, "class_id").select("doc_id", F.col("name").alias("class_id"), *[c for c in each.columns if c not in ("doc_id", "class_id")])


def class_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: tuple[int, int] = THRESHOLD, hot: int = HOT, longest: int = LIST, dense: int = DENSE) -> DataFrame:
    """(doc_id, class_id) of each document with n-grams, as links() gives them.

    What is connected is known before all pairs are verified, so that a group
    of near copies costs about as many verifications as it has documents in
    each block of pairs, not as many as it has links.
    """
    texts, heads, by_set = classes(_texts(docs, id_col, text_col), n)
    forest = _held(texts, heads, by_set, n, threshold, hot, longest, dense, _forest, "forest", "k long, root long")
    groups = components(forest.where("root <> k").select(F.col("root").alias("a"), F.col("k").alias("b")))
    each = heads.join(groups.withColumnRenamed("id", "head"), "head", "left")
    return _named(each.select(F.col("id").alias("doc_id"), F.coalesce("component", "head").alias("class_id")), by_set)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: tuple[int, int] = THRESHOLD, hot: int = HOT, longest: int = LIST, dense: int = DENSE) -> DataFrame:
    """(doc_id, class_id, n_links, top_jaccard) of each document.

    ``n_links`` is the number of documents that are similar to it, copies
    counted one by one, ``top_jaccard`` the greatest similarity (null without
    links) and ``class_id`` the smallest id that it is connected with by links.
    An id with several sets has a row for each of them.
    """
    given = _texts(docs, id_col, text_col)
    texts, heads, by_set = classes(given, n)
    found = cut(_held(texts, heads, by_set, n, threshold, hot, longest, dense, _summary, "links", "k long, root long, links long, top double"))
    groups = components(found.where("root <> k").select(F.col("root").alias("a"), F.col("k").alias("b")))  # a root isn't alone in its task
    of_head = found.groupBy("k").agg(F.sum("links").alias("links"), F.max("top").alias("top")).join(groups.withColumnRenamed("id", "k"), "k")
    each = heads.join(of_head.withColumnRenamed("k", "head"), "head", "left")
    each = each.select(
        F.col("id").alias("doc_id"),
        F.coalesce("component", "head").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
        F.when(F.col("many") > 1, 1.0).otherwise(F.col("top")).alias("top_jaccard"),
    )
    each = _named(each, by_set)
    wordless = given.where("id is not null").select("id").distinct().join(heads.select("id"), "id", "left_anti")
    return each.unionByName(wordless.select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("double").alias("top_jaccard")))


def all_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """As join(), but with the pairs of all members of the classes, not of their smallest ids alone; k copies have k (k - 1) / 2."""
    pairs = cut(join(docs, id_col, text_col, n, threshold))
    same, near = pairs.where("jaccard = 1"), pairs.where("jaccard < 1")  # sets that differ have less
    member = same.select(F.col("doc_a").alias("head"), F.col("doc_b").alias("id")).unionByName(same.select(F.col("doc_a").alias("head"), F.col("doc_a").alias("id")).distinct())
    a, b = (member.select(F.col("head").alias(f"head_{c}"), F.col("id").alias(f"id_{c}")) for c in "ab")
    wide = near.join(a, F.col("doc_a") == F.col("head_a"), "left").join(b, F.col("doc_b") == F.col("head_b"), "left").withColumns({"x": F.coalesce("id_a", "doc_a"), "y": F.coalesce("id_b", "doc_b")})
    inner = same.join(b, (F.col("doc_a") == F.col("head_b")) & (F.col("doc_b") < F.col("id_b"))).select(F.col("doc_b").alias("doc_a"), F.col("id_b").alias("doc_b"), "overlap", "jaccard")
    return wide.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "overlap", "jaccard").unionByName(same).unionByName(inner)


def _group_of(groups: int):
    @F.pandas_udf("long")
    def q(i: pd.Series) -> pd.Series:
        return pd.Series((common.mix(i.to_numpy(dtype="i8").view("u8").copy()) % np.uint64(groups)).astype("i8"))

    return q


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that are connected with one of a smaller id: one of each group stays, all columns as they are.

    Rows with a null id stay, and so do rows without words; an id that stays keeps all its rows.
    """
    gone = cut(class_ids(docs, id_col, text_col, n, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct())
    inner, (i,) = isolate(docs, id_col)
    kept = inner.join(gone, i.cast("long") == F.col("__gone"), "left_anti")  # the planner broadcasts it by its measured size, or shuffles
    return restore(kept, docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents"))


def sql(n: int = N, threshold: tuple[int, int] = THRESHOLD) -> str:
    num, den = threshold
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{common.WORD_SQL}') AS w FROM documents WHERE doc_id IS NOT NULL),
sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda k: array_to_string(w[k:k + {n - 1}], ' ')))) END AS g FROM w),
post AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets),
often AS (SELECT x FROM post GROUP BY x HAVING count(*) > 1),
shared AS (SELECT post.* FROM post SEMI JOIN often USING (x)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (a.n + b.n - count(*))::DOUBLE AS jaccard
  FROM shared a JOIN shared b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * {num + den} >= {num} * (a.n + b.n)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON p.a = r.other),
least_id AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id),
degree AS (SELECT a AS doc_id, count(*) AS n_links, max(jaccard) AS top_jaccard FROM pairs GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, top_jaccard FROM least_id LEFT JOIN degree USING (doc_id)
"""


SQL = sql()

"""HTML extraction with wrappers inferred as union-free regular expressions.

A page is a stream of tokens: opening tags, closing tags and texts.  Its
repeated groups are folded first (a unit of any length that follows itself
becomes ``( )+``).  The pages of a host are then aligned one after another with
the wrapper so far: what both have stays, what one lacks becomes an optional
group, repeated groups align with one another and with single occurrences of
their unit, and texts become slots.  A page that the wrapper accepts already
changes nothing, so only distinct folded streams are aligned, the most frequent
first.  A host with many distinct streams isn't gathered anywhere: chunks of
CHUNK streams, dealt by a hash, make a wrapper each, and chunks of wrappers
again, until a host has one.  The result doesn't depend on how pages are spread
over tasks.

Every page is then parsed with the wrapper of its host.  A slot that has the
same text on all pages of the host that hold any text belongs to the template;
the others hold data.  Pages with equal texts are one page: a host that has only
one, however often, has no template, and all its texts stay.  The text of a page
is what its data slots hold outside of navigation, headers of sites, footers
and asides, the title apart; a title stays if it is the same on all pages.

Defined cases: ids are integers; a null or empty page has null title and empty text; a page
without host belongs to the host ``''``; a page with broken tags is a stream of
tokens like any other; ``<`` that begins no tag is text; a header within an
article or main element is content; an aside that isn't closed ends with the
element around it, and is content if that is the page, its body, main or an
article, as its end isn't known then; comments, scripts and styles are left out; rows that are
repeated are extracted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, isolate, table

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(?P<raw>script|style)\b[^<>]*>(?:.*?</(?P=raw)\s*>|.*)|<(?P<tag>/?[a-z][a-z0-9:-]*)[^<>]*>?|<[/!?][^<>]*>?|(?P<text>(?:[^<]+|<(?![a-z/!?]))+)", re.S | re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Texts within these aren't content.
ASIDE = frozenset("nav footer aside header menu noscript select button".split())
#: What closes the asides left open in it; other closing tags don't.
BLOCKS = ASIDE | frozenset("html head body main article section div center address blockquote details dialog fieldset figure figcaption form hgroup search ul ol dl li dt dd table caption thead tbody tfoot tr td th".split())
#: An aside that is left open in these could be all the rest of the page.
WIDE = frozenset("html body main article".split())
#: Wrappers up to this many bytes are broadcast; more are joined by host.
BROADCAST_BYTES = 32 << 20
#: Streams or wrappers that one task aligns.
CHUNK = 256
SCHEMA = "page_id long, host string, matched boolean, n_slots int, title string, text string"


def tokens(html: str) -> tuple[list, list, list]:
    """(tokens, texts, zone of each text: title, aside or body); a text is the token ``#``."""
    out, texts, zones = [], [], []
    opened: list[tuple[str, int]] = []  # blocks, with the number of the aside that each is, or -1
    count: dict[str, int] = {}
    inside: tuple[int, ...] = ()
    asides, title, unknown = 0, False, set()
    for m in _TOKEN.finditer(html):
        if (tag := m["tag"]) is not None:
            tag = tag.lower()
            out.append(tag)
            name = tag[1:] if tag[0] == "/" else tag
            if name == "title":
                title = tag == name
            elif name not in BLOCKS:
                continue
            elif tag == name:
                own = -1
                if name in ASIDE and not (name == "header" and (count.get("article") or count.get("main"))):
                    own, asides = asides, asides + 1
                    inside = (*inside, own)
                opened.append((name, own))
                count[name] = count.get(name, 0) + 1
            elif count.get(name):
                while True:
                    last, own = opened.pop()
                    count[last] -= 1
                    if own >= 0:
                        inside = inside[:-1]
                        if name in WIDE:
                            unknown.add(own)
                    if last == name:
                        break
        elif (text := m["text"]) is not None:
            if text := text.strip():
                out.append("#")
                texts.append(text)
                zones.append("title" if title else inside)
    unknown.update(own for _, own in opened)
    return out, texts, [z if z == "title" else "body" if unknown.issuperset(z) else "aside" for z in zones]


# A wrapper is a tuple of nodes: a token, ("+", nodes) or ("?", nodes).


def fold(stream: list[str]) -> tuple:
    """The stream with elements, and then any units, that follow themselves made repeated groups."""
    out: list = []
    open_at: dict[str, list[int]] = {}
    for t in stream:
        out.append(t)
        if t == "#" or t in VOID:
            continue
        if t[0] != "/":
            open_at.setdefault(t, []).append(len(out) - 1)
            continue
        own = open_at.get(t[1:])
        while own and (own[-1] >= len(out) or out[own[-1]] != t[1:]):
            own.pop()  # it went with a group
        if not own:
            continue
        s = own.pop()
        unit = tuple(out[s:])
        n = len(unit)
        if s and out[s - 1] == ("+", unit):
            del out[s:]
        elif s >= n and tuple(out[s - n : s]) == unit:
            del out[s - n :]
            out.append(("+", unit))
    return _fold_runs(tuple(out))


@lru_cache(512)
def _fold_runs(nodes: tuple) -> tuple:
    """The nodes with runs of any length that follow themselves as groups, the shortest first."""
    out: list = []
    places: dict = {}  # of each node
    groups: dict = {}  # of groups, by the last node of their unit
    sums, power = np.zeros(len(nodes) + 2, "u8"), _powers(len(nodes) + 2)

    def push(node) -> None:
        places.setdefault(node, []).append(len(out))
        if isinstance(node, tuple):
            groups.setdefault(node[1][-1], []).append(len(out))
        out.append(node)
        sums[len(out)] = sums[len(out) - 1] * _ODD + np.uint64(hash(node) & (2**64 - 1))

    def pop(n: int) -> None:
        for _ in range(n):
            node = out.pop()
            places[node].pop()
            if isinstance(node, tuple):
                groups[node[1][-1]].pop()

    def twice(end: int, single: bool) -> int:
        """The size of the shortest run that ends here and follows itself, or 0; hashes of prefixes tell where to look."""
        own = places[out[-1]]
        first = bisect_left(own, (end - 1) // 2)
        at = np.array(own[first:-1], "i8")[::-1]
        n = end - 1 - at
        n = n[(2 * n <= end) & ((n > 1) | single)]
        mid, low = sums[end - n], sums[end - 2 * n]
        for k in n[sums[end] - mid * power[n] == mid - low * power[n]].tolist():
            if out[end - 2 * k : end - k] == out[end - k :]:
                return k
        return 0

    with np.errstate(over="ignore"):
        for node in nodes:
            if isinstance(node, tuple) and out and out[-1] == node:
                continue
            push(node)
            end = len(out)
            more = next((end - 1 - g for g in reversed(groups.get(node, ())) if len(out[g][1]) == end - 1 - g and out[g][1] == tuple(out[g + 1 :])), 0)
            again = twice(end, node != "#" and not isinstance(node, tuple)) if len(places[node]) > 1 else 0
            if more and (more <= again or not again):
                pop(more)
            elif again:
                unit = tuple(out[-again:])
                pop(2 * again)
                if not out or out[-1] != ("+", unit):
                    push(("+", unit))
    return tuple(out)


_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(64)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, _ODD, "u8")]), dtype="u8")


def _lift(nodes: tuple, groups: set) -> tuple:
    """``nodes`` with runs that are the unit of one of ``groups`` as that group."""
    for g in sorted(groups, key=lambda g: (-len(g[1]), repr(g))):
        unit, out, k = g[1], [], 0
        while k < len(nodes):
            if nodes[k : k + len(unit)] == unit:
                out.append(g)
                k += len(unit)
            else:
                out.append(nodes[k])
                k += 1
        nodes = tuple(out)
    return nodes


def _tight(nodes: list) -> tuple:
    """Neighbouring equal groups as one, no option in an option."""
    out: list = []
    for n in nodes:
        if isinstance(n, tuple) and n[0] == "?" and len(n[1]) == 1 and isinstance(n[1][0], tuple) and n[1][0][0] == "?":
            n = n[1][0]
        if out and isinstance(n, tuple) and out[-1] == n:
            if n[0] == "?":
                out[-1] = ("?", (("+", n[1]),))
            continue
        out.append(n)
    return tuple(out)


def align(a: tuple, b: tuple) -> tuple:
    """The wrapper of all that ``a`` or ``b`` accept: a longest common subsequence stays, the rest is optional."""
    if a == b:
        return a
    own = {n for n in a if isinstance(n, tuple)}
    a, b = _lift(a, {n for n in b if isinstance(n, tuple)} - own), _lift(b, own)
    pre = 0
    while pre < min(len(a), len(b)) and a[pre] == b[pre]:
        pre += 1
    post = 0
    while post < min(len(a), len(b)) - pre and a[-1 - post] == b[-1 - post]:
        post += 1
    x, y = a[pre : len(a) - post], b[pre : len(b) - post]
    kinds: dict = {}
    number = lambda n: kinds.setdefault(n if isinstance(n, str) else (n[1][0], n[1][-1]), len(kinds))
    pairs = common_subsequence(np.array([number(n) for n in x], "i4"), np.array([number(n) for n in y], "i4"))
    out, only_a, only_b = list(a[:pre]), [], []

    def flush():
        for run in (only_a, only_b):
            if run:
                out.append(run[0] if len(run) == 1 and isinstance(run[0], tuple) and run[0][0] == "?" else ("?", tuple(run)))
                run.clear()

    i = j = 0
    for p, q in [*pairs, (len(x), len(y))]:
        only_a += x[i:p]
        only_b += y[j:q]
        flush()
        i, j = p + 1, q + 1
        if p == len(x):
            break
        if x[p] == y[q]:
            out.append(x[p])
            continue
        kind = "?" if "?" in (x[p][0], y[q][0]) else "+"
        body = align(x[p][1], y[q][1])
        if kind == "?" and "+" in (x[p][0], y[q][0]):
            body = (("+", body),)
        out.append((kind, body))
    return _tight(out + list(a[len(a) - post :]))


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The length of a longest common subsequence of ``x`` and each prefix of ``y``."""
    row = np.zeros(len(y) + 1, "i4")
    for v in x:
        row[1:] = np.maximum(row[1:], row[:-1] + (y == v))
        np.maximum.accumulate(row, out=row)
    return row


def common_subsequence(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; halves of ``x`` are solved one after the other, so memory grows with the sum of the lengths."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            hit = np.flatnonzero(y[c:d] == x[a])
            if len(hit):
                out.append((a, c + int(hit[0])))
            continue
        mid = (a + b) // 2
        at = c + int((_lengths(x[a:mid], y[c:d]) + _lengths(x[a:b][mid - a :][::-1], y[c:d][::-1])[::-1]).argmax())
        todo += [(a, mid, c, at), (mid, b, at, d)]
    return sorted(out)


# A program is a tuple of instructions for a backtracking machine that never is in a state twice.


def compile_wrapper(nodes: tuple) -> tuple:
    code: list = []
    slots = 0

    def emit(ns: tuple) -> None:
        nonlocal slots
        for n in ns:
            if isinstance(n, str):
                if n == "#":
                    code.append(("#", slots))
                    slots += 1
                else:
                    code.append((n, 0))
            elif n[0] == "+":
                at = len(code)
                emit(n[1])
                code.append(("loop", at))
            else:
                at = len(code)
                code.append(None)
                emit(n[1])
                code[at] = ("try", len(code))

    emit(nodes)
    return tuple(code)


def parse(code: tuple, stream: list[str]) -> list[int] | None:
    """The slot of each text of the stream, or None if the wrapper doesn't accept it; each accepts an empty stream."""
    if not stream:
        return []
    end, n = len(code), len(stream)
    todo, seen, trail = [(0, 0, 0)], set(), []
    while todo:
        pc, i, keep = todo.pop()
        del trail[keep:]
        while True:
            if pc == end:
                if i == n:
                    return trail
                break
            op, arg = code[pc]
            if op == "try" or op == "loop":
                if (pc, i) in seen:
                    break
                seen.add((pc, i))
                if op == "try":
                    todo.append((arg, i, len(trail)))
                    pc += 1
                else:
                    todo.append((pc + 1, i, len(trail)))
                    pc = arg
            elif i < n and stream[i] == op:
                if op == "#":
                    trail.append(arg)
                pc, i = pc + 1, i + 1
            else:
                break
    return None


def infer(given: list[tuple]) -> tuple:
    """The wrapper of folded streams or wrappers, aligned in the order given."""
    wrapper, code = None, ()
    for s in given:
        if not s:
            continue
        if wrapper is None:
            wrapper = s
        elif _optional(s) or parse(code, unfold(s)) is None or parse(code, unfold(s, 2)) is None:
            wrapper = align(wrapper, s)
        else:
            continue
        code = compile_wrapper(wrapper)
    return wrapper or ()


def _optional(nodes: tuple) -> bool:
    return any(isinstance(n, tuple) and (n[0] == "?" or _optional(n[1])) for n in nodes)


def unfold(nodes: tuple, times: int = 1) -> list[str]:
    out: list[str] = []
    for n in nodes:
        if isinstance(n, str):
            out.append(n)
        else:
            for _ in range(times if n[0] == "+" else 1):
                out += unfold(n[1], times)
    return out


def show(nodes: tuple) -> str:
    """As a regular expression over tokens; read() takes it back."""
    return " ".join(n if isinstance(n, str) else f"( {show(n[1])} ){n[0]}" for n in nodes)


def read(text: str) -> tuple:
    stack: list[list] = [[]]
    for t in text.split():
        if t == "(":
            stack.append([])
        elif t[0] == ")":
            body = tuple(stack.pop())
            stack[-1].append((t[1], body))
        else:
            stack[-1].append(t)
    return tuple(stack[0])


def _skeletons(batches):
    found: dict[tuple[str, str], int] = {}
    for pdf in batches:
        for host, html in zip(pdf["host"], pdf["html"]):
            key = (host, show(fold(tokens(html)[0])))
            found[key] = found.get(key, 0) + 1
        if len(found) > 50_000:
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["host", "wrapper", "n"])
            found = {}
    yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["host", "wrapper", "n"])


def _infer_chunk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "wrapper"], ascending=[False, True], kind="stable")
    wrapper = infer([read(s) for s in pdf["wrapper"]])
    return pd.DataFrame({"host": [key[0]], "wrapper": [show(wrapper)], "n": [int(pdf["n"].sum())]})


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    inner, (i, u, h) = isolate(pages, id_col, url_col, html_col)
    return inner.select(i.cast("long").alias("id"), host_of(u).alias("host"), F.coalesce(h, F.lit("")).alias("html"))


def _wrappers(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    found = pages.select("host", "html").mapInPandas(_skeletons, "host string, wrapper string, n long")
    level = cut(found.groupBy("host", "wrapper").agg(F.sum("n").alias("n")))
    while True:
        many = level.groupBy("host").agg(F.count("*").alias("many"))
        most = many.agg(F.max("many")).first()[0] or 0
        if most > chunk:  # some host takes a round more
            level = level.join(many, "host").withColumn("c", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("many") / chunk)))
        else:
            level = level.withColumn("c", F.lit(0))
        level = level.groupBy("host", "c").applyInPandas(_infer_chunk, "host string, wrapper string, n long")
        if most <= chunk:
            return level.withColumnRenamed("n", "n_pages")
        level = cut(level.groupBy("host", "wrapper").agg(F.sum("n").alias("n")))


def wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, n_pages) of each host."""
    return _wrappers(_pages(pages, id_col, url_col, html_col))


@lru_cache(5_000)
def _code(wrapper: str) -> tuple:
    return compile_wrapper(read(wrapper))


def _parsed(pdf: pd.DataFrame, of_host: dict | None):
    for k, (i, host, html) in enumerate(zip(pdf["id"], pdf["host"], pdf["html"])):
        wrapper = of_host[host] if of_host is not None else pdf["wrapper"].iloc[k]
        stream, texts, zones = tokens(html)
        yield i, host, parse(_code(wrapper), stream), texts, zones


def _slots(of_host: dict | None):
    """Of each slot in a task: on how many pages it occurs, whether its texts are the same, and their digest; as slot -1 of a host, how many pages have texts, and the least and greatest digest of these."""

    def run(batches):
        seen: dict[tuple[str, int], list] = {}
        pages: dict[str, list] = {}
        for pdf in batches:
            for _, host, slots, texts, _ in _parsed(pdf, of_host):
                if texts:
                    d = blake2b("\0".join(texts).encode("utf-8", "replace"), digest_size=16).hexdigest()
                    n, lo, hi = pages.get(host, (0, d, d))
                    pages[host] = [n + 1, min(lo, d), max(hi, d)]
                here: set[int] = set()
                for s, t in zip(slots or (), texts):
                    h = blake2b(t.encode("utf-8", "replace"), digest_size=16).hexdigest()
                    own = seen.setdefault((host, s), [h, 0, True])
                    own[1] += s not in here
                    own[2] = own[2] and own[0] == h
                    here.add(s)
        rows = [(h, s, t if same else None, t if same else None, n, same) for (h, s), (t, n, same) in seen.items()]
        yield pd.DataFrame(rows + [(h, -1, lo, hi, n, True) for h, (n, lo, hi) in pages.items()], columns=["host", "slot", "lo", "hi", "n", "same"])

    return run


def _extract(of_host: dict | None, fixed: dict[str, frozenset[int]] | None):
    def run(batches):
        for pdf in batches:
            rows = []
            for k, (i, host, slots, texts, zones) in enumerate(_parsed(pdf, of_host)):
                still = fixed.get(host, frozenset()) if fixed is not None else frozenset(pdf["fixed"].iloc[k])
                title, body, used = None, [], set()
                for n, (t, z) in enumerate(zip(texts, zones)):
                    if z == "title":
                        title = title or unescape(t)
                    elif slots is not None and slots[n] in still:
                        continue
                    if slots is not None:
                        used.add(slots[n])
                    if z == "body":
                        body.append(unescape(t))
                rows.append((i, host, slots is not None, len(used), title, "\n".join(body)))
            yield pd.DataFrame(rows, columns=["page_id", "host", "matched", "n_slots", "title", "text"]).astype({"page_id": "Int64"})

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, matched, n_slots, title, text) of each page."""
    inner = _pages(pages, id_col, url_col, html_col)
    known = cut(_wrappers(inner))
    size = known.agg(F.sum(F.length("wrapper") + F.length("host") + 64)).first()[0] or 0
    schema = "host string, slot int, lo string, hi string, n long, same boolean"
    if small := size <= broadcast_bytes:
        of_host = {r["host"]: r["wrapper"] for r in known.collect()}
        parts = inner.mapInPandas(_slots(of_host), schema)
    else:
        joined = inner.join(known.select("host", "wrapper"), "host")
        parts = joined.select("id", "host", "html", "wrapper").mapInPandas(_slots(None), schema)
    slots = parts.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.bool_and("same").alias("same"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    steady = slots.where("same and (slot = -1) = (lo <> hi)").groupBy("host").agg(F.max(F.expr("if(slot = -1, n, null)")).alias("n_pages"), F.collect_list(F.expr("if(slot >= 0, struct(slot, n), null)")).alias("s"))
    fixed = steady.where("n_pages is not null").select("host", F.expr("transform(filter(s, x -> x.n = n_pages), x -> x.slot)").alias("fixed"))
    if small:  # no more than the slots of those wrappers
        still = {r["host"]: frozenset(r["fixed"]) for r in fixed.collect()}
        return inner.mapInPandas(_extract(of_host, still), SCHEMA)
    both = joined.join(fixed, "host", "left").withColumn("fixed", F.coalesce("fixed", F.array().cast("array<int>")))
    return both.select("id", "host", "html", "wrapper", "fixed").mapInPandas(_extract(None, None), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""What needs a document tree: one Arrow UDF parses a body once and returns all of it.

The tree comes from the standard library's parser; broken markup gives a tree
of its own reading, so texts may differ from other parsers' where tags are not
balanced.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..policy import DEFAULT, Policy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SCHEMA = (
    "hub struct<is_hub: boolean, reasons: array<string>, links: array<string>, n_links: int, body_chars: int, link_text_chars: int, title: string, dropped: int>, "
    "pdf_links array<string>, definition string, deprecation string, overlays array<string>, markdown string"
)
DEFINITION = re.compile(r"definition", re.I)
DEPRECATED = re.compile(r"deprecat", re.I)
TERMS = frozenset("div dt h1 h2 h3 h4 h5 p span strong th".split())
OVERLAY = re.compile(r"\b(paywall|overlay|modal|signin|gate|wall)\b", re.I)
MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`"}
NOTICE = frozenset("alert card danger-card deprecated notice warning".split())


class Node:
    __slots__ = ("tag", "attrs", "items", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.items, self.parent = tag, attrs, [], parent

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.items) if isinstance(c, Node)]

    def strings(self, skip: frozenset = frozenset()):
        todo: list = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in skip:
                todo += reversed(n.items)

    def text(self, by: str = " ", skip: frozenset = frozenset()) -> str:
        return by.join(s for t in self.strings(skip) if (s := t.strip()))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "dt", "dd") and self.at.tag == tag:
            self.at = self.at.parent
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.items.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.items.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def normalize(url: str) -> str:
    """functions.urls.normalize_url for one string."""
    raw = (url or "").strip()
    try:
        p = urlsplit(raw)
        _ = p.port
        return p._replace(netloc=p.hostname or p.netloc, path="".join(p.path.split())).geturl()
    except ValueError:
        return raw


def text_sizes(root: Node) -> dict[int, int]:
    """The length of text() of each node, in one pass."""
    sums: dict[int, tuple[int, int]] = {}
    for n in reversed(list(root.walk())):  # children before parents
        size = many = 0
        for c in n.items:
            a, b = sums[id(c)] if isinstance(c, Node) else (len(s), 1) if (s := c.strip()) else (0, 0)
            size, many = size + a, many + b
        sums[id(n)] = (size, many)
    return {k: size + max(0, many - 1) for k, (size, many) in sums.items()}


def hub(root: Node, base: str, policy: Policy = DEFAULT, prefixes: tuple[str, ...] = (), other_hosts: frozenset[str] = frozenset()) -> dict:
    gone = frozenset("script style noscript nav footer header aside".split())
    body = "\n".join(root.strings(gone)).strip()
    own, links, chars, dropped = (urlsplit(base).hostname or "").lower(), [], 0, 0
    kept_out, sizes = set(), text_sizes(root)
    for n in root.walk():
        if n.tag in gone or id(n.parent) in kept_out:
            kept_out.add(id(n))
    for n in root.walk():
        href = n.attrs.get("href", "").strip() if n.tag == "a" and id(n) not in kept_out else ""
        if not href or href.startswith(("#", "javascript:")):
            continue
        try:
            full = urljoin(base, href)
            p = urlsplit(full)
            site = (p.hostname or "").lower()
        except ValueError:
            continue
        if p.scheme not in ("http", "https"):
            continue
        path = p.path.strip()
        if path in ("", "/") or re.search("email-protection|cdn-cgi", path):
            dropped += 1
        elif site != own and site not in other_hosts:
            continue
        elif prefixes and not path.startswith(prefixes):
            dropped += 1
        else:
            links.append(normalize(full))
            chars += sizes[id(n)]
    links = list(dict.fromkeys(links))[: policy.hub_cap]
    density = chars / len(body) if body else 0.0
    tests = {"links_min": len(links) >= policy.hub_links, "low_body_text": len(body) <= policy.hub_body, "high_link_density": density >= policy.hub_density}
    title = next((n.text() for n in root.walk() if n.tag == "title"), "") or None
    is_hub = tests["links_min"] and (tests["low_body_text"] or tests["high_link_density"])
    return dict(is_hub=is_hub, reasons=[k for k, v in tests.items() if v], links=links, n_links=len(links), body_chars=len(body), link_text_chars=chars, title=title, dropped=dropped)


def pdf_links(root: Node, base: str) -> list[str]:
    out = []
    for n in root.walk():
        if n.tag == "a" and (href := n.attrs.get("href", "").strip()):
            try:
                u = normalize(urljoin(base, href))
            except ValueError:
                continue
            if re.split(r"[?#]", u)[0].lower().endswith(".pdf"):
                out.append(u)
    return out


def definition(root: Node, html: str) -> str | None:
    """The text around the first element that speaks of a definition, or of a list of definitions."""
    if not re.search(r"definition|glossary", html, re.I):
        return None

    def snippet(n) -> str | None:
        t = n.text() if isinstance(n, Node) else n.strip() if isinstance(n, str) else ""
        return t[:800] if 40 <= len(t) <= 1200 else None

    n = _first_term(root)
    if n is not None:
        after = n.parent.items[n.parent.items.index(n) + 1 :] if n.parent else []
        return snippet(n.parent) or (snippet(after[0]) if after else None) or n.text()
    lists = next((n for n in root.walk() if n.tag == "dl"), None)
    return snippet(lists) if lists else None


def _first_term(root: Node) -> Node | None:
    """The first element of TERMS whose text speaks of a definition: the outermost around the first text that has one."""
    todo: list = [(root, None)]
    while todo:
        item, parent = todo.pop()
        if isinstance(item, Node):
            todo += [(c, item) for c in reversed(item.items)]
        elif DEFINITION.search(item):
            best = None
            while parent is not None:
                best = parent if parent.tag in TERMS else best
                parent = parent.parent
            if best is not None:
                return best
    return None


def deprecation(root: Node, html: str) -> str | None:
    """The notice that something is deprecated: a box that says so, else the largest short text around the word."""
    if not DEPRECATED.search(html):
        return None
    for n in root.walk():
        said = next((s for s in n.items if isinstance(s, str) and DEPRECATED.search(s)), None)
        if said is None:
            continue
        best, at, below, t = None, n, None, ""
        while at is not None:
            boxed = bool(NOTICE & set(at.attrs.get("class", "").lower().split()))
            if t is not None:  # the text of what is below, with what is around it; None once it is too long
                t = " ".join(x for c in at.items if (x := t if c is below else c.text() if isinstance(c, Node) else c.strip()))
                if len(t) > 800:
                    t = None
                elif at.tag not in ("script", "style") and t:
                    best = t
            if boxed and at.tag not in ("script", "style") and (whole := t if t is not None else at.text()):
                return whole[:800]
            at, below = at.parent, at
        return best or said.strip() or "deprecation warning"
    return "deprecation warning"


def overlays(root: Node) -> list[str]:
    out = [f"{k}:{n.attrs[k][:120]}" for k in ("class", "id") for n in root.walk() if k in n.attrs and OVERLAY.search(n.attrs[k])]
    for n in root.walk():
        s = n.attrs.get("style", "").lower().replace(" ", "")
        if re.search(r"position:(fixed|absolute)", s) and re.search(r"(top|left):0", s) and re.search(r"(width|height):100%", s):
            out.append(f"style:{n.attrs['style'][:120]}")
    return out[:10]


def markdown(root: Node) -> str:
    """Headings, paragraphs, lists, links, code and tables as Markdown."""
    lines: list[str] = []

    def inline(top) -> str:
        open_: list = [(None, iter([top]), [])]  # (element, what is left of it, its parts so far)
        while True:
            n, rest, parts = open_[-1]
            c = next(rest, None)
            if c is None:
                open_.pop()
                t = "".join(parts)
                if n is None:
                    return t
                if s := t.strip():
                    if n.tag == "a" and n.attrs.get("href"):
                        t = f"[{s}]({n.attrs['href']})"
                    elif mark := MARKS.get(n.tag):
                        t = f"{mark}{s}{mark}"
                open_[-1][2].append(t)
            elif isinstance(c, str):
                parts.append(re.sub(r"\s+", " ", c))
            elif c.tag not in ("script", "style", "noscript"):
                open_.append((c, iter(c.items), []))

    todo: list = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if n.strip():
                lines.append(re.sub(r"\s+", " ", n).strip())
        elif n.tag in ("script", "style", "noscript", "head"):
            continue
        elif re.fullmatch(r"h[1-6]", n.tag):
            lines.append(f"{'#' * int(n.tag[1])} {inline(n).strip()}")
        elif n.tag == "tr":
            lines.append("| " + " | ".join(inline(c).strip() for c in n.items if isinstance(c, Node)) + " |")
        elif n.tag == "li":
            lines.append(f"- {inline(n).strip()}")
        elif n.tag == "pre":
            lines.append("```\n" + "".join(n.strings()).strip("\n") + "\n```")
        elif n.tag in ("p", "dt", "dd", "a", "b", "strong", "em", "i", "code", "span", "td", "th") and not any(isinstance(c, Node) and c.tag in ("p", "div", "ul", "ol", "table") for c in n.items):
            if t := inline(n).strip():
                lines.append(t)
        else:
            todo += reversed(n.items)
    return "\n\n".join(lines)


_PART = re.compile(r"""([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^$~]?)=['"]?([^'"\]]*)['"]?)?\]""")


def _compound(text: str) -> list | None:
    """Tests of one step of a selector, or None if it can't be read."""
    out, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or (m[1] and at):
            return None
        out.append(m.groups())
        at = m.end()
    return out or None


def _fits(n: Node, tests: list) -> bool:
    for tag, ident, cls, attr, how, value in tests:
        have = n.attrs.get(attr) if attr else None
        if tag and tag != "*" and n.tag != tag.lower():
            return False
        if ident and n.attrs.get("id") != ident:
            return False
        if cls and cls not in n.attrs.get("class", "").split():
            return False
        if attr and (have is None or (value is not None and not {"": have == value, "*": value in have, "^": have.startswith(value), "$": have.endswith(value), "~": value in have.split()}[how or ""])):
            return False
    return True


def find(root: Node, selector: str) -> list[Node]:
    """Nodes of a selector, in document order: steps of tag, #id, .class and [attr], [attr='v'] (also *=, ^=, $=, ~=), one within the other or, after ``>``, right in it; alternatives after commas."""
    ways = []
    for way in selector.split(","):
        steps, direct = [], False
        for word in way.replace(">", " > ").split():
            if word == ">":
                direct = True
                continue
            tests = _compound(word)
            if tests is None:
                steps = []
                break
            steps.append((tests, direct))
            direct = False
        if steps:
            ways.append(steps)

    def holds(n: Node, steps: list) -> bool:
        if not n.tag or not _fits(n, steps[-1][0]):
            return False
        at, direct = n.parent, steps[-1][1]
        for tests, more in reversed(steps[:-1]):
            while at is not None and not (at.tag and _fits(at, tests)):
                at = None if direct else at.parent
            if at is None:
                return False
            at, direct = at.parent, more
        return True

    return [n for n in root.walk() if any(holds(n, steps) for steps in ways)] if ways else []


def select(root: Node, selectors: list[str], most: int = 8) -> Node:
    """The nodes of the first selector that finds any, ``most`` at most, else the whole tree."""
    for sel in selectors:
        if found := find(root, sel):
            out = Node("", {}, None)
            out.items = list(found[:most])
            return out
    return root


MAIN = ("article", "main", "[role='main']", *(f"[{a}*='{w}']" for w in ("content", "article", "post") for a in ("class", "id")))
SILENT = frozenset("script style noscript".split())


def main_text(html: str) -> str:
    """The text of the main part of a page: of the first of MAIN that finds text in its first eight nodes, else of the first 400 paragraphs."""
    root = tree(html or "")
    for sel in MAIN:
        for n in find(root, sel)[:8]:
            if n.tag not in SILENT and (t := n.text(skip=SILENT)):
                return t
    return " ".join(t for n in find(root, "p")[:400] if (t := n.text(skip=SILENT)))


@F.pandas_udf(T.StringType())
def extracted_main(html: pd.Series) -> pd.Series:
    return html.map(main_text)


def clean_markup(html: str) -> str:
    """Markup written anew from its tree, with every element closed, without scripts, styles, frames and comments."""
    out: list[str] = []
    todo: list = [tree(html or "")]
    while todo:
        n = todo.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif isinstance(n, str):
            out.append(escape(n, quote=False))
        elif n.tag not in ("script", "style", "noscript", "iframe"):
            if n.tag:
                attrs = "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items() if not k.startswith("on"))
                out.append(f"<{n.tag}{attrs}>")
                if n.tag not in VOID:
                    todo.append((f"</{n.tag}>",))
            todo += reversed(n.items)
    return "".join(out)


@F.pandas_udf(T.StringType())
def repaired(html: pd.Series) -> pd.Series:
    return html.map(lambda h: h if h is None else clean_markup(h))


FIELDS = ("hub", "pdf_links", "definition", "deprecation", "overlays", "markdown")


def features(html: Column, url: Column, policy: Policy = DEFAULT, fields: tuple[str, ...] = FIELDS) -> Column:
    """The struct of SCHEMA, from one parse; what isn't among ``fields`` is null and costs nothing, and so does a null body."""

    @F.pandas_udf(SCHEMA)
    def run(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        rows = []
        for body, base in zip(h, u):
            if body is None and "hub" not in fields:
                rows.append((None,) * len(FIELDS))
                continue
            root = tree(body or "")
            make = {
                "hub": lambda: hub(root, base or "", policy), "pdf_links": lambda: pdf_links(root, base or ""), "definition": lambda: definition(root, body or ""),
                "deprecation": lambda: deprecation(root, body or ""), "overlays": lambda: overlays(root), "markdown": lambda: markdown(root),
            }
            rows.append(tuple(make[f]() if f in fields else None for f in FIELDS))
        return pd.DataFrame(rows, columns=list(FIELDS))

    return run(html, url)


def pdf_discovery(links: Column, policy: Policy = DEFAULT) -> Column:
    """struct(links, total): links to PDFs as metadata, ``pdf_link_cap`` of them, and how many there are."""
    return F.struct(F.slice(links, 1, policy.pdf_link_cap).alias("links"), F.size(links).alias("total"))


@F.pandas_udf(T.StringType())
def fit_markdown(html: pd.Series, selectors: pd.Series) -> pd.Series:
    """Markdown of what the selectors choose, from its first top heading on."""

    def one(h, s):
        md = markdown(select(tree(h or ""), list(s) if s is not None else []))
        at = re.search(r"^# ", md, re.M)
        return md[at.start() :].strip() if at else md.strip()

    return pd.Series([one(h, s) for h, s in zip(html, selectors)])

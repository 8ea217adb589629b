"""Content of bodies as Column functions.

HTML is read by a regular-expression profile: chrome elements and comments go,
tags become blanks, four entities are decoded.  It isn't a DOM; ``<nav`` also
starts ``<navx``.  operators/dom.py has the functions that need one.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..policy import DEFAULT, Policy
from .urls import host, match_suffix, path, strip

CHROME = tuple("script style noscript nav footer header aside".split())
SPACE = r"[ \t\n\f\r]+"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, each column taken from an array of one at a place that is 0, but random to the optimizer.

    The optimizer pushes a filter through projections by writing out all they
    compute, which grows exponentially along a chain of rules; it can't through
    what isn't deterministic.  Columns that nobody reads are still pruned, with
    all that is computed for them, which a generator of rows would keep.
    """
    return df.select(*(F.get(F.array(F.col(f"`{c}`")), F.rand(0).cast("int")).alias(c) for c in df.columns))


def without_elements(html: Column, tags=CHROME) -> Column:
    """Without elements of ``tags`` and what is in them, in one pass."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?is)<({'|'.join(tags)})[^>]*>.*?</\1>", " ")


def visible_text(html: Column, without=CHROME) -> Column:
    out = F.regexp_replace(without_elements(html, without), r"(?s)<!--.*?-->|<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, SPACE, " "))


def anchor_chars(html: Column) -> Column:
    """Characters of the texts of all links."""
    inner = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), 1)
    return F.aggregate(inner, F.lit(0), lambda n, t: n + F.length(F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), SPACE, " "))))


def link_density(html: Column, text_len: Column) -> Column:
    return F.when(text_len > 0, F.least(F.lit(1.0), anchor_chars(html) / text_len)).otherwise(0.0)


def marker_hits(text: Column, policy: Policy = DEFAULT) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*(F.lit(m) for m in policy.markers)), lambda m: low.contains(m))


def verdict(text_len: Column, density: Column, markers: Column, policy: Policy = DEFAULT) -> Column:
    """ok, paywall, link_hub, thin or weak; the first that holds.  A long text with many markers is weak."""
    hits, short = F.size(markers), text_len < policy.article_chars
    return (
        F.when(~short & (hits < policy.gate_markers), "ok")
        .when(short & (hits >= policy.gate_markers), "paywall")
        .when(short & (density > policy.link_density), "link_hub")
        .when(text_len < policy.weak_chars, "thin")
        .otherwise("weak")
    )


VERDICT_REASON = {"paywall": "paywall_markers", "link_hub": "high_link_density", "thin": "too_short", "weak": "weak_content"}


def reasons_of(verdict_: Column) -> Column:
    out = F
    for v, r in VERDICT_REASON.items():
        out = out.when(verdict_ == v, F.array(F.lit(r)))
    return out.otherwise(F.array().cast("array<string>"))


def _without(reasons: Column, *gone: str) -> Column:
    return F.filter(reasons, lambda r: ~r.isin(*gone))


def _add(reasons: Column, *more: str) -> Column:
    return F.concat(reasons, F.array(*(F.lit(m) for m in more)))


def score(text_len: Column, policy: Policy = DEFAULT) -> Column:
    return F.least(F.lit(1.0), text_len / max(1, policy.article_chars))


def with_features(rows: DataFrame, extracted: Column | None = None, has_definition: Column | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """Rows (url, content_type, text) with f_text, f_len, f_density, f_markers, f_verdict, f_score and f_reasons.

    ``extracted`` is the text of an HTML body.  Each step is a projection of
    its own: one that refers to a costly column more than once isn't inlined.
    """
    none = F.array().cast("array<string>")
    text, c = F.coalesce("text", F.lit("")), F.col
    low, h, p = F.lower(F.coalesce("content_type", F.lit(""))), host(c("url")), path(c("url"))
    df = rows.withColumns({"_html": low.contains("html"), "_pdf": low.contains("pdf"), "_plain": strip(text), "_host": h, "_path": p})
    df = df.withColumns({"_empty": c("_plain") == "", "f_text": F.when(c("_plain") == "", "").when(c("_html"), extracted if extracted is not None else visible_text(c("text"))).otherwise(c("_plain"))})
    df = df.withColumns({"f_len": F.length("f_text")}).withColumns({
        "f_density": F.when(c("_html"), link_density(c("text"), c("f_len"))).otherwise(0.0), "f_markers": F.when(c("_pdf") | (c("f_len") == 0), none).otherwise(marker_hits(c("f_text"), policy)), "f_score": score(c("f_len"), policy),
    })
    df = df.withColumn("_v0", F.when(c("_empty"), "thin").otherwise(verdict(c("f_len"), c("f_density"), c("f_markers"), policy)))
    df = df.withColumn("_r0", F.when(c("_empty"), F.array(F.lit("empty_body"))).otherwise(reasons_of(c("_v0"))))
    defined = (has_definition if has_definition is not None else F.lit(False)) & ~c("_empty") & c("_v0").isin("thin", "link_hub", "weak")
    df = df.withColumn("_on", defined).withColumns({"_v1": F.when(c("_on"), "ok").otherwise(c("_v0")), "_r1": F.when(c("_on"), _add(_without(c("_r0"), "too_short", "high_link_density", "weak_content"), "structured_definition")).otherwise(c("_r0"))})
    heavy = ~c("_empty") & c("_v1").isin("link_hub", "weak") & match_suffix(c("_host"), policy.link_heavy).isNotNull()
    df = df.withColumn("_on", heavy).withColumns({"_v2": F.when(c("_on"), "ok").otherwise(c("_v1")), "_r2": F.when(c("_on"), _add(_without(c("_r1"), "weak_content", "low_body_text"), "link_heavy_allow")).otherwise(c("_r1"))})
    df = df.withColumn("_on", ~c("_empty") & c("_host").endswith("capec.mitre.org") & c("_path").contains("/community/"))
    df = df.withColumn("_closed", c("_on") & F.lower("_path").rlike("registration|signup|sign-up|login"))
    df = df.withColumns({
        "f_verdict": F.when(c("_closed"), "paywall").otherwise(c("_v2")),
        "f_reasons": F.when(c("_closed"), _add(c("_r2"), "registration_required")).when(c("_on") & c("_v2").isin("link_hub", "thin", "weak"), _add(c("_r2"), "community_portal")).otherwise(c("_r2")),
    })
    return settled(df.drop("_html", "_pdf", "_plain", "_host", "_path", "_empty", "_v0", "_v1", "_v2", "_r0", "_r1", "_r2", "_on", "_closed"))


def with_gate(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Rows of with_features() with verdict, reasons, usable, junk_reason and keep_text; the rules in their order.

    Columns method, pdf_extracted, pdf_locked and pdf_unlocked count if they
    are there.
    """
    c = F.col
    yes = lambda name: F.coalesce(c(name), F.lit(False)) if name in rows.columns else F.lit(False)
    low, u = F.lower(F.coalesce("content_type", F.lit(""))), F.lower(F.coalesce("url", F.lit("")))
    told = F.lit(False)
    for t in policy.missing_file_tokens:
        told = told | c("_low").contains(t)
    df = rows.withColumns({"_is": low.contains("pdf") | yes("pdf_extracted"), "_at": u.endswith(".pdf"), "_low": F.lower("f_text"), "_locked": yes("pdf_locked") & ~yes("pdf_unlocked")})
    df = df.withColumns({
        "_soft": c("_is") & (c("f_len") < max(policy.weak_chars, policy.missing_file_chars)) & told, "_other": c("_at") & ~low.contains("pdf") & ~yes("pdf_extracted"), "_gone": c("_at") & F.coalesce(c("status").isin(404, 410), F.lit(False)) & ~yes("pdf_extracted"),
    })
    df = df.withColumn("_r", F.when(c("_soft"), _add(_without(c("f_reasons"), "too_short"), "pdf_soft_404")).otherwise(c("f_reasons")))
    df = df.withColumn("_r", F.when(c("_other"), _add(_without(c("_r"), "too_short"), "pdf_fetch_mismatch")).otherwise(c("_r")))
    df = df.withColumns({"_r": F.when(c("_gone"), _add(c("_r"), "pdf_status_error")).otherwise(c("_r")), "_v": F.when(c("_soft") | c("_other") | c("_gone"), "missing_file").otherwise(c("f_verdict"))})
    df = df.withColumn("_on", c("_is") & (c("f_len") >= policy.article_chars) & c("_v").isin("paywall", "weak"))
    df = df.withColumns({"_r": F.when(c("_on"), _add(_without(c("_r"), "too_short", "high_link_density", "weak_content", "paywall_markers"), "pdf_long_text_override")).otherwise(c("_r")), "_v": F.when(c("_on"), "ok").otherwise(c("_v"))})
    spoken = (F.coalesce("method", F.lit("")) == "youtube-skill") if "method" in rows.columns else F.lit(False)
    df = df.withColumn("_on", spoken & c("_v").isin("weak", "thin") & (c("f_len") > 0))
    df = df.withColumns({
        "verdict": F.when(c("_locked"), "password_protected").when(c("_on"), "ok").otherwise(c("_v")),
        "reasons": F.when(c("_locked"), F.array(F.lit("pdf_password_protected"))).when(c("_on"), _add(_without(c("_r"), "too_short", "weak_content"), "youtube_transcript_preserve")).otherwise(c("_r")),
    }).withColumns({"usable": (F.coalesce("status", F.lit(-1)) == 200) & (c("verdict") == "ok"), "keep_text": c("verdict").isin("ok", "paywall")})
    http = F.coalesce("status", F.lit(-1))
    df = df.withColumn("junk_reason", F.when(c("usable"), None).when(http != 200, F.concat(F.lit("http_status_"), http.cast("string"))).otherwise(F.concat(F.lit("content_verdict_"), c("verdict"))))
    return settled(df.drop("_is", "_at", "_low", "_locked", "_soft", "_other", "_gone", "_r", "_v", "_on"))


def body_stats(html: Column) -> Column:
    """struct(body_len, paragraphs, headings) by the profile; paragraphs are closed ``p`` elements."""
    bare = without_elements(html)
    return F.struct(F.length(visible_text(html)).alias("body_len"), F.regexp_count(bare, F.lit(r"(?i)<p\b")).alias("paragraphs"), F.regexp_count(bare, F.lit(r"(?i)<h[1-6]\b")).alias("headings"))


def body_prefilter(text: Column, content_type: Column, policy: Policy = DEFAULT, min_chars: Column | None = None, min_paragraphs: Column | None = None) -> Column:
    """struct(keep, reason, section_pref_fallback); thresholds may come from a dimension table."""
    chars = min_chars if min_chars is not None else F.lit(policy.child_chars)
    paras = min_paragraphs if min_paragraphs is not None else F.lit(policy.child_paragraphs)
    html = F.lower(F.coalesce(content_type, F.lit(""))).startswith("text/html")
    s, plain = body_stats(text), strip(F.coalesce(text, F.lit("")))
    n_plain = F.size(F.filter(F.split(plain, "\n\n"), lambda p: strip(p) != ""))
    n = F.when(html, s["body_len"]).otherwise(F.length(plain))
    p = F.when(html, s["paragraphs"]).otherwise(n_plain)
    reason = F.when(n < chars, "low_body_text").when(p < paras, "few_paragraphs")
    section = F.when(html, F.when(s["headings"] == 0, "sections_missing").when((n < 300) | (p < 2), "sections_too_small")).when(reason == "low_body_text", "sections_missing").when(reason == "few_paragraphs", "sections_too_small")
    return F.struct(reason.isNull().alias("keep"), reason.alias("reason"), section.alias("section_pref_fallback"))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{3,})"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeated elements; take them from columns, so that what makes them is written out once."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 0.0).otherwise(F.round(both / either, 4))


def headings(html: Column, level: int, most: int) -> Column:
    inner = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>"), 1)
    clean = F.transform(inner, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), SPACE, " ")))
    return F.slice(F.filter(clean, lambda t: t != ""), 1, most)


def markdown_headings(md: Column, level: int, most: int) -> Column:
    lines = F.filter(F.split(F.coalesce(md, F.lit("")), "\n"), lambda x: x.startswith("#" * level + " "))
    return F.slice(F.transform(lines, lambda x: F.trim(F.substring(x, level + 2, 1 << 20))), 1, most)


def prune_to_first_heading(md: Column) -> Column:
    cut = F.regexp_extract(F.coalesce(md, F.lit("")), r"(?s)(?:^|\n)(# .*)", 1)
    return strip(F.when(cut != "", cut).otherwise(F.coalesce(md, F.lit(""))))


def minimal_fix(text: Column) -> Column:
    """fix_text() without zero-width signs; control signs of the upper range become blanks; empty for null."""
    plain = F.regexp_replace(F.regexp_replace(fix_text(F.coalesce(text, F.lit(""))), "[\\u200B\\u200C\\u200D\\u2060\\uFEFF\\x00\\x0B\\x0C]", ""), "[\\u0080-\\u009F]", " ")
    return plain


#: What single bytes 80 to 9F stand for where texts were read by the wrong code page; bytes that it lacks stay.
_PAGE = {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0x100)}
_CONT = "[" + "".join(map(re.escape, (c for c, b in _PAGE.items() if b < 0xC0))) + "\x80-\x9f]"
_MOJIBAKE = re.compile(f"[\xc2-\xdf]{_CONT}|[\xe0-\xef]{_CONT}{{2}}|[\xf0-\xf4]{_CONT}{{3}}")
_SIGNS = str.maketrans({**dict.fromkeys("\u2018\u2019\u201a\u201b", "'"), **dict.fromkeys("\u201c\u201d\u201e\u201f", '"'), **dict(zip("\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06", ("ff", "fi", "fl", "ffi", "ffl", "st", "st"))), **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}, "\u3000": " "})
_CONTROL = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f]|\x1b\\[[0-9;]*m")


def _again(m: re.Match) -> str:
    raw = bytes(_PAGE.get(c, ord(c)) for c in m[0])
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def fixed(s: str) -> str:
    """Texts read as code page 1252 though they were UTF-8, up to three times over, curly quotes, ligatures, full-width signs, line ends and control signs put right; composed."""
    if s.isascii() and not _CONTROL.search(s) and "\r" not in s:
        return s
    for _ in range(3):
        if (t := _MOJIBAKE.sub(_again, s)) == s:
            break
        s = t
    s = _CONTROL.sub("", s.replace("\r\n", "\n").replace("\r", "\n")).translate(_SIGNS)
    return unicodedata.normalize("NFC", s)


def fix_text(text: Column) -> Column:
    """fixed(), in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda s: s if s is None else fixed(s))

    return run(text)


_CHARSET = re.compile(r"charset=([^\s;]+)", re.I)


def decoded(body: bytes, content_type: str | None) -> str:
    """Bytes by the charset named, else by their mark or as UTF-8, else as code page 1252."""
    if m := _CHARSET.search(content_type or ""):
        try:
            return body.decode(m[1].strip(" \"'").lower(), "replace")
        except LookupError:
            pass
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("cp1252", "replace")


def decode_bytes(body: Column, content_type: Column) -> Column:
    """decoded(), in Arrow batches; null for null."""

    @F.pandas_udf(T.StringType())
    def run(b: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decoded(bytes(x), k) for x, k in zip(b, kind)], dtype=object)

    return run(body, content_type)


def needs_browser(url: Column, text: Column, content_type: Column, verify_html: bool = True, policy: Policy = DEFAULT) -> Column:
    """Whether a page of HTML seems to be made by scripts: a host with a sign-in box, a short page, none with a body or with enough text in it, or one that says so."""
    if not verify_html:
        return F.lit(False)
    body = F.coalesce(text, F.lit(""))
    low = F.lower(body)
    inner = F.regexp_extract(body, r"(?is)<body\b[^>]*>(.*?)(?:</body>|\z)", 1)
    told = F.lit(False)
    for hint in policy.script_hints:
        told = told | low.contains(hint)
    html = F.lower(F.coalesce(content_type, F.lit(""))).contains("html")
    thin = (F.length(body) < policy.least_page) | ~low.rlike("<body[\\s>]") | (F.length(visible_text(inner, ("script", "style", "noscript"))) < policy.least_rendered) | (F.length(visible_text(body)) < policy.least_rendered)
    return html & (host(url).isin(*sorted(policy.sign_in)) | thin | told)


def normalize_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "")


def redact_value(value: Column) -> Column:
    n = F.length(value)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 4), F.lit("..."), F.right(value, F.lit(4))))


def content_hash(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.sha2(text, 256)).otherwise("")


SECRET_NAMES = r"(?i)token|secret|password|passwd|api_?key|authorization|cookie|credential"


def redact_named(name: Column, value: Column) -> Column:
    """redact_value() where the name is that of a secret, else the value."""
    return F.when(name.rlike(SECRET_NAMES), redact_value(value)).otherwise(value)


def nfc(text: Column) -> Column:
    """Canonical composition; Arrow batches, as there is no built-in."""
    @F.pandas_udf(T.StringType())
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))

    return run(text)


def merge_maps(left: Column, right: Column) -> Column:
    """One map of two; where both have a key, the right one wins."""
    old = F.map_filter(left, lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.coalesce(F.map_concat(old, right), left, right)

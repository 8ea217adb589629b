"""URLs as Column functions.  A URL is taken apart with one regular expression (RFC 3986, appendix B)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..policy import DEFAULT, Policy

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
BLANK = r"[ \t\n\r\f\x0B]+"


def strip(c: Column) -> Column:
    """Without white space at its ends, not blanks alone."""
    return F.regexp_replace(c, rf"^{BLANK}|{BLANK}$", "")


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def host(url: Column) -> Column:
    """Lower-cased host without user, port or brackets; empty if there is none."""
    last = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(F.when(last.startswith("["), F.regexp_extract(last, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(last, r"^([^:]*)", 1)))


def tail(url: Column) -> Column:
    """Query and fragment with their signs, where they aren't empty."""
    q, f = part(url, 4), part(url, 5)
    return F.concat(F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""), F.when(f != "", F.concat(F.lit("#"), f)).otherwise(""))


def join_parts(scheme_: Column, authority_: Column, path_: Column, tail_: Column) -> Column:
    return F.concat(F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(""), F.when(authority_ != "", F.concat(F.lit("//"), authority_)).otherwise(""), path_, tail_)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no user, no port, no white space in the path; a URL whose port is no number stays as it is."""
    u = strip(F.coalesce(url, F.lit("")))
    bad_port = F.regexp_extract(F.regexp_replace(authority(u), r"^.*@", ""), r":([^:\]]*)$", 1).rlike("[^0-9]")
    h = host(u)
    return F.when(bad_port, u).otherwise(join_parts(scheme(u), F.when(h != "", h).otherwise(authority(u)), F.regexp_replace(path(u), BLANK, ""), tail(u)))


def toggle_trailing_slash(url: Column) -> Column:
    p = path(url)
    other = F.when((p.endswith("/")) & (F.length(p) > 1), F.regexp_replace(p, "/+$", "")).when(p.endswith("/") | (p == ""), p).otherwise(F.concat(p, F.lit("/")))
    return F.when((p == "") | (p == other), url).otherwise(join_parts(scheme(url), authority(url), other, tail(url)))


def validate_url(url: Column) -> Column:
    """The first reason against a URL, or null."""
    u = strip(F.coalesce(url, F.lit("")))
    s = scheme(u)
    return (
        F.when(u == "", "missing_url")
        .when(~s.isin("http", "https", "file"), "unsupported_scheme")
        .when((s != "file") & (authority(u) == ""), "missing_host")
        .when((s == "file") & (path(u) == ""), "missing_path")
    )


def normalize_domain(domain: Column, policy: Policy = DEFAULT) -> Column:
    """Lower case, no dot at the end, without a leading label such as ``www`` if two more are left."""
    d = F.lower(F.regexp_replace(strip(F.coalesce(domain, F.lit(""))), r"\.+$", ""))
    labels = F.split(d, r"\.")
    return F.when((F.size(labels) > 2) & F.get(labels, F.lit(0)).isin(*policy.strip_labels), F.regexp_replace(d, r"^[^.]*\.", "")).otherwise(d)


def match_suffix(host_: Column, allowed) -> Column:
    """The longest of ``allowed`` that is the host or a parent of it, or null."""
    h = F.regexp_replace(F.lower(strip(host_)), r"\.+$", "")
    tokens = sorted({t.strip().lower().lstrip(".") for t in allowed} - {""}, key=lambda t: (-len(t), t))
    return F.coalesce(*(F.when((h == t) | h.endswith(f".{t}"), F.lit(t)) for t in tokens), F.lit(None).cast("string"))


def is_safe_domain(domain: Column, policy: Policy = DEFAULT) -> Column:
    d = normalize_domain(domain, policy)
    ends = F.lit(False)
    for s in policy.trusted_suffixes:
        ends = ends | d.endswith(s)
    return (d != "") & (d.isin(*sorted(policy.trusted)) | ends)


def search_query(url: Column) -> Column:
    """Words of the last part of the path and the host without ``www.``; the URL itself if there is nothing."""
    last = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), r"([^/]*)$", 1)
    words = F.concat_ws(" ", F.regexp_extract_all(F.replace(F.replace(last, F.lit(".html"), F.lit("")), F.lit(".pdf"), F.lit("")), F.lit("([A-Za-z]+)"), 1))
    site = F.replace(authority(url), F.lit("www."), F.lit(""))
    query = F.trim(F.concat_ws(" ", F.when(words != "", words), F.when(site != "", site)))
    return F.when(query != "", query).otherwise(url)


def video_id(url: Column) -> Column:
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"[?&]v=([A-Za-z0-9_\-]{11})", r"youtu\.be/([A-Za-z0-9_\-]{11})", r"embed/([A-Za-z0-9_\-]{11})")]
    return F.coalesce(*found)


def code_host_request(url: Column) -> Column:
    """struct(owner, repo, ref, path, fetch_url) of a file on the code host, or null."""
    a, p = F.lower(authority(url)), F.regexp_replace(path(url), "^/+|/+$", "")
    raw = r"^([^/]*)/([^/]*)/([^/]*)/(.+)$"
    blob = r"^([^/]*)/([^/]*)/(?:blob|raw)/([^/]*)/(.+)$"
    g = lambda rx, k: F.regexp_extract(p, rx, k)
    made = lambda rx, to: F.struct(g(rx, 1).alias("owner"), g(rx, 2).alias("repo"), g(rx, 3).alias("ref"), g(rx, 4).alias("path"), to.alias("fetch_url"))
    rewritten = F.concat(F.lit("https://raw.githubusercontent.com/"), F.concat_ws("/", *(g(blob, k) for k in (1, 2, 3, 4))))
    return F.when((a == "raw.githubusercontent.com") & p.rlike(raw), made(raw, url)).when(a.isin("github.com", "www.github.com") & p.rlike(blob), made(blob, rewritten))


_RELIABLE = {f"{kind}/{x}": f".{x}" for kind, names in (("application", "pdf zip"), ("image", "gif png webp")) for x in names.split()} | {"application/gzip": ".gz", "image/jpeg": ".jpg"}
_GUESS = {"text/html": ".html", "text/plain": ".txt", "application/json": ".json", "text/csv": ".csv", "text/markdown": ".md", "application/xml": ".xml", "text/css": ".css"}


def blob_extension(url: Column, content_type: Column) -> Column:
    """From a content type that is reliable, the path's suffix, other content types, or ``.bin``."""
    out = F
    for kind, ext in _RELIABLE.items():
        out = out.when(content_type == kind, ext)
    suffix = F.regexp_extract(path(url), r"[^/.][^/]*?(\.[^/.]+)/*$", 1)
    good = (suffix != "") & (F.length(suffix) <= 10) & ~suffix.rlike(r"^\.[0-9]+$")
    out = out.when(good, suffix)
    for kind, ext in _GUESS.items():
        out = out.when(content_type == kind, ext)
    return out.otherwise(".bin")


def static_redirect(url: Column) -> Column:
    return F.when(url.contains("d3f:"), F.replace(url, F.lit("CredentialRevoking"), F.lit("CredentialRevocation"))).otherwise(url)


def looks_gated_url(url: Column, tokens=("login", "paywall", "signin", "sign-in", "subscribe", "subscription")) -> Column:
    low = F.lower(url)
    out = F.lit(False)
    for t in tokens:
        out = out | low.contains(t)
    return out


def idna_host(host_: Column) -> Column:
    """Lower-cased host in its ASCII form; ASCII hosts never leave the JVM."""
    @F.pandas_udf(T.StringType())
    def encode(h: pd.Series) -> pd.Series:
        def one(s):
            try:
                return s.encode("idna").decode("ascii") if s else s
            except UnicodeError:
                return s

        return h.map(one)

    low = F.lower(F.regexp_replace(strip(F.coalesce(host_, F.lit(""))), r"\.+$", ""))
    foreign = low.rlike(r"[^\x00-\x7f]")
    # a Python function runs for every row whatever branch it is in, so it gets nulls where it isn't needed
    return F.when(foreign, encode(F.when(foreign, low))).otherwise(low)


def final_url(url: Column, *candidates: Column) -> Column:
    """The first of ``candidates`` that isn't empty, in their order of precedence, else the URL."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates), url)


def alternate_provider(via: Column, source: Column, note: Column) -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.when(low(via).isin("wayback", "jina"), low(via)).when(low(source).isin("brave_search", "brave") | (note == "brave_redirect"), "brave")


def domain_set(*frames) -> object:
    """The distinct normalised domains of frames with a column ``domain``, empty ones apart."""
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b), (f.select("domain") for f in frames))
    return every.select(normalize_domain(F.col("domain")).alias("domain")).where("domain <> ''").distinct()

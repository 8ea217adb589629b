"""How a fetch went, decided from its row: soft 404s, blocks, fallbacks, proxies, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import DEFAULT, Policy
from .urls import match_suffix, strip


def any_of(text: Column, tokens) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | text.contains(t)
    return out


def all_of(text: Column, tokens) -> Column:
    out = F.lit(True)
    for t in tokens:
        out = out & text.contains(t)
    return out


def soft_404(text: Column, policy: Policy = DEFAULT) -> Column:
    """The template of a page that says it isn't there, or null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F
    for name, tokens in policy.soft_404:
        out = out.when(all_of(low, tokens), name)
    return out.when(any_of(low, policy.soft_404[0][1]), policy.soft_404[0][0]).when(low.contains("page not found") & low.contains("requested url"), "generic_not_found")


def cloudflare_block(text: Column) -> Column:
    return any_of(F.lower(F.coalesce(text, F.lit(""))), ("cf-error-details", "error 1020", "cloudflare"))


def bot_blocked(text: Column, policy: Policy = DEFAULT) -> Column:
    return any_of(F.lower(F.coalesce(text, F.lit(""))), policy.bot_tokens)


def fallback_reason(status: Column, text: Column, policy: Policy = DEFAULT) -> Column:
    """Why another way of fetching should be tried, or null; the first that holds."""
    return (
        F.when(soft_404(text, policy).isNotNull(), "soft_404")
        .when(status == 429, "rate_limited_429")
        .when(cloudflare_block(text), "cloudflare_block_page")
        .when(bot_blocked(text, policy), "bot_blocked")
        .when((status == 200) & (F.length(strip(F.coalesce(text, F.lit("")))) < 100), "empty_payload")
        .when(status.isin(401, 403, 404, 500, 503), "http_error_retry_exhausted")
    )


def archive_needed(status: Column, text: Column, policy: Policy = DEFAULT) -> Column:
    blocked = bot_blocked(text, policy)
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    return ((status == 200) & blocked) | (status.isin(401, 403, 404) & (empty | blocked))


def proxy_trigger(domain: Column, status: Column, text: Column, policy: Policy = DEFAULT) -> Column:
    """``status_N`` or ``hint_x`` where a proxy is allowed and called for, or null."""
    allowed = F.lit(True) if not policy.proxy_domains or "*" in policy.proxy_domains else match_suffix(domain, policy.proxy_domains).isNotNull()
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(~allowed, None).when(status.isin(*policy.proxy_statuses), F.concat(F.lit("status_"), status.cast("string")))
    for h in policy.proxy_hints:
        out = out.when(low.contains(h), f"hint_{h}")
    return out


def credit_exhaustion(status: Column, text: Column, error: Column, policy: Policy = DEFAULT) -> Column:
    """The keyword in the text, else in the error, else ``status_N``, or null."""
    hit = lambda c: F.coalesce(*(F.when(F.lower(F.coalesce(c, F.lit(""))).contains(k), F.lit(k)) for k in policy.credit_keywords))
    return F.coalesce(hit(text), hit(error), F.when(status.isin(*policy.credit_statuses), F.concat(F.lit("status_"), status.cast("string"))))


def fetch_path(method: Column, from_cache: Column, proxy_used: Column, browser: Column, browser_failed: Column, via: Column, note: Column, translate_url: Column) -> Column:
    """The ways that led to a body, in order and each once."""
    low = F.lower(F.coalesce(via, F.lit("")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    m = F.coalesce(method, F.lit(""))
    steps = F.array(
        F.lit("aiohttp"),
        F.when(yes(proxy_used), "proxy_rotation"),
        F.when(yes(browser) & ~yes(browser_failed), "playwright"),
        F.when((low == "wayback") | (m == "wayback"), "wayback"),
        F.when((low == "jina") | (m == "jina"), "jina"),
        F.when(note == "brave_redirect", "brave"),
        F.when((F.coalesce(translate_url, F.lit("")) != "") | (m == "google_translate"), "google_translate"),
    )
    return F.when(yes(from_cache), F.array(F.lit("cache"))).when(m.isin("file", "github_cli"), F.array(m)).otherwise(F.array_distinct(F.array_compact(steps)))


def rate_limit_fields(status: Column, fetched_at: Column) -> Column:
    hit = status == 429
    return F.struct(hit.alias("rate_limited"), F.when(hit, status).alias("rate_limit_status"), F.when(hit, fetched_at).alias("rate_limit_timestamp"))


def archive_timestamp(rows: Column) -> Column:
    """The first stamp after the header row of an array of rows, or null."""
    stamps = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.trim(F.get(r, F.lit(0))))
    return F.get(F.filter(stamps, lambda s: F.coalesce(s, F.lit("")) != ""), F.lit(0))

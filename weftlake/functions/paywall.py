"""Paywall scores from text, markup, status and host, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import DEFAULT, Policy
from .content import settled, visible_text
from .urls import authority, is_safe_domain, strip

OVERLAY = r"(?i)(?:class|id)\s*=\s*[\"'][^\"']*\b(paywall|overlay|modal|signin|gate|wall)\b"
META = r"(?i)<meta\b[^>]*\b(metered|paywall|subscription|access-?control|member(ship)?)\b"


def hits(patterns, text: Column) -> Column:
    """The patterns that occur, sorted."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(p)) for p in sorted(patterns))))


def with_detection(rows: DataFrame, html_col: str = "text", policy: Policy = DEFAULT) -> DataFrame:
    """Rows (url, status, ...) with pw_score, pw_verdict, pw_indicators, pw_page_len and pw_article_len.

    Safe hosts are unlikely at once, and 401, 403 and 451 end the scoring with
    the weight of the host and their own.  The article is what is in paragraphs.
    """
    w, caps, c = policy.weights, policy.caps, F.col
    body = F.coalesce(c(html_col), F.lit(""))
    hidden = F.array_join(F.regexp_extract_all(body, F.lit(r"(?is)<noscript[^>]*>(.*?)</noscript>"), 1), " ")
    paragraphs = F.array_join(F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), " ")
    df = rows.withColumns({"_seen": visible_text(body, ("script", "style", "noscript")), "_hidden": hidden, "_paras": paragraphs, "_site": F.lower(authority(F.coalesce("url", F.lit(""))))})
    safe = c("_site").isin(*sorted(policy.trusted))
    for s in policy.trusted_suffixes:
        safe = safe | c("_site").endswith(s)
    gated = c("_site").isin(*sorted(policy.gated)) | F.regexp_replace("_site", r"^www\.", "").isin(*sorted(policy.gated))
    on = lambda cond, k: F.when(F.coalesce(cond, F.lit(False)), F.lit(w[k])).otherwise(0.0)
    many = lambda patterns, text, k: F.least(F.size(hits(patterns, text)) * F.lit(w[k]), F.lit(caps[k]))
    df = df.withColumns({"pw_page_len": F.length("_seen"), "pw_article_len": F.length(visible_text(c("_paras"))), "_safe": safe, "_host": on(gated, "host"), "_barred": F.coalesce(c("status").isin(401, 403, 451), F.lit(False))})
    n, article, status = c("pw_page_len"), c("pw_article_len"), c("status")
    legal = (F.size(hits(policy.legal, c("_seen"))) > 0) & c("_seen").rlike(r"(?i)\bsubscribe\b")
    terms = {
        "payment_required": on(status == 402, "payment"), "rate_limited": on(status == 429, "limited"), "readability_gap": on((n >= 1000) & (article < 400) & (article <= n * 0.2), "gap"), "short_body_stub": on(n < 400, "stub"),
        "paywall_phrases": many(policy.strong, c("_seen"), "strong"), "paywall_phrases_weak": many(policy.soft, c("_seen"), "soft"), "vendor_markers": many(policy.vendors, body, "vendor"), "overlay_dom": on(body.rlike(OVERLAY), "overlay"),
        "legalese_plus_subscribe": on(legal, "legal"), "noscript_paywall": on(F.size(hits(policy.strong, c("_hidden"))) > 0, "noscript"), "meta_paywall": on(body.rlike(META), "meta"),
    }
    df = df.withColumns({f"_t_{k}": v for k, v in terms.items()})
    rest = sum((c(f"_t_{k}") for k in list(terms)[1:]), c(f"_t_{next(iter(terms))}"))
    df = df.withColumn("pw_score", F.round(F.when(c("_safe"), 0.0).when(c("_barred"), c("_host") + w["unauthorized"]).otherwise(c("_host") + rest), 6))
    names = F.array_compact(F.array(F.when(c("_host") > 0, "paywall_domain"), F.when(c("_barred"), "unauthorized_status"), *(F.when(~c("_barred") & (c(f"_t_{k}") > 0), F.lit(k)) for k in terms)))
    df = df.withColumns({
        "pw_indicators": F.when(c("_safe"), F.array(F.lit("safe_domain"))).otherwise(names),
        "pw_verdict": F.when(c("_safe"), "unlikely").when(c("pw_score") >= policy.likely, "likely").when(c("pw_score") >= policy.maybe, "maybe").otherwise("unlikely"),
    })
    return settled(df.drop("_seen", "_hidden", "_paras", "_site", "_safe", "_host", "_barred", *(f"_t_{k}" for k in terms)))


def with_annotation(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Rows (domain, url, status, content_type, text) with paywall_verdict and paywall_score: safe hosts, suspicion without a body, detection for HTML, else nulls."""
    c = F.col
    empty = F.coalesce("text", F.lit("")) == ""
    suspected = F.coalesce(c("domain").isin(*sorted(policy.gated)), F.lit(False)) | F.coalesce(c("status").isin(*policy.gated_statuses), F.lit(False))
    html = F.lower(F.coalesce("content_type", F.lit(""))).contains("html")
    df = with_detection(rows, "text", policy).withColumns({"_safe": is_safe_domain(c("domain"), policy), "_doubt": empty & suspected, "_read": ~empty & html})
    df = df.withColumns({
        "paywall_verdict": F.when(c("_safe"), "safe").when(c("_doubt"), "maybe").when(c("_read"), c("pw_verdict")), "paywall_score": F.when(c("_safe"), 0.0).when(c("_doubt"), 0.6).when(c("_read"), c("pw_score")),
    })
    return df.drop("_safe", "_doubt", "_read", "pw_score", "pw_verdict", "pw_indicators", "pw_page_len", "pw_article_len")


def may_resolve(verdict: Column) -> Column:
    return F.coalesce(verdict.isin("maybe", "likely"), F.lit(True))


def hinted(text: Column, policy: Policy = DEFAULT, more=("proprietary",)) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for h in (*policy.hints, *more):
        out = out | low.contains(h)
    return out


def resolver_eligible(domain: Column, status: Column, text: Column, reason: Column, content_verdict: Column, paywall_verdict: Column, policy: Policy = DEFAULT) -> Column:
    hard = F.coalesce(status.isin(401, 403, 429, 451, 503), F.lit(False)) | F.coalesce(reason.isin("bot_blocked", "cloudflare_block_page"), F.lit(False))
    empty = F.coalesce((status == 200) & domain.isin(*sorted(policy.gated)), F.lit(False)) & (strip(F.coalesce(text, F.lit(""))) == "")
    missing = F.coalesce(content_verdict == "missing_file", F.lit(False))
    return (missing | hard | empty) & may_resolve(paywall_verdict)


def outstanding(domain: Column, status: Column, paywall_verdict: Column, safe: Column, content_verdict: Column, title: Column, excerpt: Column, policy: Policy = DEFAULT) -> Column:
    """struct(category, note) of a URL that wasn't fetched; the first rule that holds."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    http = F.concat(F.lit("HTTP status "), status.cast("string"))
    e, cv, pv = low(excerpt), low(content_verdict), low(paywall_verdict)
    bot = low(title).contains("just a moment")
    for t in ("cf-challenge", "cf-error-details", "cloudflare", "just a moment"):
        bot = bot | e.contains(t)
    told = F.concat(F.lit("content_verdict="), cv)
    rules = [
        (status.isin(404, 410, 0, -1), "broken_or_moved", http), (status.isin(500, 502, 503), "retry", http), ((status == 403) & bot, "bot_blocked", F.lit("Automated access blocked by anti-bot interstitial")),
        (status.isin(401, 403) & domain.isin(*sorted(policy.sign_in | policy.scripted)), "needs_login_or_playwright", F.lit("Requires login or JS rendering")),
        (pv.isin("likely", "maybe"), "paywall", F.concat(F.lit("Paywall verdict "), pv)), (cv == "missing_file", "broken_or_moved", told), (cv == "paywall", "paywall", told),
        (cv == "thin", "content_thin", told), (cv == "link_hub", "content_link_hub", told), (cv == "weak", "content_weak", told), (cv == "password_protected", "password_protected", told),
        (safe, "needs_whitelist", F.lit("Domain matches safe-domain policy")), (status.isin(*policy.gated_statuses), "retry", http),
    ]
    out = F
    for cond, name, note in rules:
        out = out.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("category"), note.alias("note")))
    return out.otherwise(F.struct(F.lit("retry").alias("category"), F.lit("Fetch failed for unknown reasons").alias("note")))

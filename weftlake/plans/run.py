"""Whole runs: inventory and fetched pages in, annotated results and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content, paywall, provenance, urls
from ..functions.urls import host, is_safe_domain, validate_url
from ..operators import changes, dom, entries, reports, store
from ..policy import DEFAULT, Policy


@dataclass(frozen=True)
class Run:
    results: DataFrame
    outstanding: DataFrame
    changes: DataFrame
    audit: DataFrame
    metrics: DataFrame
    #: New links of hubs, kept or dropped with a reason: what is to be fetched next.
    children: DataFrame | None = None
    #: Texts and bodies by hash, where results have pointers instead.
    texts: DataFrame | None = None
    bodies: DataFrame | None = None


def annotate(pages: DataFrame, policy: Policy = DEFAULT, with_dom: bool = False) -> DataFrame:
    """Fetched rows (url, status, content_type, text, method, seq, ...) with every decision of the data plane as columns.

    ``with_dom`` looks for definitions, which rescue a page, and notices of
    deprecation in a tree; only pages that speak of either are parsed.
    """
    c = F.col
    domain = F.coalesce("domain", host(c("url"))) if "domain" in pages.columns else host(c("url"))
    rows = pages.withColumns({"domain": domain, "soft_404_template": provenance.soft_404(c("text"), policy), "fallback_reason": provenance.fallback_reason(c("status"), c("text"), policy)})
    defined = None
    if with_dom:
        said = F.lower(F.coalesce("content_type", F.lit(""))).contains("html") & F.lower(F.coalesce("text", F.lit(""))).rlike("definition|glossary|deprecat")
        found = dom.features(F.when(said, c("text")), c("url"), policy, fields=("definition", "deprecation"))
        rows = rows.withColumn("__dom", found).withColumns({"definition": c("__dom.definition"), "deprecation_notice": c("__dom.deprecation")}).drop("__dom")
        defined = c("definition").isNotNull()
    rows = content.with_gate(content.with_features(rows, has_definition=defined, policy=policy), policy)
    rows = rows.withColumn("text", F.when(c("verdict") == "ok", c("f_text")).when(c("keep_text"), c("text")).otherwise(""))
    rows = paywall.with_annotation(rows, policy)
    return rows.withColumn("score", c("f_score")).drop("f_text", "f_len", "f_density", "f_markers", "f_verdict", "f_score", "f_reasons", "keep_text")


def with_cache(inventory: DataFrame, pages: DataFrame, cache: DataFrame, bypass=None) -> DataFrame:
    """Pages, and for entries without one the snapshot in ``cache`` (key, and columns of pages), as from_cache."""
    have = pages if "from_cache" in pages.columns else pages.withColumn("from_cache", F.lit(False))
    shared = [c for c in pages.columns if c in cache.columns and c not in ("url", "seq", "from_cache")]
    fetched = pages.select(urls.normalize_url(F.col("url")).alias("__have")).distinct()
    open_ = inventory.select("url", "seq").withColumn("__norm", urls.normalize_url(F.col("url"))).join(fetched, F.col("__norm") == F.col("__have"), "left_anti").drop("__norm")
    hits = store.cache_lookup(open_, cache.select("key", F.struct(*shared).alias("value")), bypass).where("from_cache")
    return have.unionByName(hits.select("url", "seq", *(F.col(f"cached.{c}").alias(c) for c in shared), F.lit(True).alias("from_cache")), allowMissingColumns=True)


def run_pipeline(
    inventory: DataFrame,
    pages: DataFrame,
    state: DataFrame | None = None,
    policy: Policy = DEFAULT,
    cache: DataFrame | None = None,
    with_dom: bool = False,
    prefixes: dict[str, tuple[str, ...]] | None = None,
    domains: tuple[str, ...] = (),
    download_mode: str = "text",
    externalize: bool = False,
) -> Run:
    """The whole chain: merged entries, snapshots for what wasn't fetched, decisions, links of hubs, changes, reports, storage.

    Links of hubs are followed if there are ``prefixes`` or ``domains``.
    Reports share the annotated rows; persist ``results`` where several are
    read.
    """
    unique = entries.dedupe_merge(inventory)
    rows = with_cache(unique, pages, cache) if cache is not None else pages
    results = annotate(rows, policy, with_dom)
    pending = entries.outstanding_entries(unique, results)
    flags = results.withColumns({c: F.lit(False) for c in ("proxy_attempted", "proxy_used", "from_cache") if c not in results.columns})
    changed = changes.detect_changes(results, state)
    children = None
    if prefixes or domains:
        html = F.lower(F.coalesce("content_type", F.lit(""))).contains("html") & (F.col("status") == 200)
        hubs = rows.where(html).select("url", "seq", dom.features(F.col("text"), F.col("url"), policy, fields=("hub",)).alias("x")).where("x.hub.is_hub")
        children = entries.fan_out(hubs.select("url", "seq", F.col("x.hub.links").alias("links")), rows.select("url"), prefixes or {}, domains)
    mode = check_download_mode(download_mode, policy.window_size, policy.window_step)
    out, texts, bodies = store.download(results, mode, policy), None, store.blob_bytes(results) if mode != "text" else None
    if externalize:
        out, texts = store.externalize(out, policy)
    return Run(out, pending, changed, reports.audit_counts(flags, unique), reports.run_metrics(flags), children, texts, bodies)


def batch_check(inventory: DataFrame, pages: DataFrame, policy: Policy = DEFAULT, **alternates) -> dict:
    """A small batch with its alternates (see resolve.resolve()): counts, and ``exit_code`` 0 if nothing is outstanding, else 3."""
    from .resolve import resolve

    run = run_pipeline(inventory, pages, policy=policy)
    unique = entries.dedupe_merge(inventory)
    done = resolve(unique, run.results, **({"fetched": run.results} | alternates), policy=policy)
    moved = unique.drop("url").join(done.inventory.select("seq", "url"), "seq")
    pending = entries.outstanding_entries(moved, done.results)
    counts = reports.run_metrics(done.results.withColumns({c: F.lit(False) for c in ("proxy_attempted", "proxy_used") if c not in done.results.columns})).first()
    left = pending.count()
    return {"success": counts["success"], "failed": counts["failed"], "applied_alternates": done.applied.count(), "outstanding_controls": entries.outstanding_controls(pending).count(), "outstanding_urls": left, "exit_code": 3 if left else 0}


def fetch_one(pages: DataFrame, url: str, policy: Policy = DEFAULT) -> DataFrame:
    """The chain for one URL, without fan-out, state or reports."""
    return annotate(pages.where(F.col("url") == url), policy)


def dry_run(inventory: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Counts of an inventory in one pass: all, valid, invalid, safe and those a resolver would look at."""
    bad = validate_url(F.col("url")).isNotNull()
    safe = ~bad & is_safe_domain(host(F.col("url")), policy)
    gated = ~bad & ~safe & host(F.col("url")).isin(*sorted(policy.gated))
    return inventory.agg(F.count("*").alias("total"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"), F.count_if(safe).alias("safe"), F.count_if(gated).alias("resolver_candidates"))


def check_download_mode(mode: str, size: int, step: int) -> str:
    if mode not in ("text", "download_only", "rolling_extract"):
        return "text"
    if mode == "rolling_extract" and not 0 < step <= size:
        raise ValueError("a window's step must be above 0 and no more than its size")
    return mode


def parse_emit(text: str) -> tuple[str, ...]:
    allowed = ("download", "text", "md", "fit_md")
    chosen = tuple(dict.fromkeys(t.strip() for t in text.split(",") if t.strip()))
    if unknown := [t for t in chosen if t not in allowed]:
        raise ValueError(f"unknown outputs: {', '.join(unknown)}")
    return chosen or ("download", "text", "md")

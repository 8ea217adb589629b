"""Counts, rates and reports over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paywall import outstanding
from ..functions.urls import is_safe_domain
from ..policy import DEFAULT, Policy
from .entries import has_payload
from .ordering import running



def success(results: DataFrame) -> Column:
    """Status 200 and a text, inline or under a pointer; null where there is no status."""
    return (F.col("status") == 200) & has_payload(results)


def failure_summary(results: DataFrame) -> DataFrame:
    """(kind, value, n) of status, verdict and fallback reason in one pass: the rows are expanded by grouping sets after partial aggregation."""
    low = lambda c, d: F.lower(F.trim(F.coalesce(c, F.lit(d))))
    base = results.select(F.coalesce(F.col("status").cast("string"), F.lit("unknown")).alias("status"), low("verdict", "unknown").alias("verdict"), low("fallback_reason", "none").alias("reason"))
    sets = base.groupingSets([["status"], ["verdict"], ["reason"]], "status", "verdict", "reason").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "verdict").otherwise("reason")
    return sets.select(kind.alias("kind"), F.coalesce("status", "verdict", "reason").alias("value"), "n").orderBy("kind", "value")


def run_metrics(results: DataFrame) -> DataFrame:
    ok = success(results)
    return results.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"),
        F.count_if("proxy_attempted").alias("proxy_attempted"), F.count_if("proxy_used").alias("proxy_used"),
    )


def fallback_counts(results: DataFrame) -> DataFrame:
    return results.select(F.explode("fetch_path").alias("step")).where("step <> 'aiohttp'").groupBy("step").agg(F.count("*").alias("n"))


def audit_counts(results: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Fetched and failed don't add up to all: a 200 without text is neither."""
    out = results.agg(F.count_if(success(results)).alias("fetched"), F.count_if(F.col("status") != 200).alias("failed"), F.count_if("from_cache").alias("cache_hits"), F.count("*").alias("requested"))
    if requested is not None:
        out = out.drop("requested").crossJoin(requested.agg(F.count("*").alias("requested")))
    return out.select("requested", "fetched", "failed", "cache_hits")


def overall_rate(results: DataFrame, runtime_seconds: float) -> DataFrame:
    """(requests, effective_rps) of the whole run."""
    return results.agg(F.count("*").alias("requests"), F.round(F.count("*") / F.lit(max(runtime_seconds, 1e-6)), 3).alias("effective_rps"))


def verdict_counts(results: DataFrame) -> DataFrame:
    """(verdict, n) as metrics report them; rows without a verdict are ``unknown``."""
    return results.groupBy(F.coalesce("verdict", F.lit("unknown")).alias("verdict")).agg(F.count("*").alias("n")).orderBy("verdict")


def rate_limits(results: DataFrame, runtime_seconds: float) -> DataFrame:
    run = max(runtime_seconds, 1e-6)
    g = results.groupBy("domain").agg(F.count("*").alias("requests"), F.count_if(F.col("status") == 429).alias("rate_limited"))
    return g.withColumns({"rate_limited_pct": F.round(F.col("rate_limited") / F.col("requests"), 3), "rps": F.round(F.col("requests") / F.lit(run), 3)})


def batch_health(results: DataFrame, partition: str | None = None) -> DataFrame:
    """(seq, completed, failed, error_run): running counts and the length of the run of errors so far, in order of completion.

    With ``partition`` each partition has its own order, as batches or domains
    have; without, the order is global, and counts are carried from one bucket
    of rows to the next.
    """
    by = [partition] if partition else []
    bad = (F.col("status") != 200).cast("int")
    if partition:
        w = Window.partitionBy(partition).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        base = results.select(partition, "seq", bad.alias("bad"), F.count("*").over(w).alias("completed"), F.sum(bad).over(w).alias("failed"), F.sum(1 - bad).over(w).alias("island"))
    else:
        base = running(results.select("seq", bad.alias("bad")), "seq", completed=F.lit(1), failed=F.col("bad"), island=1 - F.col("bad"))
    inside = Window.partitionBy(*by, "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return base.select(*by, "seq", "completed", "failed", F.sum("bad").over(inside).alias("error_run"))


def outstanding_items(pending_urls: DataFrame, results: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Outstanding URLs (url, domain, status, control_count, worksheets) with verdicts of their results, category and notes."""
    have = lambda c, kind="string": F.col(c).cast(kind) if c in results.columns else F.lit(None).cast(kind)
    names = ("verdict", "paywall_verdict", "hub_title", "content_excerpt", "method", "suggestion")
    known = results.groupBy(F.col("url").alias("r_url")).agg(F.max_by(F.struct(*(have(c).alias(c) for c in names), have("paywall_score", "double").alias("paywall_score")), "seq").alias("r"))
    rows = pending_urls.join(known, F.col("url") == F.col("r_url"), "left")
    safe = is_safe_domain(F.col("domain"), policy)
    told = outstanding(F.col("domain"), F.coalesce(F.col("status").cast("int"), F.lit(-1)), F.col("r.paywall_verdict"), safe, F.col("r.verdict"), F.col("r.hub_title"), F.col("r.content_excerpt"), policy)
    return rows.withColumn("o", told).select(
        "url", "domain", "status", "worksheets", "control_count", F.col("r.paywall_verdict").alias("paywall_verdict"), F.col("r.paywall_score").alias("paywall_score"), safe.alias("safe_domain"),
        F.col("r.suggestion").alias("suggestion"), F.col("o.category").alias("category"), F.col("o.note").alias("notes"), F.col("r.method").alias("fetch_method"),
    )


def outstanding_counts(items: DataFrame) -> DataFrame:
    """(category, n) of outstanding_items()."""
    return items.groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


def junk(results: DataFrame) -> DataFrame:
    return results.where("verdict is not null and verdict <> 'ok'")


def junk_summary(results: DataFrame) -> DataFrame:
    """(domain, verdict, n) with a null domain for the total of a verdict."""
    j = junk(results)
    by = j.groupingSets([["verdict"], ["domain", "verdict"]], "domain", "verdict").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return by.where("g > 0 or domain <> ''").select(F.when(F.col("g") == 0, F.col("domain")).alias("domain"), "verdict", "n")


def junk_examples(results: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    first = Window.partitionBy("verdict").orderBy("seq")
    return junk(results).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= policy.junk_examples).select("verdict", "rank", "url", "domain", "status", "junk_reason")


def junk_table(results: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Rows of the triage table in its order; the status sorts as a string."""
    rows = junk(results).select("verdict", F.coalesce(F.col("status").cast("string"), F.lit("")).alias("status"), "domain", "junk_reason", F.array_join("reasons", ", ").alias("r"), "url")
    rows = rows.withColumn("content_reasons", F.when(F.length("r") > 180, F.concat(F.substring("r", 1, 180), F.lit("…"))).otherwise(F.col("r"))).drop("r").orderBy("verdict", "domain", "status", "url")
    return rows.limit(policy.junk_rows) if policy.junk_rows > 0 else rows


def render_table(rows: DataFrame) -> DataFrame:
    """Markdown lines of a table."""
    cols = rows.columns
    head = rows.sparkSession.createDataFrame([(f"| {' | '.join(cols)} |",), (f"|{'---|' * len(cols)}",)], "line string")
    return head.unionByName(rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)), F.lit(" |")).alias("line")))


def pdf_mismatches(results: DataFrame) -> DataFrame:
    """PDFs that were read although paywall or content verdict say otherwise."""
    return results.where("pdf_extracted and (paywall_verdict in ('likely', 'maybe', 'paywalled') or verdict = 'paywall')").select("seq", "url", "paywall_verdict", "verdict")


def summary_items(entries: DataFrame, results: DataFrame) -> DataFrame:
    """One item for each entry of a run by its number: the last result of that number, or ``missing_result``."""
    last = Window.partitionBy("consumer_id").orderBy(F.desc("seq"))
    r = results.where("consumer_id is not null").withColumn("rank", F.row_number().over(last)).where("rank = 1").select(F.col("consumer_id").alias("rid"), F.col("status").alias("r_status"), has_payload(results).alias("r_has"), F.col("verdict").alias("r_verdict"), F.col("paywall_verdict").alias("r_paywall"), F.col("final_url").alias("r_final"), (F.array_contains("fetch_path", "playwright") if "fetch_path" in results.columns else F.lit(None).cast("boolean")).alias("r_script"), (F.col("blob_sha256").isNotNull() if "blob_sha256" in results.columns else F.lit(False)).alias("r_blob"))
    j = entries.join(r, entries["consumer_id"] == r["rid"], "left")
    got = F.coalesce((F.col("r_status") == 200) & F.col("r_has"), F.lit(False))
    verdict = F.when(~got, "failed").when(F.coalesce("r_verdict", F.lit("ok")) != "ok", "junk").otherwise("ok")
    pay = F.when(F.col("r_paywall").isNull(), None).when(F.col("r_paywall").isin("unlikely", "safe"), "ok").when(F.col("r_paywall").isin("likely", "maybe"), "paywalled").otherwise("unknown")
    return j.select(entries["consumer_id"], entries["url"], F.when(F.col("rid").isNull(), "missing_result").otherwise(verdict).alias("verdict"), pay.alias("paywall"), F.coalesce("r_final", entries["url"]).alias("final_url"), F.coalesce("r_script", F.lit(False)).alias("used_playwright"), F.coalesce("r_blob", F.lit(False)).alias("downloaded"))


def summary_counts(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "ok").alias("ok"), F.count_if(F.col("verdict").isin("failed", "missing_result")).alias("failed"), F.count_if(F.col("verdict") == "junk").alias("junk"), F.count_if(F.col("url") != F.col("final_url")).alias("used_alternates"), F.count_if("used_playwright").alias("used_playwright"), F.count_if("downloaded").alias("downloaded"))


def drop_reasons(children: DataFrame) -> DataFrame:
    """(reason, n) of links dropped, and kept ones under ``kept``."""
    return children.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def drop_examples(children: DataFrame, most: int = 8) -> DataFrame:
    """The first ``most`` links dropped for each reason, in order of parent and link."""
    first = Window.partitionBy("reason").orderBy("parent_url", "url")
    return children.where("not kept").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).select("reason", "rank", "parent_url", "url")


def proxy_summary(results: DataFrame) -> DataFrame:
    """(kind, value, n): attempts, successes and failures, and attempts by domain, reason and status."""
    rows = results.where("proxy_reason is not null").select(F.when(F.col("proxy_used"), "success").otherwise("failed").alias("outcome"), "domain", F.col("proxy_reason").alias("reason"), F.col("status").cast("string").alias("status"))
    kinds = ("outcome", "domain", "reason", "status")
    sets = rows.groupingSets([[], *([k] for k in kinds)], *kinds).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 15, "attempted").when(F.col("g") == 7, "outcome").when(F.col("g") == 11, "domain").when(F.col("g") == 13, "reason").otherwise("status")
    return sets.select(kind.alias("kind"), F.coalesce(*kinds).alias("value"), "n")


def credit_events(results: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` rows with an exhausted credit (proxy_credit): domain, url, trigger, status."""
    return results.where("proxy_credit is not null").orderBy("seq").limit(most).select("seq", "domain", "url", F.col("proxy_credit").alias("trigger"), "status")


def proxy_counters(results: DataFrame) -> DataFrame:
    return results.where("proxy_reason is not null").groupBy("domain", "proxy_reason").agg(F.count("*").alias("attempted"), F.count_if("proxy_used").alias("succeeded"))


def as_json_row(counts: DataFrame) -> DataFrame:
    """A report of one row as one JSON document."""
    return counts.select(F.to_json(F.struct(*counts.columns)).alias("value"))


def walkthrough(items: DataFrame) -> DataFrame:
    """One block of Markdown for each item of summary_items(), numbered in order of the run."""
    line = lambda name: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name).cast("string"), F.lit("none")))
    head = F.concat(F.lit("## Item "), (F.col("consumer_id") + 1).cast("string"))
    return items.select("consumer_id", F.concat_ws("\n", head, *(line(c) for c in ("url", "final_url", "verdict", "paywall"))).alias("block"))


def compare_markdown(pages: DataFrame, html_col: str = "html", markdown_col: str = "markdown") -> DataFrame:
    """Pages with how much of their tokens and headings their Markdown keeps."""
    from ..functions.content import headings, jaccard, markdown_headings, tokens, visible_text

    html, md = F.col(html_col), F.col(markdown_col)
    shared = [F.array_sort(F.array_intersect(headings(html, k, n), markdown_headings(md, k, n))).alias(f"shared_h{k}") for k, n in ((1, 25), (2, 50), (3, 75))]
    cut = pages.select("*", tokens(visible_text(html, ("script", "style"))).alias("__a"), tokens(md).alias("__b"))
    return cut.select(*pages.columns, jaccard(F.col("__a"), F.col("__b")).alias("token_jaccard"), *shared)

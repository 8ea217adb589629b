"""More registered queries: storage, proxies, rules and inputs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import content, provenance, urls
from ..lineage import shared_folder
from ..operators import dom, entries, reports, store
from ..policy import DEFAULT
from ..sources import readers
from ..streaming import live
from . import oracle as O
from .catalogue import (
    ANN,
    EV,
    F_STEPS,
    INV,
    JOIN,
    KIDS,
    R,
    RULES,
    _children,
    _events,
    _fetched,
    _inventory,
    _path,
    annotated,
    joined,
    load,
    register,
    results,
)

# == inputs

LINES = "SELECT page_id AS seq, CASE page_id % 4 WHEN 0 THEN concat('  ', url, E'\\t') WHEN 1 THEN '# a comment' WHEN 2 THEN '   ' ELSE url END AS value FROM pages UNION ALL SELECT page_id, url FROM pages"
register("manifest_urls", f"SELECT {O.strip('value')} AS url FROM ({LINES}) WHERE {O.strip('value')} <> '' AND NOT starts_with({O.strip('value')}, '#')")(
    lambda spark, d: readers.parse_manifest(spark.sql(LINES.replace("E'\\t'", "'\\t'").replace("FROM pages", "FROM {pages}"), pages=load(spark, d, "pages")))
)
register("rule_ids", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {O.q(readers.rule_id(r))})" for k, r in enumerate(RULES)) + ") AS v(priority, rule_id)")(lambda spark, d: readers.rules_frame(spark, RULES).select("priority", "rule_id"))
register("domain_set", f"SELECT DISTINCT {O.normalize_domain(O.host('url'))} AS domain FROM pages WHERE {O.normalize_domain(O.host('url'))} <> '' UNION SELECT d FROM (VALUES ('mitre.org'), ('nist.gov')) AS v(d)")(
    lambda spark, d: urls.domain_set(load(spark, d, "pages").select(urls.host(F.col("url")).alias("domain")), spark.createDataFrame([("MITRE.org.",), ("www.nist.gov",), ("",)], "domain string"))
)
register("params_merge", "SELECT event_id, coalesce(json_extract_string(props, '$.page'), 'none') AS page, 'fixed' AS k FROM events")(
    lambda spark, d: load(spark, d, "events").select(
        "event_id",
        content.merge_maps(
            F.create_map(F.lit("page"), F.lit("none"), F.lit("k"), F.lit("own")),
            F.map_filter(F.create_map(F.lit("page"), F.get_json_object("props", "$.page"), F.lit("k"), F.lit("fixed")), lambda _, v: v.isNotNull()),
        ).alias("m"),
    ).select("event_id", F.col("m.page").alias("page"), F.col("m.k").alias("k"))
)
_name = "CASE doc_id % 3 WHEN 0 THEN 'Authorization' WHEN 1 THEN 'x_api_key' ELSE 'Accept' END"
register("redact_named", f"SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN CASE WHEN length(text) <= 8 THEN repeat('*', length(text)) ELSE concat(substr(text, 1, 4), '...', right(text, 4)) END ELSE text END AS value FROM documents")(
    lambda spark, d: load(spark, d, "documents").select("doc_id", content.redact_named(F.expr(_name), F.col("text")).alias("value"))
)
register("decode_bytes", "SELECT doc_id, sha256(concat(text, 'caf', chr(233))) AS sha FROM documents")(
    lambda spark, d: load(spark, d, "documents")
    .select("doc_id", F.concat("text", F.lit("café")).alias("t"))
    .select("doc_id", F.sha2(content.decode_bytes(F.when(F.col("doc_id") % 2 == 0, F.encode("t", "UTF-8")).otherwise(F.encode("t", "UTF-16LE")), F.when(F.col("doc_id") % 2 == 0, "text/html").otherwise("text/html; charset=UTF-16LE")), 256).alias("sha"))
)

# == pages that need a browser

_html, _body = "contains(lower(content_type), 'html')", r"regexp_extract(text, '(?is)<body\b[^>]*>(.*?)(?:</body>|\z)', 1)"
_rendered = f"(length({O.visible(_body, ('script', 'style', 'noscript'))}) < {DEFAULT.least_rendered} OR length({O.visible('text')}) < {DEFAULT.least_rendered})"
register("needs_browser", rf"{R} SELECT seq, {_html} AND ({O.host('url')} IN {O.values(sorted(DEFAULT.sign_in))} OR length(text) < {DEFAULT.least_page} OR NOT regexp_matches(lower(text), '<body[\s>]') OR {_rendered} OR {O.any_of('lower(text)', DEFAULT.script_hints)}) AS needed FROM r")(
    lambda spark, d: results(spark, d).select("seq", content.needs_browser(F.col("url"), F.col("text"), F.col("content_type")).alias("needed"))
)
register("main_text")(lambda spark, d: load(spark, d, "pages").select("page_id", dom.extracted_main("html").alias("text")))
register("clean_markup")(lambda spark, d: load(spark, d, "pages").select("page_id", dom.repaired("html").alias("html")))

# == bytes and stored texts

_raw = "CASE seq % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('raw ', text) ELSE text END"
RAW = f"{F_STEPS}, b AS (SELECT *, {_raw} AS raw FROM j)"


def _with_raw(spark, d):
    own = results(spark, d).select(F.col("seq").alias("k"), F.encode(F.expr(_raw), "UTF-8").alias("raw_bytes"))
    return annotated(spark, d).join(own, F.col("seq") == F.col("k")).drop("k")


_data = "coalesce(raw, nullif(clean, ''))"
register("persist_raw_downloads", f"{RAW} SELECT seq, url, CASE WHEN {_data} IS NOT NULL THEN sha256({_data}) END AS blob_sha256, CASE WHEN {_data} IS NULL THEN NULL WHEN raw IS NULL THEN 'text' ELSE 'raw' END AS blob_source, CASE WHEN {_data} IS NULL THEN 'download_missing_no_payload' END AS error FROM b WHERE verdict = 'ok'")(
    lambda spark, d: store.persist_downloads(_with_raw(spark, d)).drop("blob_path")
)
register("raw_blobs", f"{RAW} SELECT sha256({_data}) AS sha256, max(strlen({_data})) AS size, min(seq) AS first_seq FROM b WHERE {_data} <> '' GROUP BY 1")(lambda spark, d: store.blobs(_with_raw(spark, d)).drop("filename"))
_plain_sql = O.strip("raw_text")
register(
    "extracted_texts",
    f"{F_STEPS}, t AS (SELECT seq, url, content_type, clean AS text FROM j WHERE verdict = 'ok' AND trim(clean) <> ''), e AS (SELECT seq, url, {O.strip(f'CASE WHEN contains(lower(content_type), {O.q("html")}) THEN {O.visible("text")} ELSE {O.strip("text")} END')} AS t FROM t) SELECT seq, url, sha256(t) AS extracted_text_sha256, concat(sha256(t), '.txt') AS extracted_text_path, length(t) AS extracted_text_len FROM e WHERE length(t) >= 1",
)(lambda spark, d: store.extracted_texts(annotated(spark, d))[0].withColumn("extracted_text_len", F.col("extracted_text_len").cast("long")))
register("postcheck", f"{F_STEPS}, r2 AS (SELECT seq, url, content_type, clean AS text FROM j WHERE verdict = 'ok') SELECT seq, length(CASE WHEN contains(lower(content_type), 'html') THEN {O.visible('text')} ELSE {O.strip('text')} END) AS content_text_len_post FROM r2 WHERE text <> '' UNION ALL SELECT seq, NULL FROM r2 WHERE text = ''")(
    lambda spark, d: store.verify_blobs(store.with_blob(annotated(spark, d)), store.blob_bytes(annotated(spark, d))).select("seq", F.col("content_text_len_post").cast("long"))
)
register("download_rolling", f"WITH n AS (SELECT doc_id, count(*) AS n FROM ({O.windows_sql()}) GROUP BY doc_id) SELECT d.doc_id AS seq, 'rolling_extract' AS download_mode, CASE WHEN length(text) > 0 THEN sha256(text) END AS blob_sha256, coalesce(n.n, 0) AS n_windows FROM documents d LEFT JOIN n USING (doc_id)")(
    lambda spark, d: store.download(load(spark, d, "documents").selectExpr("doc_id AS seq", "concat('http://h/', CAST(doc_id AS STRING)) AS url", "'text/plain' AS content_type", "text"), "rolling_extract").select("seq", "download_mode", "blob_sha256", F.greatest(F.size("windows"), F.lit(0)).cast("long").alias("n_windows"))
)

# == reports

_trigger = O.fallback_reason("status", "text")
_credit = lambda c: "CASE " + " ".join(f"WHEN contains(lower({c}), {O.q(k)}) THEN {O.q(k)}" for k in DEFAULT.credit_keywords) + " END"
PROXY = f"{R}, x AS (SELECT seq, url, {O.host('url')} AS domain, status, CASE WHEN proxy_attempted THEN concat('status_', CAST(status AS STRING)) END AS proxy_reason, proxy_used, coalesce({_credit('text')}, CASE WHEN status IN {O.values(DEFAULT.credit_statuses)} THEN concat('status_', status) END) AS proxy_credit FROM r)"


def _proxied(spark, d):
    s = F.col("status")
    return results(spark, d).select(
        "seq", "url", urls.host(F.col("url")).alias("domain"), "status", F.when(F.col("proxy_attempted"), F.concat(F.lit("status_"), s.cast("string"))).alias("proxy_reason"), "proxy_used", provenance.credit_exhaustion(s, F.col("text"), F.lit("")).alias("proxy_credit")
    )


_out = "CASE WHEN proxy_used THEN 'success' ELSE 'failed' END"
register(
    "proxy_summary",
    f"{PROXY}, p AS (SELECT *, {_out} AS outcome FROM x WHERE proxy_reason IS NOT NULL) SELECT 'attempted' AS kind, NULL AS value, count(*) AS n FROM p UNION ALL SELECT 'outcome', outcome, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'reason', proxy_reason, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'status', CAST(status AS VARCHAR), count(*) FROM p GROUP BY 2",
)(lambda spark, d: reports.proxy_summary(_proxied(spark, d)))
register("credit_events_topk", f'{PROXY} SELECT seq, domain, url, proxy_credit AS "trigger", status FROM x WHERE proxy_credit IS NOT NULL ORDER BY seq LIMIT 20')(lambda spark, d: reports.credit_events(_proxied(spark, d)))
register("fanout_drop_examples_topk", f"{KIDS}, k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY parent_url, url) AS rank FROM kid WHERE NOT kept) SELECT reason, rank::INTEGER AS rank, parent_url, url FROM k WHERE rank <= 8")(lambda spark, d: reports.drop_examples(_children(spark, d)))
register("overall_rate", f"{EV} SELECT count(*) AS requests, round(count(*) / 3600.0::DOUBLE, 3) AS effective_rps FROM e")(lambda spark, d: reports.overall_rate(_events(spark, d), 3600.0))
register("verdict_counts", f"{F_STEPS} SELECT coalesce(verdict, 'unknown') AS verdict, count(*) AS n FROM j GROUP BY 1")(lambda spark, d: reports.verdict_counts(annotated(spark, d)))
register(
    "batch_health_all",
    f"{EV}, b AS (SELECT *, (status <> 200)::INTEGER AS bad FROM e), w AS (SELECT seq, bad, count(*) OVER o AS completed, sum(bad) OVER o AS failed, sum(1 - bad) OVER o AS island FROM b WINDOW o AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT seq, completed, failed::BIGINT AS failed, (sum(bad) OVER (PARTITION BY island ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS error_run FROM w",
)(lambda spark, d: reports.batch_health(_events(spark, d)))


def _outstanding(spark, d):
    inventory, fetched = _inventory(spark, d), _fetched(spark, d)
    known = fetched.select("url", F.lit(None).cast("string").alias("verdict"), F.when(F.col("seq") % 3 == 0, "likely").alias("paywall_verdict"), F.lit("aiohttp").alias("method"), "seq")
    return reports.outstanding_items(entries.outstanding_urls(entries.outstanding_entries(inventory, fetched)), known)


ITEMS = f"""{JOIN}, u AS (SELECT url, arg_min(domain, seq) AS domain, arg_min(status, seq) AS status FROM pending GROUP BY url), v AS (SELECT url, arg_max(CASE WHEN seq % 3 = 0 THEN 'likely' ELSE '' END, seq) AS pv FROM r GROUP BY url),
o AS (SELECT u.*, nullif(v.pv, '') AS paywall_verdict, CASE WHEN v.url IS NOT NULL THEN 'aiohttp' END AS fetch_method FROM u LEFT JOIN v USING (url)),
c AS (SELECT *, CASE WHEN status IN (404, 410, 0, -1) THEN 'broken_or_moved' WHEN paywall_verdict = 'likely' THEN 'paywall' ELSE 'retry' END AS category FROM o)"""
register("outstanding_items", f"{ITEMS} SELECT url, domain, status, paywall_verdict, category, fetch_method FROM c")(lambda spark, d: _outstanding(spark, d).select("url", "domain", "status", "paywall_verdict", "category", "fetch_method"))
register("outstanding_counts", f"{ITEMS} SELECT category, count(*) AS n FROM c GROUP BY 1")(lambda spark, d: reports.outstanding_counts(_outstanding(spark, d)))

# == streams


def _folder(spark) -> str:
    return os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")


def _stream(spark, d, name):
    """A table as a stream of its files."""
    return spark.readStream.schema(load(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


register("stream_event_rates", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(
    lambda spark, d: live.run_once(live.rates(_stream(spark, d, "events")), _folder(spark)).withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
)
register("stream_changes", f"SELECT {O.normalize_url('url')} AS url_norm, page_id AS seq, sha256(html) AS content_sha256, true AS content_changed FROM pages WHERE length(html) > 0")(
    lambda spark, d: live.run_once(live.stream_changes(_stream(spark, d, "pages").select("url", F.col("html").alias("text"), F.lit("2025-01-01").alias("fetched_at"), F.col("page_id").alias("seq"))), _folder(spark), "append").select("url_norm", "seq", "content_sha256", "content_changed")
)

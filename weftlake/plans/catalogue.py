"""The registered queries, each over whole tables, with their DuckDB SQL where SQL can express them.

Result rows the reference data lacks (blocks, gates, soft 404s) are derived
from ``pages`` by expressions that are the same in both dialects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace as _replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content, paywall, provenance, urls
from ..operators import changes, dom, entries, reports, store, suggestions, windows
from ..policy import DEFAULT
from ..sources.readers import rules_frame
from ..streaming import live
from . import oracle as O
from . import run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
R, S404 = O.R, O.soft_404


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, d: (_bind(), f(spark, d))[1]
        if sql:
            SQL[name] = sql
        return f

    return keep


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def results(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(O.PAGES.replace("FROM pages", "FROM {pages}"), pages=load(spark, d, "pages")).selectExpr(*(f"{e} AS {c}" for c, e in O.RESULT.items()))


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Results with features, gate and domain, as run.annotate gives them."""
    r = results(spark, d)
    return run.annotate(r).withColumn("fetch_path", F.array(F.lit("aiohttp"))).withColumn("final_url", F.col("url"))


def joined(c) -> Column:
    return F.array_join(c, ",")


def _bind() -> None:
    """Columns can be made only where there is a session, so not on import."""
    global u, t, st, ct
    u, t, st, ct = F.col("url"), F.col("text"), F.col("status"), F.col("content_type")


def simple(name: str, col: Callable[[], object], expr: str, key: str = "seq", out: str = "value"):
    """A projection of result rows."""
    register(name, f"{R} SELECT {key}, {expr} AS {out} FROM r")(lambda spark, d: results(spark, d).select(key, col().alias(out)))


# == flagship

register(
    "domain_verdicts",
    f"WITH b AS (SELECT {O.host('url')} AS domain, {O.visible('html')} AS body, html FROM pages), n AS (SELECT domain, length(body) AS n, CASE WHEN length(body) > 0 THEN least(1.0::DOUBLE, {O.anchor_chars('html')} / length(body)) ELSE 0 END AS d, len({O.markers('body')}) AS k FROM b) "
    f"SELECT domain, {O.verdict('n', 'd', 'k')} AS verdict, count(*) AS n_pages FROM n GROUP BY 1, 2",
)(
    lambda spark, d: load(spark, d, "pages")
    .select(urls.host(u).alias("domain"), "html", content.visible_text(F.col("html")).alias("body"))
    .select("domain", content.verdict(F.length("body"), content.link_density(F.col("html"), F.length("body")), content.marker_hits(F.col("body"))).alias("verdict"))
    .groupBy("domain", "verdict")
    .agg(F.count("*").alias("n_pages"))
)

# == URLs

MESSY = "concat(CASE seq % 3 WHEN 0 THEN ' HTTP' WHEN 1 THEN 'https' ELSE 'Http' END, '://U:p@', CASE seq % 4 WHEN 0 THEN 'WWW.Ex' ELSE 'ex' END, CAST(seq % 7 AS STRING), '.Org', CASE seq % 5 WHEN 0 THEN ':8443' WHEN 1 THEN ':80' WHEN 2 THEN ':x1' ELSE '' END, '/P a/', CAST(seq AS STRING), CASE seq % 6 WHEN 0 THEN '/' WHEN 1 THEN '?a=1' WHEN 2 THEN '#f' WHEN 3 THEN '?' ELSE '' END)"
RAW = "CASE seq % 6 WHEN 0 THEN '' WHEN 1 THEN concat('ftp://example.com/', CAST(seq AS STRING)) WHEN 2 THEN 'http://' WHEN 3 THEN 'file://' WHEN 4 THEN concat('file:///tmp/', CAST(seq AS STRING)) ELSE url END"
VIDEO = "CASE seq % 4 WHEN 0 THEN concat('https://www.youtube.com/watch?x=1&v=abcdefg', CAST(1000 + seq % 9000 AS STRING)) WHEN 1 THEN concat('https://youtu.be/abc-efg', CAST(1000 + seq % 9000 AS STRING)) WHEN 2 THEN concat('https://a.b/embed/abc_efg', CAST(1000 + seq % 9000 AS STRING)) ELSE url END"
CODE = "CASE seq % 5 WHEN 0 THEN concat('https://github.com/o/r/blob/main/d/', CAST(seq AS STRING)) WHEN 1 THEN concat('https://raw.githubusercontent.com/o/r/ref/d/', CAST(seq AS STRING)) WHEN 2 THEN 'https://github.com/o/r/tree/main/x' WHEN 3 THEN 'https://www.github.com/o/r/raw/v1/a/b.md' ELSE url END"

for _name, _col, _sql, _src in [
    ("url_normalize", urls.normalize_url, O.normalize_url, MESSY),
    ("url_validate", urls.validate_url, None, RAW),
    ("video_id_extract", urls.video_id, None, VIDEO),
]:
    if _name == "url_validate":
        _s, _b = f"lower({O.part(O.strip('x'), 1)})", O.strip("x")
        _e = f"CASE WHEN {_b} = '' THEN 'missing_url' WHEN {_s} NOT IN ('http', 'https', 'file') THEN 'unsupported_scheme' WHEN {_s} <> 'file' AND {O.part(_b, 2)} = '' THEN 'missing_host' WHEN {_s} = 'file' AND {O.part(_b, 3)} = '' THEN 'missing_path' END"
    elif _name == "video_id_extract":
        _e = r"coalesce(nullif(regexp_extract(x, '[?&]v=([A-Za-z0-9_\-]{11})', 1), ''), nullif(regexp_extract(x, 'youtu\.be/([A-Za-z0-9_\-]{11})', 1), ''), nullif(regexp_extract(x, 'embed/([A-Za-z0-9_\-]{11})', 1), ''))"
    else:
        _e = _sql("x")
    register(_name, f"{R} SELECT seq, x AS url, {_e} AS value FROM (SELECT seq, {_src} AS x FROM r)")(
        lambda spark, d, c=_col, s=_src: results(spark, d).select("seq", F.expr(s).alias("url")).select("seq", "url", c(F.col("url")).alias("value"))
    )

_p = O.part("url", 3)
_o = f"CASE WHEN ends_with({_p}, '/') AND length({_p}) > 1 THEN regexp_replace({_p}, '/+$', '') WHEN ends_with({_p}, '/') OR {_p} = '' THEN {_p} ELSE concat({_p}, '/') END"
simple("trailing_slash_toggle", lambda: urls.toggle_trailing_slash(u), f"CASE WHEN {_p} = '' OR {_p} = ({_o}) THEN url ELSE {O.joined(f'lower({O.part("url", 1)})', O.part('url', 2), f'({_o})', O.tail('url'))} END")
simple("domain_normalize", lambda: urls.normalize_domain(urls.host(u)), O.normalize_domain(O.host("url")))
_last = rf"regexp_extract(regexp_replace({_p}, '/+$', ''), '([^/]*)$', 1)"
_words = f"array_to_string(regexp_extract_all(replace(replace({_last}, '.html', ''), '.pdf', ''), '([A-Za-z]+)', 1), ' ')"
_site = f"replace({O.part('url', 2)}, 'www.', '')"
_query = f"trim(concat_ws(' ', nullif({_words}, ''), nullif({_site}, '')))"
simple("search_query_tokens", lambda: urls.search_query(u), f"CASE WHEN {_query} <> '' THEN {_query} ELSE url END")
simple("safe_domain", lambda: urls.is_safe_domain(urls.host(u)), O.safe_domain(O.host("url")))
simple("allowlist_match", lambda: urls.match_suffix(urls.host(u), DEFAULT.link_heavy), O.suffix(O.host("url"), DEFAULT.link_heavy))
simple("blob_extension", lambda: urls.blob_extension(u, ct), O.blob_ext("url", "content_type"))
simple("static_redirect", lambda: urls.static_redirect(F.concat(u, F.lit("/d3f:CredentialRevoking"))), "replace(concat(url, '/d3f:CredentialRevoking'), 'CredentialRevoking', 'CredentialRevocation')")
_raw, _blob = "^([^/]*)/([^/]*)/([^/]*)/(.+)$", "^([^/]*)/([^/]*)/(?:blob|raw)/([^/]*)/(.+)$"
_pp = f"regexp_replace({O.part('x', 3)}, '^/+|/+$', '', 'g')"
register(
    "github_rewrite",
    f"{R}, s AS (SELECT seq, x, lower({O.part('x', 2)}) AS a, {_pp} AS p FROM (SELECT seq, {CODE} AS x FROM r)) SELECT seq, CASE WHEN a = 'raw.githubusercontent.com' AND regexp_matches(p, '{_raw}') THEN x WHEN a IN ('github.com', 'www.github.com') AND regexp_matches(p, '{_blob}') "
    f"THEN concat('https://raw.githubusercontent.com/', {", '/', ".join(f"regexp_extract(p, '{_blob}', {k})" for k in (1, 2, 3, 4))}) END AS fetch_url, CASE WHEN a = 'raw.githubusercontent.com' AND regexp_matches(p, '{_raw}') THEN regexp_extract(p, '{_raw}', 3) WHEN a IN ('github.com', 'www.github.com') AND regexp_matches(p, '{_blob}') THEN regexp_extract(p, '{_blob}', 3) END AS ref FROM s",
)(lambda spark, d: results(spark, d).select("seq", urls.code_host_request(F.expr(CODE)).alias("g")).select("seq", "g.fetch_url", "g.ref"))

simple("idna_hosts", lambda: urls.idna_host(urls.host(u)), O.host("url"))
simple("final_url", lambda: urls.final_url(u, F.when(F.col("seq") % 3 == 0, ""), F.when(F.col("seq") % 4 == 0, F.lit("http://alt/"))), "CASE WHEN seq % 4 = 0 THEN 'http://alt/' ELSE url END")
simple("alternate_provider", lambda: urls.alternate_provider(F.col("via"), F.lit(None), F.when(F.col("seq") % 5 == 0, "brave_redirect")), "CASE WHEN lower(via) IN ('wayback', 'jina') THEN lower(via) WHEN seq % 5 = 0 THEN 'brave' END")

# == provenance

simple("soft_404_template", lambda: provenance.soft_404(t), S404("text"))
simple("fallback_reason", lambda: provenance.fallback_reason(st, t), O.fallback_reason("status", "text"))
_bot = O.any_of("lower(text)", DEFAULT.bot_tokens)
simple("archive_needed", lambda: provenance.archive_needed(st, t), f"(status = 200 AND {_bot}) OR (status IN (401, 403, 404) AND (length(text) = 0 OR {_bot}))")
_near = "CASE seq % 3 WHEN 0 THEN 'd3fend.mitre.org' WHEN 1 THEN 'x.d3fend.mitre.org' ELSE 'example.org' END"
simple(
    "proxy_trigger",
    lambda: provenance.proxy_trigger(F.expr(_near), st, t),
    f"CASE WHEN ({O.suffix(_near, DEFAULT.proxy_domains)}) IS NULL THEN NULL WHEN status IN {O.values(DEFAULT.proxy_statuses)} THEN concat('status_', status) {' '.join(f'WHEN contains(lower(text), {O.q(h)}) THEN {O.q("hint_" + h)}' for h in DEFAULT.proxy_hints)} END",
)
_err = "CASE seq % 4 WHEN 0 THEN 'Insufficient balance' ELSE '' END"
_cs = "CASE seq % 5 WHEN 0 THEN 407 ELSE status END"
_kw = lambda c: "CASE " + " ".join(f"WHEN contains(lower({c}), {O.q(k)}) THEN {O.q(k)}" for k in DEFAULT.credit_keywords) + " END"
simple("proxy_credit", lambda: provenance.credit_exhaustion(F.expr(_cs), t, F.expr(_err)), f"coalesce({_kw('text')}, {_kw(_err)}, CASE WHEN {_cs} IN {O.values(DEFAULT.credit_statuses)} THEN concat('status_', {_cs}) END)")
_steps = "array_to_string(list_filter(['aiohttp', CASE WHEN proxy_used THEN 'proxy_rotation' END, CASE WHEN seq % 3 = 0 AND seq % 9 <> 0 THEN 'playwright' END, CASE WHEN lower(via) = 'wayback' OR method = 'wayback' THEN 'wayback' END, CASE WHEN lower(via) = 'jina' OR method = 'jina' THEN 'jina' END, CASE WHEN seq % 5 = 0 THEN 'brave' END, CASE WHEN seq % 17 = 0 THEN 'google_translate' END], lambda z: z IS NOT NULL), ',')"


def _path():
    s = F.col("seq")
    return provenance.fetch_path(F.col("method"), F.col("from_cache"), F.col("proxy_used"), s % 3 == 0, s % 9 == 0, F.col("via"), F.when(s % 5 == 0, "brave_redirect"), F.when(s % 17 == 0, "http://t"))


simple("fetch_path", lambda: joined(_path()), f"CASE WHEN from_cache THEN 'cache' WHEN method IN ('file', 'github_cli') THEN method ELSE {_steps} END")
simple("rate_limit_fields", lambda: provenance.rate_limit_fields(st, F.col("fetched_at"))["rate_limit_timestamp"], "CASE WHEN status = 429 THEN fetched_at END")
register("archive_timestamp", f"{R} SELECT seq, CASE WHEN seq % 3 = 0 THEN NULL ELSE concat('2024', CAST(seq AS STRING)) END AS stamp FROM r")(
    lambda spark, d: results(spark, d).select("seq", provenance.archive_timestamp(F.when(F.col("seq") % 3 == 0, F.array(F.array(F.lit("timestamp")))).otherwise(F.array(F.array(F.lit("timestamp")), F.array(F.lit(" ")), F.array(F.concat(F.lit("2024"), F.col("seq").cast("string")))))).alias("stamp"))
)

# == content

register("visible_text", f"SELECT page_id, sha256({O.visible('html')}) AS text_sha, length({O.visible('html')}) AS n_chars FROM pages")(
    lambda spark, d: load(spark, d, "pages").select("page_id", content.visible_text(F.col("html")).alias("v")).select("page_id", F.sha2("v", 256).alias("text_sha"), F.length("v").alias("n_chars"))
)
register("link_density", f"WITH b AS (SELECT page_id, html, length({O.visible('html')}) AS n FROM pages) SELECT page_id, round(CASE WHEN n > 0 THEN least(1.0::DOUBLE, {O.anchor_chars('html')} / n) ELSE 0 END, 3) AS density FROM b")(
    lambda spark, d: load(spark, d, "pages").select("page_id", F.round(content.link_density(F.col("html"), F.length(content.visible_text(F.col("html")))), 3).alias("density"))
)
simple("marker_hits", lambda: joined(content.marker_hits(t)), f"array_to_string({O.markers('text')}, ',')")
F_STEPS = R + O.feature_steps()


register("content_verdict", f"{F_STEPS} SELECT seq, fn::INTEGER AS text_len, fv AS verdict, round(fs, 6) AS score, array_to_string(fr, ',') AS reasons FROM f")(
    lambda spark, d: content.with_features(results(spark, d)).select("seq", F.col("f_len").alias("text_len"), F.col("f_verdict").alias("verdict"), F.round("f_score", 6).alias("score"), joined("f_reasons").alias("reasons"))
)
register("content_gate", f"{F_STEPS} SELECT seq, verdict, array_to_string(reasons, ',') AS reasons FROM g")(
    lambda spark, d: content.with_gate(content.with_features(results(spark, d))).select("seq", "verdict", joined("reasons").alias("reasons"))
)
register("usable_flags", f"{F_STEPS} SELECT seq, usable, junk_reason, length(clean) AS n_clean FROM j")(lambda spark, d: annotated(spark, d).select("seq", "usable", "junk_reason", F.length("text").alias("n_clean")))
_bare = "coalesce(text, '')"
for _t in content.CHROME:
    _bare = f"regexp_replace({_bare}, '(?is)<{_t}[^>]*>.*?</{_t}>', ' ', 'g')"
_h = "starts_with(lower(content_type), 'text/html')"
register(
    "body_prefilter",
    rf"{R}, b AS (SELECT seq, {_h} AS html, CASE WHEN {_h} THEN length({O.visible('text')}) ELSE length({O.strip('text')}) END AS n, CASE WHEN {_h} THEN len(regexp_extract_all({_bare}, '(?i)<p\b')) ELSE len(list_filter(string_split({O.strip('text')}, E'\n\n'), lambda z: {O.strip('z')} <> '')) END AS p, len(regexp_extract_all({_bare}, '(?i)<h[1-6]\b')) AS h FROM r), "
    f"c AS (SELECT *, CASE WHEN n < {DEFAULT.child_chars} THEN 'low_body_text' WHEN p < {DEFAULT.child_paragraphs} THEN 'few_paragraphs' END AS reason FROM b) SELECT seq, reason IS NULL AS keep, reason, CASE WHEN html THEN CASE WHEN h = 0 THEN 'sections_missing' WHEN n < 300 OR p < 2 THEN 'sections_too_small' END WHEN reason = 'low_body_text' THEN 'sections_missing' WHEN reason = 'few_paragraphs' THEN 'sections_too_small' END AS section FROM c",
)(lambda spark, d: results(spark, d).select("seq", content.body_prefilter(t, ct).alias("b")).select("seq", "b.keep", "b.reason", F.col("b.section_pref_fallback").alias("section")))
register("title_normalize", "SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS title FROM benchmark")(lambda spark, d: load(spark, d, "benchmark").select("item_id", content.normalize_title(F.col("text")).alias("title")))
_mask = "CASE WHEN length(v) <= 8 THEN repeat('*', length(v)) ELSE concat(substr(v, 1, 4), '...', right(v, 4)) END"
register("redact_values", f"SELECT doc_id, {_mask} AS value FROM (SELECT doc_id, text AS v FROM documents UNION ALL SELECT doc_id, source FROM documents)")(
    lambda spark, d: load(spark, d, "documents").select("doc_id", F.explode(F.array(t, F.col("source"))).alias("v")).select("doc_id", content.redact_value(F.col("v")).alias("value"))
)
register("content_hash", "SELECT doc_id, CASE WHEN length(text) > 0 THEN sha256(text) ELSE '' END AS sha FROM documents")(lambda spark, d: load(spark, d, "documents").select("doc_id", content.content_hash(F.col("text")).alias("sha")))
_tok = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '([a-z0-9]{{3,}})', 1))"
register(
    "token_jaccard",
    f"WITH p AS (SELECT page_id, {_tok.format(O.visible('html'))} AS a, {_tok.format('url')} AS b FROM pages), "
    f"k AS (SELECT page_id, len(list_intersect(a, b)) AS i, len(a) + len(b) - len(list_intersect(a, b)) AS n FROM p) SELECT page_id, CASE WHEN n = 0 THEN 0.0 ELSE round(i / n, 4) END AS jaccard FROM k",
)(lambda spark, d: load(spark, d, "pages").select("page_id", content.tokens(content.visible_text(F.col("html"))).alias("a"), content.tokens(u).alias("b")).select("page_id", content.jaccard(F.col("a"), F.col("b")).alias("jaccard")))
_h1 = rf"list_filter(list_transform(regexp_extract_all(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), lambda z: trim(regexp_replace(regexp_replace(z, '<[^>]+>', ' ', 'g'), '{content.SPACE}', ' ', 'g'))), lambda z: z <> '')"
_tt = rf"list_transform(regexp_extract_all(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), lambda z: trim(regexp_replace(regexp_replace(z, '<[^>]+>', ' ', 'g'), '{content.SPACE}', ' ', 'g')))"
register("heading_overlap", f"SELECT page_id, array_to_string(list_sort(list_intersect({_h1}[1:25], {_tt})), '|') AS shared FROM pages")(
    lambda spark, d: load(spark, d, "pages").select(
        "page_id",
        F.array_join(F.array_sort(F.array_intersect(content.headings(F.col("html"), 1, 25), F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<title\b[^>]*>(.*?)</title>"), 1), lambda z: F.trim(F.regexp_replace(F.regexp_replace(z, r"<[^>]+>", " "), content.SPACE, " "))))), "|").alias("shared"),
    )
)
register("prune_markdown", r"SELECT doc_id, sha256(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN concat('# H', CAST(doc_id AS VARCHAR), E'\n', text) ELSE text END, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')) AS sha FROM documents")(
    lambda spark, d: load(spark, d, "documents").select("doc_id", F.sha2(content.prune_to_first_heading(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Esc\nmenu\n# H"), F.col("doc_id").cast("string"), F.lit("\n"), t)).otherwise(t)), 256).alias("sha"))
)
register("minimal_fix", "SELECT doc_id, sha256(concat(text, 'caf', chr(233), ' \"q\" ffi')) AS sha FROM documents")(
    lambda spark, d: load(spark, d, "documents").select("doc_id", F.sha2(content.minimal_fix(F.concat(t, F.lit("\u200b\ufeffcaf\u00c3\u00a9 \u201cq\u201d \ufb03"))), 256).alias("sha"))
)

# == paywalls

register("paywall_score", f"{R}, h AS (SELECT seq, url, status, text AS html FROM r), {O.paywall_steps('h')} SELECT seq, score, pverdict AS verdict, indicators, page_len, article_len FROM pw")(
    lambda spark, d: paywall.with_detection(results(spark, d)).select("seq", F.col("pw_score").alias("score"), F.col("pw_verdict").alias("verdict"), joined("pw_indicators").alias("indicators"), F.col("pw_page_len").alias("page_len"), F.col("pw_article_len").alias("article_len"))
)
PW = f"{F_STEPS}, h AS (SELECT seq, url, status, clean AS html FROM j), {O.paywall_steps('h')}"
_sus = f"(j.domain IN {O.values(sorted(DEFAULT.gated))} OR j.status IN {O.values(DEFAULT.gated_statuses)})"
ANN = f"""{PW}, ann AS (SELECT j.*, CASE WHEN {O.safe_domain("j.domain")} THEN 'safe' WHEN j.clean = '' AND {_sus} THEN 'maybe' WHEN j.clean <> '' AND contains(j.ct, 'html') THEN pw.pverdict END AS paywall_verdict,
 CASE WHEN {O.safe_domain("j.domain")} THEN 0.0 WHEN j.clean = '' AND {_sus} THEN 0.6 WHEN j.clean <> '' AND contains(j.ct, 'html') THEN pw.score END::DOUBLE AS paywall_score FROM j JOIN pw USING (seq))"""
register("paywall_annotate", f"{ANN} SELECT seq, paywall_verdict, paywall_score FROM ann")(lambda spark, d: annotated(spark, d).select("seq", "paywall_verdict", "paywall_score"))
_hints = O.any_of("lower(text)", (*DEFAULT.hints, "proprietary"))
simple("paywall_hints", lambda: paywall.hinted(t), _hints)
simple("gated_urls", lambda: urls.looks_gated_url(u), O.any_of("lower(url)", ("login", "paywall", "signin", "sign-in", "subscribe", "subscription")))
_el = f"((coalesce(verdict = 'missing_file', false) OR status IN (401, 403, 429, 451, 503) OR coalesce(reason IN ('bot_blocked', 'cloudflare_block_page'), false) OR (status = 200 AND domain IN {O.values(sorted(DEFAULT.gated))} AND {O.strip('clean')} = '')) AND coalesce(paywall_verdict IN ('maybe', 'likely'), true))"
register("resolver_eligible", f"{ANN}, e AS (SELECT *, {O.fallback_reason('status', 'text')} AS reason FROM ann) SELECT seq, {_el} AS eligible FROM e")(
    lambda spark, d: annotated(spark, d).select("seq", paywall.resolver_eligible(F.col("domain"), st, t, F.col("fallback_reason"), F.col("verdict"), F.col("paywall_verdict")).alias("eligible"))
)
register("resolver_topn", f"{ANN}, e AS (SELECT *, {O.fallback_reason('status', 'text')} AS reason FROM ann) SELECT seq FROM e WHERE {_el} ORDER BY seq LIMIT 25")(
    lambda spark, d: entries.first_pending(annotated(spark, d).where(paywall.resolver_eligible(F.col("domain"), st, t, F.col("fallback_reason"), F.col("verdict"), F.col("paywall_verdict"))), 25).select("seq")
)

# == entries and joins

ENTRY = {
    "url": "concat(CASE page_id % 2 WHEN 0 THEN 'HTTP://Site' ELSE 'http://site' END, CAST(page_id % 90 AS STRING), '.example.com:80/p')",
    "domain": "concat('site', CAST(page_id % 90 AS STRING), '.example.com')",
    "controls": "split(concat('c', CAST(page_id % 5 AS STRING), ',c', CAST(page_id % 3 AS STRING)), ',')",
    "titles": "split(concat('t', CAST(page_id % 4 AS STRING)), ',')",
    "frameworks": "split('fw', ',')",
    "worksheets": "split(concat('w', CAST(page_id % 2 AS STRING), ',w9'), ',')",
    "seq": "page_id",
}
E = "WITH e AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in ENTRY.items()) + " FROM pages)"


def _entries(spark, d):
    return load(spark, d, "pages").selectExpr(*(f"{x} AS {c}" for c, x in ENTRY.items()))


_all = ", ".join(f"CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list_distinct(flatten(list({c})))), ',') ELSE array_to_string(arg_min({c}, seq), ',') END AS {c}" for c in entries.LISTS)
register("dedupe_merge", f"{E}, k AS (SELECT *, {O.normalize_url('url')} AS url_normalized FROM e) SELECT url_normalized, arg_min(url, seq) AS url, arg_min(domain, seq) AS domain, {_all}, count(*) AS n_merged, min(seq) AS seq FROM k GROUP BY url_normalized")(
    lambda spark, d: entries.dedupe_merge(_entries(spark, d)).withColumns({c: joined(c) for c in entries.LISTS})
)
register("build_entries", f"SELECT {O.strip('url')} AS url, {O.host('url')} AS domain, row_number() OVER (ORDER BY page_id) - 1 AS consumer_id FROM pages")(
    lambda spark, d: entries.build_entries(load(spark, d, "pages").select("url", F.col("page_id").alias("seq"))).select("url", "domain", F.col("consumer_id").cast("long"))
)
# entries of pages; results of some are under another URL or under their original one
RES = "SELECT CASE page_id % 4 WHEN 3 THEN concat(url, '?moved') WHEN 1 THEN concat(url, '?other') ELSE url END AS url, CASE WHEN page_id % 4 = 3 THEN url END AS original_url, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 7 = 0 THEN '' ELSE html END AS text, page_id AS seq FROM pages"
INV = "SELECT url, concat('d', CAST(page_id % 6 AS STRING)) AS domain, split(concat('c', CAST(page_id % 9 AS STRING), ',c', CAST(page_id % 4 AS STRING)), ',') AS controls, split(concat('t', CAST(page_id % 3 AS STRING)), ',') AS titles, split(concat('w', CAST(page_id % 2 AS STRING)), ',') AS worksheets, page_id AS seq FROM pages"


def _inventory(spark, d):
    p = load(spark, d, "pages")
    return p.selectExpr("url", "concat('d', CAST(page_id % 6 AS STRING)) AS domain", "split(concat('c', CAST(page_id % 9 AS STRING), ',c', CAST(page_id % 4 AS STRING)), ',') AS controls", "split(concat('t', CAST(page_id % 3 AS STRING)), ',') AS titles", "split(concat('w', CAST(page_id % 2 AS STRING)), ',') AS worksheets", "page_id AS seq")


def _fetched(spark, d):
    return spark.sql(RES.replace("FROM pages", "FROM {pages}"), pages=load(spark, d, "pages"))


JOIN = f"""WITH i AS ({INV}), r AS ({RES}), keyed AS (SELECT url AS key, 0 AS pref, status, text, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS rk FROM r UNION ALL
 SELECT original_url, 1, status, text, row_number() OVER (PARTITION BY original_url ORDER BY seq) FROM r WHERE original_url IS NOT NULL),
one AS (SELECT key, arg_min(status, pref) AS status, arg_min(text, pref) AS text FROM keyed WHERE rk = 1 GROUP BY key),
a AS (SELECT i.*, one.status AS r_status, one.text AS r_text FROM i LEFT JOIN one ON i.url = one.key),
pending AS (SELECT *, coalesce(r_status, -1) AS status FROM a WHERE NOT coalesce(r_status = 200 AND length(r_text) > 0, false))"""
register("entries_results_join", f"{JOIN} SELECT seq, url, r_status AS status FROM a")(lambda spark, d: entries.attach_results(_inventory(spark, d), _fetched(spark, d)).select("seq", F.col("url"), F.col("r_status").alias("status")))
register("outstanding_controls", f"{JOIN} SELECT controls[k] AS control_id, coalesce(titles[k], '') AS title, url AS failed_url, domain, array_to_string(worksheets, ',') AS worksheets, status FROM (SELECT *, unnest(range(1, len(controls) + 1)) AS k FROM pending)")(
    lambda spark, d: entries.outstanding_controls(entries.outstanding_entries(_inventory(spark, d), _fetched(spark, d))).withColumn("worksheets", joined("worksheets"))
)
register("outstanding_urls", f"{JOIN} SELECT url, arg_min(domain, seq) AS domain, arg_min(status, seq) AS status, len(list_distinct(flatten(list(controls)))) AS control_count, array_to_string(list_sort(list_distinct(flatten(list(worksheets)))), ',') AS worksheets FROM pending GROUP BY url")(
    lambda spark, d: entries.outstanding_urls(entries.outstanding_entries(_inventory(spark, d), _fetched(spark, d))).withColumns({"worksheets": joined("worksheets"), "control_count": F.col("control_count").cast("long")})
)
_low = lambda c: f"lower(coalesce({c}, ''))"
_bots = f"({O.any_of(_low('excerpt'), ('cf-challenge', 'cf-error-details', 'cloudflare', 'just a moment'))})"
_cat = f"""CASE WHEN status IN (404, 410, 0, -1) THEN 'broken_or_moved' WHEN status IN (500, 502, 503) THEN 'retry' WHEN status = 403 AND {_bots} THEN 'bot_blocked' WHEN status IN (401, 403) AND domain IN {O.values(sorted(DEFAULT.sign_in | DEFAULT.scripted))} THEN 'needs_login_or_playwright'
 WHEN paywall_verdict IN ('likely', 'maybe') THEN 'paywall' WHEN verdict = 'missing_file' THEN 'broken_or_moved' WHEN verdict = 'paywall' THEN 'paywall' WHEN verdict = 'thin' THEN 'content_thin' WHEN verdict = 'link_hub' THEN 'content_link_hub' WHEN verdict = 'weak' THEN 'content_weak'
 WHEN verdict = 'password_protected' THEN 'password_protected' WHEN {O.safe_domain("domain")} THEN 'needs_whitelist' ELSE 'retry' END"""


def _categories(spark, d):
    raw = results(spark, d).select(F.col("seq").alias("k"), F.substring("text", 1, 500).alias("excerpt"))
    a = annotated(spark, d).join(raw, F.col("seq") == F.col("k"))
    return a.select("seq", paywall.outstanding(F.col("domain"), st, F.col("paywall_verdict"), urls.is_safe_domain(F.col("domain")), F.col("verdict"), F.lit(None).cast("string"), F.col("excerpt")).alias("o"))


register("outstanding_categories", f"{ANN}, c AS (SELECT *, substr(text, 1, 500) AS excerpt FROM ann) SELECT seq, {_cat} AS category FROM c")(lambda spark, d: _categories(spark, d).select("seq", "o.category"))
register("outstanding_summary", f"{ANN}, c AS (SELECT *, substr(text, 1, 500) AS excerpt FROM ann) SELECT {_cat} AS category, count(*) AS n FROM c GROUP BY 1")(lambda spark, d: _categories(spark, d).groupBy("o.category").agg(F.count("*").alias("n")))

RULES = [
    {"domain": "www.nytimes.com", "target_template": "https://mirror.example/{original}"},
    {"domain": "github.com", "path_prefix": "/org/repo", "path_regex": "f[0-9]*5[.]txt$", "target_url": "https://five.example/"},
    {"substring": "capec.mitre.org", "path_prefix": "/community/", "target_url": ""},
    {"substring": "capec.mitre.org", "target_url": "https://capec.example/"},
    {"query_contains": {"page": "2", "ref": "x"}, "target_url": "https://query.example/"},
    {"domain": "github.com", "target_url": "https://any.example/"},
    {"domain": "docs.example.gov", "path_prefix": "/x", "fit_markdown_selectors": ["main", "article"]},
    {"domain": "docs.example.gov", "path_prefix": "/x1", "fit_markdown_selectors": ["#content"]},
    {"substring": "mitre", "fit_markdown_selectors": ["article"]},
]
_nd = f"({O.normalize_domain(O.host('url'))})"
_url_path, _q = O.part("url", 3), O.part("url", 4)
_rule = f"CASE WHEN {_nd} = 'nytimes.com' THEN 0 WHEN {_nd} = 'github.com' AND starts_with({_url_path}, '/org/repo') AND regexp_matches({_url_path}, 'f[0-9]*5[.]txt$') THEN 1 WHEN contains(url, 'capec.mitre.org') THEN 3 WHEN contains({_q}, 'page=2') AND contains({_q}, 'ref=x') THEN 4 WHEN {_nd} = 'github.com' THEN 5 END"
register("override_first_match", f"{R} SELECT seq, ({_rule})::INTEGER AS rule_priority, CASE ({_rule}) WHEN 0 THEN concat('https://mirror.example/', url) WHEN 1 THEN 'https://five.example/' WHEN 3 THEN 'https://capec.example/' WHEN 4 THEN 'https://query.example/' WHEN 5 THEN 'https://any.example/' END AS target FROM r")(
    lambda spark, d: entries.apply_overrides(results(spark, d).select("seq", "url", urls.host(u).alias("domain")), rules_frame(spark, RULES)).select("seq", "rule_priority", "target")
)
_hh = O.host("url")
register("selector_longest_prefix", f"{R} SELECT seq, CASE WHEN {_hh} = 'docs.example.gov' AND starts_with({_url_path}, '/x1') THEN '#content' WHEN {_hh} = 'docs.example.gov' AND starts_with({_url_path}, '/x') THEN 'main,article' WHEN contains(url, 'mitre') THEN 'article' END AS selectors FROM r")(
    lambda spark, d: entries.pick_selectors(results(spark, d).select("seq", "url"), rules_frame(spark, RULES)).select("seq", joined("selectors").alias("selectors"))
)
_cand = "SELECT doc_id, concat('u', CAST(doc_id % 97 AS STRING)) AS url, concat(CASE doc_id % 5 WHEN 0 THEN 'https://en.wikipedia.org/a' WHEN 1 THEN 'https://ok.example/login/' WHEN 2 THEN 'https://x.com/b' ELSE 'https://ok.example/c' END, CAST(doc_id AS STRING)) AS candidate, doc_id AS rank FROM documents"


def _candidates(spark, d):
    c = load(spark, d, "documents").selectExpr("concat('u', CAST(doc_id % 97 AS STRING)) AS url", "concat(CASE doc_id % 5 WHEN 0 THEN 'https://en.wikipedia.org/a' WHEN 1 THEN 'https://ok.example/login/' WHEN 2 THEN 'https://x.com/b' ELSE 'https://ok.example/c' END, CAST(doc_id AS STRING)) AS candidate", "doc_id AS rank")
    return entries.pick_candidates(c, spark.createDataFrame([(x,) for x in sorted(DEFAULT.no_search)], "domain string"), urls.looks_gated_url(F.col("candidate")))


register("candidate_filter", f"WITH c AS ({_cand}) SELECT url, arg_min(candidate, rank) AS candidate, min(rank) AS rank FROM c WHERE {O.host('candidate')} NOT IN {O.values(sorted(DEFAULT.no_search))} AND NOT {O.any_of('lower(candidate)', ('login', 'paywall', 'signin', 'sign-in', 'subscribe', 'subscription'))} GROUP BY url")(_candidates)
_SUG = ["doc_id", "CASE doc_id % 3 WHEN 0 THEN 'A Title!' ELSE '' END AS source_title", "CASE doc_id % 2 WHEN 0 THEN 'a title' ELSE 'Other' END AS title", "concat(CASE doc_id % 7 WHEN 0 THEN 'https://www.wikipedia.org/' WHEN 1 THEN 'https://a.example/signin' ELSE 'https://a.example/' END, CAST(doc_id AS STRING)) AS url", "CASE doc_id % 11 WHEN 0 THEN 'Members only' ELSE 'open' END AS summary", "CASE doc_id % 13 WHEN 0 THEN '' ELSE substr(text, 1, 20) END AS html_excerpt"]
_nt = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"
register(
    "suggestion_filter",
    f"WITH s AS (SELECT {', '.join(_SUG)} FROM documents) SELECT doc_id, url FROM s WHERE (source_title = '' OR {_nt('title')} = {_nt('source_title')}) AND coalesce(html_excerpt, '') <> '' AND NOT {O.any_of('lower(url)', ('login', 'signin', 'subscribe', 'paywall', 'account'))} AND NOT {O.any_of('lower(summary)', (*DEFAULT.hints, 'proprietary'))} AND regexp_replace(lower({O.part('url', 2)}), '^www[.]', '') NOT IN {O.values(sorted(DEFAULT.no_search))}",
)(lambda spark, d: suggestions.filter_suggestions(load(spark, d, "documents").selectExpr(*_SUG)).select("doc_id", "url"))
register("result_replacement", f"{R}, b AS (SELECT url AS replaces, concat('https://new.example/', CAST(seq AS STRING)) AS url, 200 AS status, seq + 1000000 AS seq FROM r WHERE status = 404) SELECT seq, url, status FROM r WHERE url NOT IN (SELECT replaces FROM b) UNION ALL SELECT seq, url, status FROM b")(
    lambda spark, d: entries.replace_results(results(spark, d).select("seq", "url", "status"), results(spark, d).where("status = 404").select(u.alias("replaces"), F.concat(F.lit("https://new.example/"), F.col("seq").cast("string")).alias("url"), F.lit(200).alias("status"), (F.col("seq") + 1000000).alias("seq")))
)
register("inventory_update", f"{R}, n AS (SELECT url AS old, max(concat('https://new.example/', CAST(seq AS STRING))) AS new_url FROM r WHERE status = 404 GROUP BY url) SELECT r.seq, coalesce(n.new_url, r.url) AS url, CASE WHEN n.new_url IS NOT NULL THEN r.url END AS original_url FROM r LEFT JOIN n ON r.url = n.old")(
    lambda spark, d: entries.inventory_update(results(spark, d).select("seq", "url", F.lit(None).cast("string").alias("original_url")), results(spark, d).where("status = 404").select("url", F.concat(F.lit("https://new.example/"), F.col("seq").cast("string")).alias("new_url")))
)
register("context_join", "WITH c AS (SELECT conv_id AS id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id) SELECT d.doc_id, c.role, c.turn FROM documents d LEFT JOIN c ON c.id = d.doc_id")(
    lambda spark, d: load(spark, d, "documents").select("doc_id").join(entries.keep_last(load(spark, d, "conversations").select(F.col("conv_id").alias("id"), "role", "turn"), "id", "turn"), F.col("doc_id") == F.col("id"), "left").select("doc_id", "role", "turn")
)

# == hubs and fan-out

_bodyless = "html"
for _t in content.CHROME:
    _bodyless = f"regexp_replace({_bodyless}, '(?is)<{_t}[^>]*>.*?</{_t}>', ' ', 'g')"
PREFIXES, APPROVED = {"github.com": ("/org/repo/blob/",), "docs.example.gov": ("/x1", "/x2")}, ("mitre.org", "example.com")
# a hub for each page whose children are the page's own URL under other paths and the result's URL
_kids = ["url AS parent_url", "seq", "concat('https://', CASE seq % 3 WHEN 0 THEN 'a.mitre.org' WHEN 1 THEN 'github.com' ELSE 'docs.example.gov' END, CASE seq % 4 WHEN 0 THEN '/org/repo/blob/' WHEN 1 THEN '/x1/' ELSE '/y/' END, CAST(seq % 50 AS STRING)) AS link"]


def _children(spark, d):
    h = results(spark, d).selectExpr("url", "seq", f"array({_kids[2].removesuffix(' AS link')}) AS links")
    return entries.fan_out(h, results(spark, d).select("url"), PREFIXES, APPROVED)


_same = lambda a, b: f"({a} = {b} OR ends_with({a}, concat('.', {b})))"
KIDS = f"""{R}, l0 AS (SELECT {", ".join(_kids)} FROM r), l1 AS (SELECT *, {O.normalize_url("link")} AS u FROM l0), known AS (SELECT DISTINCT {O.normalize_url("url")} AS k FROM r), l2 AS (SELECT * FROM l1 ANTI JOIN known ON l1.u = known.k),
l3 AS (SELECT *, {O.host("parent_url")} AS base, {O.host("u")} AS own, {O.suffix(O.host("parent_url"), APPROVED)} AS ok, {O.part("u", 3)} AS p FROM l2),
l4 AS (SELECT *, CASE WHEN own <> '' AND own <> base AND ok IS NOT NULL AND NOT {_same("own", "ok")} THEN 'domain_not_allowed' WHEN base = 'github.com' THEN CASE WHEN NOT starts_with(p, '/org/repo/blob/') THEN 'path_not_allowed' END
 WHEN base = 'docs.example.gov' THEN CASE WHEN NOT (starts_with(p, '/x1') OR starts_with(p, '/x2')) THEN 'path_not_allowed' END WHEN ok IS NOT NULL THEN CASE WHEN own = '' OR NOT {_same("own", "ok")} THEN 'domain_not_allowed' END ELSE 'no_allowlist' END AS reason FROM l3),
kid AS (SELECT parent_url, u AS url, reason IS NULL AS kept, reason FROM (SELECT *, row_number() OVER (PARTITION BY u, reason IS NULL ORDER BY seq) AS rk FROM l4) WHERE rk = 1 OR reason IS NOT NULL)"""
register("hub_fanout_children", f"{KIDS} SELECT parent_url, url, kept, reason FROM kid")(_children)
register("fanout_drop_reasons", f"{KIDS} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM kid GROUP BY 1")(lambda spark, d: reports.drop_reasons(_children(spark, d)))
# on these pages the tree and the profile agree about links outside of chrome
_anch = rf"regexp_extract_all({_bodyless}, '(?is)<a\b[^>]*href=[^>]*>', 0)"
register("hub_flag", f"SELECT page_id, len({_anch}) >= {DEFAULT.hub_links} AND length({O.visible('html')}) <= {DEFAULT.hub_body} AS is_hub FROM pages")(
    lambda spark, d: load(spark, d, "pages").select("page_id", dom.features(F.col("html"), u, fields=("hub",)).alias("x")).select("page_id", F.col("x.hub.is_hub").alias("is_hub"))
)


def _dom(spark, d, field, *cols):
    return results(spark, d).select("seq", dom.features(F.concat(F.lit("<h2>Definition of terms</h2><p>Some deprecated text for a longer notice here.</p><a href='/doc/a.pdf'>a</a>"), t), u, fields=field).alias("x")).select("seq", *cols)


register("dom_features")(lambda spark, d: _dom(spark, d, ("hub", "overlays"), "x.hub.is_hub", "x.hub.n_links", "x.hub.body_chars", "x.hub.link_text_chars", F.size("x.overlays").alias("n_overlays")))
register("structured_definition")(lambda spark, d: _dom(spark, d, ("definition",), "x.definition"))
register("deprecation_notice")(lambda spark, d: _dom(spark, d, ("deprecation",), "x.deprecation"))
register("pdf_links", f"{R} SELECT seq, concat({f'lower({O.part("url", 1)})'}, '://', {O.host('url')}, '/doc/a.pdf') AS links FROM r")(lambda spark, d: _dom(spark, d, ("pdf_links",), joined("x.pdf_links").alias("links")))
register("hub_links")(lambda spark, d: load(spark, d, "pages").select("page_id", dom.features(F.col("html"), u, fields=("hub",)).alias("x")).select("page_id", joined("x.hub.links").alias("links"), F.col("x.hub.title").alias("title")))
register("markdown")(lambda spark, d: load(spark, d, "pages").select("page_id", dom.features(F.col("html"), u, fields=("markdown",)).alias("x")).select("page_id", "x.markdown"))
register("fit_markdown")(lambda spark, d: load(spark, d, "pages").select("page_id", dom.fit_markdown(F.col("html"), F.array(F.lit("main"), F.lit("article"))).alias("markdown")))

register("markdown_overlap")(
    lambda spark, d: reports.compare_markdown(load(spark, d, "pages").select("page_id", "html", dom.features(F.col("html"), u, fields=("markdown",)).alias("x")).select("page_id", "html", F.col("x.markdown").alias("markdown"))).select("page_id", "token_jaccard", joined("shared_h1").alias("shared"))
)

# == reports

register(
    "failure_summary",
    f"{F_STEPS}, x AS (SELECT CAST(status AS VARCHAR) AS s, verdict AS v, coalesce({O.fallback_reason('status', 'text')}, 'none') AS b FROM j) SELECT CASE WHEN grouping(s) = 0 THEN 'status' WHEN grouping(v) = 0 THEN 'verdict' ELSE 'reason' END AS kind, coalesce(s, v, b) AS value, count(*) AS n FROM x GROUP BY GROUPING SETS ((s), (v), (b))",
)(lambda spark, d: reports.failure_summary(annotated(spark, d)))
_ok = "(status = 200 AND length(clean) > 0)"
register("run_metrics", f"{F_STEPS} SELECT count(*) AS total, count_if({_ok}) AS success, count_if(NOT {_ok}) AS failed, count_if(proxy_attempted) AS proxy_attempted, count_if(proxy_used) AS proxy_used FROM j")(lambda spark, d: reports.run_metrics(annotated(spark, d)))
register("fallback_counts", f"{R}, p AS (SELECT unnest(string_split(CASE WHEN from_cache THEN 'cache' WHEN method IN ('file', 'github_cli') THEN method ELSE {_steps} END, ',')) AS step FROM r) SELECT step, count(*) AS n FROM p WHERE step <> 'aiohttp' GROUP BY step")(
    lambda spark, d: reports.fallback_counts(results(spark, d).withColumn("fetch_path", _path()))
)
register("audit_counts", f"{F_STEPS} SELECT count(*) AS requested, count_if({_ok}) AS fetched, count_if(status <> 200) AS failed, count_if(from_cache) AS cache_hits FROM j")(lambda spark, d: reports.audit_counts(annotated(spark, d)))
_EV = ["event_type AS domain", "CASE event_id % 10 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 500 ELSE 200 END AS status", "event_id AS seq"]
EV = f"WITH e AS (SELECT {', '.join(_EV)} FROM events)"


def _events(spark, d):
    return load(spark, d, "events").selectExpr(*_EV)


register("rate_limits", f"{EV}, g AS (SELECT domain, count(*) AS requests, count_if(status = 429) AS rate_limited FROM e GROUP BY domain) SELECT *, round(rate_limited / requests, 3) AS rate_limited_pct, round(requests / 3600.0::DOUBLE, 3) AS rps FROM g")(lambda spark, d: reports.rate_limits(_events(spark, d), 3600.0))
register(
    "batch_health_runs",
    f"{EV}, b AS (SELECT *, (status <> 200)::INTEGER AS bad FROM e), w AS (SELECT domain, seq, bad, count(*) OVER o AS completed, sum(bad) OVER o AS failed, sum(1 - bad) OVER o AS island FROM b WINDOW o AS (PARTITION BY domain ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT domain, seq, completed, failed::BIGINT AS failed, (sum(bad) OVER (PARTITION BY domain, island ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS error_run FROM w",
)(lambda spark, d: reports.batch_health(_events(spark, d), "domain"))
register("junk_summary", f"{F_STEPS}, k AS (SELECT * FROM j WHERE verdict <> 'ok') SELECT NULL AS domain, verdict, count(*) AS n FROM k GROUP BY verdict UNION ALL SELECT domain, verdict, count(*) FROM k WHERE domain <> '' GROUP BY domain, verdict")(lambda spark, d: reports.junk_summary(annotated(spark, d)))
register("junk_examples_topk", f"{F_STEPS}, k AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY seq) AS rank FROM j WHERE verdict <> 'ok') SELECT verdict, rank::INTEGER AS rank, url, domain, status, junk_reason FROM k WHERE rank <= {DEFAULT.junk_examples}")(lambda spark, d: reports.junk_examples(annotated(spark, d)))
register("junk_table", f"{F_STEPS} SELECT verdict, CAST(status AS VARCHAR) AS status, domain, junk_reason, url, array_to_string(reasons, ', ') AS content_reasons FROM j WHERE verdict <> 'ok' ORDER BY verdict, domain, CAST(status AS VARCHAR), url LIMIT {DEFAULT.junk_rows}")(lambda spark, d: reports.junk_table(annotated(spark, d)))
register("pdf_paywall_mismatch", f"{ANN} SELECT seq, url, paywall_verdict, verdict FROM ann WHERE pdf_extracted AND (paywall_verdict IN ('likely', 'maybe', 'paywalled') OR verdict = 'paywall')")(lambda spark, d: reports.pdf_mismatches(annotated(spark, d)))
_got = "(j.status = 200 AND length(j.clean) > 0)"
_blobbed = "coalesce(length(j.clean) > 0, false)"
_scripted = "(NOT j.from_cache AND j.method NOT IN ('file', 'github_cli') AND j.seq % 3 = 0 AND j.seq % 9 <> 0)"
ITEMS = f"{ANN}, item AS (SELECT p.page_id AS consumer_id, p.url, CASE WHEN j.seq IS NULL THEN 'missing_result' WHEN NOT {_got} THEN 'failed' WHEN j.verdict <> 'ok' THEN 'junk' ELSE 'ok' END AS verdict, CASE WHEN j.paywall_verdict IN ('unlikely', 'safe') THEN 'ok' WHEN j.paywall_verdict IN ('likely', 'maybe') THEN 'paywalled' END AS paywall, coalesce(j.url, p.url) AS final_url, coalesce({_scripted}, false) AS used_playwright, {_blobbed} AS downloaded FROM pages p LEFT JOIN (SELECT *, CASE WHEN NOT from_cache THEN seq END AS cid FROM ann) j ON p.page_id = j.cid)"


def _items(spark, d):
    e = load(spark, d, "pages").select(F.col("page_id").alias("consumer_id"), "url")
    return reports.summary_items(e, store.with_blob(annotated(spark, d)).withColumn("fetch_path", _path()).withColumn("consumer_id", F.when(~F.col("from_cache"), F.col("seq"))))


register("summary_items", f"{ITEMS} SELECT * FROM item")(_items)
register("walkthrough", f"{ITEMS} SELECT consumer_id, concat('## Item ', consumer_id + 1, E'\\nurl: ', url, E'\\nfinal_url: ', final_url, E'\\nverdict: ', verdict, E'\\npaywall: ', coalesce(paywall, 'none')) AS block FROM item")(lambda spark, d: reports.walkthrough(_items(spark, d)))
register("summary_counts", f"{ITEMS} SELECT count(*) AS total, count_if(verdict = 'ok') AS ok, count_if(verdict IN ('failed', 'missing_result')) AS failed, count_if(verdict = 'junk') AS junk, count_if(url <> final_url) AS used_alternates, count_if(used_playwright) AS used_playwright, count_if(downloaded) AS downloaded FROM item")(lambda spark, d: reports.summary_counts(_items(spark, d)))
_sv, _bv = f"lower({O.part(O.strip('url'), 1)})", O.strip("url")
_bad = f"({_bv} = '' OR {_sv} NOT IN ('http', 'https', 'file') OR ({_sv} <> 'file' AND {O.part(_bv, 2)} = '') OR ({_sv} = 'file' AND {O.part(_bv, 3)} = ''))"
register("dry_run_counts", f"{R}, x AS (SELECT {RAW} AS url FROM r), v AS (SELECT {_bad} AS bad, {O.safe_domain(O.host('url'))} AS safe, {O.host('url')} AS h FROM x) SELECT count(*) AS total, count_if(NOT bad) AS valid, count_if(bad) AS invalid, count_if(NOT bad AND safe) AS safe, count_if(NOT bad AND NOT safe AND h IN {O.values(sorted(DEFAULT.gated))}) AS resolver_candidates FROM v")(
    lambda spark, d: run.dry_run(results(spark, d).select(F.expr(RAW).alias("url")))
)
register("proxy_counters", f"{R} SELECT method AS domain, concat('status_', CAST(status AS STRING)) AS proxy_reason, count(*) AS attempted, count_if(proxy_used) AS succeeded FROM r WHERE proxy_attempted GROUP BY 1, 2")(
    lambda spark, d: reports.proxy_counters(results(spark, d).select(F.col("method").alias("domain"), F.when(F.col("proxy_attempted"), F.concat(F.lit("status_"), st.cast("string"))).alias("proxy_reason"), "proxy_used"))
)

# == state and storage

# each document is fetched twice, half of them with another text the second time; the state knows some texts and has others for the rest
_CH = "SELECT concat('http://Site', CAST(doc_id AS STRING), '.example.com/') AS url, text, '2025-01-01' AS fetched_at, doc_id AS seq FROM documents UNION ALL SELECT concat('HTTP://site', CAST(doc_id AS STRING), '.example.com/'), CASE WHEN doc_id % 2 = 0 THEN text ELSE concat(text, ' again') END, '2025-01-02', doc_id + 10000000 FROM documents"
_ST = "SELECT concat('http://site', CAST(doc_id AS STRING), '.example.com/') AS url_norm, CASE WHEN doc_id % 3 = 0 THEN {sha} ELSE 'other' END AS sha, CAST(length(text) AS INT) AS length, '2024-12-31' AS fetched_at, substr(text, 1, 800) AS sample FROM documents"
CH = f"WITH st AS ({_ST.format(sha='sha256(text)')}), c AS ({_CH}), n AS (SELECT *, {O.normalize_url('url')} AS url_norm, CASE WHEN length(text) > 0 THEN sha256(text) END AS sha FROM c), w AS (SELECT n.*, CASE WHEN n.sha IS NOT NULL THEN coalesce(lag(n.sha) OVER o, st.sha) END AS before, CASE WHEN n.sha IS NOT NULL THEN coalesce(lag(length(n.text)) OVER o, st.length) END AS len_before FROM n LEFT JOIN st ON n.url_norm = st.url_norm WINDOW o AS (PARTITION BY n.url_norm, n.sha IS NULL ORDER BY n.fetched_at, n.seq))"


def _state(spark, d):
    return spark.sql(_ST.format(sha="sha2(text, 256)").replace("FROM documents", "FROM {docs}"), docs=load(spark, d, "documents"))


def _changes(spark, d):
    return changes.detect_changes(spark.sql(_CH.replace("FROM documents", "FROM {docs}"), docs=load(spark, d, "documents")), _state(spark, d))


register("content_change", f"{CH} SELECT seq, url_norm, sha AS content_sha256, before AS content_previous_sha256, len_before AS content_previous_len, CASE WHEN sha IS NOT NULL THEN coalesce(sha <> before, true) END AS content_changed FROM w")(
    lambda spark, d: _changes(spark, d).select("seq", "url_norm", "content_sha256", "content_previous_sha256", F.col("content_previous_len").cast("long"), "content_changed")
)
register("change_feed", f"{CH} SELECT seq, url_norm FROM w WHERE sha IS NOT NULL AND coalesce(sha <> before, true)")(lambda spark, d: changes.change_feed(_changes(spark, d)).select("seq", "url_norm"))
register("content_state", f"{CH} SELECT url_norm, arg_max(sha, fetched_at || lpad(CAST(seq AS VARCHAR), 12, '0')) AS sha FROM n WHERE sha IS NOT NULL GROUP BY url_norm UNION ALL SELECT url_norm, sha FROM st WHERE url_norm NOT IN (SELECT url_norm FROM n WHERE sha IS NOT NULL)")(lambda spark, d: changes.next_state(_changes(spark, d), _state(spark, d)).select("url_norm", "sha"))
register("diff_ratio")(lambda spark, d: changes.with_diff_ratio(_changes(spark, d)).select("seq", "content_diff_ratio"))
_D = "SELECT doc_id AS seq, concat('http://h/', CAST(doc_id AS STRING), '.txt') AS url, 'text/plain' AS content_type, text FROM documents"


def _docs(spark, d):
    return load(spark, d, "documents").selectExpr("doc_id AS seq", "concat('http://h/', CAST(doc_id AS STRING), '.txt') AS url", "'text/plain' AS content_type", "text")


INLINE = _replace(DEFAULT, inline_bytes=2000)
register("externalize_text", f"WITH x AS ({_D}) SELECT seq, strlen(text) > 2000 AS text_externalized, CASE WHEN strlen(text) > 2000 THEN concat(sha256(text), '.txt') END AS text_path, strlen(text) AS text_inline_bytes, length(text) AS text_length_chars FROM x")(
    lambda spark, d: store.externalize(_docs(spark, d), INLINE)[0].select("seq", "text_externalized", "text_path", F.col("text_inline_bytes").cast("long"), F.col("text_length_chars").cast("long"))
)
register("blob_dedupe", f"WITH x AS ({_D}) SELECT sha256(text) AS sha256, max(strlen(text)) AS size, concat(sha256(text), '.txt') AS filename, min(seq) AS first_seq FROM x WHERE length(text) > 0 GROUP BY sha256(text)")(lambda spark, d: store.blobs(_docs(spark, d)).withColumn("size", F.col("size").cast("long")))
CACHE = f"{R}, c AS (SELECT CASE WHEN seq % 2 = 0 THEN {O.normalize_url('url')} ELSE concat(url, '#other') END AS key, max(CAST(seq AS STRING)) AS value FROM r GROUP BY 1)"


def _cache(spark, d):
    return results(spark, d).groupBy(F.when(F.col("seq") % 2 == 0, urls.normalize_url(u)).otherwise(F.concat(u, F.lit("#other"))).alias("key")).agg(F.max(F.col("seq").cast("string")).alias("value"))


register("cache_lookup", f"{CACHE} SELECT r.seq, CASE WHEN r.method <> 'file' THEN coalesce(a.value, b.value) END AS cached FROM r LEFT JOIN c a ON a.key = {O.normalize_url('r.url')} LEFT JOIN c b ON b.key = r.url")(
    lambda spark, d: store.cache_lookup(results(spark, d).select("seq", "url", "method"), _cache(spark, d), F.col("method") == "file").select("seq", "cached")
)
register("cache_prune", "SELECT event_id AS key, concat(strftime(ts, '%Y-%m-%d'), ' ', strftime(ts, '%H:%M:%S.%f')) AS fetched_at FROM events ORDER BY ts DESC, event_id LIMIT 5000")(
    lambda spark, d: store.cache_prune(load(spark, d, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("fetched_at"))).select("key", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fetched_at"))
)
register("cache_upsert", f"{R} SELECT {O.host('url')} AS key, max(fetched_at) AS fetched_at FROM r GROUP BY 1")(
    lambda spark, d: store.cache_upsert(*(results(spark, d).where(c).groupBy(urls.host(u).alias("key")).agg(F.max("fetched_at").alias("fetched_at")) for c in ("status = 200", "status <> 200"))).select("key", "fetched_at")
)
register("persist_downloads", f"{F_STEPS} SELECT seq, url, CASE WHEN length(clean) > 0 THEN sha256(clean) END AS blob_sha256, CASE WHEN length(clean) = 0 THEN 'download_missing_no_payload' END AS error FROM j WHERE verdict = 'ok'")(lambda spark, d: store.persist_downloads(annotated(spark, d)).select("seq", "url", "blob_sha256", "error"))

_X = "CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN text END"
register("raw_text", f"{R}, x AS (SELECT seq, text AS kept, sha256(text) AS sha, {_X} AS text FROM r) SELECT seq, sha256(CASE WHEN coalesce(text, '') <> '' THEN text WHEN length(kept) > 0 THEN kept END) AS raw_sha FROM x")(
    lambda spark, d: store.raw_text(
        results(spark, d).select("seq", F.when(F.length("text") > 0, F.concat(F.sha2("text", 256), F.lit(".txt"))).alias("text_path"), F.expr(_X).alias("text")),
        results(spark, d).where("length(text) > 0").select(F.sha2("text", 256).alias("sha256"), "text").dropDuplicates(["sha256"]),
    ).select("seq", F.sha2("raw_text", 256).alias("raw_sha"))
)

# == windows

register("sentences", f"WITH {O.SENTENCE_STEPS} SELECT doc_id, i::INTEGER AS i, s::INTEGER AS s, e::INTEGER AS e FROM sent")(
    lambda spark, d: load(spark, d, "documents").select("doc_id", F.explode(windows.sentences("text")).alias("x")).select("doc_id", "x.i", "x.s", "x.e")
)
register("rolling_windows", O.windows_sql())(lambda spark, d: windows.explode_windows(load(spark, d, "documents"), "doc_id", t).withColumn("text_sha", F.sha2("text", 256)).drop("text"))

# == event time

register("event_rates", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(
    lambda spark, d: live.rates(load(spark, d, "events")).withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
)
register(
    "event_sessions",
    "WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e) SELECT key, min(ts) AS session_start, count(*) AS n FROM s GROUP BY key, sid",
)(lambda spark, d: live.sessions(load(spark, d, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz")))

from . import catalogue_more  # noqa: E402, F401

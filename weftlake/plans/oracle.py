"""DuckDB SQL for the registered queries, written on its own from the same policy."""

from __future__ import annotations

from ..functions.content import CHROME, SPACE
from ..functions.paywall import META, OVERLAY
from ..functions.urls import _GUESS, _RELIABLE, BLANK, PARTS
from ..policy import DEFAULT, Policy


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(items) -> str:
    return "(" + ", ".join(q(i) if isinstance(i, str) else str(i) for i in items) + ")"


def any_of(c: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(t)})" for t in tokens) + ")"


def all_of(c: str, tokens) -> str:
    return "(" + " AND ".join(f"contains({c}, {q(t)})" for t in tokens) + ")"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}|{BLANK}$', '', 'g')"


def part(u: str, k: int) -> str:
    return f"regexp_extract({u}, {q(PARTS)}, {k})"


def host(u: str) -> str:
    last = f"regexp_replace({part(u, 2)}, '^.*@', '')"
    return rf"lower(CASE WHEN starts_with({last}, '[') THEN regexp_extract({last}, '^\[([^\]]*)', 1) ELSE regexp_extract({last}, '^([^:]*)', 1) END)"


def tail(u: str) -> str:
    return f"concat(CASE WHEN {part(u, 4)} <> '' THEN concat('?', {part(u, 4)}) ELSE '' END, CASE WHEN {part(u, 5)} <> '' THEN concat('#', {part(u, 5)}) ELSE '' END)"


def joined(scheme: str, auth: str, path: str, end: str) -> str:
    return f"concat(CASE WHEN {scheme} <> '' THEN concat({scheme}, ':') ELSE '' END, CASE WHEN {auth} <> '' THEN concat('//', {auth}) ELSE '' END, {path}, {end})"


def normalize_url(u: str) -> str:
    s = strip(f"coalesce({u}, '')")
    auth = f"CASE WHEN {host(s)} <> '' THEN {host(s)} ELSE {part(s, 2)} END"
    port = rf"regexp_extract(regexp_replace({part(s, 2)}, '^.*@', ''), ':([^:\]]*)$', 1)"
    clean_path = f"regexp_replace({part(s, 3)}, '{BLANK}', '', 'g')"
    return f"CASE WHEN regexp_matches({port}, '[^0-9]') THEN {s} ELSE {joined(f'lower({part(s, 1)})', f'({auth})', clean_path, tail(s))} END"


def normalize_domain(d: str, policy: Policy = DEFAULT) -> str:
    low = rf"lower(regexp_replace({strip(f'coalesce({d}, {q('')})')}, '\.+$', ''))"
    return rf"CASE WHEN len(string_split({low}, '.')) > 2 AND string_split({low}, '.')[1] IN {values(policy.strip_labels)} THEN regexp_replace({low}, '^[^.]*\.', '') ELSE {low} END"


def suffix(h: str, allowed) -> str:
    tokens = sorted({t.lower().lstrip(".") for t in allowed}, key=lambda t: (-len(t), t))
    low = rf"regexp_replace(lower({h}), '\.+$', '')"
    return "CASE " + " ".join(f"WHEN {low} = {q(t)} OR ends_with({low}, {q('.' + t)}) THEN {q(t)}" for t in tokens) + " END"


def safe_domain(d: str, policy: Policy = DEFAULT) -> str:
    n = f"({normalize_domain(d, policy)})"
    return f"({n} <> '' AND ({n} IN {values(sorted(policy.trusted))} OR {' OR '.join(f'ends_with({n}, {q(s)})' for s in policy.trusted_suffixes)}))"


def soft_404(t: str, policy: Policy = DEFAULT) -> str:
    low = f"lower(coalesce({t}, ''))"
    whens = " ".join(f"WHEN {all_of(low, tokens)} THEN {q(name)}" for name, tokens in policy.soft_404)
    return f"CASE {whens} WHEN {any_of(low, policy.soft_404[0][1])} THEN 'github_pages_404' WHEN contains({low}, 'page not found') AND contains({low}, 'requested url') THEN 'generic_not_found' END"


def fallback_reason(s: str, t: str, policy: Policy = DEFAULT) -> str:
    low, body = f"lower(coalesce({t}, ''))", f"coalesce({t}, '')"
    return f"""CASE WHEN ({soft_404(t, policy)}) IS NOT NULL THEN 'soft_404' WHEN {s} = 429 THEN 'rate_limited_429'
 WHEN {any_of(low, ("cloudflare", "cf-error-details", "error 1020"))} THEN 'cloudflare_block_page' WHEN {any_of(low, policy.bot_tokens)} THEN 'bot_blocked'
 WHEN {s} = 200 AND length({strip(body)}) < 100 THEN 'empty_payload' WHEN {s} IN (401, 403, 404, 500, 503) THEN 'http_error_retry_exhausted' END"""


def visible(h: str, without=CHROME) -> str:
    out = f"coalesce({h}, '')"
    for tag in without:
        out = f"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{sign}')"
    return f"trim(regexp_replace({out}, '{SPACE}', ' ', 'g'))"


def anchor_chars(h: str) -> str:
    one = f"length(trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '{SPACE}', ' ', 'g')))"
    return rf"coalesce(list_sum(list_transform(regexp_extract_all(coalesce({h}, ''), '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda x: {one})), 0)"


def markers(t: str, policy: Policy = DEFAULT) -> str:
    return f"list_filter([{', '.join(q(m) for m in policy.markers)}], lambda m: contains(lower(coalesce({t}, '')), m))"


def verdict(n: str, d: str, k: str, p: Policy = DEFAULT) -> str:
    return f"""CASE WHEN {n} >= {p.article_chars} AND {k} < {p.gate_markers} THEN 'ok' WHEN {n} < {p.article_chars} AND {k} >= {p.gate_markers} THEN 'paywall'
 WHEN {n} < {p.article_chars} AND {d} > {p.link_density} THEN 'link_hub' WHEN {n} < {p.weak_chars} THEN 'thin' ELSE 'weak' END"""


#: The pages, whole, and as many more rows with an empty or a short body.
PAGES = (
    "SELECT page_id, url, html, false AS stub FROM pages UNION ALL "
    "SELECT page_id + 10000000, concat(url, '/stub'), CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '<p>Members only. Please log in to continue.</p>' ELSE concat('<p>A short page with the number ', CAST(page_id AS STRING), '.</p>') END, true FROM pages"
)
#: Result rows derived from those, the same expressions in both dialects.
RESULT = {
    "seq": "page_id",
    "url": "CASE page_id % 10 WHEN 0 THEN concat('https://github.com/org/repo/blob/v1/docs/f', CAST(page_id AS STRING), '.txt') WHEN 1 THEN concat('https://www.attack.mitre.org/t/', CAST(page_id AS STRING)) WHEN 2 THEN concat('https://www.nytimes.com/a/', CAST(page_id AS STRING), '.html') "
    "WHEN 3 THEN concat('https://docs.example.gov/x', CAST(page_id AS STRING), '.pdf') WHEN 4 THEN concat('https://capec.mitre.org/community/registration', CAST(page_id AS STRING), '.html') ELSE url END",
    "status": "CASE page_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 401 WHEN 5 THEN -1 ELSE 200 END",
    "content_type": "CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/plain' ELSE 'application/pdf' END",
    "text": "concat(html, CASE WHEN stub THEN '' ELSE CASE page_id % 11 WHEN 0 THEN ' Please subscribe or log in to continue reading. Members only.' WHEN 1 THEN ' Cloudflare error 1020 Access denied. You are unable to access' "
    "WHEN 2 THEN ' The site configured at this address' WHEN 3 THEN '<noscript>Subscription required</noscript>' WHEN 4 THEN ' Too many requests, temporarily blocked' WHEN 5 THEN ' Page not found. The requested URL is gone' "
    "WHEN 6 THEN ' Copyright. All rights reserved. Subscribe for unlimited access' WHEN 7 THEN '<div class=\"paywall\"></div> piano out of credits' ELSE '' END END)",
    "method": "CASE page_id % 6 WHEN 0 THEN 'file' WHEN 1 THEN 'wayback' WHEN 2 THEN 'youtube-skill' ELSE 'aiohttp' END",
    "fetched_at": "concat('2025-01-', CAST(10 + page_id % 19 AS STRING))",
    "from_cache": "page_id % 12 = 0",
    "proxy_used": "page_id % 14 = 1",
    "proxy_attempted": "page_id % 7 = 1",
    "via": "CASE page_id % 15 WHEN 2 THEN 'Jina' WHEN 3 THEN 'wayback' ELSE '' END",
    "pdf_extracted": "page_id % 8 = 3",
    "pdf_locked": "page_id % 16 = 7",
}
R = "WITH r AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RESULT.items()) + f" FROM ({PAGES}))"


def feature_steps(policy: Policy = DEFAULT) -> str:
    """CTEs f (features) and g (gate) after r."""
    community = f"({host('url')} LIKE '%capec.mitre.org' AND contains({part('url', 3)}, '/community/'))"
    closed = f"({community} AND regexp_matches(lower({part('url', 3)}), 'registration|signup|sign-up|login'))"
    gone = lambda c, *names: f"list_filter({c}, lambda z: z NOT IN {values(names)})"
    return f""",
f0 AS (SELECT *, lower(content_type) AS ct, {strip("text")} = '' AS empty, CASE WHEN contains(lower(content_type), 'html') THEN {visible("text")} ELSE {strip("text")} END AS body FROM r),
f1 AS (SELECT *, length(body) AS n, CASE WHEN contains(ct, 'html') AND length(body) > 0 THEN least(1.0::DOUBLE, {anchor_chars("text")} / length(body)) ELSE 0.0::DOUBLE END AS d,
  CASE WHEN contains(ct, 'pdf') OR body = '' THEN [] ELSE {markers("body", policy)} END AS m FROM f0),
f2 AS (SELECT *, CASE WHEN empty THEN 'thin' ELSE {verdict("n", "d", "len(m)", policy)} END AS v0 FROM f1),
f3 AS (SELECT *, CASE WHEN empty THEN ['empty_body'] WHEN v0 = 'paywall' THEN ['paywall_markers'] WHEN v0 = 'link_hub' THEN ['high_link_density'] WHEN v0 = 'thin' THEN ['too_short'] WHEN v0 = 'weak' THEN ['weak_content'] ELSE [] END AS r0,
  NOT empty AND v0 IN ('link_hub', 'weak') AND ({suffix(host("url"), policy.link_heavy)}) IS NOT NULL AS heavy, NOT empty AND {community} AS community, NOT empty AND {closed} AS closed FROM f2),
f4 AS (SELECT *, CASE WHEN heavy THEN 'ok' ELSE v0 END AS v2, CASE WHEN heavy THEN list_concat({gone("r0", "weak_content", "low_body_text")}, ['link_heavy_allow']) ELSE r0 END AS r2 FROM f3),
f AS (SELECT *, CASE WHEN closed THEN 'paywall' ELSE v2 END AS fv, CASE WHEN closed THEN list_concat(r2, ['registration_required']) WHEN community AND v2 IN ('link_hub', 'thin', 'weak') THEN list_concat(r2, ['community_portal']) ELSE r2 END AS fr,
  CASE WHEN empty THEN 0.0 ELSE least(1.0::DOUBLE, n / {policy.article_chars}::DOUBLE) END AS fs, CASE WHEN empty THEN 0 ELSE n END AS fn FROM f4),
g0 AS (SELECT *, contains(ct, 'pdf') OR pdf_extracted AS is_pdf, ends_with(lower(url), '.pdf') AS pdf_url FROM f),
g1 AS (SELECT *, is_pdf AND fn < {max(policy.weak_chars, policy.missing_file_chars)} AND {any_of("lower(CASE WHEN empty THEN '' ELSE body END)", policy.missing_file_tokens)} AS soft,
  pdf_url AND NOT contains(ct, 'pdf') AND NOT pdf_extracted AS mismatch, pdf_url AND status IN (404, 410) AND NOT pdf_extracted AS missing FROM g0),
g2 AS (SELECT *, CASE WHEN soft OR mismatch OR missing THEN 'missing_file' ELSE fv END AS gv0,
  CASE WHEN soft THEN list_concat({gone("fr", "too_short")}, ['pdf_soft_404']) ELSE fr END AS gr0 FROM g1),
g3 AS (SELECT *, CASE WHEN mismatch THEN list_concat({gone("gr0", "too_short")}, ['pdf_fetch_mismatch']) ELSE gr0 END AS gr1 FROM g2),
g4 AS (SELECT *, CASE WHEN missing THEN list_concat(gr1, ['pdf_status_error']) ELSE gr1 END AS gr2, is_pdf AND fn >= {policy.article_chars} AND gv0 IN ('paywall', 'weak') AS long_pdf FROM g3),
g5 AS (SELECT *, CASE WHEN long_pdf THEN 'ok' ELSE gv0 END AS gv1, CASE WHEN long_pdf THEN list_concat({gone("gr2", "too_short", "high_link_density", "weak_content", "paywall_markers")}, ['pdf_long_text_override']) ELSE gr2 END AS gr3 FROM g4),
g6 AS (SELECT *, method = 'youtube-skill' AND gv1 IN ('weak', 'thin') AND fn > 0 AS spoken FROM g5),
g AS (SELECT *, CASE WHEN pdf_locked THEN 'password_protected' WHEN spoken THEN 'ok' ELSE gv1 END AS verdict,
  CASE WHEN pdf_locked THEN ['pdf_password_protected'] WHEN spoken THEN list_concat({gone("gr3", "too_short", "weak_content")}, ['youtube_transcript_preserve']) ELSE gr3 END AS reasons FROM g6),
j AS (SELECT *, {host("url")} AS domain, status = 200 AND verdict = 'ok' AS usable,
  CASE WHEN status = 200 AND verdict = 'ok' THEN NULL WHEN status <> 200 THEN concat('http_status_', status) ELSE concat('content_verdict_', verdict) END AS junk_reason,
  CASE WHEN verdict = 'ok' THEN CASE WHEN empty THEN '' ELSE body END WHEN verdict = 'paywall' THEN text ELSE '' END AS clean FROM g)"""


def paywall_steps(source: str, policy: Policy = DEFAULT) -> str:
    """CTEs that end in pw(seq, score, pverdict, indicators, page_len, article_len) over ``source`` (seq, url, status, html)."""
    w, caps = policy.weights, policy.caps
    hits = lambda ps, t: f"list_filter([{', '.join(q(p) for p in sorted(ps))}], lambda z: regexp_matches({t}, concat('(?i)', z)))"
    terms = [
        ("payment_required", f"CASE WHEN status = 402 THEN {w['payment']} ELSE 0 END"), ("rate_limited", f"CASE WHEN status = 429 THEN {w['limited']} ELSE 0 END"),
        ("readability_gap", f"CASE WHEN page_len >= 1000 AND article_len < 400 AND article_len <= page_len * 0.2 THEN {w['gap']} ELSE 0 END"), ("short_body_stub", f"CASE WHEN page_len < 400 THEN {w['stub']} ELSE 0 END"),
        ("paywall_phrases", f"least(len(strong) * {w['strong']}, {caps['strong']})"), ("paywall_phrases_weak", f"least(len(soft) * {w['soft']}, {caps['soft']})"), ("vendor_markers", f"least(len(vendor) * {w['vendor']}, {caps['vendor']})"),
        ("overlay_dom", f"CASE WHEN regexp_matches(html, {q(OVERLAY)}) THEN {w['overlay']} ELSE 0 END"), ("legalese_plus_subscribe", rf"CASE WHEN len(legal) > 0 AND regexp_matches(seen, '(?i)\bsubscribe\b') THEN {w['legal']} ELSE 0 END"),
        ("noscript_paywall", f"CASE WHEN len(hidden_hits) > 0 THEN {w['noscript']} ELSE 0 END"), ("meta_paywall", f"CASE WHEN regexp_matches(html, {q(META)}) THEN {w['meta']} ELSE 0 END"),
    ]
    cols = ", ".join(f"({e})::DOUBLE AS t_{k}" for k, e in terms)
    gated = values(sorted(policy.gated))
    return rf"""
p0 AS (SELECT seq, url, status, coalesce(html, '') AS html FROM {source}),
p1 AS (SELECT *, {visible("html", ("script", "style", "noscript"))} AS seen, array_to_string(regexp_extract_all(html, '(?is)<noscript[^>]*>(.*?)</noscript>', 1), ' ') AS hidden,
  length({visible(r"array_to_string(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1), ' ')")}) AS article_len, lower({part("url", 2)}) AS d FROM p0),
p2 AS (SELECT *, length(seen) AS page_len, {hits(policy.strong, "seen")} AS strong, {hits(policy.soft, "seen")} AS soft, {hits(policy.vendors, "html")} AS vendor, {hits(policy.legal, "seen")} AS legal, {hits(policy.strong, "hidden")} AS hidden_hits,
  (d IN {values(sorted(policy.trusted))} OR {" OR ".join(f"ends_with(d, {q(s)})" for s in policy.trusted_suffixes)}) AS safe, CASE WHEN d IN {gated} OR regexp_replace(d, '^www\.', '') IN {gated} THEN {w["host"]} ELSE 0 END::DOUBLE AS t_host FROM p1),
p3 AS (SELECT *, {cols} FROM p2),
p4 AS (SELECT *, round(CASE WHEN safe THEN 0 WHEN status IN (401, 403, 451) THEN t_host + {w["unauthorized"]} ELSE t_host + ({" + ".join(f"t_{k}" for k, _ in terms)}) END, 6) AS score FROM p3),
pw AS (SELECT seq, score, CASE WHEN safe THEN 'unlikely' WHEN score >= {policy.likely} THEN 'likely' WHEN score >= {policy.maybe} THEN 'maybe' ELSE 'unlikely' END AS pverdict, page_len, article_len,
  CASE WHEN safe THEN 'safe_domain' ELSE array_to_string(list_filter([CASE WHEN t_host > 0 THEN 'paywall_domain' END, CASE WHEN status IN (401, 403, 451) THEN 'unauthorized_status' END, {", ".join(f"CASE WHEN status NOT IN (401, 403, 451) AND t_{k} > 0 THEN '{k}' END" for k, _ in terms)}], lambda z: z IS NOT NULL), ',') END AS indicators FROM p4)"""


SENTENCE_STEPS = r"""
tok AS (SELECT doc_id, pos, tok, (sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT - length(tok) AS o FROM
  (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '([^.!?]+[.!?]|[.!?]+|[^.!?]+$)', 1) AS t FROM documents))),
ended AS (SELECT doc_id, (o + length(tok) - length(ltrim(tok, E' \t\n\r\f'))) AS s, o + length(tok) AS e, pos FROM tok WHERE regexp_matches(tok, '^[^.!?]+[.!?]$')),
whole AS (SELECT doc_id, length(text) - length(ltrim(text, E' \t\n\r\f')) AS s, length(text) - length(ltrim(text, E' \t\n\r\f')) + length(trim(text, E' \t\n\r\f')) AS e, 1 AS pos FROM documents
  WHERE trim(text, E' \t\n\r\f') <> '' AND doc_id NOT IN (SELECT doc_id FROM ended)),
sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, s, e FROM (SELECT * FROM ended UNION ALL SELECT * FROM whole))"""


def windows_sql(policy: Policy = DEFAULT) -> str:
    return f"""WITH RECURSIVE {SENTENCE_STEPS},
per AS (SELECT doc_id, list(s ORDER BY i) AS ss, list(e ORDER BY i) AS es FROM sent GROUP BY doc_id),
win(doc_id, k, idx) AS (
  SELECT doc_id, 1, 0 FROM per
  UNION ALL
  SELECT w.doc_id, greatest(w.k + 1, len(list_filter(p.ss, lambda x: x < p.ss[w.k] + {policy.window_step})) + 1), w.idx + 1
  FROM win w JOIN per p ON p.doc_id = w.doc_id WHERE greatest(w.k + 1, len(list_filter(p.ss, lambda x: x < p.ss[w.k] + {policy.window_step})) + 1) <= len(p.ss))
SELECT w.doc_id, w.idx::INTEGER AS index, p.ss[w.k]::INTEGER AS start, greatest(p.es[w.k], list_max(list_filter(p.es, lambda x: x <= p.ss[w.k] + {policy.window_size})))::INTEGER AS "end",
  sha256(substr(d.text, p.ss[w.k] + 1, greatest(p.es[w.k], list_max(list_filter(p.es, lambda x: x <= p.ss[w.k] + {policy.window_size}))) - p.ss[w.k])) AS text_sha
FROM win w JOIN per p ON p.doc_id = w.doc_id JOIN documents d ON d.doc_id = w.doc_id"""


def blob_ext(u: str, ct: str) -> str:
    suffix_ = rf"regexp_extract({part(u, 3)}, '[^/.][^/]*?(\.[^/.]+)/*$', 1)"
    first = " ".join(f"WHEN {ct} = {q(k)} THEN {q(v)}" for k, v in _RELIABLE.items())
    last = " ".join(f"WHEN {ct} = {q(k)} THEN {q(v)}" for k, v in _GUESS.items())
    return rf"CASE {first} WHEN {suffix_} <> '' AND length({suffix_}) <= 10 AND NOT regexp_matches({suffix_}, '^\.[0-9]+$') THEN {suffix_} {last} ELSE '.bin' END"

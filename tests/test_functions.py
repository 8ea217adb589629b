"""Rules with one row for each branch."""

from urllib.parse import urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlake.functions import content, paywall, provenance, urls
from weftlake.operators import dom, suggestions
from weftlake.operators.windows import rolling, split_sentences
from weftlake.policy import DEFAULT
from weftlake.sources.readers import rule_id


def values(spark, f, inputs, *types):
    schema = ", ".join(f"c{k} {t}" for k, t in enumerate(types or ("string",)))
    data = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(inputs)]
    df = spark.createDataFrame(data, f"k int, {schema}")
    return [r[0] for r in df.orderBy("k").select(f(*(F.col(f"c{k}") for k in range(len(data[0]) - 1))).alias("v")).collect()]


def test_normalize(spark):
    cases = {
        "https://e.org/Dir/Deep/": "https://e.org/Dir/Deep/",
        "https://e.org/dir/ a b /c": "https://e.org/dir/ab/c",
        "http://u:p@ex.com:8443/x": "http://ex.com/x",
        " HTTP://EX.com ": "http://EX.com".lower(),
        "http://ex.com:abc/x": "http://ex.com:abc/x",
        "http://ex.com/?": "http://ex.com/",
        "http://ex.com/a?b=1#c": "http://ex.com/a?b=1#c",
        "http://[::1]:80/x": "http://::1/x",
        "": "",
        None: "",
    }
    assert values(spark, urls.normalize_url, list(cases)) == list(cases.values())


def test_parts_agree_with_the_standard_library(spark):
    cases = ["http://a.b/c?d#e", "https://A.b:1/c;p?q=1/2?3#f#g", "file:///tmp/x", "mailto:x@y", "//h/p", "p/q", "http://u@h", "?q", "#f"]
    got = values(spark, lambda c: F.struct(urls.scheme(c), urls.authority(c), urls.part(c, 4), urls.part(c, 5)), cases)
    assert [tuple(g) for g in got] == [(p.scheme, p.netloc, p.query, p.fragment) for p in map(urlparse, cases)]


def test_validate(spark):
    cases = {"http://": "missing_host", "ftp://example.com": "unsupported_scheme", "file://": "missing_path", "https://example.com": None, " ": "missing_url", None: "missing_url"}
    assert values(spark, urls.validate_url, list(cases)) == list(cases.values())


def test_code_host(spark):
    got = values(spark, lambda c: urls.code_host_request(c)["fetch_url"], ["https://github.com/o/r/blob/main/d/f.txt", "https://github.com/o/r", "https://raw.githubusercontent.com/o/r/x", "https://raw.githubusercontent.com/o/r/x/y"])
    assert got == ["https://raw.githubusercontent.com/o/r/main/d/f.txt", None, None, "https://raw.githubusercontent.com/o/r/x/y"]


def test_hosts(spark):
    assert values(spark, lambda c: urls.match_suffix(c, ("mitre.org",)), ["attack.mitre.org", "example.com", "notmitre.org"]) == ["mitre.org", None, None]
    assert values(spark, urls.is_safe_domain, ["test.example.gov", "medium.com", "www.arxiv.org", ""]) == [True, False, True, False]
    assert values(spark, urls.toggle_trailing_slash, ["http://h/a/", "http://h/a", "http://h/", "http://h"]) == ["http://h/a", "http://h/a/", "http://h/", "http://h"]


@pytest.mark.parametrize(
    ("body", "template"),
    [
        ("does not contain the requested file", "github_pages_404"),
        ("Cloudflare Error 1020 Access denied. You are unable to access x", "cloudflare_access_denied"),
        ("<Code>NoSuchKey</Code>", "s3_nosuchkey"),
        ("Page not found; the requested URL is gone", "generic_not_found"),
        ("a fine page", None),
        ("", None),
        (None, None),
    ],
)
def test_soft_404(spark, body, template):
    assert values(spark, provenance.soft_404, [body]) == [template]


def test_fallback_order(spark):
    long = "x" * 200
    cases = [(429, long), (200, long + "cloudflare"), (200, "you have been blocked" + long), (200, " tiny "), (503, long), (200, long), (200, "page not found requested url")]
    assert values(spark, provenance.fallback_reason, cases, "int", "string") == ["rate_limited_429", "cloudflare_block_page", "bot_blocked", "empty_payload", "http_error_retry_exhausted", None, "soft_404"]


def test_verdicts(spark):
    f = lambda n, d, k: content.verdict(n, d, F.sequence(F.lit(1), k))
    cases = [(1500, 0.9, 1), (1499, 0.0, 2), (1499, 0.5, 1), (399, 0.4, 1), (400, 0.4, 1), (1500, 0.0, 2)]
    assert values(spark, f, cases, "int", "double", "int") == ["ok", "paywall", "link_hub", "thin", "weak", "weak"]


def gate(spark, **row):
    base = dict(url="http://e.org/x") | dict(status=200, content_type="text/html") | dict(text="", method="aiohttp", pdf_extracted=False, pdf_locked=False, pdf_unlocked=False) | row
    df = spark.createDataFrame([tuple(base.values())], "url string, status int, content_type string, text string, method string, pdf_extracted boolean, pdf_locked boolean, pdf_unlocked boolean")
    r = content.with_gate(content.with_features(df)).first()
    return r["verdict"], r["reasons"], r["junk_reason"]


@pytest.mark.parametrize(
    ("row", "verdict", "reason"),
    [
        (dict(text="This is a sentence. " * 200), "ok", None),
        (dict(text="Subscribe to continue. Log in."), "paywall", "paywall_markers"),
        (dict(text="<a href='/x'>word</a>" * 50, url="https://attack.mitre.org/t"), "ok", "link_heavy_allow"),
        (dict(text="hello", url="//".join(("https:", "capec.mitre.org/community/a/login"))), "paywall", "registration_required"),
        (dict(text="subscribe login " * 200, content_type="application/pdf"), "ok", None),
        (dict(text="Page not found", content_type="application/pdf"), "missing_file", "pdf_soft_404"),
        (dict(text="<p>x</p>", url="http://e.org/a.pdf"), "missing_file", "pdf_fetch_mismatch"),
        (dict(text="x", url="http://e.org/a.pdf", content_type="application/pdf", status=404), "missing_file", "pdf_status_error"),
        (dict(text="x", pdf_locked=True), "password_protected", "pdf_password_protected"),
        (dict(text="short talk", content_type="text/plain", method="youtube-skill"), "ok", "youtube_transcript_preserve"),
        (dict(text=""), "thin", "empty_body"),
        (dict(text=None), "thin", "empty_body"),
    ],
)
def test_gate(spark, row, verdict, reason):
    v, reasons, junk = gate(spark, **row)
    assert v == verdict
    assert reason is None or reason in reasons
    assert junk == (None if v == "ok" and row.get("status", 200) == 200 else f"http_status_{row['status']}" if row.get("status", 200) != 200 else f"content_verdict_{v}")


def test_outstanding_categories(spark):
    f = lambda d, s, p, c, t: paywall.outstanding(d, s, p, urls.is_safe_domain(d), c, t, F.lit(None).cast("string"))["category"]
    cases = [
        ("x.org", 404, None, None, None), ("x.org", 500, None, None, None), ("x.org", 403, None, None, "Just a moment..."), ("www.linkedin.com", 403, None, None, None), ("x.org", 200, "likely", None, None),
        ("x.org", 200, None, "missing_file", None), ("x.org", 200, None, "thin", None), ("x.org", 200, None, "password_protected", None), ("arxiv.org", 200, None, None, None), ("x.org", 402, None, None, None), ("x.org", 200, None, None, None), ("x.org", -1, None, None, None),
    ]
    assert values(spark, f, cases, "string", "int", "string", "string", "string") == [
        "broken_or_moved", "retry", "bot_blocked", "needs_login_or_playwright", "paywall", "broken_or_moved", "content_thin", "password_protected", "needs_whitelist", "retry", "retry", "broken_or_moved",
    ]


def test_proxies(spark):
    f = lambda d, s, t: provenance.proxy_trigger(d, s, t)
    assert values(spark, f, [("d3fend.mitre.org", 429, ""), ("d3fend.mitre.org", 200, "Too many requests"), ("x.org", 429, ""), ("d3fend.mitre.org", 200, "")], "string", "int", "string") == ["status_429", "hint_too many requests", None, None]
    g = lambda s, t, e: provenance.credit_exhaustion(s, t, e)
    assert values(spark, g, [(402, "", ""), (200, "Out of credits", ""), (200, None, "insufficient balance"), (200, "", "")], "int", "string", "string") == ["status_402", "out of credit", "insufficient balance", None]


def test_sentences_and_windows():
    assert [("A b... C d! tail")[a:b] for a, b in split_sentences("A b... C d! tail")] == ["A b.", "C d!"]
    assert split_sentences("  no end ") == [(2, 8)]
    assert split_sentences(" \n ") == []
    w = rolling("One sentence here. Another one there. A third is short. The fourth ends.", 40, 20, 5)
    assert 2 <= len(w) <= 5 and all(e > s and t[-1] in ".!?" for _, s, e, t in w)
    assert rolling("a. b. c.", 100, 1, 1) == [(0, 0, 8, "a. b. c.")]
    assert rolling("x", 0, 1, 0) == [] and rolling("", 5, 5, 0) == []


@given(st.text(alphabet="ab .!?\n", max_size=60))
@settings(max_examples=200, deadline=None)
def test_sentences_are_those_of_the_pattern(text):
    import re

    want = [(m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip())) for m in re.finditer(r"[^.!?]+[.!?]", text)]
    if not want and text.strip():
        a = text.find(text.strip())
        want = [(a, a + len(text.strip()))]
    assert split_sentences(text) == want


def test_hub():
    links = "".join(f"<a href='/p/{k}'>link {k}</a>" for k in range(25))
    assert dom.hub(dom.tree(f"<body>{links}tiny</body>"), "https://e.org/hub")["is_hub"]
    full = dom.hub(dom.tree(f"<body>{'word ' * 500}{links}<nav><a href='/n/1'>n</a></nav><a href='https://o.org/x'>o</a><a href='/'>r</a></body>"), "https://e.org/hub")
    assert not full["is_hub"] and full["n_links"] == 25 and full["dropped"] == 1
    assert dom.hub(dom.tree(""), "")["n_links"] == 0


def test_notices():
    html = "<dl><dt>Definition</dt><dd>A structured text that says in full what the term means to a reader.</dd></dl>"
    assert "what the term means" in dom.definition(dom.tree(html), html)
    old = "<div class='danger-card'>Deprecated: use the other page.</div><p>" + "body " * 300 + "</p>"
    assert dom.deprecation(dom.tree(old), old).startswith("Deprecated")
    assert dom.definition(dom.tree("<p>x</p>"), "<p>x</p>") is None and dom.deprecation(dom.tree("x"), "x") is None
    assert dom.markdown(dom.tree("<h1>T</h1><p>a <b>b</b> <a href='/c'>c</a></p><ul><li>d</li></ul>")) == "# T\n\na **b** [c](/c)\n\n- d"
    assert dom.select(dom.tree("<main id='m'><p>x</p></main><p>y</p>"), ["#none", "main"]).text() == "x"


def test_salvage():
    want = {"alternates": []}
    for text in ('{"alternates": []}', 'say ```json\n{"alternates": []}\n``` done', 'well {"alternates": []} so'):
        assert suggestions.salvage(text) == want
    assert suggestions.salvage("no") is None and suggestions.salvage(None) is None


def test_rule_id_is_stable():
    assert rule_id({"b": 1, "a": "é"}) == rule_id({"a": "é", "b": 1}) and len(rule_id({})) == 12


def test_policy_sizes():
    assert "www.gps.gov" in DEFAULT.scripted and "csrc.nist.gov" in DEFAULT.trusted and DEFAULT.gated_statuses[0] == -1


def test_unicode(spark):
    assert values(spark, urls.idna_host, ["Bücher.Example.", "a.ORG", "", None]) == ["xn--bcher-kva.example", "a.org", "", ""]
    assert values(spark, content.nfc, ["e\u0301", None]) == ["é", None]


def test_what_is_not_read_is_pruned_from_the_chain(spark):
    from weftlake.plans import run

    df = spark.createDataFrame([("http://h/a", 200, "text/html", "<p>x</p>", 1)], "url string, status int, content_type string, text string, seq long")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        plan = lambda *names: run.annotate(df).select("seq", *names)._jdf.queryExecution().optimizedPlan().toString()
        assert "metered" in plan("paywall_score") and "error 1020" in plan("fallback_reason")
        assert "metered" not in plan("usable", "junk_reason") and "error 1020" not in plan("usable", "junk_reason")
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")

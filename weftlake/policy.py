"""Tunables and reference data as one immutable value; functions take it explicitly."""

from __future__ import annotations

from dataclasses import dataclass, field


def _hosts(**by_suffix: str) -> frozenset[str]:
    """``_hosts(com="a b")`` is {a.com, b.com}; ``_`` in a suffix stands for a dot."""
    return frozenset(f"{name}.{suffix.replace('_', '.')}" for suffix, names in by_suffix.items() for name in names.split())


def _phrases(text: str) -> tuple[str, ...]:
    return tuple(p.strip() for p in text.split("|"))


def _bounded(text: str) -> tuple[str, ...]:
    """Patterns of whole words."""
    return tuple(rf"\b{p.strip()}\b" for p in text.split(";"))


GATED = _hosts(
    com="bloomberg ecadforum fortinet money.cnn nytimes online.wsj reuters securityboulevard sentinelone asec.ahnlab spaceref thuraya twitter washingtonpost waterfall-security wired wsj x zdnet arabsat",
    org="almaobservatory atlas.mitre c4i cheatsheetseries.owasp hbr irp.fas web.archive",
    gov="gps nasa oig.nasa policy.defense",
    mil="doctrine.af dtic",
    co_uk="telegraph",
    org_uk="raeng",
    com_au="spoonfeedin.blogspot",
    lk="dailynews",
    edu="engr.utexas",
    eu="eu-space",
    space="smcit-scc",
)
TRUSTED = _hosts(
    com="advanced-television arstechnica asiatimes bleepingcomputer breakingdefense businessinsider cybersecurityforme deadline english.manoramaonline forbes hackersonlineclub jwillbold media.kaspersky spacenews spaceref theguardian csis-website-prod.s3.amazonaws",
    org="aerospace.csis aerospaceamerica aerospaceamerica.aiaa arxiv attack.mitre capec.mitre csis cwe.mitre d3fend.mitre hsdl ndss-symposium sparta.aerospace web.archive",
    gov="cisa csrc.nist nvlpubs.nist",
    rip="csrc.nist",
    co_uk="theregister",
)
LINK_HEAVY = _hosts(org="aerospace attack.mitre d3fend.mitre mitre sparta.aerospace", gov="csrc.nist nist")
NO_SEARCH = _hosts(org="en.wikipedia sparta.aerospace wikimedia wikipedia", com="twitter x")
_MODAL = dict(com="cpomagazine cyberdefensemagazine darkreading linkedin mdpi sentinelone splunk", gov="cisa", org="cnas")
SIGN_IN = _hosts(**{k: f"{v} {' '.join('www.' + n for n in v.split())}" for k, v in _MODAL.items()}) | _hosts(com="online.wsj")
SCRIPTED = SIGN_IN | _hosts(com="asiatimes www.forbes www.reuters", gov="policy.defense www.gps www.oig.nasa", org="atlas.mitre attack.mitre cwe.mitre d3fend.mitre", tools="csf", google="antigravity")


@dataclass(frozen=True)
class Policy:
    # content verdict
    article_chars: int = 1500
    weak_chars: int = 400
    link_density: float = 0.45
    gate_markers: int = 2
    markers: tuple[str, ...] = _phrases("subscribe|paywall|sign in|sign-in|sign up|sign-up|log in|login|register to read|members only|premium|unlock full|enable javascript|cookie consent")
    link_heavy: frozenset[str] = LINK_HEAVY
    missing_file_chars: int = 1200
    missing_file_tokens: tuple[str, ...] = _phrases("404|access denied|doesn't exist|does not exist|errors.edgesuite.net|file not found|page not found|page you were looking for can't be found|page you were looking for cannot be found|sorry, the page")
    # soft 404: every token of a template
    soft_404: tuple = (
        ("github_pages_404", _phrases("does not contain the requested file|page not found · github pages|the site configured at this address")),
        ("cloudflare_access_denied", _phrases("access denied|cloudflare|error 1020|you are unable to access")),
        ("s3_nosuchkey", _phrases("code>nosuchkey<|<code>nosuchkey</code>")),
        ("generic_not_found", _phrases("page not found|requested url was not found on this server|the page you are looking for doesn't exist")),
    )
    bot_tokens: tuple[str, ...] = _phrases("temporarily blocked|you are unable to access|you have been blocked")
    # gates and trusted hosts
    gated: frozenset[str] = GATED
    gated_statuses: tuple[int, ...] = (-1, 202, 401, 402, 403, 500, 502, 503)
    trusted: frozenset[str] = TRUSTED
    trusted_suffixes: tuple[str, ...] = (".gov", ".mil")
    strip_labels: tuple[str, ...] = ("www",)
    hints: tuple[str, ...] = _phrases("account|copyright|login|members only|paywall|purchase|sign in|sign-in|subscribe|subscription")
    no_search: frozenset[str] = NO_SEARCH
    scripted: frozenset[str] = SCRIPTED
    sign_in: frozenset[str] = SIGN_IN
    # paywall detector
    strong: tuple[str, ...] = _bounded("paywall; unlimited access; subscription required; not available in your region; this article is for subscribers; you (?:have|used) [0-9]+ free articles; (subscriber|members?) only")
    soft: tuple[str, ...] = _bounded(
        "subscribe; subscription; log in to (?:continue|read); sign in to (?:continue|read); please enable javascript; this is a potential security issue; you are viewing this page in an unauthorized frame"
    )
    vendors: tuple[str, ...] = _bounded("blueconic; cleeng; laterpay; memberful; piano; pressplus; tinypass; zephr; (paywall|metered)wall")
    legal: tuple[str, ...] = _bounded("all rights reserved; copyright; dmca; terms and conditions; terms of service")
    weights: dict = field(
        default_factory=lambda: dict(
            unauthorized=1.0, payment=0.9, limited=0.4, strong=0.6, soft=0.2, vendor=0.5, overlay=0.4, gap=0.7, stub=0.2, legal=0.3, noscript=0.4, meta=0.4, host=0.5
        )
    )
    caps: dict = field(default_factory=lambda: dict(strong=1.0, soft=0.4, vendor=1.0))
    likely: float = 1.0
    maybe: float = 0.5
    # body prefilter
    child_chars: int = 600
    child_paragraphs: int = 3
    # link hubs
    hub_links: int = 20
    hub_body: int = 1200
    hub_density: float = 0.4
    hub_cap: int = 100
    pdf_link_cap: int = 32
    # pages that need a browser
    least_page: int = 120
    least_rendered: int = 1024
    script_hints: tuple[str, ...] = _phrases('please enable javascript|javascript is required|</noscript>|id="root"')
    # proxies
    proxy_domains: tuple[str, ...] = ("d3fend.mitre.org",)
    proxy_statuses: tuple[int, ...] = (429,)
    proxy_hints: tuple[str, ...] = _phrases("rate limit|too many requests|temporarily blocked|retry later|exceeded your request quota|too many hits")
    credit_keywords: tuple[str, ...] = _phrases("out of credit|out-of-credit|out of credits|no credit|insufficient credit|insufficient credits|insufficient balance|insufficient traffic|traffic exhausted|bandwidth exhausted|bandwidth limit exceeded|not enough credit|exhausted your traffic")
    credit_statuses: tuple[int, ...] = (402, 407, 509, 511)
    # rolling windows
    window_size: int = 4000
    window_step: int = 2000
    window_max: int = 0
    # sinks
    inline_bytes: int = 0
    cache_entries: int = 5000
    junk_rows: int = 200
    junk_examples: int = 8


DEFAULT = Policy()

"""Inventory entries: merging duplicates, joining results, rules, fan-out, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host, match_suffix, normalize_domain, normalize_url, path, part, strip
from ..policy import DEFAULT, Policy
from .ordering import numbered

#: Rows of a rule table; it goes into the plan as a literal.
MOST_RULES = 10_000
LISTS = tuple("controls titles frameworks worksheets".split())


def build_entries(urls: DataFrame, url_col: str = "url", seq_col: str = "seq") -> DataFrame:
    """Entries of bare URLs: domain, empty lists and a number from 0 in input order."""
    none = F.array().cast("array<string>")
    rows = urls.select(strip(F.col(url_col)).alias("url"), host(F.col(url_col)).alias("domain"), *(none.alias(c) for c in LISTS), F.col(seq_col).alias("seq"))
    return numbered(rows, "seq", "consumer_id")


def dedupe_merge(entries: DataFrame) -> DataFrame:
    """One entry for each normalised URL: scalars of the first, sorted unions of lists where there are duplicates, instances each once.

    One shuffle on the normalised URL; partial aggregation happens before it.
    """
    keyed = entries.withColumn("url_normalized", normalize_url(F.col("url")))
    scalars = [c for c in entries.columns if c not in (*LISTS, "instances", "seq")]
    first = F.min_by(F.struct(*scalars, *(c for c in LISTS if c in entries.columns)), "seq").alias("first")
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(f"all_{c}") for c in LISTS if c in entries.columns]
    inst = []
    if "instances" in entries.columns:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "instances"))), lambda x: F.coalesce(x["instances"], F.array()))
        inst = [F.array_distinct(F.flatten(ordered)).alias("instances")]
    merged = keyed.groupBy("url_normalized").agg(first, F.count("*").alias("n_merged"), F.min("seq").alias("seq"), *lists, *inst)
    chosen = [F.when(F.col("n_merged") > 1, F.col(f"all_{c}")).otherwise(F.col(f"first.{c}")).alias(c) for c in LISTS if c in entries.columns]
    return merged.select("url_normalized", *(F.col(f"first.{c}").alias(c) for c in scalars), *chosen, *(["instances"] if inst else []), "n_merged", "seq")


def attach_results(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Entries with the result of their URL: by the result's URL (the last of those), else by its original URL (the first)."""
    last = Window.partitionBy("key").orderBy(F.desc("r_seq"))
    first = Window.partitionBy("key").orderBy("r_seq")
    r = results.select(*(F.col(c).alias(f"r_{c}") for c in results.columns))
    by_url = r.withColumn("key", F.col("r_url")).withColumn("rank", F.row_number().over(last)).where("rank = 1").withColumn("pref", F.lit(0))
    keyed = by_url.drop("rank")
    if "original_url" in results.columns:
        by_original = r.where("r_original_url is not null").withColumn("key", F.col("r_original_url")).withColumn("rank", F.row_number().over(first)).where("rank = 1").withColumn("pref", F.lit(1)).drop("rank")
        both = keyed.unionByName(by_original)
        keyed = both.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("pref"))).where("rank = 1").drop("rank")
    keyed = keyed.drop("pref")
    return entries.join(keyed, strip(entries["url"]) == keyed["key"], "left").drop("key")


def has_payload(results: DataFrame, prefix: str = "") -> Column:
    """Whether a result has a text, inline or under a pointer."""
    kept = F.length(F.coalesce(f"{prefix}text", F.lit(""))) > 0
    return kept | (F.coalesce(f"{prefix}text_path", F.lit("")) != "") if f"{prefix}text_path" in results.columns else kept


def outstanding_entries(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Entries without a fetched text; status -1 where there is no result at all."""
    joined = attach_results(entries, results)
    ok = (F.col("r_status") == 200) & has_payload(joined, "r_")
    return joined.where(~F.coalesce(ok, F.lit(False))).withColumn("status", F.coalesce("r_status", F.lit(-1)))


def outstanding_controls(pending: DataFrame) -> DataFrame:
    rows = pending.select(F.posexplode("controls").alias("k", "control_id"), "titles", "url", "domain", "worksheets", "status")
    return rows.select("control_id", F.coalesce(F.get("titles", F.col("k")), F.lit("")).alias("title"), F.col("url").alias("failed_url"), "domain", "worksheets", "status")


def outstanding_urls(pending: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return pending.groupBy("url").agg(
        F.min_by("domain", "seq").alias("domain"), F.min_by("status", "seq").alias("status"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.coalesce("controls", none))))).alias("control_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("worksheets", none))))).alias("worksheets"),
    )


def _rules(rules: DataFrame, *cols: Column) -> Column | None:
    """A rule table as an array of structs in order of priority."""
    rows = rules.select(F.col("priority").alias("priority"), *cols).orderBy("priority").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a rule table has at most {MOST_RULES} rows")

    def value(v) -> Column:
        return F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)

    return F.array(*(F.struct(*(value(v).alias(k) for k, v in r.asDict().items())) for r in rows)) if rows else None


def apply_overrides(entries: DataFrame, rules: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """``entries`` with rule_priority and target by the first rule that matches and has a usable target.

    ``rules``: priority, domain, substring, path_prefix, path_regex,
    query_contains (map), target_template, target_url.  A rule table is small
    by nature; it becomes a literal of the plan, so rows stay where they are,
    whatever their columns hold and however often they occur.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    table = _rules(
        rules.where("coalesce(target_template, target_url, '') <> ''"),
        F.when(blank("domain") == "", "").otherwise(normalize_domain(F.col("domain"), policy)).alias("domain"),
        *(blank(c).alias(c) for c in ("substring", "path_prefix", "path_regex", "target_template", "target_url")),
        F.coalesce(F.transform(F.map_entries("query_contains"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), F.array().cast("array<string>")).alias("query"),
    )
    if table is None:
        return entries.withColumns({"rule_priority": F.lit(None).cast("int"), "target": F.lit(None).cast("string")})
    url = strip(F.col("url"))
    original = F.coalesce(F.col("original_url"), url) if "original_url" in entries.columns else url
    own = F.nullif(F.col("domain"), F.lit("")) if "domain" in entries.columns else F.lit(None).cast("string")
    domain, c = normalize_domain(F.coalesce(own, host(url)), policy), F.col
    made = entries.withColumn("__u", F.struct(url.alias("url"), original.alias("original"), domain.alias("domain"), path(url).alias("path"), part(url, 4).alias("query")))

    def matches(r: Column) -> Column:
        return (
            ((r["domain"] == "") | (r["domain"] == c("__u.domain")))
            & ((r["substring"] == "") | c("__u.original").contains(r["substring"]))
            & ((r["path_prefix"] == "") | c("__u.path").startswith(r["path_prefix"]))
            & F.when(r["path_regex"] == "", True).otherwise(F.regexp_like(c("__u.path"), r["path_regex"]))
            & F.forall(r["query"], lambda q: c("__u.query").contains(q))
        )

    hit = made.withColumn("__hit", F.get(F.filter(table, matches), F.lit(0)))
    base = F.when(c("__u.original").startswith("http"), c("__u.original")).otherwise(c("__u.url"))
    target = F.when(c("__hit.target_template") != "", F.replace(c("__hit.target_template"), F.lit("{original}"), base)).otherwise(c("__hit.target_url"))
    return hit.withColumns({"rule_priority": c("__hit.priority"), "target": target}).drop("__u", "__hit")


def pick_selectors(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages with the selectors of the rule with the longest path prefix (the first of equals)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    table = _rules(rules.where("size(fit_markdown_selectors) > 0"), F.lower(blank("domain")).alias("domain"), blank("path_prefix").alias("path_prefix"), blank("substring").alias("substring"), F.col("fit_markdown_selectors").alias("selectors"))
    if table is None:
        return pages.withColumn("selectors", F.lit(None).cast("array<string>"))
    url, c = F.col("url"), F.col
    made = pages.withColumn("__u", F.struct(host(url).alias("host"), path(url).alias("path"), url.alias("url")))
    fit = F.filter(table, lambda r: ((r["domain"] == "") | (r["domain"] == c("__u.host"))) & ((r["path_prefix"] == "") | c("__u.path").startswith(r["path_prefix"])) & ((r["substring"] == "") | c("__u.url").contains(r["substring"])))
    best = F.reduce(F.slice(fit, 2, MOST_RULES), F.get(fit, F.lit(0)), lambda a, r: F.when(F.length(r["path_prefix"]) > F.length(a["path_prefix"]), r).otherwise(a))
    return made.withColumn("selectors", F.when(F.size(fit) > 0, best["selectors"])).drop("__u")


def fan_out(hubs: DataFrame, known: DataFrame, prefixes: dict[str, tuple[str, ...]], domains: tuple[str, ...]) -> DataFrame:
    """(parent_url, url, kept, reason) of each new link of a hub; ``hubs`` has url and links.

    Links already known are dropped by an anti join; each new link counts for
    its first parent.
    """
    links = hubs.select(F.col("url").alias("parent_url"), F.col("seq").alias("parent_seq"), F.posexplode("links").alias("pos", "link"))
    links = links.withColumn("url", normalize_url(F.col("link"))).where("url <> ''")
    links = links.join(known.select(normalize_url(F.col("url")).alias("known_url")).distinct(), F.col("url") == F.col("known_url"), "left_anti")
    base, own = host(F.col("parent_url")), host(F.col("url"))
    approved = match_suffix(base, domains)
    listed = F.create_map(*(x for k, v in prefixes.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if prefixes else F.lit(None).cast("map<string,array<string>>")
    allowed = F.try_element_at(listed, base)
    p = F.when(path(F.col("url")) == "", "/").otherwise(path(F.col("url")))
    same_site = (own == approved) | own.endswith(F.concat(F.lit("."), approved))
    reason = (
        F.when((own != "") & (own != base) & approved.isNotNull() & ~same_site, "domain_not_allowed")
        .when(allowed.isNotNull(), F.when(~F.exists(allowed, lambda a: p.startswith(a)), "path_not_allowed"))
        .when(approved.isNotNull(), F.when((own == "") | ~same_site, "domain_not_allowed"))
        .otherwise("no_allowlist")
    )
    told = links.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
    # a link is requested once; where it is dropped it may still come from another hub
    once = Window.partitionBy("url", "kept").orderBy("parent_seq", "pos")
    ranked = told.withColumn("rank", F.row_number().over(once)).where((F.col("rank") == 1) | ~F.col("kept"))
    return ranked.select("parent_url", "url", "kept", "reason")


def inventory_update(inventory: DataFrame, updates: DataFrame) -> DataFrame:
    """Inventory with new URLs where ``updates`` (url, new_url) has one for the original URL, else the URL."""
    u = updates.groupBy(F.col("url").alias("old")).agg(F.max("new_url").alias("new_url"))
    key = F.coalesce(F.col("original_url"), F.col("url"))
    joined = inventory.join(u, key == F.col("old"), "left")
    kept = F.coalesce("original_url", F.when(F.col("new_url").isNotNull(), F.col("url")))
    return joined.select(*(c for c in inventory.columns if c not in ("url", "original_url")), F.coalesce("new_url", "url").alias("url"), kept.alias("original_url"))


def replace_results(results: DataFrame, better: DataFrame) -> DataFrame:
    """``results`` without the rows of URLs in ``better`` (replaces, ...), and those of ``better``."""
    gone = better.select(F.col("replaces").alias("gone")).distinct()
    return results.join(gone, results["url"] == F.col("gone"), "left_anti").unionByName(better.drop("replaces"), allowMissingColumns=True)


def pick_candidates(candidates: DataFrame, excluded: DataFrame, gated: Column) -> DataFrame:
    """The first candidate (url, candidate, rank) of each URL that is neither of an excluded domain nor gated; the planner broadcasts ``excluded`` by its size."""
    ok = candidates.withColumn("site", host(F.col("candidate"))).join(excluded, F.col("site") == F.col("domain"), "left_anti").where(~gated)
    return ok.groupBy("url").agg(F.min_by("candidate", "rank").alias("candidate"), F.min("rank").alias("rank"))


def first_pending(pending: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of pending rows by their order; all if there is no limit above 0."""
    if limit <= 0:
        return pending
    return pending.orderBy("seq").limit(limit)


def keep_last(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("rank", F.row_number().over(last)).where("rank = 1").drop("rank")

"""Alternates for entries that were not fetched: overrides, search, archive, suggestions, in this order.

Fetching is not part of it: ``fetched`` has the annotated results of all
candidates that were tried, or is a function that takes candidates (url) and
returns theirs.  A candidate counts only if its result is there with status
200, a text and no verdict but ok.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paywall import resolver_eligible
from ..functions.urls import host, looks_gated_url, strip
from ..lineage import cut
from ..operators import entries as ops
from ..operators.suggestions import filter_suggestions
from ..policy import DEFAULT, Policy


@dataclass(frozen=True)
class Resolved:
    #: (seq, control_id, old_url, new_url, provider, summary, rule_priority) of what was applied.
    applied: DataFrame
    #: Results with those of alternates in place of those of their entries.
    results: DataFrame
    #: The inventory under its new URLs.
    inventory: DataFrame


def usable(fetched: DataFrame) -> DataFrame:
    ok = (F.col("status") == 200) & ops.has_payload(fetched) & (F.coalesce("verdict", F.lit("ok")) == "ok")
    return fetched.where(ok)


def _holding(found: DataFrame, good: DataFrame) -> DataFrame:
    """The candidates whose results can be used."""
    good = good.select(F.col("url").alias("good")).distinct()
    return found.join(good, F.col("candidate") == F.col("good"), "left_semi")


def pending_entries(entries: DataFrame, results: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Entries whose result is one a resolver looks at, once for each original URL."""
    have = lambda c: F.col(f"r_{c}") if c in results.columns else F.lit(None).cast("string")
    joined = ops.attach_results(entries, results)
    ok = resolver_eligible(F.coalesce(F.col("domain"), host(F.col("url"))), F.coalesce("r_status", F.lit(-1)), F.coalesce(F.nullif(have("text"), F.lit("")), have("text_path")), have("fallback_reason"), have("verdict"), have("paywall_verdict"), policy)
    original = F.coalesce(F.col("original_url"), F.col("url")) if "original_url" in entries.columns else F.col("url")
    rows = joined.where(F.coalesce(ok, F.lit(False))).select(*(entries[c] for c in entries.columns)).withColumn("__key", original)
    first = rows.groupBy("__key").agg(F.min_by(F.struct(*entries.columns), "seq").alias("e"))
    return first.select("e.*")


def resolve(inventory: DataFrame, results: DataFrame, fetched: DataFrame | Callable[[DataFrame], DataFrame], rules: DataFrame | None = None, search: DataFrame | None = None, archive: DataFrame | None = None, suggestions: DataFrame | None = None, limit: int = 24, policy: Policy = DEFAULT) -> Resolved:
    """Alternates for ``inventory``.

    ``search``: (url, candidate, rank); ``archive``: (url, candidate);
    ``suggestions``: those of filter_suggestions() with (old_url, url, rank).
    The search looks at the first ``limit`` pending entries; archive and
    suggestions at those that are left, in order, until ``limit`` alternates
    are applied.  No limit above 0 means all.
    """
    spark = inventory.sparkSession
    entries = ops.dedupe_merge(inventory) if "url_normalized" not in inventory.columns else inventory
    entries = cut(entries.withColumn("url", strip(F.col("url"))))
    # what is decided upon again and again is a few columns of rows that come from long chains
    seen = [c for c in ("url", "original_url", "status", "text", "text_path", "fallback_reason", "verdict", "paywall_verdict", "seq") if c in results.columns]
    light = cut(results.select(*((F.substring(F.trim("text"), 1, 1).alias(c) if c == "text" else F.col(c)) for c in seen)))
    good = None if callable(fetched) else cut(usable(fetched).select("url").distinct())
    record = "seq long, control_id string, old_url string, new_url string, provider string, summary string, rule_priority int"
    stages: list[DataFrame] = [spark.createDataFrame([], record)]
    tried: list[DataFrame] = [] if callable(fetched) else [fetched]

    def holding(found: DataFrame) -> DataFrame:
        if good is not None:
            return _holding(found, good)
        tried.append(cut(fetched(found.select(F.col("candidate").alias("url")).distinct())))
        return _holding(found, usable(tried[-1]))

    def applied() -> DataFrame:
        return reduce(DataFrame.unionByName, stages)

    def left(rows: DataFrame) -> DataFrame:
        return rows.join(applied().select(F.col("old_url").alias("__done")), F.col("url") == F.col("__done"), "left_anti")

    def add(found: DataFrame, provider, summary, rule=F.lit(None)) -> None:
        one = holding(found)
        control = F.coalesce(F.get("controls", F.lit(0)), F.col("url")) if "controls" in found.columns else F.col("url")
        stages.append(cut(one.select(F.col("seq").cast("long").alias("seq"), control.alias("control_id"), F.col("url").alias("old_url"), F.col("candidate").alias("new_url"), provider.alias("provider"), summary.alias("summary"), rule.cast("int").alias("rule_priority"))))

    if rules is not None:
        hit = ops.apply_overrides(entries, rules, policy).where("target is not null and target <> ''")
        add(hit.withColumnRenamed("target", "candidate"), F.lit("override"), F.lit("domain-specific override"), F.col("rule_priority"))
    pending = cut(left(pending_entries(entries, light, policy)))
    room = lambda: None if limit <= 0 else max(0, limit - applied().count())

    def first(rows: DataFrame, many: int | None) -> DataFrame:
        return rows if many is None else rows.orderBy("seq").limit(many)

    if search is not None:
        excluded = spark.createDataFrame([(d,) for d in sorted(policy.no_search)], "domain string")
        best = ops.pick_candidates(search, excluded, looks_gated_url(F.col("candidate"))).select(F.col("url").alias("__u"), "candidate")
        add(ops.first_pending(pending, limit).join(best, F.col("url") == F.col("__u")), F.lit("search"), F.lit(None).cast("string"))
    if archive is not None:
        best = archive.select(F.col("url").alias("__u"), "candidate")
        open_ = left(pending).join(best, F.col("url") == F.col("__u"))
        add(first(holding(open_), room()), F.lit("wayback"), F.lit(None).cast("string"))
    if suggestions is not None:
        named = filter_suggestions(suggestions, policy).groupBy("old_url").agg(F.min_by(F.struct("url", "summary"), "rank").alias("s"))
        best = named.select(F.col("old_url").alias("__u"), F.col("s.url").alias("candidate"), F.col("s.summary").alias("__summary"))
        open_ = first(left(pending), room()).join(best, F.col("url") == F.col("__u"))
        add(open_, F.lit("suggestion"), F.col("__summary"))
    done = cut(applied())
    if not tried:
        return Resolved(done, results, inventory)
    known = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tried)
    better = usable(known).join(done.select(F.col("old_url").alias("replaces"), "new_url"), F.col("url") == F.col("new_url")).drop("new_url")
    one = better.groupBy("replaces").agg(F.max_by(F.struct(*known.columns), "seq").alias("r")).select("replaces", "r.*")
    original = inventory if "original_url" in inventory.columns else inventory.withColumn("original_url", F.lit(None).cast("string"))
    moved = ops.inventory_update(original, done.select(F.col("old_url").alias("url"), "new_url"))
    return Resolved(done, ops.replace_results(results, one), moved)

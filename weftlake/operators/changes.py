"""Content changes against keyed state: one shuffle on the normalised URL."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import normalize_url

SAMPLE_CHARS = 800


@F.pandas_udf(T.DoubleType())
def diff_ratio(before: pd.Series, after: pd.Series) -> pd.Series:
    """difflib's ratio of a sample kept and as much of the new text, to four digits; null if either is empty."""

    def one(a, b):
        if a == b and a:  # what difflib gives, too
            return 1.0
        return round(difflib.SequenceMatcher(None, a, b[: len(a)]).ratio(), 4) if a and b else None

    return pd.Series([one(a, b) for a, b in zip(before, after)])


def detect_changes(results: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Results with content_sha256, content_changed and what was there before.

    The content is the text, else the bytes (column raw_bytes); a row with
    neither passes through with nulls and touches no state.  A later row of the
    same URL sees the earlier one; the first sees ``state`` (url_norm, sha,
    length, fetched_at, sample), where there is one.  Only digests and samples
    are compared; bodies meet them again where the rows are.
    """
    raw = F.col("raw_bytes") if "raw_bytes" in results.columns else F.lit(None).cast("binary")
    has = F.length(F.coalesce("text", F.lit(""))) > 0
    sha = F.when(has, F.sha2("text", 256)).when(F.length(raw) > 0, F.sha2(raw, 256))
    # by the URL alone, which serves the window and the state, so that rows are shuffled once
    now = results.withColumns({"url_norm": normalize_url(F.col("url")), "content_sha256": sha, "content_text_len": F.when(sha.isNotNull(), F.length(F.coalesce("text", F.lit("")))), "sample": F.when(has, F.substring("text", 1, SAMPLE_CHARS)).when(sha.isNotNull(), "")}).repartition("url_norm")
    # rows without content see none and aren't seen
    order = Window.partitionBy("url_norm", F.col("content_sha256").isNull()).orderBy("fetched_at", "seq")
    seen = now.withColumn("p", F.lag(F.struct(F.col("content_sha256").alias("sha"), F.col("content_text_len").alias("length"), "fetched_at", "sample")).over(order))
    if state is not None:
        s = state.select(F.col("url_norm").alias("s_url"), F.struct("sha", F.col("length").cast("int").alias("length"), "fetched_at", "sample").alias("s"))
        seen = seen.join(s, seen["url_norm"] == s["s_url"], "left").withColumn("p", F.coalesce("p", "s"))
    p, some = F.when(F.col("content_sha256").isNotNull(), F.col("p")), F.col("content_sha256").isNotNull()
    return seen.select(
        *results.columns, "url_norm", "content_sha256", "content_text_len", p["sha"].alias("content_previous_sha256"), p["length"].alias("content_previous_len"), p["fetched_at"].alias("content_previous_fetched_at"),
        F.when(some, F.coalesce(F.col("content_sha256") != p["sha"], F.lit(True))).alias("content_changed"), p["sample"].alias("previous_sample"), F.col("sample").alias("content_sample"),
    )


def with_diff_ratio(changes: DataFrame) -> DataFrame:
    """With diff_ratio(), of the sample where detect_changes() gave it, so that texts aren't shuffled for it; equal samples don't go through Python."""
    before = F.col("previous_sample")
    after = F.substring(F.col("content_sample" if "content_sample" in changes.columns else "text"), F.lit(1), F.length(before))
    same = (before == after) & (F.length(before) > 0)
    return changes.withColumn("content_diff_ratio", F.when(same, 1.0).otherwise(diff_ratio(F.when(~same, before), F.when(~same, after))))


def next_state(changes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The last content of each URL: of these rows, else of ``state``."""
    kept = F.struct(F.col("content_sha256").alias("sha"), F.col("content_text_len").alias("length"), "fetched_at", F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("sample"))
    new = changes.where("content_sha256 is not null").groupBy("url_norm").agg(F.max_by(kept, F.struct("fetched_at", "seq")).alias("x"))
    new = new.select("url_norm", "x.*")
    if state is None:
        return new
    return new.unionByName(state.join(new.select("url_norm"), "url_norm", "left_anti"))


def change_feed(changes: DataFrame) -> DataFrame:
    """Rows whose content changed."""
    return changes.where("content_changed")


def feed_records(changes: DataFrame) -> DataFrame:
    """The records of a change feed; what a run doesn't know is null."""
    rows = change_feed(with_diff_ratio(changes))
    have = lambda c: F.col(c) if c in changes.columns else F.lit(None).cast("string")
    return rows.select(
        "url", have("domain").alias("domain"), "fetched_at", F.col("content_previous_fetched_at").alias("previous_fetched_at"), "content_sha256", "content_previous_sha256", "content_diff_ratio",
        F.coalesce(F.nullif(have("text_path"), F.lit("")), have("file_path")).alias("text_path"), have("blob_path").alias("blob_path"),
    )

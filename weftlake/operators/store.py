"""Texts and blobs by content, and snapshots of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import blob_extension, normalize_url
from ..policy import DEFAULT, Policy


def externalize(results: DataFrame, policy: Policy = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(results with pointers instead of long texts, texts by hash).

    A negative limit leaves all inline, 0 moves every text, more moves texts of
    more bytes.
    """
    most = policy.inline_bytes
    n, text = F.octet_length("text"), F.col("text")
    moved = F.lit(False) if most < 0 else (F.length(text) > 0) & (n > most)
    moved = F.coalesce(moved, F.lit(False))
    sha = F.when(moved, F.sha2(text, 256))
    out = results.withColumns({
        "text_externalized": moved, "text_sha256": sha, "text_path": F.when(moved, F.concat(sha, F.lit(".txt"))), "text_inline_bytes": F.coalesce(n, F.lit(0)), "text_length_chars": F.coalesce(F.length(text), F.lit(0)),
    }).withColumn("text", F.when(moved, "").otherwise(text))
    blobs = results.where(moved).select(sha.alias("sha256"), "text").dropDuplicates(["sha256"])
    return out, blobs


def payload(results: DataFrame) -> Column:
    """What is stored of a row: its bytes, else its text; null where it has neither."""
    text = F.when(F.length(F.coalesce("text", F.lit(""))) > 0, F.encode("text", "UTF-8"))
    return F.coalesce(F.col("raw_bytes"), text) if "raw_bytes" in results.columns else text


def with_blob(results: DataFrame) -> DataFrame:
    """Results with the pointer to their stored bytes: blob_sha256, blob_size, blob_source and blob_path (a name in the store)."""
    data, kind = payload(results), F.col("content_type") if "content_type" in results.columns else F.lit(None).cast("string")
    sha = F.sha2(data, 256)
    raw = F.col("raw_bytes").isNotNull() if "raw_bytes" in results.columns else F.lit(False)
    return results.withColumns({
        "blob_sha256": sha, "blob_size": F.octet_length(data).cast("long"), "blob_source": F.when(data.isNotNull(), F.when(raw, "raw").otherwise("text")), "blob_path": F.concat(sha, blob_extension(F.col("url"), kind)),
    })


def blobs(results: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Each distinct body once: (sha256, size, filename, first_seq), without those known."""
    body = with_blob(results).where("blob_size > 0")
    first = body.groupBy(F.col("blob_sha256").alias("sha256")).agg(F.max("blob_size").alias("size"), F.min_by("blob_path", "seq").alias("filename"), F.min("seq").alias("first_seq"))
    if known is not None:
        first = first.join(known.select("sha256"), "sha256", "left_anti")
    return first.select("sha256", "size", "filename", "first_seq")


def blob_bytes(results: DataFrame) -> DataFrame:
    """(sha256, data) of each distinct body."""
    return results.select(F.sha2(payload(results), 256).alias("sha256"), payload(results).alias("data")).where("octet_length(data) > 0").dropDuplicates(["sha256"])


def verify_blobs(results: DataFrame, stored: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Results of verdict ok with what the stored bytes (sha256, data) say: postcheck_verdict, score, reasons, length and postcheck_failed; nulls where nothing is stored."""
    from ..functions.content import with_features

    read = stored.select(F.col("sha256").alias("stored_sha"), F.try_validate_utf8(F.col("data").cast("string")).alias("stored_text"))
    rows = results.where("verdict = 'ok'").join(read, F.col("blob_sha256") == F.col("stored_sha"), "left")
    told = with_features(rows.select("seq", "url", "content_type", F.col("stored_text").alias("text")), policy=policy)
    none = F.col("text").isNull()
    return told.select(
        "seq", "url", F.when(~none, F.col("f_verdict")).alias("postcheck_verdict"), F.when(~none, F.round("f_score", 3)).alias("postcheck_score"), F.when(~none, F.col("f_reasons")).alias("postcheck_reasons"),
        F.when(~none, F.col("f_len")).alias("content_text_len_post"), (F.col("f_verdict") != "ok").alias("postcheck_failed"),
    )


def extracted_texts(results: DataFrame, texts: DataFrame | None = None, min_chars: int = 1, policy: Policy = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(results of verdict ok with a pointer to the text extracted from what they hold, those texts by hash).

    The source is raw_text() of the row, extracted again whatever it was; a
    text of fewer than ``min_chars`` signs isn't kept.
    """
    from ..functions.content import with_features
    from ..functions.urls import strip

    rows = raw_text(results.where("lower(coalesce(verdict, '')) = 'ok'"), texts)
    kind = F.coalesce(F.nullif(F.col("content_type"), F.lit("")), F.lit("text/html"))
    told = with_features(rows.where("trim(raw_text) <> ''").select("seq", "url", kind.alias("content_type"), F.col("raw_text").alias("text")), policy=policy).withColumn("t", strip(F.col("f_text")))
    told = told.where(F.length("t") >= max(1, min_chars)).withColumn("sha256", F.sha2("t", 256))
    pointers = told.select("seq", "url", F.col("sha256").alias("extracted_text_sha256"), F.concat("sha256", F.lit(".txt")).alias("extracted_text_path"), F.length("t").alias("extracted_text_len"))
    return pointers, told.select("sha256", F.col("t").alias("text")).dropDuplicates(["sha256"])


def cache_lookup(requests: DataFrame, cache: DataFrame, bypass=None) -> DataFrame:
    """Requests with the snapshot under their normalised URL, else their raw one; none where ``bypass`` holds."""
    c = cache.select(F.col("key").alias("k1"), F.col("value").alias("v1"))
    d = cache.select(F.col("key").alias("k2"), F.col("value").alias("v2"))
    r = requests.withColumn("url_norm", normalize_url(F.col("url")))
    j = r.join(c, F.col("url_norm") == F.col("k1"), "left").join(d, F.col("url") == F.col("k2"), "left")
    hit = F.coalesce("v1", "v2")
    if bypass is not None:
        hit = F.when(~bypass, hit)
    return j.select(*requests.columns, "url_norm", hit.alias("cached"), hit.isNotNull().alias("from_cache"))


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The newest snapshot of each key."""
    last = Window.partitionBy("key").orderBy(F.desc("fetched_at"))
    return cache.unionByName(fresh).withColumn("rank", F.row_number().over(last)).where("rank = 1").drop("rank")


def cache_prune(cache: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    return cache.orderBy(F.desc("fetched_at"), "key").limit(policy.cache_entries)


def download(results: DataFrame, mode: str, policy: Policy = DEFAULT) -> DataFrame:
    """Results by mode: ``text`` as they are, ``download_only`` with pointers to blobs, ``rolling_extract`` with windows too; an unknown mode is text."""
    from .windows import rolling_windows

    mode = mode if mode in ("download_only", "rolling_extract") else "text"
    if mode == "rolling_extract" and not 0 < policy.window_step <= policy.window_size:
        raise ValueError("a window's step must be above 0 and no more than its size")
    out = results.withColumn("download_mode", F.lit(mode))
    if mode == "text":
        return out
    out = with_blob(out)
    return out.withColumn("windows", rolling_windows(F.col("text"), policy)) if mode == "rolling_extract" else out


def persist_downloads(results: DataFrame, allow_junk: bool = False) -> DataFrame:
    """Blob pointers and the error of each URL without a payload; bytes come before text."""
    rows = results if allow_junk else results.where("coalesce(nullif(verdict, ''), 'ok') = 'ok'")
    held = with_blob(rows)
    return held.select("seq", "url", "blob_sha256", "blob_path", "blob_source", F.when(F.col("blob_sha256").isNull(), "download_missing_no_payload").alias("error"))


def window_source(results: DataFrame, texts: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """What windows are cut from: raw_text() of the row."""
    return raw_text(results, texts, stored)


def raw_text(results: DataFrame, texts: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Results with raw_text: their own text, else their bytes, else the stored text (sha256, text) their text or file pointer names, else the stored bytes (sha256, data) of their blob pointer."""
    have = lambda c: F.nullif(F.col(c), F.lit("")) if c in results.columns else F.lit(None).cast("string")
    own = F.nullif(F.coalesce("text", F.lit("")), F.lit(""))
    raw = F.nullif(F.try_validate_utf8(F.col("raw_bytes").cast("string")), F.lit("")) if "raw_bytes" in results.columns else F.lit(None).cast("string")
    joined, found = results, [own, raw]
    if texts is not None:
        kept = texts.select(F.concat("sha256", F.lit(".txt")).alias("__path"), F.col("text").alias("__text"))
        joined = joined.join(kept, F.coalesce(have("text_path"), have("file_path")) == F.col("__path"), "left")
        found.append(F.nullif(F.col("__text"), F.lit("")))
    if stored is not None:
        kept = stored.select(F.col("sha256").alias("__sha"), F.try_validate_utf8(F.col("data").cast("string")).alias("__data"))
        joined = joined.join(kept, F.regexp_extract(have("blob_path"), "([0-9a-f]{64})[^/]*$", 1) == F.col("__sha"), "left")
        found.append(F.nullif(F.col("__data"), F.lit("")))
    return joined.select(*results.columns, F.coalesce(*found).alias("raw_text"))

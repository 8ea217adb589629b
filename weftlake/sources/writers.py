"""Sinks: results, reports and state as tables; one file for each row is never written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports
from ..policy import DEFAULT, Policy


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_report(counts: DataFrame, path: str) -> None:
    reports.as_json_row(counts).coalesce(1).write.mode("overwrite").text(path)


def _remove(frame: DataFrame, path: str) -> None:
    spark = frame.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_change_feed(changes: DataFrame, path: str) -> int:
    """The records of a change feed; the number written.  Without any there is no feed, and an old one goes."""
    from ..operators.changes import feed_records

    records = feed_records(changes).persist()
    n = records.count()
    if n:
        records.write.mode("overwrite").json(path)
    else:
        _remove(changes, path)
    records.unpersist()
    return n


def write_alternates(applied: DataFrame, inventory: DataFrame, path: str) -> None:
    """The inventory under its new URLs, and what was applied, appended to the log."""
    inventory.write.mode("overwrite").json(f"{path}/inventory")
    applied.write.mode("append").json(f"{path}/alternates_log")


def write_extracted(results: DataFrame, texts: DataFrame | None, path: str, min_chars: int = 1, policy: Policy = DEFAULT) -> None:
    """Texts extracted from results of verdict ok, and the pointers to them."""
    from ..operators.store import extracted_texts

    pointers, found = extracted_texts(results, texts, min_chars, policy)
    write_texts(found, f"{path}/extracted_text")
    pointers.write.mode("overwrite").json(f"{path}/extracted")


def write_markdown(results: DataFrame, path: str, policy: Policy = DEFAULT, min_chars: int = 1) -> None:
    """Markdown of HTML results of verdict ok, by hash, with the pointers."""
    from ..operators import dom

    html = F.lower(F.coalesce("content_type", F.lit(""))).contains("html")
    rows = results.where(html & (F.col("verdict") == "ok")).select("seq", "url", dom.features(F.col("html") if "html" in results.columns else F.col("text"), F.col("url"), policy, fields=("markdown",))["markdown"].alias("text"))
    rows = rows.where(F.length("text") >= max(1, min_chars)).withColumn("sha256", F.sha2("text", 256))
    write_texts(rows.select("sha256", "text").dropDuplicates(["sha256"]), f"{path}/markdown")
    rows.select("seq", "url", F.col("sha256").alias("markdown_sha256"), F.length("text").alias("markdown_len")).write.mode("overwrite").json(f"{path}/markdown_index")


def write_junk(results: DataFrame, path: str, policy: Policy = DEFAULT) -> None:
    """Junk rows without their texts, the summary, examples and the triage table."""
    reports.junk(results).drop("text").write.mode("overwrite").json(f"{path}/results")
    reports.junk_summary(results).write.mode("overwrite").json(f"{path}/summary")
    reports.junk_examples(results, policy).write.mode("overwrite").json(f"{path}/examples")
    reports.render_table(reports.junk_table(results, policy)).coalesce(1).write.mode("overwrite").text(f"{path}/table")


def write_outstanding(pending: DataFrame, path: str, results: DataFrame | None = None, policy: Policy = DEFAULT) -> None:
    """Controls and URLs outstanding; with ``results`` the summary by domain and category too."""
    from ..operators.entries import outstanding_controls, outstanding_urls

    outstanding_controls(pending).orderBy("domain", "failed_url", "control_id").write.mode("overwrite").json(f"{path}/controls")
    rollup = outstanding_urls(pending)
    rollup.orderBy("domain", "url").write.mode("overwrite").json(f"{path}/urls")
    if results is not None:
        items = reports.outstanding_items(rollup, results, policy)
        items.orderBy("domain", "url").write.mode("overwrite").json(f"{path}/domains")
        reports.outstanding_counts(items).write.mode("overwrite").json(f"{path}/categories")


def write_texts(blobs: DataFrame, path: str) -> None:
    """Texts by hash, in folders by the first sign of it."""
    blobs.withColumn("prefix", F.substring("sha256", 1, 1)).write.mode("append").partitionBy("prefix").parquet(path)


def write_state(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def write_bodies(bodies: DataFrame, path: str) -> None:
    """Stored bytes by hash, in folders by the first sign of it."""
    bodies.withColumn("prefix", F.substring("sha256", 1, 1)).write.mode("append").partitionBy("prefix").parquet(path)


def write_summary(items: DataFrame, path: str) -> None:
    """The items of a run (reports.summary_items()), their counts as one JSON document, and the walkthrough in order of the run."""
    items.write.mode("overwrite").json(f"{path}/items")
    write_report(reports.summary_counts(items), f"{path}/summary")
    reports.walkthrough(items).orderBy("consumer_id").select("block").write.mode("overwrite").text(f"{path}/walkthrough")

"""The command line.

``python -m weftlake run --inventory x.jsonl --pages pages --out folder``, ``get URL``, ``manifest FILE``
(``-`` is standard input), ``find TEXT``, ``doctor``.  Exit 0 if all is there, 2 for wrong usage, 3 if
something is outstanding or missing.  Without a command it is ``run``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings
from .functions import urls
from .operators import reports
from .operators.entries import build_entries
from .plans import doctor
from .plans.run import dry_run, fetch_one, parse_emit, run_pipeline
from .sources import readers, writers

COMMANDS = ("run", "get", "manifest", "find", "doctor")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftlake")
    sub = p.add_subparsers(dest="command", required=True)
    run, get, manifest, find, doc = (sub.add_parser(c) for c in COMMANDS)
    source = run.add_mutually_exclusive_group(required=True)
    source.add_argument("--inventory")
    source.add_argument("--manifest")
    manifest.add_argument("manifest")
    get.add_argument("url")
    find.add_argument("needle")
    find.add_argument("--limit", type=int, default=20)
    for c in (run, manifest):
        c.add_argument("--out")
        c.add_argument("--cache", help="snapshots for what wasn't fetched")
        c.add_argument("--state", help="change state, read and written")
        c.add_argument("--new-folder", help="write to a folder of the run within --out", action="store_true")
        c.add_argument("--download-mode", default="text")
        c.add_argument("--emit", default="download,text,md")
        c.add_argument("--metrics-json", help="a file for the counts")
        c.add_argument("--dry-run", help="count, no more", action="store_true")
    for c in (run, manifest, get, find):
        c.add_argument("--pages")
    doc.add_argument("--rules")
    return p


def _inventory(spark: SparkSession, lines: DataFrame) -> DataFrame:
    return build_entries(lines.withColumn("seq", F.monotonically_increasing_id()))


def _run(spark: SparkSession, a, p: argparse.ArgumentParser) -> int:
    if getattr(a, "inventory", None):
        inventory = readers.read_inventory(spark, a.inventory)
    elif a.manifest == "-":
        inventory = _inventory(spark, readers.read_stdin_manifest(spark, sys.stdin))
    else:
        inventory = _inventory(spark, readers.read_manifest(spark, a.manifest))
    if a.dry_run:
        counts = dry_run(inventory).first()
        print(json.dumps(counts.asDict()))
        return 3 if counts["invalid"] else 0
    if not a.pages or not a.out:
        p.error("--pages and --out are needed")
    try:
        emit = parse_emit(a.emit)
    except ValueError as wrong:
        p.error(str(wrong))
    out = settings.run_folder(a.out, settings.run_id()) if a.new_folder else a.out
    state = readers.read_state(spark, a.state) if a.state else None
    run = run_pipeline(inventory, spark.read.parquet(a.pages), state, cache=readers.read_cache(spark, a.cache) if a.cache else None, with_dom=True, download_mode=a.download_mode)
    results = run.results.persist()
    writers.write_results(results, f"{out}/results")
    writers.write_junk(results, f"{out}/junk")
    writers.write_outstanding(run.outstanding, f"{out}/outstanding", results)
    writers.write_change_feed(run.changes, f"{out}/changes")
    writers.write_report(run.metrics, f"{out}/metrics")
    writers.write_report(run.audit, f"{out}/audit")
    reports.failure_summary(results).write.mode("overwrite").json(f"{out}/failures")
    if "text" in emit:
        writers.write_extracted(results, None, out)
    if "md" in emit or "fit_md" in emit:
        writers.write_markdown(results, out)
    if run.bodies is not None:
        writers.write_bodies(run.bodies, f"{out}/downloads")
    if a.state:
        from .operators.changes import next_state

        writers.write_state(next_state(run.changes, state).persist(), f"{out}/state")
    if a.command == "manifest":
        numbered = inventory.select(urls.normalize_url(F.col("url")).alias("__norm"), "consumer_id", "url")
        mine = results.withColumn("__norm", urls.normalize_url(F.col("url"))).join(numbered.drop("url"), "__norm").withColumn("final_url", F.col("url"))
        writers.write_summary(reports.summary_items(numbered.drop("__norm"), mine), f"{out}/summary")
    left = run.outstanding.count()
    if a.metrics_json:
        metrics = run.metrics.first().asDict() | {"verdict_counts": {r["verdict"]: r["n"] for r in reports.verdict_counts(results).collect()}, "outstanding": left}
        with open(a.metrics_json, "w", encoding="utf-8") as f:
            json.dump(metrics, f)
    return 3 if left else 0


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and argv[0] not in ("-h", "--help"):
        argv = ["run", *argv]
    p = _parser()
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("weftlake").getOrCreate()
    if a.command == "doctor":
        told = doctor.report(doctor.checks(spark, a.rules))
        print(json.dumps(told))
        return 0 if told["ok"] else 3
    if a.command in ("get", "find") and not a.pages:
        p.error("--pages is needed")
    if a.command == "get":
        rows = fetch_one(spark.read.parquet(a.pages), a.url).drop("raw_bytes").toJSON().take(1)
        print(rows[0] if rows else json.dumps({"url": a.url, "status": -1}))
        return 0 if rows else 3
    if a.command == "find":
        pages = spark.read.parquet(a.pages).where(F.contains(F.lower("url"), F.lit(a.needle.lower())) | F.contains(F.lower("text"), F.lit(a.needle.lower())))
        found = pages.select("url", "status").orderBy("url").limit(a.limit).collect()
        for r in found:
            print(json.dumps(r.asDict()))
        return 0 if found else 3
    return _run(spark, a, p)


if __name__ == "__main__":
    sys.exit(main())

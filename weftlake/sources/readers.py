"""Readers of inventories, manifests, rule tables and fixtures on files."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import decode_bytes
from ..functions.urls import BLANK, strip

INVENTORY = (
    "url string, original_url string, domain string, source string, title string, controls array<string>, titles array<string>, frameworks array<string>, "
    "worksheets array<string>, instances array<struct<worksheet: string, row_index: bigint, title: string>>, seq bigint"
)
RESULTS = (
    "url string, domain string, status int, content_type string, text string, raw_bytes binary, fetched_at string, method string, from_cache boolean, error string, metadata string, seq bigint"
)
RULES = (
    "priority int, domain string, substring string, path_prefix string, path_regex string, query_contains map<string,string>, "
    "target_template string, target_url string, target_local_file string, fit_markdown_selectors array<string>, rule_id string"
)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a line that isn't JSON or has no URL fails the query."""
    rows = spark.read.schema(INVENTORY).option("mode", "FAILFAST").json(path)
    return rows.withColumn("url", F.when(F.col("url").isNull(), F.raise_error(F.lit("an inventory row has no url"))).otherwise(F.col("url")))


def parse_manifest(lines: DataFrame, col: str = "value") -> DataFrame:
    """(url) of each line that is neither empty nor a comment; white space inside a URL is an error."""
    line = strip(F.col(col))
    kept = lines.where((line != "") & ~line.startswith("#"))
    bad = F.raise_error(F.concat(F.lit("white space in a manifest line: "), line))
    return kept.select(F.when(line.rlike(BLANK), bad.cast("string")).otherwise(line).alias("url"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


CONTEXTS = "id string, category string, definition string, title string"


def read_contexts(spark: SparkSession, path: str, schema: str = CONTEXTS) -> DataFrame:
    """Control contexts by id; of rows with one id the last in its file stays, the last file first; none where there is no file."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(path)
    # the place of a line is that of its file's bytes, however files are split
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    last = F.struct("__file", "__block", "__row")
    kept = [c for c in rows.columns if c != "id"]
    return placed.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*kept), last).alias("x")).select("id", "x.*")


def read_cache(spark: SparkSession, path: str, value: str = "status int, content_type string, text string, fetched_at string, method string") -> DataFrame:
    """Snapshots (key, ...) of a folder of Parquet, or of a file with one JSON object by key; empty where there is none or it isn't JSON."""
    schema = f"key string, {value}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    whole = spark.read.option("wholetext", True).text(path)
    parsed = whole.select(F.explode(F.from_json("value", f"map<string, struct<{', '.join(': '.join(f.split()) for f in value.split(', '))}>>")))
    return parsed.select("key", "value.*")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Change state (url_norm, sha, length, fetched_at, sample): a folder of Parquet, or a file with one JSON object by URL; empty where there is none or it isn't JSON."""
    found = read_cache(spark, path, "sha string, length int, fetched_at string, sample string")
    return found.withColumnRenamed("key", "url_norm")


def rule_id(rule: dict) -> str:
    return hashlib.sha1(json.dumps(rule, sort_keys=True, ensure_ascii=True).encode()).hexdigest()[:12]


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """A rule table from a list; the place in the list is the priority."""
    text = lambda v: str(v).strip() if v else None
    rows = [
        (k, text(r.get("domain")), text(r.get("substring")), text(r.get("path_prefix")), r.get("path_regex"), {a: str(b) for a, b in (r.get("query_contains") or {}).items()} or None, r.get("target_template"), r.get("target_url"), r.get("target_local_file"), r.get("fit_markdown_selectors"), rule_id(r))
        for k, r in enumerate(rules)
        if isinstance(r, dict)
    ]
    return spark.createDataFrame(rows, RULES)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table from a JSON list; one that isn't there or isn't a list is empty, any other failure is an error."""
    rules = []
    if _exists(spark, path):
        try:
            rules = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
        except ValueError:
            rules = []
    return rules_frame(spark, rules if isinstance(rules, list) else [])


def read_mirror_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string, path string").option("multiLine", True).json(path).where("coalesce(url, '') <> ''")


def read_html_files(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Local files as result rows: PDF and other binaries by suffix, HTML and text decoded.

    Files outside of ``root``, where it is given, come with status 0 and
    without content.
    """
    rows = spark.read.format("binaryFile").load(path)
    name = F.lower("path")
    kind = F.when(name.endswith(".pdf"), "application/pdf").when(name.rlike(r"\.html?$"), "text/html").otherwise("text/plain")
    inside = F.lit(True)
    if root is not None:
        bare = F.regexp_replace("path", "^file:/*", "/")
        inside = bare.startswith(os.path.realpath(root).rstrip("/") + "/") & ~bare.contains("/../")
    raw = F.when(inside, F.col("content"))
    return rows.select(
        F.col("path").alias("url"), F.when(inside, 200).otherwise(0).alias("status"), kind.alias("content_type"), decode_bytes(F.when(~name.endswith(".pdf"), raw), kind).alias("text"), raw.alias("raw_bytes"), F.lit("file").alias("method"),
        F.when(~inside, "outside_of_root").alias("error"),
    )


def read_stdin_manifest(spark: SparkSession, lines) -> DataFrame:
    """A manifest from an open file, as standard input is."""
    return parse_manifest(spark.createDataFrame([(k, line.rstrip("\n")) for k, line in enumerate(lines)], "seq long, value string"))

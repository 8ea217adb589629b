"""What a session and its environment offer, as checks."""

from __future__ import annotations

import os
import shutil
from collections.abc import Mapping
from importlib.util import find_spec

from pyspark.sql import SparkSession

from ..settings import as_bool


def check(name: str, ok: bool, detail: str, remedy: str = "", level: str = "warn", value: str | None = None) -> dict:
    """One check; a value that is there is shown by its first and last signs only."""
    out = {"name": name, "status": "ok" if ok else "missing", "level": level, "detail": detail}
    if remedy and not ok:
        out["remedy"] = remedy
    if value:
        out["value"] = "*" * len(value) if len(value) <= 8 else f"{value[:4]}...{value[-4:]}"
    return out


def checks(spark: SparkSession | None = None, rules_path: str | None = None, env: Mapping[str, str] = os.environ) -> list[dict]:
    out = [
        check("java", shutil.which("java") is not None or "JAVA_HOME" in env, "needed by Spark", "Install a Java runtime."),
        check("pyarrow", find_spec("pyarrow") is not None, "needed by functions of Arrow batches", "Install pyarrow."),
        check("search_key", bool(env.get("WEFTLAKE_SEARCH_KEY")), "lets an ingestion step look up alternates", "Set WEFTLAKE_SEARCH_KEY.", "info", env.get("WEFTLAKE_SEARCH_KEY")),
        check("cache", not as_bool(env.get("WEFTLAKE_CACHE_DISABLE")), "snapshots are read", "Unset WEFTLAKE_CACHE_DISABLE.", "info"),
    ]
    if rules_path:
        out.append(check("rules", os.path.exists(rules_path), rules_path, "Give a rule file that exists."))
    if spark is not None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        local = spark.sparkContext.master.startswith("local")
        out += [
            check("adaptive", spark.conf.get("spark.sql.adaptive.enabled", "true") == "true", "joins are planned again at run time", "Set spark.sql.adaptive.enabled to true."),
            check("checkpoint_dir", local or bool(shared), "a folder that all executors share", "Set spark.checkpoint.dir."),
        ]
    return out


def report(found: list[dict]) -> dict:
    """The checks, and whether none of level ``warn`` is missing."""
    return {"ok": all(c["status"] == "ok" or c["level"] != "warn" for c in found), "checks": found, "warnings": [c for c in found if c["status"] != "ok"]}

"""Alternate sources proposed by a language model: reading raw responses, filtering, prompting."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.content import normalize_title
from ..functions.paywall import hinted
from ..functions.urls import authority, looks_gated_url
from ..policy import DEFAULT, Policy

ITEM = T.StructType([T.StructField(c, T.DoubleType() if c == "score" else T.StringType()) for c in ("url", "title", "summary", "score", "html_excerpt")])
SCHEMA = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("note", T.StringType()), T.StructField("items", T.ArrayType(ITEM))])


def salvage(content: str | None):
    """The JSON in a response: all of it, a fenced block, or what is between its outer braces; None if there is none."""
    text = (content or "").strip()
    fenced = [p.strip().removeprefix("json").strip() for p in text.split("```")[1:]] if "```" in text else []
    a, b = text.find("{"), text.rfind("}")
    for candidate in [text, *(p for p in fenced if p.startswith("{")), text[a : b + 1] if 0 <= a < b else ""]:
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return None


def _clean(item) -> dict | None:
    get = lambda *ks: next((s for k in ks if (s := str(item.get(k) or "").strip())), None)
    if not isinstance(item, dict) or not get("url"):
        return None
    try:
        score = float(item["score"])
    except (KeyError, TypeError, ValueError):
        score = None
    return {"url": get("url"), "title": get("title"), "summary": get("summary"), "score": score, "html_excerpt": get("html_excerpt", "html", "content", "summary")}


@F.pandas_udf(SCHEMA)
def parse_response(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for r in raw:
        data = salvage(r)
        fields = data if isinstance(data, dict) else {}
        listed, note = fields.get("alternates"), fields.get("note")
        items = [c for i in listed if (c := _clean(i))] if isinstance(listed, list) else []
        rows.append((isinstance(listed, list), note if note is None else str(note), items))
    return pd.DataFrame(rows, columns=["ok", "note", "items"])


def filter_suggestions(suggestions: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Suggestions (control_title, source_title, url, title, summary, html_excerpt) that can be tried.

    Where a source title is given, titles must agree but for case and signs; an
    excerpt is required; gated and excluded sites go.
    """
    site = F.regexp_replace(F.lower(authority(F.col("url"))), r"^www\.", "")
    same = F.coalesce(F.col("source_title"), F.lit("")) == ""
    return suggestions.where(
        (same | (normalize_title(F.col("title")) == normalize_title(F.col("source_title"))))
        & (F.coalesce("html_excerpt", F.lit("")) != "")
        & ~looks_gated_url(F.col("url"), tuple("account login paywall signin subscribe".split()))
        & ~hinted(F.col("summary"), policy)
        & ~F.coalesce(site.isin(*sorted(policy.no_search)), F.lit(False))
    )


def build_prompt(controls: DataFrame) -> DataFrame:
    """Controls with the JSON that asks for alternates."""
    cols = [c for c in ("control_id", "title", "source_title", "failed_url", "status") if c in controls.columns]
    return controls.withColumn("prompt", F.to_json(F.struct(F.lit("Find public alternates of the failed source.").alias("task"), F.struct(*cols).alias("control"))))

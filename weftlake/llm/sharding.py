"""Sharding by sampled splitters.

Records are sampled with a chance in proportion to their size, quantiles of
the sample (each record weighted by the inverse of its chance) become the
boundaries of as many ranges of keys as there are shards, and a range that
still holds too much, because one key or few fill it, is subdivided by a hash
of the id.  Records aren't sorted; they learn their range from the boundaries,
broadcast while they are few and by a distributed merge otherwise.  The sample
is as large as OVERSAMPLE times the shards, so it isn't gathered either: its
quantiles come from a range partitioning of the sample and sums of its parts.

There are at least MIN_SHARDS shards, for as many readers, and more where they
would hold over TARGET_BYTES of text.  A key is several columns one after the
other; numbers are filled with zeros to 20 places.

Defined cases: a null in a key sorts as the empty string, a null text has no
bytes; every record has one byte at least for sampling, so that empty records
are spread too; records that are repeated go to one shard; keys that are equal
are in one range; an empty table gives an empty result.  Only the columns named
are read by assign(); write_shards() writes every row with all its columns,
rows with null or repeated ids too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, isolate, restore, table, uniform, uniform_sql

TARGET_BYTES = 128 << 20
MIN_SHARDS = 64
OVERSAMPLE = 64
SLACK = 1.25
KEY = ("source", "doc_id")
#: Boundaries that are sent to all tasks; more are merged with the keys.
BROADCAST_BOUNDARIES = 200_000


def _cumulated(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with ``cum``, the sum of ``value`` up to each row in the order of ``by``, whose values must differ; no task sees more than a part of them."""
    part = cut(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    held = sorted((r["part"], r["v"]) for r in part.groupBy("part").agg(F.sum(value).alias("v")).collect())  # a row for each task
    ahead = np.concatenate([[0], np.cumsum([v for _, v in held], dtype="i8")]).tolist()
    offset = part.sparkSession.createDataFrame([(p, a) for (p, _), a in zip(held, ahead)] or [(0, 0)], "part int, ahead long")
    inside = F.sum(value).over(Window.partitionBy("part").orderBy(*by))
    return part.join(F.broadcast(offset), "part").withColumn("cum", (inside + F.col("ahead")).cast("long")).drop("part", "ahead")


def boundaries(records: DataFrame, shards: int, total: int, oversample: int = OVERSAMPLE, seed: int = 1) -> DataFrame:
    """(key): upper ends of the ranges but the last, from (id, key, w)."""
    want = float(oversample * shards)
    least = int(np.ceil(total / want)) if total else 1
    sample = records.where(uniform(F.col("id"), seed) < F.lit(want) * F.col("w") / F.lit(float(total))).select("key", F.greatest("w", F.lit(least)).cast("long").alias("h"))
    run = cut(sample.groupBy("key").agg(F.sum("h").alias("h")))
    held = float(run.agg(F.sum("h")).first()[0] or 0)
    step = lambda c: F.floor(c.cast("double") * shards / F.lit(held))
    run = _cumulated(run, ["key"], "h")
    return run.where((step(F.col("cum")) > step(F.col("cum") - F.col("h"))) & (F.col("cum") < held)).select("key")


def _count_below(ends: list[str]):
    ends = np.array(sorted(ends), object)

    @F.pandas_udf("int")
    def rank(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, key.to_numpy(object), "left").astype("int32"))

    return rank


def _rank_by_merge(records: DataFrame, ends: DataFrame) -> DataFrame:
    """As by broadcast, for any number of boundaries: keys and boundaries are range-partitioned together."""
    keys = records.select("key").distinct().select("key", F.lit(1).alias("kind"))
    every = keys.unionByName(ends.select("key", F.lit(2).alias("kind")))  # a key that is a boundary comes first
    ranks = _cumulated(every.withColumn("is_end", (F.col("kind") == 2).cast("long")), ["key", "kind"], "is_end").where("kind = 1")
    return records.join(ranks.select("key", F.col("cum").cast("int").alias("range_id")), "key")


def _key(columns: list[Column], kinds: list[str]) -> Column:
    whole = ("tinyint", "smallint", "int", "bigint")
    return F.concat_ws("/", *(F.coalesce(F.lpad(c.cast("string"), 20, "0") if k in whole else c.cast("string"), F.lit("")) for c, k in zip(columns, kinds)))


def _sharded(docs: DataFrame, key_cols, id_col, text_col, target_bytes, min_shards, oversample, slack, seed, broadcast_boundaries, light: bool) -> DataFrame:
    """Rows with (id, key, n_bytes, range_id, part, n_parts) beside their own columns, or without these if ``light``."""
    key_cols = (key_cols,) if isinstance(key_cols, str) else tuple(key_cols)
    inner, (i, t, *k) = isolate(docs, id_col, text_col, *key_cols)
    kinds = inner.select(*k).dtypes
    size = F.coalesce(F.octet_length(t.cast("string")), F.lit(0)).cast("long")
    own = [i.alias("id"), _key(k, [kind for _, kind in kinds]).alias("key"), size.alias("n_bytes"), F.greatest(size, F.lit(1)).alias("w")]
    records = cut(inner.select(*own))
    total = records.agg(F.sum("w")).first()[0] or 0
    shards = max(min_shards, -(-total // target_bytes))
    target = total / shards
    ends = cut(boundaries(records, shards, total, oversample, seed)) if shards > 1 and total else records.select("key").limit(0)
    if ends.count() <= broadcast_boundaries:
        rank = _count_below([r["key"] for r in ends.collect()])
        ranged = lambda rows: rows.withColumn("range_id", rank("key"))
    else:
        ranged = lambda rows: _rank_by_merge(rows, ends)
    # one row for a range, no more than shards
    parts = ranged(records).groupBy("range_id").agg(F.sum("w").alias("held"))
    parts = parts.select("range_id", F.when(F.col("held") > slack * target, F.ceil(F.col("held") / F.lit(target))).otherwise(1).cast("int").alias("n_parts"))
    out = ranged(records if light else inner.select("*", *own)).join(cut(parts), "range_id")  # small, so the planner broadcasts it by its measured size
    return out.withColumn("part", F.floor(uniform(F.col("id"), f"part{seed}") * F.col("n_parts")).cast("int"))


def assign(
    docs: DataFrame,
    key_cols=KEY,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_bytes: int = TARGET_BYTES,
    min_shards: int = MIN_SHARDS,
    oversample: int = OVERSAMPLE,
    slack: float = SLACK,
    seed: int = 1,
    broadcast_boundaries: int = BROADCAST_BOUNDARIES,
) -> DataFrame:
    """(doc_id, range_id, part, n_parts, n_bytes) of each record; (range_id, part) names its shard."""
    rows = _sharded(docs, key_cols, id_col, text_col, target_bytes, min_shards, oversample, slack, seed, broadcast_boundaries, True)
    return rows.select(F.col("id").alias("doc_id"), "range_id", "part", "n_parts", "n_bytes")


def write_shards(
    docs: DataFrame,
    path: str,
    key_cols=KEY,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_bytes: int = TARGET_BYTES,
    min_shards: int = MIN_SHARDS,
    oversample: int = OVERSAMPLE,
    slack: float = SLACK,
    seed: int = 1,
    broadcast_boundaries: int = BROADCAST_BOUNDARIES,
) -> str:
    """Write ``docs`` with one folder for each shard; returns the name of the column that these folders give, ``__shard`` or, if there is one, a longer name."""
    rows = _sharded(docs, key_cols, id_col, text_col, target_bytes, min_shards, oversample, slack, seed, broadcast_boundaries, False)
    name = "__shard"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    number = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    own = restore(rows, docs).columns
    marked = rows.select(*(F.col(f"__in{k}").alias(c) for k, c in enumerate(own)), F.concat_ws("-", number("range_id"), number("part")).alias(name))
    shards = rows.select("range_id", "n_parts").distinct().agg(F.sum("n_parts")).first()[0] or 1
    marked.repartition(min(int(shards), 100_000), name).write.partitionBy(name).parquet(path)
    return name


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


SQL = f"""
WITH records AS (
  SELECT doc_id, coalesce(source, '') || '/' || coalesce(lpad(doc_id::VARCHAR, 20, '0'), '') AS key,
    coalesce(strlen(text), 0) AS n_bytes, greatest(coalesce(strlen(text), 0), 1) AS w FROM documents),
size AS (SELECT sum(w)::DOUBLE AS total, greatest({MIN_SHARDS}, ceil(sum(w) / {TARGET_BYTES}.0))::BIGINT AS shards FROM records),
sample AS (
  SELECT key, sum(greatest(w, ceil(total / ({OVERSAMPLE}.0 * shards))::BIGINT))::DOUBLE AS h FROM records, size
  WHERE {uniform_sql("doc_id", 1)} < ({OVERSAMPLE}.0 * shards)::DOUBLE * w / total GROUP BY key),
run AS (SELECT key, h, sum(h) OVER (ORDER BY key) AS cum, sum(h) OVER () AS allh FROM sample),
ends AS (SELECT key FROM run, size WHERE floor(cum * shards / allh) > floor((cum - h) * shards / allh) AND cum < allh),
ranged AS (SELECT r.*, (SELECT count(*) FROM ends e WHERE e.key < r.key)::INTEGER AS range_id FROM records r),
parts AS (SELECT range_id, CASE WHEN sum(w) > {SLACK} * min(total / shards) THEN ceil(sum(w) / min(total / shards)) ELSE 1 END::INTEGER AS n_parts FROM ranged, size GROUP BY range_id)
SELECT doc_id, range_id, floor({uniform_sql("doc_id", "part1")} * n_parts)::INTEGER AS part, n_parts, n_bytes::BIGINT AS n_bytes
FROM ranged JOIN parts USING (range_id)
"""

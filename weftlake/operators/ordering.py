"""Running sums and numbers over a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket; a frame of fewer is one bucket.
BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 10_000


def running(rows: DataFrame, order: str, bucket_rows: int = BUCKET_ROWS, **values: Column) -> DataFrame:
    """``rows`` with, for each of ``values``, its sum up to and with each row in order of the number ``order`` (nulls first, ties in any order).

    Rows are dealt to buckets by quantiles of ``order``, which are literals of
    the plan, so a bucket is the same however often it is computed; a window
    sums within the bucket, and the sums of the buckets before it are added.
    """
    n = rows.count()
    buckets = min(MOST_BUCKETS, -(-n // bucket_rows))
    ends = []
    if buckets > 1:
        ends = sorted(set(rows.agg(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] or []))
    own = F.lit(0)
    if ends:
        own = F.when(F.col(order).isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col(order))))
    keyed = rows.withColumn("__bucket", own).withColumns({f"__{k}": v.cast("long") for k, v in values.items()})
    held = sorted(tuple(r) for r in keyed.groupBy("__bucket").agg(*(F.sum(f"__{k}") for k in values)).collect()) if ends else []  # a row for each bucket
    inside = Window.partitionBy("__bucket").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for j, k in enumerate(values):
        ahead, so_far = {}, 0
        for row in held:
            ahead[row[0]] = so_far
            so_far += row[j + 1] or 0
        base = F.try_element_at(F.create_map(*(F.lit(x) for kv in ahead.items() for x in kv)), F.col("__bucket")) if ahead else F.lit(0)
        out[k] = F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0)) + F.coalesce(base, F.lit(0))
    return keyed.withColumns(out).drop("__bucket", *(f"__{k}" for k in values))


def numbered(rows: DataFrame, order: str, name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with numbers from 0 in order of the number ``order``."""
    return running(rows, order, bucket_rows, **{name: F.lit(1)}).withColumn(name, F.col(name) - 1)

"""Exact deduplication with a split of heavy hitters.

Digests are SHA-256 of the text.  A Misra-Gries pass finds every digest that
could exceed a share of the rows; an exact count verifies those, and the few
that hold are broadcast (``1 / share`` rows at most, whatever the input), so
that copies of them go on the map side, before any shuffle.  All other digests
take the ordinary shuffle, where no key can be hot any more.

Defined cases: a null text has nothing to compare, so each such row stays; the
empty text is a text like any other; of repeated rows one stays; the row with
the smallest id stays (null ids last).  Other columns pass through, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, isolate, restore, table

HEAVY_SHARE = 1e-3
#: Texts with copies, of some 100 bytes each as a table in memory, that are sent to all tasks.
BROADCAST_LOSERS = 500_000


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _misra_gries(k: int):
    def run(batches):
        kept = pd.Series(dtype="int64")
        for pdf in batches:
            kept = kept.add(pdf["d"].value_counts(), fill_value=0)
            if len(kept) > k:  # as many decrements of k + 1 counters at once
                kept -= np.partition(kept.to_numpy(), len(kept) - k - 1)[len(kept) - k - 1]
                kept = kept[kept > 0]
        yield pd.DataFrame({"d": list(kept.index), "n": kept.to_numpy(dtype="int64")})

    return run


def heavy_hitters(digests: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(d, id, n): verified digests of at least ``share`` of the rows of (d, id), two rows at least."""
    k = int(np.ceil(1 / share))
    parts = digests.where("d is not null").select("d").mapInPandas(_misra_gries(k), "d binary, n long")
    # all summaries at once: what the (k + 1)th counter has is what a merge takes off every counter
    top = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(k + 1).collect()
    floor = top[k]["n"] if len(top) > k else 0
    spark = digests.sparkSession
    maybe = spark.createDataFrame([(r["d"],) for r in top if r["n"] > floor], "d binary")
    total = digests.count()
    return (
        digests.join(F.broadcast(maybe), "d")
        .groupBy("d")
        .agg(F.min("id").alias("id"), F.count("*").alias("n"))
        .where(F.col("n") >= max(2, share * total))
    )


def _winners(digests: DataFrame, share: float) -> DataFrame:
    """The heavy hitters as a local table: at most 1 / share rows."""
    rows = heavy_hitters(digests, share).collect()
    kind = dict(digests.dtypes)["id"]
    return digests.sparkSession.createDataFrame([(r["d"], r["id"], r["n"]) for r in rows], f"d binary, id {kind}, n long")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = HEAVY_SHARE) -> DataFrame:
    """One row for each text: (doc_id that stays, digest in hex or null, n_copies)."""
    inner, (i, t) = isolate(docs, id_col, text_col)
    digests = cut(inner.select(i.alias("id"), digest(t).alias("d")))
    hot = _winners(digests, share)
    rest = digests.where("d is not null").join(F.broadcast(hot.select("d")), "d", "left_anti")
    groups = rest.groupBy("d").agg(F.min("id").alias("id"), F.count("*").alias("n")).unionByName(hot)
    alone = digests.where("d is null").select("d", "id", F.lit(1).cast("long").alias("n"))
    return groups.unionByName(alone).select(F.col("id").alias("doc_id"), F.lower(F.hex("d")).alias("digest"), F.col("n").alias("n_copies"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = HEAVY_SHARE, broadcast_losers: int = BROADCAST_LOSERS) -> DataFrame:
    """``docs`` with one row for each text, all columns as they are.

    The copies that go are found by digests and ids alone.  Up to
    ``broadcast_losers`` of them are taken out on the map side, so that no text
    is shuffled; beyond that, rows are shuffled by digest.
    """
    inner, (i, t) = isolate(docs, id_col, text_col)
    digests = cut(inner.select(i.alias("id"), digest(t).alias("d")))
    hot = _winners(digests, share)
    rest = digests.where("d is not null").join(F.broadcast(hot.select("d")), "d", "left_anti")
    # of a text: the least id, and whether rows with that id are repeated
    counted = rest.groupBy("d", "id").count().groupBy("d").agg(F.min(F.struct(F.col("id").isNull(), "id", "count")).alias("first"), F.sum("count").alias("n")).where("n > 1")
    copied = cut(counted.select("d", F.col("first.id").alias("id"), (F.col("first.count") > 1).alias("again")).unionByName(hot.select("d", "id", F.lit(True).alias("again"))))
    copied = copied.select(F.col("d").alias("copied"), F.col("id").alias("winner"), "again")
    small = copied.limit(broadcast_losers + 1).count() <= broadcast_losers
    marked = inner.withColumn("d", digest(t)).join(F.broadcast(copied if small else hot.select(F.col("d").alias("copied"), F.col("id").alias("winner"), F.lit(True).alias("again"))), F.col("d") == F.col("copied"), "left")
    left = marked.where(F.col("copied").isNull() | i.eqNullSafe(F.col("winner")))  # the copies known here go without a shuffle
    plain = [f"__in{k}" for k, (_, kind) in enumerate(inner.dtypes) if "map<" not in kind and kind != "variant"]
    # rows with the same text and id: one of them stays, whichever is first by its other columns
    once = lambda rows: rows.withColumn("__rank", F.row_number().over(Window.partitionBy("d").orderBy(i.asc_nulls_last(), F.xxhash64(*plain)))).where("__rank = 1").drop("__rank")
    if small:
        kept = left.where("again is null or not again").unionByName(once(left.where("again")))
    else:
        kept = left.where("d is null").unionByName(once(left.where("d is not null")))
    return restore(kept, docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS n_copies
FROM documents GROUP BY text
"""

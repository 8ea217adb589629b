"""The corpus pipeline: language ID, exact and near deduplication, mixing and packing.

Each stage is one operator applied to all that its predecessor kept; the result
is written as Parquet and read again as the next stage's documents.  All but
the last return the columns of ``documents``.

The language stage sets ``lang`` to the language it tells, so the mixing stage
rakes by that; packing tells which bytes of which document a window holds.

Defined cases: rows without letters, with a null text among them, go in the
language stage; of rows with equal texts the one with the least id stays; a
null id is an id without near copies; further columns pass through to packing,
whatever their names; a null source is a source; empty tables give empty
results.

SQL can't express the language stage (trained support vector machines), so
there is no ORACLE_SQL; tests compare run() with a brute-force version.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from weftlake.llm import common, exact_dedup, language_id, mixing, ngram_join, packing


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence, under that language; those rejected go."""
    return language_id.keep_accepted(docs, language_id.train(docs), lang_col="lang")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity."""
    return ngram_join.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked source, language and topic weights."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of several context sizes."""
    return packing.pack(docs)


STAGES = [
    ("language", by_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    What a stage keeps is in the session's shared folder (spark.checkpoint.dir)
    until the next one has been written; the last result stays there, as the
    frame returned reads it.
    """
    folder, done = os.path.join(common.shared_folder(spark), f"pipeline-{uuid.uuid4().hex}"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            _remove(spark, done)
        done = path
    return docs

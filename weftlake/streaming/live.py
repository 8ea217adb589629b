"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.urls import normalize_url

CHANGES = "url_norm string, fetched_at string, seq long, content_sha256 string, content_previous_sha256 string, content_changed boolean"
NAMES = [c.split()[0] for c in CHANGES.split(", ")]


def _chain(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of the rows of one URL: each with the hash before it, the first with the state's."""
    # most URLs have one row in a batch, so what is done for each of them counts
    rows = [r for pdf in batches for r in zip(*(pdf[c].tolist() for c in ("fetched_at", "seq", "sha")))]
    if len(rows) > 1:
        rows.sort(key=lambda r: (r[0] is None, r[0], r[1] is None or r[1] != r[1], r[1]))
    at, seq, sha = map(list, zip(*rows))
    before = [state.get[0] if state.exists else None, *sha[:-1]]
    state.update((sha[-1],))
    yield pd.DataFrame(dict(zip(NAMES, ([key[0]] * len(rows), at, seq, sha, before, [b != s for b, s in zip(before, sha)]))), copy=False)


def stream_changes(results: DataFrame) -> DataFrame:
    """Content changes of a stream of results (url, text, fetched_at, seq), with the last hash of each URL as state."""
    hashed = results.where("length(coalesce(text, '')) > 0").select(normalize_url(F.col("url")).alias("url_norm"), F.sha2("text", 256).alias("sha"), "fetched_at", "seq")
    return hashed.groupBy("url_norm").applyInPandasWithState(_chain, CHANGES, "sha string", "append", GroupStateTimeout.NoTimeout)


def _watermarked(events: DataFrame, time_col: str, late: str) -> DataFrame:
    """Streams with a watermark, which needs a time with a zone; batches as they are."""
    if not events.isStreaming:
        return events
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)


def rates(events: DataFrame, time_col: str = "ts", key_col: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and tumbling window; batches and streams alike, late rows dropped by watermark."""
    e = _watermarked(events, time_col, late)
    return e.groupBy(F.window(time_col, size).alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "key", "n", "total")


def sessions(events: DataFrame, time_col: str = "ts", key_col: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = _watermarked(events, time_col, late)
    return e.groupBy(F.session_window(time_col, gap).alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("session_start"), "n")


def each_batch(results: DataFrame, annotate: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, progress: Callable[[int, int], None] | None = None):
    """The whole chain on each micro-batch; ``write`` gets annotated rows and must be idempotent for exactly-once output.

    ``progress`` is told the number of each batch written and its rows; an
    error in it doesn't end the query.
    """

    def run(rows: DataFrame, number: int) -> None:
        write(annotate(rows))
        if progress:
            try:
                progress(number, rows.count())
            except Exception:  # noqa: BLE001, S110 - a hook isn't part of the run
                pass

    return results.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def run_once(frame: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """What a streaming frame gives for all that is there now: the last complete table, or with ``append`` or ``update`` all rows, under ``folder``."""
    how = "overwrite" if mode == "complete" else "append"
    q = frame.writeStream.outputMode(mode).foreachBatch(lambda rows, _: rows.write.mode(how).parquet(f"{folder}/rows")).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/rows")

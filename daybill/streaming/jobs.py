"""Structured Streaming jobs: impression de-duplication, funnels, failure streaks, catalog upserts, expiry.

Every job takes a streaming (or batch) DataFrame and returns one; sinks and triggers stay with the caller. Late data beyond
the watermark is dropped by Spark; state is bounded by the watermark or by the number of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import urls
from ..operators.keep import keep_last
from ..session import ship

REFRESH_TRIGGER = {"processingTime": "60 minutes"}


def first_impressions(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """One impression per key within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def funnel(events: DataFrame, name: str, delay: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Counts per interaction and hour, final once the watermark passes the hour."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", size), name).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("hour"), name, "n")


STREAK_SCHEMA = "source BIGINT, ts TIMESTAMP, event_id BIGINT, failure_streak BIGINT"


class StreakProcessor(StatefulProcessor):
    """Consecutive failures of a source, carried across micro-batches; one counter of state per source.

    A streak depends on the order of runs, and the chunks of a source arrive unordered, so the source's rows of one
    micro-batch are sorted together. The trigger's ``maxFilesPerTrigger``/``maxBytesPerTrigger`` bounds them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "failures BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = int(self.streak.get()[0]) if self.streak.exists() else 0
        runs = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        failed = (~runs["ok"].astype(bool)).astype("int64")
        island = runs["ok"].astype(int).cumsum()
        streaks = failed.groupby(island).cumsum() + failed.where(island == 0, 0).gt(0) * before
        self.streak.update((int(streaks.iloc[-1]),))
        yield pd.DataFrame({"source": key[0], "ts": runs["ts"], "event_id": runs["event_id"], "failure_streak": streaks})

    def close(self) -> None:
        pass


def failure_streaks(runs: DataFrame) -> DataFrame:
    """Streak after every run; ``runs``: ``source, ts, event_id, ok``."""
    ship(runs.sparkSession)
    return runs.groupBy("source").transformWithStateInPandas(
        statefulProcessor=StreakProcessor(), outputStructType=STREAK_SCHEMA, outputMode="Append", timeMode="None"
    )


def changed_rows(batch: DataFrame, current: DataFrame, key: str, fields: list[str | Column]) -> DataFrame:
    """Rows of a batch that are new or differ in a display field."""
    fresh = batch.withColumn("content_hash", urls.content_hash(fields))
    known = current.select(F.col(key).alias("_k"), F.col("content_hash").alias("_h"))
    joined = fresh.join(known, F.col(key) == F.col("_k"), "left")
    return joined.filter(F.col("_h").isNull() | (F.col("_h") != F.col("content_hash"))).drop("_k", "_h")


def upsert(current: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The catalog after an upsert: changed rows replace their predecessors."""
    return current.join(changed.select(key), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def stream_of(spark, checkpoint: str) -> str:
    """The identity of the stream that owns a checkpoint folder; a new folder makes a new stream."""
    return spark.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def upsert_writer(root: str, key: str, fields: list[str], order: list[str], checkpoint: str | None = None, part: str | None = None, gates=None):
    """A ``foreachBatch`` function that publishes a new catalog version only when content changed.

    A batch is known by the stream that owns ``checkpoint`` and its number; one that is replayed after it was published
    does nothing, one replayed after a crash before that writes its version anew. Versions are numbered apart from
    batches, so a stream with a new checkpoint goes on where the catalog stands. A failed read of the catalog fails the
    batch: only the absence of any published version counts as an empty catalog. With ``part`` the catalog is kept by
    that column and a batch rewrites the parts that it touches; ``gates`` is as in ``partitioned.upsert_parts``.
    """
    from ..sources import partitioned
    from ..sources.sinks import next_version, publish_table, published_batches, published_version, read_published

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamp = (stream_of(spark, checkpoint) if checkpoint else "", batch_id)
        if stamp in published_batches(spark, root, batch_id):
            return
        newest = published_version(spark, root)
        latest = keep_last(batch, [key], order)
        if newest is None:
            current = latest.limit(0).withColumn("content_hash", F.lit(""))
        else:
            current = partitioned.read_parts(spark, root) if part else read_published(spark, root)
        changed = changed_rows(latest, current, key, fields)
        if changed.isEmpty():
            return
        version = next_version(newest, batch_id)
        if part:
            partitioned.upsert_parts(changed, root, key, part, version, gates=gates, stamp=stamp)
        else:
            publish_table(upsert(current, changed, key), root, version, stamp=stamp, gates=gates)

    return write


def retained_with_ttl(latest: DataFrame, now: str, ttl_days: int, verified: str = "verified_at") -> DataFrame:
    """Last-known-good rows until their evidence is older than the limit."""
    return latest.filter(F.date_diff(F.lit(now[:10]).cast("date"), F.to_date(verified)) < ttl_days)

"""Streams with state: seen-sets, heartbeats, rate windows, stuck domains; and one-batch-at-a-time sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import url as U

STALE_S = 300


# ---- batch forms over recorded tables


def stale_workers(heartbeats: DataFrame, as_of: F.Column, threshold_s: int = STALE_S) -> DataFrame:
    """``worker_id, domain, last_activity, elapsed_s`` of workers silent for longer than the threshold; beats after ``as_of`` count
    as no time passed."""
    last = heartbeats.groupBy("worker_id").agg(F.max("ts").alias("last_activity"), F.max_by("domain", "ts").alias("domain"))
    gone = last.withColumn("elapsed_s", F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("last_activity").cast("timestamp")))
    return gone.where(F.col("elapsed_s") > threshold_s).select("worker_id", "domain", "last_activity", "elapsed_s")


def rate_violations(requests: DataFrame, most: int, window: str = "1 second") -> DataFrame:
    """``domain, start, n`` of windows with more than ``most`` requests."""
    return requests.groupBy("domain", F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("domain", F.col("w.start").alias("start"), "n")


def token_bucket_waits(requests: DataFrame, per_second: float) -> DataFrame:
    """``requests`` with wait_s: how long each would wait for its turn if a domain's requests are spaced evenly."""
    w = Window.partitionBy("domain").orderBy("ts", "request_id")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ranked = requests.withColumn("__t", t).withColumn("__n", F.row_number().over(w))
    due = F.max(F.col("__t") - F.col("__n") / per_second).over(w) + F.col("__n") / per_second
    return ranked.withColumn("wait_s", F.round(due - F.col("__t"), 6)).drop("__t", "__n")


def stuck_domains(ticks: DataFrame, still: int = 2) -> DataFrame:
    """``domain, tick, reason`` of ticks (domain, tick, page_count, queue_size, active_workers) that show a failure: items but no workers, a
    negative queue, or no progress for ``still`` ticks in a row."""
    w = Window.partitionBy("domain").orderBy("tick")
    same = (F.col("page_count") == F.lag("page_count").over(w)).cast("int")
    moved = ticks.withColumn("__same", F.coalesce(same, F.lit(0))).withColumn("__run", F.sum(1 - F.col("__same")).over(w))
    held = moved.withColumn("__still", F.sum("__same").over(Window.partitionBy("domain", "__run").orderBy("tick")))
    reason = F.when((F.col("queue_size") > 0) & (F.col("active_workers") == 0), "no_workers_with_queue_items").when(F.col("queue_size") < 0, "negative_queue_size").when(F.col("__still") >= still, "no_progress_for_60s")
    return held.withColumn("reason", reason).where("reason IS NOT NULL").select("domain", "tick", "reason")


# ---- streams


def dedup_stream(urls: DataFrame, event_time: str = "ts", delay: str = "10 minutes", url: str = "url") -> DataFrame:
    """The first row of each key within the watermark."""
    return urls.withColumn("key", U.dedup_key(url)).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["key"])


def rate_stream(requests: DataFrame, delay: str = "10 seconds", window: str = "1 second") -> DataFrame:
    return requests.withWatermark("ts", delay).groupBy(F.window("ts", window), "domain").agg(F.count("*").alias("n"))


class _Seen(StatefulProcessor):
    """Forever-remembered keys: emits a key's first row and counts the others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.count.get()[0] if self.count.exists() else 0
        n, first = 0, None
        for pdf in rows:
            if first is None and len(pdf):
                first = pdf.iloc[:1]
            n += len(pdf)
        self.count.update((before + n,))
        if not before and first is not None:
            yield pd.DataFrame({"key": [key[0]], "url": first["url"].tolist()})

    def close(self) -> None:
        pass


def first_seen_stream(urls: DataFrame, url: str = "url") -> DataFrame:
    """``key, url`` of keys never met before, with state kept per key."""
    keyed = urls.select(U.dedup_key(url).alias("key"), F.col(url).alias("url")).where("key IS NOT NULL")
    return keyed.groupBy("key").transformWithStateInPandas(_Seen(), "key string, url string", "Append", "None")


class _Silent(StatefulProcessor):
    """A timer per beat: it fires ``threshold`` later and counts unless another beat came."""

    def __init__(self, threshold_ms: int) -> None:
        self.threshold_ms = threshold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = max(int(pdf["ts"].max().timestamp() * 1000) for pdf in rows)
        old = self.last.get()[0] if self.last.exists() else None
        if old is None or latest > old:
            self.last.update((latest,))
            self.handle.registerTimer(latest + self.threshold_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None and last + self.threshold_ms <= expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame({"worker_id": [str(key[0])], "last_ms": [last]})
            self.last.clear()

    def close(self) -> None:
        pass


def stale_stream(heartbeats: DataFrame, threshold_s: int = STALE_S, delay: str = "10 seconds") -> DataFrame:
    """``worker_id, last_ms`` as workers fall silent in event time."""
    beats = heartbeats.withWatermark("ts", delay).groupBy("worker_id")
    return beats.transformWithStateInPandas(_Silent(threshold_s * 1000), "worker_id string, last_ms long", "Append", "EventTime")


def run_sink(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Feeds a sink one batch at a time, in order; a batch repeated after a failure has the same number."""
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()

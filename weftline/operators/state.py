"""Crawl state: the scheduler's order, delta logs, snapshots, compaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U


def fingerprinted(requests: DataFrame, url: str = "url") -> DataFrame:
    """``requests`` with fingerprint: the URL's key and its depth, so a URL at two depths is two requests."""
    return requests.withColumn("fingerprint", F.concat(U.dedup_key(url), F.lit(":"), F.col("depth").cast("string")))


def schedule(requests: DataFrame, order: str = "fifo") -> DataFrame:
    """Accepted requests (the first of equal fingerprints) with their place ``ord``; ``requests``: session_id, seq, url, depth, priority.

    ``fifo`` is the live order; ``priority`` is the order after a restore: descending, stable.
    """
    if order not in ("fifo", "priority"):
        raise ValueError("order must be fifo or priority")
    f = fingerprinted(requests)
    first = f.withColumn("__n", F.row_number().over(Window.partitionBy("session_id", "fingerprint").orderBy("seq"))).where("__n = 1").drop("__n")
    by = [F.col("seq")] if order == "fifo" else [F.col("priority").desc(), F.col("seq")]
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy(*by)))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """``session_id, sequence, pending, visited, total_processed`` of each session's last snapshot."""
    rest = [c for c in snapshots.columns if c not in ("session_id", "sequence")]
    return snapshots.groupBy("session_id").agg(F.max("sequence").alias("sequence"), *[F.max_by(c, "sequence").alias(c) for c in rest])


def replay(deltas: DataFrame, snapshots: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pending, visited, totals) after the log. ``deltas``: session_id, sequence, op, fingerprint; ``snapshots``: session_id,
    sequence, pending array<string>, visited array<string>, total_processed.

    A dequeue takes the oldest pending request of its fingerprint, if there is one. Per (session, fingerprint) that is a counter which never
    goes below zero, so the number taken is the running sum of +1 and -1 less its running minimum: two windows, with no state per session
    in one place. Repeated (session, sequence) rows count once. Deltas up to the snapshot's sequence are its past and are skipped.
    """
    d = deltas.dropDuplicates(["session_id", "sequence"]).select("session_id", "sequence", F.lit(0).alias("k"), "op", "fingerprint")
    totals0 = None
    if snapshots is not None:
        s = latest_snapshot(snapshots)
        d = d.join(s.select("session_id", F.col("sequence").alias("__since")), "session_id", "left").where("__since IS NULL OR sequence > __since").drop("__since")
        held = s.select("session_id", "sequence", F.posexplode("pending").alias("k", "fingerprint")).select("session_id", F.lit(-1).cast("long").alias("sequence"), "k", F.lit("enqueue").alias("op"), "fingerprint")
        done = s.select("session_id", F.posexplode("visited").alias("k", "fingerprint")).select("session_id", F.lit(-1).cast("long").alias("sequence"), "k", F.lit("mark_visited").alias("op"), "fingerprint")
        d = held.unionByName(done).unionByName(d)
        totals0 = s.select("session_id", F.col("total_processed").alias("base"))
    moves = d.where("op IN ('enqueue', 'dequeue')").withColumn("step", F.when(F.col("op") == "enqueue", 1).otherwise(-1))
    w = Window.partitionBy("session_id", "fingerprint").orderBy("sequence", "k")
    run = moves.withColumn("level", F.sum("step").over(w)).withColumn("floor", F.least(F.lit(0), F.min("level").over(w)))
    run = run.withColumn("before", F.coalesce(F.lag("floor").over(w), F.lit(0)))
    # a dequeue below the floor so far found nothing
    run = run.withColumn("took", (F.col("op") == "dequeue") & (F.col("level") >= F.col("before")))
    nth = F.count_if(F.col("op") == "enqueue").over(w)
    took = F.count_if("took").over(Window.partitionBy("session_id", "fingerprint"))
    pending = run.withColumn("nth", nth).withColumn("gone", took).where("op = 'enqueue' AND nth > gone").select("session_id", "sequence", "k", "fingerprint")
    pending = pending.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("sequence", "k"))).select("session_id", "pos", "fingerprint")
    visited = d.where("op = 'mark_visited'").groupBy("session_id", "fingerprint").agg(F.min("sequence").alias("since"))
    sessions = d.select("session_id").union(deltas.select("session_id"))
    if totals0 is not None:
        sessions = sessions.union(totals0.select("session_id"))
    totals = sessions.distinct().join(run.where("took").groupBy("session_id").agg(F.count("*").alias("n")), "session_id", "left")
    if totals0 is not None:
        totals = totals.join(totals0, "session_id", "left")
    base = F.coalesce("base", F.lit(0)) if totals0 is not None else F.lit(0)
    return pending, visited, totals.select("session_id", (F.coalesce("n", F.lit(0)) + base).alias("total_processed"))


def as_state(pending: DataFrame, visited: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per session, as a snapshot holds it."""
    p = pending.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fingerprint"))), lambda x: x["fingerprint"]).alias("pending"))
    v = visited.groupBy("session_id").agg(F.array_sort(F.collect_set("fingerprint")).alias("visited"))
    empty = F.array().cast("array<string>")
    j = totals.join(p, "session_id", "left").join(v, "session_id", "left")
    return j.select("session_id", F.coalesce("pending", empty).alias("pending"), F.coalesce("visited", empty).alias("visited"), "total_processed")


def compact(deltas: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The deltas that a restore still needs: those from the latest snapshot's sequence on."""
    s = latest_snapshot(snapshots).select("session_id", F.col("sequence").alias("__s"))
    return deltas.join(s, "session_id", "left").where("__s IS NULL OR sequence >= __s").drop("__s")


@dataclass(frozen=True)
class SnapshotPolicy:
    every: int = 1000
    most_deltas: int = 500
    batch: int = 10
    compaction: bool = True

    def due(self, operations: int, last_sequence: int, forced: bool = False) -> bool:
        return forced or operations % self.every == 0 or operations - last_sequence >= self.most_deltas


def choose_strategy(capabilities: set[str]) -> str:
    """hybrid with deltas and snapshots, delta with deltas, else full."""
    if {"delta", "snapshot"} <= capabilities:
        return "hybrid"
    return "delta" if "delta" in capabilities else "full"


def list_sessions(snapshots: DataFrame, deltas: DataFrame) -> DataFrame:
    """``session_id, updated``: the last first."""
    both = snapshots.select("session_id", "ts").unionByName(deltas.select("session_id", "ts"))
    return both.groupBy("session_id").agg(F.max("ts").alias("updated")).orderBy(F.col("updated").desc(), "session_id")

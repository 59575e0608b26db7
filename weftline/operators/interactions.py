"""Recorded network logs: which control revealed a request, and what a sweep amounts to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def network_ledger(log: DataFrame, include_documents: bool = False) -> DataFrame:
    """The first of equal (page, method, url) requests, without documents and without the page itself; ``log``: page_url, ts, url,
    method, resource_type."""
    rows = log.where(F.col("url") != F.col("page_url"))
    if not include_documents:
        rows = rows.where("resource_type <> 'document'")
    first = F.row_number().over(Window.partitionBy("page_url", "method", "url").orderBy("ts"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n")


def attribute_requests(log: DataFrame, windows: DataFrame, on: list[str], width: int) -> DataFrame:
    """``log`` (``on``, ts) with control_id of the window (``on``, control_id, open_ts, close_ts) that has open_ts <= ts < close_ts; null if
    none has. Of several the one that opened last counts.

    The range condition becomes an equi-join: a window is put in every cell of ``width`` (in the units of ts, about a window's
    length) that it touches, and a request in its own.
    """
    cells = windows.where("open_ts < close_ts").select(*on, "control_id", "open_ts", "close_ts", F.explode(F.sequence(F.floor(F.col("open_ts") / width), F.floor((F.col("close_ts") - 1) / width))).alias("__cell"))
    keyed = log.withColumn("__row", F.monotonically_increasing_id()).withColumn("__cell", F.floor(F.col("ts") / width))
    w = cells.withColumnsRenamed({c: f"__{c}" for c in on})
    cond = (keyed["__cell"] == w["__cell"]) & (F.col("ts") >= F.col("open_ts")) & (F.col("ts") < F.col("close_ts"))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"__{c}"))
    j = keyed.join(w, cond, "left")
    return j.groupBy("__row", *log.columns).agg(F.max_by("control_id", F.struct("open_ts", "control_id")).alias("control_id")).drop("__row")


def sweep_outcome(controls: DataFrame, observed: DataFrame) -> DataFrame:
    """``page_url, driven, skipped, observed, outcome`` of a sweep; ``controls``: page_url, control_id, driven; ``observed``: page_url."""
    c = controls.groupBy("page_url").agg(F.count_if("driven").alias("driven"), F.count_if(~F.col("driven")).alias("skipped"))
    o = observed.groupBy("page_url").agg(F.count("*").alias("observed"))
    j = c.join(o, "page_url", "left").na.fill(0, ["observed"])
    out = F.when(F.col("driven") + F.col("skipped") == 0, "no-controls-declared").when(F.col("driven") == 0, "no-controls-driven").when(F.col("observed") == 0, "nothing-revealed").otherwise("revealed")
    return j.withColumn("outcome", out)

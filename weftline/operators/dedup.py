"""Keyed URL dedup: first wins, with reasons and counts; seen-sets and frontier anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U


def _keyed(urls: DataFrame, strategy: U.Strategy, url: str, order: str) -> DataFrame:
    key = U.normalize_url(url, strategy) if strategy.www == "preserve" else U.dedup_domain(url)
    www = F.col(url).contains("://www.")
    preferred = {"prefer-www": www, "prefer-non-www": ~www}.get(strategy.www, F.lit(False))
    return urls.withColumn("__key", key).withColumn("__pref", preferred.cast("int"))


def dedup_urls(urls: DataFrame, strategy: U.Strategy = U.Strategy(), url: str = "url", order: str = "pos") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, skipped with reason, stats). Within a key the first preferred row wins, else the first row.

    A row that was the incumbent when a preferred one came is "Replaced"; rows compared with the incumbent of their time
    are "Duplicate". One window per key; a key's rows are streamed, not gathered.
    """
    k = _keyed(urls, strategy, url, order)
    bad = k.where("__key IS NULL")
    w = Window.partitionBy("__key").orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    pref_row = F.when(F.col("__pref") == 1, F.struct(F.col(order), F.col(url)))
    ranked = k.where("__key IS NOT NULL").select(
        *urls.columns, "__key", "__pref", F.row_number().over(w).alias("__n"), F.first(url).over(before).alias("__first"),
        F.first(F.col(url)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__head"),
        F.min(pref_row).over(before).alias("__prefBefore"), F.min(pref_row).over(Window.partitionBy("__key")).alias("__best"),
    )
    head_pref = F.first("__pref").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumn("__headPref", head_pref)
    # the first row is replaced if it isn't preferred and a preferred one follows
    replaced = (F.col("__n") == 1) & (F.col("__headPref") == 0) & F.col("__best").isNotNull()
    taken = F.when(F.col("__best").isNull() | (F.col("__headPref") == 1), F.col("__n") == 1).otherwise(F.col(order) == F.col(f"__best.{order}"))
    incumbent = F.when((F.col("__headPref") == 1) | F.col("__prefBefore").isNull(), F.col("__head")).otherwise(F.col(f"__prefBefore.{url}"))
    reason = F.when(replaced, F.concat(F.lit("Replaced by preferred variant: "), F.col(f"__best.{url}"))).otherwise(F.concat(F.lit("Duplicate of: "), incumbent))
    kept = ranked.where(taken).select(*urls.columns, F.col("__key").alias("key"))
    skipped = ranked.where(~taken).select(*urls.columns, reason.alias("reason")).unionByName(bad.select(*urls.columns, F.concat(F.lit("Invalid URL: "), F.coalesce(F.col(url), F.lit("null"))).alias("reason")))
    stats = k.agg(F.count("*").alias("total"), F.count_distinct("__key").alias("unique"), F.count_if(F.col("__key").isNull()).alias("invalid"))
    duplicates = skipped.agg(F.count_if(F.col("reason").startswith("Duplicate")).alias("duplicates"))
    return kept, skipped, stats.crossJoin(F.broadcast(duplicates)).select("total", "unique", "duplicates", "invalid")


def first_seen(urls: DataFrame, key: Column | str, order: str = "pos") -> DataFrame:
    """``urls`` with is_new: whether a row is the first of its key."""
    key = F.col(key) if isinstance(key, str) else key
    return urls.withColumn("__k", key).withColumn("is_new", F.row_number().over(Window.partitionBy("__k").orderBy(order)) == 1).drop("__k")


def seen_stats(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count("*").alias("processed"), F.count_if("is_new").alias("unique"), F.count_if(~F.col("is_new")).alias("duplicates"))


def not_seen(urls: DataFrame, visited: DataFrame, key: str = "key") -> DataFrame:
    """The rows whose key isn't in ``visited``."""
    return urls.join(visited.select(key).distinct(), key, "left_anti")


def attach_fallbacks(kept: DataFrame, entries: DataFrame) -> DataFrame:
    """Start entries' fallback URLs back on the kept ones; of equal URLs the entry with most fallbacks counts."""
    best = entries.groupBy("url").agg(F.max_by("fallback_urls", F.size("fallback_urls")).alias("fallback_urls"))
    return kept.join(best, "url", "left")


def choose_start(candidates: DataFrame) -> DataFrame:
    """``start_id, chosen, redirected``: the first reachable of primary (pos 0) and fallbacks, else the primary."""
    by = candidates.groupBy("start_id").agg(F.min_by(F.when(F.col("reachable"), F.col("url")), F.when(F.col("reachable"), F.col("pos"))).alias("ok"), F.min_by("url", "pos").alias("primary"))
    return by.select("start_id", F.coalesce("ok", "primary").alias("chosen"), (F.coalesce("ok", "primary") != F.col("primary")).alias("fallback_used"))


def effective_starts(starts: DataFrame, redirects: DataFrame, follow_redirects: bool) -> DataFrame:
    """``starts`` with effective_url: where a cross-domain redirect of the start page led, if that is opted for."""
    if not follow_redirects:
        return starts.withColumn("effective_url", F.col("url"))
    r = redirects.select(F.col("url").alias("__u"), F.col("final_url"))
    moved = U.get_domain("final_url") != U.get_domain("url")
    return starts.join(r, F.col("url") == F.col("__u"), "left").withColumn("effective_url", F.when(moved, F.col("final_url")).otherwise(F.col("url"))).drop("__u", "final_url")

"""A crawl over stored pages: bounded breadth-first traversal as iterated joins, and its retry passes.

The order is that of one worker per start: a queue, level by level, children in (parent, link) order. A level is: first of equal keys,
anti-join with what has been seen, follow rules, robots, join with the page table, and the next level's links. Links are extracted
once, so the loop carries keys and never markup. Each level is cut in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..plans.lineage import cut
from .follow import FollowPolicy, follow_reason
from .robots import Prepared, prepare, robots_verdict


@dataclass
class CrawlTables:
    """visits: one row per seen URL with its outcome; summary: one row per start."""

    visits: DataFrame
    summary: DataFrame

    def results(self) -> DataFrame:
        """Fetched URLs, ok or error."""
        return self.visits.where("outcome IN ('ok', 'error')")

    def visited(self) -> DataFrame:
        return self.visits.select("start_id", "url", "depth")


_VISIT = ("start_id", "seq", "url", "key", "depth", "from_url", "outcome", "reason", "error_kind")


def crawl(
    starts: DataFrame, pages: DataFrame, links: DataFrame, policy: FollowPolicy | None = FollowPolicy(), robots: DataFrame | None = None,
    max_depth: int | None = None, max_pages: int | None = None, restrict_to_start: bool = True, most_levels: int = 1000,
) -> CrawlTables:
    """``starts``: start_id, url. ``pages``: url and, optionally, error_kind (null: fetched). ``links``: url (of the page), pos, abs_url.

    A URL without a page row is an error of kind ``other``. ``max_depth`` 0 or None is unlimited. A start stops with the first fetched
    URL at which the number of seen URLs has reached ``max_pages``; URLs that rules or robots refuse count as seen.
    """
    has_error = "error_kind" in pages.columns
    known = pages.select(U.dedup_key("url").alias("key"), F.lit(True).alias("known"), (F.col("error_kind") if has_error else F.lit(None).cast("string")).alias("page_error")).dropDuplicates(["key"])
    edges = cut(links.select(U.dedup_key("url").alias("key"), "pos", F.col("abs_url").alias("child")).where("child IS NOT NULL"))
    if robots is not None:
        ready = prepare(robots)
        robots = Prepared(cut(ready.rules), cut(ready.facts))
    roots = starts.select("start_id", F.col("url").alias("start_url"))
    frontier = cut(starts.select("start_id", F.lit(0).cast("long").alias("parent"), F.lit(0).alias("pos"), "url", F.lit(None).cast("string").alias("from_url")))
    seen: DataFrame | None = None
    parts: list[DataFrame] = []
    depth = 0
    by_queue = Window.partitionBy("start_id").orderBy("parent", "pos", "url")
    while depth < most_levels:
        level = frontier.withColumn("key", U.dedup_key("url"))
        level = level.withColumn("__n", F.row_number().over(Window.partitionBy("start_id", "key").orderBy("parent", "pos", "url"))).where("__n = 1").drop("__n")
        if seen is not None:
            level = level.join(seen.select("start_id", "key"), ["start_id", "key"], "left_anti")
            base = seen.groupBy("start_id").agg(F.count("*").alias("__before"), F.max(F.col("stopped").cast("int")).alias("__stopped"))
            level = level.join(base, "start_id", "left").where("coalesce(__stopped, 0) = 0").withColumn("__before", F.coalesce("__before", F.lit(0)))
        else:
            level = level.withColumn("__before", F.lit(0).cast("long"))
        level = level.withColumn("seq", F.col("__before") + F.row_number().over(by_queue)).join(roots, "start_id")
        why = follow_reason("url", F.col("from_url"), F.col("start_url") if restrict_to_start else None, policy) if policy is not None else F.lit(None).cast("string")
        level = level.withColumn("follow", why)
        if robots is not None:
            level = robots_verdict(level, robots).withColumnsRenamed({"reason": "robots_reason"}).drop("disallow_rule", "crawl_delay", "unavailable_cause")
        else:
            level = level.withColumn("allowed", F.lit(True)).withColumn("robots_reason", F.lit(None).cast("string"))
        level = level.join(known, "key", "left")
        error = F.when(F.col("known").isNull(), F.lit("other")).otherwise(F.col("page_error"))
        outcome = F.when(F.col("follow").isNotNull(), "filtered").when(~F.col("allowed"), "robots_blocked").when(error.isNotNull(), "error").otherwise("ok")
        level = level.withColumn("outcome", outcome).withColumn("error_kind", F.when(outcome == "error", error))
        fetched = F.col("outcome").isin("ok", "error")
        full = F.lit(False) if not max_pages else fetched & (F.col("seq") >= max_pages)
        level = level.withColumn("__full", full)
        # a start ends with its first full row; what follows in the queue is never taken
        ended = F.coalesce(F.max(F.col("__full").cast("int")).over(by_queue.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        level = level.withColumn("__late", ended == 1).where("NOT __late")
        reason = F.coalesce("follow", F.when(F.col("outcome") == "robots_blocked", F.col("robots_reason")))
        done = cut(level.select("start_id", "seq", "url", "key", F.lit(depth).alias("depth"), "from_url", "outcome", reason.alias("reason"), "error_kind", F.col("__full").alias("stopped")))
        if done.isEmpty():
            break
        # levels are kept side by side and written as one only now and then, so a deep crawl doesn't rewrite all it has seen at each level
        parts.append(done)
        if len(parts) > 8:
            parts = [cut(_union(parts))]
        seen = _union(parts)
        if max_depth and depth >= max_depth:
            break
        going = done.where("outcome = 'ok' AND NOT stopped").select("start_id", F.col("seq").alias("parent"), "key", F.col("url").alias("from_url"))
        frontier = cut(going.join(edges, "key").select("start_id", "parent", "pos", F.col("child").alias("url"), "from_url"))
        if frontier.isEmpty():
            break
        depth += 1
    if seen is None:
        seen = frontier.sparkSession.createDataFrame([], "start_id long, seq long, url string, key string, depth int, from_url string, outcome string, reason string, error_kind string, stopped boolean")
    return CrawlTables(seen.select(*_VISIT), domain_completion(seen, starts, max_pages=max_pages))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def domain_completion(visits: DataFrame, starts: DataFrame, interrupted: DataFrame | None = None, max_pages: int | None = None) -> DataFrame:
    """``start_id, pages_scraped, attempted, failed, blocked, max_depth, reason``: one row per start.

    pages_scraped counts every seen URL, also failed, filtered and blocked ones.
    """
    agg = visits.groupBy("start_id").agg(
        F.count("*").alias("pages_scraped"), F.count_if(F.col("outcome").isin("ok", "error")).alias("attempted"), F.count_if(F.col("outcome") == "error").alias("failed"),
        F.count_if(F.col("outcome") == "robots_blocked").alias("blocked"), F.max("depth").alias("max_depth"),
    )
    j = starts.select("start_id").join(agg, "start_id", "left").na.fill(0, ["pages_scraped", "attempted", "failed", "blocked"])
    cutoff = F.lit(False)
    if interrupted is not None:
        j = j.join(interrupted.select("start_id", F.lit(True).alias("__cut")).distinct(), "start_id", "left")
        cutoff = F.coalesce("__cut", F.lit(False))
    return j.select("start_id", "pages_scraped", "attempted", "failed", "blocked", "max_depth", completion_reason(cutoff, F.col("pages_scraped") >= max_pages if max_pages else F.lit(False), F.col("attempted"), F.col("failed"), F.col("blocked")).alias("reason"))


def completion_reason(interrupted, max_pages, attempted, failed, blocked):
    return (
        F.when(interrupted, "interrupted").when(max_pages, "max_pages").when((attempted == 0) & (blocked > 0), "robots_blocked")
        .when((attempted > 0) & (failed == attempted), "all_fetches_failed").otherwise("queue_empty")
    )


@dataclass(frozen=True)
class DomainRetry:
    max_passes: int = 2
    reasons: tuple[str, ...] = ("all_fetches_failed", "error")
    max_attempted: int = 1

    def __post_init__(self) -> None:
        if self.max_passes < 1 or self.max_attempted < 0:
            raise ValueError("max_passes must be at least 1 and max_attempted at least 0")


def residual(summary: DataFrame, retry: DomainRetry) -> DataFrame:
    """``start_id, previous_reason`` of the starts that another pass takes."""
    return summary.where(F.col("reason").isin(list(retry.reasons)) & (F.col("attempted") <= retry.max_attempted)).select("start_id", F.col("reason").alias("previous_reason"))


def crawl_passes(starts: DataFrame, pages_by_pass: list[DataFrame], links: DataFrame, retry: DomainRetry = DomainRetry(), **settings) -> DataFrame:
    """Summaries of all passes with cycle and previous_reason. Each pass sees its own page table (the last one serves further
    passes) and starts with nothing seen."""
    left, total = starts.withColumn("previous_reason", F.lit(None).cast("string")), None
    for cycle in range(1, retry.max_passes + 1):
        done = crawl(left.select("start_id", "url"), pages_by_pass[min(cycle, len(pages_by_pass)) - 1], links, **settings)
        rows = cut(done.summary.join(left.select("start_id", "previous_reason"), "start_id").withColumn("cycle", F.lit(cycle)))
        total = rows if total is None else total.unionByName(rows)
        left = cut(starts.join(residual(rows, retry), "start_id").select("start_id", "url", "previous_reason"))
        if left.isEmpty():
            break
    return total


def crawl_totals(summaries: DataFrame) -> DataFrame:
    """Pages over all passes, and the number of starts."""
    return summaries.agg(F.sum("pages_scraped").alias("total_pages"), F.count_distinct("start_id").alias("total_domains"))

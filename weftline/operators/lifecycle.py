"""Aggregates over crawl results and the lifecycle event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import is_successful

EVENT_TAGS = (
    "CrawlStart", "CrawlComplete", "CrawlError", "DomainStart", "DomainComplete", "DomainRetryScheduled", "PageScraped", "RobotsBlocked", "WorkerInterrupted",
    "DomainStopped", "CrawlStopped", "StartUrlChosen", "StartUrlRedirected",
)
#: One wide log: what a tag doesn't have is null.
EVENT_SCHEMA = (
    "ts timestamp, tag string, domain string, cycle int, start_url string, final_start_url string, url string, depth int, reason string, page_count long, pages_scraped long, "
    "pages_attempted long, pages_failed map<string,long>, duration_ms long, previous_reason string, message string, chain array<string>"
)


def is_ok(tag: Column | str = "tag") -> Column:
    return (F.col(tag) if isinstance(tag, str) else tag) == "ok"


def domain_counts(results: DataFrame, domain: str = "domain") -> DataFrame:
    """``domain, attempted, failed, blocked``. ``results``: domain, outcome."""
    return results.groupBy(domain).agg(
        F.count_if(F.col("outcome").isin("ok", "error")).alias("attempted"), F.count_if(F.col("outcome") == "error").alias("failed"), F.count_if(F.col("outcome") == "robots_blocked").alias("blocked"))


def failures_by_kind(results: DataFrame, domain: str = "domain") -> DataFrame:
    """``domain, error_kind, n``"""
    return results.where("outcome = 'error'").groupBy(domain, "error_kind").agg(F.count("*").alias("n"))


def stats_metrics(responses: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``metric, value`` as counters: requests, by depth, by status, success, error, bytes, exceptions by class.

    ``responses``: depth, status (null if none came), html. Bytes are UTF-16 units of the markup. One pass: a row is exploded into its
    counters, and partial sums leave few rows to shuffle.
    """
    status = F.col("status")
    units = F.length("html") + F.length(F.regexp_replace("html", r"[^\x{10000}-\x{10FFFF}]", ""))
    came = F.col("html").isNotNull()
    one = F.lit(1).cast("long")
    counters = [
        (F.lit("requests_processed"), one), (F.concat(F.lit("requests_depth_"), F.col("depth").cast("string")), one), (F.when(came, "responses_received"), one),
        (F.when(came, F.concat(F.lit("status_"), status.cast("string"))), one), (F.when(came & status.between(200, 299), "responses_success").when(came & (status >= 400), "responses_error"), one),
        (F.when(came, "bytes_downloaded"), units.cast("long")),
    ]
    pairs = F.array(*[F.struct(name.alias("metric"), value.alias("value")) for name, value in counters])
    rows = responses.select(F.explode(pairs).alias("m")).select("m.metric", "m.value").where("metric IS NOT NULL")
    if exceptions is not None:
        e = exceptions.select(F.explode(F.array(F.lit("exceptions"), F.concat(F.lit("exception_"), F.col("error_class")))).alias("metric"), one.alias("value"))
        rows = rows.unionByName(e)
    return rows.groupBy("metric").agg(F.sum("value").alias("value"))


def response_flags(responses: DataFrame) -> DataFrame:
    return responses.withColumn("success", is_successful("status"))


def pages_per_domain(log: DataFrame) -> DataFrame:
    """``domain, pages, events``: distinct pages; the page that reaches the limit is logged twice, so events may be one more."""
    return log.where("tag = 'PageScraped'").groupBy("domain").agg(F.count_distinct("url").alias("pages"), F.count("*").alias("events"))


def blocked_by_reason(log: DataFrame) -> DataFrame:
    return log.where("tag = 'RobotsBlocked'").groupBy("domain", "reason").agg(F.count("*").alias("n"))


def retries_per_domain(log: DataFrame) -> DataFrame:
    return log.where("tag = 'DomainRetryScheduled'").groupBy("domain").agg(F.count("*").alias("retries"), F.max_by("previous_reason", "ts").alias("last_reason"))


def completion_distribution(log: DataFrame) -> DataFrame:
    """One completion per domain and cycle counts, the first."""
    first = F.row_number().over(Window.partitionBy("domain", "cycle").orderBy("ts"))
    return log.where("tag = 'DomainComplete'").withColumn("__n", first).where("__n = 1").groupBy("reason").agg(F.count("*").alias("n"))


def durations(log: DataFrame) -> DataFrame:
    """``domain, cycle, duration_ms``: from start to completion."""
    t = lambda tag, f: f(F.when(F.col("tag") == tag, F.col("ts")))
    by = log.groupBy("domain", "cycle").agg(t("DomainStart", F.min).alias("a"), t("DomainComplete", F.min).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return by.select("domain", "cycle", F.floor((F.unix_micros("b") - F.unix_micros("a")) / 1000).cast("long").alias("duration_ms"))


def pool_stats(contexts: DataFrame) -> DataFrame:
    """``browsers, contexts, pages`` of a pool; ``contexts``: browser, context, pages."""
    return contexts.agg(F.count_distinct("browser").alias("browsers"), F.count("context").alias("contexts"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))


def least_loaded(contexts: DataFrame) -> DataFrame:
    """The browser with fewest contexts, the first of equals."""
    load = contexts.groupBy("browser").agg(F.count("context").alias("n"))
    return load.agg(F.min_by("browser", F.struct("n", "browser")).alias("browser"))


def scenario_summary(results: DataFrame) -> DataFrame:
    """Counts by status, total and mean durations, distinct scenarios and the passed share in percent."""
    s = lambda x: F.count_if(F.col("status") == x)
    return results.agg(
        F.count("*").alias("total"), s("passed").alias("passed"), s("failed").alias("failed"), s("skipped").alias("skipped"), F.sum("duration_ms").alias("duration_ms"),
        F.avg("request_ms").alias("mean_request_ms"), F.count_distinct("scenario").alias("scenarios"), (s("passed") * 100.0 / F.count("*")).alias("coverage"))

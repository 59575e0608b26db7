"""Robots rules: fetch outcomes, the fold of lines into groups, longest-match verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U

MAX_BYTES = 512 * 1024
MAX_DELAY_MS = 2000


def fetch_outcome(status: Column | str = "status", body: Column | str = "body", error: Column | str = "cause") -> Column:
    """struct(state, cause): published, absent (404, 410) or unavailable."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    s, b, e = c(status), c(body), c(error)
    ok = s.between(200, 299)
    return (
        F.when(e.isNotNull(), F.struct(F.lit("unavailable").alias("state"), e.alias("cause")))
        .when(s.isin(404, 410), F.struct(F.lit("absent").alias("state"), F.lit(None).cast("string").alias("cause")))
        .when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit("unavailable").alias("state"), F.concat(F.lit("status "), F.coalesce(s.cast("string"), F.lit("unknown"))).alias("cause")))
        .when(F.octet_length(F.coalesce(b, F.lit(""))) > MAX_BYTES, F.struct(F.lit("unavailable").alias("state"), F.lit("body too large").alias("cause")))
        .otherwise(F.struct(F.lit("published").alias("state"), F.lit(None).cast("string").alias("cause")))
    )


def pattern_regex(pattern: Column | str) -> Column:
    """A rule's path as an anchored pattern: * is anything, a final $ anchors the end."""
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    body = F.regexp_replace(p, r"\$$", "")
    escaped = F.replace(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), escaped, F.when(p.endswith("$"), F.lit("$")).otherwise(""))


def _directives(robots: DataFrame, agent: str) -> DataFrame:
    """``origin, pos, directive, value`` of the lines in groups that hold for ``agent``."""
    lines = robots.select("origin", F.posexplode(F.split("body", "\n")).alias("pos", "raw"))
    text = F.trim(F.regexp_replace(F.split("raw", "#")[0], r"\s+", " "))
    split = lines.withColumn("line", text).where(F.col("line").contains(":")).select(
        "origin", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("directive"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))
    order = Window.partitionBy("origin").orderBy("pos")
    is_agent = F.col("directive") == "user-agent"
    # a group starts at an agent line that follows any other directive
    starts = is_agent & (F.coalesce(F.lag("directive").over(order), F.lit("")) != "user-agent")
    grouped = split.withColumn("__starts", starts.cast("int")).withColumn("grp", F.sum("__starts").over(order))
    wanted = is_agent & F.lower("value").isin("*", agent.lower())
    held = grouped.withColumn("__in", F.max(wanted.cast("int")).over(Window.partitionBy("origin", "grp").orderBy("pos")))
    return held.where((F.col("grp") > 0) & (F.col("__in") == 1) & ~is_agent).select("origin", "pos", "directive", "value")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """``origin, pos, kind, path, regex, len``; ``robots``: origin, body."""
    d = _directives(robots, agent).where("directive IN ('allow', 'disallow') AND value <> ''")
    return d.select("origin", "pos", F.col("directive").alias("kind"), F.col("value").alias("path"), pattern_regex("value").alias("regex"), F.length("value").alias("len"))


def crawl_delays(robots: DataFrame, agent: str = "*") -> DataFrame:
    """``origin, crawl_delay``: the last finite delay of 0 or more; an empty value counts as 0."""
    d = _directives(robots, agent).where("directive = 'crawl-delay'")
    delay = F.when(F.col("value") == "", F.lit(0.0)).otherwise(F.expr("try_cast(value AS double)"))
    ok = d.withColumn("d", delay).where("d >= 0 AND NOT isnan(d) AND d < double('Infinity')")
    return ok.groupBy("origin").agg(F.max_by("d", "pos").alias("crawl_delay"))


def effective_delay_ms(crawl_delay: Column | str, cap_ms: int = MAX_DELAY_MS) -> Column:
    c = F.col(crawl_delay) if isinstance(crawl_delay, str) else crawl_delay
    return F.least(c * 1000, F.lit(float(cap_ms)))


@dataclass(frozen=True)
class Prepared:
    """Robots files read once, for verdicts on many tables of URLs."""

    rules: DataFrame
    facts: DataFrame


def prepare(robots: DataFrame, agent: str = "*") -> Prepared:
    """``robots``: origin, status, body, cause."""
    outcome = robots.select("origin", fetch_outcome().alias("o"), "body")
    published = outcome.where("o.state = 'published'")
    rules = robots_rules(published, agent)
    counts = rules.groupBy("origin").agg(F.count("*").alias("n_rules"))
    facts = outcome.select("origin", F.col("o.state").alias("state"), F.col("o.cause").alias("cause")).join(counts, "origin", "left").join(crawl_delays(published, agent), "origin", "left")
    return Prepared(rules, facts)


def robots_verdict(urls: DataFrame, robots: DataFrame | Prepared, url: str = "url", agent: str = "*") -> DataFrame:
    """``urls`` with allowed, reason, disallow_rule, crawl_delay and unavailable_cause.

    URLs meet the rules of their own origin only, and each distinct (origin, path) is matched once, so the theta join is within an
    equi-join. An origin without a row has published no rules.
    """
    ready = robots if isinstance(robots, Prepared) else prepare(robots, agent)
    target = urls.select("*", U.get_origin(url).alias("__origin"), F.concat(U.path(url), U.search(url)).alias("__path"))
    probes = target.select(F.col("__origin").alias("origin"), F.col("__path").alias("target")).where("origin IS NOT NULL").distinct()
    hit = probes.join(ready.rules, "origin").where(F.regexp_like("target", "regex"))
    best = hit.groupBy("origin", "target").agg(F.max_by(F.struct("kind", "path"), F.struct("len", (F.col("kind") == "allow").cast("int"))).alias("rule"))
    j = target.join(ready.facts.withColumnRenamed("origin", "__o1"), F.col("__origin") == F.col("__o1"), "left")
    j = j.join(best.withColumnsRenamed({"origin": "__o2", "target": "__t2"}), (F.col("__origin") == F.col("__o2")) & (F.col("__path") == F.col("__t2")), "left")
    kind = F.col("rule.kind")
    reason = (
        F.when(F.col("__origin").isNull(), "no-rules-published").when(F.col("state") == "unavailable", "robots-unavailable").when(F.col("state").isNull() | (F.col("state") == "absent"), "no-rules-published")
        .when(kind == "disallow", "disallowed-by-rule").when(kind == "allow", "allowed-by-rule").when(F.coalesce("n_rules", F.lit(0)) == 0, "no-rules-published").otherwise("allowed-by-rule")
    )
    done = j.withColumn("reason", reason)
    return done.select(
        *urls.columns, (~F.col("reason").isin("robots-unavailable", "disallowed-by-rule")).alias("allowed"), "reason",
        F.when(kind == "disallow", F.col("rule.path")).alias("disallow_rule"), "crawl_delay", F.col("cause").alias("unavailable_cause"))

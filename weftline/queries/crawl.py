"""Robots, traversal, retries, lifecycle and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import url as U
from ..operators import crawl as W
from ..operators import lifecycle as Y
from ..operators import robots as R
from ..operators import state as S
from ..operators.follow import FollowPolicy
from .base import literal, literal_sql, parts_sql, table, wide

# ---- robots

_BODY = "'User-agent: other~Disallow: /~User-agent: *~# note~Disallow: /private~Allow: /private/open~Disallow:~Disallow: /*.pdf$~Disallow: /*?sort=~Crawl-delay: 5~Sitemap: https://a.example/s.xml~User-agent: bot~User-agent: *~Allow: /same~Disallow: /same~Crawl-delay: 1.5'"
_ROBOTS = f"""('https://a.example', 200, {_BODY}, NULL), ('https://b.example', 404, NULL, NULL), ('https://c.example', 503, NULL, NULL), ('https://d.example', 200, 'User-agent: *~Disallow:', NULL), ('https://e.example', NULL, NULL, 'connection reset'), ('https://f.example', 410, 'User-agent: *~Disallow: /', NULL),
 ('https://g.example', 200, 'user-agent: *~disallow: /x#y~nonsense~Crawl-delay: abc~Crawl-delay: ', NULL)"""
_RCOLS = "origin, status, body, cause"
_PROBES = """(1, 'https://a.example/private/x'), (2, 'https://a.example/private/open/y'), (3, 'https://a.example/doc.pdf'), (4, 'https://a.example/doc.pdf?x=1'), (5, 'https://a.example/list?a=1&sort=up'), (6, 'https://a.example/l?sort=up'), (7, 'https://a.example/same'), (8, 'https://a.example/'), (9, 'https://b.example/any'),
 (10, 'https://c.example/any'), (11, 'https://d.example/any'), (12, 'https://e.example/'), (13, 'https://f.example/'), (14, 'https://unknown.example/'), (15, 'not a url'), (16, 'https://g.example/x'), (17, 'https://g.example/y')"""


def _robots(spark: SparkSession) -> DataFrame:
    return literal(spark, _ROBOTS, _RCOLS).withColumn("body", F.regexp_replace("body", "~", "\n"))


def robots_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robots(spark).select("origin", R.fetch_outcome().alias("o")).select("origin", "o.state", "o.cause")


def robots_rules_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.robots_rules(_robots(spark).where("status = 200")).select("origin", "pos", "kind", "path", "len")


def robots_crawl_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.crawl_delays(_robots(spark).where("status = 200"))
    return d.select("origin", "crawl_delay", R.effective_delay_ms("crawl_delay").alias("delay_ms"))


def robots_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.robots_verdict(literal(spark, _PROBES, "id, url"), _robots(spark)).select("id", "allowed", "reason", "disallow_rule", "unavailable_cause")


def robots_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two rules on every host of the pages; counts of verdicts."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    robots = p.select(U.get_origin("url").alias("origin")).distinct().withColumns({"status": F.lit(200), "body": F.lit("User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*page="), "cause": F.lit(None).cast("string")})
    return R.robots_verdict(p, robots).groupBy("reason", "disallow_rule").agg(F.count("*").alias("n"))


# ---- traversal over a synthetic site: pages of a host are linked page_id -> next two of the host, and every third back to the first


def _site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window

    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://"), U.get_domain("url"), F.lit("/p/"), F.col("page_id").cast("string")).alias("url"), U.get_domain("url").alias("host"))
    w = Window.partitionBy("host").orderBy("page_id")
    near = p.select("url", F.lead("url", 1).over(w).alias("n0"), F.lead("url", 2).over(w).alias("n1"), F.first("url").over(w).alias("n2"))
    nexts = near.select("url", F.posexplode(F.array("n0", "n1", "n2")).alias("pos", "abs_url")).where("abs_url IS NOT NULL")
    starts = p.groupBy("host").agg(F.min("page_id").alias("start_id"), F.min_by("url", "page_id").alias("url")).select("start_id", "url")
    return starts, p.select("url"), nexts


def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts, pages, links = _site(spark, sf_dir)
    return W.crawl(starts, pages, links, FollowPolicy(), max_depth=3).visits.select("start_id", "url", "depth", "outcome")


def bfs_max_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts, pages, links = _site(spark, sf_dir)
    return W.crawl(starts, pages, links, FollowPolicy(), max_pages=4).summary.select("start_id", "pages_scraped", "reason")


_SITE = "('https://t.example/'), ('https://t.example/a'), ('https://t.example/b'), ('https://t.example/private')"
_SLINKS = """('https://t.example/', 0, 'https://t.example/a'), ('https://t.example/', 1, 'https://t.example/private'), ('https://t.example/', 2, 'https://t.example/gone'), ('https://t.example/', 3, 'https://u.example/'), ('https://t.example/a', 0, 'https://t.example/'),
 ('https://t.example/a', 1, 'https://t.example/b'), ('https://t.example/a', 2, 'https://t.example/b#x'), ('https://t.example/b', 0, 'https://t.example/pic.png'), ('https://t.example/b', 1, 'https://T.example/a/')"""


def crawl_tiny_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    robots = spark.createDataFrame([("https://t.example", 200, "User-agent: *\nDisallow: /private", None)], "origin string, status int, body string, cause string")
    done = W.crawl(literal(spark, "(1, 'https://t.example/')", "start_id, url"), literal(spark, _SITE, "url"), literal(spark, _SLINKS, "url, pos, abs_url"), FollowPolicy(), robots)
    return done.visits.select("seq", "url", "depth", "outcome", F.regexp_extract(F.coalesce("reason", F.lit("")), r"^(\S*)", 1).alias("reason"))


def domain_retry_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = literal(spark, "(1, 'https://t.example/'), (2, 'https://v.example/'), (3, 'https://w.example/')", "start_id, url")
    down = literal(spark, "('https://t.example/', NULL), ('https://v.example/', 'http_5xx'), ('https://w.example/', 'timeout')", "url, error_kind")
    up = literal(spark, "('https://t.example/', NULL), ('https://v.example/', NULL), ('https://w.example/', 'timeout')", "url, error_kind")
    links = literal(spark, _SLINKS, "url, pos, abs_url").where("false")
    return W.crawl_passes(starts, [down, up], links, W.DomainRetry(max_passes=3)).select("start_id", "cycle", "attempted", "failed", "reason", "previous_reason")


_RESULTS = """(1, 'ok'), (1, 'error'), (2, 'robots_blocked'), (2, 'filtered'), (3, 'error'), (3, 'error'), (4, 'ok'), (5, 'filtered'), (6, 'ok')"""


def domain_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = literal(spark, _RESULTS, "start_id, outcome").withColumn("depth", F.lit(0))
    starts = literal(spark, "(1), (2), (3), (4), (5), (6), (7)", "start_id")
    return W.domain_completion(v, starts, interrupted=literal(spark, "(4)", "start_id")).drop("max_depth")


# ---- errors, retries


_ERRORS = """(1, 'timeout', NULL, NULL), (2, 'network', 503, NULL), (3, 'network', 429, NULL), (4, 'network', 404, NULL), (5, 'network', NULL, '[adapter-kind:dns: x] ECONNREFUSED'), (6, 'network', NULL, 'getaddrinfo ENOTFOUND h'), (7, 'network', NULL, 'connect ECONNREFUSED'), (8, 'response', NULL, 'ECONNREFUSED'),
 (9, 'response', NULL, 'reset'), (10, 'abort', 200, NULL), (11, 'parse', NULL, 'ENOTFOUND'), (12, 'network', 302, 'x'), (13, 'network', NULL, '[adapter-kind:connection_refused: y] getaddrinfo')"""


def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = literal(spark, _ERRORS, "id, error_class, status, cause").withColumn("kind", C.error_kind("error_class", "status", "cause"))
    return e.select("id", "kind", C.default_status("kind", "status").alias("status"))


def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = literal(spark, ", ".join(f"('{k}')" for k in C.ERROR_KINDS), "kind")
    return kinds.select("kind", F.posexplode(C.retry_plan("kind", C.RetryPolicy(max_attempts=4, base_ms=500))).alias("attempt", "wait_ms"))


# ---- lifecycle over events standing for a log


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a lifecycle log: user_id is the domain, event types are tags."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("domain"), "event_id", "event_type", "value")
    tag = F.element_at(F.array(*[F.lit(t) for t in ("PageScraped", "RobotsBlocked", "DomainRetryScheduled", "DomainStart", "DomainComplete")]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    reason = F.element_at(F.array(*[F.lit(t) for t in ("queue_empty", "max_pages", "error")]), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    return e.select("ts", tag.alias("tag"), "domain", (F.pmod(F.floor(F.col("event_id") / 1000), F.lit(4))).cast("int").alias("cycle"), F.concat(F.lit("u"), F.pmod("event_id", F.lit(40))).alias("url"), reason.alias("reason"), reason.alias("previous_reason"), "event_id")


_LOG = """(SELECT ts, user_id::VARCHAR AS domain, event_id, (['PageScraped', 'RobotsBlocked', 'DomainRetryScheduled', 'DomainStart', 'DomainComplete'])[event_id % 5 + 1] AS tag, (event_id // 1000) % 4 AS cycle, 'u' || (event_id % 40) AS url, (['queue_empty', 'max_pages', 'error'])[event_id % 3 + 1] AS reason FROM events)"""


def log_pages_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.pages_per_domain(_log(spark, sf_dir))


def log_blocked_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.blocked_by_reason(_log(spark, sf_dir))


def log_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.retries_per_domain(_log(spark, sf_dir))


def log_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.completion_distribution(_log(spark, sf_dir))


def log_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.durations(_log(spark, sf_dir))


def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("domain"), F.element_at(F.array(*[F.lit(t) for t in ("ok", "ok", "error", "robots_blocked", "filtered")]), (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("outcome"))
    return Y.domain_counts(e)


def failures_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("domain"), F.lit("error").alias("outcome"), F.col("event_type").alias("error_kind"))
    return Y.failures_by_kind(e)


def stats_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = wide(spark, sf_dir, "pages", "page_id", "html").select(F.pmod("page_id", F.lit(3)).alias("depth"), F.when(F.col("page_id") % 7 != 6, 200 + 100 * F.pmod("page_id", F.lit(4))).cast("int").alias("status"), "html")
    x = literal(spark, "('TimeoutError'), ('TimeoutError'), ('ParseError')", "error_class")
    return Y.stats_metrics(r, x)


_SCEN = "('login', 'passed', 100, 10.0), ('login', 'failed', 50, 20.0), ('paging', 'passed', 150, 30.0), ('csrf', 'skipped', 0, NULL)"


def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.scenario_summary(literal(spark, _SCEN, "scenario, status, duration_ms, request_ms")).withColumn("mean_request_ms", F.col("mean_request_ms").cast("double")).withColumn("coverage", F.col("coverage").cast("double"))


_POOL = "('b1', 'c1', 2), ('b1', 'c2', 1), ('b2', 'c3', 4), ('b3', NULL, NULL)"


def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = literal(spark, _POOL, "browser, context, pages")
    return Y.pool_stats(c).crossJoin(F.broadcast(Y.least_loaded(c)))


# ---- state


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a delta log: user_id is the session, and its fingerprints recur."""
    op = F.element_at(F.array(*[F.lit(o) for o in ("enqueue", "dequeue", "enqueue", "mark_visited", "dequeue")]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("sequence"), op.alias("op"), F.concat(F.lit("f"), F.pmod(F.floor(F.col("event_id") / 5), F.lit(6))).alias("fingerprint"))


_DELTAS = "(SELECT user_id::VARCHAR AS session_id, event_id AS sequence, (['enqueue', 'dequeue', 'enqueue', 'mark_visited', 'dequeue'])[event_id % 5 + 1] AS op, 'f' || ((event_id // 5) % 6) AS fingerprint FROM events)"


def delta_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session's log leaves: how many requests are pending and taken, and how many fingerprints are visited."""
    pending, visited, totals = S.replay(_deltas(spark, sf_dir))
    p = pending.groupBy("session_id").agg(F.count("*").alias("pending"))
    v = visited.groupBy("session_id").agg(F.count("*").alias("visited"))
    return totals.join(p, "session_id", "left").join(v, "session_id", "left").na.fill(0, ["pending", "visited"])


def snapshot_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restoring from a snapshot in the middle and the rest of the log gives what the whole log gives."""
    d = _deltas(spark, sf_dir)
    middle = S.as_state(*S.replay(d.where("sequence <= 4000"))).withColumn("sequence", F.lit(4000).cast("long"))
    state = S.as_state(*S.replay(d, middle.select("session_id", "sequence", "pending", "visited", "total_processed")))
    return state.select("session_id", F.size("pending").cast("long").alias("pending"), F.size("visited").cast("long").alias("visited"), "total_processed")


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _deltas(spark, sf_dir).select("session_id", "sequence", F.col("fingerprint").alias("state"))
    return S.latest_snapshot(s)


def delta_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _deltas(spark, sf_dir)
    snaps = d.where("sequence % 9 = 0 AND sequence < 5000").select("session_id", "sequence", F.lit(0).alias("total_processed"))
    return S.compact(d, snaps).groupBy("session_id").agg(F.count("*").alias("n"), F.min("sequence").alias("since"))


_QUEUE = """('s', 1, 'https://q.example/a', 0, 1), ('s', 2, 'https://q.example/b', 0, 5), ('s', 3, 'https://q.example/a/', 0, 9), ('s', 4, 'https://q.example/a', 1, 5), ('t', 5, 'https://q.example/a', 0, 0), ('s', 6, 'https://q.example/c', 0, 1)"""


def scheduler_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = literal(spark, _QUEUE, "session_id, seq, url, depth, priority")
    return S.schedule(q, "fifo").select("session_id", "seq", F.col("ord").alias("fifo")).join(S.schedule(q, "priority").select("seq", F.col("ord").alias("restored")), "seq")


_REPLAY = f"""
  d AS {_DELTAS},
  m AS (SELECT *, CASE op WHEN 'enqueue' THEN 1 ELSE -1 END AS step FROM d WHERE op <> 'mark_visited'),
  r AS (SELECT *, sum(step) OVER (PARTITION BY session_id, fingerprint ORDER BY sequence) AS level FROM m),
  f AS (SELECT *, least(0, min(level) OVER (PARTITION BY session_id, fingerprint ORDER BY sequence)) AS low FROM r),
  t AS (SELECT *, op = 'dequeue' AND level >= coalesce(lag(low) OVER (PARTITION BY session_id, fingerprint ORDER BY sequence), 0) AS took FROM f),
  x AS (SELECT session_id, count_if(took) AS total_processed, count_if(op = 'enqueue') - count_if(took) AS pending FROM t GROUP BY 1),
  v AS (SELECT session_id, count(DISTINCT fingerprint) AS visited FROM d WHERE op = 'mark_visited' GROUP BY 1)
  SELECT s.session_id, coalesce(total_processed, 0) AS total_processed, coalesce(pending, 0) AS pending, coalesce(visited, 0) AS visited FROM (SELECT DISTINCT session_id FROM d) s LEFT JOIN x USING (session_id) LEFT JOIN v USING (session_id)"""
_NODES = f"n AS (SELECT page_id, host, 'https://' || host || '/p/' || page_id AS url, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY host) AS start_id, count(*) OVER (PARTITION BY host) AS c FROM {parts_sql('pages', 'page_id, url').replace('SELECT page_id, url, ok', 'SELECT page_id, ok', 1)})"

ORACLE = {
    "robots_fetch": f"""SELECT origin, CASE WHEN cause IS NOT NULL THEN 'unavailable' WHEN status IN (404, 410) THEN 'absent' WHEN status NOT BETWEEN 200 AND 299 THEN 'unavailable' ELSE 'published' END AS state, CASE WHEN cause IS NOT NULL THEN cause WHEN status IN (404, 410) THEN NULL WHEN status NOT BETWEEN 200 AND 299 THEN 'status ' || status END AS cause
        FROM {literal_sql(_ROBOTS, _RCOLS)}""",
    "robots_rules_fold": """SELECT * FROM (VALUES ('https://a.example', 4, 'disallow', '/private', 8), ('https://a.example', 5, 'allow', '/private/open', 13), ('https://a.example', 7, 'disallow', '/*.pdf$', 7), ('https://a.example', 8, 'disallow', '/*?sort=', 8), ('https://a.example', 13, 'allow', '/same', 5),
        ('https://a.example', 14, 'disallow', '/same', 5), ('https://g.example', 1, 'disallow', '/x', 2)) AS t(origin, pos, kind, path, len)""",
    "robots_crawl_delay": "SELECT * FROM (VALUES ('https://a.example', 1.5::DOUBLE, 1500.0::DOUBLE), ('https://g.example', 0.0::DOUBLE, 0.0::DOUBLE)) AS t(origin, crawl_delay, delay_ms)",
    "robots_verdict": """SELECT * FROM (VALUES (1, false, 'disallowed-by-rule', '/private', NULL), (2, true, 'allowed-by-rule', NULL, NULL), (3, false, 'disallowed-by-rule', '/*.pdf$', NULL), (4, true, 'allowed-by-rule', NULL, NULL), (5, true, 'allowed-by-rule', NULL, NULL),
        (6, false, 'disallowed-by-rule', '/*?sort=', NULL), (7, true, 'allowed-by-rule', NULL, NULL), (8, true, 'allowed-by-rule', NULL, NULL), (9, true, 'no-rules-published', NULL, NULL), (10, false, 'robots-unavailable', NULL, 'status 503'), (11, true, 'no-rules-published', NULL, NULL),
        (12, false, 'robots-unavailable', NULL, 'connection reset'), (13, true, 'no-rules-published', NULL, NULL), (14, true, 'no-rules-published', NULL, NULL), (15, true, 'no-rules-published', NULL, NULL), (16, false, 'disallowed-by-rule', '/x', NULL), (17, true, 'allowed-by-rule', NULL, NULL)) AS t(id, allowed, reason, disallow_rule, unavailable_cause)""",
    "robots_longest_match": f"""WITH m AS (SELECT path || search AS t FROM {parts_sql('pages', 'page_id, url')}),
        r AS (SELECT CASE WHEN regexp_matches(t, '^/.*page=') THEN '/*page=' WHEN t LIKE '/en/1%' THEN NULL WHEN t LIKE '/en/%' THEN '/en/' END AS disallow_rule FROM m)
        SELECT CASE WHEN disallow_rule IS NULL THEN 'allowed-by-rule' ELSE 'disallowed-by-rule' END AS reason, disallow_rule, count(*) AS n FROM r GROUP BY ALL""",
    "bfs_depth": f"""WITH RECURSIVE {_NODES}, e AS (SELECT a.host, a.page_id AS f, b.page_id AS t FROM n a JOIN n b ON b.host = a.host AND (b.k IN (a.k + 1, a.k + 2) OR b.k = 1)),
        w AS (SELECT host, page_id AS p, 0 AS depth FROM n WHERE k = 1 UNION SELECT e.host, e.t, w.depth + 1 FROM w JOIN e ON e.host = w.host AND e.f = w.p WHERE w.depth < 3)
        SELECT n.start_id, n.url, min(w.depth) AS depth, 'ok' AS outcome FROM w JOIN n ON n.host = w.host AND n.page_id = w.p GROUP BY n.start_id, n.url""",
    "bfs_max_pages": f"WITH {_NODES} SELECT DISTINCT start_id, least(c, 4) AS pages_scraped, CASE WHEN c >= 4 THEN 'max_pages' ELSE 'queue_empty' END AS reason FROM n",
    "crawl_tiny_site": """SELECT * FROM (VALUES (1::BIGINT, 'https://t.example/', 0, 'ok', ''), (2, 'https://t.example/a', 1, 'ok', ''), (3, 'https://t.example/private', 1, 'robots_blocked', 'disallowed-by-rule'), (4, 'https://t.example/gone', 1, 'error', ''), (5, 'https://u.example/', 1, 'filtered', 'Domain/protocol'),
        (6, 'https://t.example/b', 2, 'ok', ''), (7, 'https://t.example/pic.png', 3, 'filtered', 'Filtered')) AS t(seq, url, depth, outcome, reason)""",
    "domain_retry_passes": """SELECT * FROM (VALUES (1, 1, 1, 0, 'queue_empty', NULL), (2, 1, 1, 1, 'all_fetches_failed', NULL), (3, 1, 1, 1, 'all_fetches_failed', NULL), (2, 2, 1, 0, 'queue_empty', 'all_fetches_failed'), (3, 2, 1, 1, 'all_fetches_failed', 'all_fetches_failed'), (3, 3, 1, 1, 'all_fetches_failed', 'all_fetches_failed'))
        AS t(start_id, cycle, attempted, failed, reason, previous_reason)""",
    "domain_completion": f"""WITH r AS {literal_sql(_RESULTS, "start_id, outcome")}, a AS (SELECT s.start_id, count(r.start_id) AS pages_scraped, coalesce(count_if(outcome IN ('ok', 'error')), 0) AS attempted, coalesce(count_if(outcome = 'error'), 0) AS failed, coalesce(count_if(outcome = 'robots_blocked'), 0) AS blocked
        FROM (SELECT unnest(range(1, 8))::INT AS start_id) s LEFT JOIN r ON r.start_id = s.start_id GROUP BY 1)
        SELECT *, CASE WHEN start_id = 4 THEN 'interrupted' WHEN attempted = 0 AND blocked > 0 THEN 'robots_blocked' WHEN attempted > 0 AND failed = attempted THEN 'all_fetches_failed' ELSE 'queue_empty' END AS reason FROM a""",
    "error_classify": """SELECT * FROM (VALUES (1, 'timeout', NULL), (2, 'http_5xx', 503), (3, 'http_429', 429), (4, 'http_4xx', 404), (5, 'dns', NULL), (6, 'dns', NULL), (7, 'connection_refused', NULL), (8, 'connection_refused', NULL), (9, 'other', NULL), (10, 'timeout', 200), (11, 'other', NULL), (12, 'other', 302),
        (13, 'connection_refused', NULL)) AS t(id, kind, status)""",
    "retry_plan": "SELECT kind, a AS attempt, 500 * 2 ** a AS wait_ms FROM (VALUES ('timeout'), ('http_429'), ('http_5xx')) AS k(kind), (VALUES (0), (1), (2)) AS t(a)",
    "log_pages_per_domain": f"SELECT domain, count(DISTINCT url) AS pages, count(*) AS events FROM {_LOG} WHERE tag = 'PageScraped' GROUP BY 1",
    "log_blocked_by_reason": f"SELECT domain, reason, count(*) AS n FROM {_LOG} WHERE tag = 'RobotsBlocked' GROUP BY ALL",
    "log_retries": f"SELECT domain, count(*) AS retries, arg_max(reason, ts) AS last_reason FROM {_LOG} WHERE tag = 'DomainRetryScheduled' GROUP BY 1",
    "log_completions": f"SELECT reason, count(*) AS n FROM (SELECT domain, cycle, arg_min(reason, ts) AS reason FROM {_LOG} WHERE tag = 'DomainComplete' GROUP BY 1, 2) GROUP BY 1",
    "log_durations": f"""SELECT domain, cycle::INT AS cycle, floor((epoch_us(b) - epoch_us(a)) / 1000)::BIGINT AS duration_ms FROM (SELECT domain, cycle, min(ts) FILTER (tag = 'DomainStart') AS a, min(ts) FILTER (tag = 'DomainComplete') AS b FROM {_LOG} GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL""",
    "domain_counts": "SELECT user_id AS domain, count_if(event_id % 5 < 3) AS attempted, count_if(event_id % 5 = 2) AS failed, count_if(event_id % 5 = 3) AS blocked FROM events GROUP BY 1",
    "failures_by_kind": "SELECT user_id AS domain, event_type AS error_kind, count(*) AS n FROM events GROUP BY ALL",
    "stats_metrics": """WITH r AS (SELECT page_id % 3 AS depth, CASE WHEN page_id % 7 <> 6 THEN 200 + 100 * (page_id % 4) END AS status, html FROM pages)
        SELECT 'requests_processed' AS metric, count(*) AS value FROM r UNION ALL SELECT 'responses_received', count(*) FROM r UNION ALL SELECT 'requests_depth_' || depth, count(*) FROM r GROUP BY 1 UNION ALL SELECT 'status_' || status, count(*) FROM r WHERE status IS NOT NULL GROUP BY 1
        UNION ALL SELECT 'responses_success', count(*) FROM r WHERE status BETWEEN 200 AND 299 UNION ALL SELECT 'responses_error', count(*) FROM r WHERE status >= 400 UNION ALL SELECT 'bytes_downloaded', sum(length(html))::BIGINT FROM r
        UNION ALL SELECT * FROM (VALUES ('exceptions', 3), ('exception_TimeoutError', 2), ('exception_ParseError', 1))""",
    "scenario_summary": "SELECT 4 AS total, 2 AS passed, 1 AS failed, 1 AS skipped, 300 AS duration_ms, 20.0::DOUBLE AS mean_request_ms, 3 AS scenarios, 50.0::DOUBLE AS coverage",
    "pool_stats": "SELECT 3 AS browsers, 3 AS contexts, 7 AS pages, 'b3' AS browser",
    "delta_replay": f"WITH {_REPLAY}",
    "snapshot_restore": f"WITH {_REPLAY}",
    "latest_snapshot": f"SELECT session_id, max(sequence) AS sequence, arg_max(fingerprint, sequence) AS state FROM {_DELTAS} GROUP BY 1",
    "delta_compaction": f"""WITH d AS {_DELTAS}, s AS (SELECT session_id, max(sequence) AS q FROM d WHERE sequence % 9 = 0 AND sequence < 5000 GROUP BY 1)
        SELECT d.session_id, count(*) AS n, min(sequence) AS since FROM d LEFT JOIN s USING (session_id) WHERE q IS NULL OR sequence >= q GROUP BY 1""",
    "scheduler_order": "SELECT * FROM (VALUES ('s', 1, 1, 3), ('s', 2, 2, 1), ('s', 4, 3, 2), ('s', 6, 4, 4), ('t', 5, 1, 1)) AS t(session_id, seq, fifo, restored)",
}
QUERIES = {f.__name__: f for f in (
    robots_fetch, robots_rules_fold, robots_crawl_delay, robots_verdict, robots_longest_match, bfs_depth, bfs_max_pages, crawl_tiny_site, domain_retry_passes, domain_completion, error_classify, retry_plan,
    log_pages_per_domain, log_blocked_by_reason, log_retries, log_completions, log_durations, domain_counts, failures_by_kind, stats_metrics, scenario_summary, pool_stats, delta_replay, snapshot_restore,
    latest_snapshot, delta_compaction, scheduler_order,
)}

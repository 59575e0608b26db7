"""Smaller operators: fallbacks, header merges, taxonomies, sessions by age, recipes, snapshots' policy, the crawl object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Crawl
from ..functions import text as X
from ..functions import url as U
from ..operators import dedup as D
from ..operators import extract as E
from ..operators import lifecycle as Y
from ..operators import robots as R
from ..operators import state as S
from ..operators.follow import FollowPolicy, follow_reason
from ..plans.config import ERROR_CLASSES, CrawlConfig, error_family
from .base import literal, parts_sql, table

_ENTRIES = "('https://a.example/', 'x'), ('https://a.example/', 'x y'), ('https://b.example/', ''), ('https://c.example/', 'z')"


def start_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal start URLs the entry with most fallbacks is attached to the one that was kept."""
    entries = literal(spark, _ENTRIES, "url, f").select("url", F.filter(F.split("f", " "), lambda x: x != "").alias("fallback_urls"))
    kept = literal(spark, "('https://a.example/'), ('https://b.example/'), ('https://d.example/')", "url")
    return D.attach_fallbacks(kept, entries).select("url", F.array_join("fallback_urls", " ").alias("fallbacks"))


def header_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, then the caller's headers, then the resolved user agent."""
    h = literal(spark, "(1, 'accept', 'text/html'), (2, 'user-agent', 'mine')", "id, k, v").select("id", X.map_merge(F.create_map(F.lit("accept"), F.lit("*/*")), F.create_map("k", "v"), F.create_map(F.lit("user-agent"), F.lit("resolved"))).alias("h"))
    return h.select("id", F.explode("h").alias("key", "value"))


_CLASSES = ", ".join(f"('{n}')" for names in ERROR_CLASSES.values() for n in (*names, "Odd"))


def error_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, _CLASSES, "error_class").groupBy(error_family("error_class").alias("family")).agg(F.count("*").alias("n"))


def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id")
    return S.list_sessions(e.where("event_id % 7 = 0"), e.where("event_id % 7 <> 0")).select("session_id", F.col("updated").cast("string").alias("updated"))


_BODIES = """(1, '{"data": {"user": "x"}, "errors": []}'), (2, '{"user": "y"}'), (3, 'no json')"""


def graphql_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, _BODIES, "id, body").select("id", F.try_variant_get(E.graphql_data("body"), "$.user", "string").alias("user"))


_REVIEWS = """(1, '<div class="review"><p>Good</p><span data-date="2024-01-02"></span></div><div class="review"><p>Bad</p></div><div class="testimonial"><p class="text">Nice</p><svg></svg><svg></svg></div>'), (2, '<p>none</p>')"""


def review_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = literal(spark, _REVIEWS, "page_id, html").select("page_id", F.from_json(E.extract_json("html", E.REVIEWS | E.TESTIMONIALS), "reviews array<struct<text:string,date:string>>, testimonials array<struct<text:string>>, stars array<string>").alias("x"))
    return x.select("page_id", F.array_join("x.reviews.text", ",").alias("texts"), F.array_join("x.reviews.date", ",").alias("dates"), F.array_join("x.testimonials.text", ",").alias("testimonials"), F.size("x.stars").alias("stars"))


def result_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ok and error results by status, which counts as success where it is absent."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 != 0, 200 + 100 * (F.col("event_id") % 4)).cast("int").alias("status"), F.when(F.col("event_id") % 3 == 0, "error").otherwise("ok").alias("tag"))
    return Y.response_flags(e).groupBy(Y.is_ok().alias("ok"), "success").agg(F.count("*").alias("n"))


def custom_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' own URLs under allow and block lists and patterns."""
    p = FollowPolicy(blocked_domains=("example.org",), custom_filters=(r"/(de|fr)/", "utm_source="), max_length=45)
    r = follow_reason("url", policy=p)
    return table(spark, sf_dir, "pages").groupBy(F.regexp_replace(F.coalesce(r, F.lit("follow")), r"(Domain|length) \S+", "$1").alias("reason")).agg(F.count("*").alias("n"))


def robots_rules_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and rules made from the pages: a host's robots text has a rule per page of it."""
    p = table(spark, sf_dir, "pages").select("page_id", U.get_origin("url").alias("origin"), U.path("url").alias("path"))
    body = F.concat(F.lit("User-agent: *\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "path"))), lambda s: F.concat(F.when(s["page_id"] % 2 == 0, "Disallow: ").otherwise("Allow: "), s["path"])), "\n"))
    return R.robots_rules(p.groupBy("origin").agg(body.alias("body"))).groupBy("origin", "kind").agg(F.count("*").alias("n"), F.max("len").alias("longest"))


def crawl_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a site of their own: every page is a start, one is kept per host, and links lead to nothing that is stored."""
    p = table(spark, sf_dir, "pages")
    c = Crawl(p).with_starts(p.select(F.col("page_id").alias("start_id"), "url")).configured(CrawlConfig(max_depth=1))
    return c.run().summary.select("start_id", "attempted", "failed", "reason")


_P = parts_sql("pages", "page_id, url")
_HOST = "regexp_replace(host, '^www\\.', '')"
ORACLE = {
    "start_fallbacks": "SELECT * FROM (VALUES ('https://a.example/', 'x y'), ('https://b.example/', ''), ('https://d.example/', NULL)) AS t(url, fallbacks)",
    "header_merge": "SELECT * FROM (VALUES (1, 'accept', 'text/html'), (1, 'user-agent', 'resolved'), (2, 'accept', '*/*'), (2, 'user-agent', 'resolved')) AS t(id, key, value)",
    "error_families": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {len(n)})" for f, n in ERROR_CLASSES.items()) + f", (NULL, {len(ERROR_CLASSES)})) AS t(family, n)",
    "session_list": "SELECT user_id AS session_id, regexp_replace(max(ts)::VARCHAR, '\\.?0*$', '') AS updated FROM events GROUP BY 1",
    "graphql_data": "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(id, user)",
    "review_recipes": "SELECT * FROM (VALUES (1, 'Good,Bad', '2024-01-02', 'Nice', 2), (2, NULL, NULL, NULL, NULL)) AS t(page_id, texts, dates, testimonials, stars)",
    "result_split": "SELECT event_id % 3 <> 0 AS ok, event_id % 10 = 0 OR event_id % 4 = 0 AS success, count(*) AS n FROM events GROUP BY 1, 2",
    "custom_filters": f"""SELECT CASE WHEN length(url) > 45 THEN 'URL length exceeds maximum 45' WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 'Domain is blocked' WHEN regexp_matches(url, '/(de|fr)/') THEN 'URL matches custom filter pattern: //(de|fr)//'
        WHEN url LIKE '%utm_source=%' THEN 'URL matches custom filter pattern: /utm_source=/' ELSE 'follow' END AS reason, count(*) AS n FROM {_P} GROUP BY 1""",
    "robots_rules_per_host": f"SELECT scheme || '://' || host AS origin, CASE WHEN page_id % 2 = 0 THEN 'disallow' ELSE 'allow' END AS kind, count(*) AS n, max(length(path))::INT AS longest FROM {_P} GROUP BY 1, 2",
    "crawl_object": f"""WITH p AS (SELECT page_id, host, {_HOST} AS d FROM {_P}), s AS (SELECT min(page_id) AS start_id FROM p GROUP BY d),
        n AS (SELECT start_id, len(list_distinct(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: regexp_replace(x, '/$', '')))) AS links FROM s JOIN pages ON page_id = start_id)
        SELECT start_id, links + 1 AS attempted, links AS failed, 'queue_empty' AS reason FROM n""",
}
QUERIES = {f.__name__: f for f in (start_fallbacks, header_merge, error_families, session_list, graphql_data, review_recipes, result_split, custom_filters, robots_rules_per_host, crawl_object)}

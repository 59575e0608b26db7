"""URL scalar functions, strategies and keyed dedup over the pages' URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.whatwg import whatwg_parse, whatwg_resolve
from ..operators import dedup as D
from .base import AUTH_PORT, DEDUP_KEY, SORTED_SEARCH, literal, literal_sql, parts_sql, table

_P = parts_sql("pages", "page_id, url")

ODD = """(1, 'https://Example.com:443/a//b/?z=1&a=2&z=0#top'), (2, 'http://user:pw@www.example.com:8080'), (3, 'http://www.www.Example.COM./x.tar.gz?'), (4, 'not-a-url'), (5, 'https://example.com/a/b/?'),
 (6, 'http://example.com:80/file.PDF#'), (7, 'ftp://files.example.org/pub/'), (8, 'https://example.com/a/b'), (9, 'http://[invalid'), (10, 'mailto:someone@example.com'), (11, 'https://www.example.com/?b=1&b=2&a=3'), (12, '//example.com/x')"""


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", U.scheme("url").alias("scheme"), U.get_domain("url").alias("host"), U.port("url").alias("port"), U.path("url").alias("path"), U.search("url").alias("search"), U.fragment("url").alias("hash"), U.get_origin("url").alias("origin"), U.is_secure("url").alias("secure"))


def url_parts_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = literal(spark, ODD, "id, url")
    return p.select("id", U.is_valid("url").alias("valid"), U.is_absolute("url").alias("absolute"), U.get_domain("url").alias("host"), U.get_origin("url").alias("origin"), U.get_extension("url").alias("extension"), U.comparison_domain(U.get_domain("url")).alias("compared"), U.to_https("url").alias("https"))


def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url").unionByName(literal(spark, ODD, "page_id, url").select((-F.col("page_id")).cast("long").alias("page_id"), "url"))
    return p.select("page_id", U.normalise("url").alias("normalised"), U.dedup_key("url").alias("key"))


_STRATEGIES = {"default": U.Strategy(), "www_sorted": U.Strategy(www="prefer-www", protocol="preserve", query="sort"), "bare": U.Strategy(www="prefer-non-www", query="ignore"), "kept": U.Strategy("preserve", "preserve", "preserve", "preserve", "preserve")}


def url_strategy_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", *[U.normalize_url("url", s).alias(n) for n, s in _STRATEGIES.items()], U.dedup_domain("url").alias("domain"))


def url_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.groupBy(U.get_extension("url").alias("extension")).agg(F.count("*").alias("n"))


def url_same_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per origin and how many of them match a path glob of that origin."""
    p = table(spark, sf_dir, "pages").withColumn("origin", U.get_origin("url"))
    return p.groupBy("origin").agg(F.count("*").alias("n"), F.count_if(U.matches_pattern("url", F.concat("origin", F.lit("/*.html")))).alias("html_paths"), F.count_if(U.is_same_origin("url", F.concat("origin", F.lit("/x")))).alias("same"))


def url_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", U.join("url", "sub", "leaf.html").alias("appended"), U.join("url", "/root", "x").alias("replaced"))


def query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(U.query_params("url")).alias("name", "value"))
    return p


def query_params_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where("url LIKE '%?%'")
    return p.select("page_id", U.remove_query_params("url", ["ref", "utm_source"]).alias("removed"), U.set_query_params("url", {"page": 9, "lang": "en"}).alias("edited"))


def url_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _, _ = D.dedup_urls(table(spark, sf_dir, "pages").select("page_id", "url"), order="page_id")
    return kept


def url_dedup_prefer_www(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, skipped, _ = D.dedup_urls(table(spark, sf_dir, "pages").select("page_id", "url"), U.Strategy(www="prefer-www"), order="page_id")
    return skipped


def url_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url").unionByName(literal(spark, ODD, "page_id, url").select((F.col("page_id") + 10_000_000).cast("long").alias("page_id"), "url"))
    return D.dedup_urls(rows, order="page_id")[2]


def seen_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("url"))
    return D.seen_stats(D.first_seen(rows, U.get_origin("url"), "page_id"))


def frontier_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", U.dedup_key("url").alias("key"))
    return D.not_seen(p, p.where("page_id % 3 = 0")).select("page_id", "key")


_STARTS = """(1, 0, 'https://a.example/', false), (1, 1, 'https://www.a.example/', true), (1, 2, 'http://a.example/', true), (2, 0, 'https://b.example/', true), (2, 1, 'http://b.example/', true), (3, 0, 'https://c.example/', false)"""


def start_url_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.choose_start(literal(spark, _STARTS, "start_id, pos, url, reachable"))


_REDIRECTS = """('https://a.example/', 'https://shop.example/home'), ('https://b.example/', 'https://b.example/en')"""


def cross_domain_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = literal(spark, _STARTS, "start_id, pos, url, reachable").where("pos = 0").select("start_id", "url")
    return D.effective_starts(starts, literal(spark, _REDIRECTS, "url, final_url"), True)


def url_whatwg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", whatwg_parse("url").alias("u")).select("page_id", "u.*")


def url_whatwg_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", whatwg_resolve("url", F.lit("../x/./y é?q=1#f")).alias("resolved"))


_DOMAIN = "regexp_replace(host, '^www\\.', '')"
_SLASHLESS = "coalesce(nullif(regexp_replace(path, '/$', ''), ''), '/')"
_WWW = "CASE WHEN host LIKE 'www.%' THEN host ELSE 'www.' || host END"
_PORT = "CASE WHEN port <> '' THEN ':' || port ELSE '' END"
_AT = "CASE WHEN auth <> '' THEN auth || '@' ELSE '' END"
_NORM_PATH = "CASE WHEN path <> '/' THEN regexp_replace(path, '/$', '') ELSE path END"
_ODD_SQL = literal_sql(ODD, "id, url")
_ALL = f"(SELECT page_id, url FROM pages UNION ALL SELECT -id, url FROM {_ODD_SQL})"

ORACLE = {
    "url_parts": f"SELECT page_id, scheme, host, port, path, search, hash, scheme || '://' || host || {_PORT} AS origin, scheme = 'https' AS secure FROM {_P}",
    "url_parts_odd": f"""SELECT o.id, coalesce(p.ok, false) AS valid, regexp_matches(o.url, '^[A-Za-z][A-Za-z0-9+.-]*:') AS absolute, p.host, p.scheme || '://' || p.host || {_PORT} AS origin,
        nullif(regexp_extract(p.path, '(\\.[^./]*)$', 1), '') AS extension, regexp_replace(regexp_replace(p.host, '^(www\\.)+', ''), '\\.$', '') AS compared,
        CASE WHEN p.scheme = 'http' THEN regexp_replace(o.url, '^[hH][tT][tT][pP]:', 'https:') ELSE o.url END AS https
        FROM {_ODD_SQL} o LEFT JOIN {parts_sql(_ODD_SQL, "id, url")} p ON p.id = o.id""",
    "url_normalise": f"""SELECT a.page_id, scheme || '://' || {AUTH_PORT} || {_NORM_PATH} || {SORTED_SEARCH} AS normalised, coalesce({DEDUP_KEY}, a.url) AS key
        FROM {_ALL} a LEFT JOIN {parts_sql(_ALL, "page_id, url")} p ON p.page_id = a.page_id""",
    "url_strategy_normalise": f"""SELECT page_id, 'https://' || {_AT} || {_DOMAIN} || {_PORT} || {_SLASHLESS} || search AS "default",
        scheme || '://' || {_AT} || {_WWW} || {_PORT} || {_SLASHLESS} || {SORTED_SEARCH} AS www_sorted, 'https://' || {_AT} || {_DOMAIN} || {_PORT} || {_SLASHLESS} AS bare,
        scheme || '://' || {_AT} || host || {_PORT} || path || search || hash AS kept, {_DOMAIN} AS domain FROM {_P}""",
    "url_extension": f"SELECT nullif(regexp_extract(path, '(\\.[^./]*)$', 1), '') AS extension, count(*) AS n FROM {_P} GROUP BY 1",
    "url_same_origin": f"SELECT scheme || '://' || host || {_PORT} AS origin, count(*) AS n, count_if(path LIKE '/%.html') AS html_paths, count(*) AS same FROM {_P} GROUP BY 1",
    "url_join": f"""SELECT page_id, scheme || '://' || {AUTH_PORT} || regexp_replace(path, '/$', '') || '/sub/leaf.html' || search || hash AS appended, scheme || '://' || {AUTH_PORT} || '/root/x' || search || hash AS replaced FROM {_P}""",
    "query_params": f"""SELECT page_id, string_split(p, '=')[1] AS name, url_decode(replace(regexp_replace(p, '^[^=]*=', ''), '+', ' ')) AS value
        FROM (SELECT page_id, unnest(list_filter(string_split(substr(search, 2), '&'), lambda p: p <> '')) AS p FROM {_P})""",
    "query_params_edit": f"""SELECT page_id, scheme || '://' || {AUTH_PORT} || path || coalesce('?' || nullif(array_to_string(list_filter(string_split(substr(search, 2), '&'), lambda p: string_split(p, '=')[1] NOT IN ('ref', 'utm_source')), '&'), ''), '') || hash AS removed,
        scheme || '://' || {AUTH_PORT} || path || '?' || CASE WHEN regexp_matches(search, '[?&]page=') THEN regexp_replace(substr(search, 2), 'page=[^&]*', 'page=9') ELSE substr(search, 2) || '&page=9' END || '&lang=en' || hash AS edited
        FROM {_P} WHERE url LIKE '%?%'""",
    "url_dedup_first_wins": f"SELECT arg_min(page_id, page_id) AS page_id, arg_min(url, page_id) AS url, {_DOMAIN} AS key FROM {_P} GROUP BY {_DOMAIN}",
    "url_dedup_prefer_www": f"""WITH k AS (SELECT page_id, url, {_DOMAIN} AS d, url LIKE '%://www.%' AS w FROM {_P}),
        r AS (SELECT *, first_value(w) OVER o AS head_w, first_value(url) OVER o AS head, row_number() OVER o AS n, min(CASE WHEN w THEN page_id END) OVER (PARTITION BY d) AS best FROM k WINDOW o AS (PARTITION BY d ORDER BY page_id)),
        b AS (SELECT r.*, k.url AS best_url FROM r LEFT JOIN k ON k.page_id = r.best)
        SELECT page_id, url, CASE WHEN n = 1 THEN 'Replaced by preferred variant: ' || best_url WHEN head_w OR best IS NULL OR page_id < best THEN 'Duplicate of: ' || head ELSE 'Duplicate of: ' || best_url END AS reason
        FROM b WHERE page_id <> CASE WHEN head_w OR best IS NULL THEN (SELECT min(page_id) FROM k WHERE k.d = b.d) ELSE best END""",
    "url_dedup_stats": f"""WITH a AS (SELECT page_id, url FROM pages UNION ALL SELECT id + 10000000, url FROM {_ODD_SQL}), k AS (SELECT {_DOMAIN} AS d FROM {parts_sql("a", "page_id, url")})
        SELECT (SELECT count(*) FROM a) AS total, (SELECT count(DISTINCT d) FROM k) AS "unique", (SELECT count(*) - count(DISTINCT d) FROM k) AS duplicates, (SELECT count(*) FROM a) - (SELECT count(*) FROM k) AS invalid""",
    "seen_set": f"SELECT count(*) AS processed, count(DISTINCT scheme || host || port) AS \"unique\", count(*) - count(DISTINCT scheme || host || port) AS duplicates FROM {_P}",
    "frontier_anti_join": f"WITH k AS (SELECT page_id, {DEDUP_KEY} AS key FROM {_P}) SELECT page_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE page_id % 3 = 0)",
    "start_url_resolution": f"""WITH s AS {literal_sql(_STARTS, "start_id, pos, url, reachable")}, b AS (SELECT start_id, arg_min(url, pos) FILTER (reachable) AS ok, arg_min(url, pos) AS p FROM s GROUP BY 1)
        SELECT start_id, coalesce(ok, p) AS chosen, coalesce(ok, p) <> p AS fallback_used FROM b""",
    "cross_domain_redirect": f"""SELECT s.start_id, s.url, CASE WHEN regexp_extract(r.final_url, '//([^/]+)', 1) <> regexp_extract(s.url, '//([^/]+)', 1) THEN r.final_url ELSE s.url END AS effective_url
        FROM (SELECT * FROM {literal_sql(_STARTS, "start_id, pos, url, reachable")} WHERE pos = 0) s LEFT JOIN {literal_sql(_REDIRECTS, "url, final_url")} r ON r.url = s.url""",
}
QUERIES = {f.__name__: f for f in (
    url_parts, url_parts_odd, url_normalise, url_strategy_normalise, url_extension, url_same_origin, url_join, query_params, query_params_edit, url_dedup_first_wins, url_dedup_prefer_www, url_dedup_stats,
    seen_set, frontier_anti_join, start_url_resolution, cross_domain_redirect, url_whatwg, url_whatwg_resolve,
)}

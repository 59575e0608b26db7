"""Pages, links, follow decisions and field extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U
from ..operators import extract as E
from ..operators import links as L
from ..operators import pages as P
from ..operators.follow import EXTENSIONS, FollowPolicy, extension_table, follow_reason, skip_extensions
from .base import LINKS_SQL, URL_RX, VISIBLE, literal, literal_sql, parts_sql, unescape_sql, wide


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.extract_links(wide(spark, sf_dir, "pages", "page_id", "url", "html"))


def link_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("attr = 'href'").select("page_id", "tag", "pos", "href")


def link_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.link_breakdown(_links(spark, sf_dir))


def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolve_links(_links(spark, sf_dir)).select("page_id", "tag", "pos", "abs_url")


_HREFS = """(1, 'https://a.example/x/y.html?q=1#f', '/r'), (2, 'https://a.example/x/y.html?q=1#f', 'z'), (3, 'https://a.example/x/y.html?q=1#f', '?n=2'), (4, 'https://a.example/x/y.html?q=1#f', '#g'), (5, 'https://a.example/x/y.html?q=1#f', '//b.example/p'),
 (6, 'https://a.example/x/y.html?q=1#f', 'mailto:me@a.example'), (7, 'https://a.example/x/y.html?q=1#f', 'HTTP://C.example/d'), (8, 'https://a.example/x/y.html?q=1#f', ' '), (9, 'https://a.example/x/y.html?q=1#f', 'http://[bad'), (10, 'https://a.example/x/y.html?q=1#f', 'javascript:void(0)')"""


def link_resolve_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, _HREFS, "id, url, href").select("id", U.resolve_url("url", "href").alias("abs_url"))


_CANDIDATES = """(1, 'https://www.shop.example/list.html'), (2, 'http://shop.example/pic.JPG'), (3, 'https://blog.shop.example/a'), (4, 'https://other.example/'), (5, 'javascript:void(0)'), (6, 'https://shop.example/list.html#top'), (7, 'https://shop.example/list.html'), (8, 'not a url'),
 (9, 'https://shop.example/files/a.tar.gz'), (10, 'https://shop.example/admin/x'), (11, 'https://ads.shop.example/'), (12, 'gopher://shop.example/'), (13, 'https://shop.example/very/long/path/that/goes/on/and/on/for/ever/and/ever'), (14, 'https://shop.example/app.js'), (15, 'mailto:a@shop.example')"""
_FROM, _START = "https://shop.example/list.html", "https://shop.example/"
_TIGHT = FollowPolicy(custom_filters=("/admin/",), blocked_domains=("ads.shop.example",), max_length=70, subdomains="ignore")
_WIDE = FollowPolicy(allowed_domains=("shop.example",), filter_malformed=False, categories=("images",))


def follow_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = literal(spark, _CANDIDATES, "id, url")
    return c.select("id", follow_reason("url", F.lit(_FROM), F.lit(_START), _TIGHT).alias("tight"), follow_reason("url", F.lit(_FROM), None, _WIDE).alias("wide"))


def follow_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages by what happens to them when the crawl keeps to each page's host."""
    links = L.resolve_links(_links(spark, sf_dir)).withColumn("r", follow_reason("abs_url", F.col("url"), F.col("url")))
    return links.groupBy(F.coalesce(F.regexp_extract("r", r"^(\w+)", 1), F.lit("follow")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


def link_follow_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: host and follow class over all links, from markup to counts in one pass and one small shuffle."""
    links = L.resolve_links(_links(spark, sf_dir)).withColumn("r", follow_reason("abs_url", F.col("url"), F.col("url")))
    return links.groupBy(U.get_domain("url").alias("host"), F.when(F.col("r").isNull(), "follow").otherwise("skip").alias("decision")).agg(F.count("*").alias("n"))


def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extension_table(spark).groupBy("category", "label").agg(F.count("*").alias("n"), F.min("extension").alias("least"), F.max("extension").alias("greatest"))


def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir, "pages", "page_id", "html").select("page_id", H.title("html").alias("title"))


_TYPES = "(1, 'text/html; charset=utf-8'), (2, 'application/xhtml+xml'), (3, 'text/plain'), (4, 'application/pdf'), (5, ''), (6, NULL), (7, 'image/png')"


def content_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, _TYPES, "id, content_type").select("id", P.is_parseable_content("content_type").alias("passes"), P.content_error("content_type").alias("error"))


_META = """(1, '<meta name="description" content="one"><meta name="description" content="two"><meta property="og:title" content="T &amp; U"><meta charset="utf-8"><meta name="robots" content="">'), (2, '<!-- <meta name="author" content="no"> --><meta name="author" content="A"><meta http-equiv="refresh" content="5">'),
 (3, '<script>var x = "<meta name=keywords content=k>";</script><title>none</title>')"""


def meta_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = literal(spark, _META, "page_id, html")
    return P.meta_map(p).select("page_id", F.explode("metadata").alias("key", "content"))


def common_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = literal(spark, _META, "page_id, html")
    m = p.select("page_id").join(P.meta_map(p), "page_id", "left").withColumn("c", P.common_metadata("metadata"))
    return m.select("page_id", F.col("c").isNotNull().alias("present"), "c.description", "c.keywords", "c.author", "c.robots")


_ROWS = "(1, 'https://a.example/', '<p>', 200, 1.5, 0), (2, 'nope', '<p>', 200, 1.0, 0), (3, 'https://a.example/', NULL, 99, 1.0, -1), (4, 'mailto:x@y.example', '', 599, 0.0, 3)"


def page_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = literal(spark, _ROWS, "id, url, html, status, duration_ms, depth")
    return p.select("id", F.array_join(P.page_errors(), "; ").alias("errors"))


def parse_pages_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_pages(wide(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "title", F.to_json("metadata").alias("metadata"))


def links_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = wide(spark, sf_dir, "pages", "page_id", "html").select("page_id", L.extract_exact("html", from_inputs=True).alias("x"))
    return x.select("page_id", F.size("x.links").alias("n"), "x.processed", F.array_join("x.links", " ").alias("links"))


def links_by_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = wide(spark, sf_dir, "pages", "page_id", "html").select("page_id", L.extract_exact("html", restrict_css=["nav li > a", "p a[href^='/']"]).alias("x"))
    return x.select("page_id", "x.processed", F.array_join("x.links", " ").alias("links"))


_FORMS = """(1, 'https://a.example/', '<input type="hidden" name="redirectUrl" value=" /next "><input type="hidden" name="q" value="x"><input type="text" name="next" value="y"><input type="hidden" name="NEXT" value=""><!-- <input type="hidden" name="url" value="no"> -->')"""


def hidden_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hidden_inputs(literal(spark, _FORMS, "page_id, url, html")).select("page_id", "pos", "name", "href")


_FIELDS = {"title": "title", "first_link": {"selector": "a", "attribute": "href"}, "has_nav": {"selector": "nav", "exists": True}, "items": {"selector": "nav li", "multiple": True}, "links": {"selector": "nav li", "multiple": True, "fields": {"text": "a", "to": {"selector": "a", "attribute": "href"}}}, "none": "aside.x"}


def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.extract_fields(wide(spark, sf_dir, "pages", "page_id", "html"), _FIELDS)
    get = lambda p, k="string": F.try_variant_get("extracted", p, k)
    return x.select("page_id", get("$.title").alias("title"), get("$.first_link").alias("first_link"), get("$.has_nav", "boolean").alias("has_nav"), F.size(get("$.links", "array<variant>")).alias("n_links"), get("$.none").alias("none"))


_SHOP = """(1, '<div class="product"><h3>Mug</h3><a href="/product/7">see</a><div class="price">$1,204.50</div><img src="m.png"></div><div class="product"><h3>Cup</h3><a href="/other">see</a><div class="price">free</div></div>'), (2, '<h1>Mug</h1><script type="application/ld+json">{"name":"M","offers":{"price":9.5},"aggregateRating":{"ratingValue":4.5,"reviewCount":12}}</script>')"""


def product_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.product_list(literal(spark, _SHOP, "page_id, html"))


def product_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.product_detail(literal(spark, _SHOP, "page_id, html").where("page_id = 2"))


_STATE = """(1, '<input type="hidden" name="a" value="1"><input type="hidden" name="a" value="2"><script>window.__DATA__ = {"n": 5};</script>'), (2, '<p>')"""


def hidden_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hidden_data(literal(spark, _STATE, "page_id, html")).select("page_id", F.try_element_at("inputs", F.lit("a")).alias("a"), F.try_variant_get("state", "$.n", "bigint").alias("n"))


def pagination_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pagination_links(_links(spark, sf_dir), "th").where("attr = 'href'").groupBy("page_id").agg(F.count("*").alias("n"))


def extension_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some paths a skip list catches, by category."""
    return literal(spark, _CANDIDATES, "id, url").select("id", follow_reason("url", policy=FollowPolicy(filter_schemes=False)).alias("reason")).where("reason LIKE '%extension%'")


def _ext_rx(categories=tuple(EXTENSIONS)) -> str:
    return "(" + "|".join(x.replace(".", "\\.") for x in skip_extensions(categories)) + ")$"


def _label(path: str, categories=tuple(EXTENSIONS)) -> str:
    return "concat_ws('/', " + ", ".join(f"CASE WHEN regexp_matches({path}, '{_ext_rx((c,))}') THEN '{EXTENSIONS[c][0]}' END" for c in categories) + ")"


_C = literal_sql(_CANDIDATES, "id, url")
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_Q = f"""(SELECT c.id, c.url, {_SCHEME.replace("url", "c.url")} AS sch, p.ok IS NOT NULL AS ok, p.host, lower(p.path) AS low, p.path, p.search, p.hash FROM {_C} c LEFT JOIN {parts_sql(_C, "id, url")} p ON p.id = c.id)"""
_BADPROTO = "'Protocol ' || sch || ': not in allowed schemes: http:, https:, file:, ftp:'"
_R = f"(SELECT l.page_id, l.url, l.tag, l.pos, p.scheme || '://' || p.host || CASE WHEN p.port <> '' THEN ':' || p.port ELSE '' END || l.href AS abs_url, p.host FROM {LINKS_SQL} l JOIN {parts_sql('pages', 'page_id, url')} p ON p.page_id = l.page_id WHERE l.href LIKE '/%')"
_BAD = f"NOT regexp_matches(abs_url, '{URL_RX}')"
_EXT = f"regexp_matches(lower(regexp_replace(abs_url, '[?#].*$', '')), '{_ext_rx()}')"

ORACLE = {
    "link_explode": f"SELECT page_id, tag, pos, href FROM {LINKS_SQL}",
    "link_breakdown": f"SELECT page_id, tag, count(*) AS n, count(href) AS found FROM {LINKS_SQL} GROUP BY ALL",
    "link_resolve": f"SELECT page_id, tag, pos, abs_url FROM {_R}",
    "link_resolve_forms": f"""SELECT id, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN CASE WHEN regexp_matches(h, '{URL_RX}') THEN h END WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN h LIKE '//%' THEN 'https:' || h
        WHEN h LIKE '/%' THEN 'https://a.example' || h WHEN h LIKE '?%' THEN 'https://a.example/x/y.html' || h WHEN h LIKE '#%' THEN 'https://a.example/x/y.html?q=1' || h WHEN h = '' THEN 'https://a.example/x/y.html?q=1' ELSE 'https://a.example/x/' || h END AS abs_url
        FROM (SELECT id, trim(href) AS h FROM {literal_sql(_HREFS, "id, url, href")})""",
    "follow_decisions": f"""SELECT id,
        CASE WHEN NOT ok AND (sch = '' OR url LIKE '%://%') THEN 'Malformed URL: Invalid URL'
             WHEN NOT (coalesce(regexp_replace(host, '^(www\\.)+', ''), '') IN ('shop.example') OR coalesce(host, '') LIKE '%.shop.example') OR sch NOT IN ('http', 'https', 'file', 'ftp') THEN 'Domain/protocol ' || coalesce(host, '') || ' (' || sch || ':) restricted to starting domain shop.example (https:)'
             WHEN length(url) > 70 THEN 'URL length ' || length(url) || ' exceeds maximum 70' WHEN host = 'ads.shop.example' OR host LIKE '%.ads.shop.example' THEN 'Domain ' || host || ' is blocked' WHEN url LIKE '%/admin/%' THEN 'URL matches custom filter pattern: /' || '/admin/' || '/'
             WHEN host = 'shop.example' AND path = '/list.html' AND search = '' AND hash <> '' THEN 'Fragment-only link to same page' WHEN regexp_matches(low, '{_ext_rx()}') THEN 'Filtered ' || {_label("low")} || ' file extension' END AS tight,
        CASE WHEN NOT ok AND (sch = '' OR url LIKE '%://%') THEN NULL WHEN sch NOT IN ('http', 'https', 'file', 'ftp') THEN {_BADPROTO} WHEN NOT (coalesce(host, '') = 'shop.example' OR coalesce(host, '') LIKE '%.shop.example') THEN 'Domain ' || coalesce(host, '') || ' not in allowlist'
             WHEN host = 'shop.example' AND path = '/list.html' AND search = '' AND hash <> '' THEN 'Fragment-only link to same page' WHEN regexp_matches(low, '{_ext_rx(("images",))}') THEN 'Filtered image file extension' END AS wide
        FROM {_Q}""",
    "follow_reason_counts": f"""SELECT CASE WHEN {_BAD} THEN 'Malformed' WHEN length(abs_url) > 2083 THEN 'URL' WHEN {_EXT} THEN 'Filtered' ELSE 'follow' END AS reason, count(*) AS n, count(DISTINCT page_id) AS pages FROM {_R} GROUP BY 1""",
    "link_follow_by_host": f"""SELECT host, CASE WHEN {_BAD} OR length(abs_url) > 2083 OR {_EXT} THEN 'skip' ELSE 'follow' END AS decision, count(*) AS n FROM {_R} GROUP BY 1, 2""",
    "extension_filter": "SELECT category, label, count(*) AS n, min(extension) AS least, max(extension) AS greatest FROM (VALUES " + ", ".join(f"('{c}', '{label}', '{x}')" for c, (label, xs) in EXTENSIONS.items() for x in xs) + ") AS t(category, label, extension) GROUP BY 1, 2",
    "title_extract": f"SELECT page_id, nullif({unescape_sql('t')}, '') AS title FROM (SELECT page_id, array_to_string(regexp_extract_all({VISIBLE}, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '') AS t FROM pages)",
    "content_gate": f"""SELECT id, coalesce(content_type, '') = '' OR content_type LIKE '%text/%' OR content_type LIKE '%application/xhtml%' AS passes, CASE WHEN content_type <> '' AND content_type NOT LIKE '%text/%' AND content_type NOT LIKE '%application/xhtml%' THEN 'Unsupported content type: ' || content_type END AS error
        FROM {literal_sql(_TYPES, "id, content_type")}""",
    "meta_map": "SELECT * FROM (VALUES (1, 'description', 'two'), (1, 'og:title', 'T & U'), (2, 'author', 'A'), (2, 'refresh', '5')) AS t(page_id, key, content)",
    "common_metadata": "SELECT * FROM (VALUES (1, true, 'two', NULL, NULL, NULL), (2, true, NULL, NULL, 'A', NULL), (3, false, NULL, NULL, NULL, NULL)) AS t(page_id, present, description, keywords, author, robots)",
    "page_validation": f"""SELECT id, concat_ws('; ', CASE WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'url must be an absolute URL' END, CASE WHEN html IS NULL THEN 'html must be a string' END, CASE WHEN status NOT BETWEEN 100 AND 599 THEN 'status must be between 100 and 599' END,
        CASE WHEN depth < 0 THEN 'depth must be 0 or more' END) AS errors FROM {literal_sql(_ROWS, "id, url, html, status, duration_ms, depth")}""",
    "hidden_inputs": "SELECT 1 AS page_id, 0 AS pos, 'redirectUrl' AS name, '/next' AS href",
    "product_recipes": "SELECT * FROM (VALUES (1, 0, '7', 'Mug', '/product/7', 1204.5::DOUBLE, '', 'm.png'), (1, 1, NULL, 'Cup', '/other', 0.0::DOUBLE, '', NULL)) AS t(page_id, pos, product_id, title, url, price, description, image)",
    "product_detail": "SELECT 2 AS page_id, 'Mug' AS name, 9.5::DOUBLE AS price, 4.5::DOUBLE AS rating, 12 AS reviews",
    "hidden_data": "SELECT * FROM (VALUES (1, '2', 5::BIGINT), (2, NULL, NULL)) AS t(page_id, a, n)",
    "pagination_links": f"SELECT page_id, count(*) AS n FROM {LINKS_SQL} WHERE href LIKE '%th%' AND href NOT LIKE '%#%' GROUP BY 1",
    "extension_hits": f"SELECT id, 'Filtered ' || {_label('low')} || ' file extension' AS reason FROM {_Q} WHERE regexp_matches(low, '{_ext_rx()}')",
}
QUERIES = {f.__name__: f for f in (
    link_explode, link_breakdown, link_resolve, link_resolve_forms, follow_decisions, follow_reason_counts, link_follow_by_host, extension_filter, extension_hits, title_extract, content_gate, meta_map, common_metadata,
    page_validation, parse_pages_exact, links_exact, links_by_selector, hidden_inputs, extract_fields, product_recipes, product_detail, hidden_data, pagination_links,
)}

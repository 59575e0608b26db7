"""What the query modules share: tables, literal fixtures and the pieces of SQL that several oracles use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import spread

URL_RX = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@\s]*)@)?([^/?#:@\s]+)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """These columns of a table whose rows take long, over all slots."""
    return spread(table(spark, sf_dir, name).select(*columns))


def literal(spark: SparkSession, values: str, columns: str) -> DataFrame:
    """A fixture from VALUES text that both engines read; ~ stands for a newline in strings."""
    return spark.sql(f"SELECT * FROM (VALUES {values}) AS t({columns})")


def literal_sql(values: str, columns: str) -> str:
    return f"(SELECT * FROM (VALUES {values}) AS t({columns}))"


def parts_sql(source: str, keep: str, url: str = "url") -> str:
    """A subquery with the parts of a URL column: scheme, auth, host, port, path, search, hash, ok."""
    g = lambda k: f"coalesce(regexp_extract({url}, '{URL_RX}', {k}), '')"
    return f"""(
      SELECT {keep}, ok, scheme, auth, host, CASE WHEN scheme || ':' || port IN ('http:80', 'https:443', 'ftp:21', 'ws:80', 'wss:443') THEN '' ELSE port END AS port,
             CASE WHEN path = '' THEN '/' ELSE path END AS path, CASE WHEN search = '?' THEN '' ELSE search END AS search, CASE WHEN hash = '#' THEN '' ELSE hash END AS hash
      FROM (SELECT {keep}, regexp_matches({url}, '{URL_RX}') AS ok, lower({g(1)}) AS scheme, {g(2)} AS auth, lower({g(3)}) AS host, {g(4)} AS port, {g(5)} AS path, {g(6)} AS search, {g(7)} AS hash
            FROM {source})
      WHERE ok)"""


#: The query sorted by key, with equal keys in their order; over columns of ``parts_sql``.
SORTED_SEARCH = """coalesce('?' || nullif(array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(substr(search, 2), '&'), lambda p: p <> ''),
      lambda p, i: {'k': string_split(p, '=')[1], 'i': i, 'p': p})), lambda s: s.p), '&'), ''), '')"""
AUTH_PORT = "CASE WHEN auth <> '' THEN auth || '@' ELSE '' END || host || CASE WHEN port <> '' THEN ':' || port ELSE '' END"
KEY_PATH = "coalesce(nullif(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', ''), ''), '/')"
DEDUP_KEY = f"scheme || '://' || {AUTH_PORT} || {KEY_PATH} || {SORTED_SEARCH}"

#: Links of a page: visible start tags of the configured names, their quoted values, in order.
VISIBLE = r"""regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'g')"""


def unescape_sql(text: str) -> str:
    for name, char in (("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return text


LINKS_SQL = f"""(
  SELECT page_id, url, tag, i AS pos, nullif(trim({unescape_sql("v")}), '') AS href FROM (
    SELECT page_id, url, tag, i, x, regexp_extract(x, '(?is)\\shref\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 1) AS v FROM (
      SELECT page_id, url, tag, unnest(xs) AS x, unnest(range(0, len(xs))) AS i FROM (
        SELECT page_id, url, tag, regexp_extract_all(vis, '(?is)<' || tag || '\\b[^>]*>', 0) AS xs
        FROM (SELECT page_id, url, {VISIBLE} AS vis FROM pages), (VALUES ('a'), ('area'), ('form'), ('frame'), ('iframe'), ('link')) AS t(tag))))
  WHERE regexp_matches(x, '(?is)\\shref\\s*='))"""

#: Columns whose SQL has another integer width, or no type at all, than the query's result.
TYPES = {
    "url_same_origin": {"html_paths": "BIGINT"},
    "link_explode": {"pos": "INTEGER"},
    "link_resolve": {"pos": "INTEGER"},
    "common_metadata": {"keywords": "VARCHAR", "robots": "VARCHAR"},
    "domain_retry_passes": {"attempted": "BIGINT", "failed": "BIGINT"},
    "domain_completion": {"attempted": "BIGINT", "failed": "BIGINT", "blocked": "BIGINT"},
    "retry_plan": {"wait_ms": "BIGINT"},
    "domain_counts": {"attempted": "BIGINT", "failed": "BIGINT", "blocked": "BIGINT"},
    "scenario_summary": {"total": "BIGINT", "passed": "BIGINT", "failed": "BIGINT", "skipped": "BIGINT", "duration_ms": "BIGINT", "scenarios": "BIGINT"},
    "pool_stats": {"browsers": "BIGINT", "contexts": "BIGINT", "pages": "BIGINT"},
    "delta_replay": {"total_processed": "BIGINT", "pending": "BIGINT"},
    "snapshot_restore": {"pending": "BIGINT", "total_processed": "BIGINT"},
    "json_utils": {"valid": "BIGINT", "parsed": "BIGINT"},
    "json_literals": {"a": "BIGINT", "a_or": "BIGINT"},
    "session_export_import": {"tokens": "BIGINT"},
    "form_and_headers": {"n": "BIGINT"},
    "sweep_outcome": {"driven": "BIGINT", "skipped": "BIGINT", "observed": "BIGINT"},
    "error_families": {"n": "BIGINT"},
}


def typed(name: str, sql: str) -> str:
    """The SQL with the result's own column types."""
    if name not in TYPES:
        return sql
    casts = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in TYPES[name].items())
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"

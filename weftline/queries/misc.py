"""Text helpers, tokens, sessions, network logs, heartbeats and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..operators import interactions as I
from ..operators import sessions as S
from ..operators import tokens as K
from ..plans import middleware as M
from ..plans.lineage import checkpoint_dir
from ..streaming import stateful as Z
from .base import literal, literal_sql, table, wide

# ---- regex and JSON over documents and events


def regex_utils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns are ASCII; documents hold e-mail addresses, numbers and links."""
    d = wide(spark, sf_dir, "documents", "doc_id", "text")
    mail, number = r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}", r"[0-9]+"
    return d.select(
        "doc_id", X.test(mail, "text").alias("has_mail"), X.find_first(mail, "text").alias("mail"), X.count(number, "text").cast("long").alias("numbers"), F.array_join(X.find_all(number, "text"), " ").alias("all_numbers"),
        F.length(X.replace_all(number, "text", "$1\\")).cast("long").alias("replaced"), F.array_join(X.split("[,.]", "text", 3), "|").alias("pieces"), X.find_first_index(number, "text").cast("long").alias("at"))


_TEXTS = "(1, 'user@example.com'), (2, 'no mail'), (3, 'https://example.com/x'), (4, 'abc123def456'), (5, 'file.txt'), (6, 'a.b*c'), (7, 'HELLO')"


def regex_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = literal(spark, _TEXTS, "id, s")
    return t.select(
        "id", X.is_email("s").alias("email"), X.is_url("s").alias("url"), X.test(X.from_glob("*.t?t"), "s").alias("glob"), X.starts_with("[a-z]", "s").alias("starts"), X.ends_with("[0-9]+", "s").alias("ends"), X.test(X.case_insensitive("hello"), "s").alias("ci"),
        X.escape("s").alias("escaped"), X.replace_first("[0-9]+", "s", "#").alias("first"), F.array_join(X.extract_groups("([a-z]+)([0-9]+)", "s"), ",").alias("groups"), F.array_join(F.flatten(X.extract_all_groups("([a-z]+)([0-9]+)", "s")), ",").alias("all_groups"))


def json_utils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """props of events as JSON."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count_if(X.json_is_valid("props")).alias("valid"), F.count("*").alias("n"), F.count_if(X.json_parse("props").isNotNull()).alias("parsed"))


_JSON = """(1, '{"a": 1, "b": {"c": "x"}}'), (2, '[1, 2]'), (3, '{broken'), (4, 'null'), (5, '')"""


def json_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = literal(spark, _JSON, "id, s")
    return j.select("id", X.json_is_valid("s").alias("valid"), X.json_get("s", "$.b.c").alias("c"), X.json_get("s", "$.a", "bigint").alias("a"), X.json_or_default("s", "a bigint", F.struct(F.lit(-1).cast("long").alias("a"))).getField("a").alias("a_or"))


_MAPS = "(1, 'x', '1'), (1, 'y', '2'), (2, 'y', '3')"


def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = literal(spark, _MAPS, "id, k, v").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("m"))
    merged = m.withColumn("m", X.map_merge(F.col("m"), F.create_map(F.lit("y"), F.lit("9"), F.lit("z"), F.lit("8"))))
    return merged.select("id", F.explode(X.map_omit("m", ["z"])).alias("key", "value"))


def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rules = X.validate({"negative value": F.col("value") >= 0, "odd id": F.col("event_id") % 2 == 0})
    return e.groupBy(F.array_join(rules, "; ").alias("errors")).agg(F.count("*").alias("n"))


# ---- tokens

_PAGES = """(1, '<meta name="csrf-token" content="m1"><meta name="csrf-token" content="m2"><form><input type="hidden" name="_csrf" value="i1"></form><script>window.csrfToken = "s1"; var apiKey = "k1"; window["authToken"] = "w1"; window["csrfToken2"] = "w2";</script>', 'h1'),
 (2, '<!-- <meta name="api-key" content="no"> --><meta name="api-key" content="k"><script src="x.js">api_key = "not"</script><script>headers = {"authorization": "Bearer abc"}; api_token: "t"</script>', NULL), (3, '<p>none</p>', 'h3')"""


def token_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = literal(spark, _PAGES, "page_id, html, h").withColumn("headers", F.when(F.col("h").isNotNull(), F.create_map(F.lit("x-csrf-token"), F.col("h"), F.lit("authorization"), F.lit("Bearer z"))))
    return K.extract_tokens(p, headers="headers").select("page_id", "type", "value", "source", "rule")


def script_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = literal(spark, _PAGES, "page_id, html, h")
    return p.select("page_id", K.page_csrf("html").alias("csrf"), K.scripts_api(F.array(K.inline_scripts("html"))).alias("api"))


def token_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = literal(spark, _PAGES, "page_id, html, h")
    old = K.extract_tokens(p)
    new = K.extract_tokens(p.withColumn("html", F.replace("html", F.lit("m1"), F.lit("m9"))))
    return K.token_rotation(old, new)


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in the stored pages: their scripts track visits and have none."""
    return K.extract_tokens(wide(spark, sf_dir, "pages", "page_id", "html")).groupBy("type", "source").agg(F.count("*").alias("n"))


# ---- sessions


_SESSIONS = """('a', '2024-01-01 00:00:00', 'k', '1'), ('b', '2024-01-02 12:00:00', 'k', '2'), ('c', '2024-01-03 00:00:00', 'j', '3')"""
_AS_OF = "2024-01-03 06:00:00"


def _sessions(spark: SparkSession) -> DataFrame:
    s = literal(spark, _SESSIONS, "id, made, k, v").select("id", F.create_map("k", "v").alias("user_data"), F.to_timestamp("made").alias("created_at"))
    return S.with_expiry(s, "created_at", S.SESSION_TTL_S).withColumn("last_used_at", F.col("created_at"))


def session_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load_session(_sessions(spark), literal(spark, "('a'), ('b'), ('x')", "id"), F.to_timestamp(F.lit(_AS_OF)))


def session_user_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = literal(spark, "('b', 'k', '20'), ('c', 'new', '30')", "id, k, v").select("id", F.create_map("k", "v").alias("user_data"))
    done = S.update_user_data(_sessions(spark), up, F.to_timestamp(F.lit(_AS_OF)))
    return done.select("id", F.explode("user_data").alias("key", "value"), F.unix_seconds("last_used_at").alias("used"))


def session_export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark).withColumn("tokens", F.expr("array(named_struct('type', 'CSRF', 'value', 'v'), named_struct('type', 'ODD', 'value', 'w'))"))
    return S.import_session(S.export_session(s)).select("id", F.size("tokens").cast("long").alias("tokens"), F.unix_seconds("expires_at").alias("expires"))


def token_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = literal(spark, "(1, 'CSRF', 'a', '2024-01-01 00:00:00'), (2, 'CSRF', 'b', '2024-01-03 06:00:00'), (3, 'API', 'c', '2024-01-03 05:59:59'), (4, 'AUTH', 'd', NULL)", "seq, type, value, e").withColumn("expiry", F.to_timestamp("e"))
    return S.valid_tokens(t, F.to_timestamp(F.lit(_AS_OF))).select("type", "value")


_STORE = "('local', 1, 'put', 'a', '1'), ('local', 2, 'put', 'b', '2'), ('local', 3, 'remove', 'a', NULL), ('session', 4, 'put', 'a', '3'), ('session', 5, 'clear', NULL, NULL), ('session', 6, 'put', 'c', '4')"


def storage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.storage_state(literal(spark, _STORE, "store, seq, op, key, value"))


_JAR = '[{"name":"a","value":"1","domain":"example.com","path":"/"},{"name":"b","value":"2","domain":"www.example.com","path":"/x","host_only":true},{"name":"c","value":"3","domain":".example.com","path":"/","secure":true},{"name":"d","value":"4","domain":"other.example","path":"/"}]'
_CALLS = "(1, 'www.example.com', '/x/y', true), (2, 'www.example.com', '/xy', false), (3, 'example.com', '/', true), (4, 'badexample.com', '/', true)"


def cookie_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = literal(spark, _CALLS, "id, host, path, secure")
    return r.select("id", S.cookie_header(F.col("host"), F.col("path"), F.col("secure"), S.parse_jar(F.lit(_JAR))).alias("cookie"))


_EVIDENCE = """(1, 'u', 'm', 'u', true, 'u', false), (2, 'u', 'm', 'u', false, 'u', false), (3, 'u', 'm', 'u', true, 'u', true), (4, 'u', NULL, 'login', NULL, 'login', NULL), (5, 'u', NULL, 'u', NULL, 'login', NULL), (6, 'u', NULL, 'u', NULL, 'u', NULL), (7, 'u', 'm', 'u', NULL, 'u', NULL)"""


def session_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = literal(spark, _EVIDENCE, "id, url, marker, sf, sm, af, am")
    return e.select("id", C.session_verdict(*[F.col(c) for c in ("url", "marker", "sf", "sm", "af", "am")]).alias("v")).select("id", "v.valid", "v.reason")


_REQ = """(1, 200, NULL, 'network', '{"a":1}'), (2, 302, '/home', 'timeout', 'a=1'), (3, 403, NULL, 'network', '[bad'), (4, NULL, '/x', 'parse', '')"""


def client_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = literal(spark, _REQ, "id, status, location, kind, body")
    return r.select("id", C.login_succeeded("status", "location").alias("login"), C.client_retryable("kind", "status").alias("retryable"), C.content_type_of("body").alias("content_type"), C.is_successful("status").alias("success"))


def form_and_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = literal(spark, "(1, 'tok en', 'key'), (2, 'c', NULL), (3, NULL, NULL)", "id, csrf, api")
    h = x.select("id", C.form_body(F.create_map(F.lit("user name"), F.coalesce("csrf", F.lit("")))).alias("body"), C.auth_headers(F.col("csrf"), F.col("api")).alias("h"), C.csrf_field(F.lit('<input name="csrf_token">')).alias("field"))
    return h.select("id", "body", "field", F.size("h").cast("long").alias("n"), F.try_element_at("h", F.lit("Authorization")).alias("authorization"))


# ---- network logs, heartbeats, rates


def interval_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a request log: each user's purchases open a window of six hours."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    w = e.where(F.col("event_id") % 5 == 0).select("user_id", F.col("event_id").alias("control_id"), F.col("ts").alias("open_ts"), (F.col("ts") + 21600).alias("close_ts"))
    return I.attribute_requests(e.select("user_id", "event_id", "ts"), w, ["user_id"], 21600).select("event_id", "control_id")


_NET = "('p', 1, 'x', 'GET', 'xhr'), ('p', 2, 'x', 'GET', 'xhr'), ('p', 3, 'x', 'POST', 'xhr'), ('p', 4, 'p', 'GET', 'xhr'), ('p', 5, 'd', 'GET', 'document'), ('q', 6, 'x', 'GET', 'fetch')"


def network_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.network_ledger(literal(spark, _NET, "page_url, ts, url, method, resource_type"))


def sweep_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = literal(spark, "('p', 'a', true), ('p', 'b', false), ('q', 'c', false), ('r', 'd', true)", "page_url, control_id, driven")
    return I.sweep_outcome(c, literal(spark, "('p')", "page_url"))


def heartbeat_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users silent for a day at a moment in the data."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("domain")).where("ts <= timestamp '2024-01-20 00:00:00'")
    return Z.stale_workers(e, F.lit("2024-01-20 00:00:00").cast("timestamp"), 86400).select("worker_id", "domain", "elapsed_s")


def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("domain"), F.col("ts").cast("timestamp").alias("ts"))
    return Z.rate_violations(e, 8, "1 hour").select("domain", F.unix_seconds("start").alias("start"), "n")


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = literal(spark, "('a', 1, 0.0), ('a', 2, 0.1), ('a', 3, 0.2), ('a', 4, 5.0), ('b', 5, 0.1)", "domain, request_id, s").withColumn("ts", F.timestamp_micros((F.col("s") * 1000000).cast("long")))
    return Z.token_bucket_waits(r, 2.0).select("request_id", F.round("wait_s", 3).alias("wait_s"))


_TICKS = "('a', 1, 5, 3, 2), ('a', 2, 5, 3, 2), ('a', 3, 5, 3, 2), ('a', 4, 6, 3, 2), ('b', 1, 1, 4, 0), ('c', 1, 1, -1, 1), ('d', 1, 1, 0, 0), ('d', 2, 1, 0, 0)"


def stuck_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.stuck_domains(literal(spark, _TICKS, "domain, tick, page_count, queue_size, active_workers"))


def middleware_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests pass the chain forward and responses backward; of two recoveries the later replaces the earlier."""
    add = lambda c, x: lambda d: d.withColumn(c, F.concat(F.col(c), F.lit(x)))
    say = lambda x: lambda d: d.withColumn("recovery", F.lit(x))
    chain = [M.Middleware(n, add("trace", n), add("trace", n.upper()), say(n)) for n in "abc"]
    start = literal(spark, "(1, '')", "id, trace")
    there = M.process_requests(start, chain)
    back = M.process_responses(there, chain)
    return M.process_exceptions(back, chain)


def user_agent_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic choice per host in the place of a random one that is kept: rows only, as hashes differ between engines."""
    r = table(spark, sf_dir, "pages").select("url", F.create_map(F.lit("accept"), F.lit("*/*")).alias("headers"))
    return M.process_requests(r, [M.user_agents(["one", "two", "three"])]).select("url", F.element_at("headers", "user-agent").alias("agent"))


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as a stream into the keyed seen-set; its memory table."""
    s = spark.readStream.schema(table(spark, sf_dir, "pages").schema).parquet(f"{sf_dir}/pages.parquet*")
    name = "weftline_first_seen"
    q = Z.dedup_stream(s.withColumn("ts", F.timestamp_seconds("page_id"))).select("page_id", "key").writeStream.format("memory").queryName(name).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    r = s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("domain"))
    name = "weftline_rate"
    q = Z.rate_stream(r, "1 hour", "1 day").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("domain", F.unix_seconds("window.start").alias("start"), "n")


_T0 = "epoch_us(TIMESTAMP '{}') // 1000000"
ORACLE = {
    "regex_utils": r"""SELECT doc_id, regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}') AS has_mail, nullif(regexp_extract(text, '[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}'), '') AS mail, len(regexp_extract_all(text, '[0-9]+')) AS numbers, array_to_string(regexp_extract_all(text, '[0-9]+'), ' ') AS all_numbers,
        length(regexp_replace(text, '[0-9]+', 'xyz', 'g')) AS replaced, array_to_string(string_split_regex(text, '[,.]')[1:3], '|') AS pieces, CASE WHEN regexp_matches(text, '[0-9]') THEN length(regexp_extract(text, '^[^0-9]*')) END AS at FROM documents""",
    "regex_literals": r"""SELECT id, s LIKE '%@example.com' AS email, s LIKE 'https://%' AS url, s = 'file.txt' AS glob, regexp_matches(s, '^[a-z]') AS starts, regexp_matches(s, '[0-9]+$') AS ends, s = 'HELLO' AS ci, regexp_replace(s, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS escaped, regexp_replace(s, '[0-9]+', '#') AS first,
        CASE WHEN id = 4 THEN 'abc,123' END AS groups, CASE WHEN id = 4 THEN 'abc,123,def,456' ELSE '' END AS all_groups FROM """ + literal_sql(_TEXTS, "id, s"),
    "json_utils": "SELECT event_type, count_if(json_valid(props)) AS valid, count(*) AS n, count_if(json_valid(props)) AS parsed FROM events GROUP BY 1",
    "json_literals": "SELECT * FROM (VALUES (1, true, 'x', 1, 1), (2, true, NULL, NULL, NULL), (3, false, NULL, NULL, NULL), (4, true, NULL, NULL, NULL), (5, false, NULL, NULL, -1)) AS t(id, valid, c, a, a_or)",
    "map_merge": "SELECT * FROM (VALUES (1, 'x', '1'), (1, 'y', '9'), (2, 'y', '9')) AS t(id, key, value)",
    "validation_errors": "SELECT concat_ws('; ', CASE WHEN NOT coalesce(value >= 0, false) THEN 'negative value' END, CASE WHEN event_id % 2 <> 0 THEN 'odd id' END) AS errors, count(*) AS n FROM events GROUP BY 1",
    "token_union_distinct": """SELECT * FROM (VALUES (1, 'CSRF', 'm1', 'html', 'meta[name="csrf-token"]'), (1, 'CSRF', 'i1', 'html', 'input[name="_csrf"]'), (1, 'CSRF', 's1', 'script', 'window.csrfToken'), (1, 'API', 'k1', 'script', 'api_key'), (1, 'API', 'w1', 'script', 'window[''authToken'']'),
        (1, 'CSRF', 'w2', 'script', 'window[''csrfToken2'']'), (1, 'CSRF', 'h1', 'header', 'x-csrf-token'), (1, 'AUTH', 'Bearer z', 'header', 'authorization'), (2, 'API', 'k', 'html', 'meta[name="api-key"]'), (2, 'API', 't', 'script', 'api_token'), (2, 'API', 'abc', 'script', 'authorization'),
        (2, 'CSRF', 't', 'script', '_token'), (3, 'CSRF', 'h3', 'header', 'x-csrf-token'), (3, 'AUTH', 'Bearer z', 'header', 'authorization')) AS t(page_id, type, value, source, rule)""",
    "script_tokens": "SELECT * FROM (VALUES (1, 'm1', 'k1'), (2, 't', 't'), (3, NULL, NULL)) AS t(page_id, csrf, api)",
    "token_rotation": "SELECT 1 AS page_id, 'CSRF' AS type, 'm1' AS old_value, 'm9' AS new_value",
    "page_tokens": "SELECT '' AS type, '' AS source, 0 AS n WHERE false",
    "session_load": "SELECT * FROM (VALUES ('a', 'expired'), ('b', 'ok'), ('x', 'not_found')) AS t(id, status)",
    "session_user_data": f"""SELECT * FROM (VALUES ('a', 'k', '1', {_T0.format('2024-01-01 00:00:00')}), ('b', 'k', '20', {_T0.format(_AS_OF)}), ('c', 'j', '3', {_T0.format(_AS_OF)}), ('c', 'new', '30', {_T0.format(_AS_OF)})) AS t(id, key, value, used)""",
    "session_export_import": f"SELECT id, 1 AS tokens, epoch_us(CAST(made AS TIMESTAMP)) // 1000000 + 86400 AS expires FROM {literal_sql(_SESSIONS, 'id, made, k, v')}",
    "token_validity": "SELECT * FROM (VALUES ('CSRF', 'b'), ('AUTH', 'd')) AS t(type, value)",
    "storage_state": "SELECT * FROM (VALUES ('local', 'b', '2'), ('session', 'c', '4')) AS t(store, key, value)",
    "cookie_lookup": "SELECT * FROM (VALUES (1, 'b=2; a=1; c=3'), (2, 'a=1'), (3, 'a=1; c=3'), (4, '')) AS t(id, cookie)",
    "session_verdict": """SELECT * FROM (VALUES (1, true, 'marker-seen-only-by-session'), (2, false, 'marker-absent-from-session'), (3, false, 'marker-not-discriminating'), (4, false, 'session-redirected-away'), (5, true, 'anonymous-redirected-away'), (6, false, 'no-protection-observed'),
        (7, false, 'marker-absent-from-session')) AS t(id, valid, reason)""",
    "client_decisions": """SELECT id, coalesce(status IN (200, 302), false) OR location IS NOT NULL AS login, kind = 'timeout' OR (kind = 'network' AND NOT coalesce(status BETWEEN 400 AND 499, false)) AS retryable, CASE WHEN json_valid(body) THEN 'application/json' ELSE 'application/x-www-form-urlencoded' END AS content_type,
        coalesce(status BETWEEN 200 AND 299, true) AS success FROM """ + literal_sql(_REQ, "id, status, location, kind, body"),
    "form_and_headers": "SELECT * FROM (VALUES (1, 'user+name=tok+en', 'csrf_token', 4, 'Bearer key'), (2, 'user+name=c', 'csrf_token', 2, NULL), (3, 'user+name=', 'csrf_token', 0, NULL)) AS t(id, body, field, n, \"authorization\")",
    "interval_attribution": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS ts FROM events), w AS (SELECT user_id, event_id AS control_id, ts AS o FROM e WHERE event_id % 5 = 0)
        SELECT e.event_id, arg_max(w.control_id, w.o * 1000000 + w.control_id) AS control_id FROM e LEFT JOIN w ON w.user_id = e.user_id AND e.ts >= w.o AND e.ts < w.o + 21600 GROUP BY 1""",
    "network_ledger": "SELECT * FROM (VALUES ('p', 1, 'x', 'GET', 'xhr'), ('p', 3, 'x', 'POST', 'xhr'), ('q', 6, 'x', 'GET', 'fetch')) AS t(page_url, ts, url, method, resource_type)",
    "sweep_outcome": "SELECT * FROM (VALUES ('p', 1, 1, 1, 'revealed'), ('q', 0, 1, 0, 'no-controls-driven'), ('r', 1, 0, 0, 'nothing-revealed')) AS t(page_url, driven, skipped, observed, outcome)",
    "heartbeat_stale": """SELECT worker_id, domain, elapsed_s FROM (SELECT user_id AS worker_id, arg_max(event_type, ts) AS domain, epoch_us(TIMESTAMP '2024-01-20 00:00:00') // 1000000 - epoch_us(max(ts)) // 1000000 AS elapsed_s FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1) WHERE elapsed_s > 86400""",
    "rate_window": "SELECT event_type AS domain, epoch_us(date_trunc('hour', ts)) // 1000000 AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 8",
    "token_bucket": "SELECT * FROM (VALUES (1, 0.0::DOUBLE), (2, 0.4::DOUBLE), (3, 0.8::DOUBLE), (4, 0.0::DOUBLE), (5, 0.0::DOUBLE)) AS t(request_id, wait_s)",
    "stuck_domains": "SELECT * FROM (VALUES ('a', 3, 'no_progress_for_60s'), ('b', 1, 'no_workers_with_queue_items'), ('c', 1, 'negative_queue_size')) AS t(domain, tick, reason)",
    "middleware_order": "SELECT 1 AS id, 'abcCBA' AS trace, 'a' AS recovery",
    "stream_rate": "SELECT event_type AS domain, epoch_us(date_trunc('day', ts)) // 1000000 AS start, count(*) AS n FROM events GROUP BY 1, 2",
}
QUERIES = {f.__name__: f for f in (
    regex_utils, regex_literals, json_utils, json_literals, map_merge, validation_errors, token_union_distinct, script_tokens, token_rotation, page_tokens, session_load, session_user_data, session_export_import, token_validity,
    storage_state, cookie_lookup, session_verdict, client_decisions, form_and_headers, interval_attribution, network_ledger, sweep_outcome, heartbeat_stale, rate_window, token_bucket, stuck_domains, middleware_order,
    user_agent_sticky, stream_first_seen, stream_rate,
)}

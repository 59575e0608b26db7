"""Schemas of the engine's tables, as DDL."""

PAGES = "page_id long, url string, html string, status int, headers map<string,string>, fetched_at timestamp, duration_ms double, depth int"
PAGE_DATA = (
    "url string, title string, metadata map<string,string>, common_metadata struct<description:string,keywords:string,author:string,robots:string>, status int, "
    "headers map<string,string>, fetched_at timestamp, duration_ms double, depth int, extracted variant"
)
STARTS = "start_id long, url string, fallback_urls array<string>, metadata map<string,string>"
LINKS = "page_id long, url string, tag string, attr string, ix int, pos int, href string"
ROBOTS = "origin string, status int, body string, cause string"
ROBOTS_RULES = "origin string, pos int, kind string, path string, regex string, len int"
FRONTIER = "start_id long, parent long, pos int, url string, from_url string"
VISITS = "start_id long, seq long, url string, key string, depth int, from_url string, outcome string, reason string, error_kind string"
FETCH_ERRORS = "url string, kind string, duration_ms double, status int, message string, attempts int"
TOKENS = "page_id long, ord int, type string, value string, source string, rule string"
HEARTBEATS = "worker_id string, domain string, url string, ts timestamp"
NETWORK_LOG = "page_url string, ts long, url string, method string, resource_type string"
CONTROL_WINDOWS = "page_url string, control_id string, label string, open_ts long, close_ts long"

"""Decision tables over recorded evidence: errors, retries, sessions, logins, requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_KINDS = ("timeout", "dns", "http_4xx", "http_429", "http_5xx", "connection_refused", "other")
RETRY_ON = ("http_429", "http_5xx", "timeout")
_SENTINEL = "[adapter-kind:"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any(text: Column, *needles: str) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def error_kind(error_class: Column | str, status: Column | str, cause: Column | str) -> Column:
    """The kind of a failed fetch, from its error class (timeout, abort, network, response, ...), HTTP status and cause."""
    e, s, c = _c(error_class), _c(status), F.coalesce(_c(cause), F.lit(""))
    refused = F.when(_any(c, "ECONNREFUSED"), "connection_refused").otherwise("other")
    network = (
        F.when(s >= 500, "http_5xx").when(s == 429, "http_429").when(s >= 400, "http_4xx")
        .when(c.contains(f"{_SENTINEL}dns:"), "dns").when(c.contains(f"{_SENTINEL}connection_refused:"), "connection_refused")
        .when(_any(c, "getaddrinfo", "ENONAME", "ENOTFOUND", "WSAHOST_NOT_FOUND"), "dns").otherwise(refused)
    )
    return F.when(e.isin("timeout", "abort"), "timeout").when(e == "network", network).when(e == "response", refused).otherwise("other")


def default_status(kind: Column | str, status: Column | str) -> Column:
    """The given status, or the usual one of the kind."""
    k = _c(kind)
    return F.coalesce(_c(status), F.when(k == "http_4xx", 400).when(k == "http_429", 429).when(k == "http_5xx", 500))


def is_successful(status: Column | str) -> Column:
    """2xx; an absent status counts as success."""
    return F.coalesce(_c(status).between(200, 299), F.lit(True))


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 3
    base_ms: int = 1000
    retry_on: tuple[str, ...] = RETRY_ON

    def __post_init__(self) -> None:
        if self.max_attempts < 1 or self.base_ms < 0:
            raise ValueError("max_attempts must be at least 1 and base_ms at least 0")
        if unknown := set(self.retry_on) - set(ERROR_KINDS):
            raise ValueError(f"unknown error kinds: {sorted(unknown)}")


def retry_plan(kind: Column | str, policy: RetryPolicy = RetryPolicy()) -> Column:
    """The waits in ms before further attempts that all fail with this kind; empty if it isn't retried."""
    waits = F.array(*[F.lit(policy.base_ms * 2**i).cast("long") for i in range(policy.max_attempts - 1)]) if policy.max_attempts > 1 else F.array().cast("array<long>")
    return F.when(_c(kind).isin(list(policy.retry_on)), waits).otherwise(F.array().cast("array<long>"))


def client_retryable(kind: Column | str, status: Column | str) -> Column:
    """The enhanced client retries timeouts, and network errors unless the status is 4xx."""
    return (_c(kind) == "timeout") | ((_c(kind) == "network") & ~F.coalesce(_c(status).between(400, 499), F.lit(False)))


def content_type_of(body: Column | str) -> Column:
    """What a string body is sent as: JSON if it parses as such, else a form."""
    return F.when(F.trim(_c(body)).rlike(r"^[\[{]") & F.try_parse_json(_c(body)).isNotNull(), "application/json").otherwise("application/x-www-form-urlencoded")


def form_body(fields: Column | str) -> Column:
    """A map as an urlencoded body, in the map's order."""
    return F.array_join(F.transform(F.map_entries(_c(fields)), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")


def session_verdict(url: Column, marker: Column, session_final: Column, session_marker: Column, anon_final: Column, anon_marker: Column) -> Column:
    """struct(valid, reason): by the marker if the request names one, else by redirects."""
    seen = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(marker.isNotNull(), F.when(~seen(session_marker), "marker-absent-from-session").when(seen(anon_marker), "marker-not-discriminating").otherwise("marker-seen-only-by-session"))
        .when(~session_final.eqNullSafe(url), "session-redirected-away").when(~anon_final.eqNullSafe(url), "anonymous-redirected-away").otherwise("no-protection-observed")
    )
    return F.struct(reason.isin("marker-seen-only-by-session", "anonymous-redirected-away").alias("valid"), reason.alias("reason"))


def login_succeeded(status: Column | str, location: Column | str) -> Column:
    return F.coalesce(_c(status).isin(200, 302), F.lit(False)) | _c(location).isNotNull()


CSRF_FIELDS = ("_csrf", "csrf", "csrf_token", "_token", "authenticity_token")


def csrf_field(html: Column | str) -> Column:
    """The first known CSRF field name that the form has."""
    return F.coalesce(*[F.when(_c(html).contains(f'name="{n}"'), n) for n in CSRF_FIELDS])


def auth_headers(csrf: Column, api: Column) -> Column:
    """Headers for an authenticated request from the tokens at hand."""
    empty = F.create_map().cast("map<string,string>")
    a = F.when(csrf.isNotNull(), F.create_map(F.lit("X-CSRF-Token"), csrf, F.lit("X-Requested-With"), F.lit("XMLHttpRequest"))).otherwise(empty)
    b = F.when(api.isNotNull(), F.create_map(F.lit("Authorization"), F.concat(F.lit("Bearer "), api), F.lit("X-API-Key"), api)).otherwise(empty)
    return F.map_concat(a, b)


def sticky_choice(domain: Column | str, values: list[str]) -> Column:
    """One of the values per domain, always the same one."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(_c(domain)), F.lit(len(values))) + 1).cast("int"))

"""URL functions as native Columns.

They take absolute ``scheme://host`` URLs apart with one anchored pattern, so they stay inside code generation and mean the same
in Spark and in other SQL engines. Paths and queries are kept as written; ``functions.whatwg`` has the exact parser, with
percent-encoding, dot segments and punycode, as an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@\s]*)@)?([^/?#:@\s]+)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_GROUPS = ("scheme", "auth", "host", "port", "path", "search", "hash")
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _raw(url: Column | str, part: str) -> Column:
    return F.regexp_extract(F.trim(_c(url)), PATTERN, _GROUPS.index(part) + 1)


def is_valid(url: Column | str) -> Column:
    """False for null too."""
    return F.coalesce(F.trim(_c(url)).rlike(PATTERN), F.lit(False))


def _if_valid(url: Column | str, value: Column) -> Column:
    return F.when(is_valid(url), value)


def scheme(url: Column | str) -> Column:
    return _if_valid(url, F.lower(_raw(url, "scheme")))


def auth(url: Column | str) -> Column:
    return _if_valid(url, _raw(url, "auth"))


def get_domain(url: Column | str) -> Column:
    """The host in lower case; null if the URL can't be parsed."""
    return _if_valid(url, F.lower(_raw(url, "host")))


def port(url: Column | str) -> Column:
    """Empty if it is the scheme's own."""
    p, s = _raw(url, "port"), F.lower(_raw(url, "scheme"))
    own = F.lit(False)
    for name, number in DEFAULT_PORTS.items():
        own = own | ((s == name) & (p == number))
    return _if_valid(url, F.when(own, F.lit("")).otherwise(p))


def path(url: Column | str) -> Column:
    p = _raw(url, "path")
    return _if_valid(url, F.when(p == "", F.lit("/")).otherwise(p))


def search(url: Column | str) -> Column:
    """With its question mark; empty if there is nothing after it."""
    s = _raw(url, "search")
    return _if_valid(url, F.when(s == "?", F.lit("")).otherwise(s))


def fragment(url: Column | str) -> Column:
    h = _raw(url, "hash")
    return _if_valid(url, F.when(h == "#", F.lit("")).otherwise(h))


def parts(url: Column | str) -> Column:
    """All parts as a struct; null if the URL can't be parsed."""
    return _if_valid(
        url,
        F.struct(
            scheme(url).alias("scheme"), auth(url).alias("auth"), get_domain(url).alias("host"), port(url).alias("port"),
            path(url).alias("path"), search(url).alias("search"), fragment(url).alias("hash"),
        ),
    )


def _assemble(scheme_: Column, auth_: Column, host: Column, port_: Column, path_: Column, search_: Column, hash_: Column) -> Column:
    at = F.when(auth_ != "", F.concat(auth_, F.lit("@"))).otherwise("")
    colon = F.when(port_ != "", F.concat(F.lit(":"), port_)).otherwise("")
    return F.concat(scheme_, F.lit("://"), at, host, colon, path_, search_, hash_)


def _sorted_search(url: Column | str) -> Column:
    """Pairs by key, with equal keys in their order."""
    pairs = F.filter(F.split(F.substring(search(url), 2, 1 << 30), "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p")))
    joined = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["p"]), "&")
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined))


def get_origin(url: Column | str) -> Column:
    return _assemble(scheme(url), F.lit(""), get_domain(url), port(url), F.lit(""), F.lit(""), F.lit(""))


def is_same_origin(a: Column | str, b: Column | str) -> Column:
    return get_origin(a) == get_origin(b)


def is_absolute(url: Column | str) -> Column:
    return _c(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def is_secure(url: Column | str) -> Column:
    return scheme(url) == "https"


def to_https(url: Column | str) -> Column:
    return F.when(scheme(url) == "http", F.regexp_replace(F.trim(_c(url)), r"^[hH][tT][tT][pP]:", "https:")).otherwise(_c(url))


def get_extension(url: Column | str) -> Column:
    """From the last dot after the last slash of the path; null if there is none."""
    found = F.regexp_extract(path(url), r"(\.[^./]*)$", 1)
    return F.when(found != "", found)


def normalise(url: Column | str) -> Column:
    """Host in lower case, no default port, no fragment, one trailing slash off, query sorted by key."""
    p = path(url)
    trimmed = F.when((p != "/") & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    return _assemble(scheme(url), auth(url), get_domain(url), port(url), trimmed, _sorted_search(url), F.lit(""))


def dedup_key(url: Column | str) -> Column:
    """As ``normalise``, with runs of slashes collapsed; a URL that can't be parsed is its own key."""
    p = F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), "/$", "")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    return F.coalesce(_assemble(scheme(url), auth(url), get_domain(url), port(url), p, _sorted_search(url), F.lit("")), _c(url))


@dataclass(frozen=True)
class Strategy:
    """Which differences between URLs count when they are deduplicated."""

    www: str = "ignore"  # ignore, prefer-www, prefer-non-www, preserve
    protocol: str = "prefer-https"  # prefer-https, ignore, preserve
    slash: str = "ignore"  # ignore, preserve
    query: str = "preserve"  # preserve, sort, ignore
    fragment: str = "ignore"  # ignore, preserve

    def __post_init__(self) -> None:
        allowed = {
            "www": {"ignore", "prefer-www", "prefer-non-www", "preserve"}, "protocol": {"prefer-https", "ignore", "preserve"},
            "slash": {"ignore", "preserve"}, "query": {"preserve", "sort", "ignore"}, "fragment": {"ignore", "preserve"},
        }
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {sorted(values)}, not {getattr(self, name)!r}")


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def normalize_url(url: Column | str, strategy: Strategy = Strategy()) -> Column:
    """The URL under a strategy; null if it can't be parsed."""
    host = get_domain(url)
    if strategy.www in ("ignore", "prefer-non-www"):
        host = strip_www(host)
    elif strategy.www == "prefer-www":
        host = F.when(host.startswith("www."), host).otherwise(F.concat(F.lit("www."), host))
    s = F.when(is_valid(url), F.lit("https")) if strategy.protocol == "prefer-https" else scheme(url)
    p = path(url)
    if strategy.slash == "ignore":
        p = F.regexp_replace(p, "/$", "")
        p = F.when(p == "", F.lit("/")).otherwise(p)
    q = {"ignore": lambda: F.lit(""), "sort": lambda: _sorted_search(url), "preserve": lambda: search(url)}[strategy.query]()
    return _assemble(s, auth(url), host, port(url), p, q, F.lit("") if strategy.fragment == "ignore" else fragment(url))


def dedup_domain(url: Column | str) -> Column:
    """The host without one leading www."""
    return strip_www(get_domain(url))


def comparison_domain(host: Column | str, www: str = "ignore") -> Column:
    """A host for comparison: lower case, all leading www. off if they are ignored, no final dot."""
    h = F.lower(_c(host))
    if www == "ignore":
        h = F.regexp_replace(h, r"^(www\.)+", "")
    return F.regexp_replace(h, r"\.$", "")


def query_params(url: Column | str) -> Column:
    """map<string,string>, form-decoded; the last of equal keys wins."""
    raw = F.filter(F.split(F.substring(search(url), 2, 1 << 30), "&"), lambda p: p != "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(raw, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.when(p.contains("="), F.regexp_replace(p, r"^[^=]*=", "")).otherwise("")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def _query_of(pairs: Column) -> Column:
    joined = F.array_join(pairs, "&")
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined))


def _encoded(text: str) -> str:
    from urllib.parse import quote_plus

    return quote_plus(text, safe="*-._")


def _has_key(key: str):
    return lambda p: F.substring_index(p, "=", 1) == key


def _first_or_other(same, pairs: Column):
    return lambda s: ~same(s["p"]) | ~F.exists(F.slice(pairs, F.lit(1), s["i"]), lambda q: same(q))


def _swap(same, new: Column):
    return lambda s: F.when(same(s["p"]), new).otherwise(s["p"])


def set_query_params(url: Column | str, params: Mapping[str, object]) -> Column:
    """Each key's first pair takes the new value and its others go; keys not there yet are appended."""
    pairs = F.filter(F.split(F.substring(search(url), 2, 1 << 30), "&"), lambda p: p != "")
    for key, value in params.items():
        new = F.lit(f"{_encoded(key)}={_encoded(str(value))}")
        same = _has_key(_encoded(key))
        kept = F.transform(F.filter(F.transform(pairs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), _first_or_other(same, pairs)), _swap(same, new))
        pairs = F.when(F.exists(pairs, same), kept).otherwise(F.concat(pairs, F.array(new)))
    return _assemble(scheme(url), auth(url), get_domain(url), port(url), path(url), _query_of(pairs), fragment(url))


def remove_query_params(url: Column | str, keys: Sequence[str]) -> Column:
    pairs = F.filter(F.split(F.substring(search(url), 2, 1 << 30), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin([_encoded(k) for k in keys]))
    return _assemble(scheme(url), auth(url), get_domain(url), port(url), path(url), _query_of(pairs), fragment(url))


def join(base: Column | str, *segments: Column | str) -> Column:
    """Segments that start with a slash replace the path, others are appended to it."""
    p = path(base)
    for s in segments:
        s = F.lit(s) if isinstance(s, str) else s
        p = F.when(s.startswith("/"), s).otherwise(F.concat(F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/"))), s))
    return _assemble(scheme(base), auth(base), get_domain(base), port(base), p, search(base), fragment(base))


def matches_pattern(url: Column | str, pattern: Column | str) -> Column:
    """Same origin, and a path that fits the pattern's, where * stands for anything."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    escaped = F.regexp_replace(path(pattern), r"([.+?^${}()|\[\]\\])", r"\\$1")
    rx = F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("$"))
    return is_same_origin(url, pattern) & F.regexp_like(path(url), rx)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """A link against its page's URL, for the common forms; dot segments and encoding need the exact parser."""
    h = F.trim(_c(href))
    origin = get_origin(base)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(is_absolute(h), F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.when(is_valid(h), h)).otherwise(h))
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(origin, path(base), h))
        .when(h.startswith("#"), F.concat(origin, path(base), search(base), h))
        .when(h == "", F.concat(origin, path(base), search(base)))
        .otherwise(F.concat(origin, folder, h))
    )

"""CSRF and API tokens in markup, scripts and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H

_META, _INPUT = ("meta", "content"), ("input", "value")
#: (type, tag and attribute, name), in order
ELEMENTS = [
    *[("CSRF", _META, n) for n in ("csrf-token", "_csrf", "csrf_token", "authenticity_token")],
    *[("CSRF", _INPUT, n) for n in ("csrf_token", "_csrf", "authenticity_token", "__RequestVerificationToken")],
    *[("API", _META, n) for n in ("api-key", "api_key", "api-token", "access-token")],
]
_Q = r"""["']"""


def _assigned(name: str, fold: bool = False, bearer: bool = False) -> str:
    return f"{'(?i)' if fold else ''}{name}{_Q}?\\s*[:=]\\s*{_Q}{'Bearer' + chr(92) + 's+' if bearer else ''}([^\"']+){_Q}"


#: (type, name, pattern), in order
SCRIPTS = [
    ("CSRF", "window.csrfToken", rf"window\.csrfToken\s*=\s*{_Q}([^\"']+){_Q}"), ("CSRF", "csrf_token", _assigned("csrf[_-]?token", True)), ("CSRF", "_token", _assigned("_token")),
    ("CSRF", "authenticity_token", _assigned("authenticity_token")), ("CSRF", "X-CSRF-Token", _assigned("X-CSRF-Token")),
    ("API", "api_key", _assigned("api[_-]?key", True)), ("API", "api_token", _assigned("api[_-]?token", True)), ("API", "X-Secret-Token", _assigned("X-Secret-Token")),
    ("API", "authorization", _assigned("authorization", True, True)), ("API", "access_token", _assigned("access[_-]?token", True)), ("API", "secret_key", _assigned("secret[_-]?key", True)),
]
WINDOW = rf"window\[{_Q}([^\"']*[Tt]oken[^\"']*){_Q}\]\s*=\s*{_Q}([^\"']+){_Q}"
HEADERS = [("x-csrf-token", "CSRF"), ("x-auth-token", "AUTH"), ("x-api-key", "API"), ("authorization", "AUTH"), ("x-access-token", "AUTH")]
_TOKEN = "array<struct<type:string,value:string,source:string,rule:string>>"


def inline_scripts(html: Column | str) -> Column:
    """The bodies of scripts without a src, joined by newlines."""
    h = F.col(html) if isinstance(html, str) else html
    whole = F.regexp_extract_all(h, F.lit(r"(?is)<script\b[^>]*>.*?</script>"), F.lit(0))
    inline = F.filter(whole, lambda s: ~F.regexp_extract(s, r"(?is)^(<script\b[^>]*>)", 1).rlike(r"(?is)\ssrc\s*="))
    return F.array_join(F.transform(inline, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?is)^<script\b[^>]*>", ""), r"(?is)</script>$", "")), "\n")


def _token(kind, value: Column, source: str, rule) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(value != "", F.struct(lit(kind).alias("type"), value.alias("value"), F.lit(source).alias("source"), lit(rule).alias("rule")))


def html_tokens(html: Column | str) -> Column:
    seen = H.visible(html)
    out = []
    for kind, (tag, attr), name in ELEMENTS:
        first = F.get(F.filter(H.tags(seen, tag), lambda t: H.attribute(t, "name") == name), F.lit(0))
        out.append(_token(kind, H.attribute(first, attr), "html", f'{tag}[name="{name}"]'))
    return F.array_compact(F.array(*out)).cast(_TOKEN)


def script_tokens(html: Column | str) -> Column:
    text = inline_scripts(html)
    fixed = F.array_compact(F.array(*[_token(kind, F.regexp_extract(text, p, 1), "script", name) for kind, name, p in SCRIPTS])).cast(_TOKEN)
    keys, values = (F.regexp_extract_all(text, F.lit(WINDOW), F.lit(k)) for k in (1, 2))
    low = lambda k: F.lower(k)
    window = F.transform(keys, lambda k, i: _token(F.when(low(k).contains("csrf") | low(k).contains("authenticity"), "CSRF").otherwise("API"), F.get(values, i), "script", F.concat(F.lit("window['"), k, F.lit("']"))))
    return F.concat(fixed, F.array_compact(window).cast(_TOKEN))


def header_tokens(headers: Column | str) -> Column:
    """``headers`` is a map with lower-case names."""
    h = F.col(headers) if isinstance(headers, str) else headers
    return F.array_compact(F.array(*[_token(kind, F.try_element_at(h, F.lit(name)), "header", name) for name, kind in HEADERS])).cast(_TOKEN)


def extract_tokens(pages: DataFrame, html: str = "html", headers: str | None = None) -> DataFrame:
    """``page_id, ord, type, value, source, rule``: distinct by type and value; the first of markup, scripts and headers counts."""
    parts = [html_tokens(html), script_tokens(html)] + ([F.coalesce(header_tokens(headers), F.array().cast(_TOKEN))] if headers else [])
    rows = pages.select("page_id", F.posexplode(F.concat(*parts)).alias("ord", "__token")).select("page_id", "ord", "__token.*")
    first = F.row_number().over(Window.partitionBy("page_id", "type", "value").orderBy("ord"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n")


def first_token(tokens: DataFrame, kind: str) -> DataFrame:
    """``page_id, value``: a page's first token of a type."""
    return tokens.where(F.col("type") == kind).groupBy("page_id").agg(F.min_by("value", "ord").alias("value"))


def token_rotation(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("page_id", "type")) -> DataFrame:
    """Keys with a new value that differs from the old one, with both."""
    o = old.groupBy(*keys).agg(F.min_by("value", "ord").alias("old_value"))
    n = new.groupBy(*keys).agg(F.min_by("value", "ord").alias("new_value"))
    return o.join(n, list(keys)).where("old_value <> new_value")


def page_csrf(html: Column | str) -> Column:
    """One CSRF token by markup (content, else value), then scripts; null if none."""
    seen, text = H.visible(html), inline_scripts(html)
    blank = lambda c: F.when(c != "", c)
    out = []
    for kind, (tag, _), name in ELEMENTS:
        if kind == "CSRF":
            first = F.get(F.filter(H.tags(seen, tag), lambda t: H.attribute(t, "name") == name), F.lit(0))
            out += [blank(H.attribute(first, "content")), blank(H.attribute(first, "value"))]
    return F.coalesce(*out, *[blank(F.regexp_extract(text, p, 1)) for kind, _, p in SCRIPTS if kind == "CSRF"])


def scripts_api(scripts: Column | str) -> Column:
    """One API token of an array of scripts; null if none."""
    text = F.array_join(F.col(scripts) if isinstance(scripts, str) else scripts, "\n")
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(*[blank(F.regexp_extract(text, p, 1)) for kind, _, p in SCRIPTS if kind == "API"], blank(F.regexp_extract(text, WINDOW, 2)))

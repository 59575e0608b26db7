"""Declarative fields from markup: selectors to text, attributes, flags, lists and records; and recipes over them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H

_KEYS = {"selector", "attribute", "exists", "multiple", "fields", "text"}


def check_config(config: Mapping[str, Any], nested: bool = False) -> None:
    """ValueError unless every field is a selector or a mapping of the known keys; records nest one level only."""
    for name, spec in config.items():
        spec = {"selector": spec} if isinstance(spec, str) else spec
        if not isinstance(spec, Mapping) or "selector" not in spec or set(spec) - _KEYS:
            raise ValueError(f"field {name!r}: a selector, or a mapping with selector and some of {sorted(_KEYS - {'selector'})}")
        H.compile_selector(spec["selector"])
        if "fields" in spec:
            if nested:
                raise ValueError(f"field {name!r}: records nest one level only")
            check_config(spec["fields"], nested=True)


def _field(root: H.Node, spec: str | Mapping[str, Any]) -> Any:
    spec = {"selector": spec} if isinstance(spec, str) else spec
    found, attribute = H.select(root, spec["selector"]), spec.get("attribute")
    if spec.get("exists"):
        return bool(found)
    if spec.get("multiple"):
        if not found:
            return None
        if "fields" in spec:
            return [{k: _nested(n, s) for k, s in spec["fields"].items()} for n in found]
        return [n.attrs.get(attribute) for n in found] if attribute else [n.text().strip() for n in found]
    if attribute:
        return found[0].attrs.get(attribute) if found else None
    return "".join(n.text() for n in found).strip() or None


def _nested(n: H.Node, spec: str | Mapping[str, Any]) -> Any:
    spec = {"selector": spec} if isinstance(spec, str) else spec
    found = H.select(n, spec["selector"])
    if spec.get("attribute"):
        return found[0].attrs.get(spec["attribute"]) if found else None
    return "".join(x.text() for x in found).strip()


def extract(html: str | None, config: Mapping[str, Any]) -> dict[str, Any]:
    root = H.parse(html)
    return {k: v for k, spec in config.items() if (v := _field(root, spec)) is not None}


def extract_json(html: Column | str, config: Mapping[str, Any]) -> Column:
    """The fields as a JSON object; absent ones are left out."""
    check_config(config)
    plain = json.loads(json.dumps(config))

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(extract(x, plain), ensure_ascii=False) for x in column], dtype=object)

    return run(F.col(html) if isinstance(html, str) else html)


def extract_fields(pages: DataFrame, config: Mapping[str, Any], html: str = "html", depth: str | None = None) -> DataFrame:
    """``pages`` without the markup and with extracted, a VARIANT. With a depth column only depth 0 is extracted."""
    rows = pages if depth is None else pages.withColumn(html, F.when(F.col(depth) == 0, F.col(html)))
    kept = [c for c in pages.columns if c not in (html, "extracted")]
    out = rows.select(*kept, html, extract_json(html, config).alias("__json"))
    return out.select(*kept, F.when(F.col(html).isNotNull(), F.parse_json("__json")).alias("extracted"))


# ---- recipes

PRODUCT_LIST = {
    "products": {
        "selector": ".product, .row.product", "multiple": True,
        "fields": {"title": "h3", "url": {"selector": "a", "attribute": "href"}, "price": ".price", "description": ".short-description", "image": {"selector": "img", "attribute": "src"}},
    }
}
_PRODUCTS = "struct<products:array<struct<title:string,url:string,price:string,description:string,image:string>>>"


def amount(text: Column) -> Column:
    """The number in a price, else 0."""
    return F.coalesce(F.regexp_replace(text, "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def product_list(pages: DataFrame, html: str = "html", config: Mapping[str, Any] = PRODUCT_LIST) -> DataFrame:
    """``page_id, pos, product_id, title, url, price, description, image``"""
    rows = pages.select("page_id", F.from_json(extract_json(html, config), _PRODUCTS).alias("x")).select("page_id", F.posexplode("x.products").alias("pos", "p"))
    ident = F.regexp_extract("p.url", r"/product/(\d+)", 1)
    return rows.select("page_id", "pos", F.when(ident != "", ident).alias("product_id"), "p.title", "p.url", amount(F.col("p.price")).alias("price"), "p.description", "p.image")


def json_ld(html: Column | str) -> Column:
    """The first JSON-LD block as VARIANT, or null."""
    h = F.col(html) if isinstance(html, str) else html
    body = F.regexp_extract(h, r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", 1)
    return F.try_parse_json(F.trim(body))


def product_detail(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, name, price, rating, reviews``: from the page, else from its JSON-LD. A price on the page is a number always (0 if it can't
    be read), so JSON-LD serves only where the page has no such element."""
    config = {"name": "h1, h3.product-title", "price": ".product-price, .price"}
    x = pages.select("page_id", F.from_json(extract_json(html, config), "struct<name:string,price:string>").alias("x"), json_ld(html).alias("ld"))
    get = lambda path, kind: F.try_variant_get("ld", path, kind)
    return x.select(
        "page_id", F.coalesce("x.name", get("$.name", "string")).alias("name"), F.when(F.col("x.price").isNotNull(), amount(F.col("x.price"))).otherwise(get("$.offers.price", "double")).alias("price"),
        get("$.aggregateRating.ratingValue", "double").alias("rating"), get("$.aggregateRating.reviewCount", "int").alias("reviews"))


REVIEWS = {"reviews": {"selector": ".review", "multiple": True, "fields": {"text": "p", "date": {"selector": "[data-date]", "attribute": "data-date"}}}}
TESTIMONIALS = {"testimonials": {"selector": ".testimonial", "multiple": True, "fields": {"text": ".text"}}, "stars": {"selector": ".testimonial svg", "multiple": True}}


def pagination_links(links: DataFrame, part: str = "/products") -> DataFrame:
    """Links to further pages of a listing: no fragment, and ``part`` in them."""
    return links.where(~F.col("href").contains("#") & F.col("href").contains(part))


def hidden_data(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, inputs, state``: hidden inputs as a map and the JSON assigned to window.__DATA__."""
    inputs = F.transform(H.tags(H.visible(html), "input"), lambda t: F.struct(H.attribute(t, "name").alias("k"), H.attribute(t, "value").alias("v"), H.attribute(t, "type").alias("t")))
    hidden = F.filter(inputs, lambda s: (s["t"] == "hidden") & s["k"].isNotNull())
    last = F.filter(hidden, lambda s, i: ~F.exists(F.slice(hidden, i + 2, F.greatest(F.size(hidden), F.lit(1))), lambda q: q["k"] == s["k"]))
    state = F.try_parse_json(F.regexp_extract(F.col(html), r"(?s)window\.__DATA__\s*=\s*(\{.*?\});", 1))
    return pages.select("page_id", F.map_from_entries(F.transform(last, lambda s: F.struct(s["k"], s["v"]))).alias("inputs"), state.alias("state"))


def graphql_data(body: Column | str) -> Column:
    """The data member of a response, else the whole of it."""
    v = F.try_parse_json(F.col(body) if isinstance(body, str) else body)
    return F.coalesce(F.try_variant_get(v, "$.data", "variant"), v)

"""Link extraction: configured tags and attributes, selectors, hidden inputs, counts and resolution."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from ..functions import url as U
from ..functions.whatwg import whatwg_resolve

TAGS = ("a", "area", "form", "frame", "iframe", "link")
ATTRS = ("href", "action", "src")


def extract_links(pages: DataFrame, tags: Sequence[str] = TAGS, attrs: Sequence[str] = ATTRS, html: str = "html") -> DataFrame:
    """``page_id, url, tag, attr, ix, pos, href`` of every matched element, natively; href is null where the value is blank.

    Order of a page: (ix, pos): ix numbers the pairs of tag and attribute in configured order, pos the elements.
    """
    seen = pages.select("page_id", "url", H.visible(html).alias("__v"))
    per_tag = [F.transform(H.tags(F.col("__v"), t), lambda x, i: F.struct(F.lit(t).alias("tag"), F.lit(k).alias("t"), i.alias("pos"), x.alias("x"))) for k, t in enumerate(tags)]
    elements = seen.select("page_id", "url", F.explode(F.concat(*per_tag)).alias("e")).select("page_id", "url", "e.tag", "e.t", "e.pos", "e.x")
    values = F.array(*[F.struct(F.lit(a).alias("attr"), F.lit(k).alias("a"), H.attribute(F.col("x"), a).alias("v")) for k, a in enumerate(attrs)])
    rows = elements.select("page_id", "url", "tag", "t", "pos", F.explode(values).alias("v")).where("v.v IS NOT NULL")
    trimmed = F.trim("v.v")
    return rows.select("page_id", "url", "tag", F.col("v.attr").alias("attr"), (F.col("t") * len(attrs) + F.col("v.a")).alias("ix"), "pos", F.when(trimmed != "", trimmed).alias("href"))


def hidden_inputs(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, url, pos, name, href`` of hidden inputs whose name has url, redirect or next."""
    found = pages.select("page_id", "url", F.posexplode(H.tags(H.visible(html), "input")).alias("pos", "x"))
    named = found.select("page_id", "url", "pos", H.attribute(F.col("x"), "type").alias("type"), H.attribute(F.col("x"), "name").alias("name"), F.trim(H.attribute(F.col("x"), "value")).alias("href"))
    return named.where("type = 'hidden' AND href <> ''").where(F.lower("name").rlike("url|redirect|next")).drop("type")


def link_breakdown(links: DataFrame) -> DataFrame:
    """``page_id, tag, n, found``: matched elements and those with a value."""
    return links.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.count("href").alias("found"))


def extraction_result(links: DataFrame) -> DataFrame:
    """``page_id, links, processed, breakdown``: one row per page, values in configured then document order."""
    order = F.array_sort(F.collect_list(F.when(F.col("href").isNotNull(), F.struct("ix", "pos", "href"))))
    counts = links.groupBy("page_id", "tag").agg(F.count("href").cast("int").alias("n")).where("n > 0").groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("breakdown"))
    pages = links.groupBy("page_id").agg(F.transform(order, lambda s: s["href"]).alias("links"), F.count("*").cast("int").alias("processed"))
    return pages.join(counts, "page_id", "left")


_RESULT = T.StructType([
    T.StructField("links", T.ArrayType(T.StringType())), T.StructField("processed", T.IntegerType()), T.StructField("breakdown", T.MapType(T.StringType(), T.IntegerType())),
])


def extract_exact(html: Column | str, tags: Sequence[str] = TAGS, attrs: Sequence[str] = ATTRS, restrict_css: Sequence[str] = (), from_inputs: bool = False) -> Column:
    """struct(links, processed, breakdown) over the parsed tree. With selectors the tags don't count, and only values found are
    processed. Markup that can't be read gives no links."""
    for s in restrict_css:
        H.compile_selector(s)

    def one(text: str | None) -> tuple[list[str], int, dict[str, int]]:
        links: list[str] = []
        counts: dict[str, int] = {}
        processed = 0
        try:
            root = H.parse(text)
        except Exception:  # noqa: BLE001 - extraction degrades to an empty list
            return [], 0, {}
        elements = list(root.elements())
        if restrict_css:
            found = [(n, a) for s in restrict_css for n in H.select(root, s) for a in attrs if n.attrs.get(a, "").strip()]
            processed = len(found)
        else:
            matched = [(n, a) for t in tags for a in attrs for n in elements if n.tag == t and a in n.attrs]
            processed = len(matched)
            found = [(n, a) for n, a in matched if n.attrs[a].strip()]
        for n, a in found:
            links.append(n.attrs[a].strip())
            counts[n.tag] = counts.get(n.tag, 0) + 1
        if from_inputs:
            for n in elements:
                name = n.attrs.get("name", "").lower()
                if n.tag == "input" and n.attrs.get("type") == "hidden" and any(w in name for w in ("url", "redirect", "next")):
                    processed += 1
                    if n.attrs.get("value", "").strip():
                        links.append(n.attrs["value"].strip())
                        counts["input"] = counts.get("input", 0) + 1
        return links, processed, counts

    @F.pandas_udf(_RESULT)
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in column], columns=["links", "processed", "breakdown"]).astype({"processed": "int32"})

    return run(F.col(html) if isinstance(html, str) else html)


def resolve_links(links: DataFrame, exact: bool = False) -> DataFrame:
    """``links`` with abs_url; what can't be resolved is dropped."""
    resolved = whatwg_resolve(F.col("url"), F.col("href")) if exact else U.resolve_url("url", "href")
    return links.where("href IS NOT NULL").withColumn("abs_url", resolved).where("abs_url IS NOT NULL")

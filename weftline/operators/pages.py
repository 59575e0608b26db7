"""From stored responses to page rows: the content gate, title, meta map, validity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U
from ..functions.text import validate

COMMON_KEYS = ("description", "keywords", "author", "robots")


def is_parseable_content(content_type: Column | str) -> Column:
    """HTML, XHTML and any text pass, and so does an absent type."""
    c = F.coalesce(F.col(content_type) if isinstance(content_type, str) else content_type, F.lit(""))
    return (c == "") | c.contains("text/html") | c.contains("application/xhtml") | c.contains("text/")


def content_error(content_type: Column | str) -> Column:
    return F.when(~is_parseable_content(content_type), F.concat(F.lit("Unsupported content type: "), content_type))


def meta_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, pos, key, content``: a row for each meta tag with a key and content, natively."""
    found = pages.select("page_id", F.posexplode(H.tags(H.visible(html), "meta")).alias("pos", "tag"))
    blank = lambda c: F.when(c != "", c)
    key = F.coalesce(*[blank(H.attribute(F.col("tag"), a)) for a in ("name", "property", "http-equiv")])
    return found.select("page_id", "pos", key.alias("key"), H.attribute(F.col("tag"), "content").alias("content")).where("key IS NOT NULL AND content <> ''")


def meta_map(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, metadata``: the last of equal keys wins."""
    last = meta_rows(pages, html).groupBy("page_id", "key").agg(F.max_by("content", "pos").alias("content"))
    return last.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "content")))).alias("metadata"))


def common_metadata(metadata: Column | str) -> Column:
    """The four common keys as a struct; null if all are missing."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    values = [F.try_element_at(m, F.lit(k)) for k in COMMON_KEYS]
    return F.when(F.coalesce(*values).isNotNull(), F.struct(*[v.alias(k) for k, v in zip(COMMON_KEYS, values)]))


_PAGE = "title string, metadata map<string,string>"


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the markup, with title, metadata and common_metadata: one parse per page, one stage, no shuffle."""

    @F.pandas_udf(_PAGE)
    def read(column: pd.Series) -> pd.DataFrame:
        titles, metas = [], []
        for text in column:
            root = H.parse(text)
            titles.append("".join(n.text() for n in root.elements() if n.tag == "title") or None)
            m: dict[str, str] = {}
            for n in root.elements():
                if n.tag == "meta":
                    key = n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("http-equiv")
                    if key and n.attrs.get("content"):
                        m[key] = n.attrs["content"]
            metas.append(m)
        return pd.DataFrame({"title": titles, "metadata": metas})

    kept = [c for c in pages.columns if c not in (html, "title", "metadata", "common_metadata")]
    done = pages.select(*kept, read(F.col(html)).alias("__page"))
    return done.select(*kept, F.col("__page.title").alias("title"), F.col("__page.metadata").alias("metadata"), common_metadata(F.col("__page.metadata")).alias("common_metadata"))


def page_errors(url: Column | str = "url", html: Column | str = "html", status: Column | str = "status", duration_ms: Column | str = "duration_ms", depth: Column | str = "depth") -> Column:
    """What is wrong with a page row, as an array of messages; empty if it is valid."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return validate({
        "url must be an absolute URL": U.is_valid(url) | U.is_absolute(url), "html must be a string": c(html).isNotNull(), "status must be between 100 and 599": c(status).between(100, 599),
        "duration must be a number": ~F.isnan(c(duration_ms).cast("double")), "depth must be 0 or more": c(depth) >= 0,
    })


def split_valid(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their errors)."""
    checked = pages.withColumn("errors", page_errors())
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)

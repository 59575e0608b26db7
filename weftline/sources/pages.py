"""Stored responses as a Spark data source, and the choice of a page source per request."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_SCHEMA = "url string, status int, headers map<string,string>, body string"


class StoredPages(DataSource):
    """``spark.read.format("stored_pages").load(folder)``: JSON-lines files of recorded responses, one partition per range of a file.

    Fetching from the network isn't part of it. All statuses are rows, 4xx and 5xx too. Options: ``split_bytes`` (32 MiB).
    """

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> "_Reader":
        return _Reader(self.options)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.folder = options.get("path", "").removeprefix("file://")
        self.split = int(options.get("split_bytes", 32 << 20))

    def partitions(self) -> list[_Range]:
        out = []
        for path in sorted(glob.glob(os.path.join(self.folder, "**", "*.jsonl"), recursive=True)):
            size = os.path.getsize(path)
            out += [_Range(path, s, min(size, s + self.split)) for s in range(0, size, self.split)]
        return out

    def read(self, partition: _Range):
        """The lines that start in the range."""
        with open(partition.path, "rb") as f:
            if partition.start:
                f.seek(partition.start - 1)
                f.readline()
            while f.tell() < partition.end:
                line = f.readline()
                if line.strip():
                    x = json.loads(line)
                    headers = {k.lower(): "\n".join(v) if isinstance(v, list) else v for k, v in (x.get("headers") or {}).items()}
                    yield x.get("url"), x.get("status"), headers, x.get("body")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoredPages)


Source = Callable[[SparkSession], DataFrame]


def resolve_source(configured: object, request: Mapping[str, object], default: Source) -> Source:
    """None gives the default, a source itself, and a selector (marked by ``selects``) is asked; what is invalid or raises gives a source
    without rows, whose URLs a crawl then counts as errors of kind ``other``."""
    try:
        found = configured(request) if getattr(configured, "selects", False) else configured
    except Exception:  # noqa: BLE001 - a selector's failure is a failed source
        return no_pages
    if found is None:
        return default
    return found if callable(found) else no_pages


def selector(f: Callable[[Mapping[str, object]], Source | None]) -> Callable:
    f.selects = True
    return f


def no_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PAGE_SCHEMA)

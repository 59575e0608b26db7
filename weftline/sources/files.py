"""Files as tables (text, bytes, JSON, listings) and the driver-side file operations."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, value``: one row per file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_bytes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path, modificationTime, length, content``"""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path)


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path, modificationTime, length``: contents aren't read."""
    return read_bytes(spark, path, pattern).select("path", "modificationTime", "length")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that don't fit the schema have it in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("tag").parquet(path)


def read_text(path: str, default: str | None = None) -> str | None:
    p = Path(path)
    return p.read_text(encoding="utf-8") if p.is_file() or default is None else default


def write_text(path: str, text: str, append: bool = False) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a" if append else "w", encoding="utf-8") as f:
        f.write(text)


def load_json(path: str, default: Any = None) -> Any:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        if default is None:
            raise
        return default


def save_json(path: str, value: Any, indent: int | None = 2) -> None:
    write_text(path, json.dumps(value, indent=indent, ensure_ascii=False))


def exists(path: str) -> bool:
    return os.path.exists(path)


def stat(path: str) -> dict[str, Any]:
    s = os.stat(path)
    return {"size": s.st_size, "is_file": os.path.isfile(path), "is_directory": os.path.isdir(path), "modified": s.st_mtime}


def copy(a: str, b: str) -> None:
    shutil.copytree(a, b, dirs_exist_ok=True) if os.path.isdir(a) else shutil.copy2(a, b)


def move(a: str, b: str) -> None:
    shutil.move(a, b)


def delete(path: str) -> None:
    shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)


def make_directory(path: str) -> None:
    os.makedirs(path, exist_ok=True)


def names(path: str) -> list[str]:
    return sorted(os.listdir(path))


def walk(path: str) -> list[str]:
    return sorted(str(p) for p in Path(path).rglob("*") if p.is_file())


def temp_file(suffix: str = "") -> str:
    fd, path = tempfile.mkstemp(suffix=suffix)
    os.close(fd)
    return path

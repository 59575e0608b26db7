"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # glibc: blocks of 2 MB and more go back to the system when freed, so a worker that is reused doesn't keep its peak
    ctypes.CDLL("libc.so.6").mallopt(-3, 2 << 20)
except (OSError, AttributeError):
    pass

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary
    folder, and a cluster an error, since a folder of one machine is of no use to its executors."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later steps neither recompute it nor depend on live executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: for wide rows, which checkpoints don't compress."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Rows hold whole texts, so what one Arrow batch may hold is set in bytes, not in rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are slots. Small tables come as one file and one task; large ones are left alone."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def named(column: str) -> Column:
    """A column by its exact name, dots and backquotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def given(df: DataFrame, *taken: str) -> list[Column]:
    """All columns of ``df`` by exact name, without those that an operator's own result columns replace."""
    return [named(c) for c in df.columns if c not in taken]


def hidden(stem: str) -> str:
    """A column name that no input has."""
    return f"__{stem}_{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` (materialised, a few longs a row) as a broadcast side if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """These columns of a table (all if none is named), with batches bounded for whole texts."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns)) if columns else df


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and the n+1 offsets of the texts in it (null counts as empty).

    Lone surrogates can't be in a Spark string, so UTF-32 always encodes.
    """
    parts = [t or "" for t in texts]
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4"), ends


def text_batches(texts: list[str | None], limit: int = 1_500_000):
    """Ranges of the list whose texts hold about ``limit`` characters at most (one longer text stands alone)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (splitmix64's finaliser), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

"""Crawl state on storage: deltas and snapshots as partitioned files, or in a relational database over JDBC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import compact, latest_snapshot

DELTA_SCHEMA = "session_id string, sequence long, ts timestamp, op string, fingerprint string, request string"
SNAPSHOT_SCHEMA = "session_id string, sequence long, ts timestamp, pending array<string>, visited array<string>, total_processed long"


@dataclass(frozen=True)
class FileStateStore:
    """``base/deltas`` and ``base/snapshots``, partitioned by session. Appends may repeat a (session, sequence): the first counts."""

    spark: SparkSession
    base: str
    format: str = "parquet"

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").partitionBy("session_id").format(self.format).save(f"{self.base}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).format(self.format).load(f"{self.base}/{name}") if there else self.spark.createDataFrame([], schema)

    def save_deltas(self, rows: DataFrame) -> None:
        self._append(rows, "deltas")

    def save_snapshot(self, rows: DataFrame) -> None:
        self._append(rows, "snapshots")

    def deltas(self, since: int | None = None, until: int | None = None) -> DataFrame:
        d = self._read("deltas", DELTA_SCHEMA)
        if since is not None:
            d = d.where(F.col("sequence") > since)
        if until is not None:
            d = d.where(F.col("sequence") <= until)
        return d.dropDuplicates(["session_id", "sequence"])

    def snapshots(self) -> DataFrame:
        return self._read("snapshots", SNAPSHOT_SCHEMA)

    def latest(self) -> DataFrame:
        return latest_snapshot(self.snapshots())

    def compact(self) -> None:
        """Writes the deltas that are still needed to a new folder and puts it in place of the old one."""
        compact(self.deltas(), self.snapshots()).write.mode("overwrite").partitionBy("session_id").format(self.format).save(f"{self.base}/deltas.new")
        jvm = self.spark.sparkContext._jvm
        new, old = (jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}") for n in ("deltas.new", "deltas"))
        fs = new.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(new, old)

    def delete(self, session_id: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in ("deltas", "snapshots"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}/session_id={session_id}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class JdbcStateStore:
    """The same over JDBC; the driver's jar must be on the class path. Ranges of sequences are read in parallel."""

    spark: SparkSession
    url: str
    properties: dict[str, str]
    prefix: str = "crawl_"

    def _reader(self, table: str):
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=f"{self.prefix}{table}", **self.properties)

    def deltas(self, since: int | None = None) -> DataFrame:
        d = self._reader("deltas").load()
        return d if since is None else d.where(F.col("sequence") > since)

    def snapshots(self) -> DataFrame:
        return self._reader("snapshots").load()

    def save(self, rows: DataFrame, table: str) -> None:
        """Insert and ignore what is there: rows whose key is stored already are left out first."""
        keys = ["session_id", "sequence"]
        new = rows.dropDuplicates(keys).join(self._reader(table).load().select(*keys), keys, "left_anti")
        new.write.format("jdbc").mode("append").options(url=self.url, dbtable=f"{self.prefix}{table}", **self.properties).save()

"""Folders published together: a ledger names the folders that make up a set of tables, and a new version replaces the old at once.

Writers put new folders beside the old ones and then publish the next version, a small file that is renamed into place. Readers
take the newest version, so they see all folders of a run or none, and a run that fails on its way leaves the last version as it
was. Two writers can't publish the same version: the second one's rename fails. (The file system must rename one file atomically,
as HDFS and local ones do.)
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version, 0 where nothing is published."""
        place = self._path(f"{self.base}/_ledger")
        names = [f.getPath().getName() for f in self._fs.listStatus(place)] if self._fs.exists(place) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def read(self) -> dict:
        """What the newest version says, empty where nothing is published."""
        n = self.version()
        if not n:
            return {}
        found = self._fs.open(self._path(f"{self.base}/_ledger/{n:012d}.json"))
        try:
            return json.loads(bytes(found.readAllBytes()).decode())
        finally:
            found.close()

    def publish(self, entry: dict, after: int) -> int:
        """Make `entry` the version that follows `after`; RuntimeError if another writer was faster."""
        new, last = self._path(f"{self.base}/_ledger/.{uuid.uuid4().hex}"), self._path(f"{self.base}/_ledger/{after + 1:012d}.json")
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if self._fs.exists(last) or not self._fs.rename(new, last):
            self._fs.delete(new, False)
            raise RuntimeError(f"version {after + 1} of {self.base} is taken")
        return after + 1

    def write(self, df: DataFrame, name: str, by: str | None = None) -> str:
        """Write a new folder, which no reader sees before it is published; its name in the ledger."""
        folder = f"{name}/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.base}/{folder}")
        return folder

    def open(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{folder}")

    def forget(self, folders: list[str]) -> None:
        """Delete folders that no version in use names."""
        for f in folders:
            self._fs.delete(self._path(f"{self.base}/{f}"), True)


def write_day(spark: SparkSession, base: str, date: str, tables: dict[str, DataFrame]) -> int:
    """SNK3: all tables of a day, visible together; a day that is written again is replaced as a whole, other days stay."""
    ledger = Ledger(spark, base)
    version, entry = ledger.version(), ledger.read()
    made = {name: ledger.write(df, name) for name, df in tables.items()}
    return ledger.publish({"days": {**entry.get("days", {}), date: made}}, version)


def read_day(spark: SparkSession, base: str, date: str) -> dict[str, DataFrame]:
    """The tables of a day as last published, none if it never was."""
    ledger = Ledger(spark, base)
    return {name: ledger.open(folder) for name, folder in ledger.read().get("days", {}).get(date, {}).items()}

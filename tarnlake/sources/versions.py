"""Tables in buckets that are replaced one by one: a version is a small file that names the folder of every bucket.

A change writes new folders for the buckets it touches, and then one file that takes them over beside the folders that stay.
That file appears by a rename, whole or not at all, so readers see the version before or the one after, and folders of a
change that didn't come to its end are never read. Two writers of one version: the later rename fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer made the version first."""


class Versions:
    """The versions of some tables below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def latest(self) -> int:
        """The number of the last version; 0 if there is none."""
        if not self._fs.exists(self._at("versions")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("versions"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def read(self, number: int) -> dict:
        """{"buckets": {bucket: {"tables": {table: folder}, ...}}, "schemas": {table: ...}, "about": {...}} of a version."""
        if not number:
            return {"buckets": {}, "schemas": {}, "about": {}}
        stream = self._fs.open(self._at(f"versions/{number}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, number: int, name: str, buckets: Iterable[int] | None = None, *, dated: bool = False) -> DataFrame:
        """A table as of a version, all of it or the folders of some buckets, with its `bucket`; if dated, with the `version` that wrote each row as well."""
        v = self.read(number)
        wanted = None if buckets is None else {str(b) for b in buckets}
        # several buckets may lie in one folder
        paths = list(dict.fromkeys(f"{self.path}/{b['tables'][name]}" for k, b in v["buckets"].items() if name in b["tables"] and (wanted is None or k in wanted)))
        schema = StructType.fromJson(v["schemas"][name])
        if not paths:
            return self.spark.createDataFrame([], schema.add("version", "integer") if dated else schema)
        columns = [f.name for f in schema.fields] + ["version"] * dated
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths).select(*columns)

    def write(self, number: int, name: str, rows: DataFrame) -> tuple[dict[str, str], dict]:
        """Writes rows (bucket, ...) as what a version will hold of its buckets; the folder of each bucket with rows, and the schema. Nothing reads them yet."""
        # an attempt that failed may have left files under the same number
        folder = f"{name}/version={number}"
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        held = [s.getPath().getName() for s in self._fs.listStatus(self._at(folder)) if s.isDirectory()]
        return {n[7:]: f"{folder}/{n}" for n in held if n.startswith("bucket=")}, json.loads(rows.schema.json())

    @contextmanager
    def aside(self, rows: DataFrame) -> Iterator[DataFrame]:
        """Rows that are written once and read again, for as long as the block lasts; no version names their folder."""
        name = f"aside/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.path}/{name}")
            yield self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")
        finally:
            self._fs.delete(self._at(name), True)

    def commit(self, number: int, version: dict) -> None:
        """Makes a version readable, all at once."""
        made, name = self._at(f"versions/.{number}-{id(version)}"), self._at(f"versions/{number}.json")
        if self._fs.exists(name):
            raise Conflict(f"version {number} is there")
        stream = self._fs.create(made, True)
        try:
            stream.write(bytearray(json.dumps(version).encode()))
        finally:
            stream.close()
        if not self._fs.rename(made, name):
            self._fs.delete(made, False)
            raise Conflict(f"version {number} is there")

    def forget(self, number: int) -> None:
        """Deletes a version and the folders that only it names, of it and the two after it."""
        if number < 1 or not self._fs.exists(self._at(f"versions/{number}.json")):
            return
        named = lambda n: {f for b in self.read(n)["buckets"].values() for f in b["tables"].values()}
        kept = set().union(*(named(n) for n in (number + 1, number + 2) if self._fs.exists(self._at(f"versions/{n}.json"))))
        for folder in named(number) - kept:
            self._fs.delete(self._at(folder), True)
        self._fs.delete(self._at(f"versions/{number}.json"), False)

"""A table of the latest row per key, in hash buckets, of which a batch rewrites only those it touches.

``<path>/manifests/<n>.json`` names, for version n, the folder of every bucket that has rows. A commit writes new folders for the touched buckets
and then gives its manifest its name, which no two writers can do for one n; a reader takes the manifest with the
largest number and reads just the folders it names, so it sees one version whatever is being written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sinks import latest


class KeyedTable:
    """``version`` columns decide which row of a key is the latest. ``buckets`` is fixed when the table is made; a manifest has at most as many entries.
    The last ``keep`` versions stay readable; folders that only older ones name are deleted after a commit."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str], buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.keys, self.version, self.buckets, self.keep = spark, path, list(keys), list(version), buckets, keep
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, self._context = hadoop.Path, hadoop.FileContext
        self.files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self.files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self.files.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def _manifest(self, number: int | None) -> dict | None:
        if number is None:
            return None
        source = self.files.open(self._path(f"{self.path}/manifests/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def latest_version(self) -> int | None:
        return max(self._numbers(), default=None)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, or of the newest."""
        told = self._manifest(self.latest_version() if number is None else number)
        if told is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._rows(told, told["buckets"].values())

    def _rows(self, told: dict, folders) -> DataFrame:
        schema = StructType.fromJson(told["schema"])
        folders = [f"{self.path}/data/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def merge(self, updates: DataFrame, epoch: int | None = None) -> int:
        """Merge rows and give the version that has them. A batch whose ``epoch`` the newest version has already seen, or that is empty, changes nothing.
        Null keys are keys like any other."""
        number = self.latest_version()
        told = self._manifest(number) or {"epoch": -1, "buckets": {}, "schema": updates.schema.jsonValue(), "of": self.buckets}
        if number is not None and epoch is not None and epoch <= told["epoch"]:
            return number
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(told["of"])).cast("int")
        new = updates.withColumn("__bucket", bucket)
        touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())  # at most as many as buckets
        if number is not None and not touched:
            return number
        held = self._rows(told, [told["buckets"][str(b)] for b in touched if str(b) in told["buckets"]])
        commit = uuid.uuid4().hex
        merged = latest(held.unionByName(updates.select(*held.columns)), self.keys, self.version).withColumn("__bucket", bucket)
        merged.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{commit}")
        told["buckets"] = told["buckets"] | {str(b): f"{commit}/__bucket={b}" for b in touched}
        told["epoch"] = told["epoch"] if epoch is None else epoch
        return self._commit(0 if number is None else number + 1, told)

    def _commit(self, number: int, told: dict) -> int:
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        out = self.files.create(draft)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        self.files.mkdirs(self._path(f"{self.path}/manifests"))
        name = self._path(f"{self.path}/manifests/{number:012d}.json")
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(rename, 0)  # no overwriting: of two writers of one number the second fails
        self._context.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(
            self.files.makeQualified(draft), self.files.makeQualified(name), none)
        self._clean()
        return number

    def _clean(self) -> None:
        """Delete what only versions before the last ``keep`` name."""
        numbers = self._numbers()
        kept = {f for n in numbers[-self.keep:] for f in self._manifest(n)["buckets"].values()}
        for n in numbers[:-self.keep]:
            for folder in set(self._manifest(n)["buckets"].values()) - kept:
                self.files.delete(self._path(f"{self.path}/data/{folder}"), True)
            self.files.delete(self._path(f"{self.path}/manifests/{n:012d}.json"), False)

"""Tables that outlive the driver: numbered versions in a folder, each told by a manifest that appears in one piece."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 32
_MANIFEST = "name string, bucket int, path string"


class Versions:
    """Keyed tables under one folder that change together.

    A version is a manifest: for each table and bucket of keys, the folder with its rows. A new version writes the buckets that change and
    names the others where they are. The manifest is written beside and renamed into place, so readers, and a driver that starts anew,
    see the version before or the whole new one. A version that exists is never written again: a batch that runs twice counts once.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))

    def numbers(self) -> list[int]:
        """Whole versions, ascending."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return sorted(int(n.removeprefix("v")) for n in names if n.startswith("v"))

    def _parts(self, version: int | None) -> dict[tuple[str, int], str]:
        if version is None:
            return {}
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.folder}/manifests/v{version}").collect()  # tables x buckets
        return {(r["name"], r["bucket"]): r["path"] for r in rows if r["bucket"] >= 0}

    def read(self, name: str, schema: StructType, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A table as of a version (the last one), or some of its buckets."""
        have = self.numbers()
        version = version if version is not None else (have[-1] if have else None)
        paths = [f"{self.folder}/{p}" for (n, b), p in self._parts(version).items() if n == name and (only is None or b in only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def advance(self, version: int, changes: dict[str, tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]]) -> bool:
        """Make a version from the last one before it: for each table (new rows, keys, merge), where merge() makes one row a key of old and new
        rows. False if the version is there already."""
        have = self.numbers()
        if version in have:
            return False
        before = [v for v in have if v < version]
        parts = self._parts(before[-1] if before else None)
        for name, (rows, keys, merge) in changes.items():
            bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
            rows = rows.persist()
            try:
                changed = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())  # buckets at most
                if not changed:
                    continue
                old = self.read(name, rows.schema, before[-1], changed) if before else None
                merged = merge(rows if old is None else old.unionByName(rows)).select(*rows.columns)
                path = f"parts/{name}-{version}-{uuid.uuid4().hex}"
                merged.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{path}")
            finally:
                rows.unpersist()
            parts |= {(name, b): f"{path}/__bucket={b}" for b in changed}
        self._publish(version, parts)
        return True

    def replace(self, version: int, name: str, rows: DataFrame) -> bool:
        """Make a version in which a table holds these rows and nothing else."""
        if version in self.numbers():
            return False
        path = f"parts/{name}-{version}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{path}")
        self._publish(version, {(name, 0): path})
        return True

    def _publish(self, version: int, parts: dict[tuple[str, int], str]) -> None:
        beside, to = f"{self.folder}/beside/{uuid.uuid4().hex}", f"{self.folder}/manifests/v{version}"
        rows = [(n, b, p) for (n, b), p in sorted(parts.items())] or [("", -1, "")]
        self._fs.mkdirs(self._path(f"{self.folder}/beside"))
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(beside)
        if not self._fs.rename(self._path(beside), self._path(to)):
            raise OSError(f"cannot put {to} in place")

    def prune(self, keep: int = 2) -> None:
        """Drop all but the last versions, and parts that none of those names."""
        have = self.numbers()
        for v in have[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/manifests/v{v}"), True)
        used = {p.split("/")[1] for v in have[-keep:] for p in self._parts(v).values()}
        root = self._path(f"{self.folder}/parts")
        for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)

"""Vector stores, audit logs and saved indexes. A store is a Parquet folder; an upsert writes a new version beside the old one."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.retrieval import cosine_search

ITEM = "id string, vector array<double>, text string, metadata map<string,string>"


def upsert(items: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """items without those of the new keys, and the new ones; of equal new keys one stays."""
    return items.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]))


class MemoryVectorStore:
    def __init__(self, spark: SparkSession):
        self.items = spark.createDataFrame([], ITEM)

    def upsert(self, new: DataFrame):
        self.items = upsert(self.items, new)
        return self

    def search(self, query: list[float], k: int = 5, filters: dict | None = None) -> DataFrame:
        return cosine_search(self.items, query, k, filters)

    def export_items(self) -> DataFrame:
        return self.items

    def import_items(self, items: DataFrame):
        self.items = items
        return self


class FolderVectorStore(MemoryVectorStore):
    """Versions as folders of Parquet (or JSON); a pointer file names the current one, so a reader never sees half a write."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet"):
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt
        versions = self._versions()
        self.items = self._read(versions[-1]) if versions else spark.createDataFrame([], ITEM)

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[str]:
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in names if n.startswith("v") and fs.exists(done(f"{self.path}/{n}/_SUCCESS")))

    def _read(self, version: str) -> DataFrame:
        return self.spark.read.schema(ITEM).format(self.fmt).load(f"{self.path}/{version}")

    def upsert(self, new: DataFrame):
        version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        upsert(self.items, new.select("id", "vector", "text", "metadata")).write.format(self.fmt).save(f"{self.path}/{version}")
        self.items = self._read(version)
        return self


def save_index(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_audit(path: str, event: dict) -> None:
    """One JSON line at the end of a file, under a lock."""
    import fcntl

    with open(path, "a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.write(json.dumps(event, default=str) + "\n")

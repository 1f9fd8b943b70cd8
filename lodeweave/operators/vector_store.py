"""Where embeddings are kept: one interface, and a store over Parquet folders.

A store holds one collection of chunk rows (id, vector, asset_id, asset_version, ...)
for each asset type. The engine and the ingest only use the interface, so
another store takes its place by implementing it over DataFrames.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import search, store


class VectorStore(ABC):
    """Collections of chunk rows by asset type."""

    @abstractmethod
    def exists(self, asset_type: str) -> bool: ...

    @abstractmethod
    def read(self, asset_type: str, condition: Column | None = None) -> DataFrame:
        """The rows of a collection; no rows where there is none."""

    @abstractmethod
    def replace(self, asset_type: str, rows: DataFrame) -> None:
        """The collection anew."""

    def upsert(self, asset_type: str, rows: DataFrame) -> None:
        """Rows take the place of those of the same id."""
        self.replace(asset_type, store.upsert(self.read(asset_type), rows.dropDuplicates(["id"])))

    def remove(self, asset_type: str, asset_ids: DataFrame) -> DataFrame:
        """(asset_id, last_version, chunks) of what went; ids without chunks give no row."""
        before = self.read(asset_type)
        kept, gone = store.delete(before, asset_ids)
        report = gone.toArrow()  # one row for each removed asset, before its rows go
        self.replace(asset_type, kept)
        return before.sparkSession.createDataFrame(report)

    def asset_ids(self, asset_type: str) -> DataFrame:
        return self.read(asset_type).select("asset_id").where("asset_id is not null").distinct()

    def vectors(self, asset_type: str, asset_ids: DataFrame) -> DataFrame:
        """(asset_id, id, vector) of the given assets."""
        return self.read(asset_type).join(asset_ids.select("asset_id").distinct(), "asset_id", "left_semi").select("asset_id", "id", "vector")

    def top_assets(self, asset_type: str, queries: DataFrame, k: int, condition: Column | None = None, dim: int = 64) -> DataFrame:
        """(query_id, rank, asset_id, distance) of (query_id, vector), best chunk of each asset."""
        return search.grouped_top_k(queries, search.usable_chunks(self.read(asset_type, condition), dim), k)


class ParquetStore(VectorStore):
    """Collections as versioned Parquet folders below ``path``; readers take the last version that is whole."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "id long, vector array<float>, asset_id string, asset_version long, asset_type string") -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self, asset_type: str) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{asset_type}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        whole = lambda n: files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{asset_type}/{n}/_SUCCESS"))
        return sorted(int(n[1:]) for n in names if n[0] == "v" and whole(n))

    def exists(self, asset_type: str) -> bool:
        return bool(self._versions(asset_type))

    def read(self, asset_type: str, condition: Column | None = None) -> DataFrame:
        versions = self._versions(asset_type)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{asset_type}/v{versions[-1]}") if versions else self.spark.createDataFrame([], self.schema)
        return rows if condition is None else rows.where(condition)

    def replace(self, asset_type: str, rows: DataFrame) -> None:
        number = (self._versions(asset_type) or [0])[-1] + 1
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("overwrite").parquet(f"{self.path}/{asset_type}/v{number}")

"""Sinks: chunk tables, JSON exports, result caches, versioned directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.text import tokens, windows

#: Folders of a sink by key, whatever the number of keys.
BUCKETS = 64


def chunk_rows(documents: DataFrame, text: Column, embed, size: int = 512, overlap: float = 0.25, cap: int = 11) -> DataFrame:
    """Documents to chunk rows with vectors; their other columns go with every chunk. Empty documents give none."""
    keep = [c for c in documents.columns if c not in ("chunk_no", "chunk", "vector")]
    cut = documents.withColumn("_t", tokens(text)).where(F.size("_t") > 0)
    out = cut.select(*keep, F.posexplode(windows(F.col("_t"), size, overlap, cap)).alias("chunk_no", "_c"))
    return out.select(*keep, "chunk_no", F.array_join("_c", " ").alias("chunk")).withColumn("vector", embed(F.col("chunk")))


def write_chunks(chunks: DataFrame, path: str, by: str = "asset_type") -> None:
    """Append chunks, a folder per asset type, so that a search of one type reads no other."""
    chunks.write.mode("append").partitionBy(by).parquet(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines; with ``by`` (a result cache by query) the rows of a value stand in one of ``BUCKETS`` folders, the value in the row."""
    if by is None:
        df.write.mode("overwrite").json(path)
    else:
        _bucketed(df, by).write.mode("overwrite").partitionBy("bucket").json(path)


def _bucketed(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(BUCKETS)).cast("int")).repartition("bucket", by)


def read_cached(spark: SparkSession, path: str, schema: str, wanted: DataFrame, key: str = "query_id") -> DataFrame:
    """A result cache, or LookupError when any wanted query is missing from it."""
    cached = spark.read.schema(schema).json(path)
    missing = wanted.select(key).distinct().join(cached.select(key).distinct(), key, "left_anti").limit(5).collect()
    if missing:
        raise LookupError(f"not cached: {[r[0] for r in missing]}")
    return cached


def with_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as a JSON text, null fields left out."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))


def write_texts(df: DataFrame, key: str, text: Column, path: str) -> None:
    """Texts as JSON lines (key, value) in ``BUCKETS`` folders, for tools that read files; null texts are left out."""
    write_json(df.select(F.col(key), text.alias("value")).where("value is not null"), path, key)


def parse_checked(texts: DataFrame, column: str, schema: str, required: list[str]) -> DataFrame:
    """The frame with ``parsed`` (null where the text is not of the schema) and ``ok`` (all required fields are there)."""
    parsed = texts.withColumn("parsed", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    ok = F.lit(True)
    for name in required:
        ok = ok & F.col(f"parsed.{name}").isNotNull()
    return parsed.withColumn("ok", F.coalesce(ok, F.lit(False)))


def swap(df: DataFrame, base: str, number: int) -> str:
    """Write the next version of a table beside the last; readers take the highest. Returns its path."""
    path = f"{base}/version={number}"
    df.write.mode("overwrite").parquet(path)
    return path

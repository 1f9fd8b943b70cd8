"""Versioned storage over plain Parquet: insert with fallback, upsert, delete, bulk load, queues.

Plain Parquet has no atomic merge, so a change is a new table: what stays
(anti-join) united with what is new. Writers put it into a new directory and swap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.runtime import cut_lineage
from lodeweave.schema import Registry


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order`` (deterministic, unlike dropping duplicates)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def delete(stored: DataFrame, ids: DataFrame, key: str = "asset_id") -> tuple[DataFrame, DataFrame]:
    """(what stays, (key, last version, chunks) of what goes)."""
    gone = ids.select(key).where(F.col(key).isNotNull()).distinct()
    removed = stored.join(gone, key, "left_semi").groupBy(key).agg(F.max("asset_version").alias("last_version"), F.count("*").alias("chunks"))
    return stored.join(gone, key, "left_anti"), removed


def upsert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of the same key; applying it twice changes nothing."""
    kept = stored.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def next_versions(stored: DataFrame, changed: DataFrame, key: str = "asset_id") -> DataFrame:
    """(key, version): one above the asset's highest stored version, 0 for a new asset."""
    have = stored.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("asset_version").alias("_v"))
    return changed.select(key).distinct().join(have, key, "left").select(key, (F.coalesce("_v", F.lit(-1).cast("long")) + 1).alias("version"))


def with_fallback(rows: DataFrame, registry: Registry, required: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows refused): metadata that breaks a bound is set to null as a whole, a row that misses its core is refused.

    The same outcome as inserting row by row and retrying without metadata, decided up front.
    """
    fields = [f for f in registry.fields.values() if f.name in rows.columns]
    fits = reduce(lambda a, b: a & b, [f.valid(F.col(f.name)) for f in fields], F.lit(True))
    core = F.coalesce(required, F.lit(False))
    checked = rows.withColumn("_fits", fits)
    clean = checked.where(core).withColumns({f.name: F.when(F.col("_fits"), F.col(f.name)) for f in fields}).withColumn("metadata_kept", F.col("_fits")).drop("_fits")
    return clean, rows.where(~core)


def override_columns(stored: DataFrame, update: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Stored rows with the update's non-null values, where the keys (id and version) agree; others stay as they are."""
    u = update.dropDuplicates(keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = stored.join(u, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def bulk_pairs(pages: DataFrame) -> DataFrame:
    """(page, pos, asset_id, vector) of pages that hold as many ids as vectors; others are skipped whole.

    ``pages`` is (page, asset_ids, vectors). Loaded chunks have version 0.
    """
    whole = pages.where(F.col("asset_ids").isNotNull() & F.col("vectors").isNotNull() & (F.size("asset_ids") == F.size("vectors")))
    zipped = whole.select("page", F.posexplode(F.arrays_zip("asset_ids", "vectors")).alias("pos", "_z"))
    return zipped.select("page", "pos", F.col("_z.asset_ids").alias("asset_id"), F.col("_z.vectors").alias("vector"), F.lit(0).cast("long").alias("asset_version"))


def fifo(queue: DataFrame, size: int, order: str = "created_at", tie: str = "asset_id") -> DataFrame:
    """The oldest ``size`` entries of a queue: sort and limit in one step."""
    return queue.orderBy(order, tie).limit(size)


def pages(df: DataFrame, order: list[str], window: int, overlap: float = 0.0) -> DataFrame:
    """Rows with the pages they are on, when each page starts ``int(window * (1 - overlap))`` after the last.

    Positions come from a range-sorted running number: counts per range
    partition are summed first, so no task sees more than its partition.
    """
    step = int(window * (1 - overlap))
    if step < 1:
        raise ValueError("pages must move on")
    numbered = number_rows(df, order)
    first = F.greatest(F.ceil((F.col("row_no") - window + 1) / F.lit(step)), F.lit(0)).cast("long")
    return numbered.withColumn("page", F.explode(F.sequence(first, F.floor(F.col("row_no") / step).cast("long"))))


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``row_no`` from 0 in the given order, without a one-task window.

    The range-sorted rows are written out once: the bounds of the ranges come
    from a sample, so counting and numbering must read the very same ranges.
    Rows equal in all order columns are numbered in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Range in the upper bits, place within it in the lower 33.
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    starts = sizes.select("_part", before.alias("_start"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn("row_no", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_start")


def number_within(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rows with ``place`` from 0 within each ``by``, without sorting a key's rows in one task."""
    numbered = number_rows(df.where(F.col(by).isNotNull()), [by, *order])
    first = numbered.groupBy(by).agg(F.min("row_no").alias("_first"))
    return numbered.join(first, by).withColumn("place", F.col("row_no") - F.col("_first")).drop("row_no", "_first")


def page_completeness(df: DataFrame, order: list[str], window: int) -> DataFrame:
    """(page, rows, complete) of a download in windows; only the last may be short."""
    on = pages(df, order, window)
    counted = on.groupBy("page").agg(F.count("*").alias("rows"))
    return counted.withColumn("complete", F.col("rows") == window)


class Documents:
    """A document table with the calls of a document store; every change gives a new table of the same shape."""

    def __init__(self, rows: DataFrame, key: str = "id") -> None:
        self.rows, self.key = rows, key

    def find(self, condition: Column, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
        out = self.rows.where(condition)
        out = out.orderBy(*order) if order else out
        return out if limit is None else out.limit(limit)

    def get(self, value) -> DataFrame:
        """The row of a key, or no row."""
        return self.find(F.col(self.key) == value, limit=1)

    def create(self, new: DataFrame) -> Documents:
        """Rows whose keys are not there yet are added; the others are left as they are."""
        fresh = new.dropDuplicates([self.key]).join(self.rows.select(self.key), self.key, "left_anti")
        return Documents(self.rows.unionByName(fresh), self.key)

    def replace(self, new: DataFrame) -> Documents:
        return Documents(upsert(self.rows, new.dropDuplicates([self.key]), self.key), self.key)

    def delete(self, condition: Column) -> Documents:
        """Rows for which the condition holds go; where it is null they stay."""
        return Documents(self.rows.where(~F.coalesce(condition, F.lit(False))), self.key)

"""Streams over the catalogue's tables, run until what is there has been read.

Each runs with the available-now trigger and a checkpoint in the shared folder,
so a scheduler can start it again and it goes on from where it ended.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeweave import runtime
from lodeweave.operators.lifecycle import status_of
from lodeweave.operators.store import latest


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one."""
    return f"{runtime.shared_folder(spark).rstrip('/')}/streams-{uuid.uuid4().hex}"


def source(spark: SparkSession, directory: str, name: str, files: int = 4) -> DataFrame:
    """Stream of a table's files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{directory}/{name}.parquet*")


def _finish(writer, folder: str) -> None:
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def deduplicated(spark: SparkSession, directory: str, name: str, key: str, at: str, lateness: str) -> DataFrame:
    """Each key once, within the lateness; written as files, exactly once."""
    folder = shared_folder(spark)
    stream = source(spark, directory, name).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])
    _finish(stream.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _updated(out: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run a stream of updates and give the last row of each key.

    What a batch changes is written as that batch's part; a repeated batch overwrites its own.
    So the state may forget what lies behind the watermark, and no batch rewrites what others wrote.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    _finish(out.writeStream.outputMode("update").foreachBatch(keep), folder)
    written = out.sparkSession.read.schema(out.schema.add("batch", "long")).parquet(f"{folder}/out")
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in out.columns if c not in keys]), "batch").alias("_n"))
    return newest.select(*keys, "_n.*").select(*out.columns)


def windowed(spark: SparkSession, directory: str, name: str, at: str, width: str, by: list[str], slide: str | None = None, lateness: str = "60 days") -> DataFrame:
    """(start, by..., n, total) of event-time windows, tumbling or sliding; windows that the watermark has passed leave the state."""
    folder = shared_folder(spark)
    stream = source(spark, directory, name).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    window = F.window(at, width, slide) if slide else F.window(at, width)
    out = stream.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")
    return _updated(out, ["start", *by], folder)


def _last_and_count(events: DataFrame, key: str, at: str, value: str, lateness_ms: int):
    """Per key of (key, at, value): the value at the latest time and how many different events there were.

    The state of a key holds its latest event, the count, and only those events that lie within
    the lateness of the latest, to know them when they are delivered again.
    """
    kinds = dict(events.dtypes)

    def step(name: tuple, frames, state: GroupState):
        last, count, times, values = state.get if state.exists else (None, 0, [], [])
        seen = set(zip(times, values))
        for pdf in frames:
            for t, v in zip((pdf[at].astype("int64") // 1000).tolist() if len(pdf) else [], pdf[value].tolist()):
                v = None if v is None or v != v else str(v)
                if (t, v) in seen or last is not None and t < last - lateness_ms * 1000:
                    continue
                seen.add((t, v))
                count += 1
                last = t if last is None else max(last, t)
        seen = {(t, v) for t, v in seen if t >= last - lateness_ms * 1000} if last is not None else seen
        kept = sorted(seen, key=lambda x: (x[0], x[1] or ""))
        state.update((last, count, [t for t, _ in kept], [v for _, v in kept]))
        yield pd.DataFrame({key: [name[0]], value: [next((v for t, v in reversed(kept) if t == last), None)], "changes": [count]})

    stream = events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {value} string, changes long", "last long, count long, times array<long>, seen array<string>", "update", GroupStateTimeout.NoTimeout)


DAY_MS = 86_400_000


def latest_status(spark: SparkSession, directory: str, lateness_days: int = 60) -> DataFrame:
    """(query_id, status, changes): each query's last status and how many changes led to it; events later than the lateness are dropped."""
    folder = shared_folder(spark)
    log = source(spark, directory, "search_results").select("query_id", F.col("updated_at").cast("timestamp").alias("updated_at"), status_of(F.col("status")).alias("status"))
    return _updated(_last_and_count(log, "query_id", "updated_at", "status", lateness_days * DAY_MS), ["query_id"], folder).select("query_id", "status", "changes")


def versioned(spark: SparkSession, directory: str, lateness_days: int = 3650) -> DataFrame:
    """(asset_id, version): each new delivery of an asset raises its version; a repeated delivery does not."""
    folder = shared_folder(spark)
    stream = source(spark, directory, "assets").select(F.col("identifier").alias("asset_id"), F.col("harvested_at").cast("timestamp").alias("harvested_at"), F.lit("").alias("seen"))
    out = _last_and_count(stream, "asset_id", "harvested_at", "seen", lateness_days * DAY_MS)
    return _updated(out, ["asset_id"], folder).select("asset_id", F.col("changes").alias("version"))


def merge_into(spark: SparkSession, stream: DataFrame, path: str, key: str, order: str, folder: str | None = None):
    """Start a stream that adds the newest row of each key of a batch to ``path``; ``merged`` reads the newest of all.

    A batch writes only its own part, so its cost does not grow with the table, and a
    replayed batch writes the same part again. ``compact`` folds the parts into one.
    """
    folder = folder or shared_folder(spark)

    def merge(batch: DataFrame, number: int) -> None:
        latest(batch.where(F.col(key).isNotNull()), key, [F.col(order).desc()]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The newest row of each key of all parts; of equals that of the later batch."""
    return latest(spark.read.parquet(path), key, [F.col(order).desc(), F.col("batch").desc()]).drop("batch")


def compact(spark: SparkSession, path: str, to: str, key: str, order: str, last: int) -> None:
    """Fold the parts up to batch ``last`` into one part of a new table; later parts are copied as they are."""
    parts = spark.read.parquet(path)
    latest(parts.where(F.col("batch") <= last), key, [F.col(order).desc(), F.col("batch").desc()]).drop("batch").write.mode("overwrite").parquet(f"{to}/batch={last}")
    parts.where(F.col("batch") > last).write.mode("append").partitionBy("batch").parquet(to)


def session_windows(events: DataFrame, at: str, gap: str, by: list[str]) -> DataFrame:
    """(by..., start, end, n) of sessions that end after a gap, batch or stream."""
    shaped = events.withColumn(at, F.col(at).cast("timestamp"))
    grouped = shaped.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return grouped.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

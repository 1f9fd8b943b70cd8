"""Ingest in windows that goes on where it was cut off.

The rows modified in a span of time are worked off in windows of a fixed order.
After each window the place is written down; a new start takes up the same
span at that place. When a span is done the next begins at its end, less a time
for rows that arrive late, so a late row is seen by the following pass; who applies
the windows must bear seeing a row again (an upsert does).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import store


@dataclass(frozen=True)
class Place:
    """A span of time and the number of its rows that are done; ``done`` once the span is."""

    since: dt.datetime | None
    until: dt.datetime | None
    offset: int = 0
    done: bool = True


class Progress:
    """Places written down below a folder, one small file each; the last counts."""

    SCHEMA = "since timestamp_ntz, until timestamp_ntz, offset long, done boolean, n long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.n = spark, path.rstrip("/"), -1
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            self.n = spark.read.schema(self.SCHEMA).parquet(f"{self.path}/*").agg(F.max("n")).first()[0]

    def last(self) -> Place:
        if self.n < 0:
            return Place(None, None)
        row = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{self.n}").first()
        return Place(row["since"], row["until"], row["offset"], row["done"])

    def put(self, place: Place) -> None:
        self.n += 1
        self.spark.createDataFrame([(*asdict(place).values(), self.n)], self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{self.n}")


def ingest(catalogue: DataFrame, key: str, modified: str, progress: Progress, apply: Callable[[DataFrame], None], window: int, until: dt.datetime, late: dt.timedelta = dt.timedelta(days=1)) -> int:
    """Apply the windows that are still to be done up to ``until``; returns how many there were.

    A span that was cut off is finished first, in its own bounds. Rows without a key or a time of change are left out.
    """
    count, place = 0, progress.last()
    while True:
        if place.done:
            since = None if place.until is None else place.until - late
            if place.until is not None and place.until >= until:
                return count
            place = Place(since, until, 0, False)
            progress.put(place)
        at = F.col(modified)
        span = catalogue.where(F.col(key).isNotNull() & (at < F.lit(place.until)) & (F.lit(True) if place.since is None else at >= F.lit(place.since)))
        numbered = store.number_rows(span, [modified, key])
        total = numbered.count()
        while place.offset < total:
            apply(numbered.where(F.col("row_no").between(place.offset, place.offset + window - 1)).drop("row_no"))
            place = Place(place.since, place.until, place.offset + window, False)
            progress.put(place)
            count += 1
        place = Place(place.since, place.until, place.offset, True)
        progress.put(place)

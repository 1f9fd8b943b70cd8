"""Values brought to allowed ones: literal, by alias, or by the nearest spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_allowed(values: DataFrame, allowed: DataFrame, column: str = "value", most_edits: int = 2, aliases: dict[str, str] | None = None) -> DataFrame:
    """(value, normalised, edits) of each distinct value, in lower case; null where no allowed value is within ``most_edits``.

    ``allowed`` has a column ``allowed``; distinct values meet what shares a piece with them, and the
    nearest wins, the smaller of equals. Null values give no row.
    """
    own = values.select(F.lower(F.trim(column)).alias("value")).where("value is not null").distinct()
    meant: Column = F.col("value")
    for alias, target in (aliases or {}).items():
        meant = F.when(F.col("value") == alias.lower(), F.lit(target.lower())).otherwise(meant)
    listed = allowed.select(F.lower("allowed").alias("allowed")).where("allowed is not null").distinct()
    asked, kept = own.withColumn("_m", meant), listed.withColumn("_m", F.col("allowed"))
    met = _blocked(asked, most_edits, True).join(_blocked(kept, most_edits, False).drop("_m"), "_key").select("value", "_m", "allowed").distinct()
    best = met.where(F.levenshtein("_m", "allowed", most_edits) >= 0).groupBy("value").agg(F.min(F.struct(F.levenshtein("_m", "allowed").alias("edits"), "allowed")).alias("_b"))
    return own.join(best, "value", "left").select("value", F.col("_b.allowed").alias("normalised"), F.col("_b.edits").alias("edits"))


def _blocked(rows: DataFrame, most: int, asks: bool) -> DataFrame:
    """Rows under keys of which two strings within ``most`` edits share one.

    An allowed string is cut into one piece more than edits, so one of them is left
    whole; the asking one looks for it in allowed strings of each length in reach, at each place in reach.
    """
    n, parts = F.length("_m"), most + 1
    keys = []
    for longer in range(-most, most + 1) if asks else (0,):
        of = n + longer
        for i in range(parts):
            begin, end = F.floor(of * i / parts), F.floor(of * (i + 1) / parts)
            for shift in range(-most, most + 1) if asks else (0,):
                at = begin + shift
                fits = (of >= 0) & (at >= 0) & (at + end - begin <= n)
                keys.append(F.when(fits, F.concat_ws(" ", of, F.lit(i), F.substring(F.col("_m"), (at + 1).cast("int"), (end - begin).cast("int")))))
    return rows.withColumn("_key", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))))

"""Pairs within groups of equal records: all of them, or on request a compact form for large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members that one row gathers, and members of a group that meet as many others in one task; neither limits what comes out.
CHUNK, BLOCK = 256, 4096


def group_pairs(keyed: DataFrame, key: str, expand: int | None = None) -> DataFrame:
    """(key_a, key_b), smaller first, of members of one ``group`` with different ``variant``.

    ``keyed`` has the columns key, group and variant. Every pair is given,
    whatever the size of the group. Only with ``expand`` are groups above that many
    members given in a compact form: all pairs of the variants' smallest members,
    the group's smallest member paired with each member of another variant, and
    members of its own variant with the smallest member of the next.
    """
    a, b = f"{key}_a", f"{key}_b"
    variants = keyed.groupBy("group", "variant").agg(F.count("*").alias("n"), F.min(key).alias("low"))
    groups = variants.groupBy("group").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.min(F.struct("low", "variant")).alias("first")).where("kinds > 1")
    if expand is None:
        return _every(keyed, variants, groups, key)
    every = _every(keyed, variants, groups.where(F.col("n") <= expand), key)
    large = groups.where(F.col("n") > expand).select("group", "kinds", F.col("first.low").alias("_first"), F.col("first.variant").alias("_own"))
    second = variants.join(large, "group").where("variant <> _own").groupBy("group").agg(F.min("low").alias("_second"))
    star = keyed.join(large.join(second, "group"), "group")
    star = star.withColumn("_hub", F.when(F.col("variant") == F.col("_own"), F.col("_second")).otherwise(F.col("_first")))
    star = star.select(F.least(key, "_hub").alias(a), F.greatest(key, "_hub").alias(b)).where(F.col(a) != F.col(b))
    lows = variants.select("group", "variant", F.col("low").alias(key), F.lit(1).cast("long").alias("n"))
    between = _every(lows.drop("n"), lows, large.select("group", F.col("kinds").alias("n")), key)
    return every.unionByName(star.unionByName(between).distinct())


def _every(keyed: DataFrame, variants: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """All pairs of different variants in the given groups.

    Members of one variant are gathered in chunks, so copies are never compared
    with one another, and the chunks of a large group are dealt to parts: each
    two parts meet under a key of their own, so that a group that holds
    a third of all rows is spread over many tasks.
    """
    a, b = f"{key}_a", f"{key}_b"
    sizes = variants.select("group", "variant", "n").join(groups.select("group", F.ceil(F.col("n") / BLOCK).cast("int").alias("_parts")), "group")
    dealt = keyed.join(sizes, ["group", "variant"]).withColumn("_chunk", F.pmod(F.xxhash64(key), F.ceil(F.col("n") / CHUNK)))
    chunks = dealt.groupBy("group", "variant", "_chunk").agg(F.collect_list(key).alias("_keys"), F.first("_parts").alias("_parts"))
    chunks = chunks.withColumn("_part", F.pmod(F.xxhash64("variant", "_chunk"), F.col("_parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = chunks.select("group", F.col("_part").alias("_p"), others.alias("_q"), "variant", F.col("_keys").alias("_left"))
    right = chunks.select("group", others.alias("_p"), F.col("_part").alias("_q"), F.col("variant").alias("_v"), F.col("_keys").alias("_right"))
    met = left.join(right, ["group", "_p", "_q"]).where("variant < _v")
    met = met.select(F.explode("_left").alias("_x"), "_right").select("_x", F.explode("_right").alias("_y"))
    return met.where("_x <> _y").select(F.least("_x", "_y").alias(a), F.greatest("_x", "_y").alias(b))

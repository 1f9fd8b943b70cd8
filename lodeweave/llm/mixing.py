"""Mixing sources to target weights.

Every source gets ``target_weight`` x T tokens, T being the tokens of all
documents of the listed sources used once. A source's documents are used
``r = target / available`` times on average: ``floor(r)`` certain copies of
each, and a Pareto order sample for the remainder. In that sample a document's
rank is its random odds u / (1 - u) over its inclusion odds p / (1 - p); the inclusion
probability p = min(1, s w) is in proportion to its weight w, with s solved for each source
so that the expected tokens are the remainder's; the best ranks are taken until these
are reached. r never exceeds ``max_repeats``: a source too small for its
share gives all it may, and the report shows by how much it falls short.

No source is ever sorted in one task, though one may hold a third of all
rows: s is solved on a histogram of weights, and the cut of the cumulative token sum is found by two passes of a
4,096-bucket histogram; only the last, tiny bucket is ordered exactly.

Null or unlisted sources and null keys take no part; weights listed twice
count once (the largest); a document that comes with several texts or sources counts once, by
the first of them; empty documents have no tokens and are never
sampled. An empty corpus gives an empty mix and a report of zeros.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.runtime import cut_lineage

BUCKETS = 4096


def _listed(weights: DataFrame) -> DataFrame:
    return weights.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_weight", F.lit(0.0))).alias("target_weight"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))


def sized(documents: DataFrame, weights: DataFrame, tokens: Column, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, tokens, weight) of the documents of listed sources, each id once, materialised.

    The encoding is the costly step, so it runs once and is written out as a narrow table. Where no ``weight`` is given, or it is null, a document weighs its tokens.
    """
    listed = weights.where("source is not null").select("source").distinct()
    docs = documents.where("doc_id is not null").join(listed, "source", "left_semi")
    counted = docs.select("doc_id", "source", tokens.alias("tokens"), (F.lit(None) if weight is None else weight).cast("double").alias("weight"))
    first = counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens", "weight")).alias("f"))
    return cut_lineage(first.select("doc_id", "f.source", "f.tokens", F.coalesce("f.weight", F.col("f.tokens").cast("double")).alias("weight")))


def plan(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per listed source: tokens available, wanted and reachable, whole copies, remainder.

    ``docs`` is the result of ``sized``.
    """
    per_source = docs.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    out = _listed(weights).join(per_source, "source", "left").na.fill(0, ["available", "documents"])
    total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    out = out.join(total, how="cross")  # one row: the corpus total
    out = out.withColumn("wanted", F.col("target_weight") * F.col("total"))
    use = F.when(F.col("available") == 0, 0.0).otherwise(F.least(F.col("wanted") / F.greatest("available", F.lit(1)), F.col("max_repeats").cast("double")))
    out = out.withColumn("use", use).withColumn("whole", F.floor("use").cast("int"))
    return out.withColumn("part", F.col("use") - F.col("whole")).withColumn("rest", F.col("part") * F.col("available"))


def short_sources(docs: DataFrame, weights: DataFrame, seed: int = 7) -> DataFrame:
    """The sources that the mix uses up to the last allowed copy and that still stay below their share."""
    return shares(docs, weights, seed).where("short").select("source")


def _cut(rows: DataFrame, bucket: Column, before: str) -> tuple[DataFrame, DataFrame]:
    """Split candidates at the bucket in which the cumulative tokens cross ``rest``.

    Returns the rows of the buckets wholly below the cut, and those of the
    crossing bucket with the tokens taken before it. The histogram has at most
    4,096 rows per source, so its window is bounded.
    """
    rows = rows.withColumn("_b", bucket)
    histogram = rows.groupBy("source", "_b").agg(F.sum("tokens").alias("_t"), F.first("rest").alias("_rest"), F.first(before).alias("_done"))
    running = F.sum("_t").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = histogram.withColumn("_upto", F.col("_done") + running)
    marked = marked.withColumn("_side", F.when(F.col("_upto") <= F.col("_rest"), 0).when(F.col("_upto") - F.col("_t") < F.col("_rest"), 1).otherwise(2))
    marked = marked.where("_side < 2").select("source", "_b", "_side", (F.col("_upto") - F.col("_t")).alias("_start"))
    placed = rows.join(marked, ["source", "_b"])
    columns = ["doc_id", "source", "tokens", "rest", "_rank"]
    return placed.where("_side = 0").select(*columns), placed.where("_side = 1").select(*columns, F.col("_start").alias("_done"))


def scales(docs: DataFrame, per_source: DataFrame) -> DataFrame:
    """(source, scale): s of p = min(1, s w) for which a source's expected tokens are ``rest``.

    Solved on a histogram of the weights, 64 buckets an octave: at most some thousand rows a source, whatever its size.
    """
    usable = docs.where("tokens > 0 and weight > 0")
    buckets = usable.withColumn("_b", F.floor(F.log2("weight") * 64)).groupBy("source", "_b").agg(F.sum("tokens").cast("double").alias("t"), F.sum(F.col("tokens") * F.col("weight")).alias("tw"))
    rows = buckets.join(per_source.select("source", "rest"), "source").select("source", (F.col("tw") / F.col("t")).alias("w"), "t", "rest")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        w, t, rest = pdf["w"].to_numpy(), pdf["t"].to_numpy(), float(pdf["rest"].iloc[0])
        order = np.argsort(-w)
        w, t = w[order], t[order]
        # With the j heaviest certain, the others share what is left; the first j that keeps them below one is it.
        certain = np.concatenate([[0.0], np.cumsum(t)[:-1]])
        left = np.cumsum((t * w)[::-1])[::-1]
        s = np.maximum(0, rest - certain) / left
        fits = np.flatnonzero(s * w <= 1 + 1e-12)
        return pd.DataFrame({"source": pdf["source"].iloc[:1], "scale": [float(s[fits[0]]) if len(fits) else 1.0 / float(w[-1])]})

    return rows.groupBy("source").applyInPandas(solve, "source string, scale double")


def pareto_rank(seed: int, p: Column) -> Column:
    """Random odds over inclusion odds, mapped monotonically to (0, 1).

    The random number is a hash of seed and id, so a rerun task draws the same.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = (u / (1 - u)) / (p / (1 - p))
    return odds / (1 + odds)


def mix(docs: DataFrame, weights: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, copies) of the mix; documents that are not used give no row."""
    return _mixed(docs, cut_lineage(plan(docs, weights)), seed)


def _mixed(docs: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    per_source = planned.select("source", "whole", "part", "rest")
    rows = docs.join(per_source, "source")
    ranked = rows.where("part > 0 and tokens > 0").join(cut_lineage(scales(docs, per_source)), "source", "left")
    ranked = ranked.withColumn("_rank", pareto_rank(seed, F.coalesce(F.col("scale") * F.col("weight"), F.lit(0.0)))).withColumn("_zero", F.lit(0).cast("long"))
    sure, edge = _cut(ranked, F.floor(F.col("_rank") * BUCKETS).cast("long"), "_zero")
    surer, edge = _cut(edge, F.floor(F.col("_rank") * BUCKETS * BUCKETS).cast("long"), "_done")
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("_rank", "doc_id"))
    last = edge.withColumn("_upto", F.col("_done") + upto).where(F.col("_upto") - F.col("tokens") / 2 <= F.col("rest")).select("doc_id", "source", "tokens", "rest", "_rank")
    sampled = sure.unionByName(surer).unionByName(last).select("doc_id", F.lit(1).alias("_extra"))
    out = rows.join(sampled, "doc_id", "left").withColumn("copies", F.col("whole") + F.coalesce("_extra", F.lit(0)))
    return out.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def shares(docs: DataFrame, weights: DataFrame, seed: int = 7) -> DataFrame:
    """Report of each listed source: target share, tokens available and used, share reached, largest use, and whether it falls short though all is used."""
    planned = cut_lineage(plan(docs, weights))  # as many rows as sources, and read at every step
    used = _mixed(docs, planned, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    out = planned.join(used, "source", "left").na.fill(0, ["mixed_tokens", "most_copies"])
    used_up = (F.col("mixed_tokens") >= F.col("available") * F.col("max_repeats")) & (F.col("mixed_tokens") < F.col("wanted"))
    everything = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # as many rows as sources
    share = F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(0.0)
    return out.select("source", "target_weight", "max_repeats", F.col("available").cast("long").alias("available_tokens"), F.col("mixed_tokens").cast("long"), F.col("most_copies").cast("int"), F.round("wanted", 3).alias("wanted_tokens"), F.round(share, 6).alias("share"), used_up.alias("short"))

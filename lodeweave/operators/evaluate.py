"""Retrieval metrics over ranked results and graded judgements.

``ranked`` is (query_id, rank, doc_id, score), the score being a doc's grade
for that query; ``relevant`` is a Column over it. All metrics are one
aggregation per query after at most one window within a query's short list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(ranked: DataFrame, totals: DataFrame, relevant: Column, levels: tuple[int, ...]) -> DataFrame:
    """(query_id, k, precision, recall) for each level; precision divides by k, recall is 0 without relevant docs.

    ``totals`` is (query_id, relevant_total).
    """
    hit = relevant.cast("int")
    each = [F.struct(F.lit(k).alias("k"), F.sum(F.when(F.col("rank") <= k, hit).otherwise(0)).alias("hits")) for k in levels]
    rows = ranked.groupBy("query_id").agg(*[e.alias(f"l{i}") for i, e in enumerate(each)])
    rows = rows.select("query_id", F.explode(F.array(*[f"l{i}" for i in range(len(each))])).alias("l")).select("query_id", "l.k", "l.hits")
    rows = rows.join(totals, "query_id", "left")
    return rows.select("query_id", "k", (F.col("hits") / F.col("k")).alias("precision"), F.coalesce(F.try_divide(F.col("hits"), F.col("relevant_total")), F.lit(0.0)).alias("recall"))


def average_precision(ranked: DataFrame, totals: DataFrame, relevant: Column, k: int) -> DataFrame:
    """(query_id, ap): precision summed at each hit up to k, over all relevant docs; stops at the hits there are."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = relevant.cast("int")
    at = ranked.where(F.col("rank") <= k).withColumn("_h", hit).withColumn("_p", F.sum("_h").over(w) / F.col("rank"))
    summed = at.groupBy("query_id").agg(F.sum(F.col("_p") * F.col("_h")).alias("_s"))
    return summed.join(totals, "query_id", "left").select("query_id", F.coalesce(F.try_divide(F.col("_s"), F.col("relevant_total")), F.lit(0.0)).alias("ap"))


def ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg): linear gain, log2 discount; the ideal is the same retrieved docs in order of grade; 0 if all grades are 0."""
    ideal = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")
    placed = ranked.withColumn("_i", F.row_number().over(ideal))
    gain = lambda place: F.sum(F.when(place <= k, F.col("score") / F.log2(place + 1)).otherwise(0.0))
    out = placed.groupBy("query_id").agg(gain(F.col("rank")).alias("_d"), gain(F.col("_i")).alias("_m"))
    return out.select("query_id", F.when(F.col("_m") > 0, F.col("_d") / F.col("_m")).otherwise(0.0).alias("ndcg"))


def hit_rate(ranked: DataFrame, queries: DataFrame, relevant: Column, levels: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., k, hit_rate, position): part of the queries with a hit among the first k, and the mean 0-based place of the first hit."""
    first = ranked.where(relevant).groupBy("query_id").agg(F.min("rank").alias("_first"))
    rows = queries.select("query_id", *by).distinct().join(first, "query_id", "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in levels])))
    hit = F.coalesce(F.col("_first") <= F.col("k"), F.lit(False))
    return rows.groupBy(*by, "k").agg(F.avg(hit.cast("double")).alias("hit_rate"), F.avg(F.when(hit, F.col("_first") - 1)).alias("position"), F.count("*").alias("queries"))


def heuristic_score(conditions: Column) -> Column:
    """Score of an array of {mandatory, met}: share of mandatory met, plus share of optional met times its square; null without mandatory ones."""
    count = lambda test: F.size(F.filter(conditions, test)).cast("double")
    must = F.try_divide(count(lambda c: c["mandatory"] & c["met"]), count(lambda c: c["mandatory"]))
    may = F.coalesce(F.try_divide(count(lambda c: ~c["mandatory"] & c["met"]), count(lambda c: ~c["mandatory"])), F.lit(0.0))
    return must + may * must * must


def quality_bucket(length: Column, tags: Column) -> Column:
    """Stratum of an asset by the length of its description and its number of tags; null between the strata."""
    return (
        F.when((length > 1000) & (tags > 10), "long_many").when((length > 1000) & (tags < 3), "long_few")
        .when(length.between(200, 500) & (tags > 10), "short_many").when((length < 50) & (tags > 10), "tiny_many")
    )


def best_two(table: DataFrame, metric: str) -> DataFrame:
    """Rows with the two largest distinct values of a metric, with their place."""
    return table.withColumn("place", F.dense_rank().over(Window.orderBy(F.col(metric).desc()))).where("place <= 2")  # over an already aggregated report


def pooled_vectors(chunks: DataFrame, how: str, key: str = "asset_id", order: str = "id", weight: Column | None = None) -> DataFrame:
    """(key, vector): a key's chunk vectors pooled per component by mean, max, weighted mean or cls (the first chunk).

    Vectors are added up within each Arrow batch before they are shuffled, so a key that
    holds very many chunks sends one partial vector a batch. Weights are null or not
    negative; where a key's sum to nothing the plain mean is taken.
    """
    rows = chunks.where(F.col(key).isNotNull() & F.col("vector").isNotNull())
    if how == "cls":
        return rows.groupBy(key).agg(F.min_by("vector", order).alias("vector")).select(key, F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    kind = dict(chunks.dtypes)[key]
    w = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))
    schema = f"{key} {kind}, w double, n long, weighted array<double>, plain array<double>"
    add = np.maximum if how == "max" else np.add

    def reduced(keys, w, n, weighted, plain):
        code, names = pd.factorize(keys)
        by = np.argsort(code, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(code[by]) != 0])
        names = np.asarray(names)[code[by][start]]
        return pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(np.add.reduceat(x[by], start)) for x in (w, n)], *[pa.array(list(add.reduceat(x[by], start, axis=0)), pa.list_(pa.float64())) for x in (weighted, plain)]], [key, "w", "n", "weighted", "plain"])

    def matrix(column):
        return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                vectors, weights = matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                yield reduced(batch.column(0).to_pandas(), weights, np.ones(len(vectors), np.int64), vectors * weights[:, None] if how != "max" else vectors, vectors)

    def whole(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        columns = [table.column(k).combine_chunks() for k in range(5)]
        return pa.Table.from_batches([reduced(columns[0].to_pandas(), columns[1].to_numpy(), columns[2].to_numpy(), matrix(columns[3]), matrix(columns[4]))])

    sums = rows.select(key, "vector", w.alias("w")).mapInArrow(partial, schema).groupBy(key).applyInArrow(whole, schema)
    if how == "max":
        return sums.select(key, F.col("plain").alias("vector"))
    return sums.select(key, F.when(F.col("w") > 0, F.transform("weighted", lambda x: x / F.col("w"))).otherwise(F.transform("plain", lambda x: x / F.col("n"))).alias("vector"))


def pooled(chunks: DataFrame, how: str, key: str = "asset_id", order: str = "id") -> DataFrame:
    """(key, pos, value) of ``pooled_vectors``."""
    return pooled_vectors(chunks, how, key, order).select(key, F.posexplode("vector").alias("pos", "value"))


def annotated(results: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """Results with their annotations; LookupError if any result has none."""
    missing = results.select(*keys).join(annotations.select(*keys), keys, "left_anti").first()
    if missing is not None:
        raise LookupError(f"no annotation for {tuple(missing)}")
    return results.join(annotations, keys)


def best_attempt(attempts: DataFrame, key: str, valid: str, total: str, order: str) -> DataFrame:
    """Per key the first wholly valid attempt, else the one with most valid parts, the earlier of equals."""
    w = Window.partitionBy(key).orderBy((F.col(valid) == F.col(total)).desc(), F.when(F.col(valid) == F.col(total), 0).otherwise(-F.col(valid)), order)
    return attempts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def expand_topic(topic: Column, discarded: Column) -> Column:
    """A topic with the discarded conditions' texts appended."""
    return F.array_join(F.concat(F.array(topic), F.filter(discarded, lambda x: x.isNotNull() & (x != ""))), " ")

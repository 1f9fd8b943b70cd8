"""Exact vector search: top-k, grouped, multi-vector, filtered, fan-out, validated, recommender.

Queries are a DataFrame (query_id, vector, ...), the corpus a DataFrame
(id, vector, asset_id, asset_type, ...). A batch of queries is one job. The
kernel (``functions/nearest.py``) is a matrix product of each block of the corpus
with the query matrix; a task keeps the k best of each query over all of its
rows, so what is shuffled is queries x k for each core.

The query matrix is broadcast while its checked size stays below
``MAX_BROADCAST``; beyond it the queries are cut into blocks of that size, and
the corpus is scanned once for each, without shuffling it. Similarities are rounded to nine
digits before they are ranked, so that order does not depend on summation order,
and ties go to the smaller asset or vector id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.nearest import DIGITS, Nearest, Queries, matrix
from lodeweave.functions.vector import usable
from lodeweave.runtime import forget, written

MAX_BROADCAST = 64 << 20
#: Query vectors of one product; corpus rows gathered before they meet the queries.
QUERY_BLOCK, CORPUS_BLOCK = 512, 8192
#: From so many query vectors on, two a query at least, a first pass tells floors.
MANY = 1 << 14


def _candidates(queries: DataFrame, corpus: DataFrame, k: int, grouped: bool, tagged: bool) -> DataFrame:
    """(query_id, [id,] asset_id, similarity): the k nearest of each query in each part of the corpus, all of a query in one partition."""
    kind = dict(queries.dtypes)["query_id"]
    schema = f"query_id {kind}, " + ("" if grouped else "id long, ") + "asset_id string, similarity double"
    q = queries.select("query_id", "vector", *(["tag"] if tagged else []))
    c = corpus.select("id", "vector", F.col("asset_id"), *(["tag"] if tagged else []))
    # A part for each core: every part gives its own k of each query.
    c = c.coalesce(c.sparkSession.sparkContext.defaultParallelism)
    found = [_scan(block, c, k, grouped, tagged, schema) for block in _blocks(q)]
    return reduce(DataFrame.union, found).repartition("query_id")


def _blocks(q: DataFrame) -> Iterator[DataFrame]:
    """The queries in blocks that can be held at once, all vectors of a query in one block unless they are a large part of it. Each is to be read before the next is asked for."""
    size = q.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    wide = 8 if dict(q.dtypes)["vector"] == "array<double>" else 4
    most = max(QUERY_BLOCK, MAX_BROADCAST // (wide * max(size["d"] or 0, 1)))
    if size["n"] <= most:
        yield q
        return
    blocks = -(-size["n"] // most)
    many = [r[0] for r in q.groupBy("query_id").count().where(F.col("count") > most // 4).select("query_id").collect()]  # at most 4 a block
    number = F.pmod(F.xxhash64("query_id", F.when(F.col("query_id").isin(many), F.xxhash64("vector")).otherwise(F.lit(0).cast("long"))), F.lit(blocks))
    held = written(q.withColumn("_q", number))
    for i in range(blocks):
        yield held.where(F.col("_q") == i).drop("_q")
    forget(held)


def _scan(q: DataFrame, c: DataFrame, k: int, grouped: bool, tagged: bool, schema: str) -> DataFrame:
    """The k nearest of each query in each partition of the corpus, with the queries broadcast."""
    asked = Queries.of(q.toArrow(), tagged)
    if grouped and len(asked.query) >= max(MANY, 2 * len(asked.names)):
        asked = _with_floors(asked, c, k, tagged, schema)
    return _each_part(asked, c, k, grouped, tagged, schema, Nearest.meet)


def _with_floors(asked: Queries, c: DataFrame, k: int, tagged: bool, schema: str) -> Queries:
    """The queries with what k assets of the whole corpus, though not the k nearest, reach already."""
    some = _each_part(asked, c, k, True, tagged, schema, Nearest.guess).groupBy("query_id", "asset_id").agg(F.max("similarity").alias("s"))
    kth = some.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("s"), False), F.lit(k - 1)).alias("s")).where("s is not null").toPandas()
    floor = asked.floor.copy()
    floor[pd.Index(asked.names).get_indexer(kth["query_id"])] = kth["s"]
    return asked._replace(floor=floor)


def _each_part(asked: Queries, c: DataFrame, k: int, grouped: bool, tagged: bool, schema: str, take: Callable[..., None]) -> DataFrame:
    """The hits that ``take`` finds in each partition of the corpus, at most k a query."""
    shared, rows, gathered = c.sparkSession.sparkContext.broadcast(asked), QUERY_BLOCK, CORPUS_BLOCK

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(shared.value, k, grouped, rows)
        waiting: list[pa.RecordBatch] = []

        def meet() -> None:
            columns = pa.Table.from_batches(waiting).columns
            waiting.clear()
            for a in range(0, len(columns[0]), gathered):
                ids, vectors, assets, *tags = (x.slice(a, gathered) for x in columns)
                take(nearest, ids.to_numpy(), matrix(vectors), assets.to_pandas().to_numpy(), tags[0].to_pandas().to_numpy() if tagged else None)

        for batch in batches:
            if batch.num_rows and len(shared.value.query):
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= gathered:
                meet()
        if waiting:
            meet()
        for part in nearest.hits():
            yield pa.RecordBatch.from_pandas(part, preserve_index=False)

    return c.mapInArrow(scan, schema)


def _ranked(candidates: DataFrame, k: int, tie: str, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("similarity").desc(), F.col(tie))
    out = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("distance", F.round(1 - F.col("similarity"), 6)).drop("similarity")


def usable_chunks(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """Chunks with a usable vector, rows delivered again included: searches drop those among their few candidates.

    So filters on these rows reach the scan, and no search shuffles the table.
    """
    return chunks.where(F.col("id").isNotNull() & usable(F.col("vector"), dim))


def distinct_chunks(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """Usable chunks, each id once (of several rows the one with the smallest vector), for what sums or counts over them."""
    return usable_chunks(chunks, dim).withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("vector"))).where(F.col("_r") == 1).drop("_r")


def _once(candidates: DataFrame) -> DataFrame:
    """(query_id, id, asset_id, similarity): each id once for a query, by its nearest vector."""
    return candidates.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"), F.min("asset_id").alias("asset_id"))


def top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, asset_id, distance): the k most similar vectors of each query."""
    return _ranked(_once(_candidates(queries, corpus, k, False, False)), k, "id")


def top_k_expression(queries: DataFrame, corpus: DataFrame, k: int, most: int = 256) -> DataFrame:
    """``top_k`` in JVM expressions only, for a handful of queries joined to each corpus row; beyond ``most`` queries the kernel takes over."""
    from lodeweave.functions.vector import as_double, cosine

    if len(queries.select("query_id").limit(most + 1).collect()) > most:
        return top_k(queries, corpus, k)
    q = queries.select("query_id", as_double(F.col("vector")).alias("_q"))
    c = corpus.select("id", "asset_id", as_double(F.col("vector")).alias("_v"))
    scored = c.join(q, F.lit(True)).select("query_id", "id", "asset_id", F.round(cosine(F.col("_q"), F.col("_v")), DIGITS).alias("similarity"))
    return _ranked(_once(scored), k, "id")


def grouped_top_k(queries: DataFrame, corpus: DataFrame, k: int, tagged: bool = False) -> DataFrame:
    """(query_id, rank, asset_id, distance): the k best assets, each by its best chunk.

    A query of several vectors is several rows of one query_id; an asset counts by the smallest distance
    to any of them. With ``tagged``, queries and corpus have a column ``tag`` that must agree.
    """
    pool = _candidates(queries, corpus.where(F.col("asset_id").isNotNull()), k, True, tagged)
    best = pool.groupBy("query_id", "asset_id").agg(F.max("similarity").alias("similarity"))
    return _ranked(best, k, "asset_id").select("query_id", "rank", "asset_id", "distance")


def excluding(queries: DataFrame, corpus: DataFrame, banned: DataFrame, k: int, most_banned: int) -> DataFrame:
    """Grouped top-k without each query's own excluded assets.

    ``banned`` is (query_id, asset_id) with at most ``most_banned`` rows per
    query: so many more are fetched and the excluded ones then anti-joined.
    """
    wide = grouped_top_k(queries, corpus, k + most_banned)
    kept = wide.join(banned.distinct(), ["query_id", "asset_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "asset_id", "distance")


def fan_out(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Top-k assets of every asset type merged into one global top-k by distance.

    Each type's list is taken first, as separate collections would give it; the merge is a rank over their union.
    """
    per_type = _candidates_by_type(queries, corpus, k)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "asset_id", "asset_type")
    merged = per_type.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "asset_id", "asset_type", F.round(1 - F.col("similarity"), 6).alias("distance"))


def _candidates_by_type(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    named = corpus.where("asset_id is not null and asset_type is not null")
    # An asset of two types is two candidates: type and id travel as one name.
    packed = named.withColumn("asset_id", F.concat_ws("\u0001", "asset_type", "asset_id"))
    # The k best over all types contain all that the merge can return.
    pool = _candidates(queries, packed, k, True, False)
    parts = F.split("asset_id", "\u0001")
    best = pool.groupBy("query_id", "asset_id").agg(F.max("similarity").alias("similarity")).select("query_id", parts[0].alias("asset_type"), parts[1].alias("asset_id"), "similarity")
    w = Window.partitionBy("query_id", "asset_type").orderBy(F.col("similarity").desc(), "asset_id")
    return best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def conditioned(queries: DataFrame, corpus: DataFrame, metadata: DataFrame, conditions: dict[int, Column], k: int) -> DataFrame:
    """Grouped top-k in which each query searches only among the assets that fit its own condition.

    ``queries`` has a column ``tag``, the number of its condition on ``metadata``
    (asset_id, ...). The metadata is read once for all conditions; equal conditions should share a number.
    """
    fits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    allowed = metadata.where(F.col("asset_id").isNotNull()).select("asset_id", F.explode(fits).alias("tag")).distinct()
    return grouped_top_k(queries, corpus.join(allowed, "asset_id"), k, tagged=True)


def validated(queries: DataFrame, corpus: DataFrame, catalogue: DataFrame, k: int) -> DataFrame:
    """Top-k assets that still exist: the corpus is semi-joined to the catalogue first, so one exact pass fills k."""
    known = catalogue.select("asset_id").distinct()
    return grouped_top_k(queries, corpus.join(known, "asset_id", "left_semi"), k)


def validated_rounds(queries: DataFrame, corpus: DataFrame, catalogue: DataFrame, k: int, rounds: int = 5) -> DataFrame:
    """The refill loop by its effect: each round fetches the still missing number of unseen hits and keeps the valid ones.

    All rounds are one pass over a ranked list of k hits per round at most: the
    running count of valid hits says how far each round reaches.
    """
    known = catalogue.select("asset_id").distinct().withColumn("_ok", F.lit(1))
    hits = grouped_top_k(queries, corpus, k * rounds).join(known, "asset_id", "left").withColumn("_ok", F.coalesce("_ok", F.lit(0)))
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "asset_id", "distance", "_ok"))).alias("h"))
    reach = F.lit(k)
    for _ in range(rounds - 1):
        seen = reach
        reach = F.lit(k) + F.aggregate(F.slice("h", F.lit(1), seen.cast("int")), F.lit(0), lambda s, x: s + 1 - x["_ok"])
        reach = F.greatest(seen, reach)
    out = listed.select("query_id", F.explode(F.slice("h", F.lit(1), reach.cast("int"))).alias("x")).where("x._ok = 1")
    w = Window.partitionBy("query_id").orderBy("x.rank")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("x.asset_id").alias("asset_id"), F.col("x.distance").alias("distance"))


def lazy_deletes(queries: DataFrame, corpus: DataFrame, catalogue: DataFrame, k: int) -> DataFrame:
    """Assets among the unvalidated top-k that the catalogue no longer has, to be deleted."""
    hits = grouped_top_k(queries, corpus, k)
    return hits.select("asset_id").distinct().join(catalogue.select("asset_id").distinct(), "asset_id", "left_anti")


def overfetch(queries: DataFrame, corpus: DataFrame, k: int, factor: int = 10) -> DataFrame:
    """Take k x factor chunks, keep each asset's first, cut to k; may hold fewer than k when one asset fills the fetch."""
    wide = _ranked(_once(_candidates(queries, corpus.where(F.col("asset_id").isNotNull()), k * factor, False, False)), k * factor, "id")
    first = wide.groupBy("query_id", "asset_id").agg(F.min("rank").alias("_f"), F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy("_f")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "asset_id", "distance")


def recommend(seeds: DataFrame, corpus: DataFrame, k: int, same_type: bool) -> DataFrame:
    """(query_id, rank, asset_id, distance) for assets given by id, from their stored vectors.

    ``seeds`` is (asset_id). All chunk vectors of the seed are query vectors; the seed itself is left out
    only when recommending within its own type.
    """
    q = corpus.join(seeds.distinct(), "asset_id", "left_semi").select(F.col("asset_id").alias("query_id"), "vector", F.col("asset_type").alias("tag"))
    if not same_type:
        return grouped_top_k(q.drop("tag"), corpus, k)
    c = corpus.where("asset_id is not null and asset_type is not null").withColumn("tag", F.col("asset_type"))
    wide = grouped_top_k(q.where("tag is not null"), c, k + 1, tagged=True).where(F.col("query_id") != F.col("asset_id"))
    w = Window.partitionBy("query_id").orderBy("rank")
    return wide.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def existing(spark, table: str, schema: str) -> DataFrame:
    """A named collection, or an empty one of the schema if there is none."""
    return spark.table(table) if spark.catalog.tableExists(table) else spark.createDataFrame([], schema)


def slice_results(results: DataFrame, low: int, high: int) -> DataFrame:
    """Ranks low..high of each result list."""
    return results.where(F.col("rank").between(low, high))


def translate(results: DataFrame, documents: DataFrame, key: str = "asset_id") -> DataFrame:
    """Result arrays to their documents, in the order of the hits: (query_id, pos, asset_id, found columns)."""
    hits = results.select("query_id", F.posexplode("asset_ids").alias("pos", key))
    return hits.join(documents, key, "left")


def context_text(hits: DataFrame, content: Column, link: Column) -> DataFrame:
    """(query_id, context): ``Result i:`` blocks of the hits in rank order, counted from 0."""
    block = F.concat(F.lit("Result "), (F.col("rank") - 1).cast("string"), F.lit(":\n"), content, F.lit("\nlink:"), link, F.lit("\n"))
    listed = hits.withColumn("_b", block).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "_b"))).alias("_l"))
    return listed.select("query_id", F.array_join(F.transform("_l", lambda x: x["_b"]), "").alias("context"))

"""The calls a client of the engine makes, each giving DataFrames.

Queries come as batches: one job answers all of them. An embedder is any
function from a text Column to a vector Column; a parser is any function from a
query text to conditions. Both have deterministic defaults, so everything runs without a model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.text import ASSET_TYPES
from lodeweave.functions.vector import hash_embedding
from lodeweave.operators import lifecycle, search
from lodeweave.plans import filter_dsl
from lodeweave.schema import Registry


class NotFound(LookupError):
    """No query of this id."""


class Expired(LookupError):
    """The query's result is past its time."""


@dataclass
class Engine:
    """A chunk table, the catalogue of assets, and metadata to filter by."""

    chunks: DataFrame
    assets: DataFrame
    metadata: DataFrame | None = None
    embed: Callable[[Column], Column] = field(default_factory=hash_embedding)
    dim: int = 64
    parse: Callable[[str], list[dict]] | None = None

    def built_types(self) -> list[str]:
        """Asset types that have chunks; there are at most as many as types."""
        return sorted(r[0] for r in self.chunks.where("asset_type is not null").select("asset_type").distinct().collect())

    def _corpus(self, asset_type: str) -> DataFrame:
        chunks = search.usable_chunks(self.chunks, self.dim)
        return chunks if asset_type == "all" else chunks.where(F.col("asset_type") == asset_type)

    def _catalogue(self) -> DataFrame:
        return self.assets.select(F.col("identifier").alias("asset_id")).distinct()

    def _vectors(self, queries: DataFrame) -> DataFrame:
        return queries.select("query_id", self.embed(F.col("text")).alias("vector"))

    def _checked(self, queries: DataFrame, topk: int) -> DataFrame:
        """The queries, or ValueError if any text is null, blank or too long, or ``topk`` out of bounds."""
        filter_dsl.validate_query("x", topk)
        fits = F.coalesce((F.trim("text") != "") & (F.length("text") <= filter_dsl.MAX_TEXT), F.lit(False))
        odd = queries.where(~fits).select("query_id").first()
        if odd is not None:
            raise ValueError(f"query {odd[0]!r}: a query has 1 to {filter_dsl.MAX_TEXT} characters")
        return queries

    def search(self, queries: DataFrame, topk: int = 10, asset_type: str = "all", entire: bool = False) -> DataFrame:
        """(query_id, rank, asset_id, distance[, asset]) of (query_id, text): assets that still exist, best chunk each."""
        filter_dsl.validate_asset_type(asset_type, self.built_types(), ASSET_TYPES)
        asked = self._vectors(self._checked(queries, topk))
        return self._shaped(search.validated(asked, self._corpus(asset_type), self._catalogue(), topk), entire)

    def filtered_search(self, queries: DataFrame, filters: Sequence[filter_dsl.Filter] | None, asset_type: str, topk: int = 10, registry: Registry | None = None, entire: bool = False) -> DataFrame:
        """``search`` within one asset type, among assets whose metadata passes the filters.

        With ``filters`` None the parser reads each query's own from its text; what it
        gives and does not fit is dropped. Queries with equal filters share one condition, and the
        metadata is read once for all of them.
        """
        filter_dsl.validate_asset_type(asset_type, self.built_types(), ASSET_TYPES, allow_all=False)
        if self.metadata is None:
            raise ValueError("there is no metadata to filter by")
        registry = registry or Registry.of(asset_type)
        asked, corpus = self._checked(queries, topk), self._corpus(asset_type).join(self._catalogue(), "asset_id", "left_semi")
        if filters is not None:
            fit = self.metadata.where(filter_dsl.compile_filters(list(filters), registry)).select("asset_id").distinct()
            return self._shaped(search.grouped_top_k(self._vectors(asked), corpus.join(fit, "asset_id", "left_semi"), topk), entire)
        number: dict[tuple, int] = {}
        read = [(r["query_id"], number.setdefault(tuple(self.read_filters(r["text"], registry)), len(number))) for r in asked.select("query_id", "text").distinct().collect()]  # the parser is called for each text here
        conditions = {n: filter_dsl.compile_filters(list(own), registry) for own, n in number.items()}
        kind = asked.schema["query_id"].dataType.simpleString()
        tags = queries.sparkSession.createDataFrame(read, f"query_id {kind}, tag int")
        tagged = self._vectors(asked).join(tags, "query_id")
        return self._shaped(search.conditioned(tagged, corpus, self.metadata, conditions, topk), entire)

    def read_filters(self, text: str, registry: Registry) -> list[filter_dsl.Filter]:
        """Filters that the parser finds in a text; a parser that fails finds none. More than are allowed is an error later on."""
        try:
            raw = self.parse(text) if self.parse else []
        except Exception:  # whatever a parser of a user's raises means no conditions
            raw = []
        return [f for f in (filter_dsl.condition(r, registry) for r in raw) if f is not None]

    def recommend(self, asset_ids: DataFrame, topk: int = 10, output_type: str = "all", entire: bool = False) -> DataFrame:
        """Assets like the given ones, from stored vectors; an asset is left out of its own list only within its own type."""
        filter_dsl.validate_query("x", topk)
        filter_dsl.validate_asset_type(output_type, self.built_types(), ASSET_TYPES)
        chunks = search.usable_chunks(self.chunks, self.dim)
        asked = chunks.join(asset_ids.select("asset_id").distinct(), "asset_id", "left_semi").select(F.col("asset_id").alias("query_id"), "vector", F.col("asset_type").alias("own"))
        corpus = self._corpus(output_type).join(self._catalogue(), "asset_id", "left_semi")
        hits = search.grouped_top_k(asked.drop("own"), corpus, topk + 1)
        kinds = asked.groupBy("query_id").agg(F.first("own").alias("own"))
        kept = hits.join(kinds, "query_id").where((F.col("query_id") != F.col("asset_id")) | (F.lit(output_type) != F.col("own"))).drop("own")
        from pyspark.sql import Window

        ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= topk)
        return self._shaped(ranked, entire)

    def context(self, queries: DataFrame, topk: int = 3, asset_type: str = "all") -> DataFrame:
        """(query_id, context) for a chat: names and links of the best assets."""
        hits = self.search(queries, topk, asset_type)
        named = self.assets.select(F.col("identifier").alias("asset_id"), "name").dropDuplicates(["asset_id"])
        return search.context_text(hits.join(named, "asset_id"), F.coalesce("name", F.lit("")), F.col("asset_id"))

    def _shaped(self, hits: DataFrame, entire: bool) -> DataFrame:
        if not entire:
            return hits
        whole = self.assets.select(F.col("identifier").alias("asset_id"), F.struct(*self.assets.columns).alias("asset")).dropDuplicates(["asset_id"])
        return hits.join(whole, "asset_id", "left")

    @staticmethod
    def field_schema(asset_type: str) -> list[dict]:
        return Registry.of(asset_type).field_schema()

    @staticmethod
    def filter_schema(asset_type: str, name: str) -> dict:
        return Registry.of(asset_type).filter_schema(name)


def result_of(log: DataFrame, query_id: str, now: Column) -> DataFrame:
    """The logged query's row; NotFound if there is none, Expired if it is past its time."""
    row = log.where(F.col("query_id") == query_id).limit(1)
    found = row.select(lifecycle.is_expired(F.col("expires_at"), now).alias("gone")).first()
    if found is None:
        raise NotFound(query_id)
    if found["gone"]:
        raise Expired(query_id)
    return row


def rerank(hits: DataFrame, score: Column, candidates: DataFrame | None = None) -> DataFrame:
    """Hits in the order of a score; with ``candidates`` (query_id, asset_id) only those that were asked about are kept."""
    from pyspark.sql import Window

    kept = hits if candidates is None else hits.join(candidates.select("query_id", "asset_id").distinct(), ["query_id", "asset_id"], "left_semi")
    w = Window.partitionBy("query_id").orderBy(score.desc(), "rank")
    return kept.withColumn("rank", F.row_number().over(w))

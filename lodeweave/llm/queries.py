"""Registered queries of the subpackage and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.llm import canonical, lookalike, mixing, near_duplicates, splitting, tokenize, vector_graph
from lodeweave.runtime import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    """Register a query under its function's name."""
    QUERIES[fn.__name__] = fn
    return fn


@query
def p1_found(spark, d):
    return canonical.mapped_found(table(spark, d, "normalized_values"), table(spark, d, "field_valid_values"))


@query
def p1_mapped(spark, d):
    return canonical.mapped_rows(table(spark, d, "normalized_values"), table(spark, d, "field_valid_values"))


@query
def p1_misses(spark, d):
    return canonical.misses(table(spark, d, "normalized_values"), table(spark, d, "field_valid_values"))


@query
def p2_found(spark, d):
    return vector_graph.similar_pairs(table(spark, d, "chunk_vectors"))


@query
def p2_nearest(spark, d):
    return vector_graph.nearest(table(spark, d, "chunk_vectors"))


@query
def p2_search(spark, d):
    return vector_graph.search(table(spark, d, "chunk_vectors"))


@query
def p4_found(spark, d):
    pairs = near_duplicates.asset_duplicates(table(spark, d, "assets")).pairs()
    return pairs.select(F.col("key_a").alias("identifier_a"), F.col("key_b").alias("identifier_b"))


@query
def p4_groups(spark, d):
    groups = near_duplicates.asset_duplicates(table(spark, d, "assets")).groups()
    return groups.withColumnRenamed("key", "identifier")


@query
def p5_found(spark, d):
    return splitting.oversized_texts(table(spark, d, "assets"))


@query
def p5_pieces(spark, d):
    return splitting.split_assets(table(spark, d, "assets"))


@query
def p6_ids(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tokenize.token_ids(spark, F.col("text")).alias("ids"))


def _sized(spark, d):
    """Documents with their tokens; the chance to be sampled beyond the certain copies goes by their size."""
    docs, weights = table(spark, d, "documents"), table(spark, d, "source_weights")
    return mixing.sized(docs, weights, tokenize.token_count(spark, F.col("text"))), weights


@query
def p7_found(spark, d):
    return mixing.short_sources(*_sized(spark, d))


@query
def p7_mix(spark, d):
    return mixing.mix(*_sized(spark, d))


@query
def p7_shares(spark, d):
    return mixing.shares(*_sized(spark, d))


@query
def p8_found(spark, d):
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


@query
def p8_forms(spark, d):
    docs = table(spark, d, "documents").where("doc_id is not null")
    return lookalike.canonical_text(docs).select("doc_id", "form")


ORACLE["p5_found"] = r"""
with t as (
  select identifier, 'description' as field_name, coalesce(description.plain, regexp_replace(description.html, '<[^>]*>', ' ', 'g')) as txt from assets
  union all
  select identifier, 'content', coalesce(content.plain, regexp_replace(content.html, '<[^>]*>', ' ', 'g')) from assets)
select distinct identifier, field_name, cast(regexp_matches(txt, '[^ \t\r\n]{1000}[^ \t\r\n]{1000}[^ \t\r\n]') as int) as hard
from t where length(txt) > 2000 and identifier is not null"""

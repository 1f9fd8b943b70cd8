"""All core queries; importing the parts registers them."""

from __future__ import annotations

from lodeweave.operators import units
from lodeweave.plans import data_queries, search_queries, stream_queries, text_queries  # noqa: F401
from lodeweave.plans.registry import ORACLE, QUERIES, query
from lodeweave.runtime import table

FLAGSHIP = "vector_topk"


@query()
def p3_found(spark, d):
    return units.sizes_in_kb(table(spark, d, "assets"), table(spark, d, "dataset_metadata"), table(spark, d, "platform_units"))


__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]

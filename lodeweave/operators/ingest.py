"""Change data: what is new, changed, stale; crawled pages; collection logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.runtime import cut_lineage


def new_assets(catalogue: DataFrame, stored: DataFrame, added: DataFrame | None = None, key: str = "asset_id") -> DataFrame:
    """Catalogue rows that are neither stored nor added in this run; overlapping pages count once."""
    out = catalogue.where(F.col(key).isNotNull()).dropDuplicates([key]).join(stored.select(key).distinct(), key, "left_anti")
    return out if added is None else out.join(added.select(key).distinct(), key, "left_anti")


def changed_assets(catalogue: DataFrame, stored: DataFrame, modified: Column, since: Column, key: str = "asset_id") -> DataFrame:
    """Catalogue rows of stored assets modified at or after the last synchronisation."""
    return catalogue.where(modified >= since).join(stored.select(key).distinct(), key, "left_semi")


def stale_assets(stored: DataFrame, catalogue: DataFrame, key: str = "asset_id") -> DataFrame:
    """Stored ids that the catalogue no longer has."""
    return stored.select(key).where(F.col(key).isNotNull()).distinct().join(catalogue.select(key).distinct(), key, "left_anti")


def crawl_delta(old: DataFrame, new: DataFrame, url: str = "url", version: str = "last_modified") -> DataFrame:
    """(url, change): insert, update, keep or delete of each page of either crawl."""
    a = old.groupBy(url).agg(F.max(F.coalesce(version, F.lit(""))).alias("_a"))
    b = new.groupBy(url).agg(F.max(F.coalesce(version, F.lit(""))).alias("_b"))
    joined = a.join(b, url, "full_outer")
    change = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.col("_a") != F.col("_b"), "update").otherwise("keep")
    return joined.select(url, change.alias("change"))


def crawl_rule(domain: str | None = None, blocked: tuple[str, ...] = (), kinds: tuple[str, ...] = ("", "html", "htm", "php")) -> Column:
    """Whether a page (column ``node``, a URL) may be visited: of the domain or below it, without a blocked beginning, and a page by its ending."""
    node = F.col("node")
    host = F.lower(F.regexp_extract(node, r"^(?:https?://)?+([^/:?#]+)", 1))
    ending = F.lower(F.regexp_extract(node, r"^(?:https?://)?+[^/?#]*/?(?:[^?#]*/)?[^/?#]*?\.([A-Za-z0-9]{1,5})(?:[?#].*)?$", 1))
    path = F.regexp_extract(node, r"^(?:https?://)?+[^/?#]+(/[^?#]*)", 1)
    rule = F.when(path == "", F.lit(True)).otherwise(ending.isin(*kinds))
    if domain:
        rule = rule & ((host == domain.lower()) | F.endswith(host, F.lit("." + domain.lower())))
    for beginning in blocked:
        rule = rule & ~F.startswith(node, F.lit(beginning))
    return F.coalesce(rule, F.lit(False))


def reach(links: DataFrame, starts: DataFrame, depth: int, allowed: Column | None = None) -> DataFrame:
    """(node, depth): what is reached over ``links`` (src, dst) in at most ``depth`` steps, with the least number of steps.

    With ``allowed`` (on column ``node``) other nodes are neither visited nor passed through; starts are.

    One join of the frontier a step; each step is materialised, so a lost executor costs no more than that.
    """
    seen = cut_lineage(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for step in range(1, depth + 1):
        found = links.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).where("node is not null")
        found = (found if allowed is None else found.where(allowed)).distinct()
        frontier = cut_lineage(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen


def embedding_count(log: DataFrame) -> DataFrame:
    """Embeddings of each collection log: of its setup, plus added, less removed by its updates."""
    change = F.aggregate("recurring", F.lit(0).cast("long"), lambda s, u: s + u["embeddings_added"] - u["embeddings_removed"])
    return log.select("asset_type", (F.col("setup.embeddings_added") + F.coalesce(change, F.lit(0))).alias("num_embeddings"))


def prune_updates(recurring: Column) -> Column:
    """Updates without additions or removals are dropped, except the last."""
    return F.filter(recurring, lambda u, i: (u["embeddings_added"] + u["embeddings_removed"] > 0) | (i == F.size(recurring) - 1))


def last_update(recurring: Column) -> Column:
    return F.try_element_at(recurring, F.lit(-1))

"""Embedding of documents: whole, by chunks, refined, pooled. The model is any text-to-vector Column function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.text import tokens, windows
from lodeweave.operators.evaluate import pooled_vectors


def embed_whole(documents: DataFrame, key: str, text: str, embed: Callable[[Column], Column], most_tokens: int | None = 4096) -> DataFrame:
    """(key, vector) of each document, or of its first ``most_tokens`` tokens where a model has such a bound; null and blank texts give no row."""
    every = tokens(F.col(text))
    kept = documents.select(key, (every if most_tokens is None else F.slice(every, 1, most_tokens)).alias("_t")).where(F.size("_t") > 0)
    return kept.select(key, embed(F.array_join("_t", " ")).alias("vector"))


def embed_chunks(documents: DataFrame, key: str, text: str, embed: Callable[[Column], Column], size: int = 512, overlap: float = 0.25, cap: int | None = 11) -> DataFrame:
    """(key, chunk_no, vector) of each document's chunks, at most ``cap`` unless that is None; null and blank texts give no row."""
    kept = documents.select(key, tokens(F.col(text)).alias("_t")).where(F.size("_t") > 0)
    chunks = kept.select(key, F.posexplode(windows(F.col("_t"), size, overlap, cap)).alias("chunk_no", "_c"))
    return chunks.select(key, "chunk_no", embed(F.array_join("_c", " ")).alias("vector"))


def refine(chunks: DataFrame, key: str, model: Callable[[np.ndarray], np.ndarray], order: str = "chunk_no") -> DataFrame:
    """(key, order, vector) after a model over each document's chunk vectors in order; a document has few chunks."""
    kinds = dict(chunks.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        vectors = model(np.stack(pdf["vector"].to_numpy()))
        return pd.DataFrame({key: pdf[key].to_numpy(), order: pdf[order].to_numpy(), "vector": [v.astype(np.float32) for v in vectors]})

    return chunks.select(key, order, "vector").groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, vector array<float>")


def weighted_pool(chunks: DataFrame, key: str, weight: Column) -> DataFrame:
    """(key, vector): chunk vectors summed with weights that add up to one in each document; without weight the plain mean."""
    return pooled_vectors(chunks, "mean", key, weight=weight)

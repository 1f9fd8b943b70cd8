"""Vector arithmetic as Column expressions and as numpy kernels."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors of equal length; null if either is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def usable(vector: Column, dim: int) -> Column:
    """The vector has ``dim`` values, none null, not all zero."""
    return F.coalesce((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def hash_embedding(dim: int = 64, prefix: str = ""):
    """Deterministic embedder: signed feature hashing of lower-case terms, unit length.

    Stands where a model would; any function from strings to vectors can take its place.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dim, np.float64)
            for term in (prefix + (text or "")).lower().split():
                h = zlib.crc32(term.encode())
                v[h % dim] += 1.0 if h & 0x40000000 else -1.0
            size = np.linalg.norm(v)
            out.append((v / size if size else v).astype(np.float32))
        return pd.Series(out)

    return embed

"""Sources: a paged catalogue, JSON and text collections, bulk pages of vectors.

The paged catalogue is a Python data source with one input partition per page,
so pages are fetched in parallel by executors. What fetches a page is a
function named ``module:function``; it takes offset, limit, from_time and to_time
and returns a list of dictionaries; ``module:function?text`` gives it the text as ``source``, too. A page that fails is halved until the single bad
row is left out; timeouts are tried again.
"""

from __future__ import annotations

import importlib
import json
from dataclasses import dataclass, replace
from functools import partial
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodeweave.runtime import written


class PageError(Exception):
    """The catalogue could not give a page as a whole."""


@dataclass(frozen=True)
class PageRequest:
    """A page of the catalogue; ``moved`` gives the same request for other bounds."""

    offset: int
    limit: int
    from_time: str | None = None
    to_time: str | None = None

    def moved(self, offset: int, limit: int) -> PageRequest:
        return replace(self, offset=offset, limit=limit)

    def parameters(self) -> dict[str, str]:
        """Query parameters; days are written without zero padding."""
        day = lambda t: "-".join(str(int(x)) for x in t[:10].split("-"))
        out = {"offset": str(self.offset), "limit": str(self.limit)}
        return out | ({"date_modified_after": day(self.from_time)} if self.from_time else {}) | ({"date_modified_before": day(self.to_time)} if self.to_time else {})

    def timeout(self, pause: float = 1.0) -> float:
        """Seconds to wait for the page; grows with its size."""
        return pause + int(self.limit * 0.06)


def page_step(window: int, overlap: float) -> int:
    """How far the next page begins after this one."""
    return max(1, int(window * (1 - overlap)))


def resolve(path: str):
    """The function named ``module:function``; what follows a ``?`` is passed as ``source``."""
    named, asked, source = path.partition("?")
    module, _, name = named.partition(":")
    function = getattr(importlib.import_module(module), name)
    return partial(function, source=source) if asked else function


def fetch_whole(fetch, page: PageRequest, attempts: int = 3) -> list[dict]:
    """Rows of a page; halves it where it fails, leaves out a single row that fails, repeats after a timeout."""
    for left in range(attempts - 1, -1, -1):
        try:
            return fetch(page.offset, page.limit, page.from_time, page.to_time)
        except TimeoutError:
            if not left:
                raise
        except PageError:
            if page.limit == 1:
                return []
            half = page.limit // 2
            return fetch_whole(fetch, page.moved(page.offset, half)) + fetch_whole(fetch, page.moved(page.offset + half, page.limit - half))
    return []


@dataclass
class _Page(InputPartition):
    offset: int
    limit: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.options, self.names = options, schema.fieldNames()

    def partitions(self):
        total, limit, overlap = int(self.options["total"]), int(self.options.get("limit", 1000)), float(self.options.get("overlap", 0.1))
        return [_Page(o, min(limit, total - o)) for o in range(0, max(total, 0), page_step(limit, overlap))]

    def read(self, partition):
        request = PageRequest(partition.offset, partition.limit, self.options.get("from_time"), self.options.get("to_time"))
        for row in fetch_whole(resolve(self.options["fetch"]), request):
            yield tuple(row.get(n) for n in self.names)


class PagedCatalogue(DataSource):
    """``spark.read.format("paged_catalogue")`` with the options fetch, schema, total, limit, overlap."""

    @classmethod
    def name(cls):
        return "paged_catalogue"

    def schema(self):
        return self.options["schema"]

    def reader(self, schema):
        return PagedReader(dict(self.options), schema)


def paged(spark: SparkSession, fetch: str, schema: str, total: int, limit: int = 1000, overlap: float = 0.1, key: str = "id") -> DataFrame:
    """The catalogue's rows, rows of overlapping pages once."""
    spark.dataSource.register(PagedCatalogue)
    rows = spark.read.format("paged_catalogue").option("fetch", fetch).option("schema", schema).option("total", total).option("limit", limit).option("overlap", overlap).load()
    return rows.dropDuplicates([key])


def numbers(offset: int, limit: int, from_time=None, to_time=None) -> list[dict]:
    """A catalogue that makes its rows up; its row 13 cannot be delivered."""
    if offset <= 13 < offset + limit:
        raise PageError(offset)
    return [{"id": i, "name": f"asset {i}"} for i in range(offset, offset + limit)]


def asset_rows(offset: int, limit: int, from_time=None, to_time=None, source: str = "") -> list[dict]:
    """A page of a Parquet table of assets by position, over its files in the order of their names."""
    path, rows, start = Path(source), [], 0
    for file in sorted(path.rglob("*.parquet")) if path.is_dir() else [path]:
        with pq.ParquetFile(file) as table:
            for group in range(table.num_row_groups):
                end = start + table.metadata.row_group(group).num_rows
                if start < offset + limit and offset < end:
                    part = table.read_row_group(group, ["identifier", "platform", "name"])
                    part = part.slice(max(0, offset - start), min(end, offset + limit) - max(start, offset))
                    rows += [r | {"id": r["identifier"]} for r in part.to_pylist()]
                start = end
    return rows


def json_table(spark: SparkSession, paths: str | list[str], schema: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected texts) of JSON files; a record that does not fit the schema is rejected, not fatal."""
    rows = written(spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(paths, multiLine=multi_line))  # parsed once for both results
    return rows.where("_corrupt is null").drop("_corrupt"), rows.where("_corrupt is not null").select("_corrupt")


def text_files(spark: SparkSession, path: str, include: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) of a folder with one text file per document; the file's name is its id."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))
    return rows if include is None else rows.join(include.select("doc_id").distinct(), "doc_id", "left_semi")


def bulk_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(page, pos, asset_id, vector) of ``page_N.npz`` and ``page_N.json`` pairs; incomplete or unequal pairs are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "page_*").load(path)
    named = files.select(F.regexp_extract("path", r"page_(\d+)\.(npz|json)$", 1).cast("long").alias("page"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("kind"), "content").where("page is not null")
    both = named.groupBy("page").agg(F.max(F.when(F.col("kind") == "npz", F.col("content"))).alias("v"), F.max(F.when(F.col("kind") == "json", F.col("content"))).alias("i")).where("v is not null and i is not null")

    def unpack(batches):
        import io

        for pdf in batches:
            for page, v, i in zip(pdf["page"], pdf["v"], pdf["i"]):
                try:
                    vectors, ids = np.load(io.BytesIO(v))["vectors"], json.loads(i)
                except (ValueError, KeyError, OSError):
                    continue
                if len(vectors) == len(ids):
                    yield pd.DataFrame({"page": page, "pos": range(len(ids)), "asset_id": ids, "vector": [x.astype(np.float32) for x in vectors]})

    return both.mapInPandas(unpack, "page long, pos int, asset_id string, vector array<float>")


def apply_safely(df: DataFrame, function: str, column: str, attempts: int = 3, backup: str | None = None) -> DataFrame:
    """The frame with ``result`` and ``error`` of a function over a text column: tried ``attempts`` times, then the backup once."""
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(batches):
        first, second = resolve(function), resolve(backup) if backup else None
        for pdf in batches:
            results, errors = [], []
            for text in pdf[column]:
                result, error = None, None
                for f in [first] * attempts + ([second] if second else []):
                    try:
                        result, error = f(text), None
                        result = None if result is None else str(result)
                        if result is not None:
                            break
                    except Exception as e:  # a function of a user's may raise anything
                        error = repr(e)
                results.append(result)
                errors.append(error)
            yield pdf.assign(result=results, error=errors)

    return df.mapInPandas(run, f"{fields}, result string, error string")

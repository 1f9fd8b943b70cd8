import numpy as np
from pyspark.sql import functions as F

from lodeweave.functions.vector import hash_embedding
from lodeweave.operators import embedding as em
from lodeweave.operators import normalise as no
from lodeweave.operators import store as st
from lodeweave.plans import text_queries


def test_embedding(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, "  "), (4, "x")], "doc_id long, text string")
    whole = {r["doc_id"]: r["vector"] for r in em.embed_whole(docs, "doc_id", "text", hash_embedding(8), 2).collect()}
    same = {r["doc_id"]: r["vector"] for r in em.embed_whole(docs.withColumn("text", F.lit("one two")), "doc_id", "text", hash_embedding(8)).collect()}
    assert set(whole) == {1, 4} and whole[1] == same[1]
    chunks = em.embed_chunks(docs, "doc_id", "text", hash_embedding(8), size=4, overlap=0.25)
    assert {(r["doc_id"], r["chunk_no"]) for r in chunks.collect()} == {(1, 0), (1, 1), (4, 0)}
    assert all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-5 for r in chunks.collect())
    doubled = {(r["doc_id"], r["chunk_no"]): r["vector"] for r in em.refine(chunks, "doc_id", lambda m: m * 2).collect()}
    assert all(np.allclose(doubled[r["doc_id"], r["chunk_no"]], 2 * np.array(r["vector"])) for r in chunks.collect())
    c = spark.createDataFrame([("a", 1.0, [1.0, 0.0]), ("a", 3.0, [0.0, 1.0]), ("b", None, [2.0, 2.0])], "k string, w double, vector array<double>")
    assert {r["k"]: r["vector"] for r in em.weighted_pool(c, "k", F.col("w")).collect()} == {"a": [0.25, 0.75], "b": [2.0, 2.0]}


def test_long_documents_are_embedded_whole(spark, tmp_path):
    words = [f"w{i}" for i in range(1400)]
    spark.createDataFrame([(1, " ".join(words)), (2, "short"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    chunks = {(r["doc_id"], r["chunk_no"]): r["vector"] for r in text_queries.embed_documents(spark, str(tmp_path)).collect()}
    assert set(chunks) == {(1, i) for i in range(19)} | {(2, 0)}
    last = spark.createDataFrame([(" ".join(words[1350:]),)], "t string").select(hash_embedding(64)("t").alias("v")).first()["v"]
    assert chunks[1, 18] == last
    pooled = {r["doc_id"]: r["vector"] for r in text_queries.pooled_document_vectors(spark, str(tmp_path)).collect()}
    assert set(pooled) == {1, 2} and np.allclose(pooled[1], np.mean([chunks[1, i] for i in range(19)], axis=0), atol=1e-6)


def test_normalise(spark):
    values = spark.createDataFrame([("Engish",), ("ENGLISH ",), ("deutsch",), ("zzz",), (None,), ("",)], "value string")
    allowed = spark.createDataFrame([("english",), ("german",)], "allowed string")
    got = {r["value"]: (r["normalised"], r["edits"]) for r in no.to_allowed(values, allowed, aliases={"deutsch": "german"}).collect()}
    assert got == {"engish": ("english", 1), "english": ("english", 0), "deutsch": ("german", 0), "zzz": (None, None), "": (None, None)}


def test_documents(spark):
    d = st.Documents(spark.createDataFrame([(1, "a"), (2, None)], "id long, v string"))
    d = d.create(spark.createDataFrame([(1, "zz"), (3, "c")], "id long, v string")).replace(spark.createDataFrame([(3, "d")], "id long, v string"))
    assert {tuple(r) for r in d.rows.collect()} == {(1, "a"), (2, None), (3, "d")}
    assert {r["id"] for r in d.delete(F.col("v") == "a").rows.collect()} == {2, 3}
    assert d.get(3).first()["v"] == "d" and d.get(9).count() == 0
    assert [r["id"] for r in d.find(F.lit(True), [F.col("id").desc()], 1).collect()] == [3]

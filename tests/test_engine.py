import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodeweave.engine import Engine, Expired, NotFound, rerank, result_of
from lodeweave.functions.vector import hash_embedding
from lodeweave.operators import vector_store
from lodeweave.plans.filter_dsl import Expression, Filter, compile_filters, condition
from lodeweave.schema import Registry
from lodeweave.sources import sinks
from lodeweave.streaming import status

NAMES = ["red apple pie", "green apple tart", "blue whale song", "crop row photos", "tram delay table"]


@pytest.fixture(scope="module")
def engine(spark):
    kinds = ["datasets", "datasets", "news", "datasets", "ml_models"]
    assets = spark.createDataFrame([(f"a{i}", n, k) for i, (n, k) in enumerate(zip(NAMES, kinds))], "identifier string, name string, type string")
    docs = assets.select(F.col("identifier").alias("asset_id"), F.col("type").alias("asset_type"), "name")
    chunks = sinks.chunk_rows(docs, F.col("name"), hash_embedding(64), size=8).withColumn("id", F.xxhash64("asset_id", "chunk_no"))
    metadata = spark.createDataFrame([("a0", "mit", 5), ("a1", "apache", 50), ("a3", "mit", 500)], "asset_id string, license string, datapoint_count long")
    return Engine(chunks.cache(), assets, metadata)


def _ask(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")


def test_search_and_filters(spark, engine):
    hits = {(r["query_id"], r["rank"]): r["asset_id"] for r in engine.search(_ask(spark, "apple pie red", "whale song"), 2).collect()}
    assert hits["0", 1] == "a0" and hits["0", 2] == "a1" and hits["1", 1] == "a2" and ("2", 1) not in hits
    small = [Filter("datapoint_count", "AND", (Expression(10, ">"),)), Filter("license", "AND", (Expression("MIT", "=="),))]
    assert [r["asset_id"] for r in engine.filtered_search(_ask(spark, "apple"), small, "datasets").collect()] == ["a3"]
    parsing = Engine(engine.chunks, engine.assets, engine.metadata, parse=lambda t: [{"field": "license", "expressions": [{"value": "apache", "comparison_operator": "=="}]}, {"field": "nope", "expressions": []}])
    assert [r["asset_id"] for r in parsing.filtered_search(_ask(spark, "apple"), None, "datasets").collect()] == ["a1"]
    failing = Engine(engine.chunks, engine.assets, engine.metadata, parse=lambda t: 1 / 0)
    assert failing.filtered_search(_ask(spark, "apple"), None, "datasets").count() == 3
    for bad in (lambda: engine.search(_ask(spark, "x", " "), 2), lambda: engine.search(_ask(spark, "x" * 201), 2), lambda: engine.filtered_search(_ask(spark, "x", None), [], "datasets"), lambda: engine.search(_ask(spark, "x"), 0), lambda: engine.search(_ask(spark, "x"), 5, "projects"), lambda: engine.filtered_search(_ask(spark, "x"), [], "all")):
        with pytest.raises(ValueError):
            bad()


def test_each_query_is_filtered_by_its_own_text(spark, engine):
    wanted = lambda t: [{"field": "license", "expressions": [{"value": t.split()[-1], "comparison_operator": "=="}]}]
    parsing = Engine(engine.chunks, engine.assets, engine.metadata, parse=wanted)
    got = parsing.filtered_search(_ask(spark, "apple mit", "apple apache", "apple unknown"), None, "datasets").collect()
    assert {(r["query_id"], r["asset_id"]) for r in got} == {("0", "a0"), ("0", "a3"), ("1", "a1")}
    many = Engine(engine.chunks, engine.assets, engine.metadata, parse=lambda t: wanted(t) * 6)
    with pytest.raises(ValueError):
        many.filtered_search(_ask(spark, "apple mit"), None, "datasets")


def test_vector_store(spark, engine, tmp_path):
    held = vector_store.ParquetStore(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a", 0, "news"), (2, [0.0, 1.0], "b", 0, "news")], held.schema)
    assert not held.exists("news") and held.read("news").count() == 0
    held.upsert("news", rows)
    held.upsert("news", rows.where("id = 2").withColumn("asset_version", F.lit(3).cast("long")))
    query = spark.createDataFrame([("q", [0.1, 1.0])], "query_id string, vector array<float>")
    assert [r["asset_id"] for r in held.top_assets("news", query, 5, dim=2).collect()] == ["b", "a"]
    assert [r["asset_id"] for r in held.top_assets("news", query, 5, F.col("asset_version") == 0, 2).collect()] == ["a"]
    gone = spark.createDataFrame([("b",), ("zz",)], "asset_id string")
    assert [tuple(r) for r in held.remove("news", gone).collect()] == [("b", 3, 1)] and held.remove("news", gone).count() == 0
    assert [r[0] for r in held.asset_ids("news").collect()] == ["a"] and held.vectors("news", rows).count() == 1


def test_allowed_values(spark):
    listed = spark.createDataFrame([("base", "license", "MIT"), ("base", "license", "apache-2.0"), ("news", "license", "own")], "asset_type string, field string, value string")
    fields = Registry.of("datasets").with_values(listed)
    assert fields["license"].values == ("MIT", "apache-2.0") and fields["platform"].values is None
    raw = lambda v: {"field": "license", "expressions": [{"value": v, "comparison_operator": "=="}]}
    assert condition(raw("Apache 2.0"), fields).expressions[0].value == "apache-2.0" and condition(raw("apachee-2.0"), fields).expressions[0].value == "apache-2.0"
    assert condition(raw("own"), fields) is None
    with pytest.raises(ValueError):
        compile_filters([Filter.parse(raw("own"))], fields)


def test_recommend_context_and_entire(spark, engine):
    seed = spark.createDataFrame([("a0",)], "asset_id string")
    assert "a0" not in {r["asset_id"] for r in engine.recommend(seed, 3, "datasets").collect()}
    assert "a0" in {r["asset_id"] for r in engine.recommend(seed, 3, "all").collect()}
    assert engine.recommend(spark.createDataFrame([("zz",)], "asset_id string"), 3).count() == 0
    assert engine.context(_ask(spark, "whale song"), 1).first()["context"] == "Result 0:\nblue whale song\nlink:a2\n"
    assert engine.search(_ask(spark, "whale song"), 1, entire=True).first()["asset"]["name"] == "blue whale song"
    hits = engine.search(_ask(spark, "apple"), 3)
    assert rerank(hits, F.col("distance")).count() == 3 and Engine.field_schema("datasets")


def test_results_expire(spark):
    log = spark.createDataFrame([("a", dt.datetime(2020, 1, 1)), ("b", None)], "query_id string, expires_at timestamp_ntz")
    now = F.lit("2021-01-01").cast("timestamp_ntz")
    assert result_of(log, "b", now).count() == 1
    with pytest.raises(Expired):
        result_of(log, "a", now)
    with pytest.raises(NotFound):
        result_of(log, "c", now)


def test_sinks(spark, engine, tmp_path):
    path = str(tmp_path / "chunks")
    sinks.write_chunks(engine.chunks, path)
    plan = spark.read.parquet(path).where("asset_type = 'news'")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(asset_type" in plan._jdf.queryExecution().toString()
    cache = spark.createDataFrame([("q1", "a"), ("q2", "b")], "query_id string, doc_id string")
    sinks.write_json(cache, str(tmp_path / "cache"), "query_id")
    schema = "query_id string, doc_id string"
    assert sinks.read_cached(spark, str(tmp_path / "cache"), schema, cache.select("query_id")).count() == 2
    with pytest.raises(LookupError):
        sinks.read_cached(spark, str(tmp_path / "cache"), schema, spark.createDataFrame([("q9",)], "query_id string"))
    assert sinks.with_json(cache, "query_id").where("query_id = 'q1'").first()["json"] == '{"query_id":"q1","doc_id":"a"}'
    texts = spark.createDataFrame([('{"a": 1}',), ("oops",), ('{"b": 2}',)], "t string")
    assert [r["ok"] for r in sinks.parse_checked(texts, "t", "a int, b int", ["a"]).collect()] == [True, False, False]
    sinks.write_texts(cache, "query_id", F.col("doc_id"), str(tmp_path / "texts"))
    assert spark.read.text(str(tmp_path / "texts")).count() == 2
    assert spark.read.parquet(sinks.swap(cache, str(tmp_path / "v"), 1)).count() == 2
    empty = spark.createDataFrame([("x", None), ("y", "")], "asset_id string, name string")
    assert sinks.chunk_rows(empty, F.col("name"), hash_embedding(8)).count() == 0


def test_status_machine(spark, tmp_path):
    assert status.advance(None, ["Queued", "In_progress", "Completed", "Queued"]) == ("Completed", 1)
    assert status.advance("Queued", ["Completed"]) == ("Queued", 1)
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    spark.createDataFrame([("a", "In_progress", at(2)), ("a", "Queued", at(1)), ("b", "Queued", at(1)), ("b", "Completed", at(2))], "query_id string, status string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id string, status string, at timestamp").parquet(str(tmp_path / "in"))
    rows = []
    q = status.track(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    # Timers keep such a stream running, so it is stopped once it has spoken.
    for _ in range(60):
        if rows or q.awaitTermination(1):
            break
    q.stop()
    assert {(r["query_id"], r["status"], r["refused"]) for r in rows if not r["expired"]} == {("a", "In_progress", 0), ("b", "Queued", 1)}

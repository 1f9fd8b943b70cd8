import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.functions import text as tx
from lodeweave.operators import evaluate as ev
from lodeweave.operators import ingest as ig
from lodeweave.operators import lifecycle as lc
from lodeweave.operators import store as st
from lodeweave.plans import stream_queries
from lodeweave.schema import FieldSpec, Registry
from lodeweave.sources import catalogue as ct
from lodeweave.streaming import ingest as si


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def test_windows(spark):
    f = lambda n, cap=None: [len(w) for w in one(spark, list(range(n)), lambda c: tx.windows(c, 4, 0.25, cap), "array<int>")]
    assert f(0) == [0] and f(3) == [3] and f(4) == [4] and f(5) == [4, 2] and f(10) == [4, 4, 4] and f(11, 2) == [4, 4]
    covered = one(spark, list(range(23)), lambda c: tx.windows(c, 4, 0.25), "array<int>")
    assert sorted({x for w in covered for x in w}) == list(range(23))


def test_html(spark):
    page = '<html><head><meta content="2024-05-01" property="article:modified_time"/></head><body>x</body></html>'
    dated = '<span class="git-revision-date-localized-plugin git-revision-date-localized-plugin-datetime">May <b>2</b></span>'
    assert one(spark, page, tx.last_modified) == "2024-05-01" and one(spark, dated, tx.last_modified) == "May 2" and one(spark, "<p>", tx.last_modified) == ""
    assert one(spark, '<meta name="x-dont-crawl" content="True">', tx.crawlable) is False and one(spark, "<p>", tx.crawlable) is True
    assert one(spark, "https://api.example/x", tx.page_route) == "api" and one(spark, "https://site.example", tx.page_route) == "website"


def test_text_fields(spark):
    kind = "struct<plain string, html string>"
    assert one(spark, ("p", "<i>h</i>"), tx.text_of, kind) == "p  h "
    assert one(spark, ("p", "<i>h</i>"), lambda c: tx.text_of(c, True), kind) == "p"
    assert one(spark, (None, "h"), tx.text_of, kind) == "h" and one(spark, (None, None), tx.text_of, kind) is None and one(spark, None, tx.text_of, kind) is None
    assert one(spark, "cc-by-nc-sa-4.0", tx.simplify_licence) == "cc-by-nc-sa" and one(spark, "x-openrail-m", tx.simplify_licence) == "openrail" and one(spark, "zzz", tx.simplify_licence) is None
    assert one(spark, ["b:1", "a:2:3", "a:2", "a:1", None], lambda c: tx.keyword_values(c, "a"), "array<string>") == ["1", "2"]
    assert one(spark, " A, ,b ", tx.csv_values) == ["a", "b"] and one(spark, "Datasett", tx.closest_type) == "datasets"
    assert one(spark, "x <function=f>{\"a\": 1}</function>", tx.function_call)["arguments"] == '{"a": 1}' and one(spark, "no", tx.function_call) is None
    assert one(spark, "2024-01-05T00:00:00", tx.day_key) == "2024-1-5"


def _chunks(spark):
    return spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 0), (4, None, 0)], "id long, asset_id string, asset_version long")


def test_store(spark):
    stored = _chunks(spark)
    kept, gone = st.delete(stored, spark.createDataFrame([("a",), (None,)], "asset_id string"))
    assert {r["id"] for r in kept.collect()} == {3, 4} and [tuple(r) for r in gone.collect()] == [("a", 1, 2)]
    new = spark.createDataFrame([(2, "a", 9), (7, "c", 0)], "id long, asset_id string, asset_version long")
    once = st.upsert(stored, new)
    assert sorted(map(str, st.upsert(once, new).collect())) == sorted(map(str, once.collect())) and once.count() == 5
    assert {tuple(r) for r in st.next_versions(stored, spark.createDataFrame([("a",), ("z",)], "asset_id string")).collect()} == {("a", 2), ("z", 0)}
    registry = Registry([FieldSpec("license", max_length=3)])
    good, bad = st.with_fallback(spark.createDataFrame([(1, "mit"), (2, "long licence"), (None, "mit"), (3, None)], "id long, license string"), registry, F.col("id").isNotNull())
    assert {(r["id"], r["license"], r["metadata_kept"]) for r in good.collect()} == {(1, "mit", True), (2, None, False), (3, None, True)} and bad.count() == 1
    pages = spark.createDataFrame([(1, ["x", "y"], [[1.0], [2.0]]), (2, ["x"], [[1.0], [2.0]]), (3, None, [[1.0]])], "page int, asset_ids array<string>, vectors array<array<double>>")
    assert [(r["page"], r["pos"], r["asset_id"]) for r in st.bulk_pairs(pages).orderBy("pos").collect()] == [(1, 0, "x"), (1, 1, "y")]


def test_numbering_and_pages(spark):
    df = spark.range(57).withColumn("k", F.col("id") % 7)
    got = [r["row_no"] for r in st.number_rows(df, ["k", "id"]).orderBy("k", "id").collect()]
    assert got == list(range(57))
    counts = {r["page"]: r["n"] for r in st.pages(df, ["k", "id"], 10, 0.2).groupBy("page").agg(F.count("*").alias("n")).collect()}
    assert counts[0] == 10 and sum(counts.values()) > 57
    assert {(r["page"], r["complete"]) for r in st.page_completeness(df, ["id"], 10).collect()} == {(i, i < 5) for i in range(6)}
    assert st.number_rows(df.limit(0), ["id"]).count() == 0


def test_change_data(spark):
    catalogue = spark.createDataFrame([("a", 1), ("a", 1), ("b", 5), ("c", 9), (None, 1)], "asset_id string, m int")
    stored = spark.createDataFrame([("a",), ("b",), ("old",), (None,)], "asset_id string")
    assert {r[0] for r in ig.new_assets(catalogue, stored).collect()} == {"c"}
    assert {r[0] for r in ig.changed_assets(catalogue, stored, F.col("m"), F.lit(5)).collect()} == {"b"}
    assert {r[0] for r in ig.stale_assets(stored, catalogue).collect()} == {"old"}
    old = spark.createDataFrame([("u", "1"), ("v", "1"), ("w", "1")], "url string, last_modified string")
    new = spark.createDataFrame([("u", "1"), ("v", "2"), ("x", None)], "url string, last_modified string")
    assert {tuple(r) for r in ig.crawl_delta(old, new).collect()} == {("u", "keep"), ("v", "update"), ("w", "delete"), ("x", "insert")}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert {tuple(r) for r in ig.reach(links, spark.createDataFrame([("a",)], "node string"), 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_collection_log(spark):
    kind = "asset_type string, setup struct<embeddings_added long>, recurring array<struct<embeddings_added long, embeddings_removed long>>"
    df = spark.createDataFrame([("t", (5,), [(2, 1), (0, 0), (3, 0), (0, 0)]), ("u", (1,), [])], kind)
    assert {tuple(r) for r in ig.embedding_count(df).collect()} == {("t", 9), ("u", 1)}
    pruned = {r[0]: [tuple(x) for x in r[1]] for r in df.select("asset_type", ig.prune_updates(F.col("recurring"))).collect()}
    assert pruned == {"t": [(2, 1), (3, 0), (0, 0)], "u": []}


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, "a", 5.0), ("q", 2, "b", 1.0), ("q", 3, "c", 5.0), ("z", 1, "a", 0.0)], "query_id string, rank int, doc_id string, score double")
    totals = spark.createDataFrame([("q", 4), ("z", 0)], "query_id string, relevant_total long")
    rel = F.col("score") >= 3
    pr = {(r["query_id"], r["k"]): (r["precision"], r["recall"]) for r in ev.precision_recall(ranked, totals, rel, (2, 5)).collect()}
    assert pr == {("q", 2): (0.5, 0.25), ("q", 5): (0.4, 0.5), ("z", 2): (0.0, 0.0), ("z", 5): (0.0, 0.0)}
    ap = {r[0]: r[1] for r in ev.average_precision(ranked, totals, rel, 10).collect()}
    assert abs(ap["q"] - (1 + 2 / 3) / 4) < 1e-9 and ap["z"] == 0
    g = {r[0]: r[1] for r in ev.ndcg(ranked, 10).collect()}
    want = (5 + 1 / np.log2(3) + 5 / 2) / (5 + 5 / np.log2(3) + 1 / 2)
    assert abs(g["q"] - want) < 1e-9 and g["z"] == 0
    hits = {r["k"]: (r["hit_rate"], r["position"]) for r in ev.hit_rate(ranked, ranked, rel, (1, 5)).collect()}
    assert hits == {1: (0.5, 0.0), 5: (0.5, 0.0)}
    score = lambda c: one(spark, c, ev.heuristic_score, "array<struct<mandatory boolean, met boolean>>")
    assert score([(True, True), (True, False), (False, True)]) == 0.75 and score([(False, True)]) is None and score([(True, True)]) == 1.0
    bucket = lambda n, t: spark.range(1).select(ev.quality_bucket(F.lit(n), F.lit(t))).first()[0]
    assert [bucket(1001, 11), bucket(1001, 2), bucket(200, 11), bucket(49, 11), bucket(1001, 5), bucket(600, 11)] == ["long_many", "long_few", "short_many", "tiny_many", None, None]


def test_pooling_and_attempts(spark):
    c = spark.createDataFrame([("a", 2, [1.0, 4.0]), ("a", 1, [3.0, 0.0])], "asset_id string, id long, vector array<float>")
    assert [ev.pooled_vectors(c, h).first()["vector"] for h in ("mean", "max", "cls")] == [[2.0, 2.0], [3.0, 4.0], [3.0, 0.0]]
    t = spark.createDataFrame([("x", 1, 1, 2), ("x", 2, 2, 2), ("x", 3, 3, 3), ("y", 1, 1, 3), ("y", 2, 2, 3)], "k string, a int, v int, n int")
    assert {(r["k"], r["a"]) for r in ev.best_attempt(t, "k", "v", "n", "a").collect()} == {("x", 2), ("y", 2)}


def test_lifecycle(spark):
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("a", "Queued", at), ("b", "in progress ", at), ("c", "Completed", at), ("d", "odd", at), ("e", None, at)], "query_id string, status string, updated_at timestamp_ntz")
    assert [r["query_id"] for r in lc.open_queries(log).collect()] == ["b", "a"]
    done = {r[0]: r[1] for r in log.select("query_id", lc.expires_at(F.col("status"), F.col("updated_at"), 10)).collect()}
    assert done["c"] == dt.datetime(2024, 1, 1, 0, 10) and done["a"] is None
    assert spark.range(1).select(lc.is_expired(F.lit(None).cast("timestamp"), F.current_timestamp())).first()[0] is False


def test_sources(spark, tmp_path):
    got = ct.paged(spark, "lodeweave.sources.catalogue:numbers", "id long, name string", total=95, limit=20, overlap=0.1)
    assert {r["id"] for r in got.collect()} == set(range(95)) - {13}
    assert ct.PageRequest(0, 1000, "2024-01-05").parameters() == {"offset": "0", "limit": "1000", "date_modified_after": "2024-1-5"} and ct.PageRequest(0, 1000).timeout() == 61
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"id": 1, "name": "x"}\n{"id": oops}\n')
    rows, bad = ct.json_table(spark, str(tmp_path / "j"), "id long, name string")
    assert rows.count() == 1 and bad.count() == 1
    (tmp_path / "t").mkdir()
    for n in "ab":
        (tmp_path / "t" / f"{n}.txt").write_text(f"text {n}\nmore")
    only = spark.createDataFrame([("b",)], "doc_id string")
    assert [tuple(r) for r in ct.text_files(spark, str(tmp_path / "t"), only).collect()] == [("b", "text b\nmore")]
    (tmp_path / "v").mkdir()
    for page, (n, m) in enumerate([(2, 2), (2, 3)]):
        np.savez(tmp_path / "v" / f"page_{page}.npz", vectors=np.ones((n, 4), np.float32))
        (tmp_path / "v" / f"page_{page}.json").write_text(json.dumps([f"id{i}" for i in range(m)]))
    assert [(r["page"], r["asset_id"]) for r in ct.bulk_vectors(spark, str(tmp_path / "v")).orderBy("pos").collect()] == [(0, "id0"), (0, "id1")]
    df = spark.createDataFrame([("1",), ("x",)], "t string")
    got = {r["t"]: (r["result"], r["error"] is None) for r in ct.apply_safely(df, "json:loads", "t").selectExpr("t", "result", "error").collect()}
    assert got["1"] == ("1", True) and got["x"][0] is None and not got["x"][1]


def test_fetching_again_after_timeouts():
    calls = []

    def slow(offset, limit, a, b):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return [{"id": offset}]

    assert ct.fetch_whole(slow, ct.PageRequest(4, 1)) == [{"id": 4}] and len(calls) == 3


def test_merge_stream_is_idempotent(spark, tmp_path):
    for n, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "a2", 2), (2, "old", 0), (3, "c", 1)], [(1, "a2", 2)]]):
        spark.createDataFrame(rows, "k long, v string, o int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k long, v string, o int").parquet(str(tmp_path / "in"))
        si.merge_into(spark, stream, str(tmp_path / "out"), "k", "o", str(tmp_path / "state")).awaitTermination()
    want = {(1, "a2", 2), (2, "b", 1), (3, "c", 1)}
    assert {tuple(r) for r in si.merged(spark, str(tmp_path / "out"), "k", "o").collect()} == want
    si.compact(spark, str(tmp_path / "out"), str(tmp_path / "new"), "k", "o", 1)
    assert {tuple(r) for r in si.merged(spark, str(tmp_path / "new"), "k", "o").collect()} == want
    assert len(list((tmp_path / "new").glob("batch=*"))) == 2


def test_sessions(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([("u", at(0)), ("u", at(3)), ("u", at(30)), ("w", at(1))], "user string, ts timestamp_ntz")
    assert sorted((r["user"], r["n"]) for r in si.session_windows(df, "ts", "5 minutes", ["user"]).collect()) == [("u", 1), ("u", 2), ("w", 1)]


def test_paged_scan_pages_all_assets(spark, tmp_path):
    rows = [(f"a{i:04d}", "p", f"asset {i}") for i in range(2500)] + [("a0000", "p", "asset 0")]
    spark.createDataFrame(rows, "identifier string, platform string, name string").repartition(3).write.parquet(str(tmp_path / "assets.parquet"))
    spark.createDataFrame([(1,)], "r int").write.parquet(str(tmp_path / "region.parquet"))
    got = stream_queries.paged_scan(spark, str(tmp_path)).select("id", "platform", "name").collect()
    assert sorted(tuple(r) for r in got) == rows[:2500]


def test_row_numbers_of_many_rows_with_a_payload(spark):
    # More rows than the sample of the ranges holds, and columns beyond the order.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(6_000_000).select((F.xxhash64("id") % 1_000_000).alias("k"), "id", F.lit("payload").alias("p"))
        got = st.number_rows(rows, ["k", "id"]).agg(F.countDistinct("row_no"), F.min("row_no"), F.max("row_no")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(got) == (6_000_000, 0, 5_999_999)


def test_crawl_rule(spark):
    pages = {"https://a.org/x": True, "https://www.a.org/y.html": True, "https://a.org": True, "https://b.org/x": False, "https://a.org/f.pdf?x=1": False, "https://a.org/no/x": False, "https://nota.org/": False, None: False}
    df = spark.createDataFrame([(p,) for p in pages], "node string")
    got = {r["node"]: r["ok"] for r in df.select("node", ig.crawl_rule("a.org", ("https://a.org/no",)).alias("ok")).collect()}
    assert got == pages


def test_missing_annotation_is_an_error(spark):
    results = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, doc_id string")
    notes = spark.createDataFrame([("q", "a", 5), ("q", "b", 1)], "query_id string, doc_id string, score int")
    assert ev.annotated(results, notes, ["query_id", "doc_id"]).count() == 2
    with pytest.raises(LookupError):
        ev.annotated(results, notes.where("score = 5"), ["query_id", "doc_id"])

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.operators import search as se


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), f"a{i % 37:02d}", "t1" if i % 2 else "t2") for i in range(400)]
    rows += [(400, rows[3][1], "a99", "t1"), (401, rows[3][1], "a98", "t2"), (402, rows[5][1], None, None)]
    return spark.createDataFrame(rows, "id long, vector array<float>, asset_id string, asset_type string").repartition(5).cache()


def _queries(corpus):
    return corpus.where("id % 40 = 3").select(F.col("id").alias("query_id"), "vector", "asset_type")


def _brute(corpus, k):
    rows = corpus.collect()
    x = np.array([r["vector"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r["id"] for r in rows])
    sims = {i: {j: round(float(s), 9) for j, s in zip(ids, x @ x[n])} for n, i in enumerate(ids)}
    return rows, sims


def test_top_k_with_ties(corpus):
    _, sims = _brute(corpus, 5)
    for how in (se.top_k, se.top_k_expression):
        got = {}
        for r in how(_queries(corpus), corpus, 5).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
        for q, hits in got.items():
            want = sorted(sims[q], key=lambda j: (-sims[q][j], j))[:5]
            assert [i for _, i in sorted(hits)] == want


def test_blocked_path_gives_the_same(corpus, monkeypatch):
    plain = sorted(map(tuple, se.grouped_top_k(_queries(corpus), corpus, 4).collect()))
    monkeypatch.setattr(se, "MAX_BROADCAST", 0)
    monkeypatch.setattr(se, "QUERY_BLOCK", 3)
    monkeypatch.setattr(se, "CORPUS_BLOCK", 100)
    assert sorted(map(tuple, se.grouped_top_k(_queries(corpus), corpus, 4).collect())) == plain


def test_grouped_and_filtered(corpus):
    rows, sims = _brute(corpus, 4)
    asset = {r["id"]: r["asset_id"] for r in rows}
    kind = {r["id"]: r["asset_type"] for r in rows}

    def want(q, keep, k=4):
        best = {}
        for j, s in sims[q].items():
            if asset[j] is not None and keep(j):
                best[asset[j]] = max(best.get(asset[j], -2), s)
        return sorted(best, key=lambda a: (-best[a], a))[:k]

    def got(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["query_id"], []).append((r["rank"], r["asset_id"]))
        return {q: [a for _, a in sorted(v)] for q, v in out.items()}

    plain = got(se.grouped_top_k(_queries(corpus), corpus, 4))
    assert plain == {q: want(q, lambda j: True) for q in plain}
    tagged = got(se.grouped_top_k(_queries(corpus).withColumn("tag", F.col("asset_type")), corpus.where("asset_type is not null").withColumn("tag", F.col("asset_type")), 4, True))
    assert tagged == {q: want(q, lambda j: kind[j] == kind[q]) for q in tagged}
    catalogue = corpus.select("asset_id").where("asset_id > 'a20'")
    known = {r["asset_id"] for r in catalogue.collect()}
    assert got(se.validated(_queries(corpus), corpus, catalogue, 4)) == {q: want(q, lambda j: asset[j] in known) for q in plain}
    banned = corpus.sparkSession.createDataFrame([(q, a) for q, v in plain.items() for a in v[:2]], "query_id long, asset_id string")
    shut = {(r["query_id"], r["asset_id"]) for r in banned.collect()}
    assert got(se.excluding(_queries(corpus), corpus, banned, 4, 2)) == {q: want(q, lambda j: (q, asset[j]) not in shut) for q in plain}
    union = got(se.fan_out(_queries(corpus).drop("asset_type"), corpus, 4).withColumn("asset_id", F.col("asset_id")))
    assert all(len(v) == 4 for v in union.values())


def test_refill_rounds_can_underfill(spark):
    """Nine valid hits, then five invalid ones: every round fetches only what is missing."""
    angle = lambda i: [float(np.cos(i / 40)), float(np.sin(i / 40))]
    corpus = spark.createDataFrame([(i, angle(i), f"a{i:02d}", "t") for i in range(20)], "id long, vector array<float>, asset_id string, asset_type string")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    catalogue = spark.createDataFrame([(f"a{i:02d}",) for i in range(20) if not 9 <= i < 14], "asset_id string")
    assert se.validated_rounds(queries, corpus, catalogue, 10).count() == 9
    assert se.validated(queries, corpus, catalogue, 10).count() == 10


def test_recommend_overfetch_and_empty(corpus):
    seeds = corpus.where("id = 7").select("asset_id")
    same = se.recommend(seeds, corpus, 5, True).collect()
    assert "a07" not in {r["asset_id"] for r in same} and len(same) == 5
    assert "a07" in {r["asset_id"] for r in se.recommend(seeds, corpus, 5, False).collect()}
    assert se.overfetch(_queries(corpus), corpus, 3).groupBy("query_id").count().where("count > 3").count() == 0
    assert se.top_k(_queries(corpus).limit(0), corpus, 3).count() == 0
    assert se.grouped_top_k(_queries(corpus), corpus.limit(0), 3).count() == 0
    assert se.existing(corpus.sparkSession, "no_such_table", "id long").count() == 0


def test_unusable_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    assert {r["id"] for r in se.usable_chunks(df, 2).collect()} == {1} and se.distinct_chunks(df, 2).count() == 1


def test_repeated_rows_take_one_place(spark):
    # The nearest vectors are delivered three times each, within and across batches.
    rows = [(i, [1.0, i / 100], f"a{i}") for i in range(40) for _ in range(3)] + [(0, [0.0, 1.0], "a0")]
    df = spark.createDataFrame(rows, "id long, vector array<float>, asset_id string").repartition(3)
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    for search in (se.top_k, se.top_k_expression):
        assert [r["id"] for r in search(asked, df, 10).orderBy("rank").collect()] == list(range(10))


def test_filters_reach_the_scan(spark, tmp_path):
    from lodeweave.plans import search_queries as sq

    rows = [(i, [1.0] * 64, "a", i % 4, "datasets") for i in range(100)]
    spark.createDataFrame(rows, "id long, vector array<float>, asset_id string, asset_version long, asset_type string").write.parquet(str(tmp_path / "chunk_vectors.parquet"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = sq.filtered_topk(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(asset_version,2)" in plan and "In(asset_type, [datasets,ml_models])" in plan
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and "vector" not in "".join(exchanged)


def test_candidates_do_not_grow_with_batches(spark, corpus):
    """overfetch_dedup_topk filled the disk: every Arrow batch gave k candidates of each query."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        asked = _queries(corpus)
        assert se._candidates(asked, corpus, 5, False, False).count() <= asked.count() * 5 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_query_of_many_vectors_in_blocks(spark, corpus, monkeypatch):
    """multi_vector_topk failed: k candidates of each of a hot asset's vectors, and the corpus copied for each block of queries."""
    monkeypatch.setattr(se, "MAX_BROADCAST", 0)
    monkeypatch.setattr(se, "QUERY_BLOCK", 100)
    monkeypatch.setattr(se, "CORPUS_BLOCK", 64)
    asked = corpus.where("id % 2 = 0").select(F.lit("hot").alias("query_id"), "vector").union(corpus.where("id % 40 = 3").select(F.col("id").cast("string"), "vector"))
    found = se._candidates(asked, corpus.where("asset_id is not null"), 5, True, False)
    assert found.count() <= 12 * 5 * spark.sparkContext.defaultParallelism * 3
    assert "vector" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
    _, sims = _brute(corpus, 5)
    asset, best = {r["id"]: r["asset_id"] for r in corpus.collect()}, {}
    for i in sims:
        for j, s in sims[i].items():
            for q in ["hot"] * int(i % 2 == 0) + [str(i)] * int(i % 40 == 3):
                if asset[j] is not None:
                    best.setdefault(q, {})[asset[j]] = max(s, best.get(q, {}).get(asset[j], -2))
    got = {}
    for r in se.grouped_top_k(asked, corpus, 5).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["asset_id"])
    assert got == {q: sorted(b, key=lambda a: (-b[a], a))[:5] for q, b in best.items()}


def test_recommending_to_another_type_gives_k_candidates(spark, corpus):
    """recommend_cross_type failed as multi_vector_topk did, against part of the corpus."""
    asked, kept = corpus.select(F.lit("hot").alias("query_id"), "vector"), corpus.where("asset_type = 't1'")
    assert se._candidates(asked, kept, 5, True, False).count() <= 5 * spark.sparkContext.defaultParallelism
    assert {r["asset_id"] for r in se.grouped_top_k(asked, kept, 30).collect()} <= {r["asset_id"] for r in kept.collect()}


def test_recommending_within_a_type_gives_k_candidates(spark, corpus):
    """recommend_same_type failed likewise, with the type as a tag of queries and corpus."""
    kept = corpus.where("asset_type is not null").withColumn("tag", F.col("asset_type"))
    asked = kept.select(F.concat(F.lit("hot "), "tag").alias("query_id"), "vector", "tag")
    assert se._candidates(asked, kept, 5, True, True).count() <= 2 * 5 * spark.sparkContext.defaultParallelism
    got = {(r["query_id"], r["asset_id"]) for r in se.grouped_top_k(asked, kept, 100, True).collect()}
    assert got == {(f"hot {r['tag']}", r["asset_id"]) for r in kept.collect()}


def _near_copies(spark):
    """60 assets of 12 vectors, each vector near one of other assets; floors of most queries come out high."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    rows = [(i, (base[(i * 7 + i // 60) % 60] + rng.normal(scale=0.03, size=8)).astype(np.float32).tolist(), f"a{i // 12:02d}", None if i % 11 == 0 else f"t{i // 12 % 2}") for i in range(720)]
    return spark.createDataFrame(rows, "id long, vector array<float>, asset_id string, asset_type string").repartition(3)


def _best(rows, fits, seeds, k):
    x = np.array([r["vector"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims, best = np.round(x @ x.T, 9), {}
    for n, q in enumerate(rows):
        for m, c in enumerate(rows if q["asset_id"] in seeds else []):
            if fits(q, c):
                of = best.setdefault(q["asset_id"], {})
                of[c["asset_id"]] = max(of.get(c["asset_id"], -2), sims[n, m])
    return {(q, a) for q, b in best.items() for a in sorted(b, key=lambda a: (-b[a], a))[:k]}


def test_multi_vector_search_from_floors_told_beforehand(spark, monkeypatch):
    """multi_vector_topk had not ended at 1.33 million rows; and chunks without a type must count in it."""
    monkeypatch.setattr(se, "MANY", 1)
    monkeypatch.setattr(se, "QUERY_BLOCK", 16)
    df, seen, told = _near_copies(spark), [], se._with_floors
    monkeypatch.setattr(se, "_with_floors", lambda *a: seen.append(told(*a)) or seen[-1])
    rows, seeds = df.collect(), [f"a{i:02d}" for i in range(0, 60, 3)]
    got = se.recommend(spark.createDataFrame([(s,) for s in seeds], "asset_id string"), df, 5, False).collect()
    assert {(r["query_id"], r["asset_id"]) for r in got} == _best(rows, lambda q, c: True, seeds, 5)
    assert (seen[0].floor > 0.9).mean() > 0.5


@pytest.mark.parametrize("blocks", [1, 3])
def test_recommending_to_a_type_from_floors_of_that_type(spark, monkeypatch, blocks):
    """recommend_cross_type gave each task only its own floors; those told must be reached within the part of the corpus that is searched."""
    monkeypatch.setattr(se, "MANY", 1)
    monkeypatch.setattr(se, "MAX_BROADCAST", 0)
    monkeypatch.setattr(se, "QUERY_BLOCK", 720 // blocks)
    df, seen, told = _near_copies(spark), [], se._with_floors
    monkeypatch.setattr(se, "_with_floors", lambda *a: seen.append(told(*a)) or seen[-1])
    rows, assets = df.collect(), {f"a{i:02d}" for i in range(60)}
    got = {(r["query_id"], r["asset_id"]) for r in se.grouped_top_k(df.select(F.col("asset_id").alias("query_id"), "vector"), df.where("asset_type = 't1'"), 5).collect()}
    assert got == _best(rows, lambda q, c: c["asset_type"] == "t1", assets, 5)
    assert len(seen) >= blocks and any((x.floor > 0.9).any() for x in seen)


def test_recommending_within_a_type_from_floors_of_that_type(spark, monkeypatch):
    """recommend_same_type likewise, in which pairs of the first pass must agree in their tag, too."""
    monkeypatch.setattr(se, "MANY", 1)
    df, seen, told = _near_copies(spark), [], se._with_floors
    monkeypatch.setattr(se, "_with_floors", lambda *a: seen.append(told(*a)) or seen[-1])
    rows, assets = df.collect(), {f"a{i:02d}" for i in range(60)}
    got = {(r["query_id"], r["asset_id"]) for r in se.recommend(df.select("asset_id"), df, 5, True).collect()}
    assert got == _best(rows, lambda q, c: q["asset_type"] is not None and q["asset_type"] == c["asset_type"] and q["asset_id"] != c["asset_id"], assets, 5)
    assert (seen[0].floor > 0.9).mean() > 0.5


def _stored(spark, path):
    """A table of 50 assets of two types, six of which are asked for by 36 vectors; its rows."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist(), f"a{i // 6:02d}", 1, ("publications", "datasets")[i // 6 % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, asset_id string, asset_version long, asset_type string")
    df.write.parquet(str(path / "chunk_vectors.parquet"))
    return df.collect()


def test_query_by_type_searched_in_blocks(spark, tmp_path, monkeypatch):
    """recommend_cross_type failed at 1 GB: beyond one block of queries, the table met itself by ambiguous columns (AnalysisException)."""
    from lodeweave.plans import search_queries as sq

    rows = _stored(spark, tmp_path)
    monkeypatch.setattr(se, "MAX_BROADCAST", 0)
    monkeypatch.setattr(se, "QUERY_BLOCK", 16)
    got = {(r["query_id"], r["asset_id"]) for r in sq.recommend_cross_type(spark, str(tmp_path)).collect()}
    assert got == _best(rows, lambda q, c: c["asset_type"] == "publications", {r["asset_id"] for r in rows if r["id"] % 50 == 0}, 10)


def test_query_within_its_type_searched_in_blocks(spark, tmp_path, monkeypatch):
    """recommend_same_type failed at 1 GB by the same error."""
    from lodeweave.plans import search_queries as sq

    rows = _stored(spark, tmp_path)
    monkeypatch.setattr(se, "MAX_BROADCAST", 0)
    monkeypatch.setattr(se, "QUERY_BLOCK", 16)
    got = {(r["query_id"], r["asset_id"]) for r in sq.recommend_same_type(spark, str(tmp_path)).collect()}
    assert got == _best(rows, lambda q, c: q["asset_type"] == c["asset_type"] and q["asset_id"] != c["asset_id"], {r["asset_id"] for r in rows if r["id"] % 50 == 0}, 10)

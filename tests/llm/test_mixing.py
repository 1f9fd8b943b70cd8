import random

from pyspark.sql import functions as F

from lodeweave.llm import mixing as mx


def _tables(spark, seed=1):
    rng = random.Random(seed)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None, "unlisted"]), rng.randrange(0, 400), "x") for i in range(4000)]
    weights = [("a", 0.3, 2, "y"), ("b", 0.5, 3, "y"), ("c", 0.1, 4, "y"), ("d", 0.1, 2, "y"), (None, 0.1, 1, "y")]
    return docs, spark.createDataFrame(docs, "doc_id long, source string, size long, tokens string"), spark.createDataFrame(weights, "source string, target_weight double, max_repeats int, tokens string")


def test_mix_reaches_targets(spark):
    docs, df, weights = _tables(spark)
    sized = mx.sized(df, weights, F.col("size"))
    total = {s: sum(n for _, t, n, _ in docs if t == s) for s in "abc"}
    everything = sum(total.values())
    got = mx.mix(sized, weights).collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    used = {s: sum(r["tokens"] * r["copies"] for r in got if r["source"] == s) for s in "abc"}
    caps = {"a": 2, "b": 3, "c": 4}
    for s, w in (("a", 0.3), ("b", 0.5), ("c", 0.1)):
        want = min(w * everything, caps[s] * total[s])
        assert abs(used[s] - want) <= 400, s
        assert max(r["copies"] for r in got if r["source"] == s) <= caps[s]
    report = {r["source"]: r for r in mx.shares(sized, weights).collect()}
    assert report["d"]["short"] and report["d"]["mixed_tokens"] == 0 and abs(sum(r["share"] for r in report.values()) - 1) < 1e-4
    assert {r[0] for r in mx.short_sources(sized, weights).collect()} == {s for s in "abcd" if caps.get(s, 2) * total.get(s, 0) < {"a": 0.3, "b": 0.5, "c": 0.1, "d": 0.1}[s] * everything}


def test_same_draw_every_time(spark):
    _, df, weights = _tables(spark)
    sized = mx.sized(df, weights, F.col("size"))
    first = {(r["doc_id"], r["copies"]) for r in mx.mix(sized, weights).collect()}
    again = {(r["doc_id"], r["copies"]) for r in mx.mix(sized.repartition(7), weights).collect()}
    assert first == again
    other = {(r["doc_id"], r["copies"]) for r in mx.mix(sized, weights, seed=8).collect()}
    assert first != other


def test_inclusion_follows_weight(spark):
    rows = [(i, "a", 1, "heavy" if i % 2 else "light") for i in range(6000)] + [(10_000 + i, "b", 1, "light") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, kind string")
    weights = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 2)], "source string, target_weight double, max_repeats int")
    sized = mx.sized(df, weights, F.col("size"), F.when(F.col("kind") == "heavy", 1.5).otherwise(0.5))
    got = mx.mix(sized, weights).where("source = 'a'").join(df.select("doc_id", "kind"), "doc_id").groupBy("kind").count().collect()
    n = {r["kind"]: r["count"] for r in got}
    assert 2.2 < n["heavy"] / n["light"] < 4.5


def test_empty(spark):
    _, df, weights = _tables(spark)
    sized = mx.sized(df.limit(0), weights, F.col("size"))
    assert mx.mix(sized, weights).count() == 0 and mx.short_sources(sized, weights).count() == 0
    assert all(r["share"] == 0 for r in mx.shares(sized, weights).collect())

import itertools
import random

import numpy as np
import pytest

from lodeweave.llm import near_duplicates as nd

SCHEMA = "identifier string, name string, description struct<plain string, html string>, rid int, similarity string"


def _text(rng, n, words=4000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def _records(seed=5, groups=40):
    rng, rows = random.Random(seed), []
    shared = _text(rng, 30)
    for g in range(groups):
        base = _text(rng, rng.choice([22, 40, 120])) + (shared if g % 3 == 0 else [])
        for v in range(rng.choice([1, 2, 4])):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 8)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words = words[len(words) // 4 :]
            rows.append((f"id{g:03d}_{v}", f"name {g}", " ".join(words)))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, n, (t, "<b>no</b>") if t is not None else None, 1, "x") for i, n, t in rows], SCHEMA)


def _brute(rows, similarity=0.5):
    s = nd.Shingler(3, 20)
    bits = {i: set(b.tolist()) for i, n, t in rows if (b := s.one(n or "", t)) is not None}
    return {(a, b) for a, b in itertools.combinations(sorted(bits), 2) if bits[a] and len(bits[a] & bits[b]) >= similarity * len(bits[a] | bits[b])}


def _pairs(spark, rows, **how):
    return {tuple(r) for r in nd.asset_duplicates(_frame(spark, rows), **how).pairs().collect()}


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_equals_brute_force(spark, similarity):
    rows = _records()
    assert _pairs(spark, rows, similarity=similarity) == _brute(rows, similarity)


def test_hot_bits_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT", 2)
    monkeypatch.setattr(nd, "SAMPLE", 30)
    monkeypatch.setattr(nd, "STEP", 16)
    rows = _records(seed=6)
    assert _pairs(spark, rows) == _brute(rows)


def test_classes_nulls_and_repeats(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [("a", "n", text), ("a", "n", text), ("b", "n", text), ("c", None, text), ("d", "n", None), ("e", "n", ""), ("f", "n", "too short"), (None, "n", text)]
    assert _pairs(spark, rows) == {("a", "b"), ("a", "c"), ("b", "c")}
    many = [(f"k{i:03d}", "n", text) for i in range(100)] + [("z", "other", text + " more")]
    got = nd.asset_duplicates(_frame(spark, many)).pairs(expand=10)
    assert {tuple(r) for r in got.collect()} == {("k000", f"k{i:03d}") for i in range(1, 100)} | {("k000", "z")}


def test_groups(spark):
    text = [f"word{i}" for i in range(60)]
    rows = [("a", "n", " ".join(text)), ("b", "n", " ".join(text[:50] + ["q"] * 3)), ("c", "n", " ".join(text[8:50] + ["q"] * 3)), ("d", "n", " ".join(f"other{i}" for i in range(30)))]
    got = {r["identifier"]: r for r in nd.asset_duplicates(_frame(spark, rows)).groups().withColumnRenamed("key", "identifier").collect()}
    assert got["a"]["group"] == got["b"]["group"] == got["c"]["group"] != got["d"]["group"]
    assert got["d"]["links"] == 0 and got["b"]["links"] == 2


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in nd.components(edges).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[100] == got[101] == 100


def test_empty(spark):
    assert _pairs(spark, []) == set()


def _allocated(need, single, groups):
    """Of one record: single bits' candidates, and the candidates of each group's bits."""
    code = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    _, credit, cost, ratio = nd._options(code, np.concatenate(groups).astype(float))
    single = np.sort(np.array(single, float))
    return *nd.allocate(np.array([need]), np.zeros(len(single), np.int64), single, np.zeros(len(groups), np.int64), credit, cost, ratio), credit, cost


def test_thresholds_differ_between_partitions():
    # One single bit and three groups: the dear group is left out, the cheap ones give all their bits, the last as many as are needed.
    got, singles, _, _ = _allocated(7, [0], [[5, 5, 5, 5], [900, 900, 900, 900], [3, 3, 40, 40]])
    assert singles[0] == 1 and got.tolist() == [4, 0, 2]


def test_allocation_is_the_cheapest_of_all():
    rng = np.random.default_rng(1)
    for _ in range(60):
        groups = [rng.integers(1, 60, rng.integers(1, 6)) for _ in range(3)]
        single = np.sort(rng.integers(0, 40, 4))
        need = int(rng.integers(1, 1 + 4 + sum(map(len, groups))))
        got, singles, credit, cost = _allocated(need, single, groups)
        price = {g: dict(zip([0, *credit[g]], [0.0, *cost[g]])) for g in range(3)}
        assert singles[0] + got.sum() >= need
        paid = single[: singles[0]].sum() + sum(price[g][c] for g, c in enumerate(got))
        best = min(single[:k].sum() + sum(price[g][c] for g, c in enumerate(cs)) for cs in itertools.product(*price.values()) for k in range(5) if k + sum(cs) >= need)
        assert abs(paid - best) < 1e-9


def test_correlated_bits_share_a_partition():
    together, others = np.arange(100, 110, dtype=np.uint64), np.arange(500, 503, dtype=np.uint64)
    p = nd.Partitions.fit([np.concatenate([together, others]), together, np.concatenate([others, [np.uint64(900)]])])
    part, place = p.find(np.concatenate([together, others, [np.uint64(900)]]))
    assert len(set(part[:10])) == 1 and len(set(part[10:13])) == 1 and part[0] != part[10] and part[13] == -1
    assert sorted(place[:10]) == list(range(10))


def test_no_pair_is_lost_outside_the_core(spark, monkeypatch):
    monkeypatch.setattr(nd, "CORE", 2)
    rows = _records(seed=9)
    assert _pairs(spark, rows) == _brute(rows)

import numpy as np

from lodeweave.llm import vector_graph as vg

DIM = 8


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>, extra string")


def _brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {i: {ids[j] for j in np.argsort(-s[r])[:k]} for r, i in enumerate(ids)}, s


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, DIM))
    x = (centres[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, DIM))).astype(np.float32)
    ids = list(range(3000))
    rows = [(i, v.tolist(), "x") for i, v in zip(ids, x)]
    rows += rows[:50] + [(9001, None, "x"), (9002, [0.0] * DIM, "x"), (9003, [1.0] * 3, "x"), (9004, [float("nan")] * DIM, "x"), (9005, [None] * DIM, "x"), (None, [1.0] * DIM, "x")]
    true, sims = _brute(ids, x.astype(float), 5)
    got = vg.nearest(_frame(spark, rows), 5, dim=DIM).toPandas()
    assert set(got["id"]) == set(ids) and not got.duplicated(["id", "rank"]).any()
    found = got.groupby("id")["neighbour"].agg(set)
    assert np.mean([len(found[i] & true[i]) / 5 for i in ids]) >= 0.9
    for r in got.sample(200, random_state=1).itertuples():
        assert abs(1 - r.distance - sims[r.id, r.neighbour]) < 1e-4


def test_search_walks_to_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, DIM)).astype(np.float32)
    true, _ = _brute(list(range(1500)), x.astype(float), 5)
    got = vg.search(_frame(spark, [(i, v.tolist(), "x") for i, v in enumerate(x)]), dim=DIM).toPandas()
    found = got.groupby("query")["neighbour"].agg(set)
    assert set(found.index) == set(range(0, 1500, 50))
    assert np.mean([len(found[i] & true[i]) / 5 for i in found.index]) >= 0.9


def test_walk_goes_on_to_the_end(spark):
    # A chain of vectors, each linked to the next: the answer lies twelve steps from the entry.
    angles = np.arange(13) / 10
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    codes = [bytearray(np.rint(v / np.abs(v).max() * 32767).astype(np.int16).tobytes()) for v in x]
    links = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 11)], "id long, neighbour long")
    points = spark.createDataFrame(list(enumerate(codes)), "id long, vec binary")
    asked = spark.createDataFrame([(100, codes[12], 0)], "query long, vec binary, entry long")
    got = {r["rank"]: r["neighbour"] for r in vg.greedy_search(links, points, asked, k=2, beam=2, dim=2).collect()}
    assert got == {1: 12, 2: 11}


def test_copies_follow_one_of_them(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, DIM))
    rows = [(i, [1.0] * DIM, "x") for i in range(200)] + [(1000 + i, v.tolist(), "x") for i, v in enumerate(x)]
    got = vg.nearest(_frame(spark, rows), 5, dim=DIM).toPandas()
    copies = got[got["id"] < 200]
    assert len(copies) == 1000 and (copies["distance"] < 1e-4).all() and (copies["neighbour"] < 200).all()
    assert not got.duplicated(["id", "neighbour"]).any() and (got["id"] != got["neighbour"]).all() and got["id"].nunique() == 500


def test_neighbours_of_neighbours_meet_in_a_block():
    # Two strangers a and b are listed by u alone; one of them is new.
    lists = vg._blank(3, 2)
    lists["id"][0], lists["sim"][0], lists["home"][0], lists["new"][0] = [20, 30], [0.9, 0.9], [7, 8], [1, 0]
    lists["sim"][1:], lists["id"][1:] = 0.1, [[98, 99], [98, 99]]
    unit = np.array([[1, 0], [0.9, 0.4359], [0.9, 0.4359]], np.float32)
    ids, home = np.array([10, 20, 30]), np.array([True, False, False])
    how = ids, lists, home, unit, lists["sim"][:, 1], home, 5, 2, 4
    owner, other, sim = vg._meetings(*how)
    assert set(zip(owner.tolist(), other.tolist())) >= {(1, 2), (2, 1)} and (sim > 0.85).all()
    lists["new"][0] = 0
    lists["home"][1:], lists["id"][1:] = 5, [[10, 99], [10, 99]]  # and now both have been here before
    assert not len(vg._meetings(*how)[0])


def test_crowded_cells_are_dealt_to_several_tasks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, DIM)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    monkeypatch.setattr(vg, "CELL", 100)
    plain = vg.nearest(_frame(spark, rows), 5, dim=DIM).toPandas()
    monkeypatch.setattr(vg, "MAX_VISITORS", 20)
    dealt = vg.nearest(_frame(spark, rows), 5, dim=DIM).toPandas()
    true, _ = _brute(list(range(1200)), x.astype(float), 5)
    for got in (plain, dealt):
        found = got.groupby("id")["neighbour"].agg(set)
        assert len(got) == 6000 and np.mean([len(found[i] & true[i]) / 5 for i in range(1200)]) >= 0.9


def test_recall_on_skewed_input_with_split_cells(spark, monkeypatch):
    monkeypatch.setattr(vg, "MAX_BLOCK", 128)
    rng = np.random.default_rng(4)
    # One cluster holds two thirds of all vectors, so that its cells are split into many parts.
    x = np.concatenate([1 + 0.05 * rng.normal(size=(2000, DIM)), rng.normal(size=(1000, DIM))]).astype(np.float32)
    true, _ = _brute(list(range(3000)), x.astype(float), 5)
    got = vg.nearest(_frame(spark, [(i, v.tolist(), "x") for i, v in enumerate(x)]), 5, dim=DIM).toPandas()
    found = got.groupby("id")["neighbour"].agg(set)
    assert set(found.index) == set(range(3000))
    assert np.mean([len(found[i] & true[i]) / 5 for i in range(3000)]) >= 0.97


def test_pairs_and_empty(spark):
    rows = [(1, [1.0] + [0.0] * 7, "x"), (2, [1.0, 0.1] + [0.0] * 6, "x"), (3, [0.0, 1.0] + [0.0] * 6, "x")]
    assert {tuple(r) for r in vg.similar_pairs(_frame(spark, rows), 0.9, dim=DIM).collect()} == {(1, 2)}
    assert vg.similar_pairs(_frame(spark, rows[:1]), 0.9, dim=DIM).count() == 0
    assert vg.nearest(_frame(spark, []), dim=DIM).count() == 0

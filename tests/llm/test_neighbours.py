"""Nearest neighbours: exact scores, recall, ties, odd vectors."""

import numpy as np

from cloakwork.llm import neighbours


def exact(ids, x, i, k):
    d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    d[i] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[j]), float(d[j])) for j in order]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype(np.float32).astype(np.float64)
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in neighbours.report(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    for query, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and all(a[2:] <= b[2:] for a, b in zip(rows, rows[1:]))
        assert all(abs(np.sqrt(((x[v] - x[query]) ** 2).sum()) - s) < 1e-12 for _, v, s in rows)
        hits += len({v for v, _ in exact(ids, x, query, 10)} & {r[1] for r in rows})
    assert hits / (10 * len(got)) >= 0.9


def test_blocks_split_large_leaves(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 10)
    block, pieces = neighbours._blocks(6, {0: 4, 1: 5, 2: 25, 3: 9, 5: 1})
    assert block.tolist() == [0, 0, 1, 2, 0, 2] and pieces.tolist() == [1, 1, 3, 1, 1, 1]


def test_equal_vectors_and_small_tables(spark):
    same = [(i, [1.0, 0.0]) for i in range(150)]
    odd = [(300, None), (400, [0.0, 0.0]), (500, [float("nan"), 1.0]), (600, [None, 1.0]), (700, [1.0]), (None, [1.0, 1.0]), (800, [float("inf"), 1.0]), (900, [0.0, 2.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(same + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.report(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(got) == [0, 100, 900]
    assert [got[0][k] for k in range(1, 11)] == [(i, 0.0) for i in range(1, 11)]
    assert [got[100][k] for k in range(1, 11)] == [(i, 0.0) for i in range(10)]
    assert [v for v, _ in (got[900][k] for k in range(1, 11))] == list(range(10)) and abs(got[900][1][1] - 5**0.5) < 1e-12
    assert neighbours.report(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 1.0]), (7, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.report(few).collect()] == [(0, 1, 7, 1.0)]


def test_exact_neighbours_and_the_budget_they_need(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>").repartition(3)
    found = neighbours.exact(nodes, {i: x[i] for i in (0, 10, 699)}, 5)
    assert found == {i: [v for v, _ in exact(np.arange(700), x, i, 5)] for i in (0, 10, 699)}
    forest = neighbours.Forest(x[::2], 6, 8)
    leaves = forest.leaves(x)
    counts = np.bincount(leaves.ravel(), minlength=len(forest.left))
    assert counts.sum() == 6 * 700 and sorted(forest.walk(x[3])) == sorted(np.nonzero(forest.left < 0)[0].tolist())
    near = found[10]
    for node, needed in zip(near, forest.met_at(x[10], counts, [leaves[n].tolist() for n in near])):
        assert set(leaves[node]) & set(forest.search(x[10], counts, needed))
        assert not set(leaves[node]) & set(forest.search(x[10], counts, needed - 1)[:-1])

import math

import numpy as np
import pytest

from colsight.llm import nearest as nn

SCHEMA = "vec_id bigint, embedding array<double>, label int, row string, vec string, rank int, leaf int"
QUERIES = "vec_id % 20 = 0"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r", "v", 0, 0) for i, v in rows], SCHEMA)


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(rows, k=20):
    """query row -> its nearest rows, and all results as sorted tuples."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, v) in enumerate(good):
        if i is not None and i % 20 == 0:
            others = sorted((-dot(v, w), math.inf if j is None else j) for m, (j, w) in enumerate(good) if m != n)
            out += [(i, rank, None if j == math.inf else j, -s) for rank, (s, j) in enumerate(others[:k], 1)]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


def clustered(n, dims, seed, centres=30):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return (middle[rng.integers(centres, size=n)] + 0.4 * rng.normal(size=(n, dims))).tolist()


def test_one_leaf_is_exact(spark):
    rows = list(enumerate(clustered(300, 6, 1)))
    assert result(nn.nearest(frame(spark, rows), QUERIES)) == brute(rows)


@pytest.mark.parametrize("cell, widen", [(32_768, 8), (20, 2)])
def test_recall_of_many_leaves(spark, monkeypatch, cell, widen):
    monkeypatch.setattr(nn, "CELL_ROWS", cell)
    monkeypatch.setattr(nn, "WIDEN", widen)
    seen = []
    found = nn.calibrated
    monkeypatch.setattr(nn, "calibrated", lambda tree, *a: seen.append((tree.leaves, found(tree, *a))) or seen[-1][1])
    rows = list(enumerate(clustered(3000, 16, 2)))
    got, want = result(nn.nearest(frame(spark, rows), QUERIES, leaf_rows=25)), brute(rows)
    leaves, visits = seen[0]
    assert leaves > 50 and visits < leaves / 2
    assert len(set(got) & set(want)) >= 0.5 * len(want) and len(got) == len(want)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    scores = {(q, i): s for q, _, i, s in brute(rows, 3000)}
    assert all(scores[q, i] == s for q, _, i, s in got)


def test_equal_vectors_and_ties(spark):
    rows = list(enumerate(clustered(200, 4, 3)))
    rows += [(i, [1.0, -0.0, 0.5, 2.0]) for i in range(500, 600)] + [(i, [0.0, 1.0, 0.0, 0.0]) for i in range(700, 730)]
    rows += [(500, [1.0, 0.0, 0.5, 2.0]), (None, [1.0, 0.0, 0.5, 2.0]), (None, [9.0, 0.0, 0.0, 1.0])]
    assert result(nn.nearest(frame(spark, rows), QUERIES)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (20, None), (40, [0.0, 0.0])]
    rows += [(7, [3.0]), (8, [1.0, 1.0, 5.0]), (60, [2.0, 0.5, 0.25]), (60, [2.0, 0.5, 0.25])]
    assert result(nn.nearest(frame(spark, rows), QUERIES)) == brute(rows)
    assert result(nn.nearest(frame(spark, []), QUERIES)) == []
    assert result(nn.nearest(frame(spark, [(1, [1.0]), (2, [2.0])]), QUERIES)) == []
    assert result(nn.nearest(frame(spark, [(0, [1.0])]), QUERIES)) == []


def test_given_table(spark, sf_dir, con):
    rows = [(i, list(v)) for i, v in con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()]
    assert result(nn.op12_nearest_neighbours(spark, sf_dir)) == brute(rows)


def test_tree_assigns_to_leaves_that_are_visited_first():
    rows = np.array(clustered(2000, 8, 5))
    tree = nn.Tree.fit(rows, 40)
    assert 20 <= tree.leaves <= 80 and set(tree.assign(rows)) == set(range(tree.leaves))
    visits = tree.visits(rows[:50], tree.leaves)
    assert all(sorted(v) == list(range(tree.leaves)) for v in visits)
    sizes = np.bincount(tree.assign(rows), minlength=tree.leaves)
    assert all(sizes[v].sum() >= 200 for v in tree.visits(rows[:50], 1, sizes, 200))

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsight.operators import forest, model


def impurity(y, classify):
    if classify:
        _, n = np.unique(y, return_counts=True)
        return len(y) - (n * n).sum() / len(y)
    return ((y - y.mean()) ** 2).sum()


def splits(columns, y, classify):
    """(feature, at, gain) of all splits of a node, by trying each."""
    out = []
    for name, x in columns.items():
        values = sorted(set(x))
        for v in values:
            left = np.array([a <= v if isinstance(v, float) else a == v for a in x])
            if 0 < left.sum() < len(y):
                out.append((name, v, impurity(y, classify) - impurity(y[left], classify) - impurity(y[~left], classify)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcdefg"), float(rng.randrange(9)), rng.choice([None, "x", "y", "z"])) for _ in range(400)]
    rows = [(s, x, t, ("p" if x > 4 else "q") if s in "abc" else rng.choice("pqr"), x * x + (5.0 if s == "d" else 0.0) + rng.random()) for s, x, t in rows]
    return rows, spark.createDataFrame(rows, "s string, x double, t string, y string, z double")


@pytest.mark.parametrize("target, classify", [("y", True), ("z", False)])
def test_gains_equal_brute_force(data, target, classify):
    rows, df = data
    whole = [r for r in rows if r[2] is not None]
    y = np.array([r[3] if classify else r[4] for r in whole])
    want = splits({"s": [r[0] for r in whole], "x": [r[1] for r in whole], "t": [r[2] for r in whole]}, y, classify)
    got = {r["feature"]: r for r in forest.split_gains(df, ["s", "x", "t"], target, classify).collect()}
    for name in ("s", "x", "t"):
        mine = [g for n, _, g in want if n == name]
        assert got[name]["splits"] == len(mine) and got[name]["best_gain"] == pytest.approx(max(mine))


@pytest.mark.parametrize("target, classify", [("y", True), ("z", False)])
def test_one_tree_equals_brute_force(data, target, classify):
    rows, df = data
    y = np.array([r[3] if classify else r[4] for r in rows])
    columns = {"s": np.array([r[0] for r in rows], object), "x": np.array([r[1] for r in rows], object)}
    weights = {"s": 0.0, "x": 0.0}

    def go(at, depth):
        here = {k: list(v[at]) for k, v in columns.items()}
        found = [s for s in splits(here, y[at], classify) if s[2] > 1e-6]
        if depth == 3 or not found:
            return
        name, v, gain = max(found, key=lambda s: s[2])
        weights[name] += gain
        left = np.array([x <= v if isinstance(v, float) else x == v for x in columns[name][at]])
        go(at[left], depth + 1)
        go(at[~left], depth + 1)

    go(np.arange(len(rows)), 0)
    table = forest.prepare(df, ["s", "x"], target, classify)
    got = forest.importances(forest.grow(table, 1, 3, 1, bootstrap=False), 2)
    assert got == pytest.approx([weights["s"] / sum(weights.values()), weights["x"] / sum(weights.values())])


def test_many_levels_and_classes(spark):
    df = spark.range(100_000).select(
        F.concat(F.lit("L"), "id").alias("level"), (F.col("id") % 10_000).cast("string").alias("y"), (F.col("id") % 10_000).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("t")
    )
    rows = model.feature_importance(df, ["level", "x", "t"], "y", "classification", trees=1, depth=2).collect()
    assert sum(r["feature_importance"] for r in rows) == pytest.approx(1.0)
    table = forest.prepare(df, ["level", "x", "t"], "y", True)
    level, x, t = forest.importances(forest.grow(table, 1, 2, 1), 3)
    assert x > t and x > level


def test_bootstrap_and_bins(spark):
    times = forest._times(np.arange(20_000), 8, 42)
    assert times.shape == (8, 20_000) and abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.03
    assert abs(np.corrcoef(times[0], times[1])[0, 1]) < 0.03
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(1.5).alias("one"), (F.col("id") > 300).alias("y"), F.lit(1e-9).alias("tiny"))
    table = forest.prepare(df, ["x", "one"], "y", True)
    bins = [r["c0"] for r in table.rows.orderBy("row").collect()]
    assert bins == sorted(bins) and len(set(bins)) == 64
    none = model.feature_importance(df, ["one"], "y", "classification", trees=2, depth=2).collect()
    assert [r["feature_importance"] for r in none] == [0.0]
    small = model.feature_importance(df.withColumn("z", F.col("x") * F.col("tiny")), ["x", "one"], "z", "regression", trees=2, depth=3).collect()
    assert [r["feature_importance"] for r in small] == [1.0, 0.0]


def test_tasks_sum_up_what_they_count(spark):
    df = spark.range(30_000).select((F.col("id") % 5).cast("string").alias("s"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).alias("y"))
    table = forest.prepare(df, ["s", "x"], "y", True)
    roots = forest.Trees(np.full((8, 1), -1), np.zeros((8, 1), np.int64), np.zeros((8, 1)))
    assert table.parts == 1 and forest._counted_by_task(table, roots, 0, True, 42).count() == 8 * (5 + 7) * 3


@pytest.mark.parametrize("target, classify", [("y", True), ("z", False)])
def test_parts_and_groups_give_the_same_forest(data, target, classify, monkeypatch):
    _, df = data
    whole = forest.grow(forest.prepare(df, ["s", "x", "z" if classify else "y"], target, classify), 5, 4, 3, looked_at=2)
    monkeypatch.setattr(forest, "CELLS_AT_ONCE", 300)
    monkeypatch.setattr(forest, "TASKS", 14)
    table = forest.prepare(df, ["s", "x", "z" if classify else "y"], target, classify)
    cut = forest.grow(table, 5, 4, 3, looked_at=2)
    assert table.parts == 7 and (cut.feature == whole.feature).all() and (cut.at == whole.at).all() and cut.gain == pytest.approx(whole.gain)


def test_draws_of_chosen_trees():
    rows = np.arange(50_000) * 7919 + (3 << 33)
    keys = rows.astype(np.uint64)[None, :] * np.uint64(11) + np.arange(5, dtype=np.uint64)[:, None]
    share = (forest._mixed(forest._mixed(keys + np.uint64(9))) >> np.uint64(11)).astype(float) / 2.0**53
    want = np.searchsorted(forest.STEPS, share)
    assert (forest._times(rows, 5, 9) == want).all() and (forest._times(rows, 5, 9, np.array([3])) == want[3]).all()

import itertools
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.functions import tails
from colsight.operators import stats, tables


def test_tails_closed_forms():
    assert tails.f_sf(3.2, 2, 40) == pytest.approx((1 + 2 * 3.2 / 40) ** -20)
    assert tails.chi2_sf(7.7, 4) == pytest.approx(math.exp(-3.85) * (1 + 3.85))
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    r, n = 0.7, 4
    t = r * math.sqrt(2 / (1 - r * r))
    assert tails.pearson_sf(r, n) == pytest.approx(1 - t / math.sqrt(t * t + 2))
    assert tails.pearson_sf(1.0, 10) == 0.0 and math.isnan(tails.pearson_sf(0.5, 2))
    assert tails.f_sf(math.inf, 1, 5) == 0.0


def brute_p(u, n0, n1):
    us = [sum(r) - n0 * (n0 + 1) / 2 for r in itertools.combinations(range(1, n0 + n1 + 1), n0)]
    upper = max(u, n0 * n1 - u)
    return min(1.0, 2 * sum(x >= upper for x in us) / len(us))


def test_exact_rank_p():
    for n0, n1 in ((4, 5), (3, 3), (5, 2), (6, 7)):
        for u in range(n0 * n1 + 1):
            assert tails.mann_whitney_p(u, n0, n1, 0) == pytest.approx(brute_p(u, n0, n1))
    assert tails.mann_whitney_p(0, 4, 5, 0) == pytest.approx(2 / 126)
    assert tails.mann_whitney_p(3, 4, 5, 6) != tails.mann_whitney_p(3, 4, 5, 0)


@pytest.mark.parametrize("rows_per_bucket", [50, 1_000_000])
def test_mann_whitney_against_pairs(spark, rows_per_bucket):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.integers(0, 40, 300).astype(float), "y": rng.random(300), "c": rng.choice(["p", "q"], 300)})
    pdf.loc[::11, "x"] = None
    df = spark.createDataFrame(pdf)
    got = {r["feature"]: r for r in stats.mann_whitney(df, "c", ["x", "y"], rows_per_bucket=rows_per_bucket).collect()}
    for n in ("x", "y"):
        a, b = pdf[pdf.c == "p"][n].dropna().to_numpy(), pdf[pdf.c == "q"][n].dropna().to_numpy()
        u = (a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()
        assert got[n]["u_stat"] == pytest.approx(u)
        ties = sum(t**3 - t for t in pdf[n].value_counts())
        assert got[n]["tie_term"] == pytest.approx(ties)


@pytest.mark.parametrize("rows_per_bucket", [50, 1_000_000])
def test_spearman_against_pandas(spark, rows_per_bucket):
    rng = np.random.default_rng(2)
    y = rng.normal(size=400)
    pdf = pd.DataFrame({"a": np.round(y + rng.normal(size=400), 1), "hot": np.where(rng.random(400) < 0.5, 1.0, y), "const": 2.0, "y": y})
    pdf.loc[::9, "a"] = None
    got = {r["feature"]: r for r in stats.spearman(spark.createDataFrame(pdf), "y", ["a", "hot", "const"], rows_per_bucket=rows_per_bucket).collect()}
    for n in ("a", "hot"):
        pair = pdf[[n, "y"]].dropna()
        assert got[n]["rho"] == pytest.approx(pair[n].rank().corr(pair.y.rank()))
        assert got[n]["n"] == len(pair)
    assert got["const"]["rho"] is None


def test_anova_drops_small_groups_and_matches_numpy(spark):
    groups = {"a": [1.0, 2.0, 4.0], "b": [2.0, 9.0, 5.0, 7.0], "c": [50.0, 60.0], "d": [3.0] * 6}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    row = stats.anova_by_category(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).first()
    kept = [np.array(groups[g]) for g in "abd"]
    every = np.concatenate(kept)
    ssb = sum(len(k) * (k.mean() - every.mean()) ** 2 for k in kept)
    ssw = sum(((k - k.mean()) ** 2).sum() for k in kept)
    assert row["f_stat"] == pytest.approx((ssb / 2) / (ssw / (len(every) - 3)))
    assert row["eta_squared"] == pytest.approx(ssb / (ssb + ssw)) and row["rows"] == 15 and row["n"] == 13


def test_degenerate_groups(spark):
    flat = spark.createDataFrame([("a", 1.0)] * 6 + [("b", 1.0)] * 7, "g string, v double")
    assert stats.run_tests(flat, "v", ["g"], "regression").first()["effect_size"] == 0.0
    split = spark.createDataFrame([("a", 1.0)] * 6 + [("b", 2.0)] * 7, "g string, v double")
    row = stats.run_tests(split, "v", ["g"], "regression").first()
    assert row["p_value"] == 0.0 and row["effect_size"] == 1.0
    moments = stats.class_moments(spark.createDataFrame([("a", 1.0)] * 3 + [("b", 1.0)] * 3, "g string, v double"), "g", ["v"])
    assert stats.cohens_d(moments).first()["cohens_d"] == 0.0


def test_chi_square_yates_and_plain(spark):
    cells = {("x", "p"): 30, ("x", "q"): 10, ("y", "p"): 12, ("y", "q"): 28}
    rows = [k for k, n in cells.items() for _ in range(n)]
    row = stats.chi_square(stats.contingency(spark.createDataFrame(rows, "f string, t string"), "t", ["f"])).first()
    assert row["chi2"] == pytest.approx(14.4862, abs=1e-4) and row["cramers_v"] == pytest.approx(math.sqrt(row["chi2"] / 80))


def test_chi_square_counts_empty_cells(spark):
    table = np.array([[5, 0, 7], [0, 9, 3], [4, 4, 0]])
    rows = [(f"r{i}", f"c{j}") for i in range(3) for j in range(3) for _ in range(table[i, j])]
    row = stats.chi_square(stats.contingency(spark.createDataFrame(rows, "f string, t string"), "t", ["f"])).first()
    e = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert row["chi2"] == pytest.approx(((table - e) ** 2 / e).sum()) and row["dof"] == 4
    diagonal = spark.createDataFrame([("a", "p")] * 8 + [("b", "q")] * 7, "f string, t string")
    row = stats.chi_square(stats.contingency(diagonal, "t", ["f"])).first()
    assert row["chi2"] == pytest.approx(15 * (8 * 7 - 7.5) ** 2 / (8 * 7 * 8 * 7))


def test_row_floor(spark):
    def run(n):
        rows = [(float(i), float(i * i)) for i in range(n)] + [(None, 1.0), (1.0, None)]
        return stats.run_tests(spark.createDataFrame(rows, "x double, y double"), "y", ["x"], "regression")

    assert run(11).isEmpty()
    row = run(12).first()
    assert row["n"] == 12 and row["test_type"] == "pearson_spearman" and row["correlation"] == pytest.approx(1.0)


def test_dispatch_by_type_and_classes(spark):
    rows = [(i % 7 * 1.0, i % 2 == 0, f"l{i % 3}", f"t{i % 2}", f"u{i % 3}", None if i % 3 == 2 else i * 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "num double, flag boolean, cat string, two string, three string, gap double")
    two = {r["feature"]: r["test_type"] for r in stats.run_tests(df, "two", ["num", "flag", "cat", "nope", "two"], "classification").collect()}
    assert two == {"num": "mann_whitney_u", "flag": "mann_whitney_u", "cat": "chi_square"}
    three = {r["feature"]: r["test_type"] for r in stats.run_tests(df, "three", ["num", "flag", "gap", "two"], "classification").collect()}
    assert three == {"num": "anova_multi_class", "flag": "anova_multi_class", "gap": "mann_whitney_u", "two": "chi_square"}
    reg = {r["feature"]: r["test_type"] for r in stats.run_tests(df, "num", ["flag", "cat", "gap"], "regression").collect()}
    assert reg == {"flag": "pearson_spearman", "cat": "anova", "gap": "pearson_spearman"}
    with pytest.raises(ValueError, match="not present"):
        stats.run_tests(df, "absent", ["num"], "regression")
    assert stats.run_tests(df, "num", [], "regression").isEmpty()


def test_constant_feature_gives_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(20)], "k double, y double")
    row = stats.run_tests(df, "y", ["k"], "regression").first()
    assert row["p_value"] is None and row["effect_size"] is None and row["correlation"] is None


def test_no_join_is_dealt_by_the_feature_number(spark):
    """A feature number is a key of a handful of values: with static broadcasts off no join of pairs or cells may use it alone."""
    df = spark.range(500).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y"), (F.col("id") % 3).cast("string").alias("s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = [stats.spearman(df, "y", ["x"], rows_per_bucket=50), stats.chi_square(stats.contingency(df, "s", ["x"]))]
        frames.append(tables.grouped_median(df.select(F.col("s").alias("group"), F.col("x").alias("target")), rows_per_bucket=50))
        for frame in frames:
            plan = frame._jdf.queryExecution().executedPlan().toString()
            joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)
            assert not [j for j in joins if re.fullmatch(r"ordinal#\d+", j)], joins
        # The size of a group travels with its running total.
        assert "n_total" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def table_p(u, n0, n1):
    """Two-sided p from the whole table of counts."""
    small, large = min(n0, n1), max(n0, n1)
    ways = np.zeros(small * large + 1, dtype=object)
    ways[0] = 1
    for i in range(1, small + 1):
        grown = ways.copy()
        if large + i < len(ways):
            grown[large + i :] -= ways[: -(large + i)]
        for start in range(min(i, len(ways))):
            grown[start::i] = np.cumsum(grown[start::i])
        ways = grown
    return min(1.0, float(2 * sum(ways[math.ceil(max(u, n0 * n1 - u)) :]) / math.comb(n0 + n1, small)))


def uniform_p(u, n0, n1):
    """The limit for very large groups: ranks of the small group's members are uniform numbers."""
    small, lower = min(n0, n1), math.floor(min(u, n0 * n1 - u))
    x = (lower + small * (small + 1) / 2 + 0.5) / (n0 + n1 + 1)
    return 2 * sum((-1) ** k * math.comb(small, k) * (x - k) ** small for k in range(int(x) + 1)) / math.factorial(small)


def test_rank_tail_of_a_small_group_among_very_many():
    for n0, n1, part in ((1, 200_000, 0.01), (3, 100_000, 0.2), (5, 60_000, 0.15), (8, 30_000, 0.3)):
        u = part * n0 * n1
        assert tails.mann_whitney_p(u, n0, n1, 0) == pytest.approx(uniform_p(u, n0, n1), rel=2e-3)
    assert tails.mann_whitney_p(0.0, 2, 3_000_000, 0.0) < 1e-11
    assert tails.mann_whitney_p(2.4e9, 8, 10**9, 0) == pytest.approx(uniform_p(2.4e9, 8, 10**9), rel=1e-6)


@pytest.mark.parametrize("n0, n1", [(8, 249_000), (251_000, 8), (2, 1_100_000), (7, 3), (8, 8), (1, 1)])
def test_rank_tail_equals_the_whole_table(n0, n1):
    for part in (0.0, 0.11, 0.5):
        u = round(2 * part * n0 * n1) / 2
        assert tails.mann_whitney_p(u, n0, n1, 0) == pytest.approx(table_p(u, n0, n1), rel=1e-13)


def test_spearman_spreads_hot_values(spark):
    rng = np.random.default_rng(8)
    n = 6000
    y = np.where(rng.random(n) < 0.3, -5.0, np.round(rng.normal(size=n), 4))
    pdf = pd.DataFrame({"hot": np.where(rng.random(n) < 0.34, 3.0, rng.normal(size=n)), "y": y})
    df = spark.createDataFrame(pdf)
    got = stats.spearman(df, "y", ["hot"], rows_per_bucket=500).first()
    assert got["rho"] == pytest.approx(pdf["hot"].rank().corr(pdf["y"].rank()))
    pairs = df.groupBy(F.lit(0).alias("ordinal"), F.col("hot").alias("x"), "y").agg(F.count(F.lit(1)).alias("n"))
    ranks = pairs.groupBy("ordinal", "x").agg(F.count(F.lit(1)).alias("pairs"), F.sum("x").alias("rx"))
    assert stats.hot_values(ranks, 0.1).count() == 1
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = stats._with_ranks(pairs, ranks, "x").withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in found.groupBy("task").count().collect()]
        missing = found.filter("rx IS NULL").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert missing == 0 and len(sizes) == 8 and max(sizes) < 3 * np.median(sizes)


@pytest.mark.parametrize("few", [0, 40, 10_000])
def test_spearman_joins_no_rank_of_the_target(spark, few, monkeypatch):
    monkeypatch.setattr(stats, "FEW_VALUES", few)
    rng = np.random.default_rng(5)
    n = 5000
    pdf = pd.DataFrame({"a": np.round(rng.normal(size=n), 3), "b": rng.integers(0, 9, n).astype(float), "none": np.nan, "one": 4.0})
    pdf["y"] = np.where(rng.random(n) < 0.3, -5.0, pdf["b"] - pdf["a"] + rng.normal(size=n))
    pdf.loc[rng.random(n) < 0.1, "y"] = np.nan
    pdf.loc[rng.random(n) < 0.2, "a"] = np.nan
    written = []
    write = stats.materialize
    monkeypatch.setattr(stats, "materialize", lambda df: written.append(df.columns) or write(df))
    got = {r["feature"]: r for r in stats.spearman(spark.createDataFrame(pdf), "y", ["a", "b", "none", "one"], rows_per_bucket=400).collect()}
    assert sorted(got) == ["a", "b", "one"] and got["one"]["rho"] is None
    for name in "ab":
        both = pdf[[name, "y"]].dropna()
        assert got[name]["n"] == len(both) and got[name]["rho"] == pytest.approx(both[name].rank().corr(both["y"].rank()), abs=1e-12)
    assert not any("y" in names for names in written)


def test_spearman_of_a_constant_target(spark):
    df = spark.range(100_001).select(F.lit(0.1).alias("y"), (F.col("id") % 7).alias("x"), "id")
    assert [r["rho"] for r in stats.spearman(df, "y", ["x", "id"]).collect()] == [None, None]


def test_regression_tests_write_value_counts_only(spark, monkeypatch):
    sizes, write = [], stats.materialize

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(stats, "materialize", counted)
    df = spark.range(3000).select((F.col("id") % 9).alias("a"), (F.col("id") % 4).alias("b"), (F.col("id") % 3).cast("string").alias("s"), F.sqrt("id").alias("y"))
    found = {r["feature"]: r["test_type"] for r in stats.run_tests(df, "y", ["a", "b", "s"], "regression").collect()}
    assert found == {"a": "pearson_spearman", "b": "pearson_spearman", "s": "anova"} and sum(sizes) == 9 + 4


def test_short_texts_are_their_own_keys(spark):
    """Texts below sixteen bytes are no longer digested, longer ones (by bytes) are, and the two are never equal."""
    rows = spark.createDataFrame([("R",), ("",), ("a" * 15,), ("a" * 16,), ("é" * 8,), (None,)], "x string")
    keys = [r["k"] for r in rows.select(stats._digest(F.col("x")).alias("k")).collect()]
    assert [bytes(k) for k in keys[:3]] == [b"R", b"", b"a" * 15] and keys[5] is None
    assert [len(k) for k in keys[3:5]] == [16, 16] and bytes(keys[3]) != b"a" * 16

import math

import pytest
from pyspark.sql import functions as F

from colsight.operators import model, tables
from colsight.plans import analysis


@pytest.fixture(scope="module")
def sales(spark):
    df = spark.range(400).select(
        "id",
        (F.col("id") % 20).cast("double").alias("size"),
        F.element_at(F.array(*[F.lit(v) for v in ("n", "s", "w")]), (F.col("id") % 3 + 1).cast("int")).alias("zone"),
        F.expr("timestamp_ntz'2024-01-10' + make_dt_interval(cast(id % 100 as int))").alias("day"),
        (3.0 * (F.col("id") % 20) + F.when(F.col("id") % 3 == 0, 10.0).otherwise(0.0) + F.col("id") % 7 * 0.1).alias("amount"),
    )
    return df.drop("id")


def test_dummy_columns_keep_missing_as_zero(spark):
    df = spark.createDataFrame([("b", True, 1.0, 1), ("a", False, 2.0, 2), (None, None, 3.0, 3), ("c", True, None, 4), ("c", True, 1.0, None)], "s string, f boolean, x double, y int")
    out = model.dummy_encode(df, "y")
    assert out.columns == ["y", "s_b", "s_c", "f", "x"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 0, 1.0, 1.0), (2, 0, 0, 0.0, 2.0)]


def test_wide_dummies_are_spread_and_keep_odd_names(spark):
    """Rows of one split are spread before thousands of levels are spelled out; levels may hold any character."""
    odd = ["it's", "a`b", "c\\d", "e.f", "\n", "$x", ""]
    df = spark.createDataFrame([(t, i, i) for i, t in enumerate(odd + [f"L{i:04d}" for i in range(1100)])], "s string, _x0 int, y int")
    out = model.dummy_encode(df.coalesce(1), "y")
    levels = sorted(odd + [f"L{i:04d}" for i in range(1100)])
    assert out.columns == ["y", *[f"s_{t}" for t in levels[1:]], "_x0"]
    assert out.rdd.getNumPartitions() > 1  # was 1
    few = model.dummy_encode(df.filter("y < 7"), "y", {"s": sorted(odd)})
    assert sorted(tuple(r) for r in few.collect()) == sorted((i, *[int(t == u) for u in sorted(odd)[1:]], i) for i, t in enumerate(odd))


def test_wide_dummies_look_a_level_up_once_a_row(spark):
    """A cell of a wide frame compares numbers; unknown and missing texts are all zeros, a level that is named twice is two columns."""
    levels = [f"L{i:04d}" for i in range(1100)]
    df = spark.createDataFrame([("L0000", 1), ("L0007", 2), ("L1099", 3), ("other", 4), (None, 5), ("L0007", None)], "s string, y int")
    out = model.dummy_encode(df, "y", {"s": [*levels, "L0007"]})
    assert out.columns == ["y", *[f"s_{t}" for t in levels[1:]], "s_L0007"]
    assert "array_position" in out._jdf.queryExecution().analyzed().toString()  # was a comparison of texts in each cell
    want = [(y, *[int(t == u) for u in [*levels[1:], "L0007"]]) for t, y in [("L0000", 1), ("L0007", 2), ("L1099", 3), ("other", 4), (None, 5)]]
    assert sorted(tuple(r) for r in out.collect()) == want


def test_sums_of_wide_dummies_are_joined_without_the_frame(spark, tmp_path):
    """For a join the optimizer holds all columns below it against each other: with thousands that took longer than any job."""
    from checks.queries import QUERIES

    rows = [(f"C{i % 1200:04d}", float(i)) for i in range(1500)] + [(None, 1.0), ("C0003", None), ("none", None)]
    spark.createDataFrame(rows, "c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    out = QUERIES["dummy_encode_many"][0](spark, str(tmp_path))
    assert "C0003" not in out._jdf.queryExecution().analyzed().toString().split("LocalRelation")[0]  # was every column of the frame
    ones = {r["name"]: r["ones"] for r in out.collect()}
    assert ones == {f"c_name_C{i:04d}": 2 if i < 300 else 1 for i in range(1, 1200)} | {"c_name_none": 0}


def test_split_is_stable_and_near_a_fifth(spark):
    df = spark.range(5000)
    a, b = model.hash_split(df).filter("is_test"), model.hash_split(df.repartition(7)).filter("is_test")
    assert a.exceptAll(b).isEmpty() and 850 < a.count() < 1150


def test_evaluation_with_unseen_class(spark):
    pred = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0)], "label double, prediction double")
    r = model.evaluate_classification(pred).first()
    assert r["accuracy"] == 0.5 and r["recall_weighted"] == 0.5
    assert r["precision_weighted"] == pytest.approx((2 * 1.0 + 1 / 3) / 4)
    reg = model.evaluate_regression(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "label double, prediction double")).first()
    assert reg["mae"] == pytest.approx(1.0) and reg["rmse"] == pytest.approx(math.sqrt(5 / 3)) and reg["r2"] == pytest.approx(1 - 5 / 8)


def test_regression_model_learns(sales):
    trained = model.train_model(sales, "amount")
    assert trained.task_type == "regression" and trained.excluded == ["day"] and trained.feature_count == 3
    assert trained.train_rows + trained.test_rows == 400
    assert model.evaluate(trained).first()["r2"] > 0.99


def test_classification_with_many_levels(sales):
    wide = sales.withColumn("note", F.concat(F.lit("z"), F.col("zone"), (F.col("size") % 5).cast("string")))
    trained = model.train_model(wide.select("note", "size", "zone"), "zone")
    assert trained.task_type == "classification" and trained.feature_count == 15 and trained.classes == ["n", "s", "w"]
    assert model.evaluate(trained).first()["accuracy"] > 0.95
    with pytest.raises(ValueError, match="valid target_column"):
        model.train_model(sales, "absent")


def test_no_level_or_class_is_lost(spark):
    df = spark.range(3000).select(F.format_string("L%05d", F.col("id") % 1500).alias("s"), (F.col("id") % 7).alias("y"))
    wide = model.dummy_encode(df, "y")
    assert len(wide.columns) == 1500 and wide.agg(F.sum("s_L00001"), F.sum("s_L01499")).first()[:] == (2, 2)
    long = model.dummy_long(df.withColumn("k", F.monotonically_increasing_id()), ["k"])
    assert long.columns == ["k", "column", "level"] and long.select("level").distinct().count() == 1500
    table, sizes = model.numbered(df.select(F.lit(0).alias("ordinal"), F.col("s").alias("value")))
    got = [(r["value"], r["index"]) for r in table.orderBy("index").collect()]
    assert sizes == {0: 1500} and got == [(f"L{i:05d}", float(i)) for i in range(1500)]
    coded, labels, n = model.label_encoded(df.select(F.col("s").alias("label")), "label")
    assert n == 1500 and labels.count() == 1500 and coded.agg(F.max("label")).first()[0] == 1499.0


def test_forest_with_many_classes(spark):
    df = spark.range(600).select((F.col("id") % 150).cast("string").alias("y"), (F.col("id") % 150).cast("double").alias("x"), (F.col("id") % 7).cast("string").alias("t"))
    rows = model.feature_importance(df, ["x", "t"], "y", "classification", trees=3, depth=3).collect()
    assert sum(r["feature_importance"] for r in rows) == pytest.approx(1.0)


def test_driver_analysis_says_when_no_forest_fits(sales, monkeypatch):
    def broken(*args, **kwargs):
        raise RuntimeError("too many classes")

    monkeypatch.setattr(model, "feature_importance", broken)
    gappy = sales.withColumn("amount", F.when(F.col("size") > 0, F.col("amount")))
    done = analysis.driver_analysis(gappy, "amount", limits=analysis.targets.REPORT_LIMITS)
    assert [r["feature_importance"] for r in done.ranking.collect()] == [None, None]
    assert len(done.data_quality_flags) == 2 and "too many classes" in done.data_quality_flags[1]
    assert done.results.first()["data_quality_flags"] == done.data_quality_flags[:1]


def test_drivers_after_steps(sales):
    steps = [{"step_id": "c", "operation": "CLEAN_DATA"}]
    run, done = analysis.report_with_drivers(sales, steps, "amount", trees=5)
    assert run.results.first()["status"] == "SUCCESS" and done.ranking.count() == 2


def test_all_features_are_tested_unless_limited(spark):
    df = spark.range(60).select(*[(F.col("id") * (k + 2) % 31).cast("double").alias(f"m{k}") for k in range(12)], (F.col("id") % 2 == 0).alias("y"))
    assert analysis.driver_analysis(df, "y", importance=False).results.count() == 12
    limited = analysis.driver_analysis(df, "y", importance=False, limits=analysis.targets.REPORT_LIMITS)
    assert limited.results.count() == 8


def test_boolean_sums_and_trends(spark):
    df = spark.createDataFrame([("2024-01-31", True), ("2024-01-02", False), ("2024-02-01", True)], "d string, f boolean")
    assert [r["value"] for r in tables.trend(df, "d", "f").collect()] == [0.5, 1.0]
    assert {r["group"]: r["value"] for r in tables.group_top(df, "d", "f", "sum").collect()}["2024-01-31"] == 1


def test_sparse_levels_equal_columns(spark, monkeypatch):
    df = spark.range(600).select(
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("v"), F.col("id") % 8)).alias("s"), (F.col("id") % 13).cast("double").alias("x"),
        ((F.col("id") % 8) * 2.0 + F.col("id") % 13 + F.col("id") % 9).alias("y"),
    )
    columns = model.training_frame(df, "y", "regression")
    monkeypatch.setattr(model, "COLUMN_LEVELS", 2)
    sparse = model.training_frame(df, "y", "regression")
    assert columns.feature_count == sparse.feature_count == 8
    a, b = (model.fit_linear(f.rows) for f in (columns, sparse))
    assert a.coefficients.toArray() == pytest.approx(b.coefficients.toArray(), abs=1e-6)


def test_forest_weights_sum_to_one_and_name_their_columns(spark):
    df = spark.range(300).select(
        (F.col("id") % 5).cast("double").alias("a"), F.concat(F.lit("v"), F.col("id") % 90).alias("a_b"), (F.col("id") % 5 > 2).alias("y")
    )
    rows = {r["feature"]: r["feature_importance"] for r in model.feature_importance(df, ["a", "a_b"], "y", "classification", trees=10, depth=4).collect()}
    assert set(rows) == {"a", "a_b"} and sum(rows.values()) == pytest.approx(1.0) and rows["a"] > rows["a_b"] >= 0
    assert model.feature_importance(df.limit(19), ["a"], "y", "classification").isEmpty()


def test_group_aggregates_and_errors(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", None, 3), (None, 9.0, 4), ("a", 8.0, 5)], "g string, v double, o int")
    def one(agg, **kw):
        return {r["group"]: r["value"] for r in tables.group_top(df, "g", "v", agg, **kw).collect()}

    assert one("median") == {"a": 3.0, "b": None} and one("sum") == {"a": 12.0, "b": 0.0}
    assert one("first", order_column="o") == {"a": 1.0, "b": None} and one("last", order_column="o")["a"] == 8.0
    assert one("size") == {"a": 3, "b": 1} and one("count") == {"a": 3, "b": 0} and one("prod")["a"] == 24.0
    with pytest.raises(ValueError, match="Valid group_by"):
        tables.group_top(df, "zzz", "v")
    with pytest.raises(ValueError, match="Unsupported aggregate"):
        tables.group_top(df, "g", "v", "nope")


def test_grouped_median_over_ranges(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("group"), (F.col("id") * 37 % 1009).cast("double").alias("target"))
    a = {r["group"]: r["value"] for r in tables.grouped_median(df, rows_per_bucket=100).collect()}
    b = df.toPandas().groupby("group").target.median().to_dict()
    assert a == b


def test_correlation_of_constant_and_gaps(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 6.0, 5.0), (4.0, 9.0, 5.0)], "a double, b double, k double")
    got = {(r["column_a"], r["column_b"]): r["r"] for r in tables.correlation_matrix(df).collect()}
    assert got["a", "b"] == got["b", "a"] == round(df.toPandas()[["a", "b"]].corr().iloc[0, 1], 4)
    assert got["a", "k"] is None and got["k", "k"] is None and got["a", "a"] == 1.0
    with pytest.raises(ValueError, match="At least two numeric"):
        tables.correlation_matrix(df.select("a"))


def test_wide_correlation_takes_the_matrix_for_full_columns(spark):
    cols = [((F.col("id") * (k + 3) * 7919) % 1013).cast("double").alias(f"c{k}") for k in range(12)]
    gappy = F.when(F.col("id") % 5 > 0, F.col("id") % 17).cast("double").alias("gap")
    df = spark.range(500).select(*cols, gappy, F.lit(2.0).alias("const"))
    got = {(r["column_a"], r["column_b"]): r["r"] for r in tables.correlation_pairs(df).collect()}
    want = df.toPandas().corr()
    assert len(got) == 14 * 13 // 2
    for (a, b), r in got.items():
        if "const" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b])


def test_month_gaps_show_as_zero(spark):
    df = spark.createDataFrame([("2024-01-31",), ("2024-04-30",), ("2024-04-01",), (None,), ("2024-02-01",)], "d string")
    got = [(str(r["month_end"]), r["value"]) for r in tables.trend(df, "d").collect()]
    assert got == [("2024-01-31", 1.0), ("2024-02-29", 1.0), ("2024-03-31", 0.0), ("2024-04-30", 2.0)]
    with pytest.raises(ValueError, match="No parseable"):
        tables.trend_points(spark.createDataFrame([("x",)], "d string"), "d")


def test_step_list_goes_on_after_failures(sales):
    run = analysis.run_steps(
        sales,
        [
            {"step_id": "e", "operation": "EVALUATE_MODEL"},
            {"step_id": "x", "operation": "DANCE"},
            {"step_id": "g", "operation": "GROUPBY", "parameters": {"group_by": "zone", "target_column": "amount"}},
            {"step_id": "bad", "operation": "GROUPBY", "parameters": {"group_by": "absent", "target_column": "amount"}},
            {"step_id": "c", "operation": "CLEAN_DATA", "parameters": {"operations": ["drop_duplicates", "remove_outliers_iqr"]}},
            {"step_id": "t", "operation": "TREND", "parameters": {"datetime_column": "day", "target_column": "amount"}},
        ],
    )
    got = {r["step_id"]: r for r in run.results.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"e": "FAILED", "x": "FAILED", "g": "SUCCESS", "bad": "FAILED", "c": "SUCCESS", "t": "SUCCESS"}
    assert got["x"]["summary"] == "DANCE failed: Unknown operation_type: DANCE"
    assert got["e"]["summary"] == "EVALUATE_MODEL failed: No trained model available for evaluation."
    assert got["g"]["summary"] == "Computed mean by zone for amount." and set(got["g"]["metrics"]) == {"n", "s", "w"}
    assert set(run.frames) == {"g", "c", "t"}


def test_recipes(sales):
    rows = analysis.P.collect_profile(sales)
    assert [s["operation"] for s in analysis.recipe("DESCRIPTIVE", rows)] == ["SUMMARY", "GROUPBY", "TREND"]
    assert [s["operation"] for s in analysis.recipe("DIAGNOSTIC", rows)] == ["SUMMARY", "GROUPBY", "CORRELATION"]
    assert analysis.recipe("PREDICTIVE", rows)[0]["parameters"]["target_column"] == "amount"
    assert [s["operation"] for s in analysis.recipe("DATA_CLEANING", rows)] == ["CLEAN_DATA", "SUMMARY"]
    assert [s["operation"] for s in analysis.recipe("DESCRIPTIVE", None)] == ["SUMMARY"]
    with pytest.raises(ValueError):
        analysis.report(sales, "EXPLANATORY", profile=rows)


def test_driver_analysis_end_to_end(sales):
    done = analysis.report(sales, "EXPLANATORY", "amount")
    assert done.target_type == "regression"
    ranks = done.ranking.orderBy("importance_rank").collect()
    assert [r["importance_rank"] for r in ranks] == [1, 2] and ranks[0]["feature"] == "size" and ranks[0]["strength_score"] == 1.0
    assert abs(sum(r["feature_importance"] for r in ranks) - 1) < 1e-6
    assert done.answer.first()["direct_answer"].startswith("The strongest driver for amount is size,")


def test_driver_analysis_counts_each_kind_of_row_once(spark, monkeypatch):
    df = spark.range(40_000).select((F.col("id") % 3).cast("string").alias("y"), (F.col("id") % 50).cast("double").alias("size"), (F.col("id") % 4).cast("string").alias("zone"))
    sent, write = [], model.forest.materialize

    def counted(table):
        if "by_task" in table.columns:
            sent.append(table.agg(F.max("by_task")).first()[0])
        return write(table.drop("by_task"))

    by_task = model.forest._counted_by_task
    monkeypatch.setattr(model.forest, "_counted", lambda *a: by_task(*a).groupBy("tree", "node", "feature", "level", "class").agg(
        F.sum("w").alias("w"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("by_task")))
    monkeypatch.setattr(model.forest, "materialize", counted)
    done = analysis.driver_analysis(df, "y", trees=3)
    assert done.data_quality_flags == [] and done.ranking.agg(F.sum("feature_importance")).first()[0] == pytest.approx(1.0)
    assert sent and max(sent) == 1

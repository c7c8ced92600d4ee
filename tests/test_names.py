"""Tables whose own columns have the names of helper columns."""

import pytest

from colsight.functions.exprs import free_name
from colsight.operators import blocks, cleaning, missing, model, stats


def test_free_name():
    assert free_name(["a", "_V0", "__x"], "_v") == "_v_" and free_name([], "_v") == "_v"


def test_drop_duplicates_keeps_cells(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "_row_hash bigint, _row_hash_ string")
    assert sorted(map(tuple, cleaning.drop_duplicates(df).collect())) == [(1, "a"), (2, "b")]
    maps = spark.createDataFrame([(1, {"x": 1}), (1, {"x": 1}), (2, {"x": 2})], "_key0 int, m map<string,int>")
    assert sorted(r["_key0"] for r in cleaning.drop_duplicates(maps).collect()) == [1, 2]


def test_is_test_is_a_feature(spark):
    rows = [(float(i % 9), i % 2 == 0, (3.0 if i % 2 == 0 else 0.0) + i % 9) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, is_test boolean, y double")
    trained = model.train_model(df, "y")
    assert trained.feature_count == 2 and list(trained.model.coefficients) == pytest.approx([1.0, 3.0])
    assert model.train_model(df, "is_test").task_type == "classification"
    for split in (model.hash_split, lambda t: model.modulo_split(t.withColumn("k", t.a.cast("int")), "k")):
        with pytest.raises(ValueError, match="another name"):
            split(df)
    assert model.hash_split(df, name="part").columns == ["a", "is_test", "y", "part"]


@pytest.mark.parametrize("rows_per_bucket", [2_000_000, 3])
def test_fill_datetime(spark, rows_per_bucket):
    names = ["_v0", "_bucket", "_b", "_k0", "_p0", "_v0_fill"]
    rows = [(i, f"2024-01-{i + 1:02d} 00:00:00" if i % 3 else None, *range(6)) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, d string, " + ", ".join(f"{n} int" for n in names))
    df = df.withColumn("d", df.d.cast("timestamp"))
    out = missing.fill_datetime(df, ["d"], ["k"], rows_per_bucket=rows_per_bucket)
    assert out.columns == df.columns
    got = {r["k"]: r for r in out.collect()}
    assert [got[i]["d"].day for i in range(12)] == [2, 2, 3, 3, 5, 6, 6, 8, 9, 9, 11, 12]
    assert all(tuple(r[2:]) == tuple(range(6)) for r in got.values())
    keyed = missing.fill_datetime(df, ["d"], ["k"], ["_v0"], rows_per_bucket=rows_per_bucket)
    assert {r["k"]: r["d"] for r in keyed.collect()} == {k: r["d"] for k, r in got.items()}


def test_running_totals_and_grouped_aggregates(spark):
    df = spark.createDataFrame([("a", i, 1, 7) for i in range(10)], "_l0 string, _bucket int, n int, _t0 int")
    bucket = blocks.range_bucket(df, ["_bucket"], 10, 3)
    out = blocks.running_totals(df, ["_l0"], ["_bucket"], ["n"], bucket).collect()
    assert {r["_bucket"]: (r["n_before"], r["n_total"]) for r in out} == {i: (i, 10) for i in range(10)}
    found = blocks.per_column_agg(df, ["n"], lambda n: {"total": f"sum({n})"}, keys=["_t0"]).withColumnRenamed("_t0", "_m0")
    assert found.first()["total"] == 10
    again = blocks.per_column_agg(df.withColumnRenamed("_t0", "_m0"), ["n"], lambda n: {"total": f"sum({n})"}, keys=["_m0"]).first()
    assert (again["_m0"], again["total"]) == (7, 10)
    classes = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 5.0)], "y string, _class double")
    assert {r["class"]: r["mean"] for r in stats.class_moments(classes, "y", ["_class"]).collect()} == {"x": 2.0, "y": 5.0}

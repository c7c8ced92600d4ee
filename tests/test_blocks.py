import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.operators import blocks as B
from colsight.operators import cleaning
from colsight.session import materialize, release, release_all


@pytest.mark.parametrize("cell", [5, 100, 100_000])
def test_quantiles_equal_pandas(spark, cell):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({
        "normal": rng.normal(size=3000),
        "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 50, 3000).astype(float)),
        "two": np.r_[np.zeros(1499), rng.random(2), np.ones(1499)],
        "whole": rng.integers(-5, 5, 3000),
    })
    pdf.loc[::7, "normal"] = None
    df = spark.createDataFrame(pdf)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = B.exact_quantiles(df, list(pdf.columns), probs, cell=cell)
    for n in pdf.columns:
        assert np.allclose(got[n], pdf[n].quantile(list(probs)), atol=1e-12), n


def test_quantiles_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(1.5, None), (None, None)], "a double, b double")
    assert B.exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [1.5], "b": None}


def test_running_totals_do_not_depend_on_buckets(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5003).alias("v"), (F.col("id") % 5).alias("n"))
    whole = B.running_totals(df, ["g"], ["v"], ["n"], None)
    split = B.running_totals(df, ["g"], ["v"], ["n"], B.range_bucket(df, ["g", "v"], 2000, 100))
    assert whole.exceptAll(split).isEmpty() and split.count() == 2000


def test_range_buckets_follow_the_order_of_mixed_keys(spark):
    df = spark.range(1000).select((F.col("id") % 10).cast("string").alias("s"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id)").alias("t"))
    bucket = B.range_bucket(df, ["s", "t"], 1000, 100)
    rows = df.withColumn("b", bucket).orderBy("s", "t").collect()
    found = [r["b"] for r in rows]
    assert found == sorted(found) and len(set(found)) > 5


def test_duplicates_with_nulls_and_both_ways(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a"), (3, "b")], "k int, v string")
    assert B.duplicate_count(df) == (6, 3)
    assert B.duplicate_count(df, suspect_limit=0) == (6, 3)
    assert B.duplicate_count(df.limit(0)) == (0, 0)


def test_frequencies_break_ties_by_typed_value(spark):
    df = spark.createDataFrame([(10, "b", True), (9, "a", False), (10, "b", False), (9, "a", None)], "n int, s string, f boolean")
    rows = {r["ordinal"]: r for r in B.frequency_stats(df, ["n", "s", "f"]).collect()}
    assert (rows[0]["top_value"], rows[0]["top_frequency"], rows[0]["n_distinct"]) == ("9", 2, 2)
    assert rows[1]["top_value"] == "a" and rows[2]["top_value"] == "False"


def test_long_texts_are_counted_by_digest(spark):
    long = ["x" * 200 + str(i % 4) for i in range(10)] + [None]
    df = spark.createDataFrame([(t,) for t in long], "t string")
    assert B.long_text_columns(df, ["t"]) == ["t"]
    row = B.frequency_stats(df, ["t"]).first()
    assert (row["n_distinct"], row["top_value"], row["top_frequency"]) == (4, "x" * 200 + "0", 3)


def test_modes_keep_their_type(spark):
    df = spark.createDataFrame([("b", 2.5, None), ("a", 2.5, None), ("b", 1.0, None), ("a", None, None)], "s string, x double, e int")
    assert B.smallest_modes(df, ["s", "x", "e"]) == {"s": "a", "x": 2.5, "e": None}


def test_materialized_table_is_kept_under_the_checkpoint_folder(spark):
    df = materialize(spark.range(10).filter("id > 3"))
    files = [f.removeprefix("file:").replace("//", "/") for f in df.inputFiles()]
    assert df.count() == 6 and all("/table-" in f and os.path.exists(f) for f in files)
    release(df)
    assert not any(map(os.path.exists, files))
    with pytest.raises(ValueError):
        release(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))


def test_all_tables_of_an_application_are_released(spark):
    one, two = (materialize(spark.range(n)).inputFiles()[0].removeprefix("file:").replace("//", "/") for n in (3, 4))
    assert os.path.exists(one) and one.rsplit("/", 2)[0] == two.rsplit("/", 2)[0]
    release_all(spark)
    assert not os.path.exists(one) and not os.path.exists(two)


def test_many_columns_go_in_bounded_aggregates(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 37).cast("double").alias(f"c{i}") for i in range(300)])
    got = B.exact_quantiles(df, df.columns, [0.5])
    want = df.toPandas().median()
    assert len(got) == 300 and all(got[n][0] == want[n] for n in df.columns)
    assert B.gap_counts(df, df.columns).agg(F.sum("n_missing")).first()[0] == 0


def test_maps_are_compared_by_their_entries(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, 1 AS k UNION ALL SELECT map('b', 2, 'a', 1), 1 UNION ALL SELECT map('a', 2), 1")
    assert B.duplicate_count(df) == (3, 1)
    assert cleaning.drop_duplicates(df).count() == 2

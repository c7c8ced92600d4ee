import datetime as dt

import pandas as pd
import pytest

from colsight.operators import cleaning, missing
from colsight.operators import profile as P


def test_mode_tie_takes_smallest_and_unknown(spark):
    df = spark.createDataFrame([("b", None, None), ("a", None, None), ("b", None, None), ("a", None, None), (None, None, None)], "s string, e string, n int")
    out = missing.fill_mode(df, ["s", "e", "n"])
    assert {r["s"] for r in out.collect()} == {"a", "b"} and out.filter("s = 'a'").count() == 3
    assert {r["e"] for r in out.collect()} == {"UNKNOWN"} and {r["n"] for r in out.collect()} == {None}


def test_median_fill_widens_integers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert sorted(r["x"] for r in missing.fill_median(df, ["x"]).collect()) == [1.0, 1.5, 2.0]
    empty = spark.createDataFrame([(None,)], "x double")
    assert missing.fill_median(empty, ["x"]).first()["x"] == 0.0
    assert cleaning.fill_numbers(empty).first()["x"] is None


@pytest.mark.parametrize("rows_per_bucket", [3, 1000])
def test_datetime_fill_equals_pandas(spark, rows_per_bucket):
    days = [None, None, 3, None, 5, 6, None, None, None, 10, None, 12, None, 14, None, None, 17, None, None, None]
    rows = [(i, None if d is None else dt.datetime(2024, 1, d)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz").repartition(5)
    out = missing.fill_datetime(df, ["at"], ["k"], rows_per_bucket=rows_per_bucket)
    want = pd.Series([r[1] for r in rows]).ffill().bfill().tolist()
    assert [r["at"] for r in out.orderBy("k").collect()] == [w.to_pydatetime() for w in want]


def test_datetime_fill_by_group_with_text_dates_and_null_keys(spark):
    rows = [("a", 1, "2024-01-01"), ("a", 2, None), ("b", 1, None), ("b", 2, "2024-02-02"), (None, 1, "2024-03-03"), (None, 2, "oops"), ("a", 3, "2024-01-03")]
    df = spark.createDataFrame(rows, "g string, k int, d string")
    for size in (2, 1000):
        out = missing.fill_datetime(df, ["d"], ["k"], ["g"], rows_per_bucket=size).collect()
        got = {(r["g"], r["k"]): r["d"].day for r in out}
        assert got == {("a", 1): 1, ("a", 2): 1, ("b", 1): 2, ("b", 2): 2, (None, 1): 3, (None, 2): 3, ("a", 3): 3}


def test_datetime_fill_ties_are_simultaneous(spark):
    t = dt.datetime(2024, 5, 5)
    df = spark.createDataFrame([(1, None, 0), (1, t, 1), (2, None, 2)], "k int, at timestamp_ntz, n int")
    assert {r["at"] for r in missing.fill_datetime(df, ["at"], ["k"]).collect()} == {t}


def test_nothing_missing_suggests_nothing(spark):
    profile = P.column_profile(spark.createDataFrame([(1, "a"), (1, "b")], "x int, s string"))
    assert missing.suggest_treatments(profile).isEmpty()


def test_treat_reports_and_refuses(spark):
    rows = [(float(i % 12), "x" if i % 3 else None, None if i % 2 else i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "m double, s string, h int")
    done = missing.treat(df, "DROP_HIGH_MISSING_COLUMNS")
    r = done.report.first()
    assert done.table.columns == ["m", "s"] and r["affected_columns"] == ["h"] and r["missing_before"] == 50 and r["missing_after"] == 20
    assert r["summary"] == "Drop High-Missing Columns applied. Missing values reduced from 50 to 20."
    smart = missing.treat(df, "SMART_IMPUTE")
    assert missing.missing_total(smart.table).first()["ready"]
    with pytest.raises(ValueError, match="not among the suggested"):
        missing.treat(df, "FILL_DATETIME_FFILL")
    with pytest.raises(ValueError, match="Unsupported missing-value action"):
        missing.apply_treatment(df, "NO_SUCH")


def test_clean_order_and_outliers(spark):
    rows = [(float(i), 1.0) for i in range(20)] + [(1000.0, 1.0), (3.0, 1.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert cleaning.drop_duplicates(df).count() == 22
    assert cleaning.drop_duplicates(df, suspect_limit=0).count() == 22
    kept = cleaning.remove_outliers(df)
    assert kept.count() == 21 and kept.filter("x = 1000").isEmpty()
    assert cleaning.remove_outliers(spark.createDataFrame([(None, 1.0)], "x double, y double")).isEmpty()
    pdf = pd.DataFrame(rows, columns=["x", "y"])
    for mode in ("sequential", "simultaneous"):
        q1, q3 = pdf.x.quantile(0.25), pdf.x.quantile(0.75)
        want = pdf[(pdf.x >= q1 - 1.5 * (q3 - q1)) & (pdf.x <= q3 + 1.5 * (q3 - q1))]
        assert cleaning.remove_outliers(df, mode=mode).count() == len(want)


def test_clean_metrics(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "x int, s string")
    out = cleaning.clean(df)
    row = cleaning.clean_metrics(df, out, 1).first()
    assert (row["rows_before"], row["rows_after"], row["missing_before"], row["missing_after"]) == (3, 2, 2, 0)

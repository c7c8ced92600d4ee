import datetime as dt

from pyspark.sql import functions as F

from colsight.operators import insights
from colsight.operators import profile as P


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_unique_columns_are_identifiers_first(spark):
    df = spark.createDataFrame([(1, "Alice", 25, 85.5), (2, "Bob", 30, 90.0), (3, "Charlie", 35, 88.5)], "id int, name string, age int, score double")
    assert {r["role"] for r in P.column_profile(df).collect()} == {"IDENTIFIER"}


def test_roles_and_summaries(spark):
    rows = [
        (i % 11 + 0.5, i % 3, i % 2 == 0, f"w{i % 60}", ["x", "y"][i % 2], dt.datetime(2024, 1, 1 + i % 5), None, None, None, i % 4, [1])
        for i in range(120)
    ]
    schema = (
        "metric double, few int, flag boolean, words string, cat string, at timestamp, none_num double, none_text string, "
        "none_time timestamp, paid int, nested array<int>"
    )
    p = by_column(P.column_profile(spark.createDataFrame(rows, schema)))
    roles = {n: r["role"] for n, r in p.items()}
    assert roles == {
        "metric": "NUMERIC_METRIC", "few": "CATEGORICAL_DIMENSION", "flag": "BOOLEAN", "words": "TEXT", "cat": "CATEGORICAL_DIMENSION",
        "at": "DATETIME", "none_num": "CATEGORICAL_DIMENSION", "none_text": "CATEGORICAL_DIMENSION", "none_time": "DATETIME", "paid": "IDENTIFIER",
    }
    assert p["metric"]["min"] == 0.5 and p["metric"]["top_value"] is None
    assert p["few"]["mean"] is None and p["few"]["top_value"] == "0" and p["few"]["top_frequency"] == 40
    assert p["flag"]["top_value"] == "False"
    assert p["none_text"]["n_distinct"] == 0 and p["none_text"]["top_frequency"] == 0 and p["none_text"]["missing_pct"] == 100.0


def test_empty_and_single_row(spark):
    empty = by_column(P.column_profile(spark.createDataFrame([], "a int, b string")))
    assert empty["a"]["role"] == "CATEGORICAL_DIMENSION" and empty["a"]["missing_pct"] == 0.0 and empty["a"]["is_candidate_key"]
    one = by_column(P.numeric_summary(spark.createDataFrame([(4.0,)], "a double")))
    assert one["a"]["std"] is None and one["a"]["mean"] == 4.0


def test_nan_is_missing(spark):
    p = by_column(P.missing_percentages(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")))
    assert p["x"]["n_missing"] == 2 and p["x"]["missing_pct"] == 66.67


def test_datetime_texts(spark):
    good = [f"2024-01-{d:02d}" for d in range(1, 10)] + ["n/a"]
    bad = [f"2024-01-{d:02d}" for d in range(1, 8)] + ["n/a"] * 3
    us = [f"{d}/13/2024" for d in range(1, 10)] + ["1/1/2024"]
    eu = [f"13/{d}/2024" for d in range(1, 10)] + ["1/1/2024"]
    df = spark.createDataFrame(list(zip(good, bad, us, eu)), "good string, bad string, us string, eu string")
    found = {r["column"]: (round(r["parse_ratio"], 2), r["is_datetime"]) for r in P.datetime_detection(df).collect()}
    assert found == {"good": (0.9, True), "bad": (0.7, False), "us": (1.0, True), "eu": (1.0, True)}
    assert P.detect_datetime_format(df, "us") == "M/d/yyyy" and P.detect_datetime_format(df, "eu") == "d/M/yyyy"
    assert P.detect_datetime_format(df, "bad") is None


def test_identifier_names_match_inside_words(spark):
    df = spark.createDataFrame([("paid",), ("width",), ("monkey",), ("zip code",), ("name",)], "column string")
    hits = {r["column"] for r in df.filter(P.identifier_name(df["column"])).collect()}
    assert hits == {"paid", "width", "monkey", "zip code"}


def test_catalog(spark):
    a = spark.createDataFrame([(1, "x", [1]), (1, "x", [1]), (2, "y", [2])], "k int, v string, nested array<int>")
    columns, tables = P.profile_catalog({"a": a, "b": spark.range(3)})
    got = {r["table_name"]: r for r in tables.collect()}
    assert columns.count() == 3
    assert got["a"]["duplicate_rows"] == 1 and got["a"]["total_columns"] == 3 and got["a"]["skipped_columns"] == ["nested"]
    assert got["b"]["potential_primary_keys"] == ["id"] and got["b"]["identifier_columns"] == ["id"]


def test_tables_without_numbers_texts_or_atomic_columns(spark):
    texts = spark.createDataFrame([("a",)], "s string")
    numbers = spark.createDataFrame([(1,)], "x int")
    nested = spark.createDataFrame([([1], {"a": 1})], "v array<int>, m map<string,int>")
    assert P.numeric_summary(texts).isEmpty() and P.datetime_detection(numbers).isEmpty() and P.column_profile(nested).isEmpty()
    columns, tables = P.profile_catalog({"n": nested, "t": texts})
    assert [r["table_name"] for r in columns.collect()] == ["t"] and tables.count() >= 1


def test_formats_that_programs_write(spark):
    texts = [
        "2024-01-01T10:00:00.123", "2024-01-01T10:00:00.123456", "2024-01-01 10:00:00.123", "2024-01-01 10:00:00+00:00", "2024-01-01T10:00",
        "January 1, 2024", "01-Jan-2024", "1/1/2024 10:00:00", "  2024-01-01 10:00:00                               ",
    ]
    df = spark.createDataFrame([tuple(texts)], ", ".join(f"t{i} string" for i in range(len(texts))))
    assert all(r["is_datetime"] for r in P.datetime_detection(df).collect())
    parsed = df.select(*[P.parsed_datetime(n, P.detect_datetime_format(df, n)).cast("date").cast("string").alias(n) for n in df.columns])
    assert set(parsed.first()) == {"2024-01-01"}


def test_approximate_distinct_counts(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("a"), F.lit("x").alias("b"))
    exact, near = ({r["column"]: r["n_distinct"] for r in P.distinct_counts(df, approx=a).collect()} for a in (False, True))
    assert exact == {"a": 5000, "b": 1} and near["b"] == 1 and abs(near["a"] - 5000) < 500


def test_answers_without_a_profile(spark):
    names = spark.createDataFrame([("t",), ("u",)], "table_name string")
    rows = insights.unprofiled(names, insights.UNPROFILED_OVERVIEW).collect()
    assert len(rows) == 2 and rows[0]["confidence"] == 0.25 and rows[0]["important_features"] == []
    assert insights.unprofiled(names, insights.UNPROFILED_DOMAIN).first()["suggested_kpis"] == ["Missing Data Rate", "Duplicate Row Rate"]

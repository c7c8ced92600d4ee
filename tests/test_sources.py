import pytest
from pyspark.sql import functions as F

from colsight.sources import html
from colsight.sources import tables as S

PAGE = (
    "<html><body><script>var s = '<table>';</script><table><thead><tr><th>Name</th><th>Age</th></tr></thead>"
    "<tr><td>Ann <b>B.</b></td><td>30</td></tr><tr><td>Bob<table><tr><td>inner</td></tr></table></td><td>41</td></tr></table>"
    "<table><tr><td>second</td></tr></table></body></html>"
)


def test_csv_is_typed_and_na_tokens_are_missing(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "id,name,age,score,flag,empty\n1,Alice,25,85.5,True,\n2,NA,30,90.0,False,NA\n3,Bob,35,NaN,True,null\n"
        '4,"a, b",N/A,,False,\n5,x,7,1e3,True,\n'
    )
    df = S.load_table(spark, str(path))
    assert dict(df.dtypes) == {
        "id": "bigint", "name": "string", "age": "bigint", "score": "double", "flag": "boolean", "empty": "double",
    }
    rows = df.orderBy("id").collect()
    assert [r["score"] for r in rows] == [85.5, 90.0, None, None, 1000.0]
    assert [r["name"] for r in rows] == ["Alice", None, "Bob", "a, b", "x"]
    assert rows[3]["age"] is None


def test_small_csv(spark, tmp_path):
    path = tmp_path / "test_sample.csv"
    path.write_text("id,name,age,score\n1,Alice,25,85.5\n2,Bob,30,90.0\n3,Charlie,35,88.5\n")
    df = S.ingest(spark, str(path))
    assert df.count() == 3
    assert S.validate(df) == (True, None)


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError, match="No reader for files of type .exe"):
        S.load_table(spark, "/x/y.exe")


def test_json_and_parquet_dispatch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.write.json(str(tmp_path / "t.json"))
    assert S.load_table(spark, str(tmp_path / "t.parquet")).count() == 2
    assert S.load_table(spark, str(tmp_path / "t.json")).count() == 2


def test_first_html_table(spark):
    pages = spark.createDataFrame([("p1", PAGE), ("p2", "<p>no</p>"), ("p3", "<!-- <table> -->"), ("p4", None)], "page_id string, html string")
    rows = html.html_tables(pages).orderBy("row_no").collect()
    assert {r["page_id"] for r in rows} == {"p1"}
    assert [(r["is_header"], r["cells"]) for r in rows] == [
        (True, ["Name", "Age"]), (False, ["Ann B.", "30"]), (False, ["Bobinner", "41"]),
    ]
    assert sorted(r[0] for r in html.pages_without_table(pages).collect()) == ["p2", "p3", "p4"]


def test_html_file_as_table(spark, tmp_path):
    path = tmp_path / "page.html"
    path.write_text(PAGE)
    df = S.load_table(spark, str(path))
    assert dict(df.dtypes) == {"Name": "string", "Age": "bigint"}
    assert [r["Age"] for r in df.orderBy("Age").collect()] == [30, 41]
    empty = tmp_path / "none.html"
    empty.write_text("<p>nothing</p>")
    with pytest.raises(ValueError, match="holds no table"):
        S.load_table(spark, str(empty))


def test_html_colspan_and_unclosed_cells():
    assert html.first_table("<table><tr><td colspan=2>a<td>b<tr><td>c</table>") == [(False, ["a", "a", "b"]), (False, ["c"])]


def test_html_rowspan_and_header_rows(spark, tmp_path):
    page = (
        "<table><thead><tr><th rowspan=2>k<th colspan=2>v<tr><th>a<th>b</thead><tr><td rowspan=3>x<td>1<td>2"
        "<tr><td>3<td rowspan=2>4<tr><td>5<tr><td>y<td>6<td>7</table>"
    )
    rows = html.first_table(page)
    assert rows[:2] == [(True, ["k", "v", "v"]), (True, ["k", "a", "b"])]
    assert [r for _, r in rows[2:]] == [["x", "1", "2"], ["x", "3", "4"], ["x", "5", "4"], ["y", "6", "7"]]
    (tmp_path / "one.html").write_text(page)
    assert S.load_table(spark, str(tmp_path / "one.html")).columns == ["k", "v a", "v b"]
    (tmp_path / "two.html").write_text("<table><tr><td>1</table>")
    with pytest.raises(ValueError, match="Several pages"):
        S.load_table(spark, str(tmp_path), fmt="html")


def test_csv_line_breaks_and_repeated_names(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b,a\n1,"x\ny",2\n3,"say ""hi""",4\n')
    df = S.load_table(spark, str(tmp_path / "q.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "a.1": "bigint"}
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x\ny", 2), (3, 'say "hi"', 4)]


def test_names_are_stripped_lowered_and_unique():
    assert S.normalized_names([" ID ", "id", "A b", "ID"]) == ["id", "id.1", "a b", "id.2"]
    assert S.normalized_names(["a", "A", "a.1"]) == ["a", "a.2", "a.1"]


def test_validation(spark):
    assert S.validate(None) == (False, "There is no table.")
    assert S.validate(spark.createDataFrame([], "a int")) == (False, "The table has no rows.")
    ok, why = S.validate(spark.range(5), max_rows=4)
    assert not ok and "more rows" in why


def test_file_inventory(spark, tmp_path):
    (tmp_path / "a.CSV").write_bytes(b"x" * 2 * 1024 * 1024)
    (tmp_path / "b.html").write_bytes(b"y" * 10)
    rows = {r["name"]: r for r in S.file_inventory(spark, str(tmp_path), max_mb=1).collect()}
    assert rows["a.CSV"]["size_mb"] == 2.0 and rows["a.CSV"]["extension"] == ".csv" and not rows["a.CSV"]["accepted"]
    assert rows["b.html"]["accepted"] and rows["b.html"]["size_bytes"] == 10


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert S.na_to_null(df).filter(F.col("x").isNull()).count() == 2


def test_spans_are_bounded(spark):
    page = '<table><tr><td colspan="3000000">a</td></tr><tr><td rowspan="99999999999">b</td><td colspan="0">c</td></tr><tr><td colspan="²">d</td></tr></table>'
    rows = html.html_tables(spark.createDataFrame([("p", page)], "page_id string, html string")).orderBy("row_no").collect()
    assert len(rows[0]["cells"]) == 1000 and set(rows[0]["cells"]) == {"a"}
    assert [r["cells"][:2] for r in rows[1:]] == [["b", "c"], ["b", "d"]]

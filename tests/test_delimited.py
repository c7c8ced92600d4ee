import csv
import random

import pytest

from colsight.sources import delimited
from colsight.sources import tables as S


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "800")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerows(rows)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_line_ends():
    ends = delimited.line_ends({"escape": '"'})
    assert ends("a,b") == (False, True)
    assert ends('a,"b') == (True, False)
    assert ends('"a""') == (True, False) and ends('""a') == (False, True)
    assert ends('5" pipe,x') == (False, False)
    assert ends('x",y') == (False, False)
    assert ends('x","y') == (True, True) and ends('x,y') == (False, True)
    assert ends('"a","b ""c"" d",e') == (False, False)
    backslash = delimited.line_ends({})
    assert backslash('"a\\"') == (True, False) and backslash('"a\\""') == (False, False)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_whole_file_reader(spark, tmp_path, small_splits, end):
    rng = random.Random(2)
    parts = ["x", "a b", '"', "\n", "\n\n", ",", '""', "5\" pipe", "line\nbreak", "", "é", "\"q\"", "end\n", " pad "]
    rows = [["k", "one", "two\nlines"]]
    rows += [[i, "".join(rng.choices(parts, k=rng.randrange(5))) + "z", rng.choice(["plain", 'in "quotes"\nand on'])] for i in range(300)]
    rows += [[1000, "a" + "\nlong" * 400 + "b", "over many ranges"], [1001, "last", "x"]]
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", rows, end)
    options = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    found = delimited.records(spark, str(folder / "a.csv"), options)
    assert found.select("start").distinct().count() > 10
    assert delimited.first_fields(found, options) == rows[0]
    got = delimited.read(found, options, rows[0])
    assert rows_of(got) == sorted((tuple(map(str, r)) for r in rows[1:]), key=str)
    if end == "\n":  # the whole-file reader leaves carriage returns at the ends of records
        assert rows_of(got) == rows_of(spark.read.options(**options, multiLine="true").csv(str(folder)))


def test_only_broken_files_change_plan(spark, tmp_path, small_splits):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", [["k", "t", "t"], *([i, "p", 'an "inch"'] for i in range(50))])
    write(folder / "b 1%.csv", [["k", "t", "t"], *([i, "two\nlines", "q"] for i in range(50, 90))])
    (folder / "c.csv").write_text('k,t,t\n90,5" pipe,x\n\n91,"",y\n')
    broken = delimited.broken_files(spark, str(folder), {"escape": '"'})
    assert [b.rsplit("/", 1)[1] for b in broken] == ["b%201%25.csv"]
    df = S.load_table(spark, str(folder), "csv")
    assert df.columns == ["k", "t", "t.1"] and dict(df.dtypes)["k"] == "bigint"
    got = {r["k"]: (r["t"], r["t.1"]) for r in df.collect()}
    assert len(got) == 92 and got[50] == ("two\nlines", "q") and got[90] == ('5" pipe', "x") and got[3] == ("p", 'an "inch"') and got[91] == (None, "y")


def test_comments_and_no_header(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text('# "a comment\nx,"1\n# inside\n2"\n\n  \ny,3\n# end\n')
    df = S.load_table(spark, str(path), "csv", comment="#")
    assert [tuple(r) for r in df.collect()] == [("y", 3)] and df.columns == ["x", "1\n# inside\n2"]
    bare = S.load_table(spark, str(path), "csv", comment="#", header="false")
    assert rows_of(bare) == [("x", "1\n# inside\n2"), ("y", "3")]

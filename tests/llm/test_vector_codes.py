import duckdb
import numpy as np
import pytest

from checks.compare import differences
from colsight.llm import shared
from colsight.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error bigint, whole string, `of` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "w", 2) for r in rows], SCHEMA)


def query(spark, rows, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    frame(spark, rows).write.parquet(path)
    return vc.op13_vector_codes(spark, str(tmp_path)).toPandas()


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    if rows:
        con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    return con.execute(vc.OP13_SQL).df()


@pytest.mark.parametrize("cell", [1, 7, 32, 1000])
def test_memo_equals_plain_search(cell):
    rng = np.random.default_rng(cell)
    book = rng.integers(-300, 300, (256, 5))
    book[10] = book[200]
    memo = vc.Memo(book, cell, most=500)
    parts = np.concatenate([rng.integers(-400, 400, (3000, 5)), book, np.repeat(book[:1], 1000, axis=0)])
    for some in np.split(parts, [100, 1500, 3100]):
        entry, distance = memo.nearest(some)
        plain = ((some[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (entry == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    assert memo.evaluated < 256 * memo.asked or cell == 1000


def test_given_table(spark, sf_dir, con):
    got = vc.op13_vector_codes(spark, sf_dir).toPandas()
    assert differences(got, con.execute(vc.OP13_SQL).df()) is None


def test_equals_sql(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist(), int(rng.integers(4)) if i % 5 else None) for i in rng.permutation(700).tolist()]
    rows += [(i, [0.5, -0.25, 0.0, -0.0, 1.0, 2.0, 3.0, -4.0], 9) for i in range(800, 1200)]
    rows += [rows[0], rows[1], (None, [0.1] * 8, 1), (5000, None, 1), (5001, [float("nan")] * 8, 2), (5002, [float("inf")] + [0.0] * 7, 2)]
    rows += [(5003, [None] + [1.0] * 7, 1), (5004, [0.0] * 8, None)]
    assert differences(query(spark, rows, tmp_path), by_sql(rows)) is None


def test_few_and_none(spark, tmp_path):
    rows = [(3, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0, 3.0, 5.0], None)]
    got = query(spark, rows, tmp_path)
    assert differences(got, by_sql(rows)) is None and set(got["error"]) == {0}
    empty = vc.compress(frame(spark, [(1, None, 1)]))
    assert empty.codes.count() == 0 and all(len(b) == 0 for b in empty.books)
    assert vc.compress(frame(spark, [])).codes.count() == 0


def test_lengths_and_bounds(spark):
    out = vc.compress(frame(spark, [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [1.0], 1), (3, [], 1)]))
    assert [len(b[0]) for b in out.books] == [2] * 4 and out.codes.count() == 3
    with pytest.raises(Exception, match="too large"):
        shared.written(vc.compress(frame(spark, [(1, [1e30] * 4, 1)])).codes)

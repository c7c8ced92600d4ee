import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.operators import blocks, cleaning


def brute_bounds(pdf):
    bounds = {}
    for n in pdf.columns:
        kept = pdf[n].dropna()
        if kept.empty:
            bounds[n], pdf = None, pdf[:0]
            continue
        a, b = np.quantile(kept, [0.25, 0.75])
        bounds[n] = (a - 1.5 * (b - a), b + 1.5 * (b - a))
        pdf = pdf[pdf[n].between(*bounds[n])]
    return bounds, pdf


def same(got, want):
    assert list(got) == list(want)
    for n, b in want.items():
        assert (got[n] is None) == (b is None) and (b is None or got[n] == pytest.approx(b, rel=1e-12)), n


@pytest.fixture
def passes(monkeypatch, spark):
    """Number of actions that read the table."""
    frame, seen = type(spark.range(1)), []
    first = frame.first
    monkeypatch.setattr(frame, "first", lambda self: (seen.append(1), first(self))[1])
    return seen


def test_fifty_columns_in_at_most_ten_passes(spark, passes):
    rng = np.random.default_rng(5)
    common = rng.normal(size=4000)
    pdf = pd.DataFrame({f"c{i:02d}": common * (i % 3) + rng.normal(size=4000) * (1 + i) for i in range(50)})
    df = spark.createDataFrame(pdf).repartition(4).cache()
    want, kept = brute_bounds(pdf)
    same(cleaning.sequential_bounds(df, list(pdf.columns), shared=50), want)
    assert len(passes) <= 10
    assert 0 < len(kept) == cleaning.remove_outliers(df).count()


@pytest.mark.parametrize("cell", [100_000, 20])
@pytest.mark.parametrize("shared", [1, 3, 48])
def test_ties_gaps_and_types(spark, monkeypatch, cell, shared):
    monkeypatch.setattr(cleaning, "QUANTILE_CELL", cell)
    rng = np.random.default_rng(6)
    n = 600
    pdf = pd.DataFrame(
        {
            "failing": rng.integers(0, 5, n).astype(float), "moved": rng.lognormal(size=n), "x0": np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n) * 9),
            "count": rng.integers(-1000, 1000, n) ** 3, "gaps": np.where(rng.random(n) < 0.1, np.nan, rng.exponential(size=n)), "last": rng.lognormal(size=n),
        }
    )
    df = cleaning.nan_to_null(spark.createDataFrame(pdf).repartition(3))
    want, kept = brute_bounds(pdf)
    same(cleaning.sequential_bounds(df, list(pdf.columns), shared=shared), want)
    assert cleaning.remove_outliers(df).count() == len(kept)


def test_column_without_values_and_empty_table(spark):
    names = [f"c{i}" for i in range(6)]
    rows = [(float(i), float(i % 7), None, 1.0, float(-i), 2.0) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    bounds = cleaning.sequential_bounds(df, names)
    assert bounds["c1"] is not None and all(bounds[n] is None for n in names[2:])
    assert cleaning.remove_outliers(df).count() == 0
    assert set(cleaning.sequential_bounds(df.limit(0), names).values()) == {None}
    assert cleaning.remove_outliers(df.limit(0)).count() == 0


def test_quantiles_do_not_depend_on_width(spark):
    df = spark.range(500).select(*[((F.col("id") * (i + 3)) % 97).cast("double").alias(f"c{i}") for i in range(7)])
    wide = blocks.exact_quantiles(df, df.columns, (0.1, 0.5), cell=10, width=7)
    narrow = blocks.exact_quantiles(df, df.columns, (0.1, 0.5), width=2)
    assert all(wide[n] == pytest.approx(narrow[n]) for n in df.columns)


def test_sequential_bounds_with_drawn_sketches(spark, monkeypatch):
    """Sketches of a share of the rows give the same bounds, and a later round tries the fences of the first."""
    rng = np.random.default_rng(5)
    n = 20_000
    pdf = pd.DataFrame({f"x{i}": np.round(rng.standard_t(4, n), 4) if i % 2 else rng.integers(0, 9, n) for i in range(8)})
    pdf["gaps"] = np.where(np.arange(n) % 3 == 0, np.nan, rng.normal(size=n))
    pdf["rare"] = np.where(np.arange(n) < 3, 1.0, np.nan)
    df = cleaning.nan_to_null(spark.createDataFrame(pdf))
    names = list(pdf.columns)
    want, _ = brute_bounds(pdf)
    wide = []
    plain = blocks._Fence.sketch

    def spy(fence, *more):
        if fence.lo is None and fence.hi is None and fence.inside > 2_000:
            wide.append((fence.column, more))
        return plain(fence, *more)

    monkeypatch.setattr(blocks._Fence, "sketch", spy)
    monkeypatch.setattr(cleaning, "QUANTILE_CELL", 40)
    for module in (blocks, cleaning):
        monkeypatch.setattr(module, "SKETCH_ROWS", 2_000, raising=False)
    same(cleaning.sequential_bounds(df, names), want)
    # was: without a share, so of all rows
    assert wide and all(more and more[0] <= 0.5 for _, more in wide)

"""Row and cell cleaning by column type: duplicates, fills, outliers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.exprs import atomic_columns, c, dtype_of, free_name, is_number, nan_to_null, number, number_columns
from colsight.operators.blocks import (
    COLUMNS_PER_AGGREGATE,
    QUANTILE_CELL,
    SKETCH_ROWS,
    SUSPECT_LIMIT,
    Cuts,
    comparable,
    draw,
    exact_quantiles,
    gap_counts,
)
from colsight.operators.missing import fill_median, fill_mode
from colsight.session import materialize

# Operations of a cleaning step, in the order they run, and the default choice.
OPERATIONS = ("drop_duplicates", "fill_numeric_median", "fill_categorical_mode", "remove_outliers_iqr")
DEFAULT_OPERATIONS = OPERATIONS[:3]
# Fixed value: whisker length in interquartile ranges.
WHISKER = 1.5

# Columns whose quartiles are sought in the same passes, one after the other in meaning;
# columns up to which each has passes of its own, as that takes no more of them; passes over
# sketches before the first exact one. All are choices of plan, the bounds are the same.
SHARED_COLUMNS = 48
FEW_COLUMNS = 4
ROUGH_PASSES = 2


def drop_duplicates(df: DataFrame, suspect_limit: int = SUSPECT_LIMIT) -> DataFrame:
    """Distinct rows; NULL equals NULL.

    Row hashes that occur more than once are found first (8 bytes per row are
    shuffled). If they are few, rows with any other hash stay where they are and only
    the rest is compared in full; otherwise whole rows are shuffled.
    """
    key = free_name(df.columns, "_row_hash")
    hashed = df.withColumn(key, F.xxhash64(*[comparable(df, n) for n in df.columns]))
    counts = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    shared = counts.filter(F.col("n") > 1).select(key)
    n_shared = shared.count()
    if n_shared == 0:
        return df
    maps = [n for n in df.columns if "map<" in dtype_of(df, n).simpleString()]

    def distinct(rows: DataFrame) -> DataFrame:
        slots = [f"{free_name(rows.columns, '_key')}{i}" for i in range(len(maps))]
        keyed = rows.withColumns({s: comparable(df, n) for s, n in zip(slots, maps)})
        keys = [n for n in rows.columns if n not in maps] + slots
        return keyed.dropDuplicates(keys).select(*[c(n) for n in rows.columns])

    if n_shared > suspect_limit:
        return distinct(df)
    alone = hashed.join(F.broadcast(shared), key, "left_anti")
    suspects = distinct(hashed.join(F.broadcast(shared), key, "left_semi"))
    return alone.unionByName(suspects).select(*[c(n) for n in df.columns])


def fill_numbers(df: DataFrame) -> DataFrame:
    """Median fill of every number column; a column without values stays missing."""
    return fill_median(df, number_columns(df), undefined=None)


def fill_categories(df: DataFrame) -> DataFrame:
    """Mode fill of every other atomic column, datetimes and booleans included."""
    return fill_mode(df, [n for n in atomic_columns(df) if not is_number(dtype_of(df, n))])


Bounds = dict[str, tuple[float, float] | None]


def _whiskers(quartiles: dict[str, Sequence[float] | None], whisker: float) -> Bounds:
    return {
        n: None if q is None else (q[0] - whisker * (q[1] - q[0]), q[1] + whisker * (q[1] - q[0])) for n, q in quartiles.items()
    }


def iqr_bounds(df: DataFrame, columns: Sequence[str], whisker: float = WHISKER) -> Bounds:
    return _whiskers(exact_quantiles(df, list(columns), (0.25, 0.75)), whisker)


def sequential_bounds(df: DataFrame, columns: Sequence[str], whisker: float = WHISKER, shared: int = SHARED_COLUMNS) -> Bounds:
    """IQR bounds of every column among the rows that the columns before it kept.

    The quartiles of ``shared`` columns are sought in the same passes: bounds are guessed
    from sketches (of drawn rows, if there are many; every later step reads all rows), the quartiles of all columns are taken under the guessed bounds of those
    before, and a count tells from which column on a row is kept by one set of bounds and not
    by the other. All columns up to that one are settled, the others go through another
    round with the better guess. A round settles one column at least and as a rule nearly
    all, so passes grow with rounds and not with columns.
    """
    out: Bounds = {}
    shared = 1 if len(columns) <= FEW_COLUMNS else shared
    for start in range(0, len(columns), shared):
        found = _settle(df, list(columns[start : start + shared]), whisker)
        df = _kept(df, found)
        out |= found
    return out


def _kept(df: DataFrame, bounds: Bounds) -> DataFrame:
    for n, b in bounds.items():
        df = df.filter(F.lit(False) if b is None else within(df, n, *b))
    return df


def _failing(df: DataFrame, names: Sequence[str], bounds: Bounds) -> Column:
    """Position of the first column whose bounds a row misses; the number of columns if it misses none."""
    out = F.when(F.lit(False), F.lit(-1))
    for i, n in enumerate(names):
        if n in bounds:
            keep = F.lit(False) if bounds[n] is None else F.coalesce(within(df, n, *bounds[n]), F.lit(False))
            out = out.when(~keep, F.lit(i))
    return out.otherwise(F.lit(len(names)))


def _marked(df: DataFrame, names: Sequence[str], bounds: Bounds) -> DataFrame:
    return df.select(_failing(df, names, bounds).alias("failing"), *[number(df, n).alias(f"x{i}") for i, n in enumerate(names)])


def _rough_bounds(df: DataFrame, names: Sequence[str], guess: Bounds, whisker: float, share: float) -> Bounds:
    """Bounds from one sketch per column of a share of the rows, under the bounds guessed for the columns before."""
    kept = [F.when(F.col("failing") >= i, F.col(f"x{i}")) for i in range(len(names))]
    sketches = [F.percentile_approx(col, [0.25, 0.75]).alias(f"s{i}") for i, col in enumerate(kept)]
    found = _marked(draw(df, share)[0] if share < 1 else df, names, guess).agg(*sketches).first()
    return _whiskers({n: found[f"s{i}"] for i, n in enumerate(names)}, whisker)


def _settle(df: DataFrame, names: list[str], whisker: float) -> Bounds:
    guess: Bounds = {}
    share = SKETCH_ROWS / max(SKETCH_ROWS, df.count()) if len(names) > 1 else 1.0
    for _ in range(ROUGH_PASSES if len(names) > 1 else 0):
        guess, last = _rough_bounds(df, names, guess, whisker, share), guess
        if guess == last:
            break
    done, sizes, fences = 0, None, Cuts()
    while done < len(names):
        rows = _kept(df, {n: guess[n] for n in names[:done]})
        seek = [(names[i], F.when(F.col("failing") >= i, F.col(f"x{i}"))) for i in range(done, len(names))]
        cell = max(1, QUANTILE_CELL * COLUMNS_PER_AGGREGATE // max(len(seek), COLUMNS_PER_AGGREGATE))
        quartiles = exact_quantiles(_marked(rows, names, guess), seek, (0.25, 0.75), cell, len(seek), sizes, fences)
        better = guess | _whiskers(quartiles, whisker)
        if len(names) - done == 1:
            return better
        # the first column on which the two sets of bounds differ for some row, and the counts of the next round
        both = rows.select(
            _failing(rows, names, guess).alias("before"), _failing(rows, names, better).alias("after"),
            *[number(rows, n).alias(f"x{i}") for i, n in enumerate(names)],
        )
        before, after = F.col("before"), F.col("after")
        counts = [F.count(F.when(after >= i, F.col(f"x{i}"))).alias(names[i]) for i in range(done + 1, len(names))]
        found = both.agg(F.min(F.when(before != after, F.least(before, after))), *counts).first()
        guess, done = better, len(names) if found[0] is None else found[0] + 1
        sizes = dict(zip(names[len(names) - len(counts) :], found[1:]))
    return guess


def remove_outliers(df: DataFrame, columns: Sequence[str] | None = None, mode: str = "sequential") -> DataFrame:
    """Keep rows within the IQR whiskers of every number column; a missing value fails.

    ``sequential``: the quartiles of a column come from the rows the earlier columns
    kept. ``simultaneous``: all quartiles from the input, one pass. Bounds are literals,
    so the filters reach the scan and nothing is materialised in between.
    """
    names = list(columns or number_columns(df))
    return _kept(df, sequential_bounds(df, names) if mode == "sequential" else iqr_bounds(df, names))


def within(df: DataFrame, name: str, low: float, high: float) -> Column:
    """Range test on the bare column, in its own type where possible, so that it can be
    pushed into the scan. NaN sorts above every number and fails."""
    if isinstance(dtype_of(df, name), T.IntegralType):
        return c(name).between(max(math.ceil(low), -(2**63)), min(math.floor(high), 2**63 - 1))
    return c(name).between(low, high)


def clean(df: DataFrame, operations: Sequence[str] = DEFAULT_OPERATIONS) -> DataFrame:
    """Run the chosen operations in their fixed order."""
    return clean_counted(df, operations)[0]


def clean_counted(df: DataFrame, operations: Sequence[str] = DEFAULT_OPERATIONS) -> tuple[DataFrame, int | None]:
    """``clean``, and how many duplicates it removed (None without that operation).

    Every later operation reads the table several times, so a table that lost rows to
    the duplicate step is written once instead of being compared again each time.
    """
    df = nan_to_null(df)
    steps = dict(zip(OPERATIONS, (drop_duplicates, fill_numbers, fill_categories, remove_outliers)))
    removed = None
    for name in (n for n in OPERATIONS if n in operations):
        before, df = df, steps[name](df)
        if name == "drop_duplicates":
            removed = 0
            if df is not before:
                df = materialize(df)
                removed = before.count() - df.count()
    return df, removed


def clean_metrics(before: DataFrame, after: DataFrame, duplicates_removed: int | None = None) -> DataFrame:
    """One row: rows and missing cells before and after, duplicates removed."""

    def count(df: DataFrame, suffix: str) -> DataFrame:
        gaps = gap_counts(df, df.columns)
        return gaps.agg(F.max("n_rows").alias(f"rows_{suffix}"), F.sum("n_missing").cast("bigint").alias(f"missing_{suffix}"))

    pair = count(before, "before").withColumn("_one", F.lit(1)).join(count(after, "after").withColumn("_one", F.lit(1)), "_one")
    return pair.select(
        "rows_before",
        "missing_before",
        F.lit(duplicates_removed).cast("bigint").alias("duplicates_removed"),
        "rows_after",
        "missing_after",
    )

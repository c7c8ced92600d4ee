"""Summary, grouped aggregates, correlations, monthly trends."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.exprs import (
    atomic_columns,
    c,
    dtype_of,
    corr_sql,
    from_micros,
    is_number,
    is_number_or_bool,
    is_temporal,
    literal,
    micros_sql,
    number,
    number_columns,
    number_sql,
    value,
    value_sql,
)
from colsight.operators import profile as P
from colsight.operators.blocks import (
    COLUMNS_PER_AGGREGATE,
    ROWS_PER_BUCKET,
    exact_quantiles,
    frequency_stats,
    per_column_agg,
    range_bucket,
    running_totals,
    union_all,
)
from colsight.operators.missing import as_datetime

QUARTILES = (0.25, 0.5, 0.75)
# Fixed value: groups kept by a grouped aggregate.
TOP_GROUPS = 20
PAIRS_PER_AGGREGATE = 10


def summary(df: DataFrame) -> DataFrame:
    """Descriptive statistics, one row per column.

    Numbers: count, mean, std, min, quartiles, max. Datetimes: count, mean, min,
    quartiles, max in the ``*_time`` columns. Others: count, unique, top, freq.
    """
    names = atomic_columns(df)
    numbers = [n for n in names if is_number(dtype_of(df, n))]
    times = [n for n in names if is_temporal(dtype_of(df, n))]
    others = [n for n in names if n not in numbers and n not in times]

    def measure(n: str) -> str:
        return number_sql(df, n) if n in numbers else micros_sql(n) if n in times else "cast(NULL AS double)"

    def metrics(n: str) -> dict[str, str]:
        return {"count": f"count({value_sql(df, n)})", **P.moments_sql(measure(n))}

    quartiles = exact_quantiles(df, [(n, F.expr(measure(n))) for n in numbers + times], QUARTILES)
    stats = per_column_agg(df, names, metrics)
    freq_schema = "ordinal int, unique bigint, top string, freq bigint"
    if others:
        place = F.element_at(F.array(*[F.lit(names.index(n)) for n in others]), F.col("ordinal") + 1)
        freq = frequency_stats(df, others).select(
            place.alias("ordinal"), F.col("n_distinct").alias("unique"), F.col("top_value").alias("top"),
            F.col("top_frequency").alias("freq"),
        )
    else:
        freq = df.sparkSession.createDataFrame([], freq_schema)

    def pick(j: int) -> Column:
        lits = [F.lit(quartiles[n][j] if quartiles.get(n) else None).cast("double") for n in names]
        return F.element_at(F.array(*lits), F.col("ordinal") + 1)

    kinds = F.array(*[F.lit("number" if n in numbers else "datetime" if n in times else "other") for n in names])
    full = stats.join(freq, "ordinal", "left").withColumn("kind", F.element_at(kinds, F.col("ordinal") + 1))
    for j, q in enumerate(("p25", "p50", "p75")):
        full = full.withColumn(q, pick(j))
    figures = ("mean", "std", "min", "p25", "p50", "p75", "max")
    is_num, is_time = F.col("kind") == "number", F.col("kind") == "datetime"
    return full.select(
        "ordinal",
        "column",
        "kind",
        "count",
        "unique",
        "top",
        "freq",
        *[F.when(is_num, F.col(f)).alias(f) for f in figures],
        *[F.when(is_time, from_micros(F.floor(F.col(f)))).alias(f"{f}_time") for f in figures if f != "std"],
    )


def _need(df: DataFrame, name: str | None, message: str) -> str:
    if not name or name not in df.columns:
        raise ValueError(message)
    return name


def group_top(
    df: DataFrame,
    group_by: str,
    target_column: str,
    agg: str = "mean",
    top: int = TOP_GROUPS,
    order_column: str | None = None,
) -> DataFrame:
    """(group, value) of one aggregate per group, largest first; missing keys are left out."""
    _need(df, group_by, "Valid group_by column is required.")
    _need(df, target_column, "Valid target_column is required.")
    key = value(df, group_by).alias("group")
    grouped = group_aggregate(df.select(key, value(df, target_column).alias("target"), *_order(order_column)), agg, order_column)
    return grouped.orderBy(F.col("value").desc_nulls_last(), "group").limit(top)


def _order(order_column: str | None) -> list[Column]:
    return [c(order_column).alias("seq")] if order_column else []


def group_aggregate(pairs: DataFrame, agg: str, order_column: str | None = None) -> DataFrame:
    """One aggregate of ``target`` per ``group``. Sums and moments combine before the
    shuffle; the median goes through counted values, see ``grouped_median``."""
    pairs = pairs.filter(F.col("group").isNotNull())
    t = F.col("target")
    if agg in ("median", "quantile"):
        return grouped_median(pairs)
    if agg in ("first", "last"):
        if order_column is None:
            raise ValueError(f"'{agg}' needs order_column: rows of a DataFrame have no order of their own.")
        seq = F.when(t.isNotNull(), F.col("seq"))
        expr = F.min_by(t, seq) if agg == "first" else F.max_by(t, seq)
    elif agg in ("mean", "sum", "std", "var", "sem", "prod", "skew"):
        whole = isinstance(dtype_of(pairs, "target"), T.BooleanType)
        x = t.cast("double") if agg != "sum" else t.cast("bigint") if whole else t
        n = F.count(x)
        expr = {
            "mean": F.avg(x),
            "sum": F.coalesce(F.sum(x), F.lit(0)),
            "std": F.stddev_samp(x),
            "var": F.var_samp(x),
            "sem": F.try_divide(F.stddev_samp(x), F.sqrt(n)),
            "prod": F.coalesce(F.product(x), F.lit(1.0)),
            "skew": F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)),
        }[agg]
    elif agg in ("min", "max", "count", "size", "nunique"):
        expr = {
            "min": F.min(t),
            "max": F.max(t),
            "count": F.count(t),
            "size": F.count(F.lit(1)),
            "nunique": F.count_distinct(t),
        }[agg]
    else:
        raise ValueError(f"Unsupported aggregate: {agg}")
    return pairs.groupBy("group").agg(expr.alias("value"))


def grouped_median(pairs: DataFrame, n_rows: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact interpolated median of ``target`` per ``group``.

    Values are counted first, ordered positions come from running totals over value
    ranges, and the one or two middle values are picked by position: a huge group is
    spread over many tasks.
    """
    clean = pairs.select("group", F.col("target").cast("double").alias("target"))
    present = clean.filter(F.col("target").isNotNull())
    counted = present.groupBy("group", "target").agg(F.count(F.lit(1)).alias("n"))
    bucket = range_bucket(present, ["target"], present.count() if n_rows is None else n_rows, rows_per_bucket)
    placed = running_totals(counted, ["group"], ["target"], ["n"], bucket)
    low, high = F.floor((F.col("n_total") - 1) / 2), F.floor(F.col("n_total") / 2)
    first, end = F.col("n_before"), F.col("n_before") + F.col("n")
    groups = clean.select("group").distinct()
    middle = (
        placed.filter((first <= high) & (end > low))
        .groupBy("group")
        .agg(((F.min("target") + F.max("target")) / 2).alias("value"))
    )
    return groups.join(middle, "group", "left").select("group", "value")


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(i, j, column_a, column_b, r) for i < j, over the rows where both are present.

    All pairs share one scan. In wide tables the columns without gaps go through one
    distributed correlation matrix, which is the same there; the pairs that need their own
    complete rows are cut into aggregates of ``PAIRS_PER_AGGREGATE``.
    """
    names = list(columns or number_columns(df))
    if len(names) < 2:
        raise ValueError("At least two numeric columns are required for correlation.")
    x = [number_sql(df, n) for n in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    parts = []
    if len(pairs) > PAIRS_PER_AGGREGATE:
        full = _complete_columns(df, x)
        if len(full) > 2:
            parts.append(_matrix_pairs(df, names, x, full))
            pairs = [(i, j) for i, j in pairs if i not in full or j not in full]
    for start in range(0, len(pairs), PAIRS_PER_AGGREGATE):
        chunk = pairs[start : start + PAIRS_PER_AGGREGATE]
        row = df.agg(*[F.expr(corr_sql(x[i], x[j])).alias(f"r{i}_{j}") for i, j in chunk])
        cells = [
            f"struct({i} AS i, {j} AS j, {literal(names[i])} AS column_a, {literal(names[j])} AS column_b, r{i}_{j} AS r)"
            for i, j in chunk
        ]
        parts.append(row.selectExpr(f"inline(array({', '.join(cells)}))"))
    return union_all(parts)


def _complete_columns(df: DataFrame, x: Sequence[str]) -> set[int]:
    full = set()
    for start in range(0, len(x), COLUMNS_PER_AGGREGATE):
        part = list(enumerate(x))[start : start + COLUMNS_PER_AGGREGATE]
        gaps = df.agg(*[F.expr(f"count_if({e} IS NULL)").alias(f"g{i}") for i, e in part]).first()
        full |= {i for i, _ in part if gaps[f"g{i}"] == 0}
    return full


def _matrix_pairs(df: DataFrame, names: Sequence[str], x: Sequence[str], full: set[int]) -> DataFrame:
    """Pairs of columns without gaps from one pass; the matrix has columns x columns cells."""
    order = sorted(full)
    cols = [F.expr(x[i]).alias(f"x{i}") for i in order]
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in order], outputCol="v").transform(df.select(*cols))
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    rows = []
    for a, i in enumerate(order):
        for b in range(a + 1, len(order)):
            r = float(matrix[a, b])
            rows.append((i, order[b], names[i], names[order[b]], None if math.isnan(r) else r))
    return df.sparkSession.createDataFrame(rows, "i int, j int, column_a string, column_b string, r double")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Long Pearson matrix (column_a, column_b, r rounded to 4); constant columns give NULL.
    ``pairs`` are correlations at hand, else they are computed here."""
    names = list(columns or number_columns(df))
    upper = correlation_pairs(df, names) if pairs is None else pairs
    varied = per_column_agg(df, names, lambda n: {"spread": f"var_pop({number_sql(df, n)})"})
    diagonal = varied.select(
        F.col("ordinal").alias("i"),
        F.col("ordinal").alias("j"),
        F.col("column").alias("column_a"),
        F.col("column").alias("column_b"),
        F.when(F.col("spread") > 0, F.lit(1.0)).alias("r"),
    )
    lower = upper.select(
        F.col("j").alias("i"), F.col("i").alias("j"), F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r"
    )
    mirrored = upper.unionByName(lower)
    return mirrored.unionByName(diagonal).select("i", "j", "column_a", "column_b", F.bround("r", 4).alias("r"))


def strongest_correlation(df: DataFrame, columns: Sequence[str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Pair with the largest |r|, first in row order on ties; r keeps its sign."""
    found = (correlation_pairs(df, columns) if pairs is None else pairs).filter(F.col("r").isNotNull())
    return found.orderBy(F.abs("r").desc(), "i", "j").limit(1).select("column_a", "column_b", "r")


def trend(df: DataFrame, datetime_column: str, target_column: str | None = None) -> DataFrame:
    """Monthly mean of a numeric or boolean target, else monthly row counts (``month_end``, ``value``)."""
    _need(df, datetime_column, "Valid datetime_column is required.")
    numeric = target_column in df.columns and is_number_or_bool(dtype_of(df, target_column))
    return trend_mean(df, datetime_column, target_column) if numeric else trend_count(df, datetime_column)


def _months(df: DataFrame, datetime_column: str, *more: Column) -> DataFrame:
    when = as_datetime(df, datetime_column)
    return df.select(F.last_day(when.cast("date")).alias("month_end"), *more).filter(F.col("month_end").isNotNull())


def trend_mean(df: DataFrame, datetime_column: str, target_column: str) -> DataFrame:
    rows = _months(df, datetime_column, number(df, target_column).alias("target"))
    means = rows.groupBy("month_end").agg(F.avg("target").alias("value"))
    return means.filter(F.col("value").isNotNull()).orderBy("month_end")


def trend_count(df: DataFrame, datetime_column: str) -> DataFrame:
    """Row counts per month; months without rows inside the range appear with 0."""
    counts = _months(df, datetime_column).groupBy("month_end").agg(F.count(F.lit(1)).alias("n"))
    # One row per month is left here, so a window without partitions is small.
    after = F.lead("month_end").over(Window.orderBy("month_end"))
    gaps = F.sequence(F.last_day("month_end"), F.coalesce(F.last_day(F.add_months("next_end", -1)), F.col("month_end")), F.expr("interval 1 month"))
    spine = counts.select("month_end", "n", after.alias("next_end")).select("month_end", "n", F.explode(gaps).alias("day"))
    month = F.last_day("day")
    return spine.select(
        month.alias("month_end"), F.when(month == F.col("month_end"), F.col("n")).otherwise(0).cast("double").alias("value")
    ).orderBy("month_end")


def trend_points(df: DataFrame, datetime_column: str, target_column: str | None = None) -> DataFrame:
    """Trend with at least one parseable date, else an error."""
    points = trend(df, datetime_column, target_column)
    if points.isEmpty() and _months(df, datetime_column).isEmpty():
        raise ValueError("No parseable datetime values for trend analysis.")
    return points

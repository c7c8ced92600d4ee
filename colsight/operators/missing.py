"""Missing-value treatment: suggestions, fills, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.exprs import c, dtype_of, free_name, is_temporal, nan_to_null, quoted, value
from colsight.operators import profile as P
from colsight.operators.blocks import ROWS_PER_BUCKET, exact_quantiles, gap_counts, range_bucket, smallest_modes
from colsight.session import materialize

# Treatment ids, titles and descriptions, in the order they are offered.
SOLUTIONS = {
    "SMART_IMPUTE": (
        "Smart Imputation (Recommended)",
        "Fill numeric metrics with median, categorical/text fields with mode, "
        "and datetime columns with forward/backward fill.",
    ),
    "DROP_HIGH_MISSING_COLUMNS": (
        "Drop High-Missing Columns",
        "Drop columns where missing percentage is 40% or higher.",
    ),
    "FILL_NUMERIC_MEDIAN": (
        "Fill Numeric with Median",
        "Apply median fill for numeric metric columns only.",
    ),
    "FILL_CATEGORICAL_MODE": (
        "Fill Categorical/Text with Mode",
        "Apply mode fill for categorical and text-like columns.",
    ),
    "FILL_DATETIME_FFILL": (
        "Fill Datetime with Forward/Backward Fill",
        "Propagate nearest valid datetime values forward then backward.",
    ),
}
# Percentage from which a column counts as high-missing; text for an empty mode.
HIGH_MISSING = 40.0
NO_MODE = "UNKNOWN"

MODE_ROLES = (P.CATEGORY, P.BOOLEAN, P.TEXT)


def suggest_treatments(profile: DataFrame, high_missing: float = HIGH_MISSING) -> DataFrame:
    """Treatments that fit each profiled table, with the columns they would touch."""
    role = F.col("role")
    applies = {
        "SMART_IMPUTE": F.lit(True),
        "DROP_HIGH_MISSING_COLUMNS": F.col("missing_pct") >= high_missing,
        "FILL_NUMERIC_MEDIAN": role == P.METRIC,
        "FILL_CATEGORICAL_MODE": role.isin(*MODE_ROLES),
        "FILL_DATETIME_FFILL": role == P.DATETIME,
    }
    matches = F.array_compact(
        F.array(
            *[
                F.when(
                    applies[sid],
                    F.struct(
                        F.lit(rank).alias("rank"),
                        F.lit(sid).alias("solution_id"),
                        F.lit(title).alias("title"),
                        F.lit(description).alias("description"),
                    ),
                )
                for rank, (sid, (title, description)) in enumerate(SOLUTIONS.items(), start=1)
            ]
        )
    )
    long = profile.filter(F.col("missing_pct") > 0).select("table_name", "ordinal", "column", F.inline(matches))
    return long.groupBy("table_name", "rank", "solution_id", "title", "description").agg(
        P.names_where(F.lit(True)).alias("target_columns")
    )


def missing_total(df: DataFrame) -> DataFrame:
    """One row: missing cells in the table and whether it is free of them."""
    cells = F.sum("n_missing").cast("bigint").alias("missing_cells")
    return gap_counts(df, df.columns).agg(cells).withColumn("ready", F.col("missing_cells") == 0)


def _replace(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.select(*[(new[n] if n in new else c(n)).alias(n) for n in df.columns])


def _columns_with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    gaps = {r["column"]: r["n_missing"] for r in gap_counts(df, list(columns)).collect()}
    return [n for n in columns if gaps[n]]


def fill_median(
    df: DataFrame, columns: Sequence[str], undefined: float | None = 0.0, gaps: Sequence[str] | None = None
) -> DataFrame:
    """Fill gaps with the exact median. ``gaps`` names the columns that have some, if known. Integer and decimal columns with gaps become
    double, as the median may lie between two values. ``undefined`` replaces the median
    of a column without values (None leaves it missing)."""
    gaps = _columns_with_gaps(df, columns) if gaps is None else [n for n in columns if n in gaps]
    medians = exact_quantiles(df, gaps, [0.5])
    new = {}
    for n in gaps:
        fill = medians[n][0] if medians[n] else undefined
        if fill is not None:
            new[n] = F.coalesce(value(df, n).cast("double"), F.lit(float(fill)))
    return _replace(df, new)


def _typed_literal(v: object, dt: T.DataType) -> Column:
    return F.lit(str(v)).cast(dt) if is_temporal(dt) else F.lit(v).cast(dt)


def fill_mode(df: DataFrame, columns: Sequence[str], gaps: Sequence[str] | None = None) -> DataFrame:
    """Fill gaps with the smallest most frequent value. ``gaps`` names the columns that have
    some, if known. A text column without any value
    becomes UNKNOWN; other types without values stay missing."""
    gaps = _columns_with_gaps(df, columns) if gaps is None else [n for n in columns if n in gaps]
    modes = smallest_modes(df, gaps)
    new = {}
    for n in gaps:
        dt = dtype_of(df, n)
        if modes[n] is not None:
            new[n] = F.coalesce(value(df, n), _typed_literal(modes[n], dt))
        elif isinstance(dt, T.StringType):
            new[n] = F.coalesce(c(n), F.lit(NO_MODE))
    return _replace(df, new)


def as_datetime(df: DataFrame, name: str) -> Column:
    """A datetime column as it is; a text column parsed in its best single format."""
    if not isinstance(dtype_of(df, name), T.StringType):
        return c(name)
    fmt = P.detect_datetime_format(df, name)
    return P.parsed_datetime(name, fmt) if fmt else F.lit(None).cast("timestamp")


def fill_datetime(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    n_rows: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    gaps: Sequence[str] | None = None,
) -> DataFrame:
    """Fill gaps with the last earlier value, else the first later one, in ``order_by`` order.

    Rows that share a key are simultaneous: a gap takes the largest value at its own
    key first. Only (key, value) pairs are shuffled and scanned, cut into key ranges;
    range ends are carried over a table with one row per range. Rows without gaps are
    passed through where they are, rows with gaps look their values up by key.
    """
    gaps = _columns_with_gaps(df, columns) if gaps is None else [n for n in columns if n in gaps]
    if not gaps:
        return df
    parsed = _replace(df, {n: as_datetime(df, n) for n in gaps})
    keys = [*partition_by, *order_by]
    stem = free_name(df.columns, "_")
    at, other = f"{stem}bucket", f"{stem}b"
    slots = [f"{stem}v{i}" for i in range(len(gaps))]
    steps = parsed.groupBy(*[c(k) for k in keys]).agg(
        *[F.max(c(n)).alias(s) for n, s in zip(gaps, slots)],
        *[F.max(c(n).isNull()).alias(f"{s}_gap") for n, s in zip(gaps, slots)],
    )
    bucket = range_bucket(df, keys, n_rows if n_rows is not None else df.count(), rows_per_bucket)
    steps = steps.withColumn(at, F.lit(0) if bucket is None else bucket)

    groups = [c(k) for k in partition_by] or [F.lit(0)]
    order = [c(k) for k in order_by]
    backward = [c(k).desc_nulls_last() for k in order_by]
    up_to = Window.partitionBy(*groups, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # "First later value" as "last value" of the reversed order: a growing frame is linear.
    since = Window.partitionBy(*groups, at).orderBy(*backward).rowsBetween(Window.unboundedPreceding, 0)
    local = steps.select(
        "*",
        *[F.last(s, ignorenulls=True).over(up_to).alias(f"{s}_prev") for s in slots],
        *[F.last(s, ignorenulls=True).over(since).alias(f"{s}_next") for s in slots],
    ).filter(" or ".join(quoted(f"{s}_gap") for s in slots))

    if bucket is not None:
        when = F.struct(*order)
        ends = steps.groupBy(*[c(k) for k in partition_by], at).agg(
            *[F.max_by(s, F.when(F.col(s).isNotNull(), when)).alias(f"{s}_end") for s in slots],
            *[F.min_by(s, F.when(F.col(s).isNotNull(), when)).alias(f"{s}_start") for s in slots],
        )
        before = Window.partitionBy(*groups).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*groups).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(
            *[c(k).alias(f"{stem}p{i}") for i, k in enumerate(partition_by)],
            F.col(at).alias(other),
            *[F.last(f"{s}_end", ignorenulls=True).over(before).alias(f"{s}_carry") for s in slots],
            *[F.last(f"{s}_start", ignorenulls=True).over(after).alias(f"{s}_ahead") for s in slots],
        )
        same = F.col(at) == F.col(other)
        for i, k in enumerate(partition_by):
            same = same & c(k).eqNullSafe(F.col(f"{stem}p{i}"))
        local = local.join(carried, same)
        fills = [F.coalesce(f"{s}_prev", f"{s}_carry", f"{s}_next", f"{s}_ahead") for s in slots]
    else:
        fills = [F.coalesce(f"{s}_prev", f"{s}_next") for s in slots]

    looked_up = local.select(
        *[c(k).alias(f"{stem}k{i}") for i, k in enumerate(keys)], *[f.alias(f"{s}_fill") for f, s in zip(fills, slots)]
    )
    gap = F.lit(False)
    for n in gaps:
        gap = gap | c(n).isNull()
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & c(k).eqNullSafe(F.col(f"{stem}k{i}"))
    holes = parsed.filter(gap).join(looked_up, on, "left")
    filled = holes.select(
        *[
            (F.coalesce(c(n), F.col(f"{slots[gaps.index(n)]}_fill")) if n in gaps else c(n)).alias(n)
            for n in df.columns
        ]
    )
    return parsed.filter(~gap).unionByName(filled)


def drop_high_missing(df: DataFrame, profile: DataFrame | Sequence[Row] | None = None, high_missing: float = HIGH_MISSING) -> DataFrame:
    rows = P.collect_profile(df, profile)
    return df.drop(*[r["column"] for r in rows if r["missing_pct"] >= high_missing])


def smart_impute(df: DataFrame, order_by: Sequence[str], profile: DataFrame | Sequence[Row] | None = None, **scan) -> DataFrame:
    """Median, mode and datetime fill by role; identifiers are never imputed."""
    rows = P.collect_profile(df, profile)
    gaps = [r["column"] for r in rows if r["n_missing"]]
    scan = {"n_rows": rows[0]["n_rows"] if rows else 0, "gaps": gaps, **scan}
    out = fill_median(df, P.columns_with_role(rows, P.METRIC), gaps=gaps)
    out = fill_mode(out, P.columns_with_role(rows, *MODE_ROLES), gaps=gaps)
    return fill_datetime(out, P.columns_with_role(rows, P.DATETIME), order_by, **scan)


def apply_treatment(
    df: DataFrame,
    solution_id: str,
    order_by: Sequence[str] = (),
    profile: DataFrame | Sequence[Row] | None = None,
    **scan,
) -> DataFrame:
    """Run one treatment by its id; an unknown id raises."""
    if solution_id not in SOLUTIONS:
        raise ValueError(f"Unsupported missing-value action: {solution_id}")
    rows = P.collect_profile(df, profile)
    if solution_id == "DROP_HIGH_MISSING_COLUMNS":
        return drop_high_missing(df, rows)
    if solution_id == "FILL_NUMERIC_MEDIAN":
        return fill_median(df, P.columns_with_role(rows, P.METRIC))
    if solution_id == "FILL_CATEGORICAL_MODE":
        return fill_mode(df, P.columns_with_role(rows, *MODE_ROLES))
    datetimes = P.columns_with_role(rows, P.DATETIME)
    if datetimes and not order_by and any(r["n_missing"] for r in rows if r["column"] in datetimes):
        raise ValueError("Datetime fill needs order_by: rows of a DataFrame have no order of their own.")
    if solution_id == "SMART_IMPUTE":
        return smart_impute(df, order_by, rows, **scan)
    return fill_datetime(df, datetimes, order_by, **{"n_rows": rows[0]["n_rows"] if rows else 0, **scan})


def treatment_report(before: DataFrame, after: DataFrame, solution_id: str) -> DataFrame:
    """One row: rows and missing cells before and after, and the columns that changed."""
    title = SOLUTIONS[solution_id][0]
    old = gap_counts(before, before.columns).select("ordinal", "column", F.col("n_rows").alias("rows_b"), F.col("n_missing").alias("gaps_b"))
    new = gap_counts(after, after.columns).select("column", F.col("n_rows").alias("rows_a"), F.col("n_missing").alias("gaps_a"))
    dropped = solution_id == "DROP_HIGH_MISSING_COLUMNS"
    touched = F.col("gaps_a").isNull() if dropped else F.col("gaps_a") != F.col("gaps_b")
    totals = old.join(new, "column", "left").agg(
        F.max("rows_b").alias("rows_before"),
        F.max("rows_a").alias("rows_after"),
        F.sum("gaps_b").alias("missing_before"),
        F.coalesce(F.sum("gaps_a"), F.lit(0)).alias("missing_after"),
        P.names_where(touched).alias("affected_columns"),
    )
    # Fixed value: report sentence.
    sentence = "%s applied. Missing values reduced from %d to %d."
    return totals.select(
        F.lit(solution_id).alias("solution_id"),
        F.lit(True).alias("applied"),
        "rows_before",
        "rows_after",
        "missing_before",
        "missing_after",
        "affected_columns",
        F.format_string(sentence, F.lit(title), "missing_before", "missing_after").alias("summary"),
    )


@dataclass
class Treatment:
    table: DataFrame
    report: DataFrame
    profile: DataFrame
    solutions: DataFrame


def treat(df: DataFrame, solution_id: str, order_by: Sequence[str] = (), **scan) -> Treatment:
    """Apply one of the suggested treatments, then profile and suggest again."""
    df = nan_to_null(df)
    rows = P.collect_profile(df)
    offered = [r["solution_id"] for r in suggest_treatments(P.profile_frame(df.sparkSession, rows)).collect()]
    if solution_id not in offered:
        raise ValueError(f"Treatment '{solution_id}' is not among the suggested ones: {sorted(offered)}")
    table = apply_treatment(df, solution_id, order_by, rows, **scan)
    joins = solution_id in ("SMART_IMPUTE", "FILL_DATETIME_FFILL")
    if joins and any(r["n_missing"] for r in rows if r["role"] == P.DATETIME):
        table = materialize(table)
    new_profile = P.profile_frame(df.sparkSession, P.collect_profile(table))
    return Treatment(table, treatment_report(df, table, solution_id), new_profile, suggest_treatments(new_profile))


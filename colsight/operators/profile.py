"""Column and table profiles: types, semantic roles, missing values, keys, frequent values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.exprs import (
    atomic_columns,
    dtype_of,
    exact_round,
    is_number,
    is_temporal,
    literal,
    number_sql,
    quoted,
    value_sql,
)
from colsight.operators.blocks import duplicate_count, frequency_stats, per_column_agg, typed_counts

# Names that mark an identifier when they occur inside a column name.
IDENTIFIER_HINTS = ("id", "uuid", "key", "code")
# A text column is a datetime when this share of its values parses.
DATETIME_SHARE = 0.8
# Fewer distinct values than this make a number / a text a category.
NUMBER_LEVELS = 10
TEXT_LEVELS = 50

# Tables of a catalog that are profiled at the same time.
PARALLEL_TABLES = 4

# Parse pattern and the shape a text must have before the parser is tried.
DATETIME_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd HH:mm": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$",
    "yyyy-MM-dd HH:mm:ss.SSS": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}$",
    "yyyy-MM-dd HH:mm:ss.SSSSSS": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}$",
    "yyyy-MM-dd'T'HH:mm:ss.SSS": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}$",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}$",
    "yyyy-MM-dd HH:mm:ssXXX": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}(Z|[+-]\d{2}:\d{2})$",
    "yyyy-MM-dd'T'HH:mm:ssXXX": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yyyy HH:mm": r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}$",
    "M/d/yyyy HH:mm:ss": r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$",
}

LONGEST_DATETIME = 40

PROFILE_SCHEMA = (
    "table_name string, ordinal int, column string, dtype string, kind string, role string, n_rows bigint, "
    "n_missing bigint, missing_pct double, n_distinct bigint, mean double, std double, min double, max double, "
    "top_value string, top_frequency bigint, is_candidate_key boolean, parse_ratio double, number_std double"
)

METRIC, CATEGORY, DATETIME = "NUMERIC_METRIC", "CATEGORICAL_DIMENSION", "DATETIME"
IDENTIFIER, BOOLEAN, TEXT = "IDENTIFIER", "BOOLEAN", "TEXT"


def parsed_sql(col: str, fmt: str, formats: Mapping[str, str] = DATETIME_FORMATS) -> str:
    """SQL text: timestamp of a text in one format; NULL where shape or parse fails.
    Length and shape are tested first: the parser only sees likely texts."""
    likely = f"length(trim({col})) <= {LONGEST_DATETIME} AND trim({col}) RLIKE {literal(formats[fmt])}"
    return f"CASE WHEN {likely} THEN try_to_timestamp(trim({col}), {literal(fmt)}) END"


def parsed_datetime(name: str, fmt: str, formats: Mapping[str, str] = DATETIME_FORMATS) -> Column:
    return F.expr(parsed_sql(quoted(name), fmt, formats))


def hits_sql(fmt: str, formats: Mapping[str, str] = DATETIME_FORMATS) -> str:
    """SQL aggregate over counted values: rows whose value parses in a format."""
    return f"coalesce(sum(CASE WHEN {parsed_sql('value', fmt, formats)} IS NOT NULL THEN n END), 0)"


def parse_ratio_sql(formats: Mapping[str, str] = DATETIME_FORMATS) -> str:
    """SQL aggregate over counted values: parse rate of the best single format."""
    return f"cast(try_divide(greatest({', '.join(hits_sql(f, formats) for f in formats)}), sum(n)) AS double)"


def datetime_shares(df: DataFrame, columns: Sequence[str], formats: Mapping[str, str] = DATETIME_FORMATS) -> DataFrame:
    """(ordinal, column, format, rank, share): parse rate of every candidate format, from
    counted values, so that a repeated text is parsed once per task and shuffle."""
    counts = typed_counts(df, columns, T.StringType(), range(len(columns)))
    hits = [
        f"struct({literal(fmt)} AS format, {i} AS rank, cast(try_divide({hits_sql(fmt, formats)}, sum(n)) AS double) AS share)"
        for i, fmt in enumerate(formats)
    ]
    shares = counts.groupBy("ordinal").agg(F.expr(f"array({', '.join(hits)})").alias("hits"))
    return _named(shares, columns).selectExpr("ordinal", "column", "inline(hits)")


def detect_datetime_format(df: DataFrame, name: str) -> str | None:
    """Best single format of a text column if it reaches the datetime share."""
    best = (
        datetime_shares(df, [name])
        .filter(F.col("share") >= DATETIME_SHARE)
        .orderBy(F.desc("share"), "rank")
        .first()
    )
    return best["format"] if best else None


def datetime_detection(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, column, parse_ratio, is_datetime) for text columns."""
    names = list(columns or [n for n in df.columns if isinstance(dtype_of(df, n), T.StringType)])
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, parse_ratio double, is_datetime boolean")
    best = frequency_stats(df, names, {"parse_ratio": parse_ratio_sql()})
    is_datetime = F.coalesce(F.col("parse_ratio") >= DATETIME_SHARE, F.lit(False))
    return _named(best, names).select("ordinal", "column", "parse_ratio", is_datetime.alias("is_datetime"))


def identifier_name(name: Column, hints: Sequence[str] = IDENTIFIER_HINTS) -> Column:
    """True when a hint occurs anywhere in the lower-case name ("paid" matches "id")."""
    plain = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    hit = F.lit(False)
    for hint in hints:
        hit = hit | plain.contains(hint)
    return hit


def role_of(hints: Sequence[str] = IDENTIFIER_HINTS, identifier_kinds: Sequence[str] | None = None) -> Column:
    """Role from the columns kind, column, n_rows, n_distinct, is_datetime; first match wins."""
    unique = (F.col("n_distinct") == F.col("n_rows")) & (F.col("n_rows") > 0)
    if identifier_kinds is not None:
        unique = unique & F.col("kind").isin(list(identifier_kinds))
    return (
        F.when(unique, IDENTIFIER)
        .when(identifier_name(F.col("column"), hints), IDENTIFIER)
        .when(F.col("is_datetime"), DATETIME)
        .when(F.col("kind") == "bool", BOOLEAN)
        .when((F.col("kind") == "number") & (F.col("n_distinct") < NUMBER_LEVELS), CATEGORY)
        .when(F.col("kind") == "number", METRIC)
        .when(F.col("n_distinct") < TEXT_LEVELS, CATEGORY)
        .otherwise(TEXT)
    )


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if is_number(dt):
        return "number"
    return "datetime" if is_temporal(dt) else "text"


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns")
    )


def missing_percentages(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, column, n_missing, missing_pct), one fused scan."""
    names = list(columns or df.columns)
    per_column = per_column_agg(df, names, lambda n: {"n_rows": "count(1)", "n_present": f"count({value_sql(df, n)})"})
    missing = F.col("n_rows") - F.col("n_present")
    return per_column.select("ordinal", "column", missing.alias("n_missing"), _pct(missing, F.col("n_rows")).alias("missing_pct"))


def _pct(part: Column, whole: Column) -> Column:
    return exact_round(F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0)), 2)


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, column, mean, std, min, max) of number columns; std is the sample one."""
    names = list(columns or [n for n in df.columns if is_number(dtype_of(df, n))])
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, mean double, std double, min double, max double")
    return per_column_agg(df, names, lambda n: moments_sql(number_sql(df, n)))


def moments_sql(col: str) -> dict[str, str]:
    return {"mean": f"avg({col})", "std": f"stddev_samp({col})", "min": f"min({col})", "max": f"max({col})"}


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False, rsd: float = 0.02) -> DataFrame:
    """(ordinal, column, n_distinct). ``approx`` counts by sketches with relative error ``rsd``:
    nothing but sketches is shuffled, whatever the number of distinct values."""
    names = list(columns or atomic_columns(df))
    if approx:
        return per_column_agg(df, names, lambda n: {"n_distinct": f"approx_count_distinct({value_sql(df, n)}, {rsd})"})
    return _named(frequency_stats(df, names), names).select("ordinal", "column", "n_distinct")


def top_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, column, top_value, top_frequency): smallest most frequent value as text."""
    names = list(columns or atomic_columns(df))
    named = _named(frequency_stats(df, names), names)
    return named.select("ordinal", "column", "top_value", F.coalesce("top_frequency", F.lit(0)).cast("bigint").alias("top_frequency"))


def _named(stats: DataFrame, names: Sequence[str]) -> DataFrame:
    return stats.withColumn("column", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("ordinal") + 1))


def duplicate_rows(df: DataFrame) -> DataFrame:
    rows, copies = duplicate_count(df)
    return df.sparkSession.range(1).select(
        F.lit(rows).cast("bigint").alias("total_rows"), F.lit(copies).cast("bigint").alias("duplicate_rows")
    )


def column_profile(
    df: DataFrame,
    table_name: str = "table",
    *,
    hints: Sequence[str] = IDENTIFIER_HINTS,
    identifier_kinds: Sequence[str] | None = None,
) -> DataFrame:
    """One row per atomic column.

    One fused aggregate (counts, moments) and one frequency table per column type, which
    also gives the parse rates of texts. Both results have one row per column, so the join and the role rules
    cost nothing.
    """
    names = atomic_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    kinds = {n: kind_of(dtype_of(df, n)) for n in names}
    nothing = "max(cast(NULL AS double))"

    def metrics(n: str) -> dict[str, str]:
        counts = {"n_rows": "count(1)", "n_present": f"count({value_sql(df, n)})"}
        moments = moments_sql(number_sql(df, n)) if kinds[n] == "number" else dict.fromkeys(("mean", "std", "min", "max"), nothing)
        return {**counts, **moments}

    stats = per_column_agg(df, names, metrics)
    freq = frequency_stats(df, names, {"parse_ratio": parse_ratio_sql()})
    kind_array = F.array(*[F.lit(kinds[n]) for n in names])
    type_array = F.array(*[F.lit(dtype_of(df, n).simpleString()) for n in names])
    nth = F.col("ordinal") + 1
    joined = (
        freq.join(F.broadcast(stats), "ordinal")
        .withColumns({"kind": F.element_at(kind_array, nth), "dtype": F.element_at(type_array, nth)})
        .withColumns(
            {
                "is_datetime": (F.col("kind") == "datetime") | F.coalesce(F.col("parse_ratio") >= DATETIME_SHARE, F.lit(False)),
                "n_missing": F.col("n_rows") - F.col("n_present"),
            }
        )
        .withColumn("role", role_of(hints, identifier_kinds))
    )
    metric = F.col("role") == METRIC
    return joined.select(
        F.lit(table_name).alias("table_name"),
        "ordinal",
        "column",
        "dtype",
        "kind",
        "role",
        "n_rows",
        "n_missing",
        _pct(F.col("n_missing"), F.col("n_rows")).alias("missing_pct"),
        "n_distinct",
        *[F.when(metric, F.col(m)).alias(m) for m in ("mean", "std", "min", "max")],
        F.when(~metric, F.col("top_value")).alias("top_value"),
        F.when(~metric, F.coalesce("top_frequency", F.lit(0)).cast("bigint")).alias("top_frequency"),
        ((F.col("n_missing") == 0) & (F.col("n_distinct") == F.col("n_rows"))).alias("is_candidate_key"),
        "parse_ratio",
        F.col("std").alias("number_std"),
    )


def candidate_keys(profile: DataFrame) -> DataFrame:
    return profile.filter("is_candidate_key").select("table_name", "ordinal", "column")


def names_where(condition: Column) -> Column:
    """Aggregate: column names that meet a condition, in source order."""
    kept = F.array_sort(F.collect_list(F.when(condition, F.struct("ordinal", "column"))))
    return F.transform(kept, lambda x: x["column"])


def table_profile(profile: DataFrame, duplicates: DataFrame | None = None, skipped: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per table from the column profiles of any number of tables.

    ``duplicates`` has (table_name, duplicate_rows); ``skipped`` names the nested
    columns that were not profiled.
    """
    by_table = profile.groupBy("table_name").agg(
        F.max("n_rows").alias("total_rows"),
        F.count(F.lit(1)).alias("profiled_columns"),
        names_where(F.col("role") == METRIC).alias("numeric_columns"),
        names_where(F.col("role").isin(CATEGORY, BOOLEAN)).alias("categorical_columns"),
        names_where(F.col("role") == DATETIME).alias("datetime_columns"),
        names_where(F.col("role") == IDENTIFIER).alias("identifier_columns"),
        names_where(F.col("is_candidate_key")).alias("potential_primary_keys"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "missing_pct")))).alias("missing_percentage"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "role")))).alias("column_roles"),
    )
    gone = F.array().cast("array<string>")
    for table, names in (skipped or {}).items():
        gone = F.when(F.col("table_name") == table, F.array(*[F.lit(n) for n in names]).cast("array<string>")).otherwise(gone)
    out = by_table.withColumn("skipped_columns", gone)
    if duplicates is None:
        out = out.withColumn("duplicate_rows", F.lit(None).cast("bigint"))
    else:
        out = out.join(duplicates, "table_name", "left")
    return out.select(
        "table_name",
        "total_rows",
        (F.col("profiled_columns") + F.size("skipped_columns")).alias("total_columns"),
        "numeric_columns",
        "categorical_columns",
        "datetime_columns",
        "identifier_columns",
        "duplicate_rows",
        "potential_primary_keys",
        "missing_percentage",
        "column_roles",
        "skipped_columns",
    )


def profile_catalog(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(column profiles, table profiles) of several tables, one row per column / table.

    The profiles are computed once here; whatever is derived from them reads the few
    result rows and not the data again.
    """
    spark = next(iter(tables.values())).sparkSession

    def one(item: tuple[str, DataFrame]) -> tuple[list[Row], tuple[str, int]]:
        name, df = item
        return collect_profile(df, column_profile(df, name)), (name, duplicate_count(df)[1])

    with ThreadPoolExecutor(max_workers=PARALLEL_TABLES) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(one), tables.items()))
    columns = profile_frame(spark, [r for rows, _ in found for r in rows])
    copies = spark.createDataFrame([pair for _, pair in found], "table_name string, duplicate_rows bigint")
    skipped = {name: [n for n in df.columns if n not in set(atomic_columns(df))] for name, df in tables.items()}
    return columns, table_profile(columns, copies, {k: v for k, v in skipped.items() if v})


def collect_profile(df: DataFrame, profile: DataFrame | Sequence[Row] | None = None) -> list[Row]:
    """Profile rows on the driver: one per column."""
    if profile is None:
        profile = column_profile(df)
    rows = profile.collect() if isinstance(profile, DataFrame) else list(profile)
    return sorted(rows, key=lambda r: r["ordinal"])


def profile_frame(spark: SparkSession, rows: Sequence[Row]) -> DataFrame:
    """Collected profile rows (one per column) as a DataFrame, not computed again."""
    return spark.createDataFrame([tuple(r) for r in rows], PROFILE_SCHEMA)


def columns_with_role(profile: Sequence[Row], *roles: str) -> list[str]:
    return [r["column"] for r in profile if r["role"] in roles]

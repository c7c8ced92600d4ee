"""Column helpers shared by the operators: quoting, type tests, safe numerics, text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.NullType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def c(name: str) -> Column:
    """Reference a top-level column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(names: Iterable[str], stem: str) -> str:
    """A name that no column begins with, whatever its case: for helper columns beside a
    table's own. ``names`` are the table's columns."""
    taken = [n.lower() for n in names]
    while any(n.startswith(stem.lower()) for n in taken):
        stem += "_"
    return stem


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(dt: T.DataType) -> bool:
    """Numbers in the strict sense: booleans are not."""
    return isinstance(dt, T.NumericType)


def is_number_or_bool(dt: T.DataType) -> bool:
    """The wider test used when a feature is tested as a number."""
    return isinstance(dt, (T.NumericType, T.BooleanType))


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, TEMPORAL)


def is_atomic(dt: T.DataType) -> bool:
    return not isinstance(dt, NESTED) and not isinstance(dt, (T.DayTimeIntervalType, T.YearMonthIntervalType))


def atomic_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_atomic(f.dataType)]


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def quoted(name: str) -> str:
    """Column name as it is written in a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """Text as a SQL string literal, backslashes kept."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value_sql(df: DataFrame, name: str) -> str:
    """SQL text of the column with NaN read as missing."""
    col = quoted(name)
    if isinstance(dtype_of(df, name), (T.FloatType, T.DoubleType)):
        return f"CASE WHEN NOT isnan({col}) THEN {col} END"
    return col


def number_sql(df: DataFrame, name: str) -> str:
    """SQL text of the column as a double; text that is no number, and NaN, become NULL."""
    dt = dtype_of(df, name)
    col = quoted(name)
    if isinstance(dt, T.BooleanType):
        return f"cast(cast({col} AS int) AS double)"
    if is_number(dt):
        return f"cast({value_sql(df, name)} AS double)"
    return f"nullif(try_cast({col} AS double), double('NaN'))"


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    return F.expr(value_sql(df, name))


def number(df: DataFrame, name: str) -> Column:
    """The column as a double; text that is no number, and NaN, become NULL."""
    return F.expr(number_sql(df, name))


def text(df: DataFrame, name: str) -> Column:
    """Text form of a value; booleans print as True and False."""
    if isinstance(dtype_of(df, name), T.BooleanType):
        return F.initcap(c(name).cast("string"))
    return value(df, name).cast("string")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float column: one notion of missing."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[value(df, n).alias(n) if n in floats else c(n) for n in df.columns])


def micros_sql(name: str) -> str:
    """Microseconds since 1970 of a date or timestamp, free of the session time zone."""
    return f"cast(timestampdiff(MICROSECOND, {EPOCH_NTZ}, cast({quoted(name)} AS timestamp_ntz)) AS double)"


def from_micros(col: Column) -> Column:
    return F.timestamp_add("MICROSECOND", col.cast("bigint"), F.expr(EPOCH_NTZ))


def corr_sql(a: str, b: str) -> str:
    """Pearson r over the rows where both sides are present; NULL when a side is constant.

    ``corr`` raises under ANSI mode for a constant column, the regression sums do not.
    """
    spread = f"(sqrt(regr_sxx({a}, {b})) * sqrt(regr_syy({a}, {b})))"
    r = f"try_divide(regr_sxy({a}, {b}), {spread})"
    return f"CASE WHEN {r} > 1 THEN 1.0D WHEN {r} < -1 THEN -1.0D ELSE {r} END"


def clamp01(col: Column) -> Column:
    """Clamp to [0, 1]; NULL counts as 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(col, F.lit(0.0))))


def share(col: Column) -> Column:
    """min(1, |x|) with NULL as 0."""
    return F.least(F.lit(1.0), F.abs(F.coalesce(col, F.lit(0.0))))


def fixed_text(col: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, rounded by its exact binary value, half to even."""
    return F.replace(F.format_number(col, digits), F.lit(","), F.lit(""))


def exact_round(col: Column, digits: int) -> Column:
    """Round by exact binary value; for result rows, as it goes through text."""
    return fixed_text(col, digits).cast("double")


def decimal_text(col: Column, digits: int) -> Column:
    """Rounded number as text without padding zeros but with at least one decimal: 3.0, 12.25."""
    return F.when(col.isNotNull(), F.regexp_replace(fixed_text(col, digits), r"(\.\d+?)0+$", "$1"))

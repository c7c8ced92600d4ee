"""Reading, typing and checking tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.exprs import c, dtype_of, literal, nan_to_null, quoted
from colsight.operators.blocks import per_column_agg
from colsight.sources import delimited
from colsight.sources.html import html_tables, table_frame

# Texts that mean "missing" in a delimited file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Texts read as booleans when a column holds nothing else.
TRUE_TEXTS, FALSE_TEXTS = ("True", "TRUE", "true"), ("False", "FALSE", "false")

WHOLE_SHAPE = r"^[+-]?\d+$"
REAL_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|Infinity|infinity|Inf)$"
READERS = {"csv": "csv", "parquet": "parquet", "json": "json", "html": "html"}
MEGABYTE = 1024 * 1024


def load_table(spark: SparkSession, path: str, fmt: str | None = None, **options: str) -> DataFrame:
    """Read a table by format, given or taken from the file suffix.

    CSV is read as text, missing tokens become NULL, then columns are typed. Files are read in
    splits, those with line breaks inside quotes by ``delimited``; only with ``multiLine``, an
    encoding, or separators of several characters among the options a file is read whole. A
    repeated header name gets .1, .2, ...
    An HTML file gives its first table.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    kind = (fmt or suffix.lstrip(".")).lower()
    if kind not in READERS:
        raise ValueError(f"No reader for files of type {suffix or kind}.")
    if kind == "csv":
        return infer_types(na_to_null(_csv(spark, path, options)))
    if kind == "html":
        page = F.col("_metadata.file_path").alias("page_id")
        rows = html_tables(spark.read.option("wholetext", "true").text(path).select(page, F.col("value").alias("html")))
        found = [r["page_id"] for r in rows.select("page_id").distinct().limit(2).collect()]
        if len(found) > 1:
            raise ValueError("Several pages hold a table; html_tables reads them in long form.")
        return infer_types(na_to_null(table_frame(rows, *found)))
    if kind == "json":
        return spark.read.options(**options).json(path)
    return spark.read.options(**options).parquet(path)


def _csv(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    chosen = {"header": "true", "escape": '"', **options}
    if "multiLine" in chosen or not delimited.splittable(chosen):
        return _named(spark.read.options(**{"multiLine": "true", **chosen}).csv(path), chosen, path)
    broken = delimited.broken_files(spark, path, chosen)
    if not broken:
        return _named(spark.read.options(**chosen).csv(path), chosen, path)
    found = delimited.records(spark, [delimited.as_path(b) for b in broken], chosen)
    apart = {delimited.as_path(b) for b in broken}
    whole = sorted(f for f in map(delimited.as_path, spark.read.text(path).inputFiles()) if f not in apart)
    names = [f"_c{i}" if n is None else n for i, n in enumerate(delimited.first_fields(found, chosen))]
    if whole:
        plain = _named(spark.read.options(**chosen).csv(whole), chosen, whole)
        return plain.unionAll(delimited.read(found, chosen, plain.columns))
    headed = str(chosen["header"]).lower() == "true"
    return delimited.read(found, chosen, unique_names(names) if headed else [f"_c{i}" for i in range(len(names))])


def _named(raw: DataFrame, chosen: dict[str, str], path: str | list[str]) -> DataFrame:
    """A CSV table with the names that stand in its header; repeated ones get .1, .2, ..."""
    if str(chosen["header"]).lower() != "true":
        return raw
    first = raw.sparkSession.read.options(**{**chosen, "header": "false"}).csv(path).first()
    names = [n if v is None else v for n, v in zip(raw.columns, first or raw.columns)]
    plain = [n.strip().lower() for n in names]
    return raw if len(set(plain)) == len(plain) or len(names) != len(raw.columns) else raw.toDF(*unique_names(names))


def na_to_null(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Missing tokens in text columns and NaN in float columns become NULL."""
    out = nan_to_null(df)
    cols = []
    for n in out.columns:
        if isinstance(dtype_of(out, n), T.StringType):
            cols.append(F.when(~F.trim(c(n)).isin(list(tokens)), c(n)).alias(n))
        else:
            cols.append(c(n))
    return out.select(*cols)


def infer_types(df: DataFrame) -> DataFrame:
    """Type text columns: bigint, else double, else boolean, when every present value fits.

    One fused scan decides for all columns. A text column without values becomes double,
    the type of a column of missing numbers.
    """
    texts = [n for n in df.columns if isinstance(dtype_of(df, n), T.StringType)]
    if not texts:
        return df

    def metrics(n: str) -> dict[str, str]:
        col = f"trim({quoted(n)})"
        logical = ", ".join(literal(v) for v in TRUE_TEXTS + FALSE_TEXTS)
        return {
            "present": f"count({quoted(n)})",
            "whole": f"count(CASE WHEN {col} RLIKE {literal(WHOLE_SHAPE)} THEN try_cast({col} AS bigint) END)",
            "real": f"count(CASE WHEN {col} RLIKE {literal(REAL_SHAPE)} THEN try_cast({col} AS double) END)",
            "logical": f"count_if({col} IN ({logical}))",
        }

    found = {r["column"]: r for r in per_column_agg(df, texts, metrics).collect()}
    cols = []
    for n in df.columns:
        if n not in found:
            cols.append(c(n))
            continue
        r, s = found[n], F.trim(c(n))
        if r["present"] == 0 or r["real"] == r["present"] != r["whole"]:
            cols.append(s.try_cast("double").alias(n))
        elif r["whole"] == r["present"]:
            cols.append(s.try_cast("bigint").alias(n))
        elif r["logical"] == r["present"]:
            cols.append(s.isin(*TRUE_TEXTS).alias(n))
        else:
            cols.append(c(n))
    return df.select(*cols)


def unique_names(names: Sequence[str]) -> list[str]:
    """Names that differ when case is ignored: a repeated one gets .1, .2, ..."""
    out: list[str] = []
    taken = {n.lower() for n in names}
    seen: set[str] = set()
    for plain in names:
        name, k = plain, 0
        while name.lower() in seen or (k and name.lower() in taken):
            k += 1
            name = f"{plain}.{k}"
        seen.add(name.lower())
        out.append(name)
    return out


def normalized_names(names: Sequence[str]) -> list[str]:
    """Stripped lower-case names; a repeated name gets .1, .2, ..."""
    return unique_names([str(n).strip().lower() for n in names])


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def table_metadata(df: DataFrame) -> DataFrame:
    """One row: rows, columns, column names."""
    names = F.array(*[F.lit(n) for n in df.columns])
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"), names.alias("column_names")
    )


def validate(df: DataFrame | None, max_rows: int | None = None) -> tuple[bool, str | None]:
    """Whether a table can be analysed, and why not. There is no row limit by default."""
    if df is None:
        return False, "There is no table."
    if len(df.columns) == 0:
        return False, "The table has no columns."
    if df.isEmpty():
        return False, "The table has no rows."
    if max_rows is not None:
        rows = df.limit(max_rows + 1).count()
        if rows > max_rows:
            return False, f"The table has more rows than the limit of {max_rows}."
    return True, None


def validation_report(tables: dict[str, DataFrame], max_rows: int | None = None) -> DataFrame:
    """(table_name, is_valid, error) for several tables."""
    spark = next(df for df in tables.values() if df is not None).sparkSession
    rows = [(name, *validate(df, max_rows)) for name, df in tables.items()]
    return spark.createDataFrame(rows, "table_name string, is_valid boolean, error string")


def file_inventory(spark: SparkSession, path: str, max_mb: float | None = None) -> DataFrame:
    """(name, size_bytes, size_mb, extension, accepted) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    size = F.col("length")
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    size_mb = size / MEGABYTE
    fits = F.lit(True) if max_mb is None else size_mb <= max_mb
    return files.select(
        name.alias("name"), size.alias("size_bytes"), F.bround(size_mb, 2).alias("size_mb"), extension.alias("extension"), fits.alias("accepted")
    )


def ingest(spark: SparkSession, path: str, fmt: str | None = None, **options: str) -> DataFrame:
    """Load a table, read NaN as missing and normalise its column names."""
    return normalize_names(nan_to_null(load_table(spark, path, fmt, **options)))

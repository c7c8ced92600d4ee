"""Registered queries: one or more per operator, each over whole tables.

``QUERIES[name] = (callable, sql or None)``. Floats are rounded and arrays joined to text
on both sides, so that the results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import oracle as O
from checks import views as V
from colsight.functions.exprs import c, quoted
from colsight.operators import cleaning, drivers, forest, insights, missing, model, stats, tables, targets
from colsight.operators import profile as P
from colsight.plans import analysis
from colsight.session import materialize, work_folder
from colsight.sources import html
from colsight.sources import tables as S

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def orders_n(spark, d):
    return V.frame(spark, d, "orders", V.ORDERS_N)


def events_n(spark, d):
    return V.frame(spark, d, "events", V.EVENTS_N)


def lineitem_dup(spark, d):
    return V.frame(spark, d, "lineitem", V.LINEITEM_DUP)


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*[F.round(c(n), digits).alias(n) if n in names else c(n) for n in df.columns])


def joined(df: DataFrame, *names: str, sep: str = " | ") -> DataFrame:
    return df.select(*[F.array_join(c(n), sep).alias(n) if n in names else c(n) for n in df.columns])


def catalog(spark, d, *names):
    made = {"orders_n": orders_n, "events_n": events_n, "lineitem_dup": lineitem_dup}
    frames = {n: made[n](spark, d) if n in made else V.read(spark, d, n) for n in names}
    return P.profile_catalog(frames)


LIMITS = targets.REPORT_LIMITS
CATALOG = ("orders_n", "lineitem_dup", "events_n", "customer", "nation")
CATALOG_SQL = O.tables_cte(*CATALOG)


# --- sources ---------------------------------------------------------------------------


@query(
    "validate_tables",
    "SELECT 'region' AS table_name, (SELECT count(*) FROM region) > 0 AS is_valid UNION ALL "
    "SELECT 'orders', (SELECT count(*) FROM orders) > 0 UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem) > 0",
)
def _(spark, d):
    report = S.validation_report({n: V.read(spark, d, n) for n in ("region", "orders", "lineitem")})
    return report.select("table_name", "is_valid")


@query(
    "normalize_names",
    'SELECT r_regionkey AS "region key", r_name AS "name", r_regionkey AS "name.1" FROM region',
)
def _(spark, d):
    raw = V.read(spark, d, "region").select("r_regionkey", "r_name", F.col("r_regionkey").alias("k")).toDF(" Region KEY ", "Name", "NAME")
    return S.normalize_names(raw)


@query(
    "table_meta",
    "SELECT count(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns, "
    "'o_orderkey | o_custkey | o_orderstatus | o_totalprice | o_orderdate | o_orderpriority' AS column_names FROM orders",
)
def _(spark, d):
    return joined(S.table_metadata(V.read(spark, d, "orders")), "column_names")


EVENT_TEXTS_SQL = V.sql("events", V.EVENT_TEXTS)


@query(
    "na_tokens",
    "SELECT event_id, CASE WHEN trim(tagged) IN ('NA', 'null') THEN NULL ELSE tagged END AS tagged, "
    f"CASE WHEN day = 'n/a' THEN NULL ELSE day END AS day FROM {EVENT_TEXTS_SQL}",
)
def _(spark, d):
    return S.na_to_null(V.frame(spark, d, "events", V.EVENT_TEXTS)).select("event_id", "tagged", "day")


@query(
    "type_inference",
    "SELECT c_custkey AS key_text, round(c_acctbal, 2) AS balance_text, c_mktsegment AS segment_text, "
    "c_nationkey > 12 AS east_text FROM customer",
)
def _(spark, d):
    raw = V.read(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("key_text"),
        F.col("c_acctbal").cast("string").alias("balance_text"),
        F.col("c_mktsegment").alias("segment_text"),
        (F.col("c_nationkey") > 12).cast("string").alias("east_text"),
    )
    return rounded(S.infer_types(S.na_to_null(raw)), 2, "balance_text")


@query("html_tables_none", "SELECT page_id FROM pages WHERE NOT contains(lower(html), '<table')")
def _(spark, d):
    return html.pages_without_table(V.read(spark, d, "pages"))


@query(
    "html_tables",
    "SELECT CAST(page_id AS VARCHAR) AS page_id, 1 AS row_no, false AS is_header, url || ' | ' || CAST(length(html) AS VARCHAR) AS cells FROM pages "
    "UNION ALL SELECT CAST(page_id AS VARCHAR), 0, true, 'url | size' FROM pages",
)
def _(spark, d):
    pages = V.read(spark, d, "pages")
    cells = F.concat(
        F.lit("<table><tr><th>url</th><th>size</th></tr><tr><td>"), "url", F.lit("</td><td>"), F.length("html").cast("string"), F.lit("</td></tr></table>")
    )
    # The table stands behind the page's own markup, so the parser reads all of it.
    with_table = pages.select("page_id", F.concat("html", cells).alias("html"))
    return joined(html.html_tables(with_table), "cells")


# --- profile ---------------------------------------------------------------------------


@query("profile_shape", "SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns FROM lineitem")
def _(spark, d):
    return P.table_shape(V.read(spark, d, "lineitem"))


@query("profile_missing", O.profile("orders_n") + ' SELECT ordinal, col AS "column", n_missing, missing_pct FROM p')
def _(spark, d):
    return P.missing_percentages(orders_n(spark, d))


@query("profile_distinct", O.profile("lineitem") + ' SELECT ordinal, col AS "column", n_distinct FROM p')
def _(spark, d):
    return P.distinct_counts(V.read(spark, d, "lineitem"))


@query(
    "profile_numeric",
    O.profile("lineitem")
    + ' SELECT col AS "column", round(mean, 4) AS mean, round(std, 4) AS std, mn AS min, mx AS max FROM p WHERE kind = \'number\'',
)
def _(spark, d):
    return rounded(P.numeric_summary(V.read(spark, d, "lineitem")).drop("ordinal"), 4, "mean", "std")


@query("profile_top_values", O.profile("lineitem") + ' SELECT ordinal, col AS "column", top_value, top_frequency FROM p')
def _(spark, d):
    return P.top_values(V.read(spark, d, "lineitem"))


@query(
    "profile_long_text",
    "SELECT count(DISTINCT text) AS n_distinct, (SELECT text FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1) "
    "ORDER BY n DESC, text LIMIT 1) AS top_value, (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY text)) AS top_frequency FROM documents",
)
def _(spark, d):
    docs = V.read(spark, d, "documents").select("text")
    return P.distinct_counts(docs).join(P.top_values(docs), "ordinal").select("n_distinct", "top_value", "top_frequency")


@query(
    "profile_datetime_detect",
    "SELECT * FROM (SELECT 'event_type' AS \"column\", 0.0 AS parse_ratio, false AS is_datetime UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{n}', round(count(try_strptime({n}, '%Y-%m-%d')) / count({n}), 4), count(try_strptime({n}, '%Y-%m-%d')) / count({n}) >= 0.8 FROM {EVENT_TEXTS_SQL}"
        for n in ("day", "broken_day")
    )
    + ")",
)
def _(spark, d):
    texts = V.frame(spark, d, "events", V.EVENT_TEXTS).select("event_type", "day", "broken_day")
    return rounded(P.datetime_detection(texts).drop("ordinal"), 4, "parse_ratio")


@query("profile_id_names", O.profile("orders", "events_n", "customer") + f' SELECT table_name, col AS "column", {O.ID_TEST} AS is_id FROM p')
def _(spark, d):
    profile, _ = catalog(spark, d, "orders", "events_n", "customer")
    return profile.select("table_name", "column", P.identifier_name(F.col("column")).alias("is_id"))


@query("profile_roles", O.profile(*CATALOG, "lineitem") + ' SELECT table_name, ordinal, col AS "column", role FROM p')
def _(spark, d):
    profile, _ = catalog(spark, d, *CATALOG, "lineitem")
    return profile.select("table_name", "ordinal", "column", "role")


@query("profile_primary_keys", O.profile(*CATALOG) + ' SELECT table_name, ordinal, col AS "column" FROM p WHERE n_missing = 0 AND n_distinct = n_rows')
def _(spark, d):
    profile, _ = catalog(spark, d, *CATALOG)
    return P.candidate_keys(profile)


@query("profile_duplicates", f"SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {O.SOURCES['lineitem_dup'][0]})) AS duplicate_rows FROM lineitem")
def _(spark, d):
    return P.duplicate_rows(lineitem_dup(spark, d))


ROLE_LISTS = ("numeric_columns", "categorical_columns", "datetime_columns", "identifier_columns", "potential_primary_keys")


@query(
    "profile_tables",
    CATALOG_SQL
    + " SELECT table_name, total_rows, total_columns, dups AS duplicate_rows, array_to_string(nums, ' | ') AS numeric_columns, "
    "array_to_string(cats, ' | ') AS categorical_columns, array_to_string(dates, ' | ') AS datetime_columns, "
    "array_to_string(ids, ' | ') AS identifier_columns, array_to_string(pks, ' | ') AS potential_primary_keys FROM t",
)
def _(spark, d):
    _, tabs = catalog(spark, d, *CATALOG)
    return joined(tabs.select("table_name", "total_rows", "total_columns", "duplicate_rows", *ROLE_LISTS), *ROLE_LISTS)


FULL_PROFILE_SQL = (
    ' SELECT table_name, ordinal, col AS "column", role, n_rows, n_missing, missing_pct, n_distinct, '
    "CASE WHEN role = 'NUMERIC_METRIC' THEN round(mean, 4) END AS mean, CASE WHEN role = 'NUMERIC_METRIC' THEN round(std, 4) END AS std, "
    "CASE WHEN role = 'NUMERIC_METRIC' THEN mn END AS min, CASE WHEN role = 'NUMERIC_METRIC' THEN mx END AS max, "
    "CASE WHEN role <> 'NUMERIC_METRIC' THEN top_value END AS top_value, CASE WHEN role <> 'NUMERIC_METRIC' THEN CAST(top_frequency AS DOUBLE) END AS top_frequency, "
    "n_missing = 0 AND n_distinct = n_rows AS is_candidate_key FROM p"
)


@query("column_profile", O.profile("lineitem") + FULL_PROFILE_SQL)
def column_profile_lineitem(spark, d):
    out = P.column_profile(V.read(spark, d, "lineitem"), "lineitem").drop("dtype", "kind", "parse_ratio", "number_std")
    return rounded(out.withColumn("top_frequency", F.col("top_frequency").cast("double")), 4, "mean", "std")


# --- missing values --------------------------------------------------------------------


def _solution_sql() -> str:
    rules = {
        "SMART_IMPUTE": "true",
        "DROP_HIGH_MISSING_COLUMNS": "missing_pct >= 40",
        "FILL_NUMERIC_MEDIAN": "role = 'NUMERIC_METRIC'",
        "FILL_CATEGORICAL_MODE": "role IN ('CATEGORICAL_DIMENSION', 'BOOLEAN', 'TEXT')",
        "FILL_DATETIME_FFILL": "role = 'DATETIME'",
    }
    parts = [
        f"SELECT table_name, '{sid}' AS solution_id, string_agg(col, ' | ' ORDER BY ordinal) AS target_columns FROM p "
        f"WHERE missing_pct > 0 AND {rule} GROUP BY table_name"
        for sid, rule in rules.items()
    ]
    return O.profile("orders_n", "events_n", "customer") + " " + " UNION ALL ".join(parts)


@query("missing_suggest", _solution_sql())
def _(spark, d):
    profile, _ = catalog(spark, d, "orders_n", "events_n", "customer")
    return joined(missing.suggest_treatments(profile).select("table_name", "solution_id", "target_columns"), "target_columns")


ON = V.sql("orders", V.ORDERS_N)
EN = V.sql("events", V.EVENTS_N)


@query(
    "fill_median",
    f"SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM {ON})), 3) AS o_totalprice FROM {ON}",
)
def _(spark, d):
    out = missing.fill_median(orders_n(spark, d), ["o_totalprice"])
    return rounded(out.select("o_orderkey", "o_totalprice"), 3, "o_totalprice")


def mode_sql(src: str, col: str) -> str:
    return f"(SELECT {col} FROM (SELECT {col}, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY 1) ORDER BY n DESC, {col} LIMIT 1)"


@query(
    "fill_mode",
    f"SELECT o_orderkey, coalesce(o_orderpriority, {mode_sql(ON, 'o_orderpriority')}) AS o_orderpriority, "
    f"coalesce(o_note, {mode_sql(ON, 'o_note')}) AS o_note FROM {ON}",
)
def _(spark, d):
    return missing.fill_mode(orders_n(spark, d), ["o_orderpriority", "o_note"]).select("o_orderkey", "o_orderpriority", "o_note")


def ffill_sql(src: str, col: str, key: str) -> str:
    return (
        f"coalesce(last_value({col} IGNORE NULLS) OVER (ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({col} IGNORE NULLS) OVER (ORDER BY {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )


@query("fill_datetime", f"SELECT o_orderkey, {ffill_sql(ON, 'o_orderdate', 'o_orderkey')} AS o_orderdate FROM {ON}")
def _(spark, d):
    return missing.fill_datetime(orders_n(spark, d), ["o_orderdate"], ["o_orderkey"]).select("o_orderkey", "o_orderdate")


@query(
    "fill_datetime_ranges",
    f"SELECT event_id, {ffill_sql(EN, 'ts', 'event_id')} AS ts FROM {EN}",
)
def _(spark, d):
    return missing.fill_datetime(events_n(spark, d), ["ts"], ["event_id"], rows_per_bucket=1000).select("event_id", "ts")


@query(
    "drop_high_missing",
    f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {ON}",
)
def _(spark, d):
    return missing.drop_high_missing(orders_n(spark, d))


@query(
    "smart_impute",
    f"SELECT o_orderkey, o_custkey, o_orderstatus, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM {ON})), 3) AS o_totalprice, "
    f"{ffill_sql(ON, 'o_orderdate', 'o_orderkey')} AS o_orderdate, coalesce(o_orderpriority, {mode_sql(ON, 'o_orderpriority')}) AS o_orderpriority, "
    f"coalesce(o_note, {mode_sql(ON, 'o_note')}) AS o_note FROM {ON}",
)
def _(spark, d):
    return rounded(missing.smart_impute(orders_n(spark, d), ["o_orderkey"]), 3, "o_totalprice")


def _gap(col: str, src: str) -> str:
    return f"(SELECT count(*) - count({col}) FROM {src})"


_ALL_GAPS = " + ".join(_gap(n, ON) for n in ("o_totalprice", "o_orderdate", "o_orderpriority", "o_note"))


@query(
    "treatment_report",
    f"SELECT solution_id, true AS applied, n AS rows_before, n AS rows_after, b AS missing_before, a AS missing_after, affected AS affected_columns, "
    "title || ' applied. Missing values reduced from ' || CAST(b AS VARCHAR) || ' to ' || CAST(a AS VARCHAR) || '.' AS summary FROM ("
    f"SELECT 'FILL_NUMERIC_MEDIAN' AS solution_id, 'Fill Numeric with Median' AS title, (SELECT count(*) FROM orders) AS n, {_ALL_GAPS} AS b, "
    f"{_ALL_GAPS} - {_gap('o_totalprice', ON)} AS a, 'o_totalprice' AS affected UNION ALL "
    f"SELECT 'DROP_HIGH_MISSING_COLUMNS', 'Drop High-Missing Columns', (SELECT count(*) FROM orders), {_ALL_GAPS}, {_ALL_GAPS} - {_gap('o_note', ON)}, 'o_note')",
)
def _(spark, d):
    src = orders_n(spark, d)
    profile = P.collect_profile(src)
    parts = [
        missing.treatment_report(src, missing.apply_treatment(src, s, ["o_orderkey"], profile), s)
        for s in ("FILL_NUMERIC_MEDIAN", "DROP_HIGH_MISSING_COLUMNS")
    ]
    return joined(parts[0].unionByName(parts[1]), "affected_columns")


@query("missing_total", f"SELECT {_ALL_GAPS} AS missing_cells, {_ALL_GAPS} = 0 AS ready")
def _(spark, d):
    return missing.missing_total(orders_n(spark, d))


@query("treat_loop", O.profile("orders_n").replace("'orders_n'", "'table'") + " SELECT 'FILL_CATEGORICAL_MODE' AS solution_id, string_agg(col, ' | ' ORDER BY ordinal) AS still_missing FROM p WHERE missing_pct > 0 AND role NOT IN ('CATEGORICAL_DIMENSION', 'BOOLEAN', 'TEXT')")
def _(spark, d):
    done = missing.treat(orders_n(spark, d), "FILL_CATEGORICAL_MODE", ["o_orderkey"])
    left = done.solutions.filter("solution_id = 'SMART_IMPUTE'")
    return left.select(F.lit("FILL_CATEGORICAL_MODE").alias("solution_id"), F.array_join("target_columns", " | ").alias("still_missing"))


# --- tables ----------------------------------------------------------------------------


def _summary_sql() -> str:
    src, cols = O.SOURCES["orders_n"]
    parts = []
    for name, kind in cols:
        x = f"CAST({name} AS DOUBLE)"
        if kind == "number":
            figures = (
                f"round(avg({x}), 3) AS mean, round(stddev_samp({x}), 3) AS std, min({x}) AS min, round(quantile_cont({x}, 0.25), 3) AS p25, "
                f"round(quantile_cont({x}, 0.5), 3) AS p50, round(quantile_cont({x}, 0.75), 3) AS p75, max({x}) AS max"
            )
        else:
            figures = ", ".join(f"CAST(NULL AS DOUBLE) AS {f}" for f in ("mean", "std", "min", "p25", "p50", "p75", "max"))
        span = f"CAST(min({name}) AS VARCHAR), CAST(max({name}) AS VARCHAR)" if kind == "datetime" else "NULL, NULL"
        first, last = span.split(", ", 1)
        if kind == "text":
            other = f"CAST(count(DISTINCT {name}) AS DOUBLE) AS \"unique\", {mode_sql(src, name)} AS top, (SELECT CAST(max(n) AS DOUBLE) FROM (SELECT count({name}) AS n FROM {src} GROUP BY {name})) AS freq"
        else:
            other = 'CAST(NULL AS DOUBLE) AS "unique", NULL AS top, CAST(NULL AS DOUBLE) AS freq'
        parts.append(
            f"SELECT '{name}' AS \"column\", count({name}) AS \"count\", {other}, {figures}, {first} AS min_time, {last} AS max_time FROM {src}"
        )
    return " UNION ALL ".join(parts)


@query("summary_stats", _summary_sql())
def _(spark, d):
    out = tables.summary(orders_n(spark, d))
    out = out.withColumn("min_time", F.col("min_time").cast("string")).withColumn("max_time", F.col("max_time").cast("string"))
    out = out.select("column", "count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max", "min_time", "max_time")
    out = out.withColumn("unique", F.col("unique").cast("double")).withColumn("freq", F.col("freq").cast("double"))
    return rounded(out, 3, "mean", "std", "p25", "p50", "p75")


@query(
    "groupby_top20",
    'SELECT o_orderpriority AS "group", round(avg(o_totalprice), 4) AS value FROM ' + ON + ' WHERE o_orderpriority IS NOT NULL GROUP BY 1',
)
def groupby_priority(spark, d):
    return rounded(tables.group_top(orders_n(spark, d), "o_orderpriority", "o_totalprice"), 4, "value")


@query(
    "groupby_top20_many",
    'SELECT l_partkey AS "group", round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1 ORDER BY value DESC, 1 LIMIT 20',
)
def _(spark, d):
    return rounded(tables.group_top(V.read(spark, d, "lineitem"), "l_partkey", "l_extendedprice", "sum"), 2, "value")


_AGGS = {
    "mean": "avg(l_quantity)", "sum": "sum(l_quantity)", "min": "min(l_quantity)", "max": "max(l_quantity)", "count": "count(l_quantity)",
    "size": "count(*)", "median": "quantile_cont(l_quantity, 0.5)", "std": "stddev_samp(l_quantity)", "var": "var_samp(l_quantity)",
    "nunique": "count(DISTINCT l_quantity)", "sem": "stddev_samp(l_quantity) / sqrt(count(l_quantity))",
    "first": "arg_min(l_quantity, l_orderkey * 100000 + l_partkey)", "last": "arg_max(l_quantity, l_orderkey * 100000 + l_partkey)",
}
_AGG_SRC = "(SELECT *, l_orderkey * 100000 + l_partkey AS seq FROM lineitem)"


@query(
    "groupby_aggregates",
    " UNION ALL ".join(
        f"SELECT '{a}' AS agg, l_shipmode AS \"group\", round(CAST({e} AS DOUBLE), 4) AS value FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 2"
        for a, e in _AGGS.items() if a not in ("first", "last")
    ),
)
def _(spark, d):
    src = V.read(spark, d, "lineitem").withColumn("mode", F.concat("l_returnflag", "l_linestatus"))
    parts = []
    for agg in _AGGS:
        if agg in ("first", "last"):
            continue
        got = tables.group_top(src, "mode", "l_quantity", agg)
        parts.append(got.select(F.lit(agg).alias("agg"), "group", F.round(F.col("value").cast("double"), 4).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "groupby_first_last",
    "SELECT 'first' AS agg, event_type AS \"group\", arg_min(value, event_id) AS value FROM events GROUP BY 2 UNION ALL "
    "SELECT 'last', event_type, arg_max(value, event_id) FROM events GROUP BY 2",
)
def _(spark, d):
    src = V.read(spark, d, "events")
    first, last = (tables.group_top(src, "event_type", "value", a, order_column="event_id").withColumn("agg", F.lit(a)) for a in ("first", "last"))
    return first.unionByName(last).select("agg", "group", "value")


@query(
    "grouped_median_ranges",
    'SELECT l_returnflag AS "group", round(quantile_cont(l_extendedprice, 0.5), 4) AS value FROM lineitem GROUP BY 1',
)
def _(spark, d):
    pairs = V.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("group"), F.col("l_extendedprice").alias("target"))
    return rounded(tables.grouped_median(pairs, rows_per_bucket=5000), 4, "value")


_CORR = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 4) AS r FROM lineitem"
        for a in _CORR for b in _CORR
    ),
)
def _(spark, d):
    return tables.correlation_matrix(V.read(spark, d, "lineitem"), _CORR).select("column_a", "column_b", "r")


@query(
    "correlation_pairwise",
    f"SELECT 'o_orderkey' AS column_a, 'o_custkey' AS column_b, round(corr(o_orderkey, o_custkey), 4) AS r FROM {ON} UNION ALL "
    f"SELECT 'o_orderkey', 'o_totalprice', round(corr(o_orderkey, o_totalprice), 4) FROM {ON} UNION ALL "
    f"SELECT 'o_custkey', 'o_totalprice', round(corr(o_custkey, o_totalprice), 4) FROM {ON}",
)
def _(spark, d):
    return rounded(tables.correlation_pairs(orders_n(spark, d)).select("column_a", "column_b", "r"), 4, "r")


@query(
    "correlation_strongest",
    "SELECT column_a, column_b, round(r, 6) AS r FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, '{a}' AS column_a, '{b}' AS column_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM lineitem"
        for i, a in enumerate(_CORR) for j, b in enumerate(_CORR) if i < j
    )
    + ") ORDER BY abs(r) DESC, i, j LIMIT 1",
)
def _(spark, d):
    return rounded(tables.strongest_correlation(V.read(spark, d, "lineitem"), _CORR), 6, "r")


@query(
    "trend_mean",
    f"SELECT CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS month_end, round(avg(o_totalprice), 4) AS value FROM {ON} WHERE o_orderdate IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    out = tables.trend(orders_n(spark, d), "o_orderdate", "o_totalprice")
    return out.select(F.col("month_end").cast("string").alias("month_end"), F.round("value", 4).alias("value"))


_GAP = V.sql("orders", V.ORDERS_GAP)


@query(
    "trend_count",
    "WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM " + _GAP + " WHERE o_orderdate IS NOT NULL GROUP BY 1), "
    "s AS (SELECT unnest(generate_series((SELECT min(m) FROM m), (SELECT max(m) FROM m), INTERVAL 1 MONTH)) AS m) "
    "SELECT CAST(last_day(CAST(s.m AS DATE)) AS VARCHAR) AS month_end, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM s LEFT JOIN m ON s.m = m.m",
)
def _(spark, d):
    out = tables.trend(V.frame(spark, d, "orders", V.ORDERS_GAP), "o_orderdate")
    return out.select(F.col("month_end").cast("string").alias("month_end"), "value")


@query(
    "trend_text_dates",
    "SELECT CAST(last_day(CAST(try_strptime(day, '%Y-%m-%d') AS DATE)) AS VARCHAR) AS month_end, CAST(count(*) AS DOUBLE) AS value "
    f"FROM {EVENT_TEXTS_SQL} WHERE try_strptime(day, '%Y-%m-%d') IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    out = tables.trend(V.frame(spark, d, "events", V.EVENT_TEXTS), "day", "event_type")
    return out.select(F.col("month_end").cast("string").alias("month_end"), "value")


# --- cleaning --------------------------------------------------------------------------


@query("clean_drop_duplicates", f"SELECT DISTINCT * FROM {V.sql('lineitem', V.LINEITEM_DUP)}")
def _(spark, d):
    return cleaning.drop_duplicates(lineitem_dup(spark, d))


@query(
    "clean_fill",
    f"SELECT event_id, user_id, coalesce(ts, {mode_sql(EN, 'ts')}) AS ts, coalesce(event_type, {mode_sql(EN, 'event_type')}) AS event_type, "
    f"round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {EN})), 4) AS value FROM {EN}",
)
def _(spark, d):
    out = cleaning.clean(events_n(spark, d))
    return rounded(out.select("event_id", "user_id", "ts", "event_type", "value"), 4, "value")


def _iqr_sql(columns: list[str], src: str) -> str:
    ctes, last = [], src
    for i, col in enumerate(columns):
        x = f"CAST({col} AS DOUBLE)"
        ctes.append(f"q{i} AS (SELECT quantile_cont({x}, 0.25) AS a, quantile_cont({x}, 0.75) AS b FROM {last})")
        ctes.append(
            f"s{i} AS (SELECT * FROM {last} WHERE {x} >= (SELECT a - 1.5 * (b - a) FROM q{i}) AND {x} <= (SELECT b + 1.5 * (b - a) FROM q{i}))"
        )
        last = f"s{i}"
    return "WITH " + ", ".join(ctes) + f" SELECT event_id, value FROM {last}"


@query("clean_iqr", _iqr_sql(["event_id", "user_id", "value"], "(SELECT event_id, user_id, value FROM events)"))
def _(spark, d):
    return cleaning.remove_outliers(V.read(spark, d, "events").select("event_id", "user_id", "value")).select("event_id", "value")


_LINE_NUMBERS = {
    "qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax", "off": "l_extendedprice * l_discount",
    "due": "l_extendedprice * l_tax", "bulk": "l_extendedprice * l_quantity", "square": "l_extendedprice * l_extendedprice",
    "rest": "l_quantity * l_quantity * l_discount", "pair": "l_discount * l_tax", "unit": "l_tax * l_quantity * l_quantity * l_quantity",
}
_LINE_COLUMNS = ", ".join(f"{x} AS {n}" for n, x in _LINE_NUMBERS.items())


def _iqr_kept_sql(columns: list[str], src: str, shown: str) -> str:
    return _iqr_sql(columns, src).replace("SELECT event_id, value FROM", f"SELECT {shown} FROM")


@query(
    "clean_iqr_many",
    _iqr_kept_sql(
        list(_LINE_NUMBERS), f"(SELECT l_orderkey AS okey, l_linenumber AS line, {_LINE_COLUMNS} FROM lineitem)", "okey, line, price, unit"
    ),
)
def _(spark, d):
    cells = [F.expr(x).alias(n) for n, x in _LINE_NUMBERS.items()]
    lines = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), *cells)
    return cleaning.remove_outliers(lines, list(_LINE_NUMBERS)).select("okey", "line", "price", "unit")


@query(
    "clean_metrics",
    f"WITH s AS {EN}, g AS (SELECT count(*) * 3 - count(ts) - count(event_type) - count(value) AS m FROM s) "
    "SELECT count(*) AS rows_before, (SELECT m FROM g) AS missing_before, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s)) AS duplicates_removed, "
    "(SELECT count(*) FROM (SELECT DISTINCT * FROM s)) AS rows_after, CAST(0 AS BIGINT) AS missing_after FROM s",
)
def _(spark, d):
    src = events_n(spark, d)
    removed = src.count() - cleaning.drop_duplicates(src).count()
    return cleaning.clean_metrics(src, cleaning.clean(src), removed)


# --- models ----------------------------------------------------------------------------


def _dummies(src: str, col: str, known: list[str]) -> str:
    return ", ".join(f'coalesce(CAST({col} = \'{v}\' AS INT), 0) AS "{col}_{v}"' for v in known[1:])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "dummy_encode",
    f"SELECT o_totalprice, o_orderkey, o_custkey, {_dummies(ON, 'o_orderstatus', ['F', 'O', 'P'])}, {_dummies(ON, 'o_orderpriority', _PRIORITIES)}, "
    f"{_dummies(ON, 'o_note', ['F', 'O', 'P'])} FROM {ON} WHERE o_totalprice IS NOT NULL",
)
def _(spark, d):
    return model.dummy_encode(orders_n(spark, d), "o_totalprice")


@query(
    "dummy_encode_many",
    "SELECT 'c_name_' || c_name AS name, count(*) AS ones FROM customer WHERE c_name > (SELECT min(c_name) FROM customer) GROUP BY c_name",
)
def _(spark, d):
    wide = model.dummy_encode(V.read(spark, d, "customer").select("c_name", "c_acctbal"), "c_acctbal")
    names = [n for n in wide.columns if n != "c_acctbal"]
    # Below a higher-order function cells are read as they are: code for a column each takes longer to compile than to run.
    # The outer form keeps the optimizer from reading all cells twice, to see whether there are any.
    ones = wide.selectExpr(f"transform(array(array({', '.join(quoted(n) for n in names)})), row -> row)[0] AS ones")
    cells = ones.selectExpr("posexplode_outer(ones) AS (place, one)")
    # Written before the join: for a join, the optimizer holds all columns of the frame against each other.
    sums = materialize(cells.groupBy("place").agg(F.sum("one").alias("ones")))
    listed = spark.createDataFrame(list(enumerate(names)), "place int, name string")
    return sums.join(listed, "place").select("name", "ones")


@query(
    "dummy_long",
    "SELECT 'text' AS \"column\", md5(text) AS level, count(*) AS n FROM documents GROUP BY text UNION ALL SELECT 'source', md5(source), count(*) FROM documents GROUP BY source",
)
def _(spark, d):
    long = model.dummy_long(V.read(spark, d, "documents"), ["doc_id"], ["text", "source"])
    return long.groupBy("column", F.md5("level").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "task_type",
    O.profile("lineitem", "customer") + " SELECT table_name, col AS \"column\", CASE WHEN kind = 'number' AND n_distinct > 10 THEN 'regression' ELSE 'classification' END AS task_type FROM p",
)
def _(spark, d):
    profile, _ = catalog(spark, d, "lineitem", "customer")
    return model.task_types(profile)


@query("split_counts", "SELECT o_orderkey % 5 = 0 AS is_test, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return model.modulo_split(V.read(spark, d, "orders"), "o_orderkey").groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@query(
    "linear_fit_single",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, "
    "CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem",
)
def _(spark, d):
    return rounded(model.linear_fit_single(V.read(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 4, "slope", "intercept")


_PRED_SQL = "(SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 1 ELSE 2 END AS prediction FROM lineitem)"


@query(
    "eval_classification",
    f"WITH s AS {_PRED_SQL}, c AS (SELECT label, count(*) AS sup, sum(CAST(label = prediction AS INT)) AS tp FROM s GROUP BY label), "
    "g AS (SELECT prediction AS label, count(*) AS pr FROM s GROUP BY 1), m AS (SELECT sup, tp, tp / sup AS rec, coalesce(tp / pr, 0) AS prec FROM c LEFT JOIN g USING (label)) "
    "SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(sup * prec) / sum(sup), 6) AS precision_weighted, round(sum(sup * rec) / sum(sup), 6) AS recall_weighted, "
    "round(sum(sup * CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END) / sum(sup), 6) AS f1_weighted FROM m",
)
def _(spark, d):
    q = F.col("l_quantity")
    pred = V.read(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0).alias("label"),
        F.when(q < 10, 0.0).when(q < 30, 1.0).otherwise(2.0).alias("prediction"),
    )
    out = model.evaluate_classification(pred)
    return rounded(out, 6, *out.columns)


@query(
    "eval_regression",
    "SELECT round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(y)), 6) AS r2 FROM "
    "(SELECT l_extendedprice AS y, l_extendedprice - 2000 * l_quantity AS e FROM lineitem)",
)
def _(spark, d):
    pred = V.read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("label"), (2000 * F.col("l_quantity")).alias("prediction"))
    return rounded(rounded(model.evaluate_regression(pred), 4, "mae", "rmse"), 6, "r2")


@query(
    "logistic_fit",
    "SELECT count(*) FILTER (WHERE l_orderkey % 5 <> 0) AS train_rows, count(*) FILTER (WHERE l_orderkey % 5 = 0) AS test_rows, "
    "string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS classes, true AS at_optimum FROM lineitem",
)
def _(spark, d):
    src = model.modulo_split(V.read(spark, d, "lineitem").drop("l_shipdate"), "l_orderkey")
    trained = model.train_model(src, "l_returnflag", exclude=["l_orderkey"], split_column="is_test")
    row = (trained.train_rows, trained.test_rows, ", ".join(trained.classes), bool(model.steepest(trained) < 1e-4))
    return spark.createDataFrame([row], "train_rows bigint, test_rows bigint, classes string, at_optimum boolean")


@query("logistic_eval")
def _(spark, d):
    src = V.read(spark, d, "lineitem").drop("l_shipdate")
    return model.evaluate(model.train_model(src, "l_returnflag"))


_BANDS = ["l_orderkey", "concat('b', cast(floor(l_quantity / 7) AS int)) AS band", "CASE WHEN l_quantity < 13 THEN 'S' WHEN l_quantity < 38 THEN 'M' ELSE 'L' END AS size"]


@query(
    "logistic_eval_levels",  # one 0/1 column per band: the fit predicts the most frequent class of a band
    f"WITH b AS {V.sql('lineitem', _BANDS)}, h AS (SELECT band, size, count(*) AS n FROM b WHERE l_orderkey % 5 <> 0 GROUP BY ALL), "
    "w AS (SELECT band, arg_max(size, n) AS prediction FROM h GROUP BY band), s AS (SELECT b.size AS label, w.prediction FROM b JOIN w USING (band) WHERE l_orderkey % 5 = 0), "
    "c AS (SELECT label, count(*) AS sup, sum(CAST(label = prediction AS INT)) AS tp FROM s GROUP BY label), "
    "g AS (SELECT prediction AS label, count(*) AS pr FROM s GROUP BY 1), m AS (SELECT sup, tp, tp / sup AS rec, coalesce(tp / pr, 0) AS prec FROM c LEFT JOIN g USING (label)) "
    "SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(sup * prec) / sum(sup), 6) AS precision_weighted, round(sum(sup * rec) / sum(sup), 6) AS recall_weighted, "
    "round(sum(sup * CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END) / sum(sup), 6) AS f1_weighted FROM m",
)
def _(spark, d):
    src = model.modulo_split(V.frame(spark, d, "lineitem", _BANDS), "l_orderkey").drop("l_orderkey")
    out = model.evaluate(model.train_model(src, "size", split_column="is_test"))
    return rounded(out, 6, *out.columns)


@query(
    "linear_fit",
    "WITH s AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b, l_orderkey % 5 = 0 AS t FROM lineitem), "
    "m AS (SELECT covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM s WHERE NOT t), "
    "w AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS wb FROM m), "
    "e AS (SELECT y, y - (my + wa * (a - ma) + wb * (b - mb)) AS e FROM s, w WHERE t) "
    "SELECT round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(y)), 7) AS r2 FROM e",
)
def _(spark, d):
    src = model.modulo_split(V.read(spark, d, "lineitem"), "l_orderkey").select("l_quantity", "l_discount", "l_extendedprice", "is_test")
    out = model.evaluate(model.train_model(src, "l_extendedprice", split_column="is_test"))
    return rounded(rounded(out, 3, "mae", "rmse"), 7, "r2")


FOREST_FEATURES = ["o_custkey", "o_totalprice", "o_orderpriority"]


@query(
    "rf_importance",
    " UNION ALL ".join(f"SELECT '{n}' AS feature, true AS in_range, 1.0::DOUBLE AS total" for n in FOREST_FEATURES),
)
def _(spark, d):
    found = model.feature_importance(V.read(spark, d, "orders"), FOREST_FEATURES, "o_orderstatus", "classification")
    weight = F.col("feature_importance")
    total = F.round(F.sum(weight).over(Window.partitionBy()), 6)  # a row per feature
    return found.select("feature", weight.between(0, 1).alias("in_range"), total.alias("total"))


def _split_gains_sql() -> str:
    """Gains of all splits of lineitem at the root of a tree for l_returnflag, from full class tables."""
    base = "b AS (SELECT * FROM lineitem WHERE l_returnflag IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_linestatus IS NOT NULL)"
    nodes = "t AS (SELECT l_returnflag AS y, count(*)::DOUBLE AS n FROM b GROUP BY 1), w AS (SELECT sum(n) AS n, sum(n * n) AS q FROM t)"
    parts = []
    for name, test in (("l_quantity", "<="), ("l_discount", "<="), ("l_linestatus", "=")):
        parts.append(
            f"SELECT '{name}' AS feature, v.v::VARCHAR AS place, t.y, t.n AS tn, coalesce(sum(c.n), 0)::DOUBLE AS l FROM (SELECT DISTINCT {name} AS v FROM b) v "
            f"CROSS JOIN t LEFT JOIN (SELECT {name} AS v, l_returnflag AS y, count(*) AS n FROM b GROUP BY ALL) c ON c.v {test} v.v AND c.y = t.y GROUP BY v.v, t.y, t.n"
        )
    return (
        f"WITH {base}, {nodes}, s AS ({' UNION ALL '.join(parts)}), g AS (SELECT feature, place, sum(l) AS l, sum(l * l) AS ql, sum((tn - l) * (tn - l)) AS qr, sum(tn) AS n "
        "FROM s GROUP BY feature, place) SELECT feature, count(*) AS splits, round(max(ql / l + qr / (g.n - l) - w.q / w.n), 4) AS best_gain "
        "FROM g, w WHERE l > 0 AND l < g.n GROUP BY feature"
    )


@query("forest_split_gains", _split_gains_sql())
def _(spark, d):
    lines = V.read(spark, d, "lineitem")
    return rounded(forest.split_gains(lines, ["l_quantity", "l_discount", "l_linestatus"], "l_returnflag", True), 4, "best_gain")


@query(
    "forest_split_gains_numbers",
    "WITH b AS (SELECT o_orderpriority AS p, o_totalprice AS y FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL), "
    "t AS (SELECT count(*)::DOUBLE AS n, sum(y) AS s FROM b), l AS (SELECT p, count(*)::DOUBLE AS n, sum(y) AS s FROM b GROUP BY p) "
    "SELECT 'o_orderpriority' AS feature, count(*) AS splits, round(max(l.s * l.s / l.n + (t.s - l.s) * (t.s - l.s) / (t.n - l.n) - t.s * t.s / t.n) / max(t.s), 4) AS best_gain FROM l, t WHERE l.n < t.n",
)
def _(spark, d):
    orders = V.read(spark, d, "orders")
    total = orders.filter("o_orderpriority IS NOT NULL").agg(F.sum("o_totalprice")).first()[0]
    found = forest.split_gains(orders, ["o_orderpriority"], "o_totalprice", False)
    return rounded(found.withColumn("best_gain", F.col("best_gain") / float(total)), 4, "best_gain")


# --- targets ---------------------------------------------------------------------------


@query("target_type", O.profile("orders", "customer") + " SELECT table_name, col AS \"column\", CASE WHEN kind = 'number' AND n_distinct > 10 THEN 'regression' ELSE 'classification' END AS target_type FROM p")
def _(spark, d):
    profile, _ = catalog(spark, d, "orders", "customer")
    return targets.target_types(profile).drop("ordinal")


# Written out, so that a wrong word in the package shows.
_TARGET_WORDS = "status approved default churn label outcome revenue income score amount risk".split()
_INTENT_WORDS = {
    "PREDICTIVE": "predict forecast probability likely", "EXPLANATORY": "why reason driver cause influence",
    "DIAGNOSTIC": "compare difference segment breakdown",
}
_WORDS = " OR ".join(f"contains(lower(col), '{w}')" for w in _TARGET_WORDS)
_SUGGEST = (
    "s AS (SELECT table_name, ordinal, col, row_number() OVER (PARTITION BY table_name ORDER BY ordinal) AS rnk FROM p WHERE n_rows > n_missing AND "
    f"CASE WHEN {_WORDS} THEN true WHEN kind <> 'number' THEN n_distinct BETWEEN 2 AND 6 WHEN n_distinct <= 10 THEN true "
    "ELSE std > 0 AND n_distinct >= greatest(20, floor(0.05 * (n_rows - n_missing))) END)"
)


@query("target_candidates", O.profile("lineitem", "orders_n", "customer", "nation") + f', {_SUGGEST} SELECT table_name, col AS "column", rnk AS rank FROM s WHERE rnk <= 8')
def _(spark, d):
    profile, _ = catalog(spark, d, "lineitem", "orders_n", "customer", "nation")
    return targets.suggest_targets(profile, LIMITS.targets).drop("ordinal")


@query(
    "resolve_targets",
    O.profile("orders_n", "customer")
    + f", {_SUGGEST}, e AS (SELECT table_name, col, CASE col WHEN 'o_note' THEN 1 ELSE 2 END AS rnk FROM p WHERE col IN ('o_note', 'o_custkey')), "
    "b AS (SELECT table_name, col, rnk, 'explicit' AS source FROM e UNION ALL SELECT table_name, col, rnk, 'suggested' FROM s WHERE rnk <= 8 AND table_name NOT IN (SELECT table_name FROM e)) "
    'SELECT table_name, col AS "column", rnk AS rank, source, count(*) OVER (PARTITION BY table_name) <> 1 AS needs_choice FROM b',
)
def _(spark, d):
    profile, _ = catalog(spark, d, "orders_n", "customer")
    return targets.resolve_targets(profile, ["o_note", "o_custkey", "no_such_column"], LIMITS.targets)


_MSG = V.sql("conversations", V.MESSAGES)
_INTENT = (
    "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words.split()) + f" THEN '{intent}'" for intent, words in _INTENT_WORDS.items()
    ) + " ELSE 'DESCRIPTIVE' END"
)
_ORDER_NAMES = [n for n, _ in O.ORDERS]


@query("intent_tags", f"SELECT conv_id, turn, {_INTENT} AS intent_type FROM {_MSG}")
def _(spark, d):
    return targets.intent_tags(V.frame(spark, d, "conversations", V.MESSAGES)).select("conv_id", "turn", "intent_type")


@query(
    "column_mentions",
    " UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS \"column\" FROM {_MSG} WHERE contains(lower(text), '{n}')" for n in _ORDER_NAMES),
)
def _(spark, d):
    return targets.column_mentions(V.frame(spark, d, "conversations", V.MESSAGES), _ORDER_NAMES).select("conv_id", "turn", "column")


_NO_MENTION = " AND ".join(f"NOT contains(lower(text), '{n}')" for n in _ORDER_NAMES)


@query("hinted_columns", f"SELECT conv_id, turn, 'o_orderstatus' AS \"column\" FROM {_MSG} WHERE {_NO_MENTION}")
def _(spark, d):
    return targets.hinted_columns(V.frame(spark, d, "conversations", V.MESSAGES), _ORDER_NAMES).select("conv_id", "turn", "column")


@query(
    "parse_messages",
    f"SELECT conv_id, turn, {_INTENT} AS intent_type, CASE WHEN {_NO_MENTION} THEN 'o_orderstatus' ELSE array_to_string([x FOR x IN ["
    + ", ".join(f"CASE WHEN contains(lower(text), '{n}') THEN '{n}' END" for n in _ORDER_NAMES)
    + f"] IF x IS NOT NULL][1:5], ' | ') END AS target_candidates FROM {_MSG}",
)
def _(spark, d):
    out = targets.parse_messages(V.frame(spark, d, "conversations", V.MESSAGES), _ORDER_NAMES, limit=LIMITS.candidates)
    return joined(out.select("conv_id", "turn", "intent_type", "target_candidates"), "target_candidates")


def _hypotheses_sql(limited: bool) -> str:
    keep = (
        "CASE WHEN testable THEN (k = 1 AND nth <= CASE target_type WHEN 'classification' THEN 8 ELSE 10 END) OR (k = 2 AND nth <= 8) ELSE any_nth <= 6 END"
        if limited
        else "NOT testable OR k < 3"
    )
    return (
        O.profile("lineitem", "nation")
        + ", w AS (SELECT * FROM (VALUES ('lineitem', 'l_returnflag', 'classification'), ('lineitem', 'l_extendedprice', 'regression'), ('nation', 'n_name', 'classification')) v(table_name, target, target_type)), "
        "j AS (SELECT w.*, p.col, p.ordinal, CASE WHEN role = 'NUMERIC_METRIC' THEN 1 WHEN role IN ('CATEGORICAL_DIMENSION', 'BOOLEAN', 'TEXT') THEN 2 ELSE 3 END AS k "
        "FROM w JOIN p ON w.table_name = p.table_name WHERE p.col <> w.target), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY table_name, target, k ORDER BY ordinal) AS nth, row_number() OVER (PARTITION BY table_name, target ORDER BY ordinal) AS any_nth, "
        "min(k) OVER (PARTITION BY table_name, target) < 3 AS testable FROM j), "
        f"h AS (SELECT *, {keep} AS keep FROM n) "
        "SELECT table_name, target, col AS feature, row_number() OVER (PARTITION BY table_name, target ORDER BY CASE WHEN testable THEN k ELSE 0 END, ordinal) AS ordinal, "
        "CASE WHEN testable AND k = 2 THEN 'group_difference' WHEN target_type = 'classification' THEN 'classification_signal' ELSE 'correlation' END AS type, "
        "CASE WHEN NOT testable THEN col || ' may influence ' || target || ' and should be statistically tested.' "
        "WHEN k = 1 AND target_type = 'classification' THEN 'Variation in ' || col || ' is associated with class shifts in ' || target || '.' "
        "WHEN k = 1 THEN col || ' has measurable correlation with ' || target || '.' "
        "WHEN target_type = 'classification' THEN 'Category membership in ' || col || ' changes class distribution of ' || target || '.' "
        "ELSE 'Mean ' || target || ' differs across groups in ' || col || '.' END AS description FROM h WHERE keep"
    )


def _hypotheses(spark, d, limits):
    profile, _ = catalog(spark, d, "lineitem", "nation")
    wanted = spark.createDataFrame(
        [("lineitem", "l_returnflag", "classification"), ("lineitem", "l_extendedprice", "regression"), ("nation", "n_name", "classification")],
        "table_name string, target string, target_type string",
    )
    return targets.hypotheses(profile, wanted, limits).drop("target_type")


@query("hypotheses", _hypotheses_sql(True))
def _(spark, d):
    return _hypotheses(spark, d, LIMITS)


@query("hypotheses_all", _hypotheses_sql(False))
def _(spark, d):
    return _hypotheses(spark, d, targets.NO_LIMITS)


# --- tests -----------------------------------------------------------------------------

DL = V.DOC_LABELS_SQL


def _rank_sql(src: str, features: list[str], target: str, first: str) -> str:
    parts = []
    for x in features:
        parts.append(
            f"SELECT '{x}' AS feature, n0, n1, round(u, 1) AS u_stat, round(ties, 0) AS tie_term, "
            "round((greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5) / sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - ties / ((n0 + n1) * (n0 + n1 - 1)))), 5) AS z FROM ("
            "SELECT n0, n1, r0 - n0 * (n0 + 1) / 2 AS u, ties FROM ("
            f"SELECT CAST(sum(CAST(y = {first} AS INT)) AS DOUBLE) AS n0, CAST(sum(CAST(y <> {first} AS INT)) AS DOUBLE) AS n1, "
            f"sum(CASE WHEN y = {first} THEN rk END) AS r0, sum(t * t - 1) AS ties FROM ("
            f"SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rk, CAST(count(*) OVER (PARTITION BY x) AS DOUBLE) AS t "
            f"FROM (SELECT CAST({x} AS DOUBLE) AS x, {target} AS y FROM {src} WHERE {x} IS NOT NULL AND {target} IS NOT NULL))))"
        )
    return " UNION ALL ".join(parts)


def _ranked_out(df: DataFrame) -> DataFrame:
    return df.select(
        "feature", F.col("n0").cast("double").alias("n0"), F.col("n1").cast("double").alias("n1"),
        F.round("u_stat", 1).alias("u_stat"), F.round("tie_term", 0).alias("tie_term"), F.round("z", 5).alias("z"),
    )


@query("mann_whitney", _rank_sql(DL, ["n_chars"], "quality", "0"))
def _(spark, d):
    return _ranked_out(stats.mann_whitney(V.doc_labels(spark, d), "quality", ["n_chars"]))


@query("mann_whitney_lineitem", _rank_sql("lineitem", ["l_quantity", "l_extendedprice", "l_tax"], "l_linestatus", "'F'"))
def _(spark, d):
    return _ranked_out(stats.mann_whitney(V.read(spark, d, "lineitem"), "l_linestatus", ["l_quantity", "l_extendedprice", "l_tax"]))


@query("mann_whitney_ranges", _rank_sql("lineitem", ["l_extendedprice"], "l_linestatus", "'F'"))
def _(spark, d):
    return _ranked_out(stats.mann_whitney(V.read(spark, d, "lineitem"), "l_linestatus", ["l_extendedprice"], rows_per_bucket=5000))


def _cohen_sql(src: str, x: str, y: str, a: str, b: str) -> str:
    one = f"SELECT count(*) AS n, avg(CAST({x} AS DOUBLE)) AS m, var_samp(CAST({x} AS DOUBLE)) AS v FROM {src} WHERE {y} = "
    return (
        f"SELECT '{x}' AS feature, a.n AS n0, b.n AS n1, round(abs((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))), 6) AS cohens_d "
        f"FROM ({one}{a}) a, ({one}{b}) b"
    )


@query("cohens_d", _cohen_sql(DL, "n_chars", "quality", "0", "1"))
def _(spark, d):
    moments = stats.class_moments(V.doc_labels(spark, d), "quality", ["n_chars"])
    return rounded(stats.cohens_d(moments).drop("ordinal"), 6, "cohens_d")


_ANOVA_OUT = "SELECT feature, n, df1, df2, round(f_stat, 5) AS f_stat, round(eta, 8) AS eta_squared FROM f"


def _anova_out(df: DataFrame) -> DataFrame:
    return df.select("feature", "n", "df1", "df2", F.round("f_stat", 5).alias("f_stat"), F.round("eta_squared", 8).alias("eta_squared"))


@query("anova_by_class", "WITH " + O.anova(O.class_groups("lineitem", "l_returnflag", O.FLAG_NUMBERS)) + " " + _ANOVA_OUT)
def _(spark, d):
    return _anova_out(stats.anova_by_class(V.read(spark, d, "lineitem"), "l_returnflag", O.FLAG_NUMBERS))


def _category_groups(src: str, features: list[str], target: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS feature, CAST({x} AS VARCHAR) AS cls, count({target}) AS n, avg({target}) AS m, var_samp({target}) AS v FROM {src} "
        f"WHERE {x} IS NOT NULL AND {target} IS NOT NULL GROUP BY 2"
        for x in features
    )


_CATS = ["o_orderstatus", "o_orderpriority", "o_note"]


@query("anova_by_category", "WITH " + O.anova(_category_groups(ON, _CATS, "o_totalprice")) + " " + _ANOVA_OUT)
def _(spark, d):
    return _anova_out(stats.anova_by_category(orders_n(spark, d), "o_totalprice", _CATS))


@query("anova_many_levels", "WITH " + O.anova(_category_groups("documents", ["text", "source", "lang"], "n_chars")) + " " + _ANOVA_OUT)
def _(spark, d):
    return _anova_out(stats.anova_by_category(V.read(spark, d, "documents"), "n_chars", ["text", "source", "lang"]))


@query("eta_squared", "WITH " + O.anova(_category_groups("lineitem", ["l_returnflag", "l_linestatus"], "l_quantity")) + " SELECT feature, round(eta, 8) AS eta_squared FROM f")
def _(spark, d):
    out = stats.anova_by_category(V.read(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"])
    return rounded(out.select("feature", "eta_squared"), 8, "eta_squared")


@query(
    "contingency",
    "SELECT 'l_returnflag' AS feature, l_returnflag AS level, l_linestatus AS class, count(*) AS n FROM lineitem GROUP BY 2, 3 UNION ALL "
    "SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), l_linestatus, count(*) FROM lineitem GROUP BY 2, 3",
)
def _(spark, d):
    return stats.contingency(V.read(spark, d, "lineitem"), "l_linestatus", ["l_returnflag", "l_linenumber"]).drop("ordinal")


def _chi_out(df: DataFrame) -> DataFrame:
    return df.select("feature", "n", "dof", F.round("chi2", 5).alias("chi2"), F.round("cramers_v", 6).alias("cramers_v"))


def _chi_sql(parts: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT feature, n, CAST(dof AS DOUBLE) AS dof, round(chi2, 5) AS chi2, round(sqrt(chi2 / n / {k}), 6) AS cramers_v FROM ({O.chi_square(src, x, y)})"
        for src, x, y, k in parts
    )


@query("chi_square", _chi_sql([("orders", "o_orderpriority", "o_orderstatus", 2)]))
def _(spark, d):
    src = V.read(spark, d, "orders")
    return _chi_out(stats.chi_square(stats.contingency(src, "o_orderstatus", ["o_orderpriority"])))


@query("chi_square_sparse", _chi_sql([("documents", "text", "lang", 3)]))
def _(spark, d):
    return _chi_out(stats.chi_square(stats.contingency(V.read(spark, d, "documents"), "lang", ["text"])))


@query("chi_square_yates", _chi_sql([(DL, "toxic", "quality", 1)]))
def _(spark, d):
    return _chi_out(stats.chi_square(stats.contingency(V.doc_labels(spark, d), "quality", ["toxic"])))


@query(
    "pearson",
    " UNION ALL ".join(
        f"SELECT '{x}' AS feature, n, round(r, 8) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t_stat FROM "
        f"(SELECT corr({x}, o_totalprice) AS r, CAST(regr_count({x}, o_totalprice) AS BIGINT) AS n FROM {ON})"
        for x in ("o_orderkey", "o_custkey")
    ),
)
def _(spark, d):
    out = stats.pearson(orders_n(spark, d), "o_totalprice", ["o_orderkey", "o_custkey"])
    return rounded(rounded(out.drop("ordinal"), 8, "r"), 5, "t_stat")


def _spearman_sql(src: str, features: list[str], y: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS feature, count(*) AS n, round(corr(rx, ry), 7) AS rho FROM (SELECT "
        "rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry "
        f"FROM (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"
        for x in features
    )


@query("spearman", _spearman_sql("lineitem", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))
def _(spark, d):
    out = stats.spearman(V.read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return rounded(out.drop("ordinal"), 7, "rho")


@query("spearman_ranges", _spearman_sql(ON, ["o_custkey"], "o_totalprice"))
def _(spark, d):
    out = stats.spearman(orders_n(spark, d), "o_totalprice", ["o_custkey"], rows_per_bucket=2000)
    return rounded(out.drop("ordinal"), 7, "rho")


@query("target_flag", f"SELECT count(*) - count(o_totalprice) AS target_missing, CASE WHEN count(*) > count(o_totalprice) THEN 'Target column contains missing values; pairwise rows were dropped per test.' ELSE '' END AS flags FROM {ON}")
def _(spark, d):
    return joined(stats.target_flags(orders_n(spark, d), "o_totalprice"), "flags")


FLAG_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_tax", "l_linestatus"]


def flag_results(spark, d):
    return stats.result_bundle(V.read(spark, d, "lineitem"), "l_returnflag", FLAG_FEATURES, "classification")


@query(
    "test_results",
    O.flag_tests()
    + " SELECT feature, ordinal, test_type, n, round(statistic, 5) AS statistic, round(p, 6) AS p_value, round(effect, 6) AS effect_size FROM r",
)
def _(spark, d):
    out = flag_results(spark, d).select("feature", "ordinal", "test_type", "n", "statistic", "p_value", "effect_size")
    return rounded(rounded(out, 5, "statistic"), 6, "p_value", "effect_size")


def _test_rows(df: DataFrame, p_of: tuple[str, ...] = ()) -> DataFrame:
    """Test rows rounded; p only where SQL has a closed form for it."""
    p = F.when(F.col("feature").isin(*p_of), F.round("p_value", 6)) if p_of else F.lit(None).cast("double")
    return df.select(
        "feature", "test_type", "n", F.round("statistic", 4).alias("statistic"), p.alias("p_value"),
        F.round("effect_size", 6).alias("effect_size"), F.round("correlation", 6).alias("correlation"),
    )


def _linear_tests(src: str, features: list[str], y: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS feature, 'pearson_spearman' AS test_type, a.n, round(r * sqrt((a.n - 2) / (1 - r * r)), 4) AS statistic, "
        "CAST(NULL AS DOUBLE) AS p_value, round(abs(r), 6) AS effect_size, round(rho, 6) AS correlation FROM "
        f"(SELECT corr({x}, {y}) AS r, CAST(regr_count({x}, {y}) AS BIGINT) AS n FROM {src}) a, ({_spearman_sql(src, [x], y)}) b"
        for x in features
    )


@query(
    "test_results_regression",
    "WITH " + O.anova(_category_groups("lineitem", ["l_returnflag", "l_linestatus"], "l_extendedprice"))
    + " SELECT feature, 'anova' AS test_type, n, round(f_stat, 4) AS statistic, CASE WHEN df1 = 2 THEN round(pow(1 + 2 * f_stat / df2, -df2 / 2), 6) END AS p_value, "
    "round(eta, 6) AS effect_size, CAST(NULL AS DOUBLE) AS correlation FROM f UNION ALL "
    + _linear_tests("lineitem", ["l_quantity", "l_discount"], "l_extendedprice"),
)
def _(spark, d):
    src = V.read(spark, d, "lineitem")
    out = stats.result_bundle(src, "l_extendedprice", ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"], "regression")
    return _test_rows(out, ("l_returnflag",))


def _binary_sql() -> str:
    cohen = " UNION ALL ".join(_cohen_sql(DL, x, "quality", "0", "1") for x in ("n_chars", "toxic"))
    ranks = f"SELECT r.feature, 'mann_whitney_u' AS test_type, CAST(r.n0 + r.n1 AS BIGINT) AS n, u_stat AS statistic, cohens_d AS effect_size FROM ({_rank_sql(DL, ['n_chars', 'toxic'], 'quality', '0')}) r JOIN ({cohen}) c USING (feature)"
    chi = " UNION ALL ".join(f"SELECT feature, 'chi_square', n, round(chi2, 4), round(sqrt(chi2 / n), 6) FROM ({O.chi_square(DL, x, 'quality')})" for x in ("lang", "source"))
    return f"SELECT *, CAST(NULL AS DOUBLE) AS p_value, CAST(NULL AS DOUBLE) AS correlation FROM ({ranks} UNION ALL {chi})"


@query("test_results_binary", _binary_sql())
def _(spark, d):
    return _test_rows(stats.result_bundle(V.doc_labels(spark, d), "quality", ["n_chars", "lang", "source", "toxic"], "classification"))


@query("confidence", O.flag_tests() + " SELECT feature, round(CAST(0.35 AS DOUBLE) * greatest(0, least(1, 1 - p)) + CAST(0.25 AS DOUBLE) * least(1, abs(effect)), 4) AS confidence_score FROM r")
def _(spark, d):
    return flag_results(spark, d).select("feature", "confidence_score")


# --- drivers ---------------------------------------------------------------------------


@query("driver_rank", O.ranked() + " SELECT feature, strength AS strength_score, rnk AS importance_rank, label AS statistical_significance, hint AS explanation_hint FROM d")
def _(spark, d):
    out = drivers.rank_drivers(flag_results(spark, d))
    return out.select("feature", "strength_score", "importance_rank", "statistical_significance", "explanation_hint")


_EVIDENCE = "printf('%s (strength %.2f), p=%.4f, effect=%.3f', feature, strength, p, effect)"


@query("driver_evidence", O.ranked() + f" SELECT rnk AS importance_rank, feature, {_EVIDENCE} AS evidence FROM d WHERE rnk <= 3")
def _(spark, d):
    return drivers.evidence_points(drivers.rank_drivers(flag_results(spark, d))).select("importance_rank", "feature", "evidence")


@query(
    "driver_answer",
    O.ranked()
    + ", top AS (SELECT arg_min(feature, rnk) AS f1, arg_min(strength, rnk) AS s1, string_agg(feature, ', ' ORDER BY rnk) AS fs, "
    f"string_agg({_EVIDENCE}, ' | ' ORDER BY rnk) AS ev FROM d WHERE rnk <= 3) "
    "SELECT printf('The strongest driver for l_returnflag is %s, supported by the highest combined statistical and model-based score (%.2f).', f1, s1) AS direct_answer, "
    "printf('Top drivers are %s. These variables consistently rank high across significance and predictive contribution.', fs) AS key_drivers_summary, ev AS evidence_points, "
    "greatest(0.45, least(0.95, s1)) AS confidence_score, printf('Validate the effect of %s on l_returnflag across key segments before operational rollout.', f1) AS recommended_next_step FROM top",
)
def _(spark, d):
    ranking = drivers.rank_drivers(flag_results(spark, d))
    out = drivers.answers(ranking, ranking.select("target", "target_type").distinct())
    return joined(out.select("direct_answer", "key_drivers_summary", "evidence_points", "confidence_score", "recommended_next_step"), "evidence_points")


@query(
    "impact",
    O.flag_tests()
    + ", i AS (SELECT feature, ordinal, round(CAST(0.4 AS DOUBLE) * greatest(0, 1 - least(p, 1)) + CAST(0.35 AS DOUBLE) * abs(effect), 4) AS impact FROM r) "
    "SELECT feature, impact, round(impact / greatest(max(impact) OVER (), 0.0001), 4) AS share_of_top, row_number() OVER (ORDER BY ordinal) AS position FROM i",
)
def _(spark, d):
    return rounded(drivers.impact(flag_results(spark, d)).drop("target"), 4, "share_of_top")


# --- insights --------------------------------------------------------------------------

HEAVY = "len(ids) > 0 AND len(ids) >= greatest(1, total_columns // 2)"


def head(col: str, n: int) -> str:
    return f"array_to_string({col}[1:{n}], ', ')"


_DOMAIN = f"CASE WHEN len(dates) > 0 AND len(nums) > 0 THEN 'series' WHEN len(nums) > 0 THEN 'metrics' WHEN {HEAVY} THEN 'lookup' ELSE 'limited' END"


def _domain_pick(i: int) -> str:
    def lit(v):
        return str(v) if isinstance(v, float) else "'" + (" | ".join(v) if isinstance(v, tuple) else v) + "'"

    return f"CASE {_DOMAIN} " + " ".join(f"WHEN '{k}' THEN {lit(spec[i])}" for k, spec in insights.DOMAINS.items()) + " END"


@query(
    "domain_label",
    CATALOG_SQL + f" SELECT table_name, {_domain_pick(0)} AS domain_label, CAST({_domain_pick(1)} AS DOUBLE) AS confidence, {_domain_pick(3)} AS suggested_kpis, "
    f"CASE {_DOMAIN} WHEN 'series' THEN printf('{insights.DOMAINS['series'][2]}', {head('dates', 2)}, {head('nums', 2)}) "
    f"WHEN 'metrics' THEN printf('{insights.DOMAINS['metrics'][2]}', {head('nums', 3)}) WHEN 'lookup' THEN '{insights.DOMAINS['lookup'][2]}' ELSE '{insights.DOMAINS['limited'][2]}' END AS reasoning FROM t",
)
def _(spark, d):
    _, tabs = catalog(spark, d, *CATALOG)
    return joined(insights.domain_labels(tabs), "suggested_kpis")


@query("high_missing", O.profile("orders_n", "events_n") + ' SELECT table_name, col AS "column", missing_pct FROM p WHERE missing_pct > 10')
def _(spark, d):
    profile, _ = catalog(spark, d, "orders_n", "events_n")
    return insights.high_missing_columns(profile).drop("ordinal")


@query("metric_ranges", O.profile(*CATALOG, "lineitem") + " SELECT table_name, col AS \"column\", mn AS min, mx AS max, round(mean, 4) AS mean, round(std, 4) AS std FROM p WHERE role = 'NUMERIC_METRIC'")
def _(spark, d):
    profile, _ = catalog(spark, d, *CATALOG, "lineitem")
    return rounded(insights.metric_ranges(profile).drop("ordinal"), 4, "mean", "std")


@query("top_categories", O.profile(*CATALOG) + " SELECT table_name, col AS \"column\", top_value, top_frequency, n_distinct FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY ordinal) AS k FROM p WHERE role = 'CATEGORICAL_DIMENSION') WHERE k <= 15")
def _(spark, d):
    profile, _ = catalog(spark, d, *CATALOG)
    return insights.top_categories(profile).drop("ordinal")


_FLAGS = (
    "array_to_string([x FOR x IN [CASE WHEN dups > 0 THEN printf('%d duplicate rows detected, indicating integrity risk.', dups) END, "
    f"CASE WHEN len(gappy) > 0 THEN 'Missingness above 10% in ' || CAST(len(gappy) AS VARCHAR) || ' columns: ' || {head('gappy', 5)} || '.' END, "
    f"CASE WHEN worst_pct > 0 THEN 'Highest missingness is ' || {O.dec('worst_pct', 2)} || '% in column ''' || worst || '''.' END] IF x IS NOT NULL], ' | ')"
)
_FLAGS = f"CASE WHEN {_FLAGS} = '' THEN '{insights.NO_FLAG}' ELSE {_FLAGS} END"


@query("anomaly_flags", CATALOG_SQL + f" SELECT table_name, {_FLAGS} AS anomaly_indicators FROM t")
def _(spark, d):
    return joined(insights.anomaly_flags(*catalog(spark, d, *CATALOG)), "anomaly_indicators")


_HEALTH = (
    f"concat_ws(' ', CASE WHEN dups > 0 THEN '{insights.HEALTH_DUPLICATES}' END, CASE WHEN len(gappy) > 0 THEN '{insights.HEALTH_MISSING}' END, "
    f"CASE WHEN {HEAVY} THEN '{insights.HEALTH_IDENTIFIERS}' END)"
)
_HEALTH = f"CASE WHEN {_HEALTH} = '' THEN '{insights.HEALTH_STABLE}' ELSE {_HEALTH} END"


@query("health", CATALOG_SQL + f" SELECT table_name, {_HEALTH} AS data_health_assessment FROM t")
def _(spark, d):
    return insights.health(*catalog(spark, d, *CATALOG))


_SPREAD_CTE = (
    ", sg AS (SELECT table_name, ordinal * 2 AS o, col || ' spans from ' || " + O.dec("mn", 3) + " || ' to ' || " + O.dec("mx", 3) + " || '.' AS s FROM p WHERE role = 'NUMERIC_METRIC' AND mn IS NOT NULL "
    "UNION ALL SELECT table_name, ordinal * 2 + 1, col || ' has standard deviation ' || " + O.dec("std", 3) + " || '.' FROM p WHERE role = 'NUMERIC_METRIC' AND std > 0), "
    "sp AS (SELECT table_name, array_to_string(list(s ORDER BY o)[1:3], ' | ') AS spread FROM sg GROUP BY table_name)"
)
_HIGHLIGHTS = (
    "printf('Dataset contains %d rows across %d columns.', total_rows, total_columns) || ' | ' || "
    "printf('Role mix: %d metric, %d dimensions, %d datetime, %d identifiers.', len(nums), len(cats), len(dates), len(ids)) || ' | ' || "
    f"coalesce(spread, '{insights.NO_SPREAD}')"
)


@query("highlights", CATALOG_SQL + _SPREAD_CTE + f" SELECT t.table_name, {_HIGHLIGHTS} AS statistical_highlights FROM t LEFT JOIN sp ON t.table_name = sp.table_name")
def _(spark, d):
    return joined(insights.highlights(*catalog(spark, d, *CATALOG)), "statistical_highlights")


_FEATURES = "CASE WHEN gaps = 0 THEN array_to_string(list_concat(list_concat(nums[1:6], dates[1:2]), cats[1:4])[1:10], ' | ') ELSE '' END"
_ST = insights.STATISTICS
_USEFUL = (
    f"CASE WHEN gaps = 0 THEN concat_ws(' | ', CASE WHEN len(nums) > 0 THEN '{_ST['distribution']} | {_ST['outliers']}' END, "
    f"CASE WHEN len(cats) > 0 THEN '{_ST['frequency']}' END, CASE WHEN len(nums) > 0 AND len(cats) > 0 THEN '{_ST['groups']}' END, "
    f"CASE WHEN len(nums) > 0 AND len(dates) > 0 THEN '{_ST['series']}' END) ELSE '' END"
)
GUIDE = ("orders", "lineitem", "customer", "orders_n")


@query("guidance", O.tables_cte(*GUIDE) + f" SELECT table_name, {_FEATURES} AS important_features, {_USEFUL} AS useful_statistics FROM t")
def _(spark, d):
    return joined(insights.guidance(*catalog(spark, d, *GUIDE)), "important_features", "useful_statistics")


@query(
    "overview",
    CATALOG_SQL
    + f" SELECT table_name, printf('The dataset appears to be a %s with %d rows and %d columns. It includes %d numeric, %d categorical, and %d datetime columns.', lower({_domain_pick(0)}), total_rows, total_columns, len(nums), len(cats), len(dates)) AS executive_summary, "
    f"CASE WHEN dups > 0 THEN printf('%d duplicate rows detected.', dups) WHEN len(gappy20) > 0 THEN 'High missingness (>=20%) in ' || CAST(len(gappy20) AS VARCHAR) || ' columns: ' || {head('gappy20', 5)} || '.' ELSE '{insights.OVERVIEW_CLEAN}' END AS data_health_assessment, "
    f"concat_ws(' | ', '{' | '.join(insights.DIRECTIONS)}', CASE WHEN len(pks) > 0 THEN printf('{insights.TRACKING}', {head('pks', 3)}) END) AS statistical_highlights, "
    f"concat_ws(' | ', CASE WHEN dups > 0 THEN '{insights.SIGNAL_DUPLICATES}' END, CASE WHEN len(gappy20) > 0 THEN '{insights.SIGNAL_MISSING}' END, CASE WHEN dups = 0 AND len(gappy20) = 0 AND total_rows > 0 THEN '{insights.SIGNAL_NONE}' END) AS anomaly_indicators, "
    "array_to_string(list_concat(nums[1:6], cats[1:4]), ' | ') AS important_features FROM t",
)
def _(spark, d):
    out = insights.overview(*catalog(spark, d, *CATALOG)).drop("useful_statistics", "confidence")
    return joined(out, "statistical_highlights", "anomaly_indicators", "important_features")


@query(
    "summary_report",
    CATALOG_SQL + _SPREAD_CTE
    + f" SELECT t.table_name, printf('This dataset is best described as %s data with %d rows and %d columns. It includes %d measurable metric column(s) and %d time-oriented column(s).', lower({_domain_pick(0)}), total_rows, total_columns, len(nums), len(dates)) AS executive_summary, "
    f"{_HEALTH} AS data_health_assessment, {_HIGHLIGHTS} AS statistical_highlights, {_FLAGS} AS anomaly_indicators, {_FEATURES} AS important_features, {_USEFUL} AS useful_statistics, CAST(0.7 AS DOUBLE) AS confidence "
    "FROM t LEFT JOIN sp ON t.table_name = sp.table_name",
)
def _(spark, d):
    out = insights.summary_report(*catalog(spark, d, *CATALOG))
    return joined(out, "statistical_highlights", "anomaly_indicators", "important_features", "useful_statistics")


METRICS = ("lineitem", "orders_n", "events_n", "customer")
_VAR = (
    ", v0 AS (SELECT *, mx - mn AS rng, CASE WHEN std IS NOT NULL AND abs(mean) > 1e-7 THEN abs(std / mean) END AS score FROM p WHERE role = 'NUMERIC_METRIC'), "
    "v AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY coalesce(score, std, 0) DESC, ordinal) AS pos, "
    "CASE WHEN score IS NULL THEN 'Insufficient data' WHEN score >= 0.6 THEN 'High variability' WHEN score >= 0.3 THEN 'Moderate variability' ELSE 'Stable range' END AS band FROM v0)"
)


@query("variability", O.profile(*METRICS) + _VAR + ' SELECT table_name, pos AS position, col AS "column", round(rng, 4) AS range, round(score, 6) AS score, band FROM v')
def _(spark, d):
    profile, _ = catalog(spark, d, *METRICS)
    out = insights.variability(profile).select("table_name", "position", "column", "range", "score", "band")
    return rounded(rounded(out, 6, "score"), 4, "range")


def _texts(spec, *args: str) -> str:
    return f"printf('{spec}'{''.join(', ' + a for a in args)})"


_STD, _RNG = "printf('%.2f', std)", "printf('%.2f', rng)"


@query(
    "actionable",
    O.tables_cte(*METRICS) + _VAR
    + ", a AS (SELECT table_name, pos AS rank, printf('%s-%d', col, pos - 1) AS id, "
    f"CASE WHEN coalesce(score, 0) >= 0.6 THEN {_texts(insights.VOLATILITY[0], 'col')} WHEN coalesce(score, 0) >= 0.3 THEN {_texts(insights.SEGMENTATION[0], 'col')} ELSE {_texts(insights.BASELINE[0], 'col')} END AS title, "
    f"CASE WHEN coalesce(score, 0) >= 0.6 THEN {_texts(insights.VOLATILITY[1], 'col', _STD, _RNG)} WHEN coalesce(score, 0) >= 0.3 THEN {_texts(insights.SEGMENTATION[1], 'col', _STD, _RNG)} ELSE {_texts(insights.BASELINE[1], 'col', _STD)} END AS signal, "
    f"CASE WHEN coalesce(score, 0) >= 0.6 THEN {_texts(insights.VOLATILITY[2], 'col')} WHEN coalesce(score, 0) >= 0.3 THEN {_texts(insights.SEGMENTATION[2], 'col')} ELSE {_texts(insights.BASELINE[2], 'col')} END AS analysis_action FROM v WHERE pos <= 3 "
    f"UNION ALL SELECT table_name, 4, 'time-series-opportunity', '{insights.TIME_SERIES[0]}', {_texts(insights.TIME_SERIES[1], 'dates[1]')}, {_texts(insights.TIME_SERIES[2], 'dates[1]')} FROM t WHERE len(nums) > 0 AND len(dates) > 0 "
    f"UNION ALL SELECT table_name, 5, 'cross-metric-driver', '{insights.CROSS_METRIC[0]}', {_texts(insights.CROSS_METRIC[1], 'len(nums)')}, '{insights.CROSS_METRIC[2]}' FROM t WHERE len(nums) >= 3) "
    "SELECT table_name, row_number() OVER (PARTITION BY table_name ORDER BY rank) AS position, id, title, signal, analysis_action FROM a",
)
def _(spark, d):
    return insights.actionable(*catalog(spark, d, *METRICS)).drop("business_impact")


@query("high_signal", O.profile(*METRICS) + " SELECT table_name, pos AS position, col AS \"column\", round(std, 4) AS std, round(rng, 4) AS range FROM (SELECT *, mx - mn AS rng, row_number() OVER (PARTITION BY table_name ORDER BY coalesce(std, mx - mn) DESC, ordinal) AS pos FROM p WHERE role = 'NUMERIC_METRIC') WHERE pos <= 4")
def _(spark, d):
    profile, _ = catalog(spark, d, *METRICS)
    return rounded(insights.high_signal_metrics(profile), 4, "std", "range")


@query("segment_dims", O.profile(*CATALOG, "lineitem") + " SELECT table_name, pos AS position, col AS \"column\", n_distinct FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY ordinal) AS pos FROM p WHERE role IN ('CATEGORICAL_DIMENSION', 'BOOLEAN') AND n_distinct BETWEEN 2 AND 30) WHERE pos <= 4")
def _(spark, d):
    profile, _ = catalog(spark, d, *CATALOG, "lineitem")
    return insights.segment_dimensions(profile)


@query("worst_missing", O.profile("orders_n", "events_n") + ' SELECT table_name, pos AS position, col AS "column", missing_pct, round(greatest(100 * missing_pct / greatest(max(missing_pct) OVER (PARTITION BY table_name), 1.0), 6.0), 4) AS bar FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY missing_pct DESC, ordinal) AS pos FROM p WHERE missing_pct > 0) WHERE pos <= 10')
def _(spark, d):
    profile, _ = catalog(spark, d, "orders_n", "events_n")
    return rounded(insights.worst_missing(profile), 4, "bar")


# --- jobs ------------------------------------------------------------------------------


def _step_rows(run: analysis.StepRun) -> DataFrame:
    return run.results.select("step_id", "operation", "status", "summary", F.size(F.coalesce("metrics", F.create_map().cast("map<string,string>"))).alias("n_metrics"))


def _steps_sql(*steps: tuple[str, str, str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{sid}' AS step_id, '{op}' AS operation, 'SUCCESS' AS status, '{text}' AS summary, CAST(({n}) AS INT) AS n_metrics" for sid, op, text, n in steps
    )


@query(
    "run_steps_descriptive",
    _steps_sql(
        ("step_1", "SUMMARY", "Generated dataframe summary statistics.", "2"),
        ("step_2", "GROUPBY", "Computed mean by o_orderstatus for o_totalprice.", "SELECT count(DISTINCT o_orderstatus) FROM orders"),
        ("step_3", "TREND", "Monthly mean trend for o_totalprice", "SELECT count(DISTINCT date_trunc('month', o_orderdate)) FROM orders"),
    ),
)
def _(spark, d):
    return _step_rows(analysis.report(V.read(spark, d, "orders"), "DESCRIPTIVE"))


@query(
    "run_steps_diagnostic",
    _steps_sql(
        ("step_1", "SUMMARY", "Generated dataframe summary statistics.", "2"),
        ("step_2", "GROUPBY", "Computed mean by l_linenumber for l_quantity.", "SELECT count(DISTINCT l_linenumber) FROM lineitem"),
        ("step_3", "CORRELATION", "Computed correlation matrix for numeric columns.", "2"),
    ),
)
def _(spark, d):
    return _step_rows(analysis.report(V.read(spark, d, "lineitem"), "DIAGNOSTIC"))


@query(
    "run_steps_cleaning",
    _steps_sql(
        ("step_1", "CLEAN_DATA", "Applied deterministic data cleaning operations.", "5"),
        ("step_2", "SUMMARY", "Generated dataframe summary statistics.", "2"),
    ),
)
def _(spark, d):
    return _step_rows(analysis.report(orders_n(spark, d), "DATA_CLEANING"))


@query(
    "run_steps_predictive",
    _steps_sql(
        ("step_1", "TRAIN_MODEL", "Trained baseline regression model on target ''l_extendedprice''.", "6"),
        ("step_2", "EVALUATE_MODEL", "Evaluated regression model performance.", "3"),
    ),
)
def _(spark, d):
    return _step_rows(analysis.report(V.read(spark, d, "lineitem"), "PREDICTIVE", "l_extendedprice"))


@query(
    "driver_analysis",
    "WITH " + O.anova(O.class_groups("orders", "o_orderstatus", ["o_totalprice"])) + f", x AS ({O.chi_square('orders', 'o_orderpriority', 'o_orderstatus')}) "
    "SELECT feature, 'anova_multi_class' AS test_type, n, round(f_stat, 4) AS statistic, round(pow(1 + 2 * f_stat / df2, -df2 / 2), 6) AS p_value, round(eta, 6) AS effect_size, "
    "CAST(NULL AS DOUBLE) AS correlation, true AS ranked, 1.0::DOUBLE AS importance FROM f UNION ALL "
    "SELECT feature, 'chi_square', n, round(chi2, 4), NULL, round(sqrt(chi2 / n / 2), 6), NULL, true, 1.0 FROM x",
)
def _(spark, d):
    done = analysis.driver_analysis(V.read(spark, d, "orders"), "o_orderstatus")
    every = Window.partitionBy()  # a row per feature
    ranks = done.ranking.select(
        "feature",
        (F.sort_array(F.collect_list("importance_rank").over(every)) == F.sequence(F.lit(1), F.count(F.lit(1)).over(every).cast("int"))).alias("ranked"),
        F.round(F.sum("feature_importance").over(every), 6).alias("importance"),
    )
    return _test_rows(done.results, ("o_totalprice",)).join(ranks, "feature")


def _step_metrics(run: analysis.StepRun) -> DataFrame:
    """Every metric of every step: numbers rounded, other values as text."""
    cells = run.results.select("step_id", "status", F.explode("metrics").alias("metric", "value"))
    number = F.expr("try_cast(value AS double)")
    dated = F.col("metric").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    return cells.select(
        "step_id", "status", F.when(dated, F.substring("metric", 1, 10)).otherwise(F.col("metric")).alias("metric"),
        F.round(number, 4).alias("number"), F.when(number.isNull(), F.col("value")).alias("text"),
    )


def _metrics_sql(*parts: tuple[str, str, str]) -> str:
    """(step_id, metric, number or text) of relations with the columns metric and number or text."""
    return " UNION ALL ".join(
        f"SELECT '{sid}' AS step_id, 'SUCCESS' AS status, CAST(metric AS VARCHAR) AS metric, {number} AS number, {text} AS text FROM ({sql})"
        for sid, kind, sql in parts
        for number, text in [("round(CAST(v AS DOUBLE), 4)", "CAST(NULL AS VARCHAR)") if kind == "number" else ("CAST(NULL AS DOUBLE)", "v")]
    )


def _shape_sql(src: str, columns: int) -> str:
    return f"SELECT 'rows' AS metric, count(*)::DOUBLE AS v FROM {src} UNION ALL SELECT 'columns', {columns}"


@query(
    "step_metrics_descriptive",
    _metrics_sql(
        ("step_1", "number", _shape_sql("orders", 6)),
        ("step_2", "number", "SELECT o_orderstatus AS metric, avg(o_totalprice) AS v FROM orders GROUP BY 1"),
        ("step_3", "number", "SELECT CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS metric, avg(o_totalprice) AS v FROM orders GROUP BY 1"),
    ),
)
def _(spark, d):
    group = {"group_by": "o_orderstatus", "target_column": "o_totalprice", "agg": "mean"}
    trend = {"datetime_column": "o_orderdate", "target_column": "o_totalprice"}
    steps = [("SUMMARY", {}), ("GROUPBY", group), ("TREND", trend)]
    steps = [{"step_id": f"step_{i}", "operation": op, "parameters": p} for i, (op, p) in enumerate(steps, 1)]
    return _step_metrics(analysis.run_steps(V.read(spark, d, "orders"), steps))


_LINE_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{a}, {b}' AS pair, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM lineitem"
    for i, a in enumerate(_LINE_ALL) for j, b in enumerate(_LINE_ALL) if i < j
)


@query(
    "step_metrics_diagnostic",
    _metrics_sql(
        ("step_1", "number", _shape_sql("lineitem", 11)),
        ("step_2", "number", "SELECT l_linenumber AS metric, avg(l_quantity) AS v FROM lineitem GROUP BY 1"),
        ("step_3", "text", f"SELECT 'strongest_pair' AS metric, pair AS v FROM ({_PAIRS_SQL}) ORDER BY abs(r) DESC, i, j LIMIT 1"),
        ("step_3", "number", f"SELECT 'strongest_value' AS metric, r AS v FROM ({_PAIRS_SQL}) ORDER BY abs(r) DESC, i, j LIMIT 1"),
    ),
)
def _(spark, d):
    return _step_metrics(analysis.report(V.read(spark, d, "lineitem"), "DIAGNOSTIC"))


_EN_GAPS = "(SELECT count(*) * 3 - count(ts) - count(event_type) - count(value) FROM " + EN + ")"


@query(
    "step_metrics_cleaning",
    _metrics_sql(
        (
            "step_1", "number",
            f"SELECT unnest(['rows_before', 'missing_before', 'duplicates_removed', 'rows_after', 'missing_after']) AS metric, "
            f"unnest([a, {_EN_GAPS}, a - b, b, 0]) AS v FROM (SELECT (SELECT count(*) FROM {EN}) AS a, (SELECT count(*) FROM (SELECT DISTINCT * FROM {EN})) AS b)",
        ),
        ("step_2", "number", _shape_sql(f"(SELECT DISTINCT * FROM {EN})", 5)),
    ),
)
def _(spark, d):
    return _step_metrics(analysis.report(events_n(spark, d), "DATA_CLEANING"))


@query(
    "step_metrics_predictive",
    "WITH s AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b, l_orderkey % 5 = 0 AS t FROM lineitem), "
    "m AS (SELECT covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM s WHERE NOT t), "
    "w AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS wb FROM m), "
    "e AS (SELECT y, y - (my + wa * (a - ma) + wb * (b - mb)) AS e FROM s, w WHERE t), "
    "q AS (SELECT avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(y) * count(y)) AS r2 FROM e), "
    "n AS (SELECT count(*) FILTER (WHERE NOT t) AS a, count(*) FILTER (WHERE t) AS b FROM s) "
    + _metrics_sql(
        ("step_1", "text", "SELECT unnest(['task_type', 'target_column']) AS metric, unnest(['regression', 'l_extendedprice']) AS v"),
        ("step_1", "number", "SELECT unnest(['train_rows', 'test_rows', 'feature_count']) AS metric, unnest([a, b, 2]) AS v FROM n"),
        ("step_2", "number", "SELECT unnest(['mae', 'rmse', 'r2']) AS metric, unnest([mae, rmse, r2]) AS v FROM q"),
    ),
)
def _(spark, d):
    src = model.modulo_split(V.read(spark, d, "lineitem"), "l_orderkey").select("l_quantity", "l_discount", "l_extendedprice", "is_test")
    train = {"target_column": "l_extendedprice", "split_column": "is_test"}
    steps = [
        {"step_id": "step_1", "operation": "TRAIN_MODEL", "parameters": train}, {"step_id": "step_2", "operation": "EVALUATE_MODEL"},
    ]
    return _step_metrics(analysis.run_steps(src, steps))


_FILLED = (
    f"cl AS (SELECT event_id, user_id, coalesce(event_type, {mode_sql(EN, 'event_type')}) AS event_type, "
    f"coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {EN})) AS value FROM {EN})"
)


@query(
    "drivers_after_steps",
    f"WITH {_FILLED}, " + O.anova(O.class_groups("cl", "event_type", ["value"]))
    + " SELECT feature, 'anova_multi_class' AS test_type, n, round(f_stat, 4) AS statistic, round(eta, 6) AS effect_size, CAST(1 AS INT) AS importance_rank, "
    "'SUCCESS' AS cleaned FROM f",
)
def _(spark, d):
    steps = [{"step_id": "clean", "operation": "CLEAN_DATA"}]
    run, done = analysis.report_with_drivers(events_n(spark, d), steps, "event_type", importance=False)
    status = run.results.first()["status"]
    tests = _test_rows(done.results).select("feature", "test_type", "n", "statistic", "effect_size")
    return tests.join(done.ranking.select("feature", "importance_rank"), "feature").withColumn("cleaned", F.lit(status))


# --- more of the sources, fills and trends ----------------------------------------------


@query(
    "csv_typed",
    "SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem",
)
def _(spark, d):
    path = work_folder(spark)
    written = V.read(spark, d, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    written.write.option("header", "true").csv(path)
    return S.load_table(spark, path, "csv")


@query(
    "csv_line_breaks",
    "SELECT doc_id, md5(text) AS digest, lang FROM documents",
)
def _(spark, d):
    path = work_folder(spark)
    docs = V.read(spark, d, "documents").select("doc_id", "text", "lang")
    docs.write.options(header="true", escape='"').csv(path)
    read = S.load_table(spark, path, "csv", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    return read.select("doc_id", F.md5("text").alias("digest"), "lang")


@query(
    "file_inventory",
    "SELECT * FROM (VALUES " + ", ".join(f"('{n}.parquet', '.parquet', true)" for n in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    )) + ") t(name, extension, accepted)",
)
def _(spark, d):
    return S.file_inventory(spark, d).filter(F.col("size_bytes") > 0).select("name", "extension", "accepted")


@query(
    "trend_mean_flag",
    "SELECT CAST(last_day(o_orderdate) AS VARCHAR) AS month_end, round(avg(CAST(o_totalprice > 100000 AS INT)), 8) AS value FROM orders GROUP BY 1",
)
def _(spark, d):
    src = V.read(spark, d, "orders").select("o_orderdate", (F.col("o_totalprice") > 100000).alias("large"))
    out = rounded(tables.trend(src, "o_orderdate", "large"), 8, "value")
    return out.withColumn("month_end", F.col("month_end").cast("string"))


@query(
    "fill_mode_text",
    "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE text END AS text FROM documents), "
    "m AS (SELECT text FROM (SELECT text, count(*) AS n FROM s WHERE text IS NOT NULL GROUP BY text) ORDER BY n DESC, text LIMIT 1) "
    "SELECT doc_id, md5(coalesce(s.text, m.text)) AS digest FROM s, m",
)
def _(spark, d):
    src = V.read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 > 0, F.col("text")).alias("text"))
    return missing.fill_mode(src, ["text"]).select("doc_id", F.md5("text").alias("digest"))


@query(
    "groupby_prod_skew",
    "SELECT 'skew' AS agg, l_returnflag AS \"group\", round(skewness(l_extendedprice), 6) AS value FROM lineitem GROUP BY 2 UNION ALL "
    "SELECT 'prod', l_returnflag, round(product(1 + l_tax / 1000), 6) FROM lineitem GROUP BY 2",
)
def _(spark, d):
    src = V.read(spark, d, "lineitem").withColumn("factor", 1 + F.col("l_tax") / 1000)
    skew = tables.group_top(src, "l_returnflag", "l_extendedprice", "skew").withColumn("agg", F.lit("skew"))
    prod = tables.group_top(src, "l_returnflag", "factor", "prod").withColumn("agg", F.lit("prod"))
    return rounded(skew.unionByName(prod), 6, "value").select("agg", "group", "value")


_WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlation_wide",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 7) AS r FROM lineitem"
        for i, a in enumerate(_WIDE) for b in _WIDE[i + 1 :]
    ),
)
def _(spark, d):
    return rounded(tables.correlation_pairs(V.read(spark, d, "lineitem")).select("column_a", "column_b", "r"), 7, "r")

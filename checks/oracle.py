"""SQL counterparts of the Spark queries, built from the rule texts of the operators."""

from __future__ import annotations

from checks import views as V

ORDERS = [
    ("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"), ("o_totalprice", "number"),
    ("o_orderdate", "datetime"), ("o_orderpriority", "text"),
]
ORDERS_N_COLS = [*ORDERS, ("o_note", "text")]
EVENTS_N_COLS = [
    ("event_id", "number"), ("ts", "datetime"), ("user_id", "number"), ("event_type", "text"), ("value", "number"),
]
LINEITEM = [
    ("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"),
    ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"),
    ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "datetime"),
]
DUP_COLS = [("l_returnflag", "text"), ("l_linestatus", "text"), ("l_linenumber", "number"), ("l_quantity", "number")]
CUSTOMER = [
    ("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "text"),
]
NATION = [("n_nationkey", "number"), ("n_name", "text"), ("n_regionkey", "number")]

SOURCES = {
    "orders_n": (V.sql("orders", V.ORDERS_N), ORDERS_N_COLS),
    "events_n": (V.sql("events", V.EVENTS_N), EVENTS_N_COLS),
    "lineitem": ("lineitem", LINEITEM),
    "orders": ("orders", ORDERS),
    "customer": ("customer", CUSTOMER),
    "nation": ("nation", NATION),
    "lineitem_dup": (V.sql("lineitem", V.LINEITEM_DUP), DUP_COLS),
}


def column_rows(table: str) -> str:
    """One SELECT per column with counts, moments and the top value."""
    src, cols = SOURCES[table]
    parts = []
    for i, (name, kind) in enumerate(cols):
        num = kind == "number"

        def moment(fn: str) -> str:
            return f"{fn}(CAST({name} AS DOUBLE))" if num else "CAST(NULL AS DOUBLE)"

        top = (
            f"(SELECT {{}} FROM (SELECT {name} AS v, count(*) AS n FROM {src} WHERE {name} IS NOT NULL GROUP BY 1) "
            "ORDER BY n DESC, v ASC LIMIT 1)"
        )
        parts.append(
            f"SELECT '{table}' AS table_name, {i} AS ordinal, '{name}' AS col, '{kind}' AS kind, count(*) AS n_rows, "
            f"count(*) - count({name}) AS n_missing, coalesce(round(100.0 * (count(*) - count({name})) / nullif(count(*), 0), 2), 0) AS missing_pct, "
            f"count(DISTINCT {name}) AS n_distinct, {moment('avg')} AS mean, {moment('stddev_samp')} AS std, "
            f"{moment('min')} AS mn, {moment('max')} AS mx, "
            f"{top.format('CAST(v AS VARCHAR)')} AS top_value, {top.format('n')} AS top_frequency FROM {src}"
        )
    return " UNION ALL ".join(parts)


ID_TEST = "(" + " OR ".join(f"contains(replace(lower(col), ' ', '_'), '{h}')" for h in ("id", "uuid", "key", "code")) + ")"
ROLE = (
    f"CASE WHEN n_distinct = n_rows AND n_rows > 0 THEN 'IDENTIFIER' WHEN {ID_TEST} THEN 'IDENTIFIER' "
    "WHEN kind = 'datetime' THEN 'DATETIME' WHEN kind = 'bool' THEN 'BOOLEAN' "
    "WHEN kind = 'number' AND n_distinct < 10 THEN 'CATEGORICAL_DIMENSION' WHEN kind = 'number' THEN 'NUMERIC_METRIC' "
    "WHEN n_distinct < 50 THEN 'CATEGORICAL_DIMENSION' ELSE 'TEXT' END"
)


def profile(*tables: str) -> str:
    """WITH clause: ``p`` has the column profiles of the tables."""
    raw = " UNION ALL ".join(column_rows(t) for t in tables)
    return f"WITH raw AS ({raw}), p AS (SELECT *, {ROLE} AS role FROM raw)"


def names(condition: str, alias: str) -> str:
    return f"list(col ORDER BY ordinal) FILTER (WHERE {condition}) AS {alias}"


def tables_cte(*tables: str) -> str:
    """``p`` plus ``t``: one row per table with role lists and duplicate rows."""
    copies = " ".join(
        f"WHEN '{t}' THEN (SELECT count(*) FROM {SOURCES[t][0]}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {SOURCES[t][0]}))"
        for t in tables
    )
    return (
        profile(*tables)
        + ", t0 AS (SELECT table_name, max(n_rows) AS total_rows, count(*) AS total_columns, "
        + names("role = 'NUMERIC_METRIC'", "nums") + ", " + names("role IN ('CATEGORICAL_DIMENSION', 'BOOLEAN')", "cats") + ", "
        + names("role = 'DATETIME'", "dates") + ", " + names("role = 'IDENTIFIER'", "ids") + ", "
        + names("n_missing = 0 AND n_distinct = n_rows", "pks") + ", " + names("missing_pct > 10", "gappy") + ", "
        + names("missing_pct >= 20", "gappy20") + ", sum(n_missing) AS gaps, "
        + "arg_min(col, struct_pack(a := -missing_pct, b := ordinal)) AS worst, max(missing_pct) AS worst_pct "
        + "FROM p GROUP BY table_name), "
        + "t AS (SELECT table_name, total_rows, total_columns, coalesce(nums, []) AS nums, coalesce(cats, []) AS cats, "
        + "coalesce(dates, []) AS dates, coalesce(ids, []) AS ids, coalesce(pks, []) AS pks, coalesce(gappy, []) AS gappy, "
        + f"coalesce(gappy20, []) AS gappy20, gaps, worst, worst_pct, CASE table_name {copies} END AS dups FROM t0)"
    )


def dec(x: str, digits: int) -> str:
    return f"regexp_replace(printf('%.{digits}f', {x}), '(\\.\\d+?)0+$', '\\1')"


def anova(groups: str, extra: str = "") -> str:
    """ANOVA columns from a relation g(feature, cls, n, m, v), groups below 3 left out."""
    return (
        f"g AS ({groups}), kept AS (SELECT * FROM g WHERE n >= 3), "
        "tot AS (SELECT feature, count(*) AS k, sum(n) AS nn, sum(n * m) / sum(n) AS gm FROM kept GROUP BY feature), "
        "a AS (SELECT kept.feature, any_value(k) AS k, any_value(nn) AS nn, sum(n * (m - gm) * (m - gm)) AS ssb, "
        "sum((n - 1) * v) AS ssw FROM kept JOIN tot ON kept.feature = tot.feature GROUP BY kept.feature), "
        "f AS (SELECT feature, CAST(nn AS BIGINT) AS n, k - 1.0 AS df1, CAST(nn - k AS DOUBLE) AS df2, "
        "(ssb / (k - 1)) / (ssw / (nn - k)) AS f_stat, ssb / (ssb + ssw) AS eta FROM a)"
    )


def class_groups(src: str, target: str, features: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS feature, {target} AS cls, count({x}) AS n, avg(CAST({x} AS DOUBLE)) AS m, var_samp(CAST({x} AS DOUBLE)) AS v "
        f"FROM {src} WHERE {target} IS NOT NULL GROUP BY {target}"
        for x in features
    )


def chi_square(src: str, feature: str, target: str) -> str:
    """chi2, dof, v of one feature, all cells spelled out; Yates when dof = 1."""
    base = f"(SELECT CAST({feature} AS VARCHAR) AS x, CAST({target} AS VARCHAR) AS y FROM {src} WHERE {feature} IS NOT NULL AND {target} IS NOT NULL)"
    return (
        f"SELECT '{feature}' AS feature, n, (r - 1) * (k - 1) AS dof, "
        "CASE WHEN (r - 1) * (k - 1) = 1 THEN yates ELSE plain END AS chi2 FROM ("
        "SELECT any_value(n) AS n, count(DISTINCT x) AS r, count(DISTINCT y) AS k, sum((o - e) * (o - e) / e) AS plain, "
        "sum(greatest(abs(o - e) - 0.5, 0) * greatest(abs(o - e) - 0.5, 0) / e) AS yates FROM ("
        "SELECT rx.x, cy.y, coalesce(o.n, 0) AS o, rx.n * (CAST(cy.n AS DOUBLE) / tt.n) AS e, tt.n AS n "
        f"FROM (SELECT x, count(*) AS n FROM {base} GROUP BY x) rx "
        f"CROSS JOIN (SELECT y, count(*) AS n FROM {base} GROUP BY y) cy CROSS JOIN (SELECT count(*) AS n FROM {base}) tt "
        f"LEFT JOIN (SELECT x, y, count(*) AS n FROM {base} GROUP BY x, y) o ON o.x = rx.x AND o.y = cy.y))"
    )


FLAG_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def flag_tests() -> str:
    """``r``: test results of lineitem features against l_returnflag, p in closed form."""
    order = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_tax", "l_linestatus"]
    place = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(order, start=1))
    chi = chi_square("lineitem", "l_linestatus", "l_returnflag")
    return (
        "WITH " + anova(class_groups("lineitem", "l_returnflag", FLAG_NUMBERS)) + f", x AS ({chi}), "
        "r0 AS (SELECT feature, 'anova_multi_class' AS test_type, n, f_stat AS statistic, "
        "pow(1 + 2 * f_stat / df2, -df2 / 2) AS p, eta AS effect FROM f UNION ALL "
        "SELECT feature, 'chi_square', n, chi2, exp(-chi2 / 2), sqrt(chi2 / n) FROM x), "
        f"r AS (SELECT *, CASE feature {place} END AS ordinal FROM r0)"
    )


SIGNIFICANCE = (
    "CASE WHEN p IS NULL THEN 0.4 WHEN p <= 0.001 THEN 1.0 WHEN p <= 0.01 THEN 0.9 WHEN p <= 0.05 THEN 0.75 "
    "WHEN p <= 0.1 THEN 0.55 ELSE 0.25 END"
)


def ranked() -> str:
    """``d``: driver ranking over the flag tests."""
    return flag_tests() + (
        f", s AS (SELECT *, CAST(0.35 AS DOUBLE) * {SIGNIFICANCE} + CAST(0.25 AS DOUBLE) * least(abs(effect), 1.0) AS raw FROM r), "
        "d AS (SELECT feature, ordinal, p, effect, round(raw / max(raw) OVER (), 4) AS strength, "
        "row_number() OVER (ORDER BY raw DESC, ordinal) AS rnk, "
        "CASE WHEN p <= 0.01 THEN 'Strong' WHEN p <= 0.05 THEN 'Moderate' ELSE 'Weak' END AS label, "
        "CASE WHEN abs(effect) > 0.3 THEN 'Material segment effect' ELSE 'Signal present but moderate' END AS hint FROM s)"
    )

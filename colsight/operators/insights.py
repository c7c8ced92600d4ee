"""Rule-based data-quality and insight tables, computed from profiles of many tables.

``columns`` is a column profile, ``tables`` a table profile; both are small, and each
rule is a column expression over them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.functions.exprs import decimal_text, fixed_text
from colsight.operators import profile as P

# Missing percentages that count as high (summary / overview), columns named
# in a flag, items kept in a list.
SUMMARY_MISSING, OVERVIEW_MISSING = 10.0, 20.0
NAMED_COLUMNS = 5
LIST_ITEMS = 5
TOP_CATEGORY_COLUMNS = 15
SUMMARY_CONFIDENCE, OVERVIEW_CONFIDENCE = 0.7, 0.62

# Domain labels with confidence, reasoning and suggested measures.
DOMAINS = {
    "series": (
        "Operational Time-Series Dataset", 0.58,
        "Detected datetime column(s) %s and metric column(s) %s, indicating trend-ready operational data.",
        ("Trend Growth Rate", "Period-over-Period Change", "Data Completeness"),
    ),
    "metrics": (
        "Business Metrics Dataset", 0.52,
        "Detected measurable numeric metrics (%s) and categorical dimensions suitable for segmented KPI analysis.",
        ("Metric Distribution", "Segment Performance", "Duplicate Row Rate"),
    ),
    "lookup": (
        "Reference or Lookup Dataset", 0.49,
        "Identifier columns dominate the schema, which suggests a reference-oriented table rather than a metric-heavy analytical dataset.",
        ("Identifier Coverage", "Completeness by Field", "Duplicate Identifier Rate"),
    ),
    "limited": (
        "Structured Dataset with Limited Domain Signals", 0.36,
        "Available metadata contains limited metric/time signals, so domain confidence remains conservative.",
        ("Missing Data Rate", "Duplicate Row Rate", "Column Completeness"),
    ),
}

# Sentences of the summary report.
DUPLICATE_FLAG = "%d duplicate rows detected, indicating integrity risk."
MISSING_FLAG = "Missingness above 10%% in %d columns: %s."
WORST_FLAG = "Highest missingness is %s%% in column '%s'."
NO_FLAG = "No critical anomaly signals detected from duplicates and missingness checks."
HEALTH_DUPLICATES = "Duplicate rows require deduplication before deeper analysis."
HEALTH_MISSING = "Several columns exceed 10% missingness and need imputation strategy."
HEALTH_IDENTIFIERS = "Identifier-heavy structure suggests a lookup or reference-oriented table."
HEALTH_STABLE = "Core health signals are stable with low duplicates and manageable missingness."
SHAPE = "Dataset contains %d rows across %d columns."
ROLE_MIX = "Role mix: %d metric, %d dimensions, %d datetime, %d identifiers."
SPAN = "%s spans from %s to %s."
DEVIATION = "%s has standard deviation %s."
NO_SPREAD = "Numeric spread signals are limited from available summaries."
EXECUTIVE = (
    "This dataset is best described as %s data with %d rows and %d columns. "
    "It includes %d measurable metric column(s) and %d time-oriented column(s)."
)
STATISTICS = {
    "distribution": "Distribution summary (mean, median, std, range) for key metric columns.",
    "outliers": "Outlier checks using IQR or z-score on high-variance metrics.",
    "frequency": "Category-level frequency and concentration analysis for segment columns.",
    "groups": "Group-wise comparison (ANOVA or Kruskal) between dimensions and metrics.",
    "series": "Time-series trend and seasonality checks for datetime-linked metrics.",
}

# Sentences of the first overview.
OVERVIEW_DUPLICATES = "%d duplicate rows detected."
OVERVIEW_HIGH_MISSING = "High missingness (>=20%%) in %d columns: %s."
OVERVIEW_CLEAN = "No major quality issues detected from deterministic profile checks."
DIRECTIONS = (
    "Analyze trends across key numeric features.",
    "Investigate relationships between categorical segments and numeric outcomes.",
    "Prioritize cleanup for columns with missing values before deeper modeling.",
)
TRACKING = "Use potential identifier(s) %s for record-level tracking."
SIGNAL_DUPLICATES = "Duplicate rows may indicate ingestion or upstream merge issues."
SIGNAL_MISSING = "Concentrated missingness may indicate process gaps in data capture."
SIGNAL_NONE = "No immediate anomaly signals from duplicate/missingness checks."
OVERVIEW_EXECUTIVE = (
    "The dataset appears to be a %s with %d rows and %d columns. "
    "It includes %d numeric, %d categorical, and %d datetime columns."
)
OVERVIEW_STATISTICS = (
    "Distribution summary for numeric metrics.",
    "Segment-level comparisons across categorical dimensions.",
)

# Variability steps and labels; texts of the actionable insights.
HIGH_VARIABILITY, MODERATE_VARIABILITY, SMALLEST_MEAN = 0.6, 0.3, 1e-7
BANDS = ("Insufficient data", "High variability", "Moderate variability", "Stable range")
ACTIONABLE_METRICS, ACTIONABLE_ROWS, CROSS_METRICS = 3, 5, 3
VOLATILITY = (
    "%s: Volatility Driver",
    "%s shows high movement (std %s, range %s).",
    "Run distribution diagnostics, outlier checks, and segmented variance analysis on %s.",
    "Supports risk control, threshold setting, and faster detection of unstable operating conditions.",
)
SEGMENTATION = (
    "%s: Segmentation Signal",
    "%s has moderate spread (std %s, range %s).",
    "Use %s for cohort segmentation, benchmarking, and before/after performance comparisons.",
    "Enables targeted interventions and sharper prioritization across customer, team, or regional segments.",
)
BASELINE = (
    "%s: Baseline KPI",
    "%s is relatively stable (std %s).",
    "Treat %s as a control metric for baseline tracking and drift monitoring.",
    "Improves measurement consistency and helps separate structural change from short-term noise.",
)
TIME_SERIES = (
    "Time-Series Opportunity",
    "%s introduces a usable temporal axis for trend and seasonality analysis.",
    "Create weekly/monthly trends and seasonal decomposition using %s.",
    "Improves planning precision for demand, staffing, budget pacing, and operational timing.",
)
CROSS_METRIC = (
    "Cross-Metric Driver Discovery",
    "Detected %d metric columns, allowing multivariate driver analysis.",
    "Prioritize correlation heatmaps and grouped comparisons across the top-variance metrics.",
    "Helps identify the few controllable levers most likely to move strategic KPIs.",
)
# Rows of the metric, dimension and missing rankings; level range; least bar.
SIGNAL_METRICS, SEGMENT_COLUMNS, SEGMENT_LEVELS, WORST_COLUMNS, LEAST_BAR = 4, 4, (2, 30), 10, 6.0


def _names(col: str | Column, n: int) -> Column:
    return F.array_join(F.slice(col, 1, n), ", ")


def _nth(*order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy("table_name").orderBy(*order))


def _identifier_heavy() -> Column:
    size = F.size("identifier_columns")
    return (size > 0) & (size >= F.greatest(F.lit(1), F.floor(F.col("total_columns") / 2)))


# --- one row per table -----------------------------------------------------------------


def domain_labels(tables: DataFrame) -> DataFrame:
    """Domain label, confidence, reasoning and suggested measures per table."""
    metrics, times = F.size("numeric_columns") > 0, F.size("datetime_columns") > 0
    kind = (
        F.when(times & metrics, "series")
        .when(metrics, "metrics")
        .when(_identifier_heavy(), "lookup")
        .otherwise("limited")
    )

    def pick(make) -> Column:
        out = None
        for name, spec in DOMAINS.items():
            test = F.col("kind") == name
            out = F.when(test, make(name, spec)) if out is None else out.when(test, make(name, spec))
        return out

    def reasoning(name: str, spec) -> Column:
        if name == "series":
            return F.format_string(spec[2], _names("datetime_columns", 2), _names("numeric_columns", 2))
        if name == "metrics":
            return F.format_string(spec[2], _names("numeric_columns", 3))
        return F.lit(spec[2])

    return tables.withColumn("kind", kind).select(
        "table_name",
        pick(lambda _, s: F.lit(s[0])).alias("domain_label"),
        pick(lambda _, s: F.lit(s[1])).alias("confidence"),
        pick(reasoning).alias("reasoning"),
        pick(lambda _, s: F.array(*[F.lit(k) for k in s[3]])).alias("suggested_kpis"),
    )


def high_missing_columns(columns: DataFrame, above: float = SUMMARY_MISSING, inclusive: bool = False) -> DataFrame:
    test = F.col("missing_pct") >= above if inclusive else F.col("missing_pct") > above
    return columns.filter(test).select("table_name", "ordinal", "column", "missing_pct")


def metric_ranges(columns: DataFrame) -> DataFrame:
    return columns.filter(F.col("role") == P.METRIC).select("table_name", "ordinal", "column", "min", "max", "mean", "std")


def top_categories(columns: DataFrame, limit: int = TOP_CATEGORY_COLUMNS) -> DataFrame:
    """Top value, its frequency and the level count of the first dimensions of each table."""
    dims = columns.filter(F.col("role") == P.CATEGORY).withColumn("nth", _nth("ordinal"))
    return dims.filter(F.col("nth") <= limit).select("table_name", "ordinal", "column", "top_value", "top_frequency", "n_distinct")


def _missing_facts(columns: DataFrame, above: float = SUMMARY_MISSING, inclusive: bool = False) -> DataFrame:
    test = F.col("missing_pct") >= above if inclusive else F.col("missing_pct") > above
    return columns.groupBy("table_name").agg(
        P.names_where(test).alias("gappy"),
        F.min(F.struct((-F.col("missing_pct")).alias("neg"), "ordinal", "column")).alias("worst"),
    )


def anomaly_flags(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_name, anomaly_indicators): duplicates, high missingness, the worst column."""
    full = tables.join(_missing_facts(columns), "table_name")
    worst = -F.col("worst.neg")
    flags = F.array_compact(
        F.array(
            F.when(F.col("duplicate_rows") > 0, F.format_string(DUPLICATE_FLAG, "duplicate_rows")),
            F.when(F.size("gappy") > 0, F.format_string(MISSING_FLAG, F.size("gappy"), _names("gappy", NAMED_COLUMNS))),
            F.when(worst > 0, F.format_string(WORST_FLAG, decimal_text(worst, 2), F.col("worst.column"))),
        )
    )
    shown = F.when(F.size(flags) > 0, F.slice(flags, 1, LIST_ITEMS)).otherwise(F.array(F.lit(NO_FLAG)))
    return full.select("table_name", shown.alias("anomaly_indicators"))


def health(columns: DataFrame, tables: DataFrame) -> DataFrame:
    full = tables.join(_missing_facts(columns), "table_name")
    parts = F.concat_ws(
        " ",
        F.when(F.col("duplicate_rows") > 0, HEALTH_DUPLICATES),
        F.when(F.size("gappy") > 0, HEALTH_MISSING),
        F.when(_identifier_heavy(), HEALTH_IDENTIFIERS),
    )
    return full.select("table_name", F.when(parts == "", HEALTH_STABLE).otherwise(parts).alias("data_health_assessment"))


def highlights(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_name, statistical_highlights): shape, role mix, up to three spread signals."""
    name = F.col("column")
    span = F.when(
        F.col("min").isNotNull() & F.col("max").isNotNull(),
        F.format_string(SPAN, name, decimal_text(F.col("min"), 3), decimal_text(F.col("max"), 3)),
    )
    deviation = F.when(F.col("std") > 0, F.format_string(DEVIATION, name, decimal_text(F.col("std"), 3)))
    signals = (
        columns.filter(F.col("role") == P.METRIC)
        .select("table_name", "ordinal", F.array_compact(F.array(span, deviation)).alias("signals"))
        .groupBy("table_name")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "signals"))).alias("by_column"))
        .select("table_name", F.slice(F.flatten(F.transform("by_column", lambda x: x["signals"])), 1, 3).alias("spread"))
    )
    full = tables.join(signals, "table_name", "left")
    spread = F.when(F.size("spread") > 0, F.col("spread")).otherwise(F.array(F.lit(NO_SPREAD)))
    lead = F.array(
        F.format_string(SHAPE, "total_rows", "total_columns"),
        F.format_string(
            ROLE_MIX, F.size("numeric_columns"), F.size("categorical_columns"), F.size("datetime_columns"), F.size("identifier_columns")
        ),
    )
    return full.select("table_name", F.slice(F.concat(lead, spread), 1, LIST_ITEMS).alias("statistical_highlights"))


def guidance(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Features and statistics worth a look; empty while a table still misses cells."""
    ready = columns.groupBy("table_name").agg((F.sum("n_missing") == 0).alias("ready"))
    metrics, dims, times = F.size("numeric_columns") > 0, F.size("categorical_columns") > 0, F.size("datetime_columns") > 0
    features = F.array_distinct(
        F.concat(F.slice("numeric_columns", 1, 6), F.slice("datetime_columns", 1, 2), F.slice("categorical_columns", 1, 4))
    )
    useful = F.array_compact(
        F.array(
            F.when(metrics, STATISTICS["distribution"]),
            F.when(metrics, STATISTICS["outliers"]),
            F.when(dims, STATISTICS["frequency"]),
            F.when(metrics & dims, STATISTICS["groups"]),
            F.when(times & metrics, STATISTICS["series"]),
        )
    )
    none = F.array().cast("array<string>")
    return tables.join(ready, "table_name").select(
        "table_name",
        F.when(F.col("ready"), F.slice(features, 1, 10)).otherwise(none).alias("important_features"),
        F.when(F.col("ready"), F.slice(useful, 1, 8)).otherwise(none).alias("useful_statistics"),
    )


def overview(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """First overview per table: quality flag, directions, anomaly signals, features."""
    gaps = _missing_facts(columns, OVERVIEW_MISSING, inclusive=True)
    full = tables.join(gaps, "table_name").join(domain_labels(tables).select("table_name", "domain_label"), "table_name")
    copies, gappy = F.col("duplicate_rows") > 0, F.size("gappy") > 0
    quality = F.coalesce(
        F.when(copies, F.format_string(OVERVIEW_DUPLICATES, "duplicate_rows")),
        F.when(gappy, F.format_string(OVERVIEW_HIGH_MISSING, F.size("gappy"), _names("gappy", NAMED_COLUMNS))),
        F.lit(OVERVIEW_CLEAN),
    )
    keys = F.when(F.size("potential_primary_keys") > 0, F.format_string(TRACKING, _names("potential_primary_keys", 3)))
    signals = F.array_compact(
        F.array(
            F.when(copies, SIGNAL_DUPLICATES),
            F.when(gappy, SIGNAL_MISSING),
            F.when(~copies & ~gappy & (F.col("total_rows") > 0), SIGNAL_NONE),
        )
    )
    summary = F.format_string(
        OVERVIEW_EXECUTIVE, F.lower("domain_label"), "total_rows", "total_columns",
        F.size("numeric_columns"), F.size("categorical_columns"), F.size("datetime_columns"),
    )
    return full.select(
        "table_name",
        summary.alias("executive_summary"),
        quality.alias("data_health_assessment"),
        F.array_compact(F.array(*[F.lit(d) for d in DIRECTIONS], keys)).alias("statistical_highlights"),
        signals.alias("anomaly_indicators"),
        F.concat(F.slice("numeric_columns", 1, 6), F.slice("categorical_columns", 1, 4)).alias("important_features"),
        F.array(*[F.lit(s) for s in OVERVIEW_STATISTICS]).alias("useful_statistics"),
        F.lit(OVERVIEW_CONFIDENCE).alias("confidence"),
    )


def summary_report(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """The full report, one row per table."""
    executive = F.format_string(
        EXECUTIVE, F.lower("domain_label"), "total_rows", "total_columns", F.size("numeric_columns"), F.size("datetime_columns")
    )
    base = tables.join(domain_labels(tables).select("table_name", "domain_label"), "table_name")
    return (
        base.select("table_name", executive.alias("executive_summary"))
        .join(health(columns, tables), "table_name")
        .join(highlights(columns, tables), "table_name")
        .join(anomaly_flags(columns, tables), "table_name")
        .join(guidance(columns, tables), "table_name")
        .withColumn("confidence", F.lit(SUMMARY_CONFIDENCE))
    )


# --- tables without a profile ----------------------------------------------------------

# What is said about a table that could not be profiled.
UNPROFILED_DOMAIN = {
    "domain_label": "Structured Dataset",
    "confidence": 0.25,
    "reasoning": "Insufficient profile context was available for domain inference fallback.",
    "suggested_kpis": ["Missing Data Rate", "Duplicate Row Rate"],
}
UNPROFILED_OVERVIEW = {
    "executive_summary": "Insufficient metadata for fallback overview.",
    "data_health_assessment": "Fallback executed without profile context.",
    "statistical_highlights": ["Load dataset and rerun profiling pipeline."],
    "anomaly_indicators": ["No anomaly assessment available."],
    "important_features": [],
    "useful_statistics": [],
    "confidence": 0.25,
}
UNPROFILED_SUMMARY = {
    "executive_summary": "Dataset summary unavailable because metadata context is missing.",
    "data_health_assessment": "Unable to assess data health without profile metadata.",
    "statistical_highlights": ["No statistical highlights available."],
    "anomaly_indicators": ["No anomaly indicators available."],
    "important_features": [],
    "useful_statistics": [],
    "confidence": 0.2,
}


def unprofiled(names: DataFrame, answer: Mapping[str, object]) -> DataFrame:
    """One of the answers above for every ``table_name``."""

    def fixed(v: object) -> Column:
        return F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)

    return names.select("table_name", *[fixed(v).alias(n) for n, v in answer.items()])


# --- rankings of columns ---------------------------------------------------------------


def variability(columns: DataFrame) -> DataFrame:
    """Metrics by coefficient of variation, with a band."""
    mean = F.abs("mean")
    score = F.when(F.col("std").isNotNull() & (mean > SMALLEST_MEAN), F.abs(F.col("std") / F.when(mean > SMALLEST_MEAN, F.col("mean"))))
    rows = metric_ranges(columns).withColumn("range", F.col("max") - F.col("min")).withColumn("score", score)
    band = (
        F.when(F.col("score").isNull(), BANDS[0])
        .when(F.col("score") >= HIGH_VARIABILITY, BANDS[1])
        .when(F.col("score") >= MODERATE_VARIABILITY, BANDS[2])
        .otherwise(BANDS[3])
    )
    ranked = rows.withColumn("position", _nth(F.coalesce("score", "std", F.lit(0.0)).desc(), "ordinal"))
    return ranked.select("table_name", "position", "column", "mean", "std", "min", "max", "range", "score", band.alias("band"))


def actionable(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Up to five suggestions per table: leading metrics, time axis, several metrics."""

    std, spread = (F.coalesce(fixed_text(F.col(n), 2), F.lit("N/A")) for n in ("std", "range"))
    score = F.coalesce("score", F.lit(0.0))
    name = F.col("column")

    def insight(key: Column, title: Column, signal: Column, action: Column, benefit: str) -> Column:
        return F.struct(
            key.alias("id"), title.alias("title"), signal.alias("signal"), action.alias("analysis_action"),
            F.lit(benefit).alias("business_impact"),
        )

    key = F.format_string("%s-%d", name, F.col("position") - 1)

    def metric(texts, *signal_args: Column) -> Column:
        return insight(
            key, F.format_string(texts[0], name), F.format_string(texts[1], name, *signal_args),
            F.format_string(texts[2], name), texts[3],
        )

    chosen = (
        F.when(score >= HIGH_VARIABILITY, metric(VOLATILITY, std, spread))
        .when(score >= MODERATE_VARIABILITY, metric(SEGMENTATION, std, spread))
        .otherwise(metric(BASELINE, std))
    )
    leading = variability(columns).filter(F.col("position") <= ACTIONABLE_METRICS)
    from_metrics = leading.select("table_name", F.col("position").alias("rank"), chosen.alias("i"))
    with_metrics = tables.filter(F.size("numeric_columns") > 0)
    axis = F.col("datetime_columns")[0]
    series = with_metrics.filter(F.size("datetime_columns") > 0).select(
        "table_name",
        F.lit(ACTIONABLE_METRICS + 1).alias("rank"),
        insight(
            F.lit("time-series-opportunity"), F.lit(TIME_SERIES[0]), F.format_string(TIME_SERIES[1], axis),
            F.format_string(TIME_SERIES[2], axis), TIME_SERIES[3],
        ).alias("i"),
    )
    several = with_metrics.filter(F.size("numeric_columns") >= CROSS_METRICS).select(
        "table_name",
        F.lit(ACTIONABLE_METRICS + 2).alias("rank"),
        insight(
            F.lit("cross-metric-driver"), F.lit(CROSS_METRIC[0]), F.format_string(CROSS_METRIC[1], F.size("numeric_columns")),
            F.lit(CROSS_METRIC[2]), CROSS_METRIC[3],
        ).alias("i"),
    )
    rows = from_metrics.unionByName(series).unionByName(several)
    ranked = rows.withColumn("position", _nth("rank"))
    return ranked.filter(F.col("position") <= ACTIONABLE_ROWS).select("table_name", "position", "i.*")


def high_signal_metrics(columns: DataFrame, limit: int = SIGNAL_METRICS) -> DataFrame:
    """Metrics with the largest standard deviation (else range)."""
    rows = metric_ranges(columns).withColumn("range", F.col("max") - F.col("min"))
    rows = rows.filter(F.col("std").isNotNull() | F.col("range").isNotNull())
    ranked = rows.withColumn("position", _nth(F.coalesce("std", "range").desc(), "ordinal"))
    return ranked.filter(F.col("position") <= limit).select("table_name", "position", "column", "std", "range")


def segment_dimensions(columns: DataFrame, limit: int = SEGMENT_COLUMNS) -> DataFrame:
    """First categorical columns with a handy number of levels."""
    dims = columns.filter(F.col("role").isin(P.CATEGORY, P.BOOLEAN) & F.col("n_distinct").between(*SEGMENT_LEVELS))
    ranked = dims.withColumn("position", _nth("ordinal"))
    return ranked.filter(F.col("position") <= limit).select("table_name", "position", "column", "n_distinct")


def worst_missing(columns: DataFrame, limit: int = WORST_COLUMNS) -> DataFrame:
    """Columns with the most missing cells and the length of their bar in percent."""
    gaps = columns.filter(F.col("missing_pct") > 0).withColumn("position", _nth(F.desc("missing_pct"), "ordinal"))
    kept = gaps.filter(F.col("position") <= limit)
    largest = F.greatest(F.max("missing_pct").over(Window.partitionBy("table_name")), F.lit(1.0))
    bar = F.greatest(100.0 * F.col("missing_pct") / largest, F.lit(LEAST_BAR))
    return kept.select("table_name", "position", "column", "missing_pct", bar.alias("bar"))

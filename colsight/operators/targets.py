"""Target selection, intent tagging of messages, and the list of features to test.

All of it works on column profiles or on message texts; profiles of many tables go
through the same job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.functions.exprs import c, free_name
from colsight.operators import profile as P

# Words that mark a likely target when they occur inside a column name.
TARGET_WORDS = (
    "status", "approved", "default", "churn", "label", "outcome",
    "revenue", "income", "score", "amount", "risk",
)
# Words that decide the intent of a message, tried in this order.
INTENT_WORDS = {
    "PREDICTIVE": ("predict", "forecast", "probability", "likely"),
    "EXPLANATORY": ("why", "reason", "driver", "cause", "influence"),
    "DIAGNOSTIC": ("compare", "difference", "segment", "breakdown"),
}
DEFAULT_INTENT = "DESCRIPTIVE"

# Names up to which a mention is tested name by name: a choice of plan, the result is the same.
SPELLED_OUT = 64
# Distinct values above which a number is a regression target; limits of
# the target suggestion.
REGRESSION_DISTINCT = 10
CLASS_LEVELS = (2, 6)
SPREAD_DISTINCT, SPREAD_SHARE = 20, 0.05


@dataclass(frozen=True)
class Limits:
    """Most candidates and features that are kept; None keeps all."""

    targets: int | None = None
    candidates: int | None = None
    numeric_classification: int | None = None
    numeric_regression: int | None = None
    categories: int | None = None
    fallback: int | None = None
    features: int | None = None


NO_LIMITS = Limits()
# The limits of a short report.
REPORT_LIMITS = Limits(
    targets=8, candidates=5, numeric_classification=8, numeric_regression=10, categories=8, fallback=6, features=20
)


def within(nth: Column, limit: int | None) -> Column:
    return F.lit(True) if limit is None else nth <= limit


def contains_any(col: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | col.contains(w)
    return hit


def target_types(profile: DataFrame) -> DataFrame:
    """(table_name, ordinal, column, target_type) for every profiled column."""
    many = (F.col("kind") == "number") & (F.col("n_distinct") > REGRESSION_DISTINCT)
    return profile.select(
        "table_name", "ordinal", "column", F.when(many, "regression").otherwise("classification").alias("target_type")
    )


def suggest_targets(profile: DataFrame, limit: int | None = None) -> DataFrame:
    """Likely target columns per table, in source order; at most ``limit`` of each."""
    present = F.col("n_rows") - F.col("n_missing")
    number = F.col("kind") == "number"
    levels = F.col("n_distinct")
    spread_floor = F.greatest(F.lit(SPREAD_DISTINCT), F.floor(F.lit(SPREAD_SHARE) * present))
    fits = (
        F.when(present == 0, False)
        .when(contains_any(F.lower("column"), TARGET_WORDS), True)
        .when(~number, levels.between(*CLASS_LEVELS))
        .when(levels <= REGRESSION_DISTINCT, True)
        .otherwise((F.col("number_std") > 0) & (levels >= spread_floor))
    )
    rank = F.row_number().over(Window.partitionBy("table_name").orderBy("ordinal"))
    kept = profile.filter(fits).select("table_name", "ordinal", "column", rank.alias("rank"))
    return kept.filter(within(F.col("rank"), limit))


def resolve_targets(profile: DataFrame, candidates: Sequence[str], limit: int | None = None) -> DataFrame:
    """Named candidates that exist, in the order given; without any, the suggestions.

    ``needs_choice`` is true when a table ends up with none or several.
    """
    wanted = F.array(*[F.lit(n) for n in candidates]) if candidates else F.array().cast("array<string>")
    position = F.array_position(wanted, F.col("column"))
    explicit = profile.filter(position > 0).select(
        "table_name", "column", position.cast("int").alias("rank"), F.lit("explicit").alias("source")
    )
    suggested = suggest_targets(profile, limit).select("table_name", "column", "rank", F.lit("suggested").alias("source"))
    both = explicit.unionByName(suggested)
    by_table = Window.partitionBy("table_name")
    named = F.max(F.col("source") == "explicit").over(by_table)
    kept = both.withColumn("named", named).filter((F.col("source") == "explicit") | ~F.col("named")).drop("named")
    return kept.withColumn("needs_choice", F.count(F.lit(1)).over(by_table) != 1)


def intent_of(message: Column) -> Column:
    return _intent(F.lower(message))


def _intent(low: Column) -> Column:
    out = None
    for intent, words in INTENT_WORDS.items():
        test = contains_any(low, words)
        out = F.when(test, intent) if out is None else out.when(test, intent)
    return out.otherwise(DEFAULT_INTENT)


def intent_tags(messages: DataFrame, text_column: str = "text") -> DataFrame:
    """Messages with their intent."""
    lowered, low = _lowered(messages, text_column)
    return lowered.withColumn("intent_type", _intent(c(low))).drop(low)


def _lowered(messages: DataFrame, text_column: str) -> tuple[DataFrame, str]:
    """Add the lower-case text as a column, so that it is made once and not for every word; also its name."""
    low = free_name(messages.columns, "_low")
    return messages.withColumn(low, F.lower(c(text_column))), low


def mentioned(message: Column, names: Sequence[str], spelled_out: int = SPELLED_OUT) -> Column:
    """Array of the column names that occur in a message, case ignored, in the order of ``names``.

    A few names are tested one by one inside the generated code. More of them, as of a whole
    catalog, become one automaton per task that finds all in a single pass over the message,
    and the plan holds one expression however many there are.
    """
    return _mentioned(F.lower(message), names, spelled_out)


def _mentioned(low: Column, names: Sequence[str], spelled_out: int = SPELLED_OUT) -> Column:
    if len(names) > spelled_out:
        return _scanner(names)(low)
    return F.array_compact(F.array(*[F.when(low.contains(n.lower()), F.lit(n)) for n in names]))


def _scanner(names: Sequence[str]) -> Callable[[Column], Column]:
    """Function from lower-case texts to the names that occur in them; nulls hold none."""
    names = list(names)

    @F.pandas_udf("array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        places: dict[str, list[int]] = {}
        for i, n in enumerate(names):
            places.setdefault(n.lower(), []).append(i)
        always = places.pop("", [])
        automaton = ahocorasick.Automaton()
        for low, found in places.items():
            automaton.add_word(low, found)
        if places:
            automaton.make_automaton()

        def occurring(message: str | None) -> list[str]:
            if message is None:
                return []
            hits = set(always)
            if places:
                for _, found in automaton.iter(message):
                    hits.update(found)
            return [names[i] for i in sorted(hits)]

        for batch in batches:
            yield batch.map(occurring)

    return scan


def column_mentions(messages: DataFrame, names: Sequence[str], text_column: str = "text") -> DataFrame:
    """One row per message and mentioned column. The names are schema metadata, so a
    message is matched where it lies and nothing is joined."""
    lowered, low = _lowered(messages, text_column)
    return lowered.withColumn("column", F.explode(_mentioned(c(low), names))).drop(low)


def hinted_names(names: Sequence[str], limit: int | None = None) -> list[str]:
    return [n for n in names if any(w in n.lower() for w in TARGET_WORDS)][:limit]


def hinted_columns(messages: DataFrame, names: Sequence[str], text_column: str = "text", limit: int | None = None) -> DataFrame:
    """For messages that mention no column: the columns whose names suggest a target."""
    lowered, low = _lowered(messages, text_column)
    silent = lowered.filter(F.size(_mentioned(c(low), names)) == 0).drop(low)
    hints = F.array(*[F.lit(n) for n in hinted_names(names, limit)]).cast("array<string>")
    return silent.withColumn("column", F.explode(hints))


def parse_messages(messages: DataFrame, names: Sequence[str] | None, text_column: str = "text", limit: int | None = None) -> DataFrame:
    """Intent and target candidates of every message; at most ``limit`` candidates. Without
    column names nothing can be told: every message is diagnostic and has no candidate."""
    if names is None:
        none = F.array().cast("array<string>")
        return messages.withColumn("intent_type", F.lit("DIAGNOSTIC")).withColumn("target_candidates", none)
    found = mentioned(c(text_column), names)
    hints = F.array(*[F.lit(n) for n in hinted_names(names, limit)]).cast("array<string>")
    candidates = F.when(F.size(found) > 0, F.slice(found, 1, limit or max(1, len(names)))).otherwise(hints)
    return intent_tags(messages, text_column).withColumn("target_candidates", candidates)


def hypotheses(profile: DataFrame, targets: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """Features to test per (table_name, target, target_type), in order.

    Numeric metrics first, then categories, booleans and texts, each up to its limit if there
    is one; a target without any gets its other columns whatever their role.
    """
    role = F.col("role")
    group = F.when(role == P.METRIC, 1).when(role.isin(P.CATEGORY, P.BOOLEAN, P.TEXT), 2).otherwise(3)
    pairs = (
        targets.join(profile.select("table_name", "ordinal", "column", "role"), "table_name")
        .filter(F.col("column") != F.col("target"))
        .withColumn("kind_rank", group)
    )
    by_target = Window.partitionBy("table_name", "target")
    pairs = (
        pairs.withColumn("nth", F.row_number().over(Window.partitionBy("table_name", "target", "kind_rank").orderBy("ordinal")))
        .withColumn("nth_any", F.row_number().over(by_target.orderBy("ordinal")))
        .withColumn("testable", F.max(F.col("kind_rank") < 3).over(by_target))
    )
    classify = F.col("target_type") == "classification"
    nth = F.col("nth")
    numeric = F.when(classify, within(nth, limits.numeric_classification)).otherwise(within(nth, limits.numeric_regression))
    keep = F.when(
        F.col("testable"),
        ((F.col("kind_rank") == 1) & numeric) | ((F.col("kind_rank") == 2) & within(nth, limits.categories)),
    ).otherwise(within(F.col("nth_any"), limits.fallback))
    signal = F.when(classify, "classification_signal").otherwise("correlation")
    feature, target = F.col("column"), F.col("target")
    # Descriptions of the four kinds of test and of the fallback.
    description = (
        F.when(~F.col("testable"), F.format_string("%s may influence %s and should be statistically tested.", feature, target))
        .when(
            (F.col("kind_rank") == 1) & classify,
            F.format_string("Variation in %s is associated with class shifts in %s.", feature, target),
        )
        .when(F.col("kind_rank") == 1, F.format_string("%s has measurable correlation with %s.", feature, target))
        .when(classify, F.format_string("Category membership in %s changes class distribution of %s.", feature, target))
        .otherwise(F.format_string("Mean %s differs across groups in %s.", target, feature))
    )
    position = F.when(F.col("testable"), F.col("kind_rank") * 1_000_000 + F.col("nth")).otherwise(F.col("nth_any"))
    order = F.row_number().over(by_target.orderBy("position"))
    return (
        pairs.filter(keep)
        .withColumn("position", position)
        .select(
            "table_name",
            "target",
            "target_type",
            order.alias("ordinal"),
            feature.alias("feature"),
            F.when(F.col("testable") & (F.col("kind_rank") == 2), "group_difference").otherwise(signal).alias("type"),
            description.alias("description"),
        )
        .filter(within(F.col("ordinal"), limits.features))
    )

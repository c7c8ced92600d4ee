"""Driver ranking and the answer built from it. Works on result tables, one row per
(target, feature), for any number of targets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.functions.exprs import exact_round, fixed_text, share

# Fixed texts of an answer without drivers, and its confidence.
NO_DRIVERS = {
    "direct_answer": "The system could not identify strong evidence-based drivers from the current dataset and target setup.",
    "key_drivers_summary": "No ranked drivers were produced.",
    "evidence_points": "Insufficient statistical results after validation filters.",
    "business_impact": "Decision confidence remains low until stronger statistical signals are available.",
    "recommended_next_step": "Confirm target variable quality and increase usable sample size.",
}
NO_DRIVERS_CONFIDENCE = 0.32
# Sentences of an answer with drivers; confidence stays within these limits.
DIRECT_ANSWER = (
    "The strongest driver for %s is %s, "
    "supported by the highest combined statistical and model-based score (%s)."
)
KEY_DRIVERS = (
    "Top drivers are %s. "
    "These variables consistently rank high across significance and predictive contribution."
)
BUSINESS_IMPACT = (
    "Prioritizing interventions on the top-ranked drivers is likely to create the fastest measurable movement in the target outcome."
)
NEXT_STEP = "Validate the effect of %s on %s across key segments before operational rollout."
CONFIDENCE_RANGE = (0.45, 0.95)
EVIDENCE_DRIVERS = 3
IMPACT_ROWS = 10


def significance_score(p: Column) -> Column:
    # Score per p-value step, 0.4 without one.
    return (
        F.when(p.isNull(), 0.4)
        .when(p <= 0.001, 1.0)
        .when(p <= 0.01, 0.9)
        .when(p <= 0.05, 0.75)
        .when(p <= 0.1, 0.55)
        .otherwise(0.25)
    )


def significance_label(p: Column) -> Column:
    # Label per p-value step.
    return F.when(p.isNull(), "No p-value").when(p <= 0.01, "Strong").when(p <= 0.05, "Moderate").otherwise("Weak")


def explanation_hint(importance: Column, correlation: Column, effect: Column) -> Column:
    # Hint texts, first match wins.
    return (
        F.when(importance > 0.2, "High model contribution")
        .when(F.abs(correlation) > 0.4, "Meaningful directional relationship")
        .when(F.abs(effect) > 0.3, "Material segment effect")
        .otherwise("Signal present but moderate")
    )


def raw_strength() -> Column:
    # Weights of significance, effect, correlation and importance.
    return (
        0.35 * significance_score(F.col("p_value"))
        + 0.25 * share(F.col("effect_size"))
        + 0.2 * share(F.col("correlation"))
        + 0.2 * share(F.col("feature_importance"))
    )


def rank_drivers(results: DataFrame) -> DataFrame:
    """Ranked drivers per target; ties keep the order of the hypotheses."""
    by_target = Window.partitionBy("target")
    top = F.max("raw").over(by_target)
    scored = results.withColumn("raw", raw_strength())
    return scored.select(
        "target",
        "target_type",
        "feature",
        exact_round(F.col("raw") / F.when(top == 0, 1.0).otherwise(top), 4).alias("strength_score"),
        F.row_number().over(by_target.orderBy(F.desc("raw"), "ordinal")).alias("importance_rank"),
        significance_label(F.col("p_value")).alias("statistical_significance"),
        explanation_hint(F.col("feature_importance"), F.col("correlation"), F.col("effect_size")).alias("explanation_hint"),
        "p_value",
        "effect_size",
        "feature_importance",
        "correlation",
    )


def evidence_points(ranking: DataFrame, top: int = EVIDENCE_DRIVERS) -> DataFrame:
    """One sentence per leading driver; parts without a value are left out."""

    def part(label: str, name: str, digits: int) -> Column:
        return F.when(F.col(name).isNotNull(), F.format_string(f"{label}=%s", fixed_text(F.col(name), digits)))

    # Parts of an evidence sentence.
    sentence = F.concat_ws(
        ", ",
        F.format_string("%s (strength %s)", F.col("feature"), fixed_text(F.col("strength_score"), 2)),
        part("p", "p_value", 4),
        part("effect", "effect_size", 3),
        part("importance", "feature_importance", 3),
    )
    kept = ranking.filter(F.col("importance_rank") <= top)
    return kept.select("target", "target_type", "importance_rank", "feature", "strength_score", sentence.alias("evidence"))


def answers(ranking: DataFrame, targets: DataFrame) -> DataFrame:
    """One answer row per (target, target_type) in ``targets``."""
    ordered = F.array_sort(F.collect_list(F.struct("importance_rank", "feature", "strength_score", "evidence")))
    top = evidence_points(ranking).groupBy("target").agg(ordered.alias("top"))
    full = targets.select("target", "target_type").join(top, "target", "left")
    lead, strength = F.col("top")[0]["feature"], F.col("top")[0]["strength_score"]
    found = F.col("top").isNotNull()
    names = F.array_join(F.transform("top", lambda d: d["feature"]), ", ")
    low, high = CONFIDENCE_RANGE

    def text(sentence: Column, key: str) -> Column:
        return F.when(found, sentence).otherwise(NO_DRIVERS[key]).alias(key)

    return full.select(
        "target",
        "target_type",
        text(F.format_string(DIRECT_ANSWER, F.col("target"), lead, fixed_text(strength, 2)), "direct_answer"),
        text(F.format_string(KEY_DRIVERS, names), "key_drivers_summary"),
        F.when(found, F.transform("top", lambda d: d["evidence"]))
        .otherwise(F.array(F.lit(NO_DRIVERS["evidence_points"])))
        .alias("evidence_points"),
        text(F.lit(BUSINESS_IMPACT), "business_impact"),
        F.when(found, F.greatest(F.lit(low), F.least(F.lit(high), strength))).otherwise(NO_DRIVERS_CONFIDENCE).alias("confidence_score"),
        text(F.format_string(NEXT_STEP, lead, F.col("target")), "recommended_next_step"),
    )


def impact(results: DataFrame, limit: int = IMPACT_ROWS) -> DataFrame:
    """Impact per feature and its share of the largest one, leading rows per target."""
    # Weights of significance, effect and importance; floor of the scale.
    certainty = F.when(F.col("p_value").isNotNull(), F.greatest(F.lit(0.0), 1 - F.least(F.col("p_value"), F.lit(1.0)))).otherwise(0.0)
    value = F.round(
        0.4 * certainty
        + 0.35 * F.coalesce(F.abs("effect_size"), F.lit(0.0))
        + 0.25 * F.coalesce(F.abs("feature_importance"), F.lit(0.0)),
        4,
    )
    by_target = Window.partitionBy("target")
    scored = results.withColumn("impact", value)
    largest = F.greatest(F.max("impact").over(by_target), F.lit(0.0001))
    ranked = scored.select(
        "target",
        "feature",
        "impact",
        (F.col("impact") / largest).alias("share_of_top"),
        F.row_number().over(by_target.orderBy("ordinal")).alias("position"),
    )
    return ranked.filter(F.col("position") <= limit)

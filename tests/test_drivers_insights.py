import pytest
from pyspark.sql import functions as F

from colsight.operators import drivers, insights, stats, targets
from colsight.operators import profile as P

RESULTS = "target string, target_type string, feature string, ordinal int, p_value double, effect_size double, correlation double, feature_importance double"


def results(spark, rows):
    return spark.createDataFrame([("t", "regression", f, i, p, e, c, m) for i, (f, p, e, c, m) in enumerate(rows)], RESULTS)


def test_significance_steps(spark):
    df = spark.createDataFrame([(None,), (0.001,), (0.01,), (0.05,), (0.1,), (0.2,)], "p double")
    got = df.select(drivers.significance_score(F.col("p")), drivers.significance_label(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [
        (0.4, "No p-value"), (1.0, "Strong"), (0.9, "Strong"), (0.75, "Moderate"), (0.55, "Weak"), (0.25, "Weak"),
    ]


def test_ranking_answer_and_ties(spark):
    df = results(spark, [("a", 0.0005, -0.5, None, 0.3), ("b", None, None, -0.5, None), ("c", None, None, -0.5, None), ("d", 0.5, 2.0, None, None)])
    rows = drivers.rank_drivers(df).orderBy("importance_rank").collect()
    assert [r["feature"] for r in rows] == ["a", "d", "b", "c"]
    raw_a, raw_b = 0.35 + 0.125 + 0.06, 0.35 * 0.4 + 0.1
    assert rows[0]["strength_score"] == 1.0 and rows[2]["strength_score"] == pytest.approx(round(raw_b / raw_a, 4))
    assert [r["explanation_hint"] for r in rows] == [
        "High model contribution", "Material segment effect", "Meaningful directional relationship", "Meaningful directional relationship",
    ]
    wanted = spark.createDataFrame([("t", "regression"), ("empty", "classification")], "target string, target_type string")
    answers = {r["target"]: r for r in drivers.answers(drivers.rank_drivers(df), wanted).collect()}
    assert answers["t"]["evidence_points"][0] == "a (strength 1.00), p=0.0005, effect=-0.500, importance=0.300"
    assert answers["t"]["evidence_points"][2].startswith("b (strength 0.45)") and answers["t"]["confidence_score"] == 0.95
    assert answers["empty"]["confidence_score"] == 0.32 and answers["empty"]["key_drivers_summary"] == "No ranked drivers were produced."


def test_confidence_and_impact(spark):
    df = results(spark, [("a", 0.2, -3.0, 0.5, None), ("b", None, None, None, None)])
    got = {r["feature"]: r["confidence_score"] for r in stats.with_confidence(df).collect()}
    assert got == {"a": pytest.approx(0.35 * 0.8 + 0.25 + 0.1), "b": 0.0}
    imp = {r["feature"]: (r["impact"], r["share_of_top"]) for r in drivers.impact(df).collect()}
    assert imp["a"] == (pytest.approx(0.4 * 0.8 + 0.35 * 3), 1.0) and imp["b"] == (0.0, 0.0)


def test_messages(spark):
    names = ["churn", "Revenue", "region"]
    df = spark.createDataFrame([("Why did churn rise?",), ("Forecast revenue",), ("compare regions",), ("hello",)], "text string")
    got = {r["text"]: (r["intent_type"], r["target_candidates"]) for r in targets.parse_messages(df, names).collect()}
    assert got["Why did churn rise?"] == ("EXPLANATORY", ["churn"])
    assert got["Forecast revenue"] == ("PREDICTIVE", ["Revenue"])
    assert got["compare regions"] == ("DIAGNOSTIC", ["region"])
    assert got["hello"] == ("DESCRIPTIVE", ["churn", "Revenue"])
    blind = targets.parse_messages(df, None).select("intent_type", "target_candidates").distinct().collect()
    assert [tuple(r) for r in blind] == [("DIAGNOSTIC", [])]


def test_target_suggestions_and_hypotheses(spark):
    rows = [(i, i % 2, f"s{i % 4}", float(i % 40), 1.0 * i + 0.5, f"n{i % 70}") for i in range(200)]
    df = spark.createDataFrame(rows, "row_key int, churn int, cat string, span double, unique_value double, note string")
    profile = P.column_profile(df)
    assert [r["column"] for r in targets.suggest_targets(profile).orderBy("rank").collect()] == ["row_key", "churn", "cat", "span", "unique_value"]
    wanted = spark.createDataFrame([("table", "churn", "classification"), ("table", "span", "regression")], "table_name string, target string, target_type string")
    got = [(r["target"], r["feature"], r["type"]) for r in targets.hypotheses(profile, wanted).orderBy("target", "ordinal").collect()]
    assert got == [
        ("churn", "span", "classification_signal"), ("churn", "cat", "group_difference"), ("churn", "note", "group_difference"),
        ("span", "churn", "group_difference"), ("span", "cat", "group_difference"), ("span", "note", "group_difference"),
    ]
    types = {r["column"]: r["target_type"] for r in targets.target_types(profile).collect()}
    assert types["churn"] == "classification" and types["span"] == "regression" and types["note"] == "classification"


def test_insight_tables(spark):
    rows = [(i, float(i % 15), None if i % 4 == 0 else "x") for i in range(60)]
    df = spark.createDataFrame(rows, "k int, m double, s string")
    columns, tables = P.profile_catalog({"t": df, "ids": spark.range(4).withColumnRenamed("id", "a_key")})
    labels = {r["table_name"]: r["domain_label"] for r in insights.domain_labels(tables).collect()}
    assert labels == {"t": "Business Metrics Dataset", "ids": "Reference or Lookup Dataset"}
    flags = {r["table_name"]: r["anomaly_indicators"] for r in insights.anomaly_flags(columns, tables).collect()}
    assert flags["t"] == ["Missingness above 10% in 1 columns: s.", "Highest missingness is 25.0% in column 's'."]
    assert flags["ids"] == [insights.NO_FLAG]
    notes = {r["table_name"]: r["statistical_highlights"] for r in insights.highlights(columns, tables).collect()}
    assert notes["t"][2] == "m spans from 0.0 to 14.0." and notes["ids"][2] == insights.NO_SPREAD
    health = {r["table_name"]: r["data_health_assessment"] for r in insights.health(columns, tables).collect()}
    # One identifier among three columns is "identifier-heavy": the floor of half of three is one.
    assert health["t"] == f"{insights.HEALTH_MISSING} {insights.HEALTH_IDENTIFIERS}" and health["ids"] == insights.HEALTH_IDENTIFIERS
    guide = {r["table_name"]: r["important_features"] for r in insights.guidance(columns, tables).collect()}
    assert guide == {"t": [], "ids": []}
    bars = insights.worst_missing(columns).first()
    assert bars["column"] == "s" and bars["bar"] == 100.0
    act = insights.actionable(columns, tables).orderBy("position").first()
    assert act["title"] == "m: Volatility Driver" or act["title"] == "m: Segmentation Signal"

import random

from colsight.operators import targets


def brute(text, names):
    return [n for n in names if text is not None and n.lower() in text.lower()]


def test_automaton_finds_what_single_tests_find(spark):
    rnd = random.Random(3)
    names = ["a", "ab", "b", "Bab", "abab", "ÄB", "x y", "ab", "", "o_id", "zz"]
    texts = ["".join(rnd.choice("abÄB xy") for _ in range(rnd.randint(0, 14))) for _ in range(300)] + [None, "", "O_ID and o_id", "ÄBab " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    for spelled_out in (0, 100):
        got = df.select("id", targets.mentioned(df["text"], names, spelled_out).alias("found")).collect()
        assert {r["id"]: r["found"] for r in got} == {i: brute(t, names) for i, t in enumerate(texts)}


def test_catalog_of_fifty_thousand_names_in_one_pass(spark):
    names = [f"col_{i:05d}" for i in range(50_000)]
    rows = [(1, "sum Col_00017 by col_49999"), (2, "nothing"), (3, None), (4, "col_1234")]
    df = spark.createDataFrame(rows, "id int, text string")
    found = targets.column_mentions(df, names)
    assert sorted((r["id"], r["column"]) for r in found.collect()) == [(1, "col_00017"), (1, "col_49999")]
    few = targets.column_mentions(df, names[:100])
    assert len(found._jdf.queryExecution().toString()) < 2 * len(few._jdf.queryExecution().toString())
    parsed = {r["id"]: r["target_candidates"] for r in targets.parse_messages(df, names, limit=1).collect()}
    assert parsed == {1: ["col_00017"], 2: [], 3: [], 4: []}


def test_names_only_empty(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, text string")
    got = df.select("id", targets.mentioned(df["text"], ["", ""], 0).alias("found")).collect()
    assert {r["id"]: r["found"] for r in got} == {1: ["", ""], 2: []}


def test_helper_column_keeps_clear_of_names(spark):
    df = spark.createDataFrame([("why a drop", 5)], "text string, _low int")
    assert targets.intent_tags(df).collect()[0].asDict() == {"text": "why a drop", "_low": 5, "intent_type": "EXPLANATORY"}
    assert targets.column_mentions(df, ["DROP"]).collect()[0].asDict() == {"text": "why a drop", "_low": 5, "column": "DROP"}

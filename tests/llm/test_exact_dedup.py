import hashlib

from colsight.llm.exact_dedup import exact_dedup, op7_exact_dedup

SCHEMA = "doc_id bigint, text string, digest string, keep_id string"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark, sf_dir, documents):
    got = sorted((tuple(r) for r in op7_exact_dedup(spark, sf_dir).collect()), key=str)
    assert got == brute([r[:2] for r in documents])
    assert any(not r[3] for r in got)


def test_frequent_texts_nulls_and_repeats(spark):
    rows = [(i, "hot" if i % 3 else f"own {i}") for i in range(300)] + [(1, "hot"), (None, "hot"), (None, "alone")]
    rows += [(400, None), (401, ""), (402, "x" * 100_000), (403, "x" * 100_000)]
    df = spark.createDataFrame([(*r, "d", "k") for r in rows], SCHEMA)
    for support in (0.01, 0.9):
        got = sorted((tuple(r) for r in exact_dedup(df, support).collect()), key=str)
        assert got == brute(rows)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0

import hashlib
import re

from pyspark.sql import functions as F

from colsight.llm import shared
from colsight.llm.substring_dedup import op2_substring_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, pack string, keys int"


def brute(rows, window):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_equals_brute_force(spark, sf_dir, documents):
    got = sorted(tuple(r) for r in op2_substring_dedup(spark, sf_dir).collect())
    want = [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute([r[:2] for r in documents], 13)]
    assert got == want
    assert sum(r[2] for r in got) > 0


def test_edges(spark):
    long = " ".join(f"w{i % 97}x{i}" for i in range(3000))
    rows = [
        (1, "a b c d e f", "x", "p", 1),
        (2, "z a b c d e y", None, None, None),
        (3, "", "x", "p", 1),
        (4, None, "x", "p", 1),
        (5, "a\tb\nc d  q " + "é" * 300 + " r", "x", "p", 1),
        (6, long, "x", "p", 1),
        (7, "start " + long, "x", "p", 1),
        (8, "one two three one two three one two three", "x", "p", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = substring_dedup(df, 4).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out] == brute([r[:2] for r in rows], 4)
    assert [(x.start, x.stop) for x in out[6].removed] == [(1, 3001)]
    assert out[7].n_removed == 0  # a document does not repeat itself


def test_empty_and_missing_ids(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e", None, None, None), (9, "a b c d e", None, None, None), (None, "a b c d e", None, None, None)]
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), 3).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == [(9, 0), (None, 5), (None, 5)]


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e", None, None, None)] * 3, SCHEMA)
    assert [r.n_removed for r in substring_dedup(df, 3).collect()] == [0, 0, 0]
    assert substring_dedup(df.withColumn("text", F.lit(None).cast("string"))).count() == 3


def test_ranges_grow_with_the_corpus(spark):
    assert shared.hash_ranges(spark.range(60)) == 60 // shared.PACKS_PER_RANGE
    assert shared.hash_ranges(spark.range(1)) == shared.partitions(spark)

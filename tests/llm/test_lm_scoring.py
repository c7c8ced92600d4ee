import math
import re
from collections import Counter

from colsight.llm.lm_scoring import op4_lm_scoring, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, wanted int, pack string, quality int"


def brute(rows, target):
    split = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in rows]
    models = []
    for chosen in (target, None):
        mine = [w for i, w in split if chosen is None or i in chosen]
        models.append((Counter(x for w in mine for x in w), Counter(p for w in mine for p in zip(w, w[1:]))))
    vocabulary = len({x for _, w in split for x in w})
    out = []
    for i, w in split:
        losses = []
        for one, two in models:
            total, loss = sum(one.values()), 0.0
            for k, x in enumerate(w):
                p = (one[x] + 1) / (total + vocabulary)
                if k:
                    p = (two[w[k - 1], x] + p) / (one[w[k - 1]] + 1)
                loss -= math.log(p)
            losses.append(loss / len(w) if w else None)
        out.append((i, len(w), *losses, losses[1] - losses[0] if w else None))
    return out


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert a[:2] == b[:2]
        assert all((x is None and y is None) or math.isclose(x, y, abs_tol=1e-5) for x, y in zip(a[2:], b[2:])), (a, b)


def test_equals_brute_force(spark, sf_dir, documents, con):
    target = {r[0] for r in con.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    want = [(r[0], r[1], r[4]) for r in brute([d[:2] for d in documents], target)]
    same([tuple(r) for r in op4_lm_scoring(spark, sf_dir).collect()], want)


def test_edges(spark):
    rows = [(1, "The cat sat"), (2, "the dog sat on the cat"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(5000))), (2, "again"), (None, "the end")]
    df = spark.createDataFrame([(*r, 1, "p", 0) for r in rows], SCHEMA)
    named = spark.createDataFrame([(1,), (1,), (2,), (99,), (None,)], "doc_id bigint")
    same([tuple(r) for r in score(df, named).collect()], brute(rows, {1, 2}))
    same([tuple(r) for r in score(df, named.limit(0)).collect()], brute(rows, set()))
    assert score(df.limit(0), named).count() == 0
    assert score(df.filter("doc_id = 4"), named).first().score is None

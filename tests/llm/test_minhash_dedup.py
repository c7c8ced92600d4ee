import random
import re

import pytest

from colsight.llm import minhash_dedup
from colsight.llm.minhash_dedup import components, near_dedup, needed, op1_minhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, n int, sketch string, id string, digest string"


def brute(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in where[g] if j > i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def run(df, **options):
    return sorted(tuple(r) for r in near_dedup(df, **options).collect())


def test_equals_brute_force(spark, sf_dir, documents):
    want = brute([r[:2] for r in documents], 4)
    assert sorted(tuple(r) for r in op1_minhash_dedup(spark, sf_dir).collect()) == want
    assert any(not r[3] for r in want)


@pytest.mark.parametrize("weight", [minhash_dedup.BLOCK_WEIGHT, 2000])
def test_group_of_near_copies(spark, monkeypatch, weight):
    """A large group in one block, and the same cut into many."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_WEIGHT", weight)
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(30)]
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 7, 12])):
            words[rng.randrange(len(words))] = f"e{rng.random()}"
        rows.append((i, " ".join(words[: rng.choice([120, 110, 95])])))
    rows += [(1000 + i, " ".join(passage + [f"o{i}x{k}" for k in range(60)])) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "s", "i", "d") for r in rows], SCHEMA)
    assert run(df, shingle=3) == brute(rows, 3)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c d e f"), (7, "a b c d e f"), (8, long), (9, long + " end"), (10, "x" * 50_000)]
    rows += [(11, "same text of a few words here")] * 3
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    want = brute(rows, 5)
    got = run(df)
    assert [r for r in got if r[0] != 11] == [r for r in want if r[0] != 11]
    assert [r for r in got if r[0] == 11] == [(11, 3, 11, True)] * 3
    none = spark.createDataFrame([(None, "a b c d e f", 1, "", "", ""), (12, "a b c d e f", 1, "", "", "")], SCHEMA)
    assert {tuple(r) for r in near_dedup(none).collect()} == {(None, 2, 12, False), (12, 2, 12, True)}
    assert near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "id bigint, root bigint")
    got = {r.id: r.component for r in components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_needed_overlap():
    assert 20 <= needed(80) <= 30

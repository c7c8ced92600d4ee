import random

import numpy as np

from colsight.llm import decontamination as dec

SCHEMA = "doc_id bigint, text string, row string, matches string, item_id int"


def distance(item, text):
    """Smallest edit distance of item to any part of text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_best_match():
    rng = random.Random(1)
    for _ in range(200):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 9))]
        text = [rng.randrange(6) for _ in range(rng.randrange(0, 15))]
        cost, a, b = dec.best_match(np.array(item), np.array(text, np.int64))
        assert cost == distance(item, text)
        assert 0 <= a <= b <= len(text)


def planted(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[k] = f"new{rng.randrange(1000)}"
        elif kind == 1:
            words.insert(k, f"more{rng.randrange(1000)}")
        else:
            del words[k]
    return words


def test_recall_and_precision(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    items = {i: rng.choices(vocabulary, k=rng.randrange(15, 60)) for i in range(40)}
    rows, truth = [], {}
    for d in range(400):
        text = rng.choices(vocabulary, k=rng.randrange(0, 150))
        if d % 2:
            i = rng.choice(list(items))
            edits = rng.randrange(0, int(0.15 * len(items[i])) + 1)
            at = rng.randrange(len(text) + 1)
            text = text[:at] + planted(rng, items[i], edits) + text[at:]
            truth[d] = i
        rows.append((d, " ".join(text).upper() + "."))
    df = spark.createDataFrame([(*r, "r", "m", 1) for r in rows], SCHEMA)
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in items.items()] + [(None, None), (99, "too short")], "item_id bigint, text string")
    want = {
        (d, i) for d, t in rows for i, w in items.items()
        if distance(w, t.lower().rstrip(".").split()) <= int(dec.EDITS * len(w))
    }
    for size in (dec.BLOCK_BYTES, 4000):
        monkeypatch.setattr(dec, "BLOCK_BYTES", size)
        got = {(r.row.doc_id, m.item_id) for r in dec.contaminated(df, bench).collect() for m in r.matches}
        assert got <= want
        assert len(got) >= 0.97 * len(want) and set(truth.items()) & want == set(truth.items())


def test_exact_passages_of_the_benchmark(spark, sf_dir, documents, con):
    items = dict(con.execute("SELECT item_id, text FROM benchmark").fetchall())
    got = {r.doc_id: set(r.item_ids) for r in dec.op6_decontamination(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for i, text, _ in documents:
        assert got[i] >= {k for k, t in items.items() if text and t in text and len(t.split()) >= dec.LEAST_WORDS}
    assert sum(map(bool, got.values())) < len(got) / 4


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, item), (2, "x " * 50_000 + item), (3, None), (4, ""), (None, item), (1, item), (5, item.replace("eta", "eat"))]
    df = spark.createDataFrame([(*r, "r", "m", 1) for r in rows], SCHEMA)
    bench = spark.createDataFrame([(7, item), (None, item)], "item_id bigint, text string")
    out = {(r.row.doc_id, r.row.text and len(r.row.text)): r.matches for r in dec.contaminated(df, bench).collect()}
    assert [m.edits for m in out[1, len(item)]] == [0, 0]
    (start,) = {(m.start, m.stop) for m in out[2, 100_000 + len(item)]}
    assert start == (50_000, 50_012)
    assert not out[3, None] and not out[4, ""] and len(out) == 6
    assert {m.item_id for m in out[None, len(item)]} == {7, None}
    assert dec.contaminated(df, bench.limit(0)).filter("size(matches) > 0").count() == 0
    assert dec.contaminated(df.limit(0), bench).count() == 0


def test_recall_by_length_and_edits(spark):
    rng = random.Random(17)
    vocabulary = [f"v{i}" for i in range(2000)]
    items, rows, want = {}, [], {}
    for n in (8, 10, 12, 14, 15, 16, 17, 18, 20, 24, 31, 32, 40):
        for edits in range(int(dec.EDITS * n) + 1):
            for _ in range(12):
                i = len(items)
                items[i] = rng.sample(vocabulary, n)
                text = rng.choices(vocabulary, k=20) + planted(rng, items[i], edits) + rng.choices(vocabulary, k=rng.randrange(20))
                assert distance(items[i], text) <= edits
                rows.append((i, " ".join(text), "r", "m", 1))
                want.setdefault((n, edits), set()).add(i)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    out = dec.contaminated(spark.createDataFrame(rows, SCHEMA), bench).collect()
    got = {r.row.doc_id for r in out if r.row.doc_id in {m.item_id for m in r.matches}}
    for (n, edits), ids in want.items():
        assert len(ids & got) >= (len(ids) if n < dec.SEEDED else 11), (n, edits)


def test_short_items_stand_unchanged(spark):
    texts = ["say alpha beta gamma now", "alpha beta more gamma", "one", "", "Gamma? one, two!", "one " * 3000]
    df = spark.createDataFrame([(i, t, "r", "m", 1) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(1, "Alpha, beta gamma."), (2, "one"), (3, "?!"), (4, "a b c d e f g"), (5, "")], "item_id bigint, text string")
    got = {r.row.doc_id: [(m.item_id, m.edits) for m in r.matches] for r in dec.contaminated(df, bench).collect()}
    assert got == {0: [(1, 0)], 1: [], 2: [(2, 0)], 3: [], 4: [(2, 0)], 5: [(2, 0)]}

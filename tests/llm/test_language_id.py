import math
import zlib

import numpy as np

from colsight.llm import language_id as lid

PIECES = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "bab", "c"]


def segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in PIECES or k == 1:
            for rest in segmentations(word[k:]):
                yield [word[:k], *rest]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    model = rng.random((len(PIECES) + 1, 2))
    words = ["a", "ab", "abab", "babab", "x", "abxba", "cab"]
    got = lid.word_scores(words, lid.Pieces(PIECES), model)
    number = {p: k for k, p in enumerate(PIECES)}
    for w, row in zip(words, got):
        for lang in range(2):
            want = sum(math.prod(model[number.get(p, len(PIECES)), lang] for p in s) for s in segmentations("▁" + w))
            assert math.isclose(math.exp(row[lang]), want, rel_tol=1e-9)


def test_expected_counts():
    rng = np.random.default_rng(2)
    model = rng.random((len(PIECES) + 1, 2))
    words, lang, times = ["abab", "bx", "abab"], np.array([0, 1, 1]), np.array([3.0, 2.0, 1.0])
    got = lid.expected_counts(words, lang, times, lid.Pieces(PIECES), model)
    number = {p: k for k, p in enumerate(PIECES)}
    want = np.zeros_like(model)
    for w, k, n in zip(words, lang, times):
        ways = [[number.get(p, len(PIECES)) for p in s] for s in segmentations("▁" + w)]
        chances = [math.prod(model[p, k] for p in s) for s in ways]
        for s, c in zip(ways, chances):
            for p in s:
                want[p, k] += n * c / sum(chances)
    assert np.allclose(got, want)


def test_held_out_accuracy(spark, sf_dir, documents):
    rows = lid.op9_language_id(spark, sf_dir).collect()
    truth = {i: lang for i, _, lang in documents}
    assert len(rows) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_chances_below_the_smallest_double():
    """Totals of 1e10 piece uses: a run of unseen letters has a chance of 1e-11 per letter."""
    table = lid.Pieces(PIECES)
    model = np.full((len(PIECES) + 1, 2), 0.1 / 1e10)
    model[:, 1] = 0.1 / 1e6
    words = ["x" * lid.WORD_LETTERS, "ab" * 16, "x"]
    got = lid.word_scores(words, table, model)
    small = np.log(model[-1])
    assert np.isfinite(got).all()
    assert np.allclose(got[0], (lid.WORD_LETTERS + 1) * small) and np.allclose(got[2], 2 * small)
    # The same sums at chances which a double can hold, then all of them scaled.
    scaled = np.full((len(PIECES) + 1, 1), 0.1 / 1e10)
    letters = [len(p) for p in PIECES] + [1]
    for f in (1.0, 1e-11):
        scaled[:, 0] = 0.5 * f ** np.array(letters, float)
        scores = lid.word_scores(words, table, scaled)[:, 0] - np.log(f) * np.array([len(w) + 1 for w in words])
        uses = lid.expected_counts(words, np.zeros(3, int), np.array([2.0, 3.0, 1.0]), table, scaled)
        if f == 1:
            want = scores, uses
        assert np.allclose(scores, want[0]) and np.allclose(uses, want[1])


def test_unseen_script_does_not_decide(spark):
    """A run in a script that no language has; the words around it say which language it is."""
    chances = np.full((len(PIECES) + 1, 2), 0.1 / 1e10, np.float32)
    chances[PIECES.index("▁ab")] = [0.9, 0.1]
    docs = spark.createDataFrame([("ab ab ab " + chr(0x4E00) * 40,)], "text string")
    for small in (1e-11, 1e-13):  # of the second language
        chances[-1, 1] = small
        (row,) = lid.predict(docs, lid.Model(PIECES, ["aa", "bb"], chances, np.array([0.5, 0.5]))).collect()
        assert row.lang_pred == "aa" and 0.5 < row.score <= 1


SCHEMA = "doc_id bigint, text string, lang string, row string, score int, lang_pred string"


def test_edges(spark):
    rows = [(1, "der hund und die katze", "de"), (3, "the dog and the cat", "en"), (4, "le chien et le chat", None), (5, None, "en")]
    rows += [(6, "", "en"), (7, "12 !? 34", "en"), (None, "the cat", None), (8, "x" * 100_000 + " the dog", None), (3, "the dog and the cat", "en")]
    df = spark.createDataFrame([(*r, "r", 1, "l") for r in rows], SCHEMA)
    model = lid.train(df.select("text", "lang"), ["▁", *"abcdefghijklmnopqrstuvwxyz", "▁the", "▁der", "▁und"])
    got = {(r.row.doc_id, r.row.text): r for r in lid.predict(df, model).collect()}
    assert len(got) == 8 and got[1, rows[0][1]].lang_pred == "de" and got[None, "the cat"].lang_pred == "en"
    assert {k[0] for k, r in got.items() if r.lang_pred == "und"} == {5, 6, 7}
    assert all(r.score == 0 for r in got.values() if r.lang_pred == "und")
    empty = spark.createDataFrame([], SCHEMA)
    nothing = lid.train(empty, ["a"])
    assert lid.predict(empty, nothing).count() == 0
    assert {r.lang_pred for r in lid.predict(df, nothing).collect()} == {"und"}


def test_long_runs_are_one_word():
    """A run of 500 letters against sums over all of its segmentations, taken from its end."""
    rng = np.random.default_rng(6)
    table = lid.Pieces(PIECES)
    model = rng.random((len(PIECES) + 1, 2)) / 1000
    word = "".join(rng.choice(list("abcx"), 500))
    number = {p: k for k, p in enumerate(PIECES)}
    text = "▁" + word
    want = np.zeros((len(text) + 1, 2))  # logarithms
    uses = np.zeros_like(model)
    front = np.full_like(want, -np.inf)
    front[0] = 0
    steps = [(k, k + n, number.get(text[k : k + n], len(PIECES))) for k in range(len(text)) for n in (1, 2, 3) if k + n <= len(text) and (n == 1 or text[k : k + n] in number)]
    want[:-1] = -np.inf
    for a, b, p in reversed(steps):
        want[a] = np.logaddexp(want[a], np.log(model[p]) + want[b])
    for a, b, p in sorted(steps, key=lambda x: x[1]):
        front[b] = np.logaddexp(front[b], np.log(model[p]) + front[a])
    for a, b, p in steps:
        uses[p] += np.exp(front[a] + np.log(model[p]) + want[b] - want[0])
    got = lid.word_scores([word, "ab", word], table, model)
    assert np.allclose(got[0], want[0], rtol=1e-12) and np.allclose(got[0], got[2])
    both = lid.expected_counts([word, word], np.array([0, 1]), np.array([1.0, 2.0]), table, model)
    assert np.allclose(both, uses * [1.0, 2.0])


def test_a_cut_would_change_the_score():
    table = lid.Pieces(PIECES)
    model = np.random.default_rng(7).random((len(PIECES) + 1, 1))
    whole, parts = lid.word_scores(["ab" * 20, "ab" * 16, "ab" * 4], table, model)[[0, 1]], lid.word_scores(["ab" * 16, "ab" * 4], table, model)
    assert not math.isclose(whole[0, 0], parts.sum())

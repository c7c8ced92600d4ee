"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability
of a word is the sum over all its segmentations into pieces (forward algorithm), and a text
scores the sum of its words' log probabilities. Pieces do not cross words, so words are scored
once per chunk, all words of one length together as arrays. A run of letters is one word however
long it is: only the sums that a piece reaches back to are held, and they are scaled up as they
fall. Sums that come near the smallest double all the same are taken again as logarithms.

Training counts (language, word) over the whole labelled part of the corpus, then estimates
the piece probabilities by expectation maximisation on the counted words: forward and backward
sums give the expected use of every piece. Only the model, pieces times languages, reaches
the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm import shared

ROUNDS = 2
SMOOTHING = 0.1
WORDS_AT_ONCE, WORD_LETTERS = 20_000, 32  # so many words of so many letters at once, or fewer longer ones
RESCALE, LOW = 8, 1e-100
LONG_LETTERS = 256  # longer words are taken one by one, all their pieces found at once
COUNTED_WORDS = 200_000
CHUNK_BYTES = 4 << 20
UNDECIDED = "und"
LEAST_CHANCE = 1e-280  # above it, what is lost to underflow on the way does not count
_STEP = np.uint64(0x9E3779B97F4A7C55)


def _finder():
    import regex

    return regex.compile(r"\p{L}+").findall


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.array(words, dtype=f"U{length}").view(np.uint32).reshape(len(words), length)


class Pieces:
    """Vocabulary pieces by hash. A character that is no piece is the last piece, 'unknown'."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces))
        self.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.longest, _STEP)]))
        hashes = np.empty(len(pieces), np.uint64)
        lengths = np.array([len(p) for p in pieces])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            hashes[at] = self._sums(_codes([pieces[i] for i in at], n))[:, -1]
        order = np.argsort(hashes)
        self.hashes, self.places = hashes[order], order

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * _STEP + codes[:, j].astype(np.uint64) + np.uint64(7)
        return out

    def edges_of(self, word: str) -> tuple[list[int], list[int], list[int]]:
        """(begins, ends, pieces) in one long word, ends ascending."""
        sums = self._sums(_codes(["▁" + word], len(word) + 1))[0]
        found = []
        for n in range(1, min(self.longest, len(word) + 1) + 1):
            h = sums[n:] - sums[:-n] * self.powers[n]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            there = self.hashes[at] == h
            piece = self.places[at]
            if n == 1:
                piece, there = np.where(there, piece, self.size - 1), np.ones(len(h), bool)
            begin = np.flatnonzero(there)
            found.append((begin, begin + n, piece[begin]))
        begins, ends, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(ends, kind="stable")
        return begins[order].tolist(), ends[order].tolist(), piece[order].tolist()

    def edges(self, words: list[str], length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, which words, their piece) for all pieces in words of one length, which get
        a word start in front; ends ascend."""
        sums = self._sums(_codes(["▁" + w for w in words], length + 1))
        for end in range(1, length + 2):
            for begin in range(end - 1, max(end - self.longest, 0) - 1, -1):
                h = sums[:, end] - sums[:, begin] * self.powers[end - begin]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                there = self.hashes[at] == h
                if begin == end - 1:
                    yield begin, end, np.arange(len(words)), np.where(there, self.places[at], self.size - 1)
                elif there.any():
                    which = np.flatnonzero(there)
                    yield begin, end, which, self.places[at[which]]


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        many = max(1, WORDS_AT_ONCE * WORD_LETTERS // max(WORD_LETTERS, n))
        for k in range(0, len(at), many):
            yield int(n), at[k : k + many]


def _log_forward(words: list[str], n: int, pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations of words of ``n`` letters."""
    width = pieces.longest + 1
    ring = np.full((width, len(words), logs.shape[1]), -np.inf)
    ring[0] = 0
    last = 0
    for begin, end, which, piece in pieces.edges(words, n):
        if end != last:
            ring[end % width] = -np.inf
            last = end
        here = ring[end % width]
        here[which] = np.logaddexp(here[which], ring[begin % width][which] + logs[piece])
    return ring[last % width]


def word_scores(words: list[str], pieces: Pieces, model: np.ndarray) -> np.ndarray:
    """Log probability of every word in every language, summed over segmentations. A word's sums
    are held for as many positions as the longest piece has letters."""
    out = np.zeros((len(words), model.shape[1]))
    width = pieces.longest + 1
    for n, at in _by_length(words):
        some = [words[i] for i in at]
        if n > LONG_LETTERS:
            out[at] = [_long_score(w, pieces, model) for w in some]
            continue
        ring = np.zeros((min(width, n + 2), len(at), model.shape[1]))
        ring[0] = 1
        scale = np.zeros((len(at), model.shape[1]))
        last = 0
        for begin, end, which, piece in pieces.edges(some, n):
            if end != last:
                if last and last % RESCALE == 0 and n > 2 * RESCALE:
                    top = ring.max(axis=0)
                    low = (top < LOW) & (top > 0)
                    if low.any():
                        factor = np.divide(1.0, top, out=np.ones_like(top), where=low)
                        ring *= factor
                        scale -= np.log(factor)
                ring[end % len(ring)] = 0
                last = end
            ring[end % len(ring)][which] += ring[begin % len(ring)][which] * model[piece]
        total = ring[last % len(ring)]
        weak = np.flatnonzero((total < LEAST_CHANCE).any(axis=1))
        strong = np.flatnonzero((total >= LEAST_CHANCE).all(axis=1))
        out[at[strong]] = np.log(total[strong]) + scale[strong]
        if len(weak):
            out[at[weak]] = _log_forward([some[i] for i in weak], n, pieces, np.log(model))
    return out


def expected_counts(words: list[str], language: np.ndarray, times: np.ndarray, pieces: Pieces, model: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in every language by words seen ``times`` times."""
    out = np.zeros(pieces.size * model.shape[1])
    for n, at in _by_length(words):
        lang = language[at]
        if n > LONG_LETTERS:
            for i in at:
                _add_log_uses(out, words[i], int(language[i]), times[i], pieces, model)
            continue
        edges = list(pieces.edges([words[i] for i in at], n))
        chance = [model[piece, lang[which]] for _, _, which, piece in edges]
        forward = np.zeros((n + 2, len(at)))
        backward = np.zeros((n + 2, len(at)))
        forward[0] = backward[-1] = 1
        for (begin, end, which, _), p in zip(edges, chance):
            forward[end][which] += forward[begin][which] * p
        # From the last position down: every edge into a position after all edges out of it.
        for k in sorted(range(len(edges)), key=lambda k: -edges[k][1]):
            begin, end, which, _ = edges[k]
            backward[begin][which] += backward[end][which] * chance[k]
        strong = forward[-1] >= LEAST_CHANCE
        share = np.divide(times[at], forward[-1], out=np.zeros(len(at)), where=strong)
        for (begin, end, which, piece), p in zip(edges, chance):
            use = forward[begin][which] * p * backward[end][which] * share[which]
            out += np.bincount(piece * model.shape[1] + lang[which], use, len(out))
        if not strong.all():
            for i in at[~strong]:
                _add_log_uses(out, words[i], int(language[i]), times[i], pieces, model)
    return out.reshape(pieces.size, model.shape[1])


def _long_score(word: str, pieces: Pieces, model: np.ndarray) -> np.ndarray:
    """Log probability of a long word in every language, by scaled sums."""
    width = pieces.longest + 1
    ring = np.zeros((width, model.shape[1]))
    ring[0], scale, last = 1, np.zeros(model.shape[1]), 0
    for begin, end, piece in zip(*pieces.edges_of(word)):
        if end != last:
            if last % RESCALE == 0 and (ring[last % width] < LOW).any():
                top = ring.max(axis=0)
                factor = np.divide(1.0, top, out=np.ones_like(top), where=(top < LOW) & (top > 0))
                ring *= factor
                scale -= np.log(factor)
            ring[end % width] = 0
            last = end
        ring[end % width] += ring[begin % width] * model[piece]
    if (ring[last % width] >= LEAST_CHANCE).all():
        return np.log(ring[last % width]) + scale
    return _log_forward([word], len(word), pieces, np.log(model))[0]


def _log_sum(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _add_log_uses(out: np.ndarray, word: str, lang: int, times: float, pieces: Pieces, model: np.ndarray) -> None:
    """Add the expected uses of pieces by a word that is long, or whose chance is too small for a
    double."""
    logs = np.log(model[:, lang])
    begins, ends, piece = pieces.edges_of(word)
    chance = logs[piece].tolist()
    forward = [0.0] + [-math.inf] * (len(word) + 1)
    for a, b, c in zip(begins, ends, chance):
        forward[b] = _log_sum(forward[b], forward[a] + c)
    backward = [-math.inf] * (len(word) + 1) + [0.0]
    uses = np.empty(len(piece))
    for k in range(len(piece) - 1, -1, -1):
        way = chance[k] + backward[ends[k]]
        backward[begins[k]] = _log_sum(backward[begins[k]], way)
        uses[k] = forward[begins[k]] + way - forward[-1]
    np.add.at(out, np.array(piece) * model.shape[1] + lang, times * np.exp(uses))


def _word_counts(labelled: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder()
        held: dict[str, Counter] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            columns = zip(*rows) if rows else ([], [], [])
            kinds = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["lang", "word", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                counter = held.setdefault(lang.as_py(), Counter())
                before = len(counter)
                runs = find(text.as_py().lower())
                counter.update(runs)
                size += len(counter) - before + sum(map(len, runs)) // LONG_LETTERS
                if size > COUNTED_WORDS:
                    yield flush()
                    held, size = {}, 0
        yield flush()

    counted = labelled.mapInArrow(run, "lang string, word string, n bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, pieces: list[str], languages: list[str], chances: np.ndarray, priors: np.ndarray):
        self.pieces, self.languages, self.chances, self.priors = pieces, languages, chances, priors


def train(labelled: DataFrame, pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Model of the texts in ``labelled`` (text, lang). Rows without lang or text teach nothing."""
    taught = labelled.filter("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = shared.written(_word_counts(taught))
    sizes = taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    languages = [r.lang for r in sizes]
    priors = np.array([r.n for r in sizes], float)
    n_pieces = len(pieces) + 1
    chances = np.full((n_pieces, max(1, len(languages))), 1.0 / n_pieces)

    for _ in range(rounds if languages else 0):
        current = chances.astype(np.float32)

        def run(batches: Iterable[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            table = Pieces(pieces)
            number = {x: k for k, x in enumerate(languages)}
            total = np.zeros(current.shape)
            for batch in batches:
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
                times = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
                if len(lang):
                    total += expected_counts(batch.column("word").to_pylist(), lang, times, table, current.astype(float))
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang], pa.float64())],
                ["piece", "lang", "uses"],
            )

        uses = counts.mapInArrow(run, "piece bigint, lang bigint, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        chances = np.full(chances.shape, SMOOTHING)
        found = uses.toArrow()  # at most pieces x languages rows
        chances[found.column("piece").to_numpy(), found.column("lang").to_numpy()] += found.column("uses").to_numpy()
        chances /= chances.sum(axis=0)
    return Model(pieces, languages, chances.astype(np.float32), priors / max(1.0, priors.sum()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Language of every text.

    ``docs`` is kept as a struct ``row``, beside it lang_pred and score. A text that is missing
    or has no letter is 'und' with score 0, and so is every text if nothing was learned. The
    score is the posterior probability of the predicted language; of equal ones the first in
    alphabetical order is taken. Repeated rows get equal results. Texts, and runs of letters in
    them, may be of any length; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, table = _finder(), Pieces(model.pieces)
        chances, start = model.chances.astype(float), np.log(model.priors + 1e-300)
        for batch in batches:
            for piece in shared.batches_by_bytes(batch, "text", CHUNK_BYTES):
                place: dict[str, int] = {}
                counts, words = [], []
                for text in piece.column("text").to_pylist():
                    runs = find((text or "").lower())
                    counts.append(len(runs))
                    words.append(np.array([place.setdefault(w, len(place)) for w in runs], np.int64))
                languages, scores = [], []
                if place and model.languages:
                    table_scores = word_scores(list(place), table, chances)
                for n, at in zip(counts, words):
                    if not n or not model.languages:
                        languages.append(UNDECIDED)
                        scores.append(0.0)
                        continue
                    total = start + table_scores[at].sum(axis=0)
                    best = int(np.argmax(total))
                    languages.append(model.languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                rest = [piece.column(k) for k, name in enumerate(piece.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                    [*(name for name in piece.schema.names if name != "text"), "lang_pred", "score"],
                )

    source = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    kind = dict(source.dtypes)["row"]
    return source.mapInArrow(run, f"row {kind}, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def public_pieces() -> list[str]:
    """Pieces of the public 32k vocabulary that consist of letters, with or without a word start."""
    import public_tokenizers
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    pieces = {read.id_to_piece(i).lower() for i in range(read.get_piece_size())}
    return sorted(p for p in pieces if p == "▁" or p.removeprefix("▁").isalpha())


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows of ``docs`` that are not held out, and predict all of them."""
    return predict(docs, train(docs.filter(~held_out()).select("text", "lang"), public_pieces()))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents. A missing doc_id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out()).select("text", "lang"), public_pieces())
    out = predict(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

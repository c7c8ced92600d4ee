"""Cross-entropy difference of two n-gram models.

Target and background model have the same order (bigrams over unigrams), the same smoothing
and one vocabulary: all words of the corpus. The background model counts all documents, the
target model those named as target. A document scores by the mean difference of its tokens'
log probabilities.

Both models are counted in one exchange: a pack sends each of its n-grams once with its two
counts, hash ranges add them up, and each pack gets the totals of its own n-grams back. No
model stands in one place, so counts grow with the corpus without a bound on the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm import shared
from colsight.llm.words import WordHasher, Words, mix, rolling, text_bytes

PRIOR = 1.0  # weight of the unigram model in bigram counts
SCHEMA = "doc_id bigint, n_tokens bigint, loss_target double, loss_background double, score double"
_ONE = np.uint64(1)
_SHIFT = np.uint64(64 - shared.KEY_BITS)


def _ngrams(table: pa.Table) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, key of every word, places that have a word before them, key of the pair that ends
    there. The lowest bit of a key tells words from pairs."""
    words = Words(*text_bytes(table.column("text").combine_chunks()))
    h = WordHasher(lower=True)(words.data, words.starts, words.ends)
    pairs = words.whole(2)
    return words, (mix(h) >> _SHIFT) | _ONE, pairs + 1, (rolling(h, 2)[pairs] >> _SHIFT) & ~_ONE


def score(docs: DataFrame, target: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Cross-entropy difference of every document.

    ``target`` names the target documents by ``doc_id``. Returns a row per input row: doc_id,
    n_tokens, loss_target and loss_background (mean negative log probability of a token) and
    score, their difference; a positive score is nearer to the target. Words are runs outside
    ASCII white space, A-Z in lower case. The first word of a text has its unigram
    probability. A missing text or one without words has missing losses and score. Without any
    target document the target model is uniform. Rows without doc_id are never target; rows
    with equal doc_id are all target or none. Other columns are not looked at.
    """
    named = target.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct()
    named = shared.bounded(shared.written(named.withColumn("wanted", F.lit(True))))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), shared.text_or_empty().alias("text"))
    source = source.join(named, "doc_id", "left").select("doc_id", "text", F.col("wanted").isNotNull().alias("wanted"))
    packs = shared.packed(source)
    buckets = shared.hash_ranges(packs)

    def keys_of(table: pa.Table) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words, singles, second, pairs = _ngrams(table)
        keys, place = np.unique(np.concatenate([singles, pairs]), return_inverse=True)
        return words, keys, place[: len(singles)], second, place[len(singles) :], singles

    def count(pack: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        words, keys, single, second, pair, _ = keys_of(table)
        if not len(keys):
            return
        place = np.concatenate([single, pair])
        wanted = table.column("wanted").to_numpy()[words.text_of()]
        weights = np.concatenate([wanted, wanted[second]])
        every = np.bincount(place, minlength=len(keys)).astype(np.uint32)
        aimed = np.bincount(place, weights, len(keys)).astype(np.uint32)
        yield shared.lists(pack, buckets, shared.KEY_BITS, keys, every, aimed)

    def add(found: list[list[np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        keys, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        every, aimed = (np.bincount(place, np.concatenate([f[k] for f in found])).astype(np.int64) for k in (1, 2))
        word = (keys & _ONE).astype(bool)
        sums = np.array([word.sum(), every[word].sum(), aimed[word].sum()], np.int64)
        yield -1, shared.encode(keys[:1], sums)
        start = 0
        for i, f in enumerate(found):
            mine = place[start : start + len(f[0])]
            start += len(f[0])
            yield i, shared.encode(f[0][:1], every[mine], aimed[mine])

    replies = shared.written(shared.merged(shared.scatter(packs, count), add))
    # One row per hash range.
    totals = [shared.decode(bytes(r.keys))[1] for r in replies.filter("pack < 0").select("keys").collect()]
    n_words, n_every, n_aimed = (int(x) for x in np.sum(totals, axis=0)) if totals else (0, 0, 0)

    def losses(words: Words, single: np.ndarray, second: np.ndarray, pair: np.ndarray, counts: np.ndarray, total: int) -> np.ndarray:
        unigram = (counts[single] + 1.0) / (total + n_words)
        chance = unigram.copy()
        before = counts[single[second - 1]]
        chance[second] = (counts[pair] + prior * unigram[second]) / (before + prior)
        sums = np.concatenate([[0.0], np.cumsum(-np.log(chance))])
        return (sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(words.counts, 1)

    def rate(pack: int, table: pa.Table, found: list[list[np.ndarray]]) -> pa.Table:
        _, every, aimed = shared.joined(found, ["u8", "i8", "i8"])
        words, keys, single, second, pair, _ = keys_of(table)
        assert len(keys) == len(every)
        empty = words.counts == 0
        loss_t = losses(words, single, second, pair, aimed, n_aimed)
        loss_b = losses(words, single, second, pair, every, n_every)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_tokens": pa.array(words.counts, pa.int64()),
                "loss_target": pa.array(loss_t, mask=empty),
                "loss_background": pa.array(loss_b, mask=empty),
                "score": pa.array(loss_b - loss_t, mask=empty),
            }
        )

    return shared.gather(packs, replies.filter("pack >= 0"), rate, SCHEMA)


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents; documents labelled as of good quality are the target."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.filter("quality = 1"))
    return out.select("doc_id", "n_tokens", F.round("score", 6).alias("score"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i, unnest(list_concat([NULL], ws[:-2])) AS v FROM w),
q AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
f AS (SELECT t.*, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS aimed FROM t LEFT JOIN q USING (doc_id)),
u AS (SELECT w, count(*) AS e, sum(aimed) AS a FROM f GROUP BY w),
b AS (SELECT v, w, count(*) AS e, sum(aimed) AS a FROM f WHERE v IS NOT NULL GROUP BY v, w),
n AS (SELECT count(*) AS n, sum(e) AS e, sum(a) AS a FROM u),
p AS (SELECT f.doc_id, f.v, (u.e + 1.0::DOUBLE) / (n.e + n.n) AS ue, (u.a + 1.0::DOUBLE) / (n.a + n.n) AS ua,
             b.e AS be, b.a AS ba, h.e AS he, h.a AS ha
      FROM f JOIN u USING (w) CROSS JOIN n LEFT JOIN b ON b.v = f.v AND b.w = f.w LEFT JOIN u h ON h.w = f.v),
s AS (SELECT doc_id, count(*) AS n_tokens,
             avg(ln(CASE WHEN v IS NULL THEN ua ELSE (ba + ua) / (ha + 1) END)
               - ln(CASE WHEN v IS NULL THEN ue ELSE (be + ue) / (he + 1) END)) AS score FROM p GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_tokens, 0) AS n_tokens, round(score, 6) AS score FROM w LEFT JOIN s USING (doc_id)
"""

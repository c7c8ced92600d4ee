"""Substring dedup by fixed-block anchors.

A repeated window of ``window`` words holds one aligned block of ``block`` words of the
document it repeats, as long as ``2 * block - 1 <= window``. So

1. every document is indexed by its non-overlapping aligned blocks and probed with every
   rolling block; hash ranges find the blocks that two documents share (the anchors);
2. only windows around an anchor are looked at again: their 96-bit fingerprints meet by
   hash range, and each learns the smallest document it starts in;
3. a window whose smallest document is smaller than its own is a repeat; overlapping
   repeats join to maximal runs, which are removed.

Step 1 moves about 4 bytes per word and no text; steps 2 and 3 move shared windows only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm import shared
from colsight.llm.words import WordHasher, Words, mix, rolling, text_bytes

WINDOW = 13
_LANE = np.uint64(0xD6E8FEB86659FD95)
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:bigint,stop:bigint>>"


def _hashes(docs: pa.Table) -> tuple[Words, np.ndarray]:
    words = Words(*text_bytes(docs.column("text").combine_chunks()))
    return words, WordHasher()(words.data, words.starts, words.ends)


def _groups(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and where each distinct one begins."""
    s = keys[order]
    return s, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)


def _fingerprints(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows at ``at``: 64 and 32 bits from separate mixes of the words."""
    one = rolling(h, window)[at]
    two = rolling(mix(h ^ _LANE), window)[at] >> np.uint64(32)
    return one, two.astype(np.uint32)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove words covered by a window of ``window`` words that also starts in a document
    with a smaller doc_id. Windows are judged on the input, not on what is left.

    Returns a row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by
    one space) and removed (maximal runs as word positions). A missing text has no words. A
    missing doc_id counts as larger than any other; rows with equal doc_id are one document.
    Columns other than doc_id and text are not looked at.
    """
    block = (window + 1) // 2
    span = window - block + 1  # anchors that a window can hold
    shift = np.uint64(64 - shared.KEY_BITS)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), shared.text_or_empty().alias("text"))
    packs = shared.packed(source)
    buckets = shared.hash_ranges(packs)

    def probe(pack: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        words, h = _hashes(table)
        at = words.whole(block)
        keys = rolling(h, block)[at] >> shift
        owner = shared.ids(table)[words.text_of()[at]]
        aligned = words.place()[at] % block == 0
        order = np.argsort(keys, kind="stable")
        s, begin = _groups(keys, order)
        if not len(s):
            return
        owner = owner[order]
        several = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)
        indexed = np.logical_or.reduceat(aligned[order], begin)
        flags = indexed.astype(np.uint8) | (several.astype(np.uint8) << 1)
        yield shared.lists(pack, buckets, shared.KEY_BITS, s[begin], flags)

    def anchors(found: list[list[np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        keys = np.concatenate([k for k, _ in found])
        flags = np.concatenate([f for _, f in found])
        order = np.argsort(keys, kind="stable")
        s, begin = _groups(keys, order)
        sizes = np.diff(np.append(begin, len(s)))
        joint = np.bitwise_or.reduceat(flags[order], begin)
        hot = s[begin][((joint & 1) > 0) & ((sizes > 1) | ((joint & 2) > 0))]
        for i, (k, _) in enumerate(found):
            mine = k[shared.find(hot, k)[1]]
            if len(mine):
                yield i, shared.encode(mine)

    def around(pack: int, table: pa.Table, replies: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        (hot,) = shared.joined(replies, ["u8"])
        words, h = _hashes(table)
        if not len(hot) or len(h) < window:
            return
        hits = np.zeros(len(h) + span, np.int64)
        at = words.whole(block)
        hits[at + 1] = shared.find(hot, rolling(h, block)[at] >> shift)[1]
        hits = np.cumsum(hits)
        at = words.whole(window)
        at = at[hits[at + span] > hits[at]]
        if not len(at):
            return
        one, two = _fingerprints(h, at, window)
        owner = shared.ids(table)[words.text_of()[at]]
        order = np.lexsort((two, one))
        one, two, owner = one[order], two[order], owner[order]
        begin = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        low, high = np.minimum.reduceat(owner, begin), np.maximum.reduceat(owner, begin)
        yield shared.lists(pack, buckets, 64, one[begin], two[begin], low, low != high)

    def around_table(pack: int, table: pa.Table, replies: list[list[np.ndarray]]) -> pa.Table:
        return pa.Table.from_batches(list(around(pack, table, replies)), shared.LIST_SCHEMA)

    def smallest(found: list[list[np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        sizes = [len(f[0]) for f in found]
        one, two, low, several = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        least = np.empty_like(low)
        least[order] = np.repeat(np.minimum.reduceat(low[order], begin), np.diff(np.append(begin, len(a))))
        tell = (least < low) | several
        stop = np.cumsum(sizes)
        for i, (x, y) in enumerate(zip(stop - sizes, stop)):
            mine = np.flatnonzero(tell[x:y]) + x
            if len(mine):
                yield i, shared.encode(one[mine], two[mine], least[mine])

    def cut(pack: int, table: pa.Table, replies: list[list[np.ndarray]]) -> pa.Table:
        keys, seconds, least = shared.joined(replies, ["u8", "u4", "i8"])
        words, h = _hashes(table)
        owner = shared.ids(table)
        cover = np.zeros(len(h) + window + 1, np.int64)
        at = words.whole(window)
        if len(keys) and len(at):
            one, two = _fingerprints(h, at, window)
            text_of = words.text_of()
            place, there = shared.find(keys, one)
            # Two windows with equal first hashes stand beside each other.
            for p in (place, np.minimum(place + 1, len(keys) - 1)):
                same = there & (keys[p] == one) & (seconds[p] == two)
                late = at[same & (least[p] < owner[text_of[at]])]
                cover[late] = 1
        starts = np.cumsum(cover)
        upto = np.arange(len(h))
        removed = starts[upto] > np.where(upto >= window, starts[upto - window], 0)
        data = words.data
        texts, runs, gone = [], [], []
        for i in range(table.num_rows):
            x, y = int(words.first[i]), int(words.first[i + 1])
            lost = removed[x:y]
            kept = data[words.starts[x] : words.ends[y - 1]].tobytes().split() if y > x else []
            texts.append(b" ".join(compress(kept, ~lost)).decode())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
            runs.append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            gone.append(int(lost.sum()))
        run = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(words.counts, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "kept_text": pa.array(texts, pa.string()),
                "removed": pa.array(runs, run),
            }
        )

    shared_blocks = shared.merged(shared.scatter(packs, probe), anchors)
    windows = shared.gather(packs, shared_blocks, around_table, "bucket int, pack bigint, keys binary")
    return shared.gather(packs, shared.merged(windows, smallest), cut, SCHEMA)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: 13-word windows of all documents."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS g FROM p),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (g) WHERE least < doc_id),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM e ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

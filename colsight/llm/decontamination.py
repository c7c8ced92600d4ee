"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK walk reads a word sequence with a pointer that after each output stays or moves on,
as a random bit of (step, word) says. Sequences at a small edit distance then have outputs at
a small Hamming distance: after an edit the two pointers meet again soon. Every word position
of a document starts a walk; its outputs embed the window that begins there, whatever
the length of the item it is compared with. An item is embedded from several of its words, so
that an edit spoils few of its embeddings.

Bit sampling: ``REPEATS`` keys per walk, each of ``SAMPLES`` outputs that lie apart, as
neighbouring outputs are often the same word. If outputs agree with chance a, a planted item
is missed with chance ``(1 - a**SAMPLES) ** (WALKS * REPEATS)`` per embedding, below 1 % from
a = 0.72 on. Equal keys are only candidates: the word edit distance of the item to the text
around decides. It is at least the number of item words that the text around lacks, which
settles most of them beforehand.

Items of fewer than ``SEEDED`` words are too short for several walks. They are cut into one part
more than edits are allowed, so one part stands in the text unchanged: equal parts are their
candidates, and none is missed.

Items are sent to the tasks in blocks of bounded size, one pass over the texts per block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm import shared
from colsight.llm.words import MARKS, WordHasher, chunks, mix, rolling

EDITS = 0.2
LEAST_WORDS = 8
WALKS = 2
STEPS = 32  # one bit of a 32-bit hash decides a step
REPEATS = 8
SAMPLES = 4
STRIDE = 2
REACH = 16  # words that a walk covers on average
SEEDED = STEPS  # words; shorter items are found by their parts
BLOCK_BYTES = 16 << 20
POSITIONS = 1 << 16
FILTER_BITS = 20
MATCHES = "array<struct<item_id:bigint,start:bigint,stop:bigint,edits:bigint>>"

_rng = np.random.default_rng(60221)
_SALTS = _rng.integers(1, 2**63, WALKS, dtype=np.uint64)
_FACTORS = _rng.integers(1, 2**31, (WALKS * REPEATS, SAMPLES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _sampled(span: int) -> np.ndarray:
    """One step from the first half of each of SAMPLES equal parts."""
    width = span // SAMPLES
    return np.arange(SAMPLES) * width + _rng.integers(0, width // 2 + 1, SAMPLES)


#: Sampled steps: half of the keys look at early steps only, where short items still have words.
_SAMPLED = np.array([_sampled(STEPS // 2 if k % 2 else STEPS) for k in range(WALKS * REPEATS)])


def walk_keys(h: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the walks that start at ``starts`` over the word hashes ``h``, one array per key."""
    for w in range(WALKS):
        symbols = np.append((mix(h ^ _SALTS[w]) >> np.uint64(32)).astype(np.uint32), np.uint32(0))
        outputs = np.empty((STEPS, len(starts)), np.uint32)
        at = starts.copy()
        for j in range(STEPS):
            out = np.take(symbols, at, out=outputs[j], mode="clip")
            at += (out >> np.uint32(j)) & np.uint32(1)
        for k in range(w * REPEATS, (w + 1) * REPEATS):
            key = outputs[_SAMPLED[k][0]] * _FACTORS[k][0]
            for s in range(1, SAMPLES):
                key += outputs[_SAMPLED[k][s]] * _FACTORS[k][s]
            key ^= key >> np.uint32(15)
            key *= np.uint32(0x2C1B3C6D)
            key ^= key >> np.uint32(13)
            yield key


class Lookup:
    """(item, word of the item) by key, behind a filter on the first bits of the keys."""

    def __init__(self, keys: list[np.ndarray], item: list[int], offset: list[int]):
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.shift = key.dtype.type(8 * key.itemsize - FILTER_BITS)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[key >> self.shift] = True
        self.key, self.item, self.offset = key[order], np.array(item, np.int64)[order], np.array(offset, np.int64)[order]

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``found``, item, word of the item) for equal keys."""
        at = np.flatnonzero(self.seen[found >> self.shift])
        lo = np.searchsorted(self.key, found[at], "left")
        n = np.searchsorted(self.key, found[at], "right") - lo
        which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[which], self.offset[which]


def parts(words: int, edits: int) -> list[tuple[int, int]]:
    """(begin, end) of the parts of an item of which ``edits`` edits leave one unchanged."""
    bounds = [k * words // (edits + 1) for k in range(edits + 2)]
    return list(zip(bounds, bounds[1:]))


class Items:
    """Benchmark items of a block: their words, and their keys with (item, first word)."""

    def __init__(self, numbers: list[int], texts: list[str], least: int, edits: float):
        hasher = WordHasher()
        self.numbers, self.words, self.lists, self.most = [], [], [], []
        keys: list[list[np.ndarray]] = [[] for _ in range(WALKS * REPEATS)]
        item, offset = [], []
        seeds: dict[int, tuple[list, list, list]] = {}
        for number, (_, _, words) in zip(numbers, (next(chunks(pa.array([t]), between=MARKS)) for t in texts)):
            h = hasher(words.data, words.starts, words.ends)
            if not len(h):
                continue
            most = int(edits * len(h)) if len(h) >= least else 0
            if len(h) < SEEDED and most < len(h):
                for begin, end in parts(len(h), most):
                    lists = seeds.setdefault(end - begin, ([], [], []))
                    for x, value in zip(lists, (rolling(h[begin:end], end - begin), len(self.words), begin)):
                        x.append(value)
            else:
                starts = np.arange(0, max(1, len(h) - REACH + 1), STRIDE)
                for k, key in enumerate(walk_keys(h, starts)):
                    keys[k].append(key)
                item += [len(self.words)] * len(starts)
                offset += starts.tolist()
            self.numbers.append(number)
            self.words.append(h)
            self.most.append(most)
            self.lists.append(h.tolist())
        self.walks = [Lookup(found, item, offset) for found in keys if found]
        self.seeds = {size: Lookup(*lists) for size, lists in seeds.items()}

    def candidates(self, h: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, item, word of the item there) for positions with an equal key; ``starts``
        are the first positions of ``h``."""
        for size, lookup in self.seeds.items():
            yield lookup(rolling(h, size)[: len(starts)])
        if self.walks:
            for lookup, found in zip(self.walks, walk_keys(h, starts)):
                yield lookup(found)


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smallest word edit distance of ``item`` to a part of ``text``, with its begin and end."""
    n = len(text)
    steps = np.arange(n + 1)
    cost, origin = np.zeros(n + 1, np.int64), steps.copy()
    for x in item:
        other = cost[:-1] + (text != x)
        down = cost[1:] + 1
        better = other <= down
        now = np.concatenate([[cost[0] + 1], np.where(better, other, down)])
        source = np.concatenate([[origin[0]], np.where(better, origin[:-1], origin[1:])])
        # Words inserted from the left: the smallest of now[i] + (j - i).
        level = now - steps
        lowest = np.minimum.accumulate(level)
        place = np.maximum.accumulate(np.where(level == lowest, steps, 0))
        cost, origin = lowest + steps, source[place]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


def find_items(h: np.ndarray, first: np.ndarray, items: Items) -> list[list[tuple[int, int, int, int]]]:
    """(item_id, start, stop, edits) of the items that stand in each text of a chunk."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    wanted: set[tuple[int, int, int]] = set()
    for x in range(0, len(h), POSITIONS):
        # A walk that reaches into the next text reads other words there; it is a miss, no error.
        stop = min(len(h), x + POSITIONS)
        tail = min(len(h), stop + STEPS)
        for at, item, offset in items.candidates(h[x:tail], np.arange(stop - x)):
            wanted.update(zip(owner[at + x].tolist(), item.tolist(), (at + x - offset).tolist()))
    found: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in range(len(first) - 1)]
    checked: dict[tuple[int, int], int] = {}
    for text, item, begin in sorted(wanted):
        words = items.words[item]
        if item in found[text] and not found[text][item][3]:
            continue
        most = items.most[item]
        slack = 2 * most + STEPS // 2
        before = checked.get((text, item))
        if before is not None and begin - before <= most // 2:
            continue
        checked[text, item] = begin
        lo, hi = max(int(first[text]), begin - slack), min(int(first[text + 1]), begin + len(words) + slack)
        around = set(h[lo:hi].tolist())
        if sum(x not in around for x in items.lists[item]) > most:
            continue
        cost, a, b = best_match(words, h[lo:hi])
        if cost <= most and (item not in found[text] or cost < found[text][item][3]):
            base = lo - int(first[text])
            found[text][item] = (items.numbers[item], base + a, base + b, cost)
    return [[x[item] for item in sorted(x)] for x in found]


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """Items of ``benchmark`` (item_id, text) that stand in each text.

    Returns (row, matches): the input row as a struct, and for each item found its item_id,
    start, stop (word positions) and edits. Words are runs of letters and digits in lower case
    (any non-ASCII character counts as a letter). An item stands in a text if the word edit
    distance to a part of it is at most ``edits`` times the words of the item; items with fewer
    than ``least_words`` words must stand there unchanged. Missing items and those without a
    word are not searched. A missing or empty text holds none. Repeated rows get equal results.
    """
    text = F.lower(F.col("text").cast("string"))
    passages = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text.alias("text")).filter("text is not null")
    passages = shared.written(passages)
    total = passages.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    source = docs.select(F.struct("*").alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    kind = dict(source.dtypes)["row"]

    def search(numbers: list[int], texts: list[str]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, hasher = Items(numbers, texts, least_words, edits), WordHasher()
            matches = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "stop", "edits")]))
            for batch in batches:
                for x, y, words in chunks(batch.column("text"), between=MARKS):
                    h = hasher(words.data, words.starts, words.ends)
                    found = find_items(h, words.first, items)
                    rows = [[dict(zip(("item_id", "start", "stop", "edits"), m)) for m in f] for f in found]
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(x, y - x), pa.array(rows, matches)], ["row", "matches"])

        return source.mapInArrow(run, f"row {kind}, matches {MATCHES}")

    def block(k: int) -> DataFrame:
        part = passages.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).toArrow()  # about BLOCK_BYTES
        return search(part.column("item_id").to_pylist(), part.column("text").to_pylist())

    if blocks == 1:
        return block(0)
    numbered = source.select(F.struct("row.*", F.monotonically_increasing_id().alias("_row_number")).alias("row"), "text")
    source = shared.written(numbered)
    kind = dict(source.dtypes)["row"]
    every = reduce(DataFrame.unionByName, (block(k) for k in range(blocks)))
    found = every.filter(F.size("matches") > 0).select(F.col("row._row_number").alias("number"), F.explode("matches").alias("m"))
    found = found.groupBy("number").agg(F.sort_array(F.collect_list("m")).alias("matches"))
    joined = source.join(found, F.col("row._row_number") == F.col("number"), "left")
    none = F.array().cast(MATCHES)
    return joined.select(F.col("row").dropFields("_row_number").alias("row"), F.coalesce("matches", none).alias("matches"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "row.doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("bigint").alias("n_items"),
        F.transform("matches", lambda m: m["item_id"]).alias("item_ids"),
    )

"""MinHash near-dedup on bottom-k sketches from one hash function.

1. One pass over the texts gives each document the size of its shingle set, a digest of the
   set and its ``SKETCH`` smallest shingle hashes. Documents with equal sets form a class;
   from here on only the smallest document of a class takes part.
2. Retained values are inverted. The lists of a pair with the wanted similarity overlap in at
   least ``need`` values (missed with a chance below 1e-13 at the threshold itself), so a
   class is found by its values of lowest document frequency alone: at least one shared
   value is among the first ``size - need + 1``. A passage in a third of all documents never
   gets into these prefixes unless the documents share most of their values.
3. Every prefix list has its smallest class as pivot; lists of one pivot are one group, and a
   candidate pair stands together in the group of a list that it shares. Groups are cut into
   blocks of bounded weight. In a block, the sketch of the union estimates the similarity of
   a pair (filter), and the full sets confirm it with integers (verify). Pairs that earlier
   links already connect are skipped, so a large group of copies costs a star.
4. Classes that did not link with their pivot are compared with the other blocks of their
   group. No pair leaves a task; each class emits one link to the root of its block.
5. Connected components by minimum labels and pointer jumps over written tables.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm import shared
from colsight.llm.words import WordHasher, Words, chunks, rolling

SHINGLE = 5
PERCENT = 80
SKETCH = 64
BLOCK_WEIGHT = 250_000
LEAST_WEIGHT = 64
MISS = 1e-13


def needed(percent: int) -> int:
    """Overlap of two sketches that a pair at the threshold falls short of with a chance below MISS."""
    p, below = percent / 100, 0.0
    for s in range(SKETCH + 1):
        below += math.comb(SKETCH, s) * p**s * (1 - p) ** (SKETCH - s)
        if below > MISS:
            return s
    return SKETCH


def shingle_sets(words: Words, h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (63 bits) of each text. A text with fewer words than a
    shingle is one shingle."""
    one = np.uint64(1)
    full = rolling(h, size) >> one
    short = {m: rolling(h, m) >> one for m in range(1, size)}
    for x, n in zip(words.first, words.counts):
        if n >= size:
            yield np.unique(full[x : x + n - size + 1])
        elif n:
            yield short[n][x : x + 1]
        else:
            yield full[:0]


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            for x, y, words in chunks(batch.column("text")):
                counts, digests, sketches = [], [], []
                for s in shingle_sets(words, hasher(words.data, words.starts, words.ends), size):
                    counts.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sketches.append(s[:SKETCH].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(x, y - x),
                        pa.array(counts, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(sketches, pa.list_(pa.int64())),
                    ],
                    ["id", "n", "digest", "sketch"],
                )

    return docs.mapInArrow(run, "id bigint, n bigint, digest binary, sketch array<bigint>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            for x, y, words in chunks(batch.column("text")):
                found = [s.tobytes() for s in shingle_sets(words, hasher(words.data, words.starts, words.ends), size)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(x, y - x), pa.array(found, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id bigint, shingles binary")


class _Index:
    """Inverted lists over some sorted sets: which of them hold a value, and at which rank."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = [len(s) for s in sets]
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.n = len(sets)
        self.values = values[order]
        self.owner = np.repeat(np.arange(self.n), sizes)[order]
        self.rank = np.concatenate([np.arange(k) for k in sizes])[order]

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.values, wanted, "left"), np.searchsorted(self.values, wanted, "right")

    def overlap(self, wanted: np.ndarray) -> np.ndarray:
        """Size of the intersection with every set."""
        lo, hi = self.places(wanted)
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=self.n)


def _estimate(index: _Index, sketch: np.ndarray) -> np.ndarray:
    """For every indexed sketch: how many of the smallest SKETCH values of the union stand in both."""
    seen = np.zeros(index.n, np.int64)
    both = np.zeros(index.n, np.int64)
    for rank, (lo, hi) in enumerate(zip(*index.places(sketch))):
        if hi > lo:
            owner = index.owner[lo:hi]
            both[owner] += rank + index.rank[lo:hi] - seen[owner] < SKETCH
            seen[owner] += 1
    return both


class _Block:
    """Classes of a block (or of two) with union-find over the links confirmed so far."""

    def __init__(self, sets: list[np.ndarray], percent: int, need: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets])
        self.sketches = _Index([s[:SKETCH] for s in sets])
        self.full = _Index(sets)
        self.root = np.arange(len(sets))
        # Sets that fit into their sketch are compared as they are.
        self.least = np.where(self.sizes * 100 <= SKETCH * percent, -(-self.sizes * percent // 100), need)

    def compare(self, i: int, among: np.ndarray) -> None:
        """Link i with the classes marked in ``among`` that are not connected with it yet."""
        open_ = among & (self.root != self.root[i])
        if not open_.any():
            return
        likely = open_ & (_estimate(self.sketches, self.sets[i][:SKETCH]) >= np.minimum(self.least, self.least[i]))
        if not likely.any():
            return
        shared_ = self.full.overlap(self.sets[i])
        linked = likely & (100 * shared_ >= self.percent * (self.sizes[i] + self.sizes - shared_))
        roots = np.unique(np.append(self.root[linked], self.root[i]))
        self.root[np.isin(self.root, roots)] = roots[0]


def _rows(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Classes of a group in order of their number, with their sets."""
    table = table.sort_by("id")
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
    return table.column("id").to_numpy(), sets


def _links(groups: DataFrame, percent: int, need: int) -> DataFrame:
    """(pivot, block, id, root): every class of a block with the smallest one linked to it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pivot, block = (k.as_py() for k in key)
        ids, sets = _rows(table)
        b = _Block(sets, percent, need)
        later = np.ones(len(ids), bool)
        for i in range(len(ids)):  # the pivot has the smallest number of all
            later[i] = False
            if i == 0 or b.root[i] != b.root[0]:
                # Those that joined the pivot before i were not compared with i.
                b.compare(i, later | (b.root == b.root[0]))
        return pa.table(
            {
                "pivot": pa.array([pivot] * len(ids), pa.int64()),
                "block": pa.array([block] * len(ids), pa.int64()),
                "id": pa.array(ids, pa.int64()),
                "root": pa.array(ids[b.root], pa.int64()),
            }
        )

    return groups.groupBy("pivot", "block").applyInArrow(run, "pivot bigint, block bigint, id bigint, root bigint")


def _cross_links(tasks: DataFrame, percent: int, need: int) -> DataFrame:
    """(id, root) over pairs of blocks: the open classes of one block against all of the other."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("left", "descending"), ("id", "ascending")])
        left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("id").to_numpy()
        b = _Block([np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")], percent, need)
        for i in np.flatnonzero(left):
            b.compare(i, ~left)
        return pa.table({"id": pa.array(ids, pa.int64()), "root": pa.array(ids[b.root], pa.int64())})

    return tasks.groupBy("pivot", "i", "j").applyInArrow(run, "id bigint, root bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest number reachable from every end of ``links`` (id, root)."""
    pairs = links.filter("id <> root").select("id", "root")
    edges = shared.written(pairs.unionByName(pairs.select(F.col("root").alias("id"), F.col("id").alias("root"))).distinct())
    labels = shared.written(edges.groupBy("id").agg(F.least(F.col("id"), F.min("root")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("root"), "component"), "root")
        near = near.groupBy("id").agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("component", "near").alias("lower"), F.col("component").alias("before"))
        jump = labels.select(F.col("id").alias("lower"), F.col("component").alias("jump"))
        after = lower.join(jump, "lower", "left")
        after = after.select("id", F.least("lower", F.coalesce("jump", "lower")).alias("component"), "before")
        after = shared.written(after)
        labels = after.select("id", "component")
        if after.filter("component <> before").isEmpty():
            return labels


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Groups of documents whose sets of ``shingle``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more, chained.

    Returns a row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable),
    kept (doc_id is component_id). Words are runs outside ASCII white space, A-Z in lower case.
    A text with fewer words than a shingle is one shingle; a missing text or one without words
    has none and links with nothing. Rows with equal doc_id are one document with several
    texts; rows without doc_id likewise, after all others (component_id may then be missing,
    and such rows are kept if their group has no number). Other columns are not looked at.
    """
    need = needed(percent)
    numbered = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(shared.NO_ID))
    source = docs.select(numbered.alias("id"), shared.text_or_empty().alias("text"))
    signed = shared.written(_signatures(source, shingle))
    filled = signed.filter("n > 0")

    classes = filled.groupBy("digest").agg(F.min(F.struct("id", "n", "sketch")).alias("c")).select("c.*")
    values = classes.select("id", "n", F.explode("sketch").alias("v"))
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    common = values.join(counted, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("vs"))
    kept = F.least(F.col("n"), F.lit(SKETCH))
    small = F.col("n") * 100 <= SKETCH * percent
    prefix = F.when(small, F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).otherwise(kept - need + 1)
    # Values that no other class retains come first in the order, and find nothing.
    slots = (prefix - (kept - F.size("vs"))).cast("int")
    chosen = common.withColumn("slots", slots).filter("slots > 0")
    prefixes = shared.written(chosen.select("id", "n", F.explode(F.slice("vs", F.lit(1), F.col("slots"))).alias("x")).select("id", "n", "x.v"))

    pivots = prefixes.groupBy("v").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("f")).filter("f > 1")
    members = shared.written(prefixes.join(pivots.select("v", "pivot"), "v").select("pivot", "id", "n").distinct())
    active = shared.bounded(shared.written(members.select("id").distinct()))
    sets = shared.written(_sets(source.join(active, "id", "left_semi"), shingle))

    weight = F.sum(F.greatest(F.col("n"), F.lit(LEAST_WEIGHT)))
    blocks = shared.written(members.groupBy("pivot").agg(F.ceil(weight / BLOCK_WEIGHT).alias("blocks")))
    # Written first: a hot pivot is no key of the stage that joins the sets.
    listed = shared.written(members.join(blocks, "pivot"))
    dealt = sets.join(shared.bounded(listed), "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    # The pivot is in each block of its group.
    block = F.explode(F.when(F.col("id") == F.col("pivot"), every).otherwise(F.array(own)))
    links = shared.written(_links(dealt.select("pivot", block.alias("block"), "id", "shingles"), percent, need))

    wide = blocks.filter("blocks > 1")
    placed = links.join(wide, "pivot").filter("id <> pivot").select("pivot", "block", "blocks", "id", (F.col("root") != F.col("pivot")).alias("open"))
    others = F.explode(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), F.array("block")))
    lefts = placed.filter("open").select("pivot", F.col("block").alias("i"), others.alias("j"), "id", F.lit(True).alias("left"))
    rights = placed.select("pivot", others.alias("i"), F.col("block").alias("j"), "id", F.lit(False).alias("left"))
    rights = rights.join(lefts.select("pivot", "i").distinct(), ["pivot", "i"], "left_semi")
    tasks = lefts.unionByName(rights).join(sets, "id").select("pivot", "i", "j", "id", "left", "shingles")
    found = links.select("id", "root").unionByName(_cross_links(tasks, percent, need))

    reps = filled.groupBy("digest").agg(F.min("id").alias("id")).join(components(found), "id", "left")
    # Written, so that the join below has an exchange on each side and a hot digest can be split.
    reps = shared.written(reps.select("digest", F.coalesce("component", "id").alias("component")))
    out = filled.select("id", "n", "digest").join(reps, "digest").select("id", "n", "component")
    out = out.unionByName(signed.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    number = lambda c: F.when(F.col(c) != shared.NO_ID, F.col(c))
    return out.select(
        number("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        number("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: 4-word shingles of all documents, similarity 0.8."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS doc_id, x AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
m AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, w.doc_id) AS component_id,
       coalesce(m.least, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""

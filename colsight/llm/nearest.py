"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample of the distinct vectors (``SAMPLE`` of them) and every
distinct vector is put into a leaf. A query goes through the tree best bin first: a priority
queue holds nodes by the inner product of query and centre, the best is taken out, an inner node
puts its children in, a leaf is visited. How many leaves are visited is calibrated: a bounded
sample of the queries is searched exhaustively, and the number of visits is widened until the
wanted share of their true neighbours lies in visited leaves.

Equal vectors are one entry with the smallest ``k + 1`` rows that hold them, which is all that a
result can show, so a vector held by a third of all rows is as cheap as any other. Leaves and the
queries that visit them meet in cells of bounded size: a leaf with many vectors is cut into
slices, one with many visitors deals these out. The visits are made in waves, each ``WIDEN``
times as wide as all before it, and a query carries the score of its last row found so far: cells
return only rows that reach it, so the rows returned grow with the number of waves, not of visits.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.llm import shared, vectors

K = 20
RECALL = 0.96
SAMPLE = 32_768
LEAF_ROWS = 1024
MAX_LEAVES = 8192
TREE_NUMBERS = 1 << 22
BRANCHES = 8
WIDEN = 8
TRIAL_QUERIES = 256
CELL_ROWS = 32_768
BATCH = 4096
SCORES = 2_000_000


# ---------------------------------------------------------------- the tree


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Group number of each row; some of the ``k`` groups may be empty."""
    centres = rows[rng.choice(len(rows), 1)]
    far = ((rows - centres) ** 2).sum(axis=1)
    while len(centres) < k and far.max() > 0:  # k-means++
        centres = np.vstack([centres, rows[rng.choice(len(rows), 1, p=far / far.sum())]])
        far = np.minimum(far, ((rows - centres[-1]) ** 2).sum(axis=1))
    group = np.zeros(len(rows), np.int64)
    for _ in range(rounds):
        group = closest(rows, centres)
        for g in np.unique(group):
            centres[g] = rows[group == g].mean(axis=0)
    return closest(rows, centres)


def closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


@dataclass
class Tree:
    """Nodes in breadth-first order: ``centres``, the range of a node's children, and a leaf's
    number (-1 for inner nodes). Node 0 is the root."""

    centres: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, seed: int = 1) -> Tree:
        """Nodes are split by k-means until a node has its share of the sample."""
        rng = np.random.default_rng(seed)
        share = max(1.0, len(sample) / max(1, leaves))
        centres, children, leaf, todo, at, numbered = [sample.mean(axis=0)], [], [], [sample], 0, 0
        while at < len(todo):
            rows, todo[at] = todo[at], None
            at += 1
            groups = []
            if len(rows) > 1.5 * share:
                group = k_means(rows, min(BRANCHES, math.ceil(len(rows) / share)), rng)
                groups = [rows[group == g] for g in np.unique(group)]
            if len(groups) > 1:
                children.append((len(todo), len(todo) + len(groups)))
                leaf.append(-1)
                todo += groups
                centres += [g.mean(axis=0) for g in groups]
            else:
                children.append((0, 0))
                leaf.append(numbered)
                numbered += 1
        return cls(np.stack(centres), np.array(children), np.array(leaf))

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row: the closest child at every node."""
        out = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, which = todo.pop()
            if self.leaf[node] >= 0:
                out[which] = self.leaf[node]
                continue
            first, end = self.children[node]
            child = closest(rows[which], self.centres[first:end])
            todo += [(int(first + c), which[child == c]) for c in np.unique(child)]
        return out

    def visits(self, queries: np.ndarray, many: int, sizes: np.ndarray | None = None, least: int = 0) -> list[list[int]]:
        """The first ``many`` leaves for each query, best bin first; more of them until they hold
        ``least`` vectors by ``sizes``."""
        children, leaf = self.children.tolist(), self.leaf.tolist()
        size = None if sizes is None else sizes.tolist()
        out = []
        for start in range(0, len(queries), 64):
            for near in (-(queries[start : start + 64] @ self.centres.T)).tolist():
                heap, found, held = [(near[0], 0)], [], 0
                while heap and (len(found) < many or held < least):
                    _, node = heapq.heappop(heap)
                    if leaf[node] >= 0:
                        found.append(leaf[node])
                        held += size[leaf[node]] if size else least
                    else:
                        for child in range(*children[node]):
                            heapq.heappush(heap, (near[child], child))
                out.append(found)
        return out


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of rows of two arrays, added up from the first component to the last, so
    that a pair has the same score in whatever block it is met."""
    out = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        out += queries[:, j] * rows[:, j]
    return out


def best_pairs(
    queries: np.ndarray, rows: np.ndarray, least_id: np.ndarray, k: int, floor: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of the k best rows of each query that reach its floor, ties to the
    smaller id; in blocks.

    Products by blocks differ from ``scores`` in their last bits, so all that may be among the
    best are scored again."""
    step = max(1, SCORES // max(1, len(rows)))
    margin = 4 * queries.shape[1] * np.finfo(float).eps
    longest = np.sqrt((rows**2).sum(axis=1)).max()
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        near = some @ rows.T
        edge = np.full(len(some), -np.inf) if floor is None else floor[at : at + step]
        if len(rows) > k:
            edge = np.maximum(edge, np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k])
        edge = edge - margin * longest * np.sqrt((some**2).sum(axis=1))
        q, r = np.nonzero(near >= edge[:, None])
        exact = scores(some[q], rows[r])
        if floor is not None:
            reached = exact >= floor[at + q]
            q, r, exact = q[reached], r[reached], exact[reached]
        order = np.lexsort((least_id[r], -exact, q))
        q, r, exact = q[order], r[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        yield at + q[place < k], r[place < k], exact[place < k]


# ---------------------------------------------------------------- Spark


def _clean(table: DataFrame, vector: str, size: int, kind: str) -> DataFrame:
    """(row, vec_id, vec): usable vectors that are not zero, as bytes; rows are numbered."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in vectors.pieces(batches, BATCH):
            rows = vectors.block(batch.column("v"), size)
            some = np.flatnonzero((rows != 0).any(axis=1))
            data = vectors.rows_as_bytes((rows[some] + 0.0).astype(kind))  # no negative zeros
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(len(some)), pa.int64()), batch.column("vec_id").take(pa.array(some)), pa.array(data, pa.binary())],
                ["row", "vec_id", "vec"],
            )
            number += len(some)

    kept = table.filter(vectors.usable(vector)).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).alias("v"))
    return kept.mapInArrow(run, "row bigint, vec_id bigint, vec binary")


def _sample(distinct: DataFrame, count: int, most: int, seed: int) -> DataFrame:
    """About ``most`` of ``count`` vectors, by a hash of their components."""
    if count <= most:
        return distinct.select("vec")
    share = int(most / count * 1_000_000_000)
    return distinct.filter(F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1_000_000_000)) < share).select("vec")


def _trial(items: DataFrame, tree: Tree, trial: np.ndarray, size: int, kind: str, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Sizes of the leaves, and for every trial query the leaves of its true k neighbours, one per
    neighbour. One pass over all vectors; a task returns k rows per trial query."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(tree.leaves, np.int64)
        held = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64, np.int64)]
        for batch in vectors.pieces(batches, BATCH):
            rows = vectors.from_bytes(batch.column("vec"), size, kind)
            leaf = tree.assign(rows)
            sizes += np.bincount(leaf, minlength=tree.leaves)
            ids, at, lengths, first = _holders(batch.column("ids"))
            for q, r, exact in best_pairs(trial, rows, first, k + 1):
                own = (rows[r] == trial[q]).all(axis=1)
                q, r, exact = q[~own], r[~own], exact[~own]
                part, which = _spread(r, lengths, at)
                found = [q[part], exact[part], ids[which, 0], ids[which, 1], leaf[r][part]]
                held = _top([np.concatenate(x) for x in zip(held, found)], k)
        none = np.zeros(tree.leaves, np.int64)  # rows of the leaves come first
        both = [np.concatenate(x) for x in zip((none - 1, sizes.astype(float), none, none, np.arange(tree.leaves)), held)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["q", "score", "vec_id", "row", "leaf"])

    found = shared.written(items.mapInArrow(run, "q bigint, score double, vec_id bigint, row bigint, leaf bigint"))
    sizes = np.zeros(tree.leaves, np.int64)
    for row in found.filter("q < 0").groupBy("leaf").agg(F.sum("score").alias("n")).collect():  # a row per leaf
        sizes[row["leaf"]] = int(row["n"])
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    best = found.filter("q >= 0").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    leaves: list[list[int]] = [[] for _ in range(len(trial))]
    for row in best.select("q", "leaf").collect():  # k rows per trial query
        leaves[row["q"]].append(row["leaf"])
    return sizes, leaves


def _holders(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of (vec_id, row): all pairs, where each list begins, its length, its first id."""
    pairs = column.flatten()
    ids = np.column_stack([pairs.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("vec_id", "row")])
    offsets = column.offsets.to_numpy()
    at = (offsets - offsets[0])[:-1]
    return ids, at, np.diff(offsets), ids[at, 0] if len(at) else np.zeros(0, np.int64)


def _spread(r: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors ``r``, one after the other: which of them, and each of the rows that hold it."""
    many = lengths[r]
    part = np.repeat(np.arange(len(r)), many)
    return part, np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - at[r], many)


def _top(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best (query, score, vec_id, row, ...) of each query, in order."""
    order = np.lexsort((found[3], found[2], -found[1], found[0]))
    found = [x[order] for x in found]
    place = np.arange(len(order)) - np.searchsorted(found[0], found[0])
    return [x[place < k] for x in found]


def calibrated(tree: Tree, trial: np.ndarray, leaves: list[list[int]], recall: float) -> int:
    """The number of leaves to visit: doubled until the trial queries' recall is reached, then
    narrowed down."""
    wanted = sum(map(len, leaves))
    order = tree.visits(trial, tree.leaves)
    ranks = np.sort([w.index(leaf) for w, found in zip(order, leaves) for leaf in found])

    def reached(visits: int) -> bool:
        return np.searchsorted(ranks, visits) >= recall * wanted

    visits = 1
    while visits < tree.leaves and not reached(visits):
        visits *= 2
    low = visits // 2
    while visits - low > 1:
        middle = (low + visits) // 2
        low, visits = (low, middle) if reached(middle) else (middle, visits)
    return min(visits, tree.leaves)


def _in_cells(items: DataFrame, asked: DataFrame, tree: Tree, sizes: np.ndarray, visitors: np.ndarray, size: int, kind: str, k: int) -> DataFrame:
    """Rows found per query and cell: (qn, score, vec_id, row)."""
    slices = np.maximum(1, -(-sizes // CELL_ROWS))
    deals = -(-visitors // CELL_ROWS)  # none for a leaf that nobody visits

    def place_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in vectors.pieces(batches, BATCH):
            leaf = tree.assign(vectors.from_bytes(batch.column("vec"), size, kind))
            slice_ = (turn + np.arange(len(leaf))) % slices[leaf]
            turn += len(leaf)
            which = np.repeat(np.arange(len(leaf)), deals[leaf])
            deal = np.arange(len(which)) - np.repeat(np.cumsum(deals[leaf]) - deals[leaf], deals[leaf])
            for at in range(0, len(which), BATCH):
                w = which[at : at + BATCH]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.astype(np.int32)) for x in (leaf[w], slice_[w], deal[at : at + BATCH])), batch.column("vec").take(w), batch.column("ids").take(w)],
                    ["leaf", "slice", "deal", "vec", "ids"],
                )

    def place_queries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectors.pieces(batches, 256):
            number = batch.column("qn").to_numpy()
            visits = batch.column("leaves")
            which = np.repeat(np.arange(batch.num_rows), np.diff(visits.offsets.to_numpy()))
            leaf = visits.flatten().to_numpy()
            deal = number[which] % deals[leaf]
            many = slices[leaf]
            which, leaf, deal = (np.repeat(x, many) for x in (which, leaf, deal))
            slice_ = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            for at in range(0, len(which), BATCH):
                w = which[at : at + BATCH]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[at : at + BATCH].astype(np.int32)) for x in (leaf, slice_, deal)), *(batch.column(c).take(w) for c in ("qn", "vec", "floor"))],
                    ["leaf", "slice", "deal", "qn", "vec", "floor"],
                )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[np.zeros(0, t)] for t in (np.int64, np.float64, np.int64, np.int64)]
        if left.num_rows and right.num_rows:
            rows = vectors.from_bytes(left.column("vec"), size, kind)
            queries = vectors.from_bytes(right.column("vec"), size, kind)
            number = right.column("qn").to_numpy()
            ids, at, lengths, first = _holders(left.column("ids").combine_chunks())
            floor = right.column("floor").to_numpy()
            for q, r, exact in best_pairs(queries, rows, first, k, floor):
                part, which = _spread(r, lengths, at)
                for kept, new in zip(found, _top([number[q][part], exact[part], ids[which, 0], ids[which, 1]], k)):
                    kept.append(new)
        return pa.table({n: np.concatenate(x) for n, x in zip(("qn", "score", "vec_id", "row"), found)})

    left = items.mapInArrow(place_items, "leaf int, slice int, deal int, vec binary, ids array<struct<vec_id: bigint, row: bigint>>")
    right = asked.mapInArrow(place_queries, "leaf int, slice int, deal int, qn bigint, vec binary, floor double")
    cell = ("leaf", "slice", "deal")
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, "qn bigint, score double, vec_id bigint, row bigint")


def nearest(
    table: DataFrame, queries: Column | str, vector: str = "embedding", k: int = K, recall: float = RECALL, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE
) -> DataFrame:
    """The k rows with the largest inner product for every row that fulfils ``queries`` (a
    condition on ``vec_id``), over all other rows of the table.

    Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the smaller vec_id; all
    other rows if there are fewer. Scores are in double precision on the given vectors. ``recall``
    is reached on the trial queries (up to ``TRIAL_QUERIES`` of them); with one leaf the result is
    exact. The tree is fitted on about ``sample`` distinct vectors and has at most ``MAX_LEAVES``
    leaves (fewer if their centres had over ``TREE_NUMBERS`` components), beyond which leaves grow and
    are cut into slices; its centres go to every task.

    Vectors that are missing, zero or hold missing or non-finite components take no part. Shorter
    ones count as ending in zeros. A missing vec_id is larger than all others. Repeated rows are
    rows of their own: each is a query and a candidate of the others. Other columns are not looked
    at. An empty table gives an empty result.
    """
    spark = table.sparkSession
    size = vectors.longest(table, vector)
    kind = "<f4" if dict(table.dtypes)[vector] == "array<float>" else "<f8"
    rows = shared.written(_clean(table, vector, size, kind))
    # Only the first rows of equal vectors go into the shuffle.
    holders = Window.partitionBy("vec").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    first = rows.withColumn("n", F.row_number().over(holders)).filter(F.col("n") <= k + 1)
    holder = F.struct(F.coalesce("vec_id", F.lit(shared.NO_ID)).alias("vec_id"), "row")
    items = shared.written(first.groupBy("vec").agg(F.sort_array(F.collect_list(holder)).alias("ids")))
    wanted = rows.filter(queries)
    asked = shared.written(wanted.select("vec").distinct())
    count, many = items.count(), asked.count()
    if not many:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    fit = vectors.from_bytes(_sample(items, count, sample, 1).toArrow().column("vec"), size, kind)
    bound = min(MAX_LEAVES, max(1, TREE_NUMBERS // size), max(1, len(fit) // 4))
    tree = Tree.fit(fit, min(bound, max(1, round(count / leaf_rows))))
    trial = vectors.from_bytes(asked.orderBy(F.xxhash64("vec", F.lit(2)), "vec").limit(TRIAL_QUERIES).toArrow().column("vec"), size, kind)
    sizes, leaves = _trial(items, tree, trial, size, kind, k)
    visits = calibrated(tree, trial, leaves, recall)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in vectors.pieces(batches, 1024):
            found = tree.visits(vectors.from_bytes(batch.column("vec"), size, kind), visits, sizes, k + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(batch.num_rows), pa.int64()), batch.column("vec"), pa.array(found, pa.list_(pa.int32()))], ["qn", "vec", "leaves"]
            )
            number += batch.num_rows

    asked = shared.written(asked.mapInArrow(walk, "qn bigint, vec binary, leaves array<int>"))
    ends = [visits]
    while ends[0] >= WIDEN:
        ends.insert(0, ends[0] // WIDEN)
    wave = sum((F.col("pos") >= end).cast("int") for end in ends[:-1]) if ends[1:] else F.lit(0)
    visitors = np.zeros((len(ends), tree.leaves), np.int64)
    placed = asked.select(F.posexplode("leaves").alias("pos", "leaf")).groupBy(wave.alias("wave"), "leaf").count()
    for row in placed.collect():  # a row per wave and leaf
        visitors[row["wave"], row["leaf"]] = row["count"]

    hits = None
    order = Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id", "row")
    for number, (begin, end) in enumerate(zip([0, *ends], ends)):
        many = F.lit(tree.leaves) if end == visits else F.lit(end - begin)
        going = asked.select("qn", "vec", F.slice("leaves", F.lit(begin + 1), many).alias("leaves"))
        if hits is None:
            found = _in_cells(items, going.withColumn("floor", F.lit(float("-inf"))), tree, sizes, visitors[number], size, kind, k + 1)
        else:
            last = F.when(F.size("hits") > k, F.element_at("hits", -1)["score"]).otherwise(float("-inf"))
            going = going.join(hits.select("qn", last.alias("floor")), "qn", "left").fillna(float("-inf"), "floor")
            found = _in_cells(items, going, tree, sizes, visitors[number], size, kind, k + 1)
            found = found.unionByName(hits.select("qn", F.explode("hits").alias("h")).select("qn", "h.score", "h.vec_id", "h.row"))
        best = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
        hit = F.struct("n", "score", "vec_id", "row")
        hits = shared.written(best.groupBy("qn").agg(F.sort_array(F.collect_list(hit)).alias("hits")))
    mine = wanted.select(F.col("row").alias("own"), F.col("vec_id").alias("query_id"), "vec").join(asked.select("qn", "vec"), "vec").drop("vec")
    others = F.slice(F.filter("hits", lambda h: h["row"] != F.col("own")), 1, k)
    out = mine.join(hits, "qn").select("query_id", F.posexplode(others).alias("place", "hit"))
    vec_id = F.when(F.col("hit.vec_id") != shared.NO_ID, F.col("hit.vec_id"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), vec_id.alias("vec_id"), F.col("hit.score").alias("score"))


def op12_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """Contract query: vec_ids divisible by 20 against all embeddings."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)

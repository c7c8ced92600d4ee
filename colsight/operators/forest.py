"""Random forests whose histograms are sparse rows.

Trees grow level by level, all at once. In each level tasks walk their rows down the trees so far
and count (tree, node, feature, level, class); only combinations that occur are counted, a task sums
them up for its part of the rows and its group of trees, and the counts are rows of one aggregate. So neither the number of levels of a text feature nor that of
classes is an array anywhere, and no list of them reaches the driver: levels and classes go by
their 64-bit hashes. Splits are chosen by Spark from these rows: a text feature by one level
against all others (a 0/1 column per level), a number at a bin's edge. Only the chosen splits, at
most one per node, come back to the driver and go out with the next level's tasks.

Gains follow from sums of squares. With class counts ``T`` in a node and ``L`` on a side, the
decrease of Gini impurity times rows is ``sum(L^2)/|L| + sum(R^2)/|R| - sum(T^2)/|T|``, and
``sum(R^2) = sum(T^2) - 2 sum(T L) + sum(L^2)``: classes that a level does not hold are never
touched. Variances go the same way, with sums of the target in place of class counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.functions.exprs import dtype_of, is_number_or_bool, number, text, value
from colsight.operators.blocks import union_all
from colsight.session import materialize, release

BINS = 64
# Values a task holds at once, rows whose draws are made at once, and tasks at least (parts of the rows times groups of trees).
CELLS_AT_ONCE, ROWS_AT_ONCE, TASKS = 20_000_000, 65_536, 48
DENSE = 4  # counts are an array up to so many cells a row
NOISE = 1e-10  # gains below this share of a node's squares are rounding
# Shares of draws up to 0, 1, ... times, and the number of times by 12 leading bits, -1 where a step lies within.
STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
_ENDS = np.arange(2**12) / 2.0**12
LEADING = np.where(np.searchsorted(STEPS, _ENDS) == np.searchsorted(STEPS, _ENDS + (2.0**-12 - 2.0**-53)), np.searchsorted(STEPS, _ENDS), -1)
HISTOGRAM = "tree int, node int, feature int, level bigint, class bigint, w double, s double"


@dataclass
class Table:
    """Complete rows: ``rows`` (row, label, c0, c1, ...) with a bin or a hash per feature; ``numeric``
    tells bins from hashes."""

    rows: DataFrame
    features: list[str]
    numeric: list[bool]
    classify: bool
    count: int
    parts: int


@dataclass
class Trees:
    """Splits by tree and node; node k has the children 2k + 1 and 2k + 2. ``feature`` is -1 where a
    node is not split; rows go left whose bin is at most ``at``, or whose level is ``at``."""

    feature: np.ndarray
    at: np.ndarray
    gain: np.ndarray = field(repr=False)


def prepare(df: DataFrame, features: Sequence[str], target: str, classify: bool, bins: int = BINS) -> Table:
    """Rows without a gap in the features and the target. A number with at most ``bins`` distinct
    values is split between any two of them, others at approximate quantiles."""
    rows = df
    for n in [*features, target]:
        rows = rows.filter(value(df, n).isNotNull())
    numeric = [is_number_or_bool(dtype_of(df, n)) for n in features]
    label = F.xxhash64(value(df, target)) if classify else number(df, target)
    cells = [(number(df, n) if k else F.xxhash64(text(df, n))).alias(f"v{i}") for i, (n, k) in enumerate(zip(features, numeric))]
    plain = materialize(rows.select(label.alias("label"), *cells).filter(F.col("label").isNotNull()).withColumn("row", F.monotonically_increasing_id()))
    sums: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, k in enumerate(numeric):
        if k:
            sums.append(F.approx_count_distinct(f"v{i}").alias(f"d{i}"))
            sums.append(F.percentile_approx(f"v{i}", [j / bins for j in range(1, bins)], 10_000).alias(f"q{i}"))
    seen = plain.agg(*sums).first()
    out = []
    for i, k in enumerate(numeric):
        cell = F.col(f"v{i}")
        if k:
            few = seen[f"d{i}"] <= 2 * bins and sorted(r[0] for r in plain.select(cell).distinct().limit(bins + 1).collect())
            edges = few[:-1] if few and len(few) <= bins else sorted(set(seen[f"q{i}"] or []))
            # A value's bin is the number of edges below it.
            cell = _bin(cell, edges)
        out.append(cell.cast("bigint").alias(f"c{i}"))
    # Equal rows lie together; a part is what a task takes at once.
    parts = max(1, -(-seen["n"] * (len(features) + 2) // CELLS_AT_ONCE))
    order = [*[f"c{i}" for i in range(len(features))], "label", "row"]
    placed = plain.select("row", "label", *out).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return Table(materialize(placed), list(features), numeric, classify, seen["n"], parts)


def _bin(cell: Column, edges: Sequence[float]) -> Column:
    """Number of edges below a value."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < cell)) if edges else F.lit(0)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times(rows: np.ndarray, trees: int, seed: int, chosen: np.ndarray | None = None) -> np.ndarray:
    """How often each row is drawn for each tree (or the chosen ones): Poisson with mean 1, a
    function of row and tree. Leading bits that no step of the distribution shares are looked up."""
    which = np.arange(trees, dtype=np.uint64) if chosen is None else chosen.astype(np.uint64)
    keys = rows.astype(np.uint64)[None, :] * np.uint64(2 * trees + 1) + which[:, None]
    bits = _mixed(_mixed(keys + np.uint64(seed)))
    out = LEADING[bits >> np.uint64(52)]
    unsure = out < 0
    out[unsure] = np.searchsorted(STEPS, (bits[unsure] >> np.uint64(11)).astype(float) / 2.0**53)
    return out


def _gathered(batches: Iterable[pa.RecordBatch], names: Sequence[str], limit: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Rows for one group of trees, up to ``limit`` at once."""
    held: list[pa.RecordBatch] = []
    group, size = None, 0

    def whole() -> tuple[int, dict[str, np.ndarray]]:
        return group, {n: np.concatenate([b.column(n).to_numpy() for b in held]) for n in names}

    for batch in batches:
        if not batch.num_rows:
            continue
        its = batch.column("trees")[0].as_py()  # a partition is of one group
        if held and (its != group or size + batch.num_rows > limit):
            yield whole()
            held, size = [], 0
        group, size = its, size + batch.num_rows
        held.append(batch)
    if held:
        yield whole()


def _counted(table: Table, trees: Trees, depth: int, bootstrap: bool, seed: int) -> DataFrame:
    """Histogram rows of the nodes of one level."""
    rows = _counted_by_task(table, trees, depth, bootstrap, seed)
    return rows.groupBy("tree", "node", "feature", "level", "class").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))


def _counted_by_task(table: Table, trees: Trees, depth: int, bootstrap: bool, seed: int) -> DataFrame:
    """Histogram rows as tasks have them.

    A task takes a part of the rows and a group of the trees. Rows of equal cells lie together in a
    part; a tree draws them by row, sums the draws and walks each kind of row once.
    """
    names = [f"c{i}" for i in range(len(table.features))]
    numeric, classify = np.array(table.numeric), table.classify
    n_trees, first = len(trees.feature), 2**depth - 1
    split_by, split_at = trees.feature[:, :first].copy(), trees.at[:, :first].copy()
    groups = min(n_trees, -(-TASKS // table.parts))
    limit = max(1, CELLS_AT_ONCE // (len(names) + 2))

    def places(tree: int, levels: list[np.ndarray]) -> np.ndarray:
        """Split points of a tree as positions among the levels; -1 goes with no level."""
        out = np.full(first, -1)
        for f, known in enumerate(levels):
            mine = np.flatnonzero(split_by[tree] == f)
            at = split_at[tree, mine]
            if numeric[f]:
                out[mine] = np.searchsorted(known, at, "right") - 1
            else:
                spot = np.minimum(np.searchsorted(known, at), len(known) - 1)
                out[mine] = np.where(known[spot] == at, spot, -1)
        return out

    def drawn(tree: int, row: np.ndarray, kind: np.ndarray, kinds: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often a tree draws each kind of row, and the sums of the target of these."""
        w = np.zeros(kinds)
        s = w if classify else np.zeros(kinds)
        for a in range(0, len(row), ROWS_AT_ONCE):
            here = slice(a, a + ROWS_AT_ONCE)
            times = _times(row[here], n_trees, seed, np.array([tree]))[0].astype(float) if bootstrap else np.ones(len(row[here]))
            low, span = kind[a], kind[here] - kind[a]
            w[low : low + span[-1] + 1] += np.bincount(span, times)
            if not classify:
                s[low : low + span[-1] + 1] += np.bincount(span, times * label[here])
        return w, s

    def count(group: int, rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        label = rows["label"]
        new = np.ones(len(label), bool)
        new[1:] = False
        for column in [*(rows[n] for n in names), *([label] if classify else [])]:
            new[1:] |= column[1:] != column[:-1]
        start, kind = np.flatnonzero(new), np.cumsum(new) - 1
        levels, coded = zip(*(np.unique(rows[n][start], return_inverse=True) for n in names))
        cells = np.stack(coded)
        classes, k = np.unique(label[start], return_inverse=True) if classify else (np.zeros(1, np.int64), np.zeros(len(start), np.int64))
        for tree in range(group, n_trees, groups):
            w, s = drawn(tree, rows["row"], kind, len(start), label)
            some = np.flatnonzero(w)
            node, place = np.zeros(len(some), np.int64), places(tree, levels)
            for _ in range(depth):
                feature = split_by[tree, node]
                on = feature >= 0
                some, node, feature = some[on], node[on], feature[on]
                cell = cells[feature, some]
                left = np.where(numeric[feature], cell <= place[node], cell == place[node])
                node = 2 * node + np.where(left, 1, 2)
            if not len(some):
                continue
            for f in range(len(names)):
                key = ((node - first) * len(levels[f]) + cells[f, some]) * len(classes) + k[some]
                size = 2**depth * len(levels[f]) * len(classes)
                if size <= DENSE * len(key):
                    weight = np.bincount(key, w[some], size)
                    found = np.flatnonzero(weight)
                    weight, sums = weight[found], weight[found] if classify else np.bincount(key, s[some], size)[found]
                else:
                    found, which = np.unique(key, return_inverse=True)
                    weight = np.bincount(which, w[some], len(found))
                    sums = weight if classify else np.bincount(which, s[some], len(found))
                rest, c = np.divmod(found, len(classes))
                nd, lv = np.divmod(rest, len(levels[f]))
                columns = [np.full(len(found), tree, np.int32), (nd + first).astype(np.int32), np.full(len(found), f, np.int32), levels[f][lv], classes[c], weight, sums]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in HISTOGRAM.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _gathered(batches, ["row", "label", *names], limit):
            yield from count(group, rows)

    return union_all([table.rows.withColumn("trees", F.lit(g)) for g in range(groups)]).mapInArrow(run, HISTOGRAM)


def gains(histogram: DataFrame, numeric: Sequence[bool]) -> DataFrame:
    """(tree, node, feature, at, gain, least) of every split that leaves rows on both sides; ``s`` are
    class counts or sums of the target, gains up to ``least`` are rounding."""
    node = ["tree", "node"]
    totals = histogram.filter("feature = 0").groupBy(*node, "class").agg(F.sum("w").alias("tw"), F.sum("s").alias("ts"))
    nodes = totals.groupBy(*node).agg(F.sum("tw").alias("total"), F.sum(F.col("ts") * F.col("ts")).alias("squares"))
    cells = histogram.join(totals.select(*node, "class", "ts"), [*node, "class"])
    kinds = F.array(*[F.lit(bool(x)) for x in numeric])
    cells = cells.withColumn("number", F.element_at(kinds, F.col("feature") + 1))

    key = [*node, "feature", "level"]
    levels = cells.filter("NOT number").groupBy(*key).agg(
        F.sum("w").alias("left"), F.sum(F.col("s") * F.col("s")).alias("sl"), F.sum(F.col("s") * F.col("ts")).alias("cross")
    )
    # Up to a bin a class has the count ``up``; what the bin adds to the sum of squares is summed up in turn.
    by_class = Window.partitionBy(*node, "feature", "class").orderBy("level")
    up = F.sum("s").over(by_class)
    grown = cells.filter("number").withColumn("up", up)
    added = grown.groupBy(*key).agg(
        F.sum("w").alias("w"), F.sum(F.col("s") * (2 * F.col("up") - F.col("s"))).alias("more"), F.sum(F.col("s") * F.col("ts")).alias("x")
    )
    by_bin = Window.partitionBy(*node, "feature").orderBy("level")
    bins = added.select(*key, F.sum("w").over(by_bin).alias("left"), F.sum("more").over(by_bin).alias("sl"), F.sum("x").over(by_bin).alias("cross"))

    sides = levels.unionByName(bins).join(nodes, node).filter("left > 0 AND left < total")
    right = F.col("total") - F.col("left")
    squares_right = F.col("squares") - 2 * F.col("cross") + F.col("sl")
    gain = F.col("sl") / F.col("left") + squares_right / right - F.col("squares") / F.col("total")
    return sides.select(*node, "feature", F.col("level").alias("at"), gain.alias("gain"), (NOISE * F.col("squares") / F.col("total")).alias("least"))


def grow(table: Table, trees: int, depth: int, seed: int, bootstrap: bool = True, looked_at: int | None = None) -> Trees:
    """Trees of up to ``depth`` levels of splits. At every node ``looked_at`` features are drawn from
    those that can split it (None: all are looked at)."""
    size = 2 ** (depth + 1) - 1
    out = Trees(np.full((trees, size), -1), np.zeros((trees, size), np.int64), np.zeros((trees, size)))
    node = ["tree", "node"]
    for level in range(depth):
        histogram = materialize(_counted(table, out, level, bootstrap, seed))
        found = gains(histogram, table.numeric).filter("gain > least")
        if looked_at is not None and looked_at < len(table.features):
            draw = F.row_number().over(Window.partitionBy(*node).orderBy(F.xxhash64(*node, "feature", F.lit(seed))))
            drawn = found.select(*node, "feature").distinct().withColumn("draw", draw).filter(F.col("draw") <= looked_at)
            found = found.join(drawn.drop("draw"), [*node, "feature"])
        # Ties go to the feature named first and the smaller place.
        order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("at").cast("decimal(20,0)")).alias("a"), "feature", "at")
        best = found.groupBy(*node).agg(F.max(order).alias("b"))
        chosen = best.select(*node, "b.feature", "b.at", "b.gain").toArrow()  # a row per node
        release(histogram)
        if not chosen.num_rows:
            break
        t, n = (chosen.column(c).to_numpy() for c in node)
        for name in ("feature", "at", "gain"):
            getattr(out, name)[t, n] = chosen.column(name).to_numpy()
    return out


def importances(grown: Trees, features: int) -> np.ndarray:
    """Share of each feature in the decrease of impurity, averaged over trees; all 0 without a split."""
    per_tree = np.zeros((len(grown.feature), features))
    for f in range(features):
        per_tree[:, f] = np.where(grown.feature == f, grown.gain, 0).sum(axis=1)
    sums = per_tree.sum(axis=1, keepdims=True)
    mean = np.divide(per_tree, sums, out=np.zeros_like(per_tree), where=sums > 0).mean(axis=0)
    return mean / mean.sum() if mean.sum() > 0 else mean


def split_gains(df: DataFrame, features: Sequence[str], target: str, classify: bool, bins: int = BINS) -> DataFrame:
    """(feature, splits, best_gain): what a tree sees at its root, over all complete rows."""
    table = prepare(df, features, target, classify, bins)
    empty = Trees(np.full((1, 1), -1), np.zeros((1, 1), np.int64), np.zeros((1, 1)))
    found = gains(materialize(_counted(table, empty, 0, False, 0)), table.numeric)
    names = F.element_at(F.array(*[F.lit(n) for n in features]), F.col("feature") + 1)
    return found.groupBy(names.alias("feature")).agg(F.count(F.lit(1)).alias("splits"), F.max("gain").alias("best_gain"))

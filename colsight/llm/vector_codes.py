"""Vector code compression: product codes whose nearest entries come from memoised grid cells.

Vectors are cut into parts; each part position has a codebook of up to 256 entries. To assign a
part, its coarse grid cell is hashed. The first time a task meets a cell it compares, over the
cell's box, the smallest and the largest distance to every entry: an entry whose smallest
distance is above some other entry's largest one is never the nearest for any point of the box
and is left out. The rest is kept under the cell, and only those entries are evaluated exactly,
for this part and for all later ones of the cell. Distances to a box are sums over components,
read from tables of (component, coordinate, entry) that are made once per round.

All arithmetic is in integers. A round is one pass over the written vectors: tasks return sums
and counts per entry, at most ``parts x entries`` rows each, which Spark adds up. Codebooks are
all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm import shared, vectors

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
CELL = 32
MEMO_CELLS = 1 << 16
#: Squared distances of a whole vector must stay below this to be exact in doubles and longs.
EXACT = 1 << 53
BATCH = 4096


class Memo:
    """Nearest entries of one part position's codebook, found through memoised grid cells."""

    def __init__(self, book: np.ndarray, cell: int = CELL, most: int = MEMO_CELLS):
        self.book, self.cell, self.most = book, cell, most
        self.slots: dict[bytes, int] = {}
        self.kept = np.zeros((0, len(book)), bool)
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.evaluated = self.asked = 0

    def _table(self, column: int, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared smallest and largest distance of the entries to a coordinate's interval."""
        found = self.tables.get((column, at))
        if found is None:
            low = at * self.cell
            high = low + self.cell - 1
            e = self.book[:, column]
            near = np.maximum(np.maximum(low - e, e - high), 0)
            far = np.maximum(np.abs(e - low), np.abs(e - high))
            found = self.tables[column, at] = (near * near, far * far)
        return found

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        """For each cell the entries that may be nearest to a point of its box."""
        out = np.empty((len(cells), len(self.book)), bool)
        reach = int(np.abs(cells).max() + 1) * self.cell + int(np.abs(self.book).max())
        kind = np.int32 if cells.shape[1] * reach * reach < 2**31 else np.int64
        for start in range(0, len(cells), 512):
            some = cells[start : start + 512]
            near = np.zeros((len(some), len(self.book)), kind)
            far = np.zeros_like(near)
            for column in range(cells.shape[1]):
                values, which = np.unique(some[:, column], return_inverse=True)
                tables = [self._table(column, int(v)) for v in values]
                near += np.stack([t[0] for t in tables]).astype(kind)[which]
                far += np.stack([t[1] for t in tables]).astype(kind)[which]
            # An entry at the same distance may win by its lower number, so it stays.
            out[start : start + 512] = near <= far.min(axis=1, keepdims=True)
        return out

    def _known(self, cells: np.ndarray) -> np.ndarray:
        keys = vectors.rows_as_bytes(cells)
        new = [i for i, k in enumerate(keys) if k not in self.slots]
        if new and len(self.slots) + len(new) > self.most:
            self.slots, self.kept, new = {}, self.kept[:0], list(range(len(keys)))
        if new:
            base = len(self.kept)
            self.kept = np.concatenate([self.kept, self._undominated(cells[new])])
            self.slots.update((keys[i], base + n) for n, i in enumerate(new))
        return self.kept[[self.slots[k] for k in keys]]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties to the lower number) and squared distance of each part."""
        n = len(parts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not parts.shape[1]:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        cells, which = np.unique(parts // self.cell, axis=0, return_inverse=True)
        candidates = self._known(cells)
        sizes = candidates.sum(axis=1)
        entries = np.nonzero(candidates)[1]
        starts = np.cumsum(sizes) - sizes
        # Pairs (part, entry), parts in order, entries ascending.
        many = sizes[which]
        begin = np.cumsum(many) - many
        part = np.repeat(np.arange(n), many)
        entry = entries[np.arange(many.sum()) - np.repeat(begin - starts[which], many)]
        gap = parts[part] - self.book[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        self.asked, self.evaluated = self.asked + n, self.evaluated + len(entry)
        best = np.minimum.reduceat(distance, begin)
        hit = np.flatnonzero(distance == best[part])
        first = hit[np.unique(part[hit], return_index=True)[1]]
        return entry[first], best


@dataclass
class Codes:
    """``codes``: vec_id, label, code, error of every vector; ``books``: the final codebooks, an
    array of entries per part position."""

    codes: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position."""
        numbers = ",".join(str(x) for book in self.books for x in book.ravel().tolist())
        return hashlib.sha256(numbers.encode()).hexdigest()


def _integers(table: DataFrame, size: int, vector: str) -> DataFrame:
    """(vec_id, label, whole): floor(SCALE * x) of usable vectors, padded with zeros."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectors.pieces(batches, BATCH):
            scaled = np.floor(vectors.block(batch.column("v"), size) * SCALE)
            if scaled.size and 4 * size * np.abs(scaled).max() ** 2 >= EXACT:
                raise ValueError("Components are too large for exact squared distances.")
            whole = pa.ListArray.from_arrays(
                pa.array(np.arange(0, scaled.size + 1, size) if size else np.zeros(len(scaled) + 1), pa.int32()),
                pa.array(scaled.astype(np.int32).ravel(), pa.int32()),
            )
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), whole], ["vec_id", "label", "whole"])

    kind = dict(table.dtypes)["label"]
    kept = table.filter(vectors.usable(vector)).select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col(vector).alias("v"))
    return kept.mapInArrow(run, f"vec_id bigint, label {kind}, whole array<int>")


def _cut(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    whole = vectors.block(batch.column("whole"), size).astype(np.int64)
    return [np.ascontiguousarray(x) for x in np.split(whole, PARTS, axis=1)]


def _sums(whole: DataFrame, books: list[np.ndarray], size: int, cell: int) -> list[np.ndarray]:
    """Codebooks after one round: entries replaced by the floors of their parts' means."""
    width = size // PARTS
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b, cell) for b in books]
        sums = [np.zeros((len(b), width + 1), np.int64) for b in books]
        for batch in vectors.pieces(batches, BATCH):
            for memo, total, parts in zip(memos, sums, _cut(batch, size)):
                entry, _ = memo.nearest(parts)
                np.add.at(total, entry, np.column_stack([np.ones(len(parts), np.int64), parts]))
        for p, total in enumerate(sums):
            used = np.flatnonzero(total[:, 0])
            columns = [np.full(len(used), p), used, *total[used].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], ["part", "entry", "n", *names])

    schema = ", ".join(f"{n} bigint" for n in ("part", "entry", "n", *names))
    total = whole.select("whole").mapInArrow(run, schema).groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in ("n", *names)))
    out = [b.copy() for b in books]
    for row in total.collect():  # at most parts x entries rows
        out[row["part"]][row["entry"]] = [s // row["n"] for s in row[3:]]
    return out


def compress(table: DataFrame, vector: str = "embedding", rounds: int = ROUNDS, entries: int = ENTRIES, cell: int = CELL) -> Codes:
    """Product codes of the vectors of a table (vec_id, label and the vector column).

    Rows whose vector is missing or holds a missing or non-finite component are dropped. A
    component x counts as floor(1024 * x). Vectors of different lengths, or of one that four does
    not divide, end in zeros up to the next multiple of four. Codebooks start as the parts of the
    rows with the smallest vec_id (a missing one comes last; repeated ones by their components)
    and go through ``rounds`` rounds of assigning and averaging; repeated rows all count. Entries
    that no part uses stay. An empty table has empty codebooks. Components so large that squared
    distances leave 2**53 raise an error. Other columns are not looked at.
    """
    size = -(-vectors.longest(table, vector) // PARTS) * PARTS
    whole = shared.written(_integers(table, size, vector))
    seeds = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").toArrow()
    start = vectors.block(seeds.column("whole"), size).astype(np.int64)
    books = [np.ascontiguousarray(x) for x in np.split(start, PARTS, axis=1)]
    for _ in range(rounds if len(start) else 0):
        books = _sums(whole, books, size, cell)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b, cell) for b in books]
        for batch in vectors.pieces(batches, BATCH):
            found = [memo.nearest(parts) for memo, parts in zip(memos, _cut(batch, size))]
            codes = np.column_stack([e for e, _ in found]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array([c.tobytes().hex() for c in codes], pa.string()),
                    pa.array(sum(d for _, d in found), pa.int64()),
                ],
                ["vec_id", "label", "code", "error"],
            )

    codes = whole.mapInArrow(run, f"vec_id bigint, label {dict(whole.dtypes)['label']}, code string, error bigint")
    return Codes(codes, books)


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Contract query: all embeddings."""
    found = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = shared.written(found.codes)
    sums = shared.written(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    out = codes.join(shared.bounded(sums), codes["label"].eqNullSafe(sums["of"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    return f"""
near{k} AS MATERIALIZED (
    SELECT x.rid, x.p, any_value(x.x) AS x, min({{'d': coalesce(list_sum(list_transform(range(1, len(x.x) + 1),
        lambda i: (x.x[i] - b.x[i]) * (x.x[i] - b.x[i]))), 0)::BIGINT, 'e': b.e}}) AS m
    FROM parts x JOIN book{k} b ON b.p = x.p GROUP BY x.rid, x.p
)"""


def _book_sql(k: int) -> str:
    return f"""
sums{k} AS (
    SELECT p, e, pos, sum(v)::BIGINT AS s, count(*) AS c
    FROM (SELECT p, m.e AS e, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM near{k - 1}) GROUP BY p, e, pos
), means{k} AS (
    SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY pos) AS x FROM sums{k} GROUP BY p, e
), book{k} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM book{k - 1} b LEFT JOIN means{k} n ON n.p = b.p AND n.e = b.e
)"""


OP13_SQL = f"""
WITH kept AS (
    SELECT row_number() OVER () AS rid, vec_id, label,
           list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT rid, vec_id, v, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) t(p)
), book0 AS MATERIALIZED (
    SELECT p, n - 1 AS e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST, v) AS n FROM parts) WHERE n <= {ENTRIES}
), {", ".join(_round_sql(k) + "," + _book_sql(k + 1) for k in range(ROUNDS))}, {_round_sql(ROUNDS)}, coded AS (
    SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY rid
), digest AS (
    SELECT sha256(coalesce(string_agg(v::VARCHAR, ',' ORDER BY p, e, pos), '')) AS h
    FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM book{ROUNDS})
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (rid), digest
"""

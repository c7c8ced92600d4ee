"""Written intermediate tables and packs of documents.

A pack is a few MB of documents, compressed, with a number of its own. Operators that
compare n-grams of the whole corpus send sorted hash lists of packs to hash ranges
(``scatter``), merge each range in one task, and send what they found back to the packs
(``gather``). The lists of a pack hold each hash once, so a hash that stands in a third of
all documents is one entry per pack.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.session import materialize

PACK_BYTES = 8 << 20
PACK_ROWS = 50_000
PACKS_PER_RANGE = 2
KEY_BITS = 48
NO_ID = 2**63 - 1
BROADCAST_IDS = 1_000_000


def written(df: DataFrame) -> DataFrame:
    """Write a table that several jobs read, and read it back: its lineage ends here, and
    rows and their order in files no longer change when a task is repeated."""
    return materialize(df, "zstd")


def bounded(ids: DataFrame) -> DataFrame:
    """A written list of numbers, marked for a broadcast if its counted size allows; a larger
    one is joined by shuffling."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hash_ranges(packs: DataFrame) -> int:
    """Number of hash ranges for the lists of these packs: it grows with the corpus, so that a range
    has the keys of at most about ``PACKS_PER_RANGE`` packs, whatever the session's settings."""
    return max(partitions(packs.sparkSession), -(-packs.count() // PACKS_PER_RANGE))


def dump(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def load(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def batches_by_bytes(batch: pa.RecordBatch, column: str, most: int = PACK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece has up to ``most`` bytes of text (or one text)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    row = 0
    while row < batch.num_rows:
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + most, "right")))
        stop = min(stop, row + PACK_ROWS, batch.num_rows)
        yield batch.slice(row, stop - row)
        row = stop


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Write ``docs`` as packs: (pack, payload). Numbers are settled once written."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = rows = 0

        def flush() -> pa.RecordBatch:
            payload = dump(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([payload], pa.binary())], ["pack", "payload"]
            )

        for batch in batches:
            for piece in batches_by_bytes(batch, text):
                more = piece.column(text).nbytes
                if held and (size + more > PACK_BYTES or rows + piece.num_rows > PACK_ROWS):
                    yield flush()
                    number, held, size, rows = number + 1, [], 0, 0
                held.append(piece)
                size, rows = size + more, rows + piece.num_rows
        if held:
            yield flush()

    return written(docs.mapInArrow(pack, "pack bigint, payload binary"))


def _planes(a: np.ndarray) -> bytes:
    """Bytes of an integer array, all first bytes first: equal high bytes compress away."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""


def encode(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, and arrays beside them, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    parts = [(a.dtype.str, len(a), _planes(a)) for a in (steps, *more)]
    raw = pickle.dumps(parts, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def decode(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out = []
    for dtype, n, planes in pickle.loads(raw):
        kind = np.dtype(dtype)
        out.append(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel() if n else np.empty(0, kind))
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def ranges(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where each of ``buckets`` equal hash ranges begins in sorted keys (one entry more)."""
    bounds = np.array([-(-(i << bits) // buckets) for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)


LIST_SCHEMA = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("keys", pa.binary())])


def lists(pack: int, buckets: int, bits: int, keys: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, pack, keys) of sorted keys cut into hash ranges; empty ranges left out."""
    at = ranges(keys, buckets, bits)
    rows = [(b, encode(keys[x:y], *(m[x:y] for m in more))) for b, (x, y) in enumerate(zip(at, at[1:])) if y > x]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([b for b, _ in rows], pa.int32()),
            pa.array([pack] * len(rows), pa.int64()),
            pa.array([x for _, x in rows], pa.binary()),
        ],
        schema=LIST_SCHEMA,
    )


def scatter(packs: DataFrame, fn: Callable[[int, pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Apply ``fn(pack number, documents)`` to each pack; it yields batches of LIST_SCHEMA."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("pack"), batch.column("payload")):
                yield from fn(number.as_py(), load(payload.as_py()))

    return packs.mapInArrow(run, "bucket int, pack bigint, keys binary")


def merged(found: DataFrame, fn: Callable[[list[list[np.ndarray]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Merge each hash range: ``fn`` gets the decoded lists of all packs and yields (place of
    the list, or -1 for a reply to no pack, reply). Result: (pack, keys)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        packs = table.column("pack").to_pylist()
        replies = list(fn([decode(x.as_py()) for x in table.column("keys")]))
        return pa.table(
            {"pack": pa.array([packs[i] if i >= 0 else -1 for i, _ in replies], pa.int64()), "keys": pa.array([x for _, x in replies], pa.binary())}
        )

    return found.groupBy("bucket").applyInArrow(run, "pack bigint, keys binary")


def gather(packs: DataFrame, replies: DataFrame, fn: Callable[[int, pa.Table, list[list[np.ndarray]]], pa.Table], schema: str) -> DataFrame:
    """Bring replies back to their packs: ``fn(pack number, documents, decoded replies)``.
    Both sides of a pack are bounded by the size of a pack."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number = left.column("pack")[0].as_py()
        return fn(number, load(left.column("payload")[0].as_py()), [decode(x.as_py()) for x in right.column("keys")])

    return packs.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(run, schema)


def joined(replies: list[list[np.ndarray]], kinds: list[str]) -> list[np.ndarray]:
    """Replies of all hash ranges as one sorted list (ranges do not overlap)."""
    replies = sorted((r for r in replies if len(r[0])), key=lambda r: r[0][0])
    if not replies:
        return [np.empty(0, k) for k in kinds]
    return [np.concatenate(x) for x in zip(*replies)]


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted key: its place in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def ids(table: pa.Table, name: str = "doc_id") -> np.ndarray:
    """Document numbers; a missing one counts as larger than all others."""
    return table.column(name).combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)

"""Conversation structure repair by scalar big-integer weights.

Rows of a conversation are kept, given another role, or deleted, and empty turns are inserted, so
that the roles read ``(s?(ua)+)?`` at the smallest cost; of equally cheap ways the one whose audit
(the edits' initials in order) is ASCII-least counts. A way is one integer: its high digits are
the cost, its low digits, of fixed width, are the audit's letters from the first on, and zeros
fill the end. A dynamic program over rows and states (nothing yet, system, user, assistant) runs
from the last row to the first and takes integer minima only; a letter put in front moves the
others by one digit.

Rows are range-partitioned in the order of turns and cut into chunks. A conversation that lies
within one chunk is solved where it is. One that is cut, however long, is summed up per chunk by
4 x 4 costs and 4 x 4 ranks of audits, which is enough: a chunk's audits from one state end in
letters of rows, so none is the beginning of another, and equal costs are decided within the
first chunk that differs. Summaries are composed per range partition and then per conversation,
which settles the state at every cut, and the chunks are solved on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from colsight.llm import shared

CHUNK_TURNS = 1000
CHUNK_BYTES = 8 << 20
RERUN_ROWS = 64
START, SYSTEM, USER, ASSISTANT = range(4)
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
LETTERS = "\0DIKR"  # ASCII order; a digit is a letter's place, 0 fills the end
D, I, K, R = range(1, 5)
BITS = 3
FAR = 1 << 60
#: State after an opened turn that goes on legally without a system turn.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = (None, "system", "user", "assistant")
#: What the turns inserted at the end of a conversation cost.
CLOSING = (0, 2 * INSERT, INSERT, 0)

INT, LONG, TEXT = pa.int32(), pa.int64(), pa.string()
KEY = [("conv_id", LONG), ("part", INT), ("chunk", INT)]
TURN = pa.struct([("turn", LONG), ("role", TEXT), ("text", TEXT), ("copies", INT)])
NUMBERS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns_distinct", "turn_min", "turn_max")
EDITED = pa.struct([("edit", TEXT), ("turn", LONG), ("role", TEXT), ("text", TEXT)])
SOLVED = pa.schema(
    [*KEY, *((n, LONG) for n in NUMBERS), ("first", TEXT), ("last", TEXT), ("cost", LONG), ("audit", TEXT), ("repaired", pa.list_(EDITED))]
)
SUMMARY = pa.schema([*KEY, ("costs", pa.list_(LONG)), ("ranks", pa.list_(LONG))])
REPORT = pa.schema(
    [("conv_id", LONG), *((n, LONG) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", TEXT), ("repaired_sha256", TEXT)]
)


# ---------------------------------------------------------------- the dynamic program


def way(state: int, initial: str) -> int | None:
    """State after a turn of that initial, if it may come next."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def weights(code: str, leave: int) -> tuple[list[int | None], int]:
    """For every state before the rows the integer of the best way to ``leave`` (None: there is
    none), and the number of low bits that hold the audit.

    A row's code is its initial (``s``, ``u``, ``a``, or ``-`` for any other); upper case if the
    row is truncated (``+`` for any other); ``.`` if it must be deleted."""
    low = BITS * (3 * len(code) + 1)
    top, mask = low - BITS, (1 << low) - 1

    def front(letter: int, cost: int, w: int | None) -> int | None:
        return None if w is None else (((w >> low) + cost) << low) + (letter << top) + ((w & mask) >> BITS)

    def least(*found: int | None) -> int | None:
        return min((x for x in found if x is not None), default=None)

    after: list[int | None] = [0 if s == leave else None for s in range(4)]
    for c in reversed(code):
        cut = CUT if c.isupper() or c == "+" else 0
        edited = []
        for s in range(4):
            found = [front(D, DELETE, after[s])]
            if c != ".":
                found.append(front(R, REROLE + cut, after[NEXT[s]]))
                kept = way(s, c.lower())
                if kept is not None:
                    found.append(front(K, cut, after[kept]))
            edited.append(least(*found))
        # After two inserted turns a third would only repeat a state.
        once = [front(I, INSERT, edited[NEXT[s]]) for s in range(4)]
        after = [least(edited[s], once[s], front(I, INSERT, once[NEXT[s]])) for s in range(4)]
    return after, low


def audit_of(weight: int, low: int) -> str:
    digits = weight & ((1 << low) - 1)
    return "".join(LETTERS[(digits >> at) & 7] for at in range(low - BITS, -1, -BITS)).rstrip("\0")


def summary(code: str) -> tuple[np.ndarray, np.ndarray]:
    """Costs from every state to every state, and the ranks of the audits among those from one state."""
    costs, ranks = np.full((4, 4), FAR), np.zeros((4, 4), np.int64)
    ways = [weights(code, leave) for leave in range(4)]
    for s in range(4):
        audits = sorted((w[s] & ((1 << low) - 1), t) for t, (w, low) in enumerate(ways) if w[s] is not None)
        for rank, (_, t) in enumerate(audits):
            costs[s, t], ranks[s, t] = ways[t][0][s] >> ways[t][1], rank
    return costs, ranks


def composed(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Summary of two neighbouring stretches."""
    costs, ranks = np.full((4, 4), FAR), np.zeros((4, 4), np.int64)
    for s in range(4):
        order = []
        for t in range(4):
            cost, rank, m = min((first[0][s, m] + then[0][m, t], first[1][s, m], m) for m in range(4))
            if cost < FAR:
                costs[s, t] = cost
                order.append((rank, then[1][m, t], t))
        for rank, (_, _, t) in enumerate(sorted(order)):
            ranks[s, t] = rank
    return costs, ranks


def states(stretches: list[tuple[np.ndarray, np.ndarray]], entry: int, leave: int) -> list[int]:
    """State before every stretch and after the last one, on the best way from entry to leave."""
    cost = [0 if s == leave else FAR for s in range(4)]
    choices = []
    for costs, ranks in reversed(stretches):
        best = [min((int(costs[s, t]) + cost[t], int(ranks[s, t]), t) for t in range(4) if costs[s, t] < FAR) for s in range(4)]
        choices.append([t for _, _, t in best])
        cost = [c for c, _, _ in best]
    out = [entry]
    for choice in reversed(choices):
        out.append(choice[out[-1]])
    return out


def best_leave(whole: tuple[np.ndarray, np.ndarray]) -> int:
    """Last state of a conversation before the turns inserted at its end."""
    return min((whole[0][START, t] + CLOSING[t], whole[1][START, t], t) for t in range(4))[2]


def closed(code: str) -> tuple[int, str, int]:
    """(cost, audit, last state) of a conversation in one piece, without the inserted end."""
    found = []
    for leave in range(4):
        w, low = weights(code, leave)
        if w[START] is not None:
            found.append((w[START] + (CLOSING[leave] << low), leave, low))
    weight, leave, low = min(found)
    return (weight >> low) - CLOSING[leave], audit_of(weight, low), leave


# ---------------------------------------------------------------- rows of a chunk


@dataclass
class Rows:
    """Rows of a chunk after damage, with their codes and counts."""

    turns: list[tuple[int | None, str, str]]
    code: str
    counts: list


def inspected(turns: list[dict], firsts: set[int] | None) -> Rows:
    """Faults and counts. ``firsts``: places (in ``turns``) of rows whose role and text did not
    come earlier; None if the chunk is a whole conversation and can see for itself."""
    rows, code = [], []
    blank = duplicate = truncated = illegal = distinct = 0
    seen: set[tuple[str, str]] = set()
    least = most = None
    for place, t in enumerate(turns):
        turn, role, text = t["turn"], t["role"], t["text"]
        stripped = text.rstrip(SPACE)
        for copy in range(t["copies"]):
            again = bool(copy) or (place not in firsts if firsts is not None else (role, text) in seen)
            seen.add((role, text)) if firsts is None else None
            initial = role[:1]
            if rows and rows[-1][1][:1] + initial not in ("su", "ua", "au"):
                illegal += 1
            rows.append((turn, role, text))
            if not stripped:
                blank += 1
                code.append(".")
            elif again:
                duplicate += 1
                code.append(".")
            else:
                legal = initial if initial and initial in "sua" else "-"
                cut = stripped[-1] not in ".!?"
                truncated += cut
                code.append({"-": "+"}.get(legal, legal.upper()) if cut else legal)
            if turn is not None and turn != most:
                distinct += 1
                least, most = turn if least is None else least, turn
    ends = (rows[0][1][:1], rows[-1][1][:1]) if rows else (None, None)
    return Rows(rows, "".join(code), [len(rows), blank, duplicate, truncated, illegal, distinct, least, most, *ends])


def edited(rows: Rows, audit: str, entry: int) -> list[tuple[str, int | None, str, str]]:
    """(edit, turn, role, text) of the turns that an audit leaves."""
    out, state, given = [], entry, iter(rows.turns)
    for letter in audit:
        turn, role, text = (None, "", "") if letter == "I" else next(given)
        if letter == "D":
            continue
        state = way(state, role[:1]) if letter == "K" else NEXT[state]
        out.append((letter, turn, role if letter == "K" else NAMES[state], text))
    return out


def closing_turns(leave: int) -> list[tuple[str, None, str, str]]:
    return [("I", None, NAMES[s], "") for s in {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(leave, ())]


def _batches(rows: Iterable[tuple], kinds: pa.Schema, size: int = 512, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size; lists of tuples count by their texts."""
    held: list[tuple] = []
    weight = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in held], kinds)

    for row in rows:
        held.append(row)
        last = row[-1]
        weight += sum(len(x["text"]) for x in last if isinstance(x, dict)) if isinstance(last, list) else 0
        if len(held) >= size or weight >= most:
            yield flush()
            held, weight = [], 0
    if held:
        yield flush()


# ---------------------------------------------------------------- Spark


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after damage by ``crc32(conv_id:turn) % 20``:
    0 drops a row (copies 0), 1 empties its text, 2 takes out ``.!?``, 3 repeats it (copies 2), 4
    makes it the user's. Nulls are one space, in the hashed text too."""
    space = F.lit(" ")
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    return conversations.select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def chunks(ordered: DataFrame, turn: pa.StructType, limit: int, most: int = CHUNK_BYTES) -> DataFrame:
    """Rows sorted within range partitions as chunks: (conv_id, part, chunk, whole, turns) of up to
    about ``limit`` turns or ``most`` bytes. A chunk is whole if rows of other conversations of the
    partition lie before and behind it. ``turn`` names the columns of a turn."""
    schema = pa.schema([*KEY, ("whole", pa.bool_()), ("turns", pa.list_(turn))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number, alone = 0, False  # alone: the conversation at hand began behind another one
        rest: pa.Table | None = None

        def cut(table: pa.Table, ends: list[int], begins_alone: bool, ends_alone: bool) -> pa.RecordBatch:
            """Chunks that end at ``ends``; only the first and last may be pieces of conversations."""
            nonlocal number
            n = len(ends)
            whole = np.ones(n, bool)
            whole[0] &= begins_alone
            whole[-1] &= ends_alone
            starts = [0, *ends[:-1]]
            table = table.slice(0, ends[-1]).combine_chunks()
            columns = [table.column(f.name).combine_chunks().cast(f.type) for f in turn]
            turns = pa.StructArray.from_arrays(columns, fields=list(turn))
            lists = pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), turns)
            out = pa.RecordBatch.from_arrays(
                [
                    table.column("conv_id").combine_chunks().take(pa.array(starts)),
                    pa.array([part] * n, pa.int32()),
                    pa.array(range(number, number + n), pa.int32()),
                    pa.array(whole),
                    lists.cast(schema.field("turns").type),
                ],
                schema=schema,
            )
            number += n
            return out

        for batch in batches:
            for piece in shared.batches_by_bytes(batch, "text", most):
                for at in range(0, piece.num_rows, limit):
                    more = pa.Table.from_batches([piece.slice(at, limit)])
                    rest = more if rest is None else pa.concat_tables([rest, more])
                    ids = rest.column("conv_id")
                    plain = ids.fill_null(0).to_numpy()
                    missing = pc.is_null(ids).to_numpy()
                    ends = (np.flatnonzero((plain[1:] != plain[:-1]) | (missing[1:] != missing[:-1])) + 1).tolist()
                    if ends:
                        yield cut(rest, ends, alone, True)
                        rest, alone = rest.slice(ends[-1]), True
                    if rest.num_rows >= limit or rest.column("text").nbytes >= most:
                        yield cut(rest, [rest.num_rows], False, False)
                        rest, alone = None, False
        if rest is not None and rest.num_rows:
            yield cut(rest, [rest.num_rows], False, False)

    return ordered.mapInArrow(run, from_arrow_schema(schema))


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Solved rows of conversations in one chunk. Short ones are often alike in their codes."""
    again = lru_cache(maxsize=1 << 14)(closed)
    for batch in batches:
        for conv, part, chunk, turns in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "chunk", "turns"))):
            rows = inspected(turns, None)
            cost, audit, leave = (closed if len(rows.code) > RERUN_ROWS else again)(rows.code)
            end = closing_turns(leave)
            out = edited(rows, audit, START) + end
            yield (conv, part, chunk, *rows.counts, cost + CLOSING[leave], audit + "I" * len(end), _items(out))


def _items(turns: list[tuple]) -> list[dict]:
    return [dict(zip(("edit", "turn", "role", "text"), t)) for t in turns]


def _firsts(cut: DataFrame) -> DataFrame:
    """Places of rows in the chunks of cut conversations whose role and text come there for the
    first time: (c, p, k, firsts). Equal rows are combined before the shuffle."""
    rows = cut.select("conv_id", "part", "chunk", F.posexplode("turns").alias("place", "t")).filter("t.copies > 0")
    at = F.struct("part", "chunk", "place")
    first = rows.groupBy("conv_id", F.col("t.role").alias("role"), F.sha2("t.text", 256).alias("digest")).agg(F.min(at).alias("at"))
    return first.groupBy(F.col("conv_id").alias("c"), F.col("at.part").alias("p"), F.col("at.chunk").alias("k")).agg(
        F.collect_list("at.place").alias("firsts")
    )


def _same(left: DataFrame, *names: str):
    """Join condition on the first columns of KEY, renamed c, p, k on the other side."""
    out = left["conv_id"].eqNullSafe(F.col("c"))
    for name, other in zip(names, "pk"):
        out &= left[name] == F.col(other)
    return out


def _summaries(cut: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    costs, ranks = summary(inspected(r["turns"], set(r["firsts"] or ())).code)
                    yield (r["conv_id"], r["part"], r["chunk"], costs.ravel().tolist(), ranks.ravel().tolist())

        return _batches(rows(), SUMMARY)

    return cut.mapInArrow(run, from_arrow_schema(SUMMARY))


def _stretches(table: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.array(c).reshape(4, 4), np.array(r).reshape(4, 4)) for c, r in zip(table["costs"], table["ranks"])]


def _folded(summaries: DataFrame) -> DataFrame:
    """One summary per conversation and range partition."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("chunk")
        whole, *others = _stretches(table)
        for s in others:
            whole = composed(whole, s)
        out = table[["conv_id", "part"]].head(1).copy()
        out["costs"], out["ranks"] = [whole[0].ravel().tolist()], [whole[1].ravel().tolist()]
        return out

    return summaries.groupBy("conv_id", "part").applyInPandas(run, "conv_id bigint, part int, costs array<bigint>, ranks array<bigint>")


def _part_cuts(parts: DataFrame) -> DataFrame:
    """States before and behind each range partition of a conversation; a group has 32 numbers
    per partition."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("part")
        stretches = _stretches(table)
        whole = stretches[0]
        for s in stretches[1:]:
            whole = composed(whole, s)
        way = states(stretches, START, best_leave(whole))
        out = table[["conv_id", "part"]].copy()
        out["entry"], out["leave"], out["closing"] = way[:-1], way[1:], np.arange(len(out)) == len(out) - 1
        return out.rename(columns={"conv_id": "c", "part": "p"})

    return parts.groupBy("conv_id").applyInPandas(run, "c bigint, p int, entry int, leave int, closing boolean")


def _chunk_cuts(placed: DataFrame) -> DataFrame:
    """States before and behind each chunk of a conversation in a range partition."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("chunk")
        way = states(_stretches(table), int(table["entry"].iloc[0]), int(table["leave"].iloc[0]))
        out = table[["conv_id", "part", "chunk"]].copy()
        out["entry"], out["leave"] = way[:-1], way[1:]
        out["closing"] = (np.arange(len(out)) == len(out) - 1) & table["closing"].to_numpy()
        return out.rename(columns={"conv_id": "c", "part": "p", "chunk": "k"})

    return placed.groupBy("conv_id", "part").applyInPandas(run, "c bigint, p int, k int, entry int, leave int, closing boolean")


def _pieces(cut: DataFrame) -> DataFrame:
    """Chunks of cut conversations, solved between the states at their ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    found = inspected(r["turns"], set(r["firsts"] or ()))
                    w, low = weights(found.code, r["leave"])
                    weight, end = w[r["entry"]], closing_turns(r["leave"]) if r["closing"] else []
                    audit = audit_of(weight, low)
                    out = edited(found, audit, r["entry"]) + end
                    cost = (weight >> low) + INSERT * len(end)
                    yield (r["conv_id"], r["part"], r["chunk"], *found.counts, cost, audit + "I" * len(end), _items(out))

        return _batches(rows(), SOLVED)

    return cut.mapInArrow(run, from_arrow_schema(SOLVED))


def _reported(solved: DataFrame) -> DataFrame:
    """A row per conversation from solved chunks that lie together in order. Chunks are read one
    by one; what is held of a conversation is its audit and the state of the hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            owner, held = (), None
            for batch in batches:
                for r in batch.to_pylist():
                    if (r["conv_id"],) != owner:
                        if held:
                            yield held.row()
                        owner, held = (r["conv_id"],), _Report(r["conv_id"])
                    held.add(r)
            if held:
                yield held.row()

        return _batches(rows(), REPORT)

    return solved.mapInArrow(run, from_arrow_schema(REPORT))


class _Report:
    def __init__(self, conv: int | None):
        self.conv, self.audit, self.hash, self.begun = conv, [], hashlib.sha256(), False
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns_distinct"), 0)
        self.least = self.most = self.last = None

    def add(self, chunk: dict) -> None:
        for name in self.sums:
            self.sums[name] += chunk[name]
        if chunk["rows"]:
            if self.last is not None and self.last + chunk["first"] not in ("su", "ua", "au"):
                self.sums["illegal"] += 1
            self.last = chunk["last"]
        if chunk["turn_min"] is not None:
            self.sums["turns_distinct"] -= chunk["turn_min"] == self.most
            self.least = chunk["turn_min"] if self.least is None else self.least
            self.most = chunk["turn_max"]
        self.audit.append(chunk["audit"])
        for t in chunk["repaired"]:
            self.hash.update((("\n" if self.begun else "") + f"{t['role']}:{t['text']}").encode())
            self.begun = True

    def row(self) -> tuple:
        s = self.sums
        gaps = 0 if self.least is None else self.most - self.least + 1 - s["turns_distinct"]
        return (self.conv, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(self.audit), self.hash.hexdigest())


@dataclass
class Repaired:
    """``whole`` and ``cut``: solved chunks of conversations in one chunk and in several."""

    whole: DataFrame
    cut: DataFrame

    def turns(self) -> DataFrame:
        """The repaired conversations, a row per turn: conv_id, part, chunk, place (their order),
        edit (K, R, I), turn (of the given row), role, text."""
        both = self.whole.unionByName(self.cut)
        return both.select("conv_id", "part", "chunk", F.posexplode("repaired").alias("place", "t")).select(
            "conv_id", "part", "chunk", "place", "t.edit", "t.turn", "t.role", "t.text"
        )

    def reports(self) -> DataFrame:
        """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
        repaired_sha256 (of the repaired ``role:text``, newline-joined)."""
        cut = self.cut.repartition(shared.partitions(self.cut.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "chunk")
        return _reported(self.whole).unionByName(_reported(cut))


def repair(turns: DataFrame) -> Repaired:
    """Repair conversations (conv_id, turn, role, text, copies) at the smallest cost.

    ``copies`` says how often a row stands there; a conversation of which all rows have 0 is
    reported as empty. Rows are taken by turn (missing ones first), those of one turn by role and
    text. A row's first fault counts: blank, duplicate (role and text came before), truncated (the
    last character that is not white space is none of ``.!?``). Blank and duplicate rows must be
    deleted (3); a row may get the role user or assistant (2), an empty turn of these may be
    inserted anywhere (2), and a truncated row that stays costs 1. Only a role's first letter
    decides whether it may stand; a role without one can't be kept.

    Missing roles and texts count as one space; rows without conv_id are one conversation. Repeated
    rows are duplicates. Texts and conversations may be of any length. Other columns are not
    looked at. An empty table gives empty results.
    """
    space = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        F.col("copies").cast("int").alias("copies"),
    )
    # Long texts are not sampled whole; equal rows may be cut apart by number.
    head, digest, row = F.substring("text", 1, 64), F.sha2("text", 256), F.monotonically_increasing_id()
    keyed = rows.withColumns({"head": head, "digest": F.when(F.length("text") > 64, digest), "row": row})
    by = ["conv_id", "turn", "role", "head", "digest", "row"]
    ordered = keyed.repartitionByRange(shared.partitions(turns.sparkSession), *by).sortWithinPartitions(*by).select(*rows.columns)
    pieces = shared.written(chunks(ordered, TURN, CHUNK_TURNS))

    whole = pieces.filter("whole").mapInArrow(lambda batches: _batches(_whole(batches), SOLVED), from_arrow_schema(SOLVED))

    cut = pieces.filter("NOT whole")
    # Conversations at the edges of partitions are mostly whole as well, but only a look at both sides tells.
    firsts = _firsts(cut)
    cut = shared.written(cut.join(firsts, _same(cut, "part", "chunk"), "left").select("conv_id", "part", "chunk", "turns", "firsts"))
    summaries = shared.written(_summaries(cut))
    parts = _part_cuts(_folded(summaries))
    placed = summaries.join(parts, _same(summaries, "part")).select(*summaries.columns, "entry", "leave", "closing")
    cuts = _chunk_cuts(placed)
    solved = _pieces(cut.join(cuts, _same(cut, "part", "chunk")).select(*cut.columns, "entry", "leave", "closing"))
    return Repaired(whole, solved)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Contract query: all conversations, damaged and repaired."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).reports()


#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1),
    lambda i: ord(substr({0}, i, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))))"""

OP11_SQL = rf"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations
), hit AS (
    SELECT *, {_CRC.format("k")} % 20 AS kind FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM hit WHERE kind <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           rtrim(text, E' \t\n\x0b\x0c\r') AS stripped
    FROM damaged
), looked AS (
    SELECT *, substr(role, 1, 1) AS initial, stripped = '' AS is_blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM ordered
), faults AS (
    SELECT *, CASE WHEN is_blank THEN 'b' WHEN again THEN 'd' WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
    FROM looked
), gap(st, ins, mid, price, turns) AS (
    VALUES (0, '', 0, 0, []::VARCHAR[]), (1, '', 1, 0, []), (2, '', 2, 0, []), (3, '', 3, 0, []),
           (0, 'I', 2, 2, ['user:']), (1, 'I', 2, 2, ['user:']), (2, 'I', 3, 2, ['assistant:']), (3, 'I', 2, 2, ['user:']),
           (0, 'II', 3, 4, ['user:', 'assistant:']), (1, 'II', 3, 4, ['user:', 'assistant:']),
           (2, 'II', 2, 4, ['assistant:', 'user:']), (3, 'II', 3, 4, ['user:', 'assistant:'])
), step(mid, letter, initial, nxt, price, role) AS (
    VALUES (0, 'D', NULL, 0, 3, NULL), (1, 'D', NULL, 1, 3, NULL), (2, 'D', NULL, 2, 3, NULL), (3, 'D', NULL, 3, 3, NULL),
           (0, 'R', NULL, 2, 2, 'user'), (1, 'R', NULL, 2, 2, 'user'), (2, 'R', NULL, 3, 2, 'assistant'), (3, 'R', NULL, 2, 2, 'user'),
           (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (3, 'K', 'u', 2, 0, NULL)
), paths AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS st, {{'cost': 0::BIGINT, 'audit': '', 'body': []::VARCHAR[]}} AS best FROM conversations
    UNION ALL
    SELECT p.conv_id, p.i + 1, s.nxt, min({{
        'cost': p.best.cost + g.price + s.price + CASE WHEN f.fault = 't' AND s.letter <> 'D' THEN 1 ELSE 0 END,
        'audit': p.best.audit || g.ins || s.letter,
        'body': p.best.body || g.turns || CASE WHEN s.letter = 'D' THEN []::VARCHAR[] ELSE [coalesce(s.role, f.role) || ':' || f.text] END}})
    FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
    JOIN gap g ON g.st = p.st
    JOIN step s ON s.mid = g.mid AND (s.letter = 'D' OR f.fault NOT IN ('b', 'd')) AND (s.initial IS NULL OR s.initial = f.initial)
    GROUP BY p.conv_id, p.i, s.nxt
), counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id
), ended AS (
    SELECT p.conv_id, min({{'cost': p.best.cost + g.price, 'audit': p.best.audit || g.ins, 'body': p.best.body || g.turns}}) AS best
    FROM paths p LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
    JOIN gap g ON g.st = p.st AND g.mid IN (0, 3)
    WHERE p.i = coalesce(c.n, 0)
    GROUP BY p.conv_id
)
SELECT e.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit,
       sha256(array_to_string(e.best.body, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

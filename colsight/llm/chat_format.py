"""Chat formatting with minimum-cost role repair.

Legal turns: at most one system turn, first; then user and assistant take turns, user first. A
dynamic program over this automaton (nothing yet, system, user, assistant) decides for every
given turn whether it opens a turn under its role, opens one under another role (relabel),
joins the turn before (merge), and whether an empty turn is inserted in front; the sum of
costs is smallest.

A conversation may be of any length. Rows are range-partitioned in the order of turns and cut
into chunks. A conversation that lies within one chunk is repaired where it is, without another
shuffle. Of one that is cut a chunk is summed up by the cheapest way from each state to each
state, 4 x 4 numbers; these are composed per conversation, which fixes the state at every cut, and
then the chunks are repaired on their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsight.llm import shared
from colsight.llm.conversation_repair import chunks

CHUNK_TURNS = 1000
BATCH_ROWS, BATCH_TEXT = 4096, 8 << 20
MERGE, INSERT, RELABEL = 1, 2, 3
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
PIECES = (
    "conv_id bigint, part int, chunk int, local bigint, piece bigint, role string, text string, action string, "
    "cost bigint, rendered string"
)


def options(state: int, role: str | None) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(next state, cost, action, states of inserted turns) for a turn, the preferred ones first."""
    given = ROLES.index(role) + 1 if role in ROLES else None
    out = []
    for new in (SYSTEM, USER, ASSISTANT):
        if new == SYSTEM:
            inserted = () if state == START else None
        elif new == USER:
            inserted = (ASSISTANT,) if state == USER else ()
        else:
            inserted = () if state == USER else (USER,)
        if inserted is not None:
            action = "keep" if new == given else "relabel"
            out.append((new, INSERT * len(inserted) + (0 if new == given else RELABEL), action, inserted))
    if state != START:
        out.append((state, MERGE + (0 if state == given else RELABEL), "merge", ()))
    return sorted(out, key=lambda o: o[1])


_OPTIONS = {(s, r): options(s, r) for s in range(4) for r in (*ROLES, None)}


def _known(role: str | None) -> str | None:
    return role if role in ROLES else None


def chunk_costs(roles: list[str | None]) -> np.ndarray:
    """Smallest cost from every state before the turns to every state after them."""
    cost = np.where(np.eye(4, dtype=bool), 0, FAR)
    for role in roles:
        after = np.full((4, 4), FAR)
        for state in range(4):
            for new, price, _, _ in _OPTIONS[state, role]:
                after[:, new] = np.minimum(after[:, new], cost[:, state] + price)
        cost = after
    return np.minimum(cost, FAR)


def path(roles: list[str | None], entry: int, leave: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """The cheapest options that lead from ``entry`` to ``leave``; of equal ones the first found."""
    best = {entry: (0, None)}
    steps = []
    for role in roles:
        now: dict[int, tuple[int, tuple]] = {}
        for state in sorted(best):
            for option in _OPTIONS[state, role]:
                price = best[state][0] + option[1]
                if option[0] not in now or price < now[option[0]][0]:
                    now[option[0]] = (price, (state, option))
        steps.append(now)
        best = now
    out, state = [], leave
    for now in reversed(steps):
        state, option = now[state][1]
        out.append(option)
    return out[::-1]


def _summed(cut: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, costs) of chunks of conversations that are cut."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [chunk_costs([_known(t["role"]) for t in turns]).ravel().tolist() for turns in batch.column("turns").to_pylist()]
            columns = [batch.column(c) for c in ("conv_id", "part", "chunk")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "part", "chunk", "costs"])

    return cut.mapInArrow(run, "conv_id bigint, part int, chunk int, costs array<bigint>")


def _cuts(sums: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, entry, leave, closing): states at the ends of every chunk. A group
    holds 16 numbers per CHUNK_TURNS turns of a conversation that is cut."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["part", "chunk"], kind="stable").reset_index(drop=True)
        costs = [np.array(c).reshape(4, 4) for c in table["costs"]]
        totals = [np.array([0, FAR, FAR, FAR])]
        for c in costs:
            totals.append((totals[-1][:, None] + c).min(axis=0))
        state = int(np.argmin(totals[-1]))
        ends = [state]
        for k in range(len(costs) - 1, -1, -1):
            state = int(np.argmin(totals[k] + costs[k][:, state]))
            ends.append(state)
        ends.reverse()
        out = table[["conv_id", "part", "chunk"]].copy()
        out["entry"], out["leave"] = ends[:-1], ends[1:]
        out["closing"] = np.arange(len(out)) == len(out) - 1
        return out

    schema = "conv_id bigint, part int, chunk int, entry int, leave int, closing boolean"
    return sums.groupBy("conv_id").applyInPandas(run, schema)


def _repaired(placed: DataFrame) -> DataFrame:
    """A row per given or inserted turn, numbered within its chunk."""

    def rows(conv, part, chunk, turns, entry=START, leave=None, closing=True) -> list[list]:
        roles = [_known(t["role"]) for t in turns]
        leave = int(np.argmin(chunk_costs(roles)[entry])) if leave is None else leave
        out: list[list] = []
        local, piece = 0, 0
        begun = entry != START

        def opened(state: int, text: str, action: str, cost: int) -> None:
            nonlocal local, piece, begun
            local, piece = local + 1, 1
            head = ("<|end|>\n" if begun else "") + f"<|{ROLES[state - 1]}|>\n"
            begun = True
            out.append([conv, part, chunk, local, piece, ROLES[state - 1], text, action, cost, head + text])

        for turn, (state, cost, action, inserted) in zip(turns, path(roles, entry, leave)):
            text = turn["text"] or ""
            for s in inserted:
                opened(s, "", "insert", INSERT)
            cost -= INSERT * len(inserted)
            if action == "merge":
                piece += 1
                out.append([conv, part, chunk, local, piece, ROLES[state - 1], text, action, cost, "\n" + text])
            else:
                opened(state, text, action, cost)
        if closing:
            out[-1][-1] += "<|end|>\n"
        return out

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in PIECES.split(", ")]

    def batch_of(held: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                done = rows(**{"conv" if k == "conv_id" else k: row[k] for k in row if k != "whole"})
                held += done
                size += sum(len(r[6]) for r in done)
                if len(held) >= BATCH_ROWS or size >= BATCH_TEXT:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return placed.mapInArrow(run, PIECES)


def format_chats(conversations: DataFrame) -> DataFrame:
    """Repair the roles of conversations (conv_id, turn, role, text) and render them.

    Returns a row per given or inserted turn: conv_id, turn (from 1, in the repaired
    conversation), piece (from 1, merged texts of a turn in order), role, text, action (keep,
    relabel, merge, insert), cost and rendered. The ``rendered`` strings of a conversation in
    the order of turn and piece make up its text. Costs are MERGE, INSERT and RELABEL; a merge
    under another role costs both.

    Rows are ordered by turn, role, text; a missing turn comes first. Repeated rows are turns
    of their own. A missing or unknown role has to be relabelled (or merged), a missing text is
    empty, rows without conv_id form one conversation. Texts and conversations may be of any
    length; an empty table gives an empty result. Other columns are not looked at.
    """
    spark = conversations.sparkSession
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "role", "text", "row"]  # equal rows may be cut apart by number
    ordered = turns.repartitionByRange(shared.partitions(spark), *order).sortWithinPartitions(*order)
    pieces_of = shared.written(chunks(ordered.drop("row"), TURN, CHUNK_TURNS))
    place = ["conv_id", "part", "chunk", "turns"]
    whole = _repaired(pieces_of.filter("whole").select(*place))
    out = ["conv_id", F.col("local").alias("turn"), "piece", "role", "text", "action", "cost", "rendered"]

    cut = pieces_of.filter("NOT whole").select(*place)
    cuts = _cuts(_summed(cut)).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("chunk").alias("k"), "entry", "leave", "closing")
    same = [cut["conv_id"].eqNullSafe(F.col("c")), cut["part"] == F.col("p"), cut["chunk"] == F.col("k")]
    pieces = shared.written(_repaired(cut.join(cuts, same).select(*place, "entry", "leave", "closing")))
    return whole.select(*out).unionByName(_located(pieces))


def _located(pieces: DataFrame) -> DataFrame:
    """Number the turns of conversations that were cut, and the pieces of each turn."""
    # Turns opened in earlier chunks; a chunk that goes on with a turn starts with local 0.
    sizes = pieces.groupBy("conv_id", "part", "chunk").agg(F.max("local").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("chunk").alias("k"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    same = [pieces["conv_id"].eqNullSafe(F.col("c")), pieces["part"] == F.col("p"), pieces["chunk"] == F.col("k")]
    located = pieces.join(sizes, same)
    turn = F.col("before") + F.col("local")
    # Pieces that go on with a turn of an earlier chunk come after all of that chunk's.
    counted = located.select("*", turn.alias("turn"))
    parts = counted.groupBy("conv_id", "turn", "part", "chunk").agg(F.max("piece").alias("n"))
    behind = Window.partitionBy("conv_id", "turn").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("part").alias("p2"), F.col("chunk").alias("k2"),
        F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("shift"),
    )
    same = [
        counted["conv_id"].eqNullSafe(F.col("c2")), counted["turn"] == F.col("t2"), counted["part"] == F.col("p2"), counted["chunk"] == F.col("k2"),
    ]
    return counted.join(parts, same).select("conv_id", "turn", (F.col("piece") + F.col("shift")).alias("piece"), "role", "text", "action", "cost", "rendered")


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

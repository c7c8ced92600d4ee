import itertools
import random
import re

import pytest

from colsight.llm import chat_format as chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, c string, row int"


def cheapest(roles):
    """Smallest cost over all sequences of options, by trying all."""
    best = None
    for choice in itertools.product(range(4), repeat=len(roles)):
        state, cost = chat.START, 0
        for role, k in zip(roles, choice):
            ways = chat.options(state, role)
            if k >= len(ways):
                break
            state, cost = ways[k][0], cost + ways[k][1]
        else:
            best = cost if best is None else min(best, cost)
    return best


def legal(roles):
    return re.fullmatch("s?(ua)*u?", "".join(r[0] for r in roles)) is not None


@pytest.mark.parametrize("size", [1000, 2])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "CHUNK_TURNS", size)
    rng = random.Random(5)
    given = {}
    for conv in range(40):
        given[conv] = [rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]) for _ in range(rng.randrange(1, 7))]
    rows = [(c, k, r, f"t{c}x{k}", "p", "c", 1) for c, roles in given.items() for k, r in enumerate(roles)]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "turn", "piece").collect()
    for conv, roles in given.items():
        mine = [r for r in out if r.conv_id == conv]
        assert sum(r.cost for r in mine) == cheapest(roles), roles
        opened = [r for r in mine if r.action != "merge"]
        assert legal([r.role for r in opened]) and [r.turn for r in opened] == list(range(1, len(opened) + 1))
        assert [r.text for r in mine if r.action != "insert"] == [f"t{conv}x{k}" for k in range(len(roles))]
        for t, group in itertools.groupby(mine, key=lambda r: r.turn):
            group = list(group)
            assert [r.piece for r in group] == list(range(1, len(group) + 1)) and len({r.role for r in group}) == 1
        turns = [(x, "\n".join(r.text for r in mine if r.turn == t)) for t, x in ((r.turn, r.role) for r in opened)]
        assert "".join(r.rendered for r in mine) == "".join(f"<|{x}|>\n{text}<|end|>\n" for x, text in turns)


def test_given_table(spark, sf_dir, con):
    rows = con.execute("SELECT conv_id, count(*) FROM conversations GROUP BY 1").fetchall()
    out = chat.op5_chat_format(spark, sf_dir).collect()
    given = {c: n for c, n in rows}
    kept = {}
    for r in out:
        kept[r.conv_id] = kept.get(r.conv_id, 0) + (r.action != "insert")
    assert kept == given


def test_edges(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, 0, "user", "q"), (1, 0, "user", "q"), (1, None, "assistant", ""), (2, 5, "system", "s" * 100_000)]
    df = spark.createDataFrame([(*r, "p", "c", 1) for r in rows], SCHEMA)
    out = chat.format_chats(df).orderBy("conv_id", "turn", "piece").collect()
    assert [(r.conv_id, r.turn, r.role, r.action) for r in out if r.conv_id == 1] == [
        (1, 1, "user", "insert"), (1, 2, "assistant", "keep"), (1, 3, "user", "keep"), (1, 3, "user", "merge"),
    ]
    assert len([r for r in out if r.conv_id is None]) >= 2 and len([r for r in out if r.conv_id == 2]) == 1
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0

import itertools
import random
import re

import duckdb
import pandas as pd
import pytest

from checks.compare import differences
from colsight.llm import conversation_repair as cr

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, c string, copies string, row int"


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return con.execute(cr.OP11_SQL).df()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "c", "x", 1) for r in rows], SCHEMA)


def cheapest(code):
    """Smallest (cost, audit) over all edits with up to two inserted turns in every gap."""
    best = None
    gaps = ("", "I", "II")
    for edits in itertools.product("DKR", repeat=len(code)):
        if any(c == "." and e != "D" for c, e in zip(code, edits)):
            continue
        for ins in itertools.product(gaps, repeat=len(code) + 1):
            audit = "".join(i + e for i, e in zip(ins, edits)) + ins[-1]
            given, roles = iter(code), ""
            for letter in audit:
                c = "" if letter == "I" else next(given)
                if letter == "K":
                    roles += c.lower()
                elif letter in "IR":
                    roles += "a" if roles.endswith("u") else "u"
            if not re.fullmatch("(s?(ua)+)?", roles):
                continue
            cost = sum({"D": 3, "R": 2, "K": 0, "I": 2}[x] for x in audit)
            cost += sum(1 for c, e in zip(code, edits) if e != "D" and (c.isupper() or c == "+"))
            best = min(best or (10**9, ""), (cost, audit))
    return best


def test_weights_equal_brute_force():
    rng = random.Random(3)
    codes = {"".join(rng.choice("suaSUA.-+") for _ in range(rng.randrange(5))) for _ in range(150)}
    for code in codes:
        cost, audit, leave = cr.closed(code)
        assert (cost + cr.CLOSING[leave], audit + "I" * len(cr.closing_turns(leave))) == cheapest(code), code


def test_composed_summaries():
    rng = random.Random(4)
    for _ in range(60):
        code = "".join(rng.choice("suaSUA.-+") for _ in range(12))
        cuts = sorted(rng.sample(range(13), 3))
        parts = [code[a:b] for a, b in zip([0, *cuts], [*cuts, 12])]
        stretches = [cr.summary(p) for p in parts]
        whole = stretches[0]
        for s in stretches[1:]:
            whole = cr.composed(whole, s)
        leave = cr.best_leave(whole)
        way = cr.states(stretches, cr.START, leave)
        audit = ""
        for p, s, t in zip(parts, way, way[1:]):
            w, low = cr.weights(p, t)
            audit += cr.audit_of(w[s], low)
        assert (audit, leave) == cr.closed(code)[1:]


@pytest.mark.parametrize("size", [1000, 3])
def test_equals_sql(spark, monkeypatch, size):
    monkeypatch.setattr(cr, "CHUNK_TURNS", size)
    rng = random.Random(7)
    texts = ["yes.", "no", "why?", "", " \t", "a.b", "well done!", "a ", None, "end.\n", "x" * 70 + "1.", "x" * 70 + "2."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]
    rows = []
    for conv in [*range(40), None]:
        for k in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([k, k, k, k + 2, None]), rng.choice(roles), rng.choice(texts)))
    for k in range(400):  # a third of all rows is one conversation
        rows.append((1000, k // 2, rng.choice(roles[:5]), f"turn {k}{rng.choice(['.', '', '?'])}" if k % 7 else "again."))
    rows += [(2000, 5, "user", "same.")] * 30
    rng.shuffle(rows)
    got = cr.repair(cr.damaged(frame(spark, rows))).reports().toPandas()
    assert differences(got, by_sql(rows)) is None


def test_turns_make_up_the_hash(spark):
    rows = [(1, k, r, f"text {k}.") for k, r in enumerate(["assistant", "system", "user", "user", "assistant", "user"])]
    out = cr.repair(cr.damaged(frame(spark, rows)))
    turns = out.turns().orderBy("conv_id", "part", "chunk", "place").collect()
    report = out.reports().collect()[0]
    text = "\n".join(f"{t.role}:{t.text}" for t in turns)
    assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns))
    assert report.repaired_sha256 == cr.hashlib.sha256(text.encode()).hexdigest()


def test_given_table(spark, sf_dir, con):
    got = cr.op11_conversation_repair(spark, sf_dir).toPandas()
    assert differences(got, con.execute(cr.OP11_SQL).df()) is None


def test_edges(spark):
    long = "word " * 300_000
    rows = [(None, None, None, None), (7, 1, "user", long), (7, 2, "assistant", long + "."), (8, None, "user", None)]
    got = cr.repair(cr.damaged(frame(spark, rows))).reports().toPandas()
    assert differences(got, by_sql(rows)) is None
    empty = cr.repair(cr.damaged(frame(spark, []))).reports().toPandas()
    assert isinstance(empty, pd.DataFrame) and empty.empty and list(empty.columns) == list(by_sql([]).columns)

from colsight.llm.line_dedup import line_dedup

SCHEMA = "doc_id bigint, text string, row string, lines string, deleted string, print int"


def brute(rows, window):
    key = lambda i: 2**63 - 1 if i is None else i
    first = {}
    split = [(i, None if t is None else t.split("\n")) for i, t in rows]
    for i, ls in split:
        for k in range(len(ls or []) - window + 1):
            g = tuple(ls[k : k + window])
            first[g] = min(first.get(g, (key(i), k)), (key(i), k))
    out = []
    for i, ls in split:
        gone = set()
        for k in range(len(ls or []) - window + 1):
            if first[tuple(ls[k : k + window])] < (key(i), k):
                gone.update(range(k, k + window))
        text = None if ls is None else "\n".join(x for k, x in enumerate(ls) if k not in gone)
        out.append((i, len(ls or []), len(gone), text))
    return sorted(out, key=str)


def run(df, window):
    return sorted((tuple(r) for r in line_dedup(df, window).collect()), key=str)


def test_equals_brute_force(spark, sf_dir, documents):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for window in (2, 3):
        got = run(df, window)
        assert got == brute([r[:2] for r in documents], window)
        assert sum(r[2] for r in got) > 0


def test_edges(spark):
    passage = "p1\np2\np3"
    rows = [
        (1, "a\n" + passage + "\nb"),
        (2, passage + "\nc"),
        (3, "p1\np2"),
        (4, None),
        (5, ""),
        (6, "x\nx\nx\nx\nx\nx"),
        (7, "\n".join(f"l{i % 50}" for i in range(5000))),
        (None, passage),
        (8, "\n\n\n\n"),
    ]
    rows += [(9, "q\nr\ns\nt")] * 2
    df = spark.createDataFrame([(*r, "r", "l", "d", 1) for r in rows], SCHEMA)
    for window in (1, 3):
        assert run(df, window) == brute(rows, window)


def test_empty(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0

import corpus_pipeline as p
from colsight.llm import decontamination as dec
from tests.llm import test_decontamination, test_line_dedup, test_minhash_dedup


def words(text):
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text.lower()).split()


def test_stages_equal_brute_force(spark, sf_dir, con):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}

    out = p.language_id(spark, docs, sf_dir)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == columns
    assert kept == {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}

    given = {i: rows[i].text for i in kept}
    docs = spark.createDataFrame([rows[i] for i in kept], docs.schema)
    out = p.line_dedup(spark, docs, sf_dir)
    got = {r.doc_id: r for r in out.collect()}
    want = {i: t for i, n, gone, t in test_line_dedup.brute(list(given.items()), 3) if gone == 0 or gone < n}
    assert out.columns == columns and {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == (rows[i].n_chars if r.text == rows[i].text else len(r.text)) for i, r in got.items())

    docs = spark.createDataFrame(list(got.values()), docs.schema)
    out = p.near_duplicates(spark, docs, sf_dir)
    want = {r[0] for r in test_minhash_dedup.brute(list(want.items()), 5) if r[3]}
    rest = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and set(rest) == want and len(want) < len(got)

    docs = spark.createDataFrame(list(rest.values()), docs.schema)
    out = p.decontamination(spark, docs, sf_dir)
    clean = {r.doc_id for r in out.collect()}
    items = [words(t) for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    holds = set()
    for i, r in rest.items():
        w = words(r.text)
        near = {x for item in items for x in item[:3]} & set(w)
        if near and any(test_decontamination.distance(item, w) <= int(dec.EDITS * len(item)) for item in items if len(set(item) & set(w)) >= 0.6 * len(set(item))):
            holds.add(i)
    assert out.columns == columns and clean == set(rest) - holds

    last = p.encode(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in last} == set(rest) and all(len(r.ids) == 4 * r.n_tokens for r in last)


def test_run(spark, sf_dir):
    out = p.run(spark, sf_dir)
    assert [name for name, _ in p.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    assert out.count() > 0


def test_nulls_and_empty(spark, sf_dir):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, lines string"
    rows = [(None, None, None, None, None, None, None), (1, "a b\nc d\ne f", "en", "s", 11, "r", "l"), (2, "a b\nc d\ne f", None, None, None, None, None)]
    rows += [(None, "some words here", "en", None, 15, None, None)] * 2
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == schema.replace(" bigint", "").replace(" string", "").split(", ")
        ids = sorted((r.doc_id for r in p.encode(spark, docs, sf_dir).collect()), key=str)
        assert ids == ([1, None, None] if data else [])


def test_near_duplicates_drop_rows_not_ids(spark, sf_dir):
    schema = "doc_id bigint, text string, row string"
    base = " ".join(f"word{k}" for k in range(60))
    other, third = ("completely different text " + " ".join(f"{x}{k}" for k in range(50)) for x in ("else", "third"))
    rows = [(1, base, "a"), (None, base + " more", "b"), (None, other, "c"), (2, base + " again", "d"), (2, third, "e"), (None, None, "f"), (None, "", "g")]
    rows += [(9, third + " tail", "h"), (7, third, "i"), (None, other + " end", "j")]
    out = p.near_duplicates(spark, spark.createDataFrame(rows, schema), sf_dir)
    assert out.columns == ["doc_id", "text", "row"]
    kept = sorted(r.row for r in out.collect())
    assert kept in (["a", "c", "e", "f", "g"], ["a", "e", "f", "g", "j"])


def test_very_long_texts(spark, sf_dir):
    rng = __import__("random").Random(1)
    lines = ["\n".join(" ".join(rng.choices([f"w{k}" for k in range(5000)], k=12)) for _ in range(1000)) for _ in range(2)]
    rows = [(1, lines[0], "en", "s", len(lines[0])), (2, lines[1], "en", "s", len(lines[1])), (3, lines[0] + "\nend", "en", "s", len(lines[0]) + 4), (4, "k" * 20_000, "en", "s", 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    out = {r.doc_id: r.n_tokens for r in p.encode(spark, docs, sf_dir).collect()}
    assert {1, 2, 4} <= set(out)

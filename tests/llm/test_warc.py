import gzip
import hashlib
import io
import random

from colsight.llm import warc
from colsight.session import work_folder

SCHEMA = "page_id bigint, url string, html string, digest string, record_id string, payload string"


def brute(rows):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        own = i == f
        out.append((i, len(raw), warc.base32_sha1(raw), "response" if own else "revisit", None if own else f))
    return sorted(out, key=str)


def test_equals_brute_force(spark, sf_dir, con):
    rows = con.execute("SELECT page_id, html FROM pages").fetchall()
    assert sorted(map(tuple, warc.op10_warc(spark, sf_dir).collect()), key=str) == brute(rows)


def test_edges(spark):
    rows = [(3, "<p>a</p>"), (1, "<p>a</p>"), (2, None), (5, ""), (None, "<p>a</p>"), (None, "x"), (7, "é" * 200_000), (8, "q"), (8, "q")]
    df = spark.createDataFrame([(i, "http://x/\r\nY: z" if i else None, h, "d", "r", "p") for i, h in rows], SCHEMA)
    assert sorted(map(tuple, warc.archive_pages(df).collect()), key=str) == brute(rows)
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_split_size_reads_each_record_once(spark):
    rng = random.Random(3)
    rows = [(f"urn:x:{i}", None, rng.randbytes(rng.choice([0, 10, 3000])), None) for i in range(60)]
    # A payload that holds a whole archive: its members lie inside a record.
    rows.append(("urn:x:nested", "http://x", b"".join(warc.record(f"urn:in:{i}", None, b"z", None) for i in range(5)), None))
    rows.append(("urn:x:again", None, rows[3][2], "urn:x:3"))
    df = spark.createDataFrame(rows, "record_id string, uri string, payload binary, refers_to string")
    archives = warc.write_archives(df, work_folder(spark))
    for split in (997, 4096, 1 << 20):
        got = warc.read_archives(archives, split).collect()
        own = [r for r in got if r.record_id.startswith("urn:x:")]
        assert sorted(r.record_id for r in own) == sorted(r[0] for r in rows)
        assert {r.record_id: r.payload for r in own if r.record_type == "response"} == {r[0]: r[2] for r in rows if not r[3]}
        assert all(r.intact for r in own if r.record_type == "response")


def test_ranges_of_one_file_and_magic_in_text():
    members = [warc.record(f"urn:x:{i}", None, warc.MAGIC * 50 + b"%d" % i, None) for i in range(30)]
    data = members[0] + gzip.compress(b"no record") + b"".join(members[1:])
    for size in (1, 7, 100, 5000):
        found = [r[0] for at in range(0, len(data), size) for r in warc.scan(io.BytesIO(data), at, min(at + size, len(data)))]
        assert found == [f"urn:x:{i}" for i in range(30)]
    assert warc.parse(warc._member(io.BytesIO(data), 0)[0])[3] == warc.base32_sha1(warc.MAGIC * 50 + b"0")
    assert hashlib.sha1(b"").hexdigest().startswith("da39")

import os

import duckdb
import pytest

DATA = os.environ.get("LLM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return out


@pytest.fixture(scope="session")
def documents(con):
    return con.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()

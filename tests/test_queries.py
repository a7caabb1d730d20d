"""Registered queries against their DuckDB oracles at the smallest scale, and the entry module's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from lakeweave.queries import ORACLES, QUERIES

SF = os.environ.get("LAKEWEAVE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 170
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_unicode_of_odd_texts(spark, tmp_path):
    texts = ["", "\0", "\0a", None, " ", "\n", "\x7f", "\x80", "e\u0301", "\ufeffx", "\uffff", "\U0001f600x", "\U0010ffff"]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, 'en', 'src1')", list(enumerate(texts)))
    c.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    got = sorted(tuple(r) for r in QUERIES["fn_unicode"](spark, str(tmp_path)).select("id", "f").collect())
    assert got == sorted(c.execute(ORACLES["fn_unicode"]).fetchall())

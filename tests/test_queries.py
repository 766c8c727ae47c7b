"""Every registered query with SQL agrees with it on the smallest tables; merges are idempotent on them."""

import os

import pytest

from ctispark.plans import registry
from ctispark.sources.tables import table

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    import duckdb

    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return out


def text(v):
    if v is None or v != v:
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "item") else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_agrees(spark, con, name):
    got = registry.QUERIES[name](spark, FOLDER)
    result = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(tuple(map(text, r)) for r in result.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, con, name):
    got = registry.QUERIES[name](spark, FOLDER)
    assert got.schema.names and len(got.collect()) > 0


def test_plaintext_on_halves(spark, con):
    """Extraction of the parts is that of the whole."""
    from ctispark.operators.plaintext import iocs_plaintext

    docs = table(spark, FOLDER, "documents").select("doc_id", "text")
    whole = sorted(map(tuple, iocs_plaintext(docs).collect()), key=str)
    parts = [r for k in (0, 1) for r in iocs_plaintext(docs.filter(f"doc_id % 2 = {k}")).collect()]
    assert sorted(map(tuple, parts), key=str) == whole

"""The pipeline's stages against plain Python, and the registered SQL against the queries."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_training_operators import SCHEMA, corpus

import corpus_pipeline
from ctispark.llm import bpe, jaccard, mixing, quality, registry, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def mark(text):
    """Secrets replaced, with the quotation mark behind a value that one opens."""
    out, at = [], 0
    for m in re.finditer("|".join(f"(?:{r.pattern})" for r in secrets.RULES), text):
        opened = re.search(r"""(["'])[A-Za-z0-9+/_.=-]+\Z""", m[0])
        out += [text[at : m.start()], "[SECRET]"]
        at = m.end() + bool(opened and text[m.end() : m.end() + 1] == opened[1])
    return "".join([*out, text[at:]])


def test_stages(spark, tmp_path):
    rows = corpus() + [(100, "A word of mine: token = abcdefgh12345678 stays hidden, secret = 'abcdefgh12345678' too. " + " ".join(f"w{i}" for i in range(60)) + ".", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, str(tmp_path))
        if name == "quality rules":
            want = Counter((x.doc_id, x.quality.clean_text) for x in quality.judge(docs).collect() if x.quality.kept)
            assert want and Counter((x.doc_id, x.text) for x in out.collect()) == want
        elif name == "n-gram Jaccard join":
            kept = {x.doc_id for x in jaccard.jaccard_join(docs).collect() if x.kept}
            assert Counter((x.doc_id, x.text) for x in out.collect()) == Counter((x.doc_id, x.text) for x in before if x.doc_id is None or x.doc_id in kept)
        elif name == "secret scans":
            assert Counter((x.doc_id, x.text) for x in out.collect()) == Counter((x.doc_id, mark(x.text)) for x in before)
            assert any("[SECRET]" in x.text for x in out.collect())
        elif name == "mixing":
            copies = Counter()
            for x in mixing.mix(docs).collect():
                copies[x.doc_id, x.text] += x.mix_copies
            assert Counter((x.doc_id, x.text) for x in out.collect()) == +copies
        else:
            exact = bpe.codec(*bpe.files()).exact
            assert all(x.n_tokens == len(x.ids) for x in out.collect())
            assert Counter((x.doc_id, tuple(x.ids)) for x in out.collect()) == Counter((x.doc_id, tuple(exact.encode(x.text, add_special_tokens=False).ids)) for x in before)
            break
        assert out.columns == COLUMNS
        assert all(x.n_chars == len(x.text) for x in out.collect())
        path = f"{tmp_path}/{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, tmp_path, name):
    import duckdb

    rows = [r for i, r in enumerate(corpus(9)) if i < 60]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, (i + 1) % 3 // 2) for i in range(0, 60, 4)] + [(8, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for table in ("documents", "labels"):
        file = next(f for f in os.listdir(f"{tmp_path}/{table}.parquet") if f.endswith(".parquet"))
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/{file}'")
    want = con.execute(registry.ORACLE[name]).fetchdf()
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    columns, key = sorted(want.columns), [c for c in ("doc_id", "part", "filter_order", "step") if c in want.columns]
    assert columns == sorted(got.columns) and len(want) == len(got)
    want, got = (d[columns].sort_values(key).reset_index(drop=True) for d in (want, got))
    for c in columns:
        same = want[c] == got[c] if want[c].dtype.kind != "f" else (want[c] - got[c]).abs() < 1e-6
        assert (same | want[c].isna() & got[c].isna()).all(), c


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in registry.QUERIES and F is not None

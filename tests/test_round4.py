"""What the findings of round 4 named, each in small."""

import os

from pyspark.sql import functions as F

from ctispark.operators import merge
from ctispark.streaming import jobs
from ctispark.streaming.store import ADDED, Added, Store

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def exchanges(df):
    """Shuffles and sorts in the plan of a table that has not run yet."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Sort [")


def test_merges_move_the_target_once(spark):
    """what B5 with B3, and B4, make by several shuffles of the stored rows, by one; nulls are keys, repeated rows stay."""
    make = lambda *r: spark.createDataFrame(list(r), "a string, t string, v string, s string")
    old = make(*[("a", "x", "1", "intel"), ("a", "x", "2", "parse"), ("a", "x", "2", "parse"), ("a", "x", "3", None), (None, "x", "1", "intel"), (None, None, None, "parse")], ("b", "x", "1", "intel"), ("b", None, "1", "intel"), ("c", "x", "1", "intel"), ("c", "x", "1", "parse"), ("a", None, None, "intel"))
    new = make(*[("a", "x", str(i), "new") for i in (1, 1, 2, 3, 4)], (None, "x", "1", "new"), (None, None, None, "new"), ("b", None, "1", "new"), ("b", "y", None, "new"), ("c", "x", "1", "new"), ("a", None, None, "new"), ("d", "x", "1", "new"))
    ids = spark.createDataFrame([("a",), ("a",), (None,), ("c",), ("e",)], "a string")
    key, scope = ["a", "t", "v"], F.col("s") == "intel"
    got = merge.delete_insert(old, ids, scope, new, key)
    assert rows(got) == rows(merge.insert_ignore(merge.delete_where(old, ids, ["a"], scope), new, key)) and got.columns == old.columns
    assert len(rows(got)) == 13
    # one for the keys' own distinct, one for all rows
    assert exchanges(merge.delete_insert(old, ids, scope, new, key)) == (2, 1)
    put = merge.replace_rows(old, new.dropDuplicates(key), key)
    assert rows(put) == rows(merge.insert_replace(old, new.dropDuplicates(key), key))
    assert exchanges(merge.replace_rows(old, new, key)) == (1, 1) and rows(merge.replace_rows(old, new, key)) == rows(put)


def test_store_adds_rows(spark, tmp_path):
    """rows that a batch only adds are written alone; a bucket that was added to often is rewritten; old versions go when no manifest names them."""
    root = str(tmp_path / "s")
    table = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    want = [(f"k{i}", i) for i in range(200)]
    assert Store(spark, root, ("k",), 4).commit(0, None, lambda old: {"t": table(*want)})
    for n in range(1, ADDED + 3):
        want.append((f"k{n}", -n))
        assert Store(spark, root, ("k",)).commit(n, table(want[-1]), lambda old: {"t": Added(table(want[-1]))})
        assert spark.read.parquet(f"{root}/t/v{n}").count() == 1
        assert rows(Store(spark, root, ()).read("t")) == sorted(want, key=str)
    every = table(*want)
    for n in range(20, 20 + ADDED + 1):
        assert Store(spark, root, ("k",)).commit(n, every, lambda old: {"t": Added(every)})
        want = want + want[: ADDED + 202]
        assert rows(Store(spark, root, ()).read("t")) == sorted(want, key=str)
    entry = Store(spark, root, ("k",)).manifest["tables"]["t"]
    assert all(len(v) <= ADDED for v in entry["added"].values()) and 0 not in entry["buckets"].values()
    # rows of another kind than the stored ones widen the table; none added change nothing; another key is refused
    wide = spark.createDataFrame([("k0", 1 << 40)], "k string, v long")
    assert Store(spark, root, ("k",)).commit(50, every, lambda old: {"t": Added(wide)})
    assert rows(Store(spark, root, ()).read("t")) == sorted([*want, ("k0", 1 << 40)], key=str)
    before = Store(spark, root, ("k",)).manifest["tables"]
    assert Store(spark, root, ("k",)).commit(51, every, lambda old: {"t": Added(old["t"].limit(0))})
    assert Store(spark, root, ("k",)).manifest["tables"] == before
    assert Store(spark, root, ("k",)).commit(52, every, lambda old: {"t": old["t"].limit(0)})
    assert rows(Store(spark, root, ()).read("t")) == []
    # of a table that isn't there yet
    assert Store(spark, root, ("k",)).commit(53, every, lambda old: {"u": Added(wide)})
    assert rows(Store(spark, root, ()).read("u")) == [("k0", 1 << 40)]
    assert sorted(os.listdir(f"{root}/t")) == []


def test_large_buckets_are_written_by_many_tasks(spark, tmp_path):
    """a task that got a whole bucket of a large table sorted it on disk."""
    root = str(tmp_path / "s")
    df = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("k"), "id").alias("k"))
    store = Store(spark, root, ("k",), 2, gather=False)
    store.commit(0, None, lambda old: {"t": df})
    files = [n for b in (0, 1) for n in os.listdir(f"{root}/t/v0/__bucket={b}") if n.endswith(".parquet")]
    assert len(files) == 16 and store.read("t").distinct().count() == 4000


def test_save_intel_leaves_what_only_grows(spark):
    """techniques and CVEs of a batch are added to their tables, which stay in their files."""
    from ctispark.plans import landed
    from ctispark.sources.domain import domain

    tables = [domain(spark, FOLDER, name) for name in landed._SAVED.split()]
    store, batch = landed._stored(*tables)
    new = batch.select("advisory_id", F.lit("CVE-2024-9999").alias("cve_id"))
    intel = {"advisories": batch, "ioc": store.read("ioc").filter("false"), "advisory_technique": tables[3], "advisory_cve": new, "calls": tables[7].filter("false")}
    before = {name: rows(store.read(name)) for name in ("advisory_technique", "advisory_cve")}
    for n in (1, 2):
        assert jobs.commit_intel(store, n, intel, f"2024-06-0{n}")
        held = store.manifest["tables"]
        assert set(held["advisory_cve"]["buckets"].values()) == set(held["advisory_technique"]["buckets"].values()) == {0}
        assert {v for more in held["advisory_cve"]["added"].values() for v in more} == {1} and not held["advisory_technique"]["added"]
        assert rows(store.read("advisory_technique")) == before["advisory_technique"]
        assert rows(store.read("advisory_cve")) == sorted(before["advisory_cve"] + rows(new), key=str)

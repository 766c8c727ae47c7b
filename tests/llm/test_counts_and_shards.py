"""Filter audit, Merkle manifest and virtual slots against brute force, with the cases that tables bring along."""

import hashlib
import tempfile
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctispark.llm import audit, manifest, sharding

LONG = " ".join(f"w{i}" for i in range(40_000))
PROSE = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, PROSE, "en"), (2, PROSE, "en"), (3, PROSE, None), (3, PROSE, None), (4, None, "de"), (5, "", "de"), (6, LONG, "en"), (7, "UP DOWN # x", "en"), (8, "a b " * 80, ""), (None, PROSE, "en"), (None, None, None),
    (9, "EIN" + PROSE.upper(), "fr"), (10, "x|y " * 3, "fr"), (10, "x|y " * 3, "fr"), (11, PROSE + " &", "de"), (12, "é\t日本\x0bx", None), (-5, PROSE, "zz"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (7, 0, 1), (10, 1, None), (None, 1, 1), (99, 1, 1), (-5, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, "x", k, "y") for k, (i, t, g) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, mask int, item string").repartition(5)


def split(t):
    out = t or ""
    for c in "\x09\x0a\x0b\x0c\x0d":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def test_audit(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in audit.audit(docs, labels).collect()}
    told = {}
    for i, q, t in LABELS:
        if i is not None:
            old = told.get(i, (False, False))
            told[i] = (old[0] or q == 1, old[1] or t == 1)
    cases = []
    for i, t, g in ROWS:
        s, w = t or "", split(t)
        twin = i is not None and any(j is not None and j < i and (u or "") == s for j, u, _ in ROWS)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in s) > 10 * len(s), "D": any(c in s for c in "#$%&*|"), "E": twin}
        cases.append((g or "", {f for f, bad in fails.items() if bad}, *told.get(i, (False, False))))
    assert any(len(c[1]) > 2 for c in cases) and any("E" in c[1] for c in cases)
    want = {}
    for part in {c[0] for c in cases}:
        mine, shapley = [c for c in cases if c[0] == part], Counter()
        for order in permutations("ABCDE"):
            gone = set()
            for k, f in enumerate(order):
                before, gone = gone, gone | {f}
                lost = [c for c in mine if not c[1] & before and f in c[1]]
                shapley[f] += len(lost)
                want[part, "".join(order), k + 1] = [sum(not c[1] & gone for c in mine), len(lost), sum(bool(c[1] & before) and f in c[1] for c in mine), sum(c[1] == {f} for c in mine), sum(c[2] for c in lost), sum(c[3] for c in lost), f]
        for key in [k for k in want if k[0] == part]:
            want[key][6] = shapley[want[key][6]]
    assert got == {k: tuple(v) for k, v in want.items()}


def test_audit_without_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs.limit(0), labels).collect() == []
    assert len(audit.audit(docs, labels).collect()) == 600 * 5


def test_positional_popcount():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 17, 1000):
        words, weights = rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 10**6, n)
        want = [int(sum(w for x, w in zip(words.tolist(), weights.tolist(), strict=True) if x >> b & 1)) for b in range(32)]
        assert audit.positional_popcount(words, weights).tolist() == want


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, k):
    """The root, and for each node the siblings left and right by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            first = a // k * k
            paths[i].append(("".join(nodes[first:a]), "".join(nodes[a + 1 : first + k])))
            at[i] = a // k
        nodes = [H(*nodes[i : i + k]) for i in range(0, len(nodes), k)]
    return nodes[0], paths


@pytest.mark.parametrize(("fanout", "levels"), [(2, 5), (2, 1), (3, 2)])
def test_manifest(spark, fanout, levels):
    rows = [(i, f"text {i}" if i % 9 else None, [None, "", "de", "en", "ä"][i % 5 if i < 60 else 3]) for i in range(150)] + [(None, "a", "en"), (None, "b", "en"), (7, "text 7", "de"), (7, "text 7", "de"), (500, LONG, "lone")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, path string, n int").repartition(7)
    got = manifest.manifest(docs, manifest.leaf(F.col("doc_id"), F.col("text")), carry={"chars": F.length("text")}, fanout=fanout, levels=levels)
    got = got.select("lang", "doc_id", "leaf", "chars", "subroot", "root", F.transform("path", lambda x: F.array(x["l"], x["r"])).alias("path"), manifest.fold(F.col("leaf"), F.col("path")).alias("folded"))
    leaves = sorted(((g is not None, (g or "").encode()), i is not None, i or 0, H(said(i), said(t)), g, i, len(t) if t is not None else None) for i, t, g in rows)
    groups = {}
    for x in leaves:
        groups.setdefault(x[0], []).append(x)
    trees = {g: tree([x[3] for x in xs], fanout) for g, xs in groups.items()}
    order = sorted(groups)
    root, tops = tree([trees[g][0] for g in order], fanout)
    want = [(x[4], x[5], x[3], x[6], trees[g][0], root, [list(p) for p in path + tops[order.index(g)]], root) for g in order for x, path in zip(groups[g], trees[g][1], strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_manifest_without_rows_and_of_one(spark):
    docs = spark.createDataFrame([(4, "t", None)], "doc_id long, text string, lang string")
    digest = manifest.leaf(F.col("doc_id"))
    assert manifest.manifest(docs.limit(0), digest).collect() == []
    only = manifest.manifest(docs, digest).first()
    assert only.leaf == only.subroot == only.root == H("1:4") and only.path == []


def test_shards(spark, docs):
    root = f"file://{tempfile.mkdtemp(prefix='spark-')}/map"
    rows = sharding.shard(docs, root, shards=4, slots=64).collect()
    assert len(rows) == len(ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for i, t, _ in ROWS)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.version for r in rows} == {2}
    assert len({(r.vslot, r.shard) for r in rows}) == len({r.vslot for r in rows})
    # the long text has a shard to itself but for slots that were there without bytes
    assert sum(r.shard == next(x.shard for x in rows if x.doc_id == 6) for r in rows) == 1
    assert sharding.shard(docs.limit(0), f"{root}-none", shards=4, slots=64).collect() == []


def test_rebalance_moves_few(spark):
    rng = np.random.default_rng(3)
    sizes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.pareto(2, 500) * 1000 + 10)], "vslot int, bytes long")
    size = dict(map(tuple, sizes.collect()))
    first = sharding.first_map(spark, 8, 512)
    second = sharding.rebalance(first, sizes, 8)
    where = [{r.vslot: r.shard for r in m.collect()} for m in (first, second)]
    assert sorted(where[0]) == sorted(where[1]) == list(range(512))
    load = lambda m, n: [sum(size.get(v, 0) for v, s in m.items() if s == k) for k in range(n)]
    assert max(load(where[1], 8)) - min(load(where[1], 8)) <= 200 < max(load(where[0], 8)) - min(load(where[0], 8))
    assert sum(where[0][v] != where[1][v] for v in where[0]) < 200
    # one shard more: what stays within its shard's share does not move, and a new version is stored beside the old one
    root = f"file://{tempfile.mkdtemp(prefix='spark-')}/map"
    sharding.store_map(second, root)
    third = sharding.store_map(sharding.rebalance(sharding.load_map(spark, root), sizes, 9), root)
    assert {r.version for r in third.collect()} == {3} and {r.version for r in sharding.load_map(spark, root, 2).collect()} == {2}
    where.append({r.vslot: r.shard for r in third.collect()})
    assert max(load(where[2], 9)) - min(load(where[2], 9)) <= 400
    # fewer shards: nothing is left on those that went
    fewer = {r.vslot: r.shard for r in sharding.rebalance(third, sizes, 5).collect()}
    assert sorted(fewer) == list(range(512)) and set(fewer.values()) == set(range(5))

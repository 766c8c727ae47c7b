"""Near-duplicate vectors by an epsilon grid order join.

Vectors are scaled to length 1, so a cosine of at least c is a distance of at
most eps = sqrt(2 - 2c). They are turned onto their principal dimensions; a
grid of cells of width eps on the leading ones orders them, cell by cell,
dimension by dimension. Intervals of that sequence are joined with each other:
pairs of intervals whose boxes are more than eps apart are skipped, others are
halved, down to blocks that are compared outright.

Spark joins the intervals by their cells (equal or neighbouring in each of the
first KEYED dimensions) and deals out the pairs; a task holds two intervals.
The sequence makes about INTERVALS of them, MOST_ROWS vectors each at most, so
a vector is sent to INTERVALS + 1 tasks or fewer until that bound is reached.
Vectors are sent as they came and compared so, in double precision; the turned
ones only tell which pairs can be skipped. A task returns how many links each
of its vectors has and a spanning forest of them, never the pairs, so a group
of copies of any size stays linear.
"""

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ctispark.llm.common import hub_join, read, staged
from ctispark.llm.components import components

COSINE = 0.95
#: Intervals that Spark deals out, their vectors at most, and those of a block that is compared outright.
INTERVALS, MOST_ROWS, BLOCK = 12, 32_768, 512
#: Leading dimensions that order the vectors, and that are compared before the others.
ORDERED, FIRST = 4, 16
#: Leading dimensions whose cells intervals are joined by.
KEYED = 3
#: The boxes may seem nearer than they are by this much, for rounding.
SLACK = 1e-9


def stacked(es: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(es), dims))
    for k, one in enumerate(es):
        out[k, : len(one)] = one
    return out


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    v = v / np.abs(v).max(axis=1, keepdims=True, initial=1e-300)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def principal(vectors: DataFrame, dims: int) -> np.ndarray:
    """Principal dimensions, leading ones first, from the second moments of all vectors e: each task sums its own, dims * dims numbers in all go to the driver."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, m = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            if len(batch):
                x = unit(stacked(batch.e, dims))
                n, s, m = n + len(x), s + x.sum(axis=0), m + x.T @ x
        rows = np.vstack([m, s, np.full(dims, float(n))])
        yield pd.DataFrame({"i": np.repeat(np.arange(dims + 2), dims), "j": np.tile(np.arange(dims), dims + 2), "x": rows.ravel()})

    sums = vectors.select("e").mapInPandas(moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    m = np.zeros((dims + 2, dims))
    m[sums.i, sums.j] = sums.x
    n = max(1.0, m[dims + 1, 0])
    mean = m[dims] / n
    _, axes = np.linalg.eigh(m[:dims] / n - np.outer(mean, mean))
    return axes[:, ::-1].copy()


class Links:
    """Degrees and a spanning forest of the nodes of one task."""

    def __init__(self, n: int, weight: np.ndarray):
        self.root, self.degree, self.weight = np.arange(n), np.zeros(n, np.int64), weight

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.degree, i, self.weight[j])
        np.add.at(self.degree, j, self.weight[i])
        while True:
            a, b = self.root[i], self.root[j]
            if (a == b).all():
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def ego_join(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray] | None, links: Links, cosine: float, base: int) -> None:
    """Links rows of x with rows of y (numbered from base), or with each other if y is None, where their cosine is at least so much; each side is its vectors, of length 1, and the leading ones of their turned numbers."""
    eps = math.sqrt(2 - 2 * cosine)

    def box(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v.min(axis=0), v.max(axis=0)

    def visit(a0: int, a1: int, b0: int, b1: int) -> None:
        own = y is None
        other = x if own else y
        a, p, b, q = x[0][a0:a1], x[1][a0:a1], other[0][b0:b1], other[1][b0:b1]
        if not (own and a0 == b0):
            (al, ah), (bl, bh) = box(p), box(q)
            gap = np.maximum(0, np.maximum(bl - ah, al - bh))
            if gap @ gap > (eps + SLACK) ** 2:
                return
        if max(a1 - a0, b1 - b0) > BLOCK:
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            if own and a0 == b0:
                visit(a0, am, a0, am)
                visit(a0, am, am, a1)
                visit(am, a1, am, a1)
            elif a1 - a0 >= b1 - b0:
                visit(a0, am, b0, b1)
                visit(am, a1, b0, b1)
            else:
                visit(a0, a1, b0, bm)
                visit(a0, a1, bm, b1)
            return
        near = (p * p).sum(1)[:, None] + (q * q).sum(1) - 2 * (p @ q.T) <= eps * eps + SLACK
        if own and a0 == b0:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        if len(i) > near.size // 16:
            close = (a @ b.T)[i, j] >= cosine
        else:
            close = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
        if close.any():
            links.add(i[close] + a0, j[close] + b0 + (0 if own else base))

    visit(0, len(x[0]), 0, len((x if y is None else y)[0]))


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, rows: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; shorter ones count as filled up with zeros. Equal vectors
    are compared once and counted as often as they occur. component_id is the
    smallest id reached, of the row's own for one without links (null if that
    is null, which then is kept). Repeated ids are rows of their own. Other
    columns are not returned, whatever their names; empty input gives empty
    output. rows: vectors of an interval, where the table's size shall not say.
    """
    e = F.col("e")
    table = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = F.coalesce((F.size(e) > 0) & finite & F.exists(e, lambda c: c != 0), F.lit(False))
    table = table.withColumn("e", F.when(sound, e))
    # equal vectors are one class; ids of classes are given when the table is written, once
    classes = staged(table.filter("e is not null").groupBy("e").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("least")).withColumn("c", F.monotonically_increasing_id()))
    dims = classes.agg(F.max(F.size("e"))).first()[0]
    if dims is None:
        return table.select(F.col("id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    eps = math.sqrt(2 - 2 * cosine)
    axes = principal(classes, dims)
    lead, first = min(ORDERED, dims), min(FIRST, dims)
    keyed = min(KEYED, dims)
    # single precision holds what came in it, in half the bytes
    kind = np.float32 if isinstance(vectors.schema[embedding].dataType.elementType, FloatType) else np.float64

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = stacked(batch.e, dims)
                cell = np.floor(unit(v) @ axes[:, :lead] / eps).astype(int)
                yield pd.DataFrame({"c": batch.c, "m": batch.m, "v": [x.tobytes() for x in v.astype(kind)], "cell": list(cell)})

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(part: pd.DataFrame) -> dict:
            packed = b"".join(part.v)
            z = unit(np.frombuffer(packed, kind).reshape(-1, dims).astype(float)) @ axes[:, :lead]
            own = {tuple(x[:keyed].tolist()) for x in part.cell}
            near = {tuple(np.add(x, step).tolist()) for x in own for step in itertools.product((-1, 0, 1), repeat=keyed)}
            return {"block": int(part.c.iloc[0]), "c": part.c.to_numpy().tobytes(), "m": part.m.to_numpy().tobytes(), "v": packed, "lo": z.min(axis=0), "hi": z.max(axis=0), "cells": list(own), "near": list(near)}

        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            while len(held) >= each:
                yield pd.DataFrame([one(held[:each])])
                held = held[each:]
        if held is not None and len(held):
            yield pd.DataFrame([one(held)])

    n = classes.count()
    each = rows or min(MOST_ROWS, max(BLOCK, -(-n // INTERVALS)))
    order = [F.col("cell")[k] for k in range(lead)]
    ordered = classes.select("c", "m", "e").mapInPandas(turned, "c long, m long, v binary, cell array<int>").repartitionByRange(max(1, -(-n // (4 * each))), *order, "c").sortWithinPartitions(*order, "c")
    blocks = staged(ordered.mapInPandas(intervals, "block long, c binary, m binary, v binary, lo array<double>, hi array<double>, cells array<array<int>>, near array<array<int>>"))

    box = blocks.select("block", "lo", "hi", "cells", "near")
    left = box.select("block", "lo", "hi", F.explode("cells").alias("cell"))
    right = box.select(F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode("near").alias("cell"))
    gap = lambda k: F.greatest(F.lit(0.0), F.col("lo2")[k] - F.col("hi")[k], F.col("lo")[k] - F.col("hi2")[k])
    apart = sum((gap(k) * gap(k) for k in range(lead)), F.lit(0.0))
    pairs = left.join(right, "cell").filter((F.col("block") <= F.col("block2")) & (apart <= (eps + SLACK) ** 2)).select("block", "block2").distinct()
    sides = pairs.select(F.col("block").alias("x"), "block", "block2").unionByName(pairs.filter("block <> block2").select(F.col("block2").alias("x"), "block", "block2"))
    dealt = sides.join(blocks.select(F.col("block").alias("own"), "c", "m", "v"), F.col("x") == F.col("own")).drop("own")

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("x", key=lambda s: s != pair.block.iloc[0])
        c, m = (np.concatenate([np.frombuffer(b, np.int64) for b in pair[k]]) for k in ("c", "m"))
        sides = []
        for packed in pair.v:
            v = unit(np.frombuffer(packed, kind).reshape(-1, dims).astype(float))
            sides.append((v, v @ axes[:, :first]))
        links = Links(len(c), m)
        ego_join(sides[0], sides[1] if len(sides) > 1 else None, links, cosine, len(sides[0][0]))
        at = np.flatnonzero(links.degree)
        return pd.DataFrame({"c": c[at], "n": links.degree[at], "root": c[links.root[at]]})

    found = staged(dealt.groupBy("block", "block2").applyInPandas(compare, "c long, n long, root long"))
    degrees = found.groupBy("c").agg(F.sum("n").alias("n"))
    comps = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    named = staged(classes.join(comps.select(F.col("id").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c")))
    least = staged(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k")).withColumnRenamed("component", "own"))
    joined = hub_join(named.drop("least"), "component", least, "own", "k", n)
    per = staged(joined.join(degrees, "c", "left").select(F.xxhash64("e").alias("h2"), F.col("e").alias("e2"), "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"))
    # a hash finds a row's class; of classes that share one, which is next to never, the vector tells
    keyed_rows = table.withColumn("h", F.xxhash64("e"))
    joined = hub_join(keyed_rows.filter("e is not null"), "h", per, "h2", "m", table.count()).filter("e = e2").select("id", "n_links", "component_id").unionByName(keyed_rows.filter("e is null").select("id"), allowMissingColumns=True)
    own = F.when(F.coalesce("n_links", F.lit(0)) > 0, F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), own.isNull()).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))

"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctispark.llm.common import hub_join, staged

ROUNDS = 60


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Each node's neighbours (large: those above it, small: those below it) linked to its smallest, itself included."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "n")
    linked = hub_join(both, "u", least, "w", "n", total)
    out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = linked.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs without null. Returns (id, component) for every node of an edge, component being the smallest id that it reaches; edges from a node to itself name no component.

    Nothing but two numbers a round goes to the driver. The number of rounds
    grows with the logarithm of the nodes; where ROUNDS are not enough for
    that, this raises. Hubs of many edges are broadcast, so they fill no task.
    Repeated edges count once; no edges, no rows.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        # in a finished forest each a has one b, and no b is an a
        now = staged(_stars(staged(_stars(now, True, 2 * state[0])), False, state[0]))
    else:
        raise RuntimeError(f"components are not connected after {ROUNDS} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

"""N-gram Jaccard join by MinHash banding.

Band and row counts are chosen for a target recall at the threshold. Texts
with equal n-gram sets are one class; classes that share a band's hash are
candidates, which their full sets then confirm or not.

Classes of small buckets are paired, and a pair goes on if its sketches (a
byte of each of some MinHash values) are alike enough. In large buckets each
class is only tied to the bucket's first. What hangs together by such ties is
a cluster; all its pairs are verified, in tiles of at most about BLOCK by BLOCK
classes that are spread over tasks. A tile returns how many links each class
has and a spanning forest of them, never its pairs.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctispark.llm.common import hub_join, read, staged
from ctispark.llm.components import components
from ctispark.llm.shingles import set_id, shingle_set

WORDS, SIMILARITY = 5, 0.8
RECALL, MOST_HASHES = 0.9999, 200
#: Buckets up to this size are paired, larger ones tied to their first class.
PAIRED = 16
#: Sketches have SKETCH bytes; pairs go on if SKETCH_ALIKE of them or more are equal: at the threshold 3 in 10 ** 7 pairs do not.
SKETCH, SKETCH_ALIKE = 64, 34
BLOCK = 512
#: Up to so many classes in clusters (about 60 bytes each) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def bands_for(similarity: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, with which at most so many hashes reach the recall at this similarity."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity + 1e-12)), 1) if similarity < 1 else (1, 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows))) if similarity < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def signature(s: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values (32 bits) of a set."""
    rng = np.random.default_rng(20)
    xor, odd = rng.integers(0, 2**32, hashes, np.uint32)[:, None], rng.integers(0, 2**31, hashes, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(hashes, 2**32 - 1, np.uint32)
    for a in range(0, len(x), 1024):
        np.minimum(out, ((x[a : a + 1024] ^ xor) * odd).min(axis=1), out)
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(key, id, c, bands, sketch) a row: c numbers the class, null without words; key finds the row again."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t"), F.xxhash64(text).cast("string")))
    slim = docs.select(key.alias("key"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cs, bs, ks = [], [], []
            for t in batch.column(2).to_pylist():
                s = shingle_set(t, n)
                if not len(s):
                    cs.append(None), bs.append(None), ks.append(None)
                    continue
                values = signature(s, max(bands * rows, SKETCH))
                mixed = np.arange(bands, dtype=np.uint64) + np.uint64(1)
                for v in values[: bands * rows].reshape(bands, rows).T:
                    mixed = (mixed ^ v) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(32)
                cs.append(set_id(s)), bs.append(mixed.view(np.int64)), ks.append((values[:SKETCH] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cs, pa.int64()), pa.array(bs, pa.list_(pa.int64())), pa.array(ks, pa.binary())], ["key", "id", "c", "bands", "sketch"])

    return slim.mapInArrow(run, "key string, id long, c long, bands array<long>, sketch binary")


def alike(pairs: DataFrame) -> DataFrame:
    """Of (a, b, sketch_a, sketch_b) the pairs (a, b) with sketches alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (2, 3))
                ok = pa.array((x == y).sum(axis=1) >= SKETCH_ALIKE)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def candidate_ties(classes: DataFrame) -> DataFrame:
    """classes (c, bands, sketch). Ties (a, b) such that each pair of classes that shares a band, and is not unlike by sketch, hangs together."""
    rows = staged(classes.select("c", "sketch", F.explode("bands").alias("h")).select("h", "c"))
    sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("first")).filter("n > 1").withColumnRenamed("h", "h2")
    shared = staged(hub_join(rows, "h", staged(sizes), "h2", "n", rows.count()).select("h", "c", "n", "first"))
    large = shared.filter(F.col("n") > PAIRED).filter("c <> first").select(F.col("c").alias("a"), F.col("first").alias("b"))
    small = shared.filter(F.col("n") <= PAIRED).groupBy("h").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    paired = small.select(F.posexplode("cs").alias("i", "b"), "cs").select("b", F.explode(F.slice("cs", F.lit(1), F.col("i"))).alias("a")).distinct()
    sketches = classes.select("c", "sketch")
    with_a = paired.join(sketches.select(F.col("c").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    with_b = with_a.join(sketches.select(F.col("c").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    return alike(with_b).unionByName(large.distinct())


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many numbers each two sets share."""
    n = len(sets)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    often = times > 1  # the others are in one set alone
    place = np.cumsum(often) - 1
    keep = often[at]
    at, owner = place[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((n, n), np.float64)
    for a in range(0, int(often.sum()), columns):
        lo, hi = np.searchsorted(at, (a, a + columns))
        m = np.zeros((n, columns), np.float32)
        m[owner[lo:hi], at[lo:hi] - a] = 1
        out += m @ m.T
    return out


def verified(c: np.ndarray, m: np.ndarray, sets: list[np.ndarray], across: np.ndarray | None, similarity: float) -> tuple[np.ndarray, ...]:
    """Of one tile: for each class the linked documents and classes, and the first class that its links reach. across: the side of each class; None: all pairs count."""
    size = np.array([len(s) for s in sets])
    both = overlaps(sets)
    link = both * (1 + similarity) >= similarity * (size[:, None] + size) - 1e-9
    np.fill_diagonal(link, False)
    if across is not None:
        link &= across[:, None] != across
    root = np.arange(len(c))
    while True:
        least = np.minimum(root, np.where(link, root, len(c)).min(axis=1))
        if (least == root).all():
            return link @ m, link.sum(axis=1), root
        root = least


def links(docs: DataFrame, found: DataFrame, ties: DataFrame, doc_id: str, text: str, n: int, similarity: float) -> DataFrame:
    """(c, n_links, n_text_links, root) of the tiles of the clusters that ties make; found: (key, id, c) a row of docs."""
    clusters = staged(components(ties))
    sizes = staged(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("k")).withColumnRenamed("component", "cl"))
    reps = found.filter("c is not null").groupBy("c").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("m"))
    split = F.ceil(F.col("k") / BLOCK).cast("int")
    placed = hub_join(clusters, "component", sizes, "cl", "k", clusters.count()).select(F.col("id").alias("own"), "component", split.alias("parts"), F.pmod(F.xxhash64("id"), split.cast("long")).cast("int").alias("part"))
    members = staged(placed.join(reps, F.col("own") == F.col("c")).select("rep", "c", "m", "component", "parts", "part"))
    side = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t"), F.xxhash64(text).cast("string")))
    texts = docs.select(key.alias("key"), F.col(text).alias("text")).join(side, F.col("key") == F.col("rep")).select("c", "m", "component", "parts", "part", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingle_set(t, n) for t in part.column(5).to_pylist()]
                # rows that share an id but not the text are of another class
                own = pa.array([set_id(s) == c for s, c in zip(sets, part.column(0).to_pylist(), strict=True)], pa.bool_())
                columns = [*part.columns[:5], pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([x.filter(own) for x in columns], ["c", "m", "component", "parts", "part", "s"])

    sets = texts.mapInArrow(hashed, "c long, m long, component long, parts int, part int, s binary")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tiles = sets.select("c", "m", "component", "part", "s", other).select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "c", "m", "s")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(rows: dict[int, tuple[int, int, bytes]], i: int, j: int) -> pa.RecordBatch | None:
            c = np.array(sorted(rows), np.int64)
            m, part = (np.array([rows[x][k] for x in c.tolist()]) for k in (1, 0))
            docs_, texts_, root = verified(c, m, [np.frombuffer(rows[x][2], np.uint64) for x in c.tolist()], part if i != j else None, similarity)
            at = np.flatnonzero(texts_)
            return pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array(docs_[at], pa.int64()), pa.array(texts_[at], pa.int64()), pa.array(c[root[at]])], ["c", "n_links", "n_text_links", "root"])

        now, rows = None, {}
        for batch in batches:
            for comp, i, j, part, c, m, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (comp, i, j) != now:
                    if len(rows) > 1:
                        yield one(rows, *now[1:])
                    now, rows = (comp, i, j), {}
                rows[c] = (part, m, s)
        if len(rows) > 1:
            yield one(rows, *now[1:])

    grouped = tiles.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return grouped.mapInArrow(verify, "c long, n_links long, n_text_links long, root long")


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, cluster_id, kept), a row for each row of docs.

    class_id is the smallest id among texts with the same set of n-grams (a
    text of fewer words has one, of all its words); n_links counts the other
    rows that are similar, copies included, n_text_links the other classes;
    cluster_id is the smallest id that links reach; kept: the one row of the
    cluster that stays, that of the smallest id. Texts without words, null ones
    too, link with nothing and are kept. Null ids come last; a row without an
    id is kept only if its cluster has none with one. Repeated ids are rows of
    their own and are kept alike. Texts of any length are hashed whole. Other
    columns are not returned, whatever their names; empty input gives empty
    output.
    """
    bands, rows = bands_for(similarity, recall)
    found = staged(signatures(docs.select(doc_id, text), doc_id, text, words, bands, rows))
    classes = staged(found.filter("c is not null").groupBy("c").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    ties = staged(candidate_ties(classes))
    tiles = staged(links(docs.select(doc_id, text), found.select("key", "id", "c"), ties, doc_id, text, words, similarity))
    per = tiles.groupBy("c").agg(F.sum("n_links").alias("n_links"), F.sum("n_text_links").alias("n_text_links"))
    comps = components(tiles.select(F.col("c").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("c"), "component")
    least = found.filter("c is not null").groupBy("c").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("m"))
    named = staged(least.join(per, "c", "left").join(comps, "c", "left").withColumn("component", F.coalesce("component", "c")))
    tops = staged(named.groupBy("component").agg(F.min("class_id").alias("cluster_id"), F.count(F.lit(1)).alias("k")).withColumnRenamed("component", "cl"))
    info = hub_join(named, "component", tops, "cl", "k", named.count()).select(F.col("c").alias("c2"), "class_id", "m", (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), "cluster_id")
    rows_ = found.select("id", "c")
    out = hub_join(rows_, "c", staged(info), "c2", "m", rows_.count()).drop("m").unionByName(rows_.filter("c is null"), allowMissingColumns=True)
    lone = F.col("c").isNull()
    return out.select(
        F.col("id").alias(doc_id), F.when(lone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
        F.when(lone, F.col("id")).otherwise(F.col("cluster_id")).alias("cluster_id"), (lone | F.col("id").eqNullSafe(F.col("cluster_id"))).alias("kept"),
    )


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))

"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed character 1- to 3-grams of
its lower-case letters; each language has several centroids, found by
clustering; the language of the nearest by cosine is predicted. A text further
from its nearest centroid than nearly all texts of that centroid is marked as
rejected. Document frequencies count all rows to learn from; the clustering
runs on a bounded sample of them.
"""

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctispark.llm.common import read

DIMS = 4096
CENTROIDS = 3
#: About so many rows a language are clustered, twice as many at most.
SAMPLE = 400
ROUNDS = 12
#: This share of a centroid's sample is nearer to it than the rejection limit, less SLACK in cosine.
INLIERS, SLACK = 0.995, 0.15
UNKNOWN = "und"

_lower: np.ndarray | None = None


def _table() -> np.ndarray:
    """For each code point its lower-case letter's code, or that of a space."""
    global _lower
    if _lower is None:
        _lower = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            s = chr(c)
            if s.isalpha():
                _lower[c] = ord(s.lower()[0])
    return _lower


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str, dims: int = DIMS) -> np.ndarray:
    """How often each bucket of 1-, 2- and 3-grams occurs."""
    codes = _table()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(codes) > 1:  # a run of other characters is one space
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    one = codes * np.uint32(0x9E3779B1)
    two = one[1:] ^ codes[:-1] * np.uint32(0x85EBCA77)
    three = two[1:] ^ codes[:-2] * np.uint32(0xC2B2AE3D)
    out = np.zeros(dims, np.int64)
    for k, h in enumerate((one, two, three)):
        h = (h + np.uint32(k)) * np.uint32(0x27D4EB2F)
        h ^= h >> np.uint32(15)
        out += np.bincount(h * np.uint32(0x165667B1) >> shift, minlength=dims)
    return out


def unit(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(rows.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    limits: np.ndarray


def cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from the first row and those furthest from what is chosen."""
    chosen = [0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", dims: int = DIMS, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Model | None:
    """Learns from rows with a language and a letter; None if there is none.

    The sample is by a hash of id and text, at a rate that gives about sample
    rows a language, and cut at twice that, by the hash. Repeated rows count as
    often as they occur, null ids are ids like others, texts of any length are
    learned from whole.
    """
    rows = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(ident).cast("string"), F.col(text)).alias("h"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if has_letter(t):
                    n, df = seen.get(name, (0, np.zeros(dims, np.int64)))
                    seen[name] = n + 1, df + (counts(t, dims) > 0)
        for name, (n, df) in seen.items():
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *df[at].tolist()], pa.int64())], ["lang", "bucket", "n"])

    # dims + 1 numbers a language
    table = rows.select("lang", "text").mapInArrow(frequencies, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(table):
        return None
    total = table[table.bucket < 0].set_index("lang").n
    df = np.zeros(dims)
    own = table[table.bucket >= 0]
    np.add.at(df, own.bucket.to_numpy(), own.n.to_numpy())
    idf = (np.log((1 + total.sum()) / (1 + df)) + 1).astype(np.float32)

    rate = F.create_map(*[F.lit(x) for name, n in total.items() for x in (name, min(1.0, sample / n))])[F.col("lang")]
    picked = rows.filter(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30)).select("lang", "text", "h")
    # rows of one language in the order of their hashes, so reruns take the same ones
    first = Window.partitionBy("lang").orderBy("h")
    picked = picked.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= 2 * sample).drop("nth")

    def centroids_of(group: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in group.sort_values("h").text if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "c": [], "limit": []})
        x = unit(np.stack([counts(t, dims) for t in texts]), idf)
        c = cluster(x, centroids, ROUNDS)
        near = x @ c.T
        own = [near[near.argmax(axis=1) == j, j] for j in range(len(c))]
        return pd.DataFrame({"lang": group.lang.iloc[0], "c": [v.astype(np.float32).tobytes() for v in c], "limit": [float(np.quantile(m, 1 - INLIERS)) - SLACK if len(m) else 0.0 for m in own]})

    # a language's sample is one task's; its centroids alone go to the driver
    found = picked.groupBy("lang").applyInPandas(centroids_of, "lang string, c binary, limit double").toPandas()
    if not len(found):
        return None
    found = found.sort_values("lang", kind="stable")
    return Model(idf, np.stack([np.frombuffer(c, np.float32) for c in found.c]), found.lang.tolist(), found.limit.to_numpy())


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine to the nearest centroid, 0 to 1) and lang_rejected.

    Null texts and texts without letters, and all texts where nothing could be
    learned, are UNKNOWN with score 0, rejected. Texts of any length are judged
    whole, repeated rows alike; an empty table gives an empty one. Columns of docs with these names are
    replaced; others pass through. Ties go to the language first by name.
    """
    docs = docs.drop("lang_pred", "score", "lang_rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dims * (1 + centroids * languages) numbers

    @F.pandas_udf("lang_pred string, score double, lang_rejected boolean")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        names, scores, far = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts), bool)
        asked = [i for i, t in enumerate(texts) if t is not None and m is not None and has_letter(t)]
        for a in range(0, len(asked), 512):
            part = asked[a : a + 512]
            near = unit(np.stack([counts(texts.iloc[i], len(m.idf)) for i in part]), m.idf) @ m.centroids.T
            best = near.argmax(axis=1)
            names[part] = [m.langs[j] for j in best]
            scores[part] = np.clip(near.max(axis=1), 0, 1)
            far[part] = near.max(axis=1) < m.limits[best]
        return pd.DataFrame({"lang_pred": names, "score": scores, "lang_rejected": far})

    return docs.withColumn("__p", nearest(F.col(text))).select(*[F.col(f"`{c}`") for c in docs.columns], "__p.*")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "text", "held_out"), model).drop("text")

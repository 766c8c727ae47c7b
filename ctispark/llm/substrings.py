"""Substring dedup: repeats of WINDOW words, found with compressed FM-indexes.

Each window of words is dealt out by an anchor, the smallest hash of the
shorter word n-grams within it, so equal windows meet wherever they stand.
Neighbouring windows with one anchor are a segment. Anchors that stand in one
document only are dropped; equal segments are one, with the smallest id among
their documents, and those of other documents are repeats. What remains are
different segments around one anchor. A shard holds those of some anchors: an
FM-index over their words, with the Burrows-Wheeler transform in a wavelet
matrix of packed bits. The segments are streamed through it by backward
search, one word a step; at each step the match is shortened to WINDOW - 1
words (rows of the suffix array that agree in so many) before the next word is
put in front. An interval of rows that reaches WINDOW words and has a row of a
smaller id is a repeat.

Around an anchor with over HOT different segments each window is its own
segment, so nothing is left to search there and no shard grows with the input.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctispark.llm.common import hub_join, read, staged
from ctispark.llm.shingles import mixed, ngrams, split, word_hashes

WINDOW, ANCHOR = 50, 10
#: Windows of a segment at most.
LONGEST = 400
#: Words of a shard, about.
SHARD_WORDS = 1_000_000
#: An anchor of up to so many different segments is searched in one shard: HOT * (LONGEST + WINDOW) words at most.
HOT = 2_000
#: Up to so many ranges of documents (at most 40 bytes each) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_RANGES = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(1024, 2 * n)
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        one = np.ones(1, np.uint64)
        _powers = np.cumprod(np.concatenate((one, np.full(size, _BASE))), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate((one, np.full(size, back))), dtype=np.uint64)


def range_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words h[start:end] for each range, the same wherever these words stand."""
    _grow(len(h))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers[: len(h)], dtype=np.uint64)))
    return mixed((sums[end] - sums[start]) * _inverse[start] + (end - start).astype(np.uint64))


def segments(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first window, last window + 1) of a document's segments; together they hold each window once."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, width, reach = ngrams(h, anchor), window - anchor + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: reach - width], low[width - reach :])
    begins = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    ends = np.append(begins[1:], n)
    long = np.flatnonzero(ends - begins > LONGEST)
    if len(long):
        cut = [np.arange(begins[i] + LONGEST, ends[i], LONGEST) for i in long]
        begins = np.sort(np.concatenate([begins, *cut]))
        ends = np.append(begins[1:], n)
    return low[begins], begins, ends


class FMIndex:
    """Over sequences of numbers: suffix array rows, sorted by at least window numbers, and backward search on them."""

    def __init__(self, sequences: list[np.ndarray], window: int):
        _, ranks = np.unique(np.concatenate(sequences), return_inverse=True)
        lengths = np.array([len(s) for s in sequences])
        n = int(lengths.sum() + len(lengths))
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        text = np.zeros(n, np.int64)  # 0 ends a sequence
        inside = np.ones(n, bool)
        inside[self.starts + lengths] = False
        text[inside] = ranks + 1
        self.window, self.size = window, n
        # ranks by prefixes of doubled length; those of powers of two up to the window are kept to compare prefixes of any length
        rank, by_length = text, {1: text.astype(np.int32)}
        size = 1
        while True:
            shifted = np.zeros(n, np.int64)
            shifted[: n - size] = rank[size:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + shifted
            order = np.argsort(key, kind="stable")
            key = key[order]
            size *= 2
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            if size <= window:
                by_length[size] = rank.astype(np.int32)
            if size >= window:
                break
        del rank, key, shifted
        # of the suffix array there stay which sequence a row begins in, and which rows agree in window - 1 numbers
        self.owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)[order]
        self.short_lo, self.short_hi = self._groups(order, by_length, window - 1)
        self.queries, self.lengths = [text[a : a + k].astype(np.int32) for a, k in zip(self.starts.tolist(), lengths.tolist(), strict=True)], lengths
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        bwt = text[order - 1].astype(np.int32)
        del order, by_length, text
        self._wavelet(bwt)

    def _wavelet(self, bwt: np.ndarray) -> None:
        n, self.levels, now = len(bwt), max(1, int(bwt.max(initial=0)).bit_length()), bwt
        self.bits, self.ones, self.zeros = [], [], []
        first = np.arange(int(bwt.max(initial=0)) + 1)
        start = np.zeros(len(first), np.int64)
        for level in reversed(range(self.levels)):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(64 + -n % 64, bool))), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)))[:-1].astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))
            start = self._down(len(self.bits) - 1, start, first >> level & 1)
        self.start = start

    def _down(self, k: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        word = at >> 6
        ones = self.ones[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        return np.where(bit == 1, self.zeros[k] + ones, at - ones)

    def extend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The row bounds at, once symbol stands in front of the match."""
        pos = at
        for k in range(self.levels):
            pos = self._down(k, pos, symbol >> (self.levels - 1 - k) & 1)
        return self.before[symbol] + pos - self.start[symbol]

    def _groups(self, rows: np.ndarray, by_length: dict[int, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the bounds of the rows that agree with it in so many numbers."""
        n = self.size
        differs = np.zeros(n, bool)
        differs[0] = True
        done = 0
        for size in sorted(by_length, reverse=True):
            while length - done >= size:
                value = np.where(rows + done < n, by_length[size][np.minimum(rows + done, n - 1)], -1)
                differs[1:] |= value[1:] != value[:-1]
                done += size
        bounds = np.append(np.flatnonzero(differs), n).astype(np.int32)
        mine = np.cumsum(differs, dtype=np.int32) - 1
        return bounds[mine], bounds[mine + 1]

    def matches(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each window that also stands in a sequence of a smaller number in least."""
        lengths = self.lengths
        value = np.append(least[self.owner], np.iinfo(np.int64).max)
        stream = np.concatenate(self.queries) if self.queries else np.zeros(0, np.int32)
        end = np.cumsum(lengths)
        alive = np.flatnonzero(lengths >= self.window)
        lo, hi, size = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.size), 0
        found: list[tuple[np.ndarray, ...]] = []
        for step in range(1, int(lengths.max(initial=0)) + 1):
            alive = alive[lengths[alive] >= step]
            if not len(alive):
                break
            if size == self.window:  # all matches are as long as a window: shorten them
                row = lo[alive]
                lo[alive], hi[alive], size = self.short_lo[row], self.short_hi[row], size - 1
            symbol = stream[end[alive] - step]
            lo[alive], hi[alive] = self.extend(symbol, lo[alive]), self.extend(symbol, hi[alive])
            size += 1
            if size == self.window:
                found.append((alive, lengths[alive] - step, lo[alive], hi[alive]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seq, offset, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        spans, at = np.unique(lo, return_inverse=True)
        upto = np.zeros(len(spans), np.int64)
        upto[at] = hi
        lowest = np.minimum.reduceat(value, np.stack((spans, upto), 1).ravel())[::2]
        hit = lowest[at] < least[seq]
        return seq[hit], offset[hit]


def _keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row: a number for the row, the same for equal ones. id: its id, null as the largest."""
    return docs.select(F.xxhash64(F.col(doc_id).cast("string"), text).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(text).alias("text"))


def _with_texts(texts: DataFrame, per_row: DataFrame, ranges: str, how: str) -> DataFrame:
    """texts joined with a table that has an array of ranges a row of theirs, which is broadcast while it is small."""
    total = per_row.agg(F.sum(F.size(ranges) + 1)).first()[0] or 0
    side = F.broadcast(per_row) if total <= BROADCAST_RANGES else per_row
    return texts.join(side, "row", how)


def _merged(spans: Column) -> Column:
    """Sorted ranges, those that touch or overlap as one."""
    start = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("done"), spans[0].alias("now"))

    def step(a: Column, x: Column) -> Column:
        touches = x["s"] <= a["now"]["e"]
        grown = F.struct(a["now"]["s"].alias("s"), F.greatest(a["now"]["e"], x["e"]).alias("e"))
        return F.struct(F.when(touches, a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))).alias("done"), F.when(touches, grown).otherwise(x).alias("now"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["done"], F.array(a["now"])))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(row, spans): for each row of docs with repeats, by its hash, the ranges [first, last + 1) of repeated windows' starts as array<struct<s,e>>."""
    texts = _keys(docs, doc_id, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for row, id_, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = word_hashes(split(t))
                a, s, e = segments(h, window, anchor)
                if len(a):
                    content = range_hashes(h, s, e + (window - 1))
                    for k, x in enumerate((np.full(len(a), row), np.full(len(a), id_), a.view(np.int64), content.view(np.int64), s, e)):
                        out[k].append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64 if k < 4 else np.int32)) for k, x in enumerate(out)], ["row", "id", "anchor", "content", "s", "e"])

    every = staged(texts.mapInArrow(cut, "row long, id long, anchor long, content long, s int, e int"))
    total = every.count()
    per = staged(every.groupBy("anchor", "content").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")))
    shared = per.groupBy("anchor").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), F.count(F.lit(1)).alias("k")).filter("lo < hi").select(F.col("anchor").alias("a2"), "k")
    # a content has one anchor, so it alone finds its row
    contents = staged(hub_join(per, "anchor", staged(shared), "a2", "k", total).select(F.col("content").alias("c2"), "least", "n", "k"))
    judged = staged(hub_join(every, "content", contents, "c2", "n", total).select("row", "id", "anchor", "s", "e", "least", "k"))
    copies = judged.filter("id > least").select("row", "s", "e")

    # a content's segments in its first document, where an anchor has several contents
    left = judged.filter("id = least and k > 1").select("row", "anchor", (F.col("k") > HOT).alias("hot"), "s", "e").distinct()
    asked = staged(left.groupBy("row").agg(F.collect_list(F.struct("anchor", "hot", "s", "e")).alias("parts")))
    asked_words = asked.agg(F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["e"] - p["s"] + window - 1))).first()[0] or 0
    shards = max(1, -(-asked_words // SHARD_WORDS))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The asked segments' words as hashes; of a hot anchor's, a row for each window with its hash and no words."""
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                out: list[list] = [[], [], [], [], []]
                for row, id_, t, parts in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True):
                    h = word_hashes(split(t))
                    for p in parts:
                        s, e = p["s"], p["e"]
                        if p["hot"]:
                            at = np.arange(s, e)
                            for x, w in zip(at.tolist(), range_hashes(h, at, at + window).view(np.int64).tolist(), strict=True):
                                for c, v in zip(out, (row, id_, w, x, None), strict=True):
                                    c.append(v)
                        else:
                            for c, v in zip(out, (row, id_, p["anchor"], s, h[s : e + window - 1].tobytes()), strict=True):
                                c.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], ["row", "id", "key", "s", "words"])

    taken = staged(_with_texts(texts, asked, "parts", "inner").select("row", "id", "text", "parts").mapInArrow(take, "row long, id long, key long, s long, words binary").distinct())

    def search(part: pd.DataFrame) -> pd.DataFrame:
        index = FMIndex([np.frombuffer(w, np.uint64) for w in part.words], window)
        seq, offset = index.matches(part.id.to_numpy())
        row, s = part.row.to_numpy()[seq], part.s.to_numpy()[seq] + offset
        order = np.lexsort((s, row))
        row, s = row[order], s[order]
        # windows one behind the other are one range
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (s[1:] > s[:-1] + 1)))) if len(s) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(s)) - 1
        return pd.DataFrame({"row": row[first], "s": s[first].astype(np.int32), "e": (s[last] + 1).astype(np.int32)})

    searched = taken.filter("words is not null").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(search, "row long, s int, e int")
    single = taken.filter("words is null")
    lowest = staged(single.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).withColumnRenamed("key", "k2"))
    hot = hub_join(single, "key", lowest, "k2", "n", single.count()).filter("id > least").select("row", F.col("s").cast("int").alias("s"), (F.col("s") + 1).cast("int").alias("e"))
    spans = copies.unionByName(searched).unionByName(hot)
    return staged(spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("all")).select("row", _merged(F.col("all")).alias("spans")))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept), a row for each row of docs.

    removed lists the ranges [start, end) of words that are covered by a
    window whose words also start in a document of a smaller id; kept is the
    other words, joined by a space. Null texts have no words. Null ids count as
    larger than all others; rows that share an id do not repeat each other.
    Texts of fewer words than the window lose nothing, texts of any length are
    judged whole. Other columns are not returned, whatever their names; empty
    input gives empty output.
    """
    found = repeats(docs.select(doc_id, text), doc_id, text, window, anchor)
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.xxhash64(F.col(doc_id).cast("string"), text).alias("row"), F.col(doc_id).alias("given"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ns, gone, ranges, kept = [], [], [], []
                for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = split(t)
                    out: list[dict] = []
                    for p in spans or ():
                        s, e = p["s"], p["e"] + window - 1
                        if out and s <= out[-1]["end"]:
                            out[-1]["end"] = max(e, out[-1]["end"])
                        else:
                            out.append({"start": s, "end": e})
                    left, at = [], 0
                    for r in out:
                        left += words[at : r["start"]]
                        at = r["end"]
                    left += words[at:]
                    ns.append(len(words)), gone.append(len(words) - len(left)), ranges.append(out), kept.append(b" ".join(left))
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ns, pa.int64()), pa.array(gone, pa.int64()), pa.array(ranges, span), pa.array(kept, pa.binary()).cast(pa.string())], [doc_id, "n_words", "n_removed", "removed", "kept"])

    joined = _with_texts(texts, found, "spans", "left").select("given", "text", "spans")
    return joined.mapInArrow(cut, f"`{doc_id}` {kind}, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

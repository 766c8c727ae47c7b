"""How filters interact: truth-table survival words, counted by carry-save positional popcounts.

A document's failed filters are a mask of five bits. Its survival word has 32
bits, one for each subset of the filters: bit s is set if the document survives
the filters of s. Added up bit by bit over the documents of a part and label,
the words give the survivors of every subset at once, and from these follow the
counts of any order of the filters: no order is run.

Words are added by carry-save adders on whole words, three of a plane giving
one of the plane and a carry of the next, so 32 counts cost some five bit
operations a word. Each task adds up its own rows; what meets afterwards is one
row a batch, part and label.
"""

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctispark.llm.common import let, read, words

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: By mask of failed filters, the survival word: bit s is set if s holds none of them.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & mask) for mask in range(SUBSETS)], np.uint32)
LABELS = ("all", "good", "toxic")
COUNTS = "part string, label string, survivors array<long>"


def text_mask(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 0 to 3: few words, few different words, many capitals, a symbol."""
    bit = lambda failed, i: F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))

    def of_words(w: Column) -> Column:
        return bit(F.size(w) < 100, 0) + bit(100 * F.size(F.array_distinct(w)) < 80 * F.size(w), 1)

    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return let(words(text), of_words) + bit(100 * capitals > 10 * F.length(text), 2) + bit(text.rlike("[#$%&*|]"), 3)


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, good, toxic, mask, n): how many documents of a part and label fail just these filters.

    E, failed by documents whose text a smaller id has too, is told by the
    smallest id of each text's digest. Rows that agree are counted before they
    are shuffled, so a text of very many copies is a few rows a task.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(t, 256))
    # a row without an id has no label; its digest keeps such rows apart
    key = F.when(F.col(doc_id).isNull(), F.concat(F.lit("-"), F.hex(digest))).otherwise(F.concat(F.lit("="), F.col(doc_id).cast("string")))
    slim = docs.select(key.alias("key"), F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), digest.alias("digest"), text_mask(t).alias("mask"))
    rows = slim.groupBy("key", "id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    told = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.concat(F.lit("="), F.col("doc_id").cast("string")).alias("key")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(told, "key", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    # rows of one id, text, part and label are one by now, so the smallest id's count comes along with it
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = rows.groupBy("digest", "part", "good", "toxic", "mask").agg(F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("loose"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    stays = F.col("loose") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = groups.withColumn("least", least).withColumn("stays", stays)
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stays")).alias("n"))))
    return split.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0")


def positional_popcount(word: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each bit, the sum of the weights of the words that have it, by carry-save adders.

    Plane j holds words that count 2**j each: those whose weight has bit j, and
    the carries from the plane below.
    """
    counts, carries, j = np.zeros(SUBSETS, np.int64), np.zeros(0, np.uint32), 0
    while carries.size or weight.any():
        lane, carried = np.concatenate([carries, word[(weight & 1) == 1]]), []
        while lane.size > 2:
            k = lane.size // 3
            a, b, c = lane[:k], lane[k : 2 * k], lane[2 * k : 3 * k]
            half = a ^ b
            carried.append(a & b | half & c)
            lane = np.concatenate([half ^ c, lane[3 * k :]])
        if lane.size == 2:
            carried.append(lane[:1] & lane[1:])
            lane = lane[:1] ^ lane[1:]
        if lane.size:
            counts += ((lane[0] >> np.arange(SUBSETS, dtype=np.uint32)) & 1).astype(np.int64) << j
        carries = np.concatenate(carried) if carried else np.zeros(0, np.uint32)
        weight, j = weight >> 1, j + 1
    return counts


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, good, toxic, mask, n = (batch.column(i) for i in range(5))
        names = part.dictionary_encode()
        at, word, weight = names.indices.to_numpy(), WORDS[mask.to_numpy()], n.to_numpy().astype(np.int64)
        marks = {"all": np.ones(len(at), bool), "good": good.to_numpy(zero_copy_only=False), "toxic": toxic.to_numpy(zero_copy_only=False)}
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
        found = [(names.dictionary[at[rows[0]]].as_py(), label, positional_popcount(word[rows[marks[label][rows]]], weight[rows[marks[label][rows]]])) for rows in np.split(order, cuts[1:]) if rows.size for label in LABELS]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2].tolist() for f in found], pa.list_(pa.int64()))], ["part", "label", "survivors"])


def subset_survivors(rows: DataFrame) -> DataFrame:
    """(part, all, good, toxic): a row a part; of each label, how many documents survive the subset s of the filters, at place s."""
    partial = rows.select("part", "good", "toxic", "mask", "n").mapInArrow(_popcounts, COUNTS)
    sums = {label: [F.sum(F.when(F.col("label") == label, F.col("survivors")[s]).otherwise(0)) for s in range(SUBSETS)] for label in LABELS}
    return partial.groupBy("part").agg(*[F.array(*sums[label]).alias(label) for label in LABELS])


def interactions(survivors: DataFrame) -> DataFrame:
    """The counts of every order of the filters and step of it, from the survivors of subsets."""
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    steps = survivors.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = "shiftleft(1, ascii(substr(filter_order, {}, 1)) - ascii('A'))"
    steps = steps.withColumn("own", F.expr(bit.format("step"))).withColumn("before", F.expr(f"aggregate(sequence(1, step), 0, (a, i) -> a + if(i < step, {bit.format('i')}, 0))"))
    lost = lambda label: F.expr(f"`{label}`[before] - `{label}`[before + own]")
    out = steps.select(
        "part", "filter_order", "step", "own", F.expr("`all`[before + own]").alias("kept"), lost("all").alias("removed"), (F.expr("`all`[0] - `all`[own]") - lost("all")).alias("redundant"),
        F.expr(f"`all`[{SUBSETS - 1} - own] - `all`[{SUBSETS - 1}]").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the five filters over docs.

    A null text is empty, a null part the empty string. A row without an id has
    no label, has no smaller id and is none, so E spares it and it costs no
    other row anything. Repeated rows count each; of rows that share the
    smallest id of a text E fails none. A document whose label rows disagree is
    good, or toxic, if any of them says so; null labels say nothing. Texts of
    any length are judged whole. Other columns are not looked at, whatever
    their names. Empty input has no parts and gives no rows.
    """
    return interactions(subset_survivors(masks(docs, labels, doc_id, text, part)))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


OP11_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
m as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)::int as mask
  from d left join l on d.doc_id = l.doc_id),
c as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by part, mask),
x as (select unnest([0, 1, 2, 3, 4]) as i),
p as (select [a.i, b.i, c.i, d.i, e.i] as o from x a, x b, x c, x d, x e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select array_to_string(list_transform(o, lambda i: chr(65 + i)), '') as filter_order, k as step, 1 << o[k] as own, coalesce(list_sum(list_transform(o[1:k - 1], lambda i: 1 << i)), 0)::bigint as before from p, unnest([1, 2, 3, 4, 5]) as t(k)),
g as (
  select part, filter_order, step, own, sum(case when mask & (before | own) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & before = 0 and mask & own <> 0 then n else 0 end)::bigint as removed, sum(case when mask & before <> 0 and mask & own <> 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = own then n else 0 end)::bigint as unique_fails, sum(case when mask & before = 0 and mask & own <> 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & before = 0 and mask & own <> 0 then toxic else 0 end)::bigint as toxic_lost
  from c, s group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from g
"""

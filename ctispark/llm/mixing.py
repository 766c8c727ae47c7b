"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document of a source that is to be taken r times over is expected r times in
the mix. The documents of a source stand in a fixed order; their expected
copies are summed up in that order, one random offset is added, and a document
is emitted once for each integer that the running sum crosses at it.

The order is by size class, then by a hash of the id, then by id, so documents
of like size are neighbours and the words taken come close to the target. The
running sum is built on three levels (size classes of a source, hash parts of
a class, documents of a part), so no task holds a whole source.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctispark.llm.common import read, staged, words

MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: Hash parts of a size class: this many, and one more for each PART_ROWS rows of the input.
PARTS, PART_ROWS = 64, 1_000_000


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size): a row a source. Adds target.

    Sources weigh weights in turn, by code point, null last, and share the sum
    of all sizes; a target stops at most times its source's size and what is
    over goes to the others by weight. That is a level L with target
    min(most * size, L * weight): sources are ranked by the level at which they
    fill up, and L is read off at the first that does not. One row a source
    goes through one task here, not the documents.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int")).cast("long"))
    fill = Window.orderBy((F.col("source_size") * most / F.col("__w")).asc(), "__rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    steps = weighed.withColumn("__left", left).withColumn("__ws", F.sum("__w").over(onward)).withColumn("__at", F.row_number().over(fill))
    open_ = F.col("__left") * F.col("__w") <= F.col("source_size") * most * F.col("__ws")
    first = F.min(F.when(open_, F.struct("__at", "__left", "__ws"))).over(everything)
    return (
        steps.withColumn("__first", first)
        .withColumn("target", F.when(F.col("__at") < F.col("__first.__at"), F.col("source_size") * F.lit(float(most))).otherwise(F.col("__first.__left").cast("double") / F.col("__first.__ws") * F.col("__w")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row).

    Null texts have size 0; a null source is a source of its own, the last. A
    null id is a value like others. Repeated rows are rows of their own.
    Sources without words take nothing. Other columns pass through; columns of
    docs named mix_* are replaced. Empty input gives empty output.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    # null sources and ids get keys of their own, so that plain equality joins find them
    key = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source)))
    digits = F.col("mix_size").cast("string")
    kind = F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    slim = staged(docs.select(key.alias("__key"), F.col(source).alias("source"), size_of(F.col(text)).alias("mix_size"), ident.alias("__ident")))
    parts = max(PARTS, -(-slim.count() // PART_ROWS))
    part = F.pmod(_hex(F.col("__ident"), 8), F.lit(parts))

    counts = slim.groupBy("__key", kind.alias("__kind"), part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.unboundedPreceding, -1
    in_kind = Window.partitionBy("__key", "__kind").orderBy("__part").rowsBetween(*up_to)
    in_key = Window.partitionBy("__key").orderBy("__kind").rowsBetween(*up_to)
    kinds = counts.groupBy("__key", "__kind").agg(F.sum("__n").alias("__n"))
    kinds = kinds.select("__key", "__kind", F.coalesce(F.sum("__n").over(in_key), F.lit(0)).alias("__base"))
    offsets = counts.withColumn("__inner", F.coalesce(F.sum("__n").over(in_kind), F.lit(0))).join(kinds, ["__key", "__kind"])
    sizes = slim.groupBy("__key", "source").agg(F.sum("mix_size").alias("source_size"))
    rates = sizes.join(targets(sizes.select("source", "source_size"), weights, most).select("source", "target").withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    starts = staged(
        offsets.join(rates, "__key").select(
            "__key", "__kind", "__part", (F.col("__base") + F.col("__inner")).alias("__start"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"), (_hex(F.concat(F.lit(f"{seed}:"), F.col("__key")), 5) / 1048576.0).alias("__offset"),
        )
    )

    rows = docs.withColumn("__key", key).withColumn("mix_size", size_of(F.col(text))).withColumn("__ident", ident)
    rows = rows.withColumn("__kind", kind).withColumn("__part", part)
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__key", "__kind", "__part").orderBy(F.col(doc_id).asc_nulls_last(), "mix_size", F.xxhash64(text), F.col(text))))
    rows = rows.join(starts, ["__key", "__kind", "__part"])
    run = lambda nth: F.floor((F.col("__start") + nth) * F.col("__rate") + F.col("__offset"))
    copies = F.least(run(F.col("__nth")) - run(F.col("__nth") - 1), F.lit(most)).cast("long")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_size", "mix_source_size", "mix_target", copies.alias("mix_copies"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.col("mix_copies").alias("copies"))


OP3_SQL = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rk from s),
w as (select *, [1, 2, 3][(rk % 3 + 1)::int]::bigint as w from r),
f as (
  select *, row_number() over o as at_,
    (sum(source_size) over ())::bigint - 3 * coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as left_,
    (sum(w) over (o rows between current row and unbounded following))::bigint as ws
  from w window o as (order by source_size * 3 / w, rk)),
l as (select min(at_) as at0, arg_min(left_, at_) as left0, arg_min(ws, at_) as ws0 from f where left_ * w <= source_size * 3 * ws),
t as (
  select source, source_size, case when at_ < at0 then source_size * 3.0::double else left0::double / ws0 * w end as target,
    ('0x' || substr(md5('{SEED}:' || case when source is null then '' else '=' || source end), 1, 5))::bigint / 1048576.0::double as u
  from f, l),
q as (select greatest({PARTS}, ceil(count(*) / {PART_ROWS}.0))::bigint as parts from d),
p as (
  select d.*, length(size::varchar) * 100 + substr(size::varchar, 1, 2)::int as kind,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 8))::bigint % parts as part
  from d, q),
n as (
  select p.*, t.source_size, t.target, t.u, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
    row_number() over (partition by p.source order by kind, part, doc_id) as k
  from p join t on p.source is not distinct from t.source)
select doc_id, size, source_size, target, copies * size as taken, copies
from (select *, least(floor(k * rate + u) - floor((k - 1) * rate + u), 3)::bigint as copies from n)
"""

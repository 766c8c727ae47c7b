"""Shards by fixed virtual slots, in DataFrame operations only.

A record's id is hashed into one of SLOTS slots, which never changes. Bytes are
added up by slot. A map from slots to shards, with a version, says where a slot
is; rebalancing edits it: each shard keeps its largest slots up to the target,
the others move to the emptiest shards, largest first. Whoever holds a map
places a record by its id alone; only slots that the edit names move.

The map has a row a slot, so what meets in one task or is broadcast is SLOTS
rows, whatever the number of records.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctispark.llm.common import read, shared_dir, staged
from ctispark.llm.manifest import CRC_TABLE, crc_sql

SLOTS, SHARDS = 8192, 24
#: Bytes that a record has besides its text.
OVERHEAD = 8
#: A slot is numbered in one part, and in one more for each PART_ROWS rows of a slot of average size.
PART_ROWS = 1_000_000
MAP = "vslot int, shard int, version int"


def _hash(doc_id: Column, crc: Column, at: int) -> Column:
    """32 bits of the id's hash; of rows without an id, of their text's checksum."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("-"), F.coalesce(crc.cast("string"), F.lit("-"))))
    return F.conv(F.substring(F.md5(key), at, 8), 16, 10).cast("long")


def slot_of(doc_id: Column, crc: Column, slots: int = SLOTS) -> Column:
    return F.pmod(_hash(doc_id, crc, 1), F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame, size: str = "size") -> DataFrame:
    """(vslot, bytes) of rows with a vslot."""
    return rows.groupBy("vslot").agg(F.sum(size).alias("bytes"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: each shard gets a run of slots of the same length, or one more."""
    return spark.range(slots).select(F.col("id").cast("int").alias("vslot"), F.floor(F.col("id") * shards / slots).cast("int").alias("shard"), F.lit(1).alias("version"))


def rebalance(map_: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map, over as many shards as asked for: fewer, more or the same.

    A shard keeps its largest slots while their bytes stay within the target,
    a shards' share of all bytes, and its largest in any case; slots without
    bytes stay too. The rest, and all slots of shards that are no longer, go to
    the shard that has least, largest slot first, ties by number. Added up and
    dealt out in one row of the plan: a map has SLOTS entries.
    """
    known = map_.join(sizes, "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long"))
    own = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    sofar = F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum("bytes").over(Window.partitionBy())
    fits = (F.col("sofar") * shards <= F.col("total")) | (F.col("bytes") == 0) | (F.col("nth") == 1)
    ranked = known.withColumns({"sofar": sofar, "nth": F.row_number().over(own), "total": all_})
    told = ranked.withColumn("stays", (F.col("shard") < shards) & fits)
    moves = F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("minus"), "vslot"))))
    # conditional sums would be a column a shard; the entries of shards that keep something are enough
    kept = told.groupBy("shard", "version").agg(F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0)).alias("load"), F.collect_list(F.when(F.col("stays"), F.col("vslot"))).alias("stay"), moves.alias("moves"))
    one = kept.agg(F.max("version").alias("version"), F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("load"), F.flatten(F.collect_list(F.transform("stay", lambda v: F.struct(v.alias("vslot"), F.col("shard").alias("shard"))))).alias("stay"), F.sort_array(F.flatten(F.collect_list("moves"))).alias("moves"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at(F.col("load"), i), F.lit(0).cast("long")))
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("dealt"))

    def deal(state: Column, move: Column) -> Column:
        to = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        fuller = F.transform(state["loads"], lambda x, i: F.when(i == to, x - move["minus"]).otherwise(x))
        return F.struct(fuller.alias("loads"), F.concat(state["dealt"], F.array(F.struct(move["vslot"].alias("vslot"), to.alias("shard")))).alias("dealt"))

    dealt = F.aggregate("moves", start, deal, lambda state: state["dealt"])
    return one.select(F.explode(F.concat("stay", dealt)).alias("e"), "version").select("e.vslot", "e.shard", (F.col("version") + 1).alias("version"))


def store_map(map_: DataFrame, root: str) -> DataFrame:
    """map_, written as its version below root and read again; versions written before stay, and a version is never written twice."""
    map_.select("vslot", "shard", "version").repartition(1).write.partitionBy("version").mode("append").parquet(root)
    return load_map(map_.sparkSession, root)


def load_map(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A stored map of a version, the newest if none is named."""
    found = spark.read.schema(MAP).parquet(root)
    newest = found.agg(F.max("version")).first()[0] if version is None else version
    return found.filter(F.col("version") == newest)


def placed(rows: DataFrame, map_: DataFrame) -> DataFrame:
    """rows with a vslot, with shard and version. A map's SLOTS rows of 12 bytes are broadcast."""
    return rows.join(F.broadcast(map_.select("vslot", "shard", "version")), "vslot")


def numbered(rows: DataFrame, total: int, doc_id: str = "doc_id", crc: str = "text_crc32", slots: int = SLOTS) -> DataFrame:
    """rows (of total) with slot, the place within the shard, from 0 without gaps: slots in turn, rows of a slot by hash part, id and checksum.

    Running sums of counts by slot and part give where a part begins, so a task
    sorts a part and never a shard.
    """
    parts = 1 + total // (slots * PART_ROWS)
    dealt = rows.withColumn("__part", F.pmod(_hash(F.col(doc_id), F.col(crc), 9), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "vslot", "__part").agg(F.count(F.lit(1)).alias("__n"))
    start = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("vslot", "__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("vslot", "__part", start.alias("__start"))
    nth = F.row_number().over(Window.partitionBy("vslot", "__part").orderBy(F.col(doc_id).asc_nulls_last(), crc))
    return dealt.withColumn("__nth", nth).join(starts, ["vslot", "__part"]).withColumn("slot", F.col("__start") + F.col("__nth") - 1).drop("__part", "__nth", "__start")


def shard(docs: DataFrame, root: str, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, shard, version, slot): where the records of docs go, by the map stored below root.

    Where there is no map yet, version 1 is written, edited for the bytes of
    docs and written as version 2; else the newest map is edited and the next
    version written. A null text has no bytes and no checksum and costs
    OVERHEAD alone. A row without an id is hashed by its text's checksum.
    Repeated rows share a slot of the map and get places of their own. Texts of
    any length count whole; a text larger than a shard's share makes its shard
    that much larger. Other columns are not looked at, whatever their names.
    Empty input gives empty output, and a map all the same.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.col(text))
    size = F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + OVERHEAD
    slim = staged(docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32")).withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots)))
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    old = load_map(spark, root) if known else store_map(first_map(spark, shards, slots), root)
    new = store_map(rebalance(old, slot_sizes(slim), shards), root)
    return numbered(placed(slim, new), slim.count(), slots=slots)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark).rstrip('/')}/shard-map-{uuid.uuid4().hex}"
    rows = shard(read(spark, sf_dir, "documents").select("doc_id", "text"), root)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))


OP13_SQL = f"""
with recursive k as materialized ({CRC_TABLE}),
d as materialized (select doc_id, coalesce(strlen(text), 0)::bigint + {OVERHEAD} as size, case when text is not null then {crc_sql('text')}::bigint end as crc from documents, k),
h as materialized (select *, (('0x' || substr(md5(coalesce(doc_id::varchar, '-' || coalesce(crc::varchar, '-'))), 1, 8))::bigint % {SLOTS})::int as vslot from d),
b as (select vslot, sum(size)::bigint as bytes from h group by vslot),
s as (select i::int as vslot, coalesce(bytes, 0) as bytes, (i * {SHARDS} // {SLOTS})::int as shard from range({SLOTS}) r(i) left join b on b.vslot = i),
o as (
  select *, (sum(bytes) over (partition by shard order by bytes desc, vslot rows unbounded preceding))::bigint as sofar, row_number() over (partition by shard order by bytes desc, vslot) as nth, (sum(bytes) over ())::bigint as total
  from s),
p as materialized (select *, sofar * {SHARDS} <= total or bytes = 0 or nth = 1 as stays from o),
m as materialized (select vslot, bytes, row_number() over (order by bytes desc, vslot) as i from p where not stays),
l as (select list(x order by shard) as loads from (select shard, sum(case when stays then bytes else 0 end)::bigint as x from p group by shard)),
r(i, vslot, shard, loads) as (
  select 0::bigint, -1, -1, loads from l
  union all
  select m.i, m.vslot, (list_position(loads, list_min(loads)) - 1)::int, list_transform(loads, lambda x, j: case when j = list_position(loads, list_min(loads)) then x + m.bytes else x end) from r join m on m.i = r.i + 1),
f as (select vslot, shard from p where stays union all select vslot, shard from r where i > 0)
select doc_id, size, crc as text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by vslot, doc_id) - 1)::bigint as slot, null::int as grown_shard, vslot, 2 as map_version
from h join f using (vslot)
"""

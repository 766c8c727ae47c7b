"""A Merkle manifest of a table: slot pivots upward, sibling lists downward.

Rows are leaves. Conditional aggregates spread the leaves of a block over slot
columns, one column a slot; concatenated column runs are hashed to the columns
of the level above, and the run without its own slot is a node's siblings. A
block takes LEVELS levels at once (32 slots at a fanout of 2), so a tree over
10^11 rows is eight shuffles, of which the first moves a digest and an id a row
and each later one a 32nd of it.

Leaves are numbered without gathering a group: rows are dealt by range of
group and order, counted by part, and the counts' running sums are added to the
place within the part.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctispark.llm.common import read, staged

FANOUT, LEVELS = 2, 5


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` for null, else its number of UTF-8 bytes, a colon and itself."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def proof(path: Column) -> Column:
    """Hash of the siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, digest, lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]), 256))


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with at, the place in the group by order, from 0, and n, the group's size."""
    dealt = staged(rows.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part", group).agg(F.count(F.lit(1)).alias("__k"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", group, F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__start"), F.sum("__k").over(Window.partitionBy(group)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("__part", group).orderBy(*order)) - 1
    return dealt.withColumn("__nth", nth).join(starts, ["__part", group]).withColumn("at", F.col("__start") + F.col("__nth")).drop("__part", "__nth", "__start")


def _parents(below: Column, single: Column, fanout: int) -> Callable[[Column], Column]:
    """The node at a place above a level's digests; where the group has a single node it is handed up as it is."""

    def node(place: Column) -> Column:
        first = F.get(below, place * fanout)
        return F.when(first.isNull(), F.lit(None).cast("string")).when(single, first).otherwise(F.sha2(F.array_join(F.slice(below, place * fanout + 1, fanout), ""), 256))

    return node


def _blocks(nodes: DataFrame, group: str, level: int, fanout: int, levels: int) -> DataFrame:
    """nodes (group, at, n, item with a digest) of a level by block: (group, block, n, items by slot, digests by level and place, top)."""
    slots = fanout**levels
    slot, n = F.pmod(F.col("at"), F.lit(slots)), F.col("n")
    out = nodes.groupBy(group, F.floor(F.col("at") / slots).alias("block"), "n").agg(*[F.max(F.when(slot == s, F.col("item"))).alias(f"slot{s}") for s in range(slots)])
    out = out.select(group, "block", "n", F.array(*[f"slot{s}" for s in range(slots)]).alias("items"))
    out = out.withColumn("level0", F.transform("items", lambda x: x["digest"]))
    for i in range(1, levels + 1):
        nodes_above = _parents(F.col(f"level{i - 1}"), n <= fanout ** (level + i - 1), fanout)
        out = out.withColumn(f"level{i}", F.transform(F.sequence(F.lit(0), F.lit(fanout ** (levels - i) - 1)), nodes_above))
    return staged(out.select(group, "block", "n", "items", F.array(*[f"level{i}" for i in range(levels)]).alias("digests"), F.col(f"level{levels}")[0].alias("top")))


def _siblings(slot: Column, level: int, fanout: int, levels: int) -> Column:
    """What a block adds to the path of a slot: the siblings at each of its levels where the group has several nodes."""
    entries = []
    for i in range(levels):
        own, row = F.floor(slot / fanout**i).cast("int"), F.col("digests")[i]
        lead = own % fanout
        run = lambda a, k, row=row: F.array_join(F.slice(row, a, k), "")
        entry = F.struct(run(own - lead + 1, lead).alias("l"), run(own + 2, F.lit(fanout - 1) - lead).alias("r"))
        entries.append(F.when(F.col("n") > fanout ** (level + i), entry))
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def _rounds(most: int, fanout: int, levels: int) -> int:
    out = 1
    while fanout ** (levels * out) < most:
        out += 1
    return out


def _up(nodes: DataFrame, group: str, fanout: int, levels: int) -> list[DataFrame]:
    """Blocks of each round, the leaves' first; of the last there is one a group."""
    rounds = _rounds(nodes.agg(F.max("n")).first()[0] or 1, fanout, levels)
    out = [_blocks(nodes, group, 0, fanout, levels)]
    for r in range(1, rounds):
        above = out[-1].select(group, F.col("block").alias("at"), "n", F.struct(F.col("top").alias("digest")).alias("item"))
        out.append(_blocks(above, group, r * levels, fanout, levels))
    return out


def _down(blocks: list[DataFrame], group: str, tops: DataFrame, carry: list[str], fanout: int, levels: int) -> DataFrame:
    """Leaves with their paths and what tops (group, path, *carry) says of their group: (group, item, path, *carry)."""
    rows = blocks[-1].join(tops, group)
    for r in reversed(range(len(blocks))):
        slots = rows.select("*", F.posexplode("items").alias("slot", "item")).filter("item is not null")
        path = F.concat(_siblings(F.col("slot"), r * levels, fanout, levels), F.col("path"))
        if r == 0:
            return slots.select(group, "item", path.alias("path"), *carry)
        below = slots.select(group, (F.col("block") * fanout**levels + F.col("slot")).alias("block"), path.alias("path"), *carry)
        rows = blocks[r - 1].join(below, [group, "block"])
    raise AssertionError("a tree has a round")


def manifest(docs: DataFrame, digest: Column, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row a leaf: group, order, leaf, the columns of carry, subroot, root and path (the siblings left and right of each level, from the leaf to the root).

    The leaves of a group stand by order, nulls first, rows of one order by
    digest; fanout consecutive ones become their hash (the last may be fewer)
    until one remains, the subroot; subroots by group, null first, likewise
    give the root. A lone leaf is its group's subroot, a lone subroot the root.
    Rows alike in group, order and digest are told apart by nothing and each
    get a place. Texts of any length enter the digest whole; digests alone are
    shuffled. Columns of docs of any name are only read through the arguments;
    names of carry may not be group, order, leaf, subroot, root or path. Empty
    input gives empty output.
    """
    carry = carry or {}
    # a null group is one of its own, before all others
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    names = {f"carry{i}": c for i, c in enumerate(carry)}
    slim = staged(docs.select(key.alias("key"), digest.alias("digest"), F.col(order).alias("order"), F.col(group).alias("group"), *[carry[c].alias(x) for x, c in names.items()]))
    leaves = _numbered(slim, "key", ["order", "digest"]).select("key", "at", "n", F.struct("digest", "order", "group", *names).alias("item"))
    blocks = _up(leaves, "key", fanout, levels)
    subroots = blocks[-1].select(F.lit("").alias("all"), "key", F.col("top").alias("digest"))
    over = _up(_numbered(subroots, "all", ["key"]).select("all", "at", "n", F.struct("digest", "key").alias("item")), "all", fanout, levels)
    root = over[-1].select("all", F.col("top").alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("path"))
    tops = _down(over, "all", root, ["root"], fanout, levels).select("item.key", F.col("item.digest").alias("subroot"), "path", "root")
    out = _down(blocks, "key", tops, ["subroot", "root"], fanout, levels)
    return out.select(F.col("item.group").alias(group), F.col("item.order").alias(order), F.col("item.digest").alias("leaf"), *[F.col(f"item.{x}").alias(c) for x, c in names.items()], "subroot", "root", "path")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    own = leaf(*[F.col(c) for c in docs.columns])
    tampered = leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in docs.columns])
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows = manifest(docs, own, carry={"tampered": F.when(hit, tampered)})
    folded = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of a text in DuckDB's SQL; t is the list of crc_table.
CRC_TABLE = "select list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as t from range(256) r(i)"


def crc_sql(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"


def _up_sql(name: str, base: str) -> str:
    return f"""{name}(key, lvl, at_, n, digest) as (
  {base}
  union all select key, lvl + 1, at_ // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by at_)) from {name} where n > 1 group by key, lvl, at_ // 2, n)"""


def _fold_sql(name: str, tree: str, base: str) -> str:
    return f"""{name}(doc_id, key, lvl, at_, n, h, siblings) as (
  {base}
  union all
  select f.doc_id, f.key, f.lvl + 1, f.at_ // 2, (f.n + 1) // 2, sha256(case when f.at_ % 2 = 1 then coalesce(s.digest, '') || h else h || coalesce(s.digest, '') end), siblings || coalesce(s.digest, '')
  from {name} f left join {tree} s on s.key = f.key and s.lvl = f.lvl and s.at_ = xor(f.at_, 1) where f.n > 1)"""


def _leaf_sql(n_chars: str) -> str:
    said = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    return "sha256(" + " || ".join(map(said, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


OP12_SQL = f"""
with recursive k as materialized ({CRC_TABLE}),
d as materialized (
  select doc_id, coalesce('=' || lang, '') as key, {_leaf_sql('n_chars')} as leaf,
    case when {crc_sql('doc_id::varchar')} % 7 = 0 then {_leaf_sql('(n_chars + 1)')} else {_leaf_sql('n_chars')} end as other
  from documents, k),
g as materialized (select *, row_number() over (partition by key order by doc_id) - 1 as at_, count(*) over (partition by key) as n from d),
{_up_sql('u', 'select key, 0, at_, n, leaf from g')},
r as materialized (select key, digest as subroot, row_number() over (order by key) - 1 as at_, count(*) over () as n from u where n = 1),
{_up_sql('v', "select '', 0, at_, n, subroot from r")},
{_fold_sql('f', 'u', "select doc_id, key, 0, at_, n, other, '' from g")},
{_fold_sql('e', 'v', "select doc_id, '', 0, r.at_, r.n, h, siblings from f join r using (key) where f.n = 1")}
select g.doc_id, g.leaf, r.subroot, v.digest as root, sha256(e.siblings) as proof_sha256, e.h as folded_root, e.h = v.digest as verified
from g join r using (key) join e on e.doc_id = g.doc_id and e.n = 1, v where v.n = 1
"""

"""Ordered computations (F), sorting and paging (G), set operations (H)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Label orders.
PRIORITIES = ("PRIME", "HIGH", "MEDIUM", "LOW", "NOISE")
SEVERITIES = ("Critical", "Important", "Moderate", "Low")


def first_per_key(df: DataFrame, key: list[str], *order: str | Column) -> DataFrame:
    """the first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def limit_per_group(df: DataFrame, group: str, n: int, *order: str | Column) -> DataFrame:
    """The first n rows of each group; the limit is the feature."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


#: So many members of a group are listed within its row, unless asked otherwise; its count is exact in any case.
LISTED = 1000


def first_listed(df: DataFrame, key: list[str], order: list[str], most: int | None = LISTED) -> DataFrame:
    """The first rows of each key, which a row can hold; None for all. A task keeps no more of a key before the shuffle."""
    if most is None:
        return df
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def latest_per_key(df: DataFrame, key: list[str], ts: str, *ties: str) -> DataFrame:
    """the newest row of each key, found by partial aggregation; of rows of one time the greatest by ties."""
    whole = F.struct(*df.columns)
    return df.groupBy(*key).agg(F.max_by(whole, F.struct(ts, *ties)).alias("__r")).select("__r.*")


def carry_heading(lines: DataFrame, doc: str = "doc_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """heading (the last one above, or at, the line) and in_section (it names indicators)."""
    from ctispark.functions.text import SECTION_WORDS, is_heading

    upto = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("is_heading", is_heading(F.col(line)))
    out = out.withColumn("heading", F.last(F.when(F.col("is_heading"), F.col(line)), ignorenulls=True).over(upto))
    return out.withColumn("in_section", F.coalesce(F.col("heading").rlike(SECTION_WORDS), F.lit(False)))


def drop_sections(lines: DataFrame, removable: Column, doc: str = "doc_id", pos: str = "pos", level: str = "level") -> DataFrame:
    """without the sections of removable headers.

    level is a header's level and null elsewhere. Only the latest removable
    header counts: a line goes while no header of its level or a higher one has
    come since, so a deeper removable header's own end opens the output again.
    """
    upto = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    head = F.col(level).isNotNull()
    out = lines.withColumn("__cut", F.last(F.when(head & removable, F.struct(F.col(pos).alias("p"), F.col(level).alias("l"))), ignorenulls=True).over(upto))
    since = Window.partitionBy(doc, "__cut.p").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    ended = F.max(F.when(head & (F.col(pos) > F.col("__cut.p")) & (F.col(level) <= F.col("__cut.l")), 1).otherwise(0)).over(since)
    return out.withColumn("__ended", ended).filter("__cut is null or __ended = 1").drop("__cut", "__ended")


def split_by_marker(rows: DataFrame, marker: Column, group: str = "doc_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """the texts between markers, joined by line feeds; each run begins with its marker."""
    upto = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("run", F.sum(F.when(marker, 1).otherwise(0)).over(upto))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(pos, text))), lambda x: x[text])
    return runs.filter("run > 0").groupBy(group, "run").agg(F.array_join(parts, "\n").alias(text))


def first_role(headers: DataFrame) -> DataFrame:
    """F8: of (table_no, col_no, role) the first column of each role."""
    return headers.filter("role is not null").groupBy("doc_id", "table_no", "role").agg(F.min("col_no").alias("col_no"))


def history_desc(df: DataFrame) -> DataFrame:
    """newest first, with the run that each one superseded."""
    before = F.lag("id").over(Window.partitionBy("advisory_id").orderBy("id"))
    return df.withColumn("supersedes", before).orderBy("advisory_id", F.desc("id"))


def reflow(docs: DataFrame, doc: str = "doc_id", text: str = "text", short: int = 40) -> DataFrame:
    """(doc, para, text): fragments of lines joined to paragraphs until one ends a sentence or is short; page footers and bare URLs end a paragraph and vanish."""
    from ctispark.functions.text import PAGE_FOOTER

    lines = docs.select(doc, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    gone = F.col("line").rlike(PAGE_FOOTER) | F.col("line").rlike(r"\Ahttps?://\S+\z") | (F.col("line") == "")
    lines = lines.withColumns({"gone": gone, "ends": gone | F.col("line").rlike(r"[.!?:]\z") | (F.length("line") < short)})
    by_pos = Window.partitionBy(doc).orderBy("pos")
    flagged = lines.withColumn("prev", F.coalesce(F.lag("ends").over(by_pos), F.lit(False)))
    para = F.sum(F.col("prev").cast("int")).over(by_pos.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return flagged.withColumn("para", para).filter("not gone").groupBy(doc, "para").agg(F.array_join(parts, " ").alias("text"))


def longest_cell(cells: DataFrame) -> DataFrame:
    """each table's longest text, the first of equal ones."""
    return cells.groupBy("doc_id", "table_no").agg(F.max_by("text", F.struct(F.length("text"), -F.col("pos"))).alias("text"))


def page(df: DataFrame, sort: str, allowed: tuple[str, ...], default: str, unique: str, descending: bool = True, number: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """G1: one page of rows, and the count of all. Columns that are not allowed sort by the default; unique breaks ties. A page is a feature: deep ones cost a sort of all before them."""
    col = F.col(sort if sort in allowed else default)
    rows = df.orderBy(col.desc() if descending else col.asc(), unique)
    return rows.offset((number - 1) * size).limit(size), df.agg(F.count(F.lit(1)).alias("total"))


def rank_of(col: Column, labels: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*map(F.lit, labels)), col)
    return F.when(at > 0, at).otherwise(len(labels) + 1).cast("int")


def priority_order(col: Column) -> Column:
    """G2."""
    return rank_of(col, PRIORITIES)


def severity_order(col: Column) -> Column:
    """G3."""
    return rank_of(col, SEVERITIES)


def sort_longest_first(terms: DataFrame, col: str = "term") -> DataFrame:
    """G5."""
    return terms.orderBy(F.desc(F.length(col)), col)


def sort_tags(tags: Column) -> Column:
    """G6."""
    return F.sort_array(tags)


def kill_chain_sort(items: DataFrame) -> DataFrame:
    """Exercises by phase, those without one last; of the references the four of the lowest kinds."""
    first = F.slice(F.sort_array("references"), 1, 4)
    return items.withColumn("references", first).orderBy(F.asc_nulls_last("phase"), "id")


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """H1."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def intersect_known(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """H2."""
    return ids.select(key).distinct().join(known.select(key), key, "left_semi")


def except_known(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """H3."""
    return ids.select(key).distinct().join(known.select(key), key, "left_anti")


def distinct_ids(df: DataFrame, key: str) -> DataFrame:
    """H4."""
    return df.select(key).distinct()

"""Streaming jobs over landed files. Batches are merged with the operators of the batch side, so a stream that has run dry equals its batch twin.

Tables are kept in a Store (streaming/store.py): a batch rewrites the buckets
of its own keys and commits all its tables at once.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ctispark.operators.joins import diff_feed
from ctispark.operators.merge import delete_where, insert_ignore, save_intel, save_parse, upsert_partial
from ctispark.streaming.store import Added, Store, Tables

#: The table of jobs that keep only one.
ROWS = "rows"


def current(spark: SparkSession, root: str, table: str = ROWS) -> DataFrame | None:
    """A merged table as of the last batch."""
    return Store(spark, root, ()).read(table)


def merged_sink(root: str, key: tuple[str, ...], merge: Callable[[Tables, DataFrame], Tables], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that commits merge(old tables, batch) to the store at root; a batch that is run again changes nothing.

    Batches are numbered by one query, so the store keeps that query's id;
    another query, as after the loss of a checkpoint, is refused.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            Store(spark, root, key, buckets).commit(batch_id, batch, lambda old: merge(old, batch), spark.sparkContext.getLocalProperty("sql.streaming.queryId"))
        finally:
            batch.unpersist()

    return write


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed_stream(spark: SparkSession, landing: str, schema: str, form: str = "json", files: int | None = None) -> DataFrame:
    """Files of a folder as a stream, so many a batch at most."""
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(landing)


def dealt(batch: DataFrame) -> DataFrame:
    """A batch's documents, dealt out by id over all tasks: reading one takes longer than its bytes tell, so tasks are not merged by size."""
    return batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def stream_ingest(spark: SparkSession, landing: str, schema: str, root: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """K1: landed entries (advisory_id, lastmod, ...): unseen ones are added as pending, ones with a later lastmod are asked for again, others change nothing. files: of a batch, at most."""

    def merge(tables: Tables, batch: DataFrame) -> Tables:
        old = tables.get(ROWS)
        newest = batch.groupBy("advisory_id").agg(F.max_by(F.struct(*batch.columns), "lastmod").alias("e")).select("e.*")
        fresh = newest.withColumnRenamed("lastmod", "sitemap_lastmod").withColumn("scrape_status", F.lit("pending"))
        if old is None:
            return {ROWS: fresh}
        changed = diff_feed(newest, old).filter("change <> 'unchanged'").drop("change").withColumnRenamed("lastmod", "sitemap_lastmod").withColumn("scrape_status", F.lit("pending"))
        return {ROWS: upsert_partial(old, changed, ["advisory_id"], [c for c in old.columns if c != "advisory_id"])}

    return start(landed_stream(spark, landing, schema, files=files), merged_sink(root, ("advisory_id",), merge), checkpoint)


def stream_dedup(events: DataFrame, key: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """K2: the first sighting of each key; state older than the delay is let go, and rows behind it are refused."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def stream_ioc_rollup(sightings: DataFrame) -> DataFrame:
    """K3: first_seen, last_seen and about how many advisories, by indicator. Late rows are welcome: the measures don't depend on order. For update mode."""
    return sightings.groupBy("type", "value").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.approx_count_distinct("advisory_id").alias("advisories"))


def stream_ioc_rollup_exact(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """K3, exact: distinct sightings are merged batch by batch; roll them up with current(). Kept by whole sightings, so a popular indicator is spread over all buckets."""
    key = ["type", "value", "advisory_id", "seen"]

    def merge(tables: Tables, batch: DataFrame) -> Tables:
        old, new = tables.get(ROWS), batch.select(*key).distinct()
        return {ROWS: new if old is None else insert_ignore(old, new, key)}

    return start(stream.select(*key), merged_sink(root, tuple(key), merge), checkpoint)


def stream_extract(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """K4 of plain texts: indicators of landed documents (doc_id, text), merged; a document's rows of an earlier batch stay."""
    from ctispark.operators.plaintext import iocs_plaintext

    key = ["doc_id", "type", "value"]

    def merge(tables: Tables, batch: DataFrame) -> Tables:
        old, new = tables.get(ROWS), iocs_plaintext(dealt(batch))
        # new has each key once
        return {ROWS: new if old is None else old.unionByName(new.join(old.select(*key), key, "left_anti").select(*old.columns))}

    return start(stream, merged_sink(root, ("doc_id",), merge), checkpoint)


def stream_parse(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """K4 of pages: all that landed pages (doc_id, source, html) hold (M18), one store for all tables.

    A batch is parsed once. What it has of a document replaces what earlier
    batches had, in all tables by one commit; of several pages of one document
    in a batch one is taken. A page that can't be read leaves an error in
    extraction_log and its row, whole, in dead_letter; all others go on, and a
    later page of the document that can be read takes both away.
    """
    from ctispark.operators.html import parse_documents, parse_errors, parsed

    def merge(tables: Tables, batch: DataFrame) -> Tables:
        one = dealt(batch).groupBy("doc_id").agg(F.max(F.struct("source", "html")).alias("p")).select("doc_id", "p.*")
        nodes = parsed(one)
        found = parse_documents(nodes)
        failed = parse_errors(nodes).select("doc_id", "message")
        found["dead_letter"] = one.join(failed, "doc_id")
        ids = one.select("doc_id")
        return {name: rows if tables.get(name) is None else delete_where(tables[name], ids, ["doc_id"]).unionByName(rows) for name, rows in found.items()}

    return start(stream, merged_sink(root, ("doc_id",), merge, buckets=16), checkpoint)


def keep_tables(store: Store, tables: Tables) -> None:
    """Begins a store with tables of its key."""
    store.commit(0, None, lambda old: tables)


def _changed(old: Tables, new: dict) -> dict:
    """Those of new that a merge made anew; the others stay in their files."""
    return {name: df for name, df in new.items() if df is not old.get(name)}


def commit_parse(store: Store, batch: int, parsed: Tables, at: str) -> bool:
    """B17 as one commit over all tables: a failure halfway leaves the set as it was, a batch that was committed changes nothing."""
    return store.commit(batch, parsed["advisories"], lambda old: _changed(old, save_parse(old, parsed, at)))


def commit_intel(store: Store, batch: int, intel: Tables, at: str) -> bool:
    """B18 as one commit, likewise. Of tables that only grow, the new rows are written."""
    return store.commit(batch, intel["advisories"], lambda old: _changed(old, save_intel(old, intel, at, grown=lambda _, new: Added(new))))


def poll_windows(rows: DataFrame, ts: str, width: str, slide: str | None = None, gap: str | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """K5: counts by tumbling, sliding or (gap) session windows, of a stream with a watermark or of a table."""
    at = F.col(ts).cast("timestamp")
    window: Column = F.session_window(at, gap) if gap else F.window(at, width, slide) if slide else F.window(at, width)
    out = rows.groupBy(window.alias("w"), *key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *key, "n")


def stream_retry_state(stream: DataFrame, root: str, checkpoint: str, tries: int = 3) -> StreamingQuery:
    """K6: fetch results (advisory_id, pos, outcome) counted up to blocked, in order of pos: ok resets the count, a challenge adds to it.

    Results may come late, in any batch: kept are, of each advisory, the latest
    success and the challenges behind it, so an early result that comes after
    later ones changes what it should and no more.
    """

    def merge(tables: Tables, batch: DataFrame) -> Tables:
        new = batch.filter(F.col("outcome").isin("ok", "challenge")).groupBy("advisory_id").agg(F.max(F.when(F.col("outcome") == "ok", F.col("pos"))).alias("ok_at"), F.collect_set(F.when(F.col("outcome") == "challenge", F.col("pos"))).alias("late"))
        old = tables.get(ROWS)
        if old is None:
            both = new
        else:
            both = old.select("advisory_id", F.col("ok_at").alias("a"), F.col("challenges").alias("b")).join(new, "advisory_id", "full").select("advisory_id", F.greatest("a", "ok_at").alias("ok_at"), F.array_union(F.coalesce("b", F.array().cast("array<long>")), F.coalesce("late", F.array().cast("array<long>"))).alias("late"))
        open_ = F.array_sort(F.filter("late", lambda p: F.col("ok_at").isNull() | (p > F.col("ok_at"))))
        counted = both.select("advisory_id", "ok_at", open_.alias("challenges"))
        return {ROWS: counted.withColumn("retry_count", F.size("challenges").cast("long")).withColumn("blocked", F.col("retry_count") >= tries)}

    return start(stream, merged_sink(root, ("advisory_id",), merge), checkpoint)

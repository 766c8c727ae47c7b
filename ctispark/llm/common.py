"""What the operators share: words, bindings, staged tables."""

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, VT, FF, CR.
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a folder of this machine only where none is named, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key of more rows than HUB_ROWS, and than one in HUBS of all rows, is a hub.
HUB_ROWS, HUBS = 500, 100_000


def hub_join(rows: DataFrame, key: str, table: DataFrame, other: str, n: str, total: int) -> DataFrame:
    """rows joined with table where key = other. table has one row a key and n, how many rows have it; total: of all rows.

    Hubs are few, HUBS at most, so their entries are broadcast and their rows
    stay where they are; no task of the shuffled join gets more rows of one key
    than a hub begins with. rows and table are read twice: give staged ones.
    """
    least = max(HUB_ROWS, total // HUBS)
    hubs, others = table.filter(F.col(n) > least), table.filter(F.col(n) <= least)
    if total <= HUB_ROWS:
        return rows.join(table, F.col(key) == F.col(other))
    near = rows.join(F.broadcast(hubs), F.col(key) == F.col(other))
    far = rows.join(F.broadcast(hubs.select(F.col(other).alias("__hub"))), F.col(key) == F.col("__hub"), "left_anti")
    return near.unionByName(far.join(others, F.col(key) == F.col(other)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch, column: int, characters: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have about so many bytes, so what a task makes of them stays small however long texts are."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes + 100) // characters).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)

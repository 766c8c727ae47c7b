"""From raw documents to token ids: five stages, each on all that its predecessor kept.

quality rules: rejected documents go, failing lines of the others are removed.
near duplicates: of each group of similar documents the one of the smallest id
stays. secrets: what the scan finds is replaced by a mark. mixing: documents
are repeated or left out until sources have their target weights. bpe: texts
become token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's docs. All but the last return the
columns of documents; n_chars follows the text. Rows with a null id or text
are kept or dropped as the stage's operator says.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctispark.llm.bpe import encode
from ctispark.llm.common import read, staged
from ctispark.llm.jaccard import jaccard_join
from ctispark.llm.mixing import mix
from ctispark.llm.quality import judge
from ctispark.llm.secrets import redact

#: Up to so many ids (8 bytes each) of documents to drop are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = judge(docs).filter("quality.kept")
    return _documents(kept.withColumn("text", F.col("quality.clean_text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join(docs.select("doc_id", "text"))
    # rows without an id, and all rows of an id that stays in some row, stay
    gone = staged(found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("not kept").select("doc_id"))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return _documents(docs.join(side, "doc_id", "left_anti"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(redact(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix(docs).filter("mix_copies > 0")
    return _documents(mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing", mixing), ("bpe", bpe)]

#: Near duplicates and BPE have no SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

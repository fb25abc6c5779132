"""A training-data pipeline over ``documents``: STAGES in order, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace.llm import line_dedup, minhash, mixing, packing, toxicity
from worktrace.llm.common import DOCUMENT_COLUMNS, read_table, stored


#: Rows of an Arrow batch. Executors hold batches outside their heap, in buffers that double, and texts make 10,000 rows large.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCH_ROWS`` rows in this session from now on: results are read later, so that it is not set back."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled rows of the whole table."""
    small_batches(spark)
    lexicon = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs.select(*DOCUMENT_COLUMNS), lexicon)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that an earlier one has; those of which nothing is left go."""
    out = line_dedup.dedup_lines(docs.select(*DOCUMENT_COLUMNS))
    out = out.where((F.col("n_removed_units") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_removed_units") == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long")
    return out.withColumn("n_chars", n_chars).select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    small_batches(spark)
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixed(docs.select(*DOCUMENT_COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("mix sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Learned scores, signatures and tokenizers are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

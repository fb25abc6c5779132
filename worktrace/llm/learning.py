"""What the two classifiers share: the split of labelled rows and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 3
HELD_OUT = 1


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int = 50_000_000) -> list[tuple[str, int]]:
    """(text, label) of up to ``per_class`` labelled rows of each class, none held out: those of the smallest hashes.

    What reaches the driver is bounded by ``per_class`` rows and ``most_chars`` characters of each class, in the order of hashes,
    whatever the size of the tables; texts of more than a hundredth of ``most_chars`` come after the others, so that none of them
    takes the place of many. Ids whose labels clash teach nothing.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    known = known.where("label = other").withColumn("h", F.xxhash64("doc_id"))
    picked = [known.where(F.col("label") == c).orderBy("h", "doc_id").limit(per_class).select("doc_id", "label", "h") for c in (0, 1)]
    chosen = F.broadcast(picked[0].unionAll(picked[1]))  # 2 * per_class rows of three numbers
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    so_far = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy(F.length("text") * 100 > most_chars, "h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= most_chars).select("doc_id", "text", "label").collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]

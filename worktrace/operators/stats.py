"""Descriptive statistics: gaps, durations, counts, splits, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrace.operators.grams import gram_documents, gram_lists
from worktrace.operators.scan import dealt, running
from worktrace.sources.storage import global_index, stored


def at_rank(df: DataFrame, column: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """Per group: n and the values at the places floor(n * share), from 0, of the ascending order; exact.

    Equal values are counted before they move. The counts are dealt by range of (group, value) and summed up along it, so that no
    task sorts a group, however large.
    """
    one = df.where(F.col(column).isNotNull()).withColumn("_key", F.struct(*keys) if keys else F.lit(0))
    counts = one.groupBy("_key", column).agg(F.count("*").alias("_c"))
    run = running(dealt(counts, "_key", column), "_key", total={"_before": F.col("_c")})
    n = run.groupBy(F.col("_key").alias("_of")).agg(F.sum("_c").alias("n"))
    run = run.join(n, F.col("_key").eqNullSafe(F.col("_of")))
    place = lambda s: F.floor(F.col("n") * F.lit(s))
    holds = lambda s: (F.col("_before") <= place(s)) & (place(s) < F.col("_before") + F.col("_c"))
    out = run.groupBy("_key", "n").agg(*[F.max(F.when(holds(s), F.col(column))).alias(a) for a, s in shares.items()])
    return out.select(*[F.col("_key")[k].alias(k) for k in keys], "n", *shares)


def idle_gaps(events: DataFrame) -> DataFrame:
    """session_id and gap_ms of neighbouring events, where positive."""
    rows = running(dealt(events.select("session_id", "timestamp_ms", "seq"), "session_id", "timestamp_ms", "seq"), "session_id", last={"_last": F.col("timestamp_ms")})
    return rows.select("session_id", (F.col("timestamp_ms") - F.col("_last")).alias("gap_ms")).where("gap_ms > 0")


def large_gaps(events: DataFrame, least_ms: int = 5_000) -> DataFrame:
    """One row: number, median (at place n // 2) and greatest of the gaps of ``least_ms`` or more; 0 without any."""
    gaps = idle_gaps(events).where(F.col("gap_ms") >= least_ms)
    top = gaps.agg(F.count("*").alias("large_gap_count"), F.coalesce(F.max("gap_ms"), F.lit(0)).alias("large_gap_max_ms"))
    middle = at_rank(gaps, "gap_ms", {"m": 0.5}).agg(F.coalesce(F.max("m"), F.lit(0)).alias("large_gap_median_ms"))
    return top.join(F.broadcast(middle), F.lit(True))  # one row each


def top_counts(df: DataFrame, n: int, columns: list[str], *order: str) -> DataFrame:
    """The ``n`` most frequent values of ``columns`` with their counts; of equally frequent ones, the first in ``order``."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def consecutive_repeats(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.select(key, (F.col(value) == F.lag(value).over(w)).alias("same")).groupBy(key).agg(F.count_if("same").alias("n_repeats"))


def class_weights(df: DataFrame, label: str, copies: str | None = None) -> DataFrame:
    """label, n and weight n_all / (classes * n); ``copies`` is how many rows a row stands for."""
    counts = df.groupBy(label).agg((F.sum(copies) if copies else F.count("*")).alias("n"))
    all_ = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return counts.join(F.broadcast(all_), F.lit(True)).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def ordered_split(df: DataFrame, *order: str, share: float = 0.8) -> DataFrame:
    """Adds ``is_train``: whether a row is among the first floor(n * share) of the total order."""
    indexed = global_index(df, *order)
    n = indexed.agg(F.count("*").alias("_n"))
    return indexed.join(F.broadcast(n), F.lit(True)).withColumn("is_train", F.col("idx") < F.floor(F.col("_n") * F.lit(share))).drop("_n", "idx")


def ngram_documents(docs: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """gram and n_documents, the number of documents of ``docs`` (doc_id, text) that hold it.

    A document's grams are found and counted where it is, so that only a count for each gram and task moves. Rows of one doc_id are one
    document: only where an id is repeated, its grams are made distinct first.
    """
    repeated = stored(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    once = gram_documents(docs.join(repeated, same, "left_anti"), low, high)
    pairs = gram_lists(docs.join(repeated, same, "left_semi"), "doc_id", low, high).select("key", F.explode("grams.gram").alias("gram")).distinct()
    more = pairs.groupBy("gram").agg(F.count("*").alias("n_documents"))
    return once.unionAll(more).groupBy("gram").agg(F.sum("n_documents").alias("n_documents"))


def char_ngrams(text, low: int = 1, high: int = 3):
    """Runs of ``low`` to ``high`` characters of each word, padded with a space on either side."""
    words = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    padded = F.transform(words, lambda x: F.concat(F.lit(" "), x, F.lit(" ")))

    def grams(p):
        one = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - k + 1, F.lit(1))), lambda i: F.substr(p, i, F.lit(k)))
        return F.flatten(F.array(*[one(k) for k in range(low, high + 1)]))

    return F.flatten(F.transform(padded, grams))

"""Running values along the total order of each key, without moving a key's rows to one task.

Rows are dealt by range of (key, order), so that a long key spreads over many partitions. Within a partition a window runs over the
key's rows; across partitions only one carried row goes on for each, because only the first key of a partition continues from another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrace.sources.storage import stored


def dealt(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """``df`` in ranges of (key, order), written once, with ``_part``, its partition, and ``_pos``, which ascends along the order."""
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    # Ids ascend: the upper bits are the number of the partition, the lower ones that of the row.
    return stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()), "dealt")


def running(
    df: DataFrame,
    key: str,
    last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    most: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds to ``df`` (from ``dealt``) values of the other rows of the key, null or 0 where there is none:

    ``last``: the nearest earlier value that is not null; ``total``: the sum of earlier values; ``most``: the greatest earlier value;
    ``following``: the nearest later value that is not null.
    """
    last, total, most, following = last or {}, total or {}, most or {}, following or {}
    names = [*last, *total, *most, *following]
    if not names:
        return df
    alone = len(df.inputFiles()) <= 1  # one partition was written: nothing is carried
    own = Window.partitionBy("_part", key)
    before, after = (own.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_pos"), F.col("_pos").desc()))
    placed = lambda c: F.when(c.isNotNull(), F.struct(F.col("_pos").alias("p"), c.alias("v")))
    sums = df.groupBy(key, "_part").agg(
        *[F.max(placed(c)).alias(n) for n, c in last.items()], *[F.sum(c).alias(n) for n, c in total.items()],
        *[F.max(c).alias(n) for n, c in most.items()], *[F.min(placed(c)).alias(n) for n, c in following.items()],
    )
    # A row for each key and partition; those of one key are as many as the partitions that it spreads over.
    parts = Window.partitionBy(key)
    back, forth = (parts.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_part"), F.col("_part").desc()))
    carry = sums.select(
        F.col(key).alias("_carried_key"), F.col("_part").alias("_carried_part"), F.count(F.lit(1)).over(parts).alias("_spread"),
        *[F.max(n).over(back)["v"].alias("_" + n) for n in last], *[F.sum(n).over(back).alias("_" + n) for n in total],
        *[F.max(n).over(back).alias("_" + n) for n in most], *[F.min(n).over(forth)["v"].alias("_" + n) for n in following],
    )
    # Keys that spread over partitions: the first and the last of each at most, so that no more than two rows a partition are sent.
    carry = F.broadcast(carry.where("_spread > 1").drop("_spread"))
    local = [
        *[F.last(c, ignorenulls=True).over(before).alias(n) for n, c in last.items()], *[F.sum(c).over(before).alias(n) for n, c in total.items()],
        *[F.max(c).over(before).alias(n) for n, c in most.items()], *[F.last(c, ignorenulls=True).over(after).alias(n) for n, c in following.items()],
    ]
    if alone:
        whole = {n: F.coalesce(F.col(n), F.lit(0)) if n in total else F.col(n) for n in names}
        return df.select("*", *local).select(*df.columns, *[c.alias(n) for n, c in whole.items()])
    joined = df.select("*", *local).join(carry, (F.col("_part") == F.col("_carried_part")) & F.col(key).eqNullSafe(F.col("_carried_key")), "left")
    whole = {n: F.coalesce(F.col(n), F.col("_" + n)) for n in (*last, *following)}
    whole |= {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col("_" + n), F.lit(0)) for n in total}
    whole |= {n: F.greatest(n, "_" + n) for n in most}
    return joined.select(*df.columns, *[c.alias(n) for n, c in whole.items()])

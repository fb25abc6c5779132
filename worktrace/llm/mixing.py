"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets.

Each document gets an exponential key, -ln(u) / quality weight, with u from a hash of its id, so that reruns agree. A
source's target is first met by complete epochs; the rest of it by its documents in ascending key order until the
prefix sum of sizes comes nearest to the budget. Where documents are large for their source, much of the budget can be left then: the
one later document that brings the sum nearest to it is taken as well, of equally near ones that of the smallest key.

The prefix sum never sorts a source in one task: keys fall into ranges, sums by range find the one range in which the
budget ends, and only that range is sorted. Ranges are equal in the logarithm of the key: a weight only shifts it, and whatever
the weights, no range holds more than 0.37 * ln(2) / ``KEY_RANGES`` of a source, on average. A source is one row of the
plan, however many documents it has.

Null text: size 0, never short of its target. Null source: a source of its own, last in order. Repeated rows of an id
share its key and are taken or left together. Ties of keys go to the smaller id. An empty table gives an empty result.
``mixed`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrace.llm.common import quoted, small_side, stored, words

SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
KEY_RANGES = 1024  # for keys from one to the next power of 2


def quality_weight(text: Column) -> Column:
    """1 for prose, less for texts full of symbols: 0.05 at least."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>!]", ""))
    return F.greatest(F.lit(0.05), 1.0 - symbols * 5.0 / F.greatest(F.length(text), F.lit(1)))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size) with target: shares by weight, none above ``most`` times its source's size.

    Resharing what exceeds a limit until nothing does ends at min(limit, level * weight) with one level for all: sources
    are passed in the order in which a rising level meets their limits.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("weight").over(after))
    s = s.withColumn("free", F.col("source_size") * most > F.col("level") * F.col("weight"))
    first_free = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.select(
        "source",
        "source_size",
        F.when(F.col("free"), first_free * F.col("weight")).otherwise(F.col("source_size") * float(most)).alias("target"),
    )


def sized(docs: DataFrame, seed: int = 0, keep=("doc_id", "source"), weight: Column | None = None) -> DataFrame:
    """``keep`` of ``docs`` with size (words) and key; ``weight`` is a positive column such as a quality score, ``quality_weight`` without."""
    weight = quality_weight(F.col("text")) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-6))
    size = F.size(words(F.col("text"))).cast("long")
    return docs.select(*keep, size.alias("size"), exponential_key(docs["doc_id"], weight, seed).alias("key"))


def key_range(key: Column) -> Column:
    return F.floor(F.log2(key) * KEY_RANGES).cast("int")


def plan(keys: DataFrame, **limits) -> DataFrame:
    """Per source of ``keys`` (doc_id, source, size, key): size, target, epochs, and the last key and id taken once more."""
    keys = keys.withColumn("bucket", key_range(F.col("key")))
    sums = keys.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    goal = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), **limits)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    goal = goal.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = stored(goal, "mix-targets")
    few = goal.count()

    renamed = small_side(goal.withColumnRenamed("source", "_source"), few)
    so_far = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    ends = (
        sums.withColumn("before", so_far - F.col("size"))
        .join(renamed.select("_source", "budget"), F.col("source").eqNullSafe(F.col("_source")))
        .where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("size")))
        .select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before", "budget")
    )
    in_end = keys.join(small_side(ends, few), F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    prefix = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = (
        in_end.groupBy("source", "before", "budget", "key", "doc_id")
        .agg(F.sum("size").alias("size"))
        .withColumn("to_here", prefix)
        .where(F.col("before") + F.col("to_here") - F.col("size") / 2.0 <= F.col("budget"))
        .groupBy("source")
        .agg(F.max(F.struct("key", "doc_id", (F.col("before") + F.col("to_here")).alias("sum"))).alias("last"))
    )
    end = ends.select("_source", F.col("_bucket").alias("end"))
    last = last.withColumnRenamed("source", "_last_source")
    out = goal.join(small_side(end, few), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    out = out.join(small_side(last, few), F.col("source").eqNullSafe(F.col("_last_source")), "left")
    out = out.join(small_side(_filling(keys, ends, last, few), few), F.col("source").eqNullSafe(F.col("_fill_source")), "left")
    # No range in which the budget ends: it is 0 or takes all. A range from which nothing is taken: all keys before it.
    whole = F.when(F.col("budget") > 0, F.lit(float("inf"))).otherwise(F.lit(-1.0))
    return out.select(
        "source", "source_size", "target", "epochs",
        F.coalesce(F.col("last.key"), whole).alias("last_key"), F.col("last.doc_id").alias("last_id"),
        F.when(F.col("last.key").isNull(), F.col("end")).alias("before_range"), F.col("fill.key").alias("fill_key"), F.col("fill.doc_id").alias("fill_id"),
    )


def _filling(keys: DataFrame, ends: DataFrame, last: DataFrame, few: int) -> DataFrame:
    """_fill_source and fill (key, doc_id): the document after the prefix that brings a source's sum nearest to its budget."""
    done = ends.join(small_side(last, few), F.col("_source").eqNullSafe(F.col("_last_source")), "left")
    left = F.col("budget") - F.coalesce(F.col("last.sum"), F.col("before"))
    done = done.select(F.col("_source").alias("_fill_source"), "_bucket", "last", left.alias("_left")).where("_left > 0")
    later = keys.join(small_side(done, few), F.col("source").eqNullSafe(F.col("_fill_source")))
    beyond = (F.col("key") > F.col("last.key")) | ((F.col("key") == F.col("last.key")) & (F.col("doc_id") > F.col("last.doc_id")))
    later = later.where(F.when(F.col("last").isNull(), F.col("bucket") >= F.col("_bucket")).otherwise(beyond) & F.col("doc_id").isNotNull())
    sizes = later.groupBy("_fill_source", "key", "doc_id", "_left").agg(F.sum("size").alias("size"))
    off = F.abs(F.col("size") - F.col("_left"))
    return sizes.where(off < F.col("_left")).groupBy("_fill_source").agg(F.min(F.struct(off.alias("off"), "key", "doc_id")).alias("fill"))


def with_taken(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """``docs`` (with source, doc_id, size, key) and how many of their words the mix takes."""
    mix = stored(mix, "mix-plan")
    mix = small_side(mix.withColumnRenamed("source", "_source"), mix.count())
    by_key = (F.col("key") < F.col("last_key")) | ((F.col("key") == F.col("last_key")) & (F.col("last_id").isNull() | (F.col("doc_id") <= F.col("last_id"))))
    more = F.when(F.col("before_range").isNotNull(), key_range(F.col("key")) < F.col("before_range")).otherwise(by_key)
    more = F.coalesce(more, F.lit(False)) | F.coalesce((F.col("key") == F.col("fill_key")) & (F.col("doc_id") == F.col("fill_id")), F.lit(False))
    out = docs.join(mix, F.col("source").eqNullSafe(F.col("_source")))
    times = F.least(F.lit(MOST_EPOCHS), F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long"))
    return out.withColumn("times", times.cast("int")).withColumn("taken", F.col("size") * F.col("times")).drop("_source", "epochs", "last_key", "last_id", "before_range", "fill_key", "fill_id")


def mix_sizes(docs: DataFrame, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    keys = stored(sized(docs, seed, weight=weight), "mix-keys")
    return with_taken(keys, plan(keys)).drop("key", "times")


def mixed(docs: DataFrame, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them."""
    keys = stored(sized(docs, seed, weight=weight), "mix-keys")
    rows = sized(docs, seed, (F.struct(*quoted(docs.columns)).alias("row"), "doc_id", "source"), weight)
    out = with_taken(rows, plan(keys)).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])

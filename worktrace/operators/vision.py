"""Work boundaries from frame vectors: drops of similarity between neighbouring frames, over the order of all frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrace.functions.columns import cosine
from worktrace.sources.storage import global_index

BLOCK = 4096
LABEL = "Automated Vision Segment"


def _neighbours(frames: DataFrame, order: str, back: int, ahead: int) -> DataFrame:
    """Adds arrays' ``back`` predecessors (b1, ...) and ``ahead`` successors (a1, ...) over all frames.

    Frames are numbered and dealt in blocks; those near a block's edge go to the next block too, so that no window is global.
    """
    rows = global_index(frames, order)
    block, place = F.floor(F.col("idx") / BLOCK), F.col("idx") % BLOCK
    targets = [block, *[F.when(place >= BLOCK - back, block + 1)], *([F.when(place < ahead, block - 1)] if ahead else [])]
    dealt = rows.withColumn("_block", F.explode(F.array_compact(F.array(*targets))))
    w = Window.partitionBy("_block").orderBy("idx")
    near = [F.lag("embedding", i).over(w).alias(f"b{i}") for i in range(1, back + 1)] + [F.lead("embedding", i).over(w).alias(f"a{i}") for i in range(1, ahead + 1)]
    return dealt.select("*", *near).where(F.col("_block") == F.floor(F.col("idx") / BLOCK)).drop("_block")


def single_frame(frames: DataFrame, order: str, threshold: float = 0.85) -> DataFrame:
    """``order`` and similarity_score of frames less like the one before than ``threshold``."""
    s = _neighbours(frames, order, 1, 0).withColumn("sim", cosine(F.col("b1"), F.col("embedding")))
    return s.where(F.col("sim") < threshold).select(order, F.round("sim", 4).alias("similarity_score"))


def multi_frame(frames: DataFrame, order: str, least_drop: float = 0.15) -> DataFrame:
    """Frames at which similarity drops by more than ``least_drop`` below the mean of the pairs before and after."""
    s = _neighbours(frames, order, 2, 1).where("b2 is not null and a1 is not null")
    s = s.withColumn("_b", cosine(F.col("b2"), F.col("b1"))).withColumn("_t", cosine(F.col("b1"), F.col("embedding"))).withColumn("_a", cosine(F.col("embedding"), F.col("a1")))
    s = s.withColumn("_drop", (F.col("_b") + F.col("_a")) / 2 - F.col("_t")).where(F.col("_drop") > least_drop)
    names = (("_drop", "drop_magnitude"), ("_t", "transition_similarity"), ("_b", "stability_before"), ("_a", "stability_after"))
    return s.select(order, *[F.round(c, 4).alias(n) for c, n in names])


def boundary_segments(bounds: DataFrame) -> DataFrame:
    """Segments between neighbouring distinct boundaries (session_id, timestamp_ms) of a session: n boundaries, n - 1 segments."""
    w = Window.partitionBy("session_id").orderBy("timestamp_ms")
    out = bounds.select("session_id", "timestamp_ms").distinct().withColumn("end_ms", F.lead("timestamp_ms").over(w)).where("end_ms is not null")
    return out.select("session_id", F.col("timestamp_ms").alias("start_ms"), "end_ms", F.lit(LABEL).alias("label"))

"""Joins of points with the intervals that hold them, and of intervals that overlap, by session and dyadic cells of time.

A cell of level k is 2**k ms long. An interval lies in one or two cells of the level whose cells are as long as it is, whether that is
1 ms or 50 years; a point lies in one cell of each level, and is looked up on the levels that intervals have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.operators.scan import dealt, running


def _level(start: Column, end: Column, least_ms: int) -> Column:
    """The least level whose cells are as long as the interval, and as ``least_ms``."""
    return F.greatest(F.ceil(F.log2(F.greatest(end - start + 1, F.lit(1)).cast("double"))), F.lit((max(1, least_ms) - 1).bit_length())).cast("int")


def _cell(ms: Column | str, level: Column) -> Column:
    return F.call_function("shiftright", F.col(ms) if isinstance(ms, str) else ms, level)


def _celled(intervals: DataFrame, least_ms: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """``intervals`` with their level and each cell of it that they touch; those that end before they start touch none."""
    whole = intervals.where(F.col(end) >= F.col(start)).withColumn("_level", _level(F.col(start), F.col(end), least_ms))
    first, last = _cell(start, F.col("_level")), _cell(end, F.col("_level"))
    return whole.withColumn("_cell", F.explode(F.array_distinct(F.array(first, last))))


def _levels(intervals: DataFrame, least_ms: int) -> DataFrame:
    """One row: the levels that the intervals have, of which there are 64 at most."""
    level = _level(F.col("start_ms"), F.col("end_ms"), least_ms)
    return F.broadcast(intervals.where("end_ms >= start_ms").agg(F.collect_set(level).alias("_levels")))


def points_in_intervals(intervals: DataFrame, points: DataFrame, least_ms: int = 600_000, how: str = "inner") -> DataFrame:
    """Pairs of an interval (session_id, start_ms, end_ms, both ends inclusive, ...) and a point (session_id, timestamp_ms, ...).

    The join key holds a cell of time besides the session, so that a session with very many events is dealt over many tasks
    and a point meets only intervals nearby. A point lies in one cell of a level, so that no pair comes twice. ``least_ms`` is the
    length of the shortest cells: a good value is that of common intervals, any value gives the same pairs. ``left`` also gives
    each interval once without a point, beside its pairs if those all lie in its second cell; columns besides the
    session must have distinct names.
    """
    held = points.join(_levels(intervals, least_ms), F.lit(True)).withColumn("_l", F.explode("_levels")).drop("_levels")
    right = held.withColumnRenamed("session_id", "_session").withColumn("_c", _cell("timestamp_ms", F.col("_l")))
    within = (F.col("session_id") == F.col("_session")) & (F.col("_level") == F.col("_l")) & (F.col("_cell") == F.col("_c"))
    within &= F.col("timestamp_ms").between(F.col("start_ms"), F.col("end_ms"))
    left = _celled(intervals, least_ms)
    if how == "left":
        left = left.unionByName(intervals.where("end_ms < start_ms").withColumn("_level", F.lit(0)).withColumn("_cell", F.col("start_ms")))
        first = F.col("_cell") == _cell("start_ms", F.col("_level"))
        joined = left.join(right, within, "left").where(F.col("timestamp_ms").isNotNull() | first)
    else:
        joined = left.join(right, within)
    return joined.drop("_session", "_level", "_cell", "_l", "_c")


def overlapping(one: DataFrame, other: DataFrame, least_ms: int = 600_000) -> DataFrame:
    """Pairs of an interval of ``one`` (session_id, start_ms, end_ms, ...) and one of ``other`` (other_session, other_start, other_end, ...)
    that share more than a moment.

    A pair meets on the higher of its two levels, in the cell where it begins to overlap, once.
    """
    a, b = one.where("end_ms > start_ms"), other.where("other_end > other_start")
    named = other.select(F.col("other_start").alias("start_ms"), F.col("other_end").alias("end_ms"))

    def looked_up(df, start, end, levels, higher_or_equal):
        own = _level(F.col(start), F.col(end), least_ms)
        level = df.join(levels, F.lit(True)).withColumn("_own", own).withColumn("_level", F.explode("_levels"))
        level = level.where(F.col("_level") >= F.col("_own") if higher_or_equal else F.col("_level") > F.col("_own")).drop("_levels", "_own")
        return level.withColumn("_cell", F.explode(F.array_distinct(F.array(_cell(start, F.col("_level")), _cell(end, F.col("_level"))))))

    renamed = lambda df: df.withColumnRenamed("_level", "_l").withColumnRenamed("_cell", "_c")
    meets = (F.col("session_id") == F.col("other_session")) & (F.col("_level") == F.col("_l")) & (F.col("_cell") == F.col("_c"))
    meets &= (F.col("start_ms") < F.col("other_end")) & (F.col("other_start") < F.col("end_ms"))
    meets &= F.col("_cell") == _cell(F.greatest("start_ms", "other_start"), F.col("_level"))
    upper = looked_up(a, "start_ms", "end_ms", _levels(named, least_ms), True).join(renamed(_celled(b, least_ms, "other_start", "other_end")), meets)
    lower = _celled(a, least_ms).join(renamed(looked_up(b, "other_start", "other_end", _levels(one, least_ms), False)), meets)
    return upper.unionByName(lower).drop("_level", "_cell", "_l", "_c")


def near_any(points: DataFrame, marks: DataFrame, tolerance_ms: int, bucket_ms: int = 600_000) -> DataFrame:
    """session_id, seq and ``is_near``: whether a mark (session_id, timestamp_ms) lies within the tolerance of the point."""
    at = F.col("timestamp_ms")
    spans = marks.select("session_id", (at - tolerance_ms).alias("start_ms"), (at + tolerance_ms).alias("end_ms")).distinct()
    hit = points_in_intervals(spans, points.select("session_id", "timestamp_ms", "seq"), bucket_ms).select("session_id", "seq").distinct()
    hit = hit.select(F.col("session_id").alias("_s"), F.col("seq").alias("_q"))
    out = points.join(hit, (F.col("session_id") == F.col("_s")) & (F.col("seq") == F.col("_q")), "left")
    return out.select("session_id", "seq", F.col("_s").isNotNull().alias("is_near"))


def next_events(marks: DataFrame, events: DataFrame, k: int) -> DataFrame:
    """Pairs of a mark (session_id, timestamp_ms as mark_ms) and each of the first ``k`` events at or after it, numbered from 1."""
    both = marks.select("session_id", "timestamp_ms", F.lit(0).alias("side"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("event_type"))
    both = both.unionByName(events.select("session_id", "timestamp_ms", F.lit(1).alias("side"), "seq", "event_type"))
    both = running(dealt(both, "session_id", "timestamp_ms", "side", "seq"), "session_id", total={"_before": F.col("side")})
    both = both.withColumn("no", F.col("_before") + F.col("side"))
    wanted = both.where("side = 0").select("session_id", F.col("timestamp_ms").alias("mark_ms"), F.posexplode(F.sequence(F.col("no") + 1, F.col("no") + k)).alias("step", "no"))
    return wanted.join(both.where("side = 1").select("session_id", "no", "seq", "event_type"), ["session_id", "no"]).select(
        "session_id", "mark_ms", (F.col("step") + 1).cast("long").alias("step"), "seq", "event_type"
    )

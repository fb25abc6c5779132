"""Process metrics from segments and events, and their ranking by return on automation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrace.functions.columns import machine, ratio
from worktrace.operators.intervals import points_in_intervals
from worktrace.operators.label import UNKNOWN
from worktrace.sources.storage import stored


def process_metrics(segments: DataFrame, events: DataFrame, bucket_ms: int) -> DataFrame:
    """Per label: volume, time, app switches, clipboard use, distinct apps, sessions and machines; bounds are cut to seconds.

    first_seen is the place of the label's first segment: the least ``seen`` where segments have it (as the reader of files gives it),
    else the least session and start, in whose order segments are written.
    """
    seconds = lambda c: (F.floor(F.col(c) / F.lit(1000)) * 1000).cast("long").alias(c)
    # Their labels cost most, and the join looks at them twice.
    seen = F.col("seen") if "seen" in segments.columns else F.struct("session_id", "start_ms")
    s = stored(segments.select("session_id", "label", "start_ms", "end_ms", seen.alias("_seen")), "mined")
    firsts = s.groupBy(F.col("label").alias("_named")).agg(F.min("_seen").alias("first_seen"))
    s = s.select("session_id", "label", seconds("start_ms"), seconds("end_ms"), F.col("start_ms").alias("_own"))
    lean = events.select("session_id", "timestamp_ms", "event_type", "app_name")
    found = points_in_intervals(s, lean, bucket_ms, "left")
    own = ["session_id", "label", "_own", "start_ms", "end_ms"]
    # By app first: apps of a label are then distinct rows, and no set of them is ever gathered.
    per_app = found.groupBy(*own, F.nullif("app_name", F.lit("")).alias("app")).agg(
        F.count_if(F.col("event_type") == "app_switch").alias("switches"), F.count_if(F.col("event_type") == "clipboard_change").alias("clips")
    )
    one = per_app.groupBy(*own).agg(F.sum("switches").alias("switches"), F.sum("clips").alias("clips"))
    apps = per_app.select(F.col("label").alias("_label"), "app").distinct().groupBy("_label").agg(F.count("app").alias("apps_count"))
    millis = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    out = one.groupBy("label").agg(
        F.count("*").alias("volume"), F.sum(millis).alias("total_ms"), F.sum("switches").alias("switches"), F.sum("clips").alias("clips"),
        F.count_distinct("session_id").alias("sessions_count"), F.count_distinct(machine(F.col("session_id"))).alias("staff_count"),
    )
    out = out.join(apps, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return out.join(firsts, F.col("label").eqNullSafe(F.col("_named"))).drop("_named")


def roi_ranking(segments: DataFrame, events: DataFrame, bucket_ms: int) -> DataFrame:
    """Labels by volume * (switches + clips per segment) / average duration, ties by the first segment; the unknown process is left out."""
    m = process_metrics(segments.where(F.col("label") != UNKNOWN), events, bucket_ms)
    n, seconds = F.col("volume"), F.col("total_ms") / 1000
    actions = ratio(F.col("switches") + F.col("clips"), n)
    roi = ratio(n * actions, ratio(seconds, n))
    out = m.select(
        F.col("label").alias("process"), "volume", F.round(seconds / 60, 1).alias("total_duration_min"), F.round(ratio(seconds, n), 1).alias("avg_duration_s"),
        F.round(ratio(F.col("switches"), n), 1).alias("avg_app_switches"), F.round(ratio(F.col("clips"), n), 1).alias("avg_clipboard_ops"),
        F.round(actions, 2).alias("friction"), "apps_count", "sessions_count", "staff_count", F.round(roi, 2).alias("roi_score"), "first_seen",
    )
    # One row for each label: the ranking's single partition holds no more than there are labels.
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("roi_score"), "first_seen")).cast("long")).drop("first_seen")


def markdown(ranking: DataFrame, sessions: int = 15, staff: int = 4) -> str:
    """The ranking (a row for each label) as a table."""
    head = "| Rank | Process | Volume | Minutes | Avg s | Switches | Clips | Friction | Sessions | Staff | ROI |\n|---|---|---|---|---|---|---|---|---|---|---|\n"
    rows = ranking.orderBy("rank").collect()  # a row for each label
    line = "| {rank} | {process} | {volume} | {total_duration_min} | {avg_duration_s} | {avg_app_switches} | {avg_clipboard_ops} | {friction} | "
    return head + "".join(line.format(**r.asDict()) + f"{r.sessions_count}/{sessions} | {r.staff_count}/{staff} | {r.roi_score:.2f} |\n" for r in rows)

"""What a reader of results looks at: selections of segments and choices of their labels and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrace.functions.columns import ms_to_iso, ratio
from worktrace.sources.storage import global_index

MOST_SECONDS = 120.0
#: The titles under which a ranking and segments are shown, in the order of columns.
RANKING_TITLES = {
    "process": "Business Process", "volume": "Volume (N)", "total_duration_min": "Total Time (min)", "avg_duration_s": "Avg Dur (s)",
    "avg_app_switches": "App Switches", "avg_clipboard_ops": "Clipboard Ops", "friction": "Friction Score", "roi_score": "ROI Score",
}
SEGMENT_TITLES = {"session_id": "Session ID", "start": "Start (UTC)", "end": "End (UTC)", "duration_s": "Duration (s)", "label": "Recovered Label"}
SESSION_WIDTH = 48


def explorer(segments: DataFrame, label: str | None = None, session: str | None = None) -> DataFrame:
    """Segments (session_id, start_ms, end_ms, label) of one label or session or of all, numbered within a session, with their duration as charts show it."""
    out = segments if label is None else segments.where(F.col("label") == label)
    out = out if session is None else out.where(F.col("session_id") == session)
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("start_ms", "end_ms", "label")).cast("long")
    return out.select("session_id", number.alias("execution_no"), "start_ms", "end_ms", seconds.alias("duration_s"), F.least(seconds, F.lit(MOST_SECONDS)).alias("shown_s"), "label")


def choices(segments: DataFrame, column: str) -> DataFrame:
    """The values that a column can be selected by, in order."""
    return segments.select(column).distinct().orderBy(column)


def percent(share):
    """A share as text, one digit after the point."""
    return F.concat(F.call_function("format_number", share * 100, F.lit("0.0")), F.lit("%"))


def titled(rows: DataFrame, titles: dict[str, str]) -> DataFrame:
    """The columns of ``titles`` under their titles."""
    return rows.select(*[F.col(c).alias(t) for c, t in titles.items()])


def ranking_table(ranking: DataFrame) -> DataFrame:
    """A ranking by its rank, with titled columns."""
    return titled(ranking.orderBy("rank"), RANKING_TITLES)


def segment_table(segments: DataFrame) -> DataFrame:
    """Segments (session_id, start_ms, end_ms, label) with their times as text and titled columns."""
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    times = [ms_to_iso(F.col(c + "_ms")).alias(c) for c in ("start", "end")]
    return titled(segments.select("session_id", *times, seconds.alias("duration_s"), "label"), SEGMENT_TITLES)


def bars(ranking: DataFrame, value: str) -> DataFrame:
    """series (the name of ``value``), place, process and value of a bar chart, from the least bar to the greatest; ties by rank."""
    place = F.row_number().over(Window.orderBy(value, "rank")).cast("long")  # one row for each label, as in the ranking
    return ranking.select(F.lit(value).alias("series"), place.alias("place"), "process", F.col(value).cast("double").alias("value"))


def scatter(ranking: DataFrame) -> DataFrame:
    """What a chart of return against volume shows."""
    return ranking.select("process", "volume", "roi_score", "friction")


def session_report(scores: DataFrame) -> DataFrame:
    """Sessions from the best boundary F1 down, ties by session, with shares as text; names are cut to ``SESSION_WIDTH`` characters."""
    placed = global_index(scores.withColumn("_down", F.round(-F.col("boundary_f1"), 9)), "_down", "session_id", name="_place")
    shares = [percent(F.col(c)).alias(c) for c in ("boundary_f1", "segment_f1")]
    return placed.select((F.col("_place") + 1).alias("place"), F.left("session_id", F.lit(SESSION_WIDTH)).alias("session"), "pred_count", "true_exec_count", *shares)


def label_report(codes: DataFrame) -> DataFrame:
    """Labels of counts (label, code, c) from the purest down, ties by label, with their codes as text from the most common down."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("down"), "code", "c")))  # there are few codes
    named = F.array_join(F.transform(listed, lambda x: F.format_string("%s(%d)", x["code"], x["c"])), "  ")
    out = codes.groupBy("label").agg(ratio(F.max("c"), F.sum("c")).alias("share"), named.alias("codes"))
    place = F.row_number().over(Window.orderBy(F.round(-F.col("share"), 9), "label")).cast("long")  # one row for each label
    return out.select(place.alias("place"), "label", percent(F.col("share")).alias("purity"), "codes")


def warned(sessions: DataFrame, most: int = 5) -> DataFrame:
    """place and line of the first ``most`` of ``sessions`` (session_id), and one more line that says how many are left."""
    first = sessions.orderBy("session_id").limit(most).withColumn("place", F.row_number().over(Window.orderBy("session_id")).cast("long"))
    left = sessions.agg((F.count("*") - most).alias("n")).where("n > 0")
    lines = first.select("place", F.concat(F.lit("- "), "session_id").alias("line"))
    return lines.unionAll(left.select(F.lit(most + 1).cast("long"), F.format_string("... and %d more", F.col("n"))))

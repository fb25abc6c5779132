"""The 18 features of an event for boundary models, from the events before and after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.functions.columns import app_category, hub_url_v3, url_depth
from worktrace.operators.scan import dealt, running

# Fixed names, in this order.
NAMES = (
    "dt_prev", "dt_next", "is_app_switch", "is_clipboard", "is_navigation", "is_shortcut", "is_click", "clip_len", "clip_delta", "has_id", "is_hub",
    "url_depth", "app_category", "app_changed", "title_len", "title_changed", "idle_10", "idle_30",
)
MOST_MS = 60_000


def features(events: DataFrame, browsers: str = "chrome") -> DataFrame:
    """session_id, timestamp_ms, seq and ``NAMES`` (double) of events with text_content, ms_since (null: from the event before).

    App, title and URL are those of the context alone where the events have them apart (ctx_app, ctx_title, tab_url).
    """
    app, title_, url = (c if c in events.columns else other for c, other in (("ctx_app", "app_name"), ("ctx_title", "window_title"), ("tab_url", "url")))
    t, kind, content = F.col("timestamp_ms"), F.col("event_type"), F.coalesce("text_content", F.lit(""))
    title, category = F.coalesce(title_, F.lit("")), app_category(F.col(app), browsers)
    lean = events.select("session_id", "timestamp_ms", "seq", "ms_since", kind.alias("event_type"), content.alias("_text"), F.col(url).alias("_url"), title.alias("_title"), category.alias("_category"))
    clip, length = F.col("event_type") == "clipboard_change", F.length("_text")
    near = running(
        dealt(lean, "session_id", "timestamp_ms", "seq"), "session_id", following={"_next": t},
        last={"_last": t, "_clip": F.when(clip, length), "_title_0": F.col("_title"), "_category_0": F.col("_category")},
    )
    content, title, category, url = F.col("_text"), F.col("_title"), F.col("_category"), "_url"
    since = F.when(F.col("ms_since") >= 0, F.col("ms_since")).otherwise(F.coalesce(t - F.col("_last"), F.lit(0)))
    dt_prev = F.least(since.cast("double"), F.lit(float(MOST_MS)))
    dt_next = F.least(F.greatest(F.coalesce(F.col("_next") - t, F.lit(0)), F.lit(0)), F.lit(MOST_MS))
    before = F.coalesce("_clip", F.lit(0))
    changed = lambda c: F.coalesce(F.col(f"{c}_0") != F.col(c), F.lit(False))
    values = [
        dt_prev, dt_next, kind == "app_switch", clip, kind == "browser_navigation", kind == "shortcut", kind.contains("click"), length,
        F.when(clip, F.abs(length - before)).otherwise(0), content.rlike(r"[A-Za-z0-9_-]{4,}"), hub_url_v3(F.col(url)), url_depth(F.coalesce(url, F.lit(""))),
        category, changed("_category"), F.length(title), changed("_title"), dt_prev >= 10_000, dt_prev >= 30_000,
    ]
    return near.select("session_id", "timestamp_ms", "seq", *[v.cast("double").alias(n) for n, v in zip(NAMES, values)])

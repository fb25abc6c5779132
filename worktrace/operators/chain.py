"""Segments by learned models: boundary peaks, windows between them, labels from their documents, merging."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.functions.columns import port_token, route_token
from worktrace.operators import features, ml, segment
from worktrace.operators.intervals import points_in_intervals
from worktrace.operators.label import UNKNOWN
from worktrace.operators.trees import Trees
from worktrace.sources.storage import stored

MERGE_GAP_MS = 35_000


def tokens(events: DataFrame):
    """Words of an event for the document of its window: port, route, title, texts, clipboard, form."""
    have = lambda name, other: F.col(name if name in events.columns else other)
    url, content = have("tab_url", "url"), F.coalesce("text_content", F.lit(""))
    listed = F.col("doc_texts") if "doc_texts" in events.columns else F.array().cast("array<string>")
    form = F.when(F.length("form_text") > 1, F.col("form_text")) if "form_text" in events.columns else F.lit(None).cast("string")
    clip = F.when(content != "", F.concat(F.lit("CLIP_"), F.substring(content, 1, 50)))
    title = F.nullif(have("ctx_title", "window_title"), F.lit(""))
    return F.array_compact(F.concat(F.array(port_token(url), route_token(url), title), listed, F.array(clip, form)))


def documents(spans: DataFrame, events: DataFrame, bucket_ms: int) -> DataFrame:
    """``spans`` (session_id, start_ms, end_ms) with the number of their events and their words in order, '' without events."""
    at = events.select("session_id", "timestamp_ms", "seq", tokens(events).alias("_tokens"))
    own = spans.select("session_id", "start_ms", "end_ms").distinct()
    found = points_in_intervals(own, at, bucket_ms, "left")
    listed = F.array_sort(F.collect_list(F.when(F.size("_tokens") > 0, F.struct("timestamp_ms", "seq", "_tokens"))))
    docs = found.groupBy("session_id", "start_ms", "end_ms").agg(F.count("timestamp_ms").alias("event_count"), listed.alias("t"))
    return docs.select("session_id", "start_ms", "end_ms", "event_count", F.array_join(F.flatten(F.col("t")["_tokens"]), " ").alias("text"))


def windows(events: DataFrame, threshold: float = 0.5, peak_gap_ms: int = 12_000, min_ms: int = segment.LEAST_MS, bucket_ms: int = 600_000, least_events: int = 10, idle_ms: int = 15_000) -> DataFrame:
    """Windows between boundaries of ``events`` (with p), as documents; those with few events for their length are idle and left out."""
    found = segment.candidate_windows(events, segment.peaks(events, threshold, peak_gap_ms), min_ms)
    docs = documents(found, events, bucket_ms)
    return docs.where(~((F.col("event_count") < least_events) & (F.col("end_ms") - F.col("start_ms") > idle_ms)))


def labelled(docs: DataFrame, model: PipelineModel, names: list[str]) -> DataFrame:
    """``docs`` with label: the name that the model predicts, unknown for an empty document."""
    out = ml.predicted_labels(model, docs)
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int"))
    return out.select(*docs.columns, F.when(F.col("text") == "", UNKNOWN).otherwise(label).alias("label"))


def with_context(docs: DataFrame, events: DataFrame, bucket_ms: int = 600_000, most_texts: int = 10) -> DataFrame:
    """``docs`` (session_id, start_ms, end_ms, event_count, label) with window_titles, urls and apps_seen (sorted), the first extracted_texts
    and the anchor_texts (clipboard contents, in order) of the events within them, both ends included.

    App, title and URL are those of the context alone where the events have them apart; texts are those of ``plain_text``.
    """
    have = lambda name, other: F.col(name if name in events.columns else other)
    said = have("plain_text", "plain_text") if "plain_text" in events.columns else F.lit("")
    fields = [have("ctx_title", "window_title").alias("_title"), have("tab_url", "url").alias("_url"), have("ctx_app", "app_name").alias("_app"), said.alias("_said"), F.col("text_content").alias("_clip")]
    at = events.select("session_id", "timestamp_ms", "seq", *fields)
    own = docs.select("session_id", "start_ms", "end_ms", "event_count", "label")
    found = points_in_intervals(own, at, bucket_ms, "left")
    strings = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))

    def ordered(c):
        listed = F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("timestamp_ms", "seq", F.col(c).alias("v")))))
        return F.transform(listed, lambda x: x["v"])

    return found.groupBy(*own.columns).agg(
        strings("_title").alias("window_titles"), strings("_url").alias("urls"), strings("_app").alias("apps_seen"), F.slice(ordered("_said"), 1, most_texts).alias("extracted_texts"),
        ordered("_clip").alias("anchor_texts"),
    )


def merged(docs: DataFrame, events: DataFrame, rules: segment.Rules, bucket_ms: int) -> DataFrame:
    """Neighbours of one label merged, with their context, by the clipboard contents of their events and by time."""
    rules = replace(rules, merge_gap_ms=MERGE_GAP_MS) if rules.merge_gap_ms == segment.Rules.merge_gap_ms else rules
    return segment.merged_segments(with_context(stored(docs, "labelled-windows"), events, bucket_ms), rules)


def segments(
    events: DataFrame, boundary: Trees | None, label: Callable[[DataFrame], DataFrame] | None, rules: segment.Rules = segment.Rules(), bucket_ms: int = 600_000, **thresholds
) -> DataFrame:
    """Segments by both models; by the rules, from the events that are no noise, where one of them is missing."""
    if boundary is None or label is None:
        if {"ctrl", "key", "element_text"} <= set(events.columns):
            from worktrace.functions.columns import keeps_event

            events = events.where(keeps_event(F.col("event_type"), F.col("ctrl"), F.col("key"), F.col("element_text")))
        return segment.merged_segments(segment.rule_context(events, rules), rules)
    p = ml.boundary_probability(boundary, features.features(events)).select("session_id", "timestamp_ms", "seq", "p")
    likely = events.join(p, ["session_id", "timestamp_ms", "seq"])
    return merged(label(windows(likely, min_ms=rules.min_ms, bucket_ms=bucket_ms, **thresholds)), events, rules, bucket_ms)

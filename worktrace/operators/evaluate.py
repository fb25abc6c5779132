"""Segmentations against ground truth: boundary F1, overlap F1 and label purity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate, groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrace.functions.columns import f1, iou, ratio
from worktrace.operators import truth
from worktrace.operators.intervals import overlapping
from worktrace.operators.segment import by_session
from worktrace.sources.storage import stored


def boundaries(segments: DataFrame) -> DataFrame:
    """session_id and timestamp_ms of all starts and ends."""
    return segments.select("session_id", F.explode(F.array("start_ms", "end_ms")).alias("timestamp_ms")).where("timestamp_ms is not null")


def islands(df: DataFrame, start: str, end: str, slack_ms: int) -> DataFrame:
    """Numbers the groups of a session that lie further than ``slack_ms`` apart: nothing matches across them."""
    w = Window.partitionBy("session_id").orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(F.col(start) - reach > slack_ms, 1).otherwise(0)).withColumn("island", F.sum("_new").over(w)).drop("_new")


def greedy_boundaries(pred: list[int], true: list[int], tolerance_ms: int) -> int:
    """Predictions in ascending order take the closest unused true boundary within the tolerance, the earlier one on a tie."""
    used, hits = [False] * len(true), 0
    for p in pred:
        window = range(bisect_left(true, p - tolerance_ms), bisect_right(true, p + tolerance_ms))
        near = [(abs(p - true[i]), i) for i in window if not used[i]]
        if near:
            used[min(near)[1]] = True
            hits += 1
    return hits


def greedy_overlaps(pred: list[tuple], true: list[tuple], least: float) -> int:
    """Predictions by start take the unused execution of the largest IoU, the earlier one on a tie, if it reaches ``least``."""
    used, hits = [False] * len(true), 0
    starts, reach = [a for a, _ in true], list(accumulate((b for _, b in true), max))
    for s, e in pred:
        best, at = 0.0, None
        for i in range(bisect_right(reach, s), bisect_left(starts, e)):  # the others do not overlap
            a, b = true[i]
            both = max(0, min(e, b) - max(s, a))
            union = (e - s) + (b - a) - both
            if not used[i] and union > 0 and both / union > best:
                best, at = both / union, i
        if at is not None and best >= least:
            used[at] = True
            hits += 1
    return hits


def _scores(sessions: DataFrame, pred: DataFrame, true: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of ``sessions`` with n_pred, n_true, n_hits, precision, recall and f1; what is missing counts 0."""
    n = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    out = sessions.join(n(pred, "n_pred"), "session_id", "left").join(n(true, "n_true"), "session_id", "left")
    out = out.join(hits.groupBy("session_id").agg(F.sum("hits").alias("n_hits")), "session_id", "left")
    out = out.select("session_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_pred", "n_true", "n_hits")])
    p, r = ratio(F.col("n_hits"), F.col("n_pred")), ratio(F.col("n_hits"), F.col("n_true"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def _sessions(pred: DataFrame, true: DataFrame) -> DataFrame:
    return pred.select("session_id").distinct().join(true.select("session_id").distinct(), "session_id")


def _matched(pred: DataFrame, true: DataFrame, slack_ms: int, match) -> DataFrame:
    both = pred.withColumn("side", F.lit(0)).unionByName(true.withColumn("side", F.lit(1)))
    grouped = islands(both, "start_ms", "end_ms", slack_ms)

    def fold(rows):
        hits = 0
        for _, island in groupby(rows, key=lambda r: r["island"]):
            sides: tuple[list, list] = ([], [])
            for r in island:
                sides[r["side"]].append((r["start_ms"], r["end_ms"]))
            hits += match(*sides)
        yield (hits,)

    return by_session(grouped, fold, "session_id string, hits long", "start_ms", "end_ms", "side")


def boundary_f1(pred: DataFrame, true: DataFrame, tolerance_ms: int = 5_000, sessions: DataFrame | None = None) -> DataFrame:
    """Scores of boundaries (session_id, timestamp_ms) per session, of ``sessions`` or of those on both sides."""
    span = lambda df: df.select("session_id", F.col("timestamp_ms").alias("start_ms"), F.col("timestamp_ms").alias("end_ms"))
    match = lambda a, b: greedy_boundaries([x for x, _ in a], [x for x, _ in b], tolerance_ms)
    return _scores(_sessions(pred, true) if sessions is None else sessions, pred, true, _matched(span(pred), span(true), tolerance_ms, match))


def segment_iou(pred: DataFrame, true: DataFrame, least: float = 0.5, sessions: DataFrame | None = None) -> DataFrame:
    """Scores of segments (session_id, start_ms, end_ms) per session; predictions that do not end after they start do not count.

    Sessions all of whose predictions are such stay, with 0. Executions all count, though those without length match nothing.
    """
    lasting = lambda df: df.select("session_id", "start_ms", "end_ms").where("end_ms > start_ms")
    sessions = _sessions(pred, true) if sessions is None else sessions
    return _scores(sessions, lasting(pred), true, _matched(lasting(pred), lasting(true), -1, lambda a, b: greedy_overlaps(a, b, least)))


def evaluated_sessions(pred: DataFrame, manifests: DataFrame, tolerance_ms: int = 5_000, least: float = 0.5) -> DataFrame:
    """All scores of each predicted session (session_id, start_ms, end_ms) that has a manifest."""
    bounds, runs = truth.true_boundaries(manifests), truth.true_executions(manifests)
    sessions = _sessions(pred, manifests)
    b = boundary_f1(boundaries(pred), bounds, tolerance_ms, sessions)
    s = segment_iou(pred, runs, least, sessions)
    named = lambda df, kind: [df[c].alias(f"{kind}_{c}") for c in ("precision", "recall", "f1")]
    b = b.select("session_id", F.col("n_true").alias("true_boundary_count"), *named(b, "boundary"))
    s = s.select("session_id", F.col("n_true").alias("true_exec_count"), *named(s, "segment"))
    counts = pred.groupBy("session_id").agg(F.count("*").alias("pred_count"))
    return counts.join(b, "session_id").join(s, "session_id")


def unmatched_sessions(pred: DataFrame, manifests: DataFrame) -> DataFrame:
    """Predicted sessions without a manifest."""
    return pred.select("session_id").distinct().join(manifests.select("session_id"), "session_id", "left_anti")


def macro_scores(sessions: DataFrame) -> DataFrame:
    """One row: the number of sessions and the unweighted means of their scores, 0 without sessions."""
    names = [f"{kind}_{x}" for kind in ("boundary", "segment") for x in ("precision", "recall", "f1")]
    return sessions.agg(F.count("*").alias("n_sessions"), *[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names])


def label_codes(pred: DataFrame, true: DataFrame, bucket_ms: int = 600_000, least: float = 0.5) -> DataFrame:
    """label, code and c: how many segments of a label have their best execution, which may be shared, in a code."""
    p = pred.groupBy("session_id", "start_ms", "end_ms", "label").agg(F.count("*").alias("copies"))
    t = true.select(F.col("session_id").alias("other_session"), F.col("start_ms").alias("other_start"), F.col("end_ms").alias("other_end"), "code")
    score = iou(F.col("start_ms"), F.col("end_ms"), F.col("other_start"), F.col("other_end"))
    p, t = stored(p, "predicted"), stored(t, "true")  # their labels cost most, and the join looks at them twice
    found = overlapping(p, t, bucket_ms).withColumn("iou", score).where(F.col("iou") >= least)
    best = found.groupBy("session_id", "start_ms", "end_ms", "label", "copies").agg(F.min(F.struct((-F.col("iou")).alias("i"), "other_start", "other_end", "code")).alias("best"))
    return best.groupBy("label", F.col("best.code").alias("code")).agg(F.sum("copies").alias("c"))


def label_histogram(codes: DataFrame) -> DataFrame:
    """label and codes: a map from code to count; there are few codes."""
    pairs = codes.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("code", "c"))).alias("codes"))
    return pairs.select("label", F.map_from_entries("codes").alias("codes"))


def label_purity(pred: DataFrame, true: DataFrame, bucket_ms: int, least: float = 0.5) -> DataFrame:
    """Per predicted label: n matched, the most common code and its share."""
    counts = label_codes(pred, true, bucket_ms, least)
    top = counts.groupBy("label").agg(F.sum("c").alias("n_matched"), F.min(F.struct((-F.col("c")).alias("c"), "code")).alias("top"))
    return top.select("label", "n_matched", F.col("top.code").alias("top_code"), ratio(-F.col("top.c"), F.col("n_matched")).alias("purity"))


def macro_purity(purity: DataFrame) -> DataFrame:
    return purity.agg(F.coalesce(F.avg("purity"), F.lit(0.0)).alias("macro_purity"))

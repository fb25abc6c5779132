"""Streams of a session: idle segments, late and repeated events, drops of similarity between frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_idle_segments(events: DataFrame, idle_ms: int, late: str = "1 hour") -> DataFrame:
    """Segments of a stream (session_id, timestamp_ms), given out when the watermark has passed them by ``idle_ms``.

    Session windows join events that are exactly a gap apart, batch segments do not: the gap is one millisecond less.
    Events later than ``late`` are dropped by the watermark (``stream_late_events`` gives them); state is one window for each
    open segment.
    """
    timed = events.withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", late)
    out = timed.groupBy("session_id", F.session_window("at", f"{idle_ms - 1} milliseconds").alias("w"))
    out = out.agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.count("*").alias("event_count"))
    return out.select("session_id", "start_ms", "end_ms", "event_count")


def stream_once(events: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """The first of the events that are equal in session_id, timestamp_ms and ``keys``; state goes when the watermark has passed."""
    timed = events.withColumn("_at", F.timestamp_millis("timestamp_ms")).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark(["session_id", "timestamp_ms", *keys]).drop("_at")


def _expiring(state: GroupState, greatest: int) -> None:
    """Lets ``state`` go when the watermark passes ``greatest``: what comes later for its session is newer."""
    state.setTimeoutTimestamp(max(greatest, state.getCurrentWatermarkMs()) + 1)


def stream_late_events(events: DataFrame, late_ms: int, silence: str = "1 day") -> DataFrame:
    """session_id, timestamp_ms and late_by_ms of events more than ``late_ms`` behind the greatest time of earlier batches of their session.

    State is one number for each session, kept until the session has been silent for ``silence``; the watermark drops what comes
    still later than that, so it should be well above ``late_ms``.
    """

    def late(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else None
        greatest = before
        for frame in frames:
            times = frame["timestamp_ms"].dropna().astype("int64")
            if times.empty:
                continue
            greatest = int(times.max()) if greatest is None else max(greatest, int(times.max()))
            if before is not None:
                behind = before - times
                behind = behind[behind > late_ms]
                yield pd.DataFrame({"session_id": key[0], "timestamp_ms": before - behind, "late_by_ms": behind})
        if greatest is not None:
            state.update((greatest,))
            _expiring(state, greatest)

    schema = "session_id string, timestamp_ms long, late_by_ms long"
    lean = events.select("session_id", "timestamp_ms", F.timestamp_millis("timestamp_ms").alias("at")).withWatermark("at", silence)
    return lean.groupBy("session_id").applyInPandasWithState(late, schema, "greatest long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_frame_drops(frames: DataFrame, least: float, silence: str = "1 day") -> DataFrame:
    """session_id, timestamp_ms and drop_magnitude of frames (session_id, timestamp_ms, embedding) whose similarity to the frame before lies
    more than ``least`` below that of the neighbouring pairs, as ``vision.multi_frame`` finds them in a table.

    A frame is judged when the next one is there. State is the last three frames of a session, kept until it has been silent for
    ``silence``; frames of a batch are sorted, those not after the last of earlier batches are left out.
    """

    def cosine(a: np.ndarray, b: np.ndarray) -> float:
        norm = float(np.linalg.norm(a) * np.linalg.norm(b))
        return float(a @ b) / norm if norm else 0.0

    def drops(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept: list[tuple[int, np.ndarray]] = []
        if state.exists:
            numbers, flat = state.get
            kept = list(zip(numbers, np.asarray(flat, "float64").reshape(len(numbers), -1)))
        last = kept[-1][0] if kept else None
        rows = [(int(n), np.asarray(e, "float64")) for batch in batches for n, e in zip(batch["timestamp_ms"], batch["embedding"])]
        found = []
        for number, vector in sorted((r for r in rows if last is None or r[0] > last), key=lambda r: r[0]):
            kept.append((number, vector))
            if len(kept) == 4:
                (_, a), (_, b), (at, c), (_, d) = kept
                drop = (cosine(a, b) + cosine(c, d)) / 2 - cosine(b, c)
                if drop > least:
                    found.append((key[0], at, drop))
                del kept[0]
        if kept:
            state.update(([n for n, _ in kept], np.concatenate([v for _, v in kept]).tolist()))
            _expiring(state, kept[-1][0])
        yield pd.DataFrame(found, columns=["session_id", "timestamp_ms", "drop_magnitude"])

    schema = "session_id string, timestamp_ms long, drop_magnitude double"
    lean = frames.select("session_id", "timestamp_ms", F.col("embedding").cast("array<double>").alias("embedding"), F.timestamp_millis("timestamp_ms").alias("at"))
    kind = "numbers array<long>, vectors array<double>"
    return lean.withWatermark("at", silence).groupBy("session_id").applyInPandasWithState(drops, schema, kind, "append", GroupStateTimeout.EventTimeTimeout)

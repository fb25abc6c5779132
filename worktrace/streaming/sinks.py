"""One stream into several sinks: rows on time and rows too late, each written once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BATCH = "batch"


def with_lateness(events: DataFrame, silence: str = "1 day") -> DataFrame:
    """``events`` (session_id, timestamp_ms, ...) with late_by_ms: how far each is behind the greatest time of earlier batches of its
    session, 0 if it is not. State is one number a session, kept until the session has been silent for ``silence``."""

    def judged(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = greatest = state.get[0] if state.exists else None
        for frame in frames:
            times = frame["timestamp_ms"]
            known = times.dropna()
            if len(known):
                greatest = int(known.max()) if greatest is None else max(greatest, int(known.max()))
            behind = (before - times).clip(lower=0).fillna(0) if before is not None else times * 0
            yield frame[names].assign(late_by_ms=behind.fillna(0).astype("int64"))
        if greatest is not None:
            state.update((greatest,))
            state.setTimeoutTimestamp(max(greatest, state.getCurrentWatermarkMs()) + 1)

    names = events.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", late_by_ms long"
    timed = events.withColumn("_at", F.timestamp_millis("timestamp_ms")).withWatermark("_at", silence)
    return timed.groupBy("session_id").applyInPandasWithState(judged, schema, "greatest long", "append", GroupStateTimeout.EventTimeTimeout)


def write_batch(rows: DataFrame, batch: int, folder: str, sinks: dict[str, str]) -> None:
    """Writes a micro-batch to each of ``sinks``: folder name to the condition of its rows.

    The batch is computed once, into ``<folder>/staged``, from which the sinks are filled. Each holds a batch in a folder of its own
    (``batch=<id>``), which a repeated batch replaces as a whole, so that each row is there once however often a batch is restarted.
    """
    at = lambda name: f"{folder.rstrip('/')}/{name}/{BATCH}={batch}"
    rows.write.mode("overwrite").parquet(at("staged"))
    staged = rows.sparkSession.read.schema(rows.schema).parquet(at("staged"))
    for name, condition in sinks.items():
        staged.where(condition).write.mode("overwrite").parquet(at(name))


def write_on_time_and_late(events: DataFrame, late_ms: int, folder: str, silence: str = "1 day") -> DataStreamWriter:
    """A writer of the stream: events up to ``late_ms`` late go to ``<folder>/on_time``, others to ``<folder>/late``; start() it with a
    checkpoint location. One query reads the source, so that both sinks stand at the same batch."""
    sinks = {"on_time": f"late_by_ms <= {late_ms}", "late": f"late_by_ms > {late_ms}"}
    return with_lateness(events, silence).writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, folder, sinks))

"""Streams of the rule engine and of late rows: shuffled and restarted batches against the batch results."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from worktrace.operators import segment
from worktrace.streaming.rules import Machine, stream_rule_segments
from worktrace.streaming.sinks import write_on_time_and_late

from test_segments import EVENT, plain_segments, random_session

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_machine_equals_the_plain_fold(spark):
    rng = random.Random(3)
    for i in range(150):
        events = random_session(rng, "s", rng.randrange(1, 120), rng.choice([0, 0.05, 0.2]))
        lean = segment.signals(spark.createDataFrame(events, EVENT)).collect() if i < 3 else None
        rows = [tuple(r)[1:] for r in lean] if lean else [plain_signals(e) for e in events]
        state = None
        found = []
        for row in rows:  # the state goes out and comes back between any two events
            machine = Machine(segment.Rules(), state)
            machine.idle(row[0] - 1)
            machine.event(*row)
            found += machine.found
            state = machine.state()
        machine = Machine(segment.Rules(), state)
        machine.end()
        assert [(a, b, c, d) for a, b, c, d in found + machine.found] == plain_segments(events, segment.Rules())


def plain_signals(e):
    from worktrace.functions import columns as C

    _, t, seq, kind, app, title, url, nav, anchor = e
    browser, portal = "Chrome" in app, next((p for p in C.PORTALS if p in title), None)
    switch = kind == "app_switch" and browser
    home = url.endswith("/dashboard") if switch else kind == "browser_navigation" and nav.endswith("/dashboard")
    return (t, seq, app in C.WORK_APPS, home, portal if switch else None, portal if browser else None, portal, anchor)


def test_shuffled_stream_gives_the_batch_segments(rocks, tmp_path):
    spark = rocks
    rng = random.Random(6)
    base = 1_700_000_000_000
    events = [(n, base + t, *rest) for s in range(5) for n, t, *rest in random_session(rng, f"ses_{s}", 50, 0.1)]
    events.sort(key=lambda e: e[1])
    half = base + (events[-1][1] - base) // 2
    end = [(n, base + 100 * 86_400_000, i, "x", "", "", "", "", None) for i, n in enumerate(["ses_end", "ses_0"])]
    batches = [[e for e in events if e[1] <= half], [e for e in events if e[1] > half], end, [("ses_end", base + 200 * 86_400_000, 9, "x", "", "", "", "", None)]]
    out = str(tmp_path / "out")
    for batch in batches:
        rng.shuffle(batch)
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        made = stream_rule_segments(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), late="1 minute")
        q = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = segment.rule_segments(spark.createDataFrame(events, EVENT))
    assert got == sorted(map(tuple, want.select(*spark.read.parquet(out).columns).collect())) and got
    state = spark.read.format("statestore").option("stateVarName", "machine").load(str(tmp_path / "cp"))
    assert [r[0] for r in state.select(F.col("key.session_id")).distinct().collect()] == ["ses_end"]  # of sessions that ended nothing is kept
    held = spark.read.format("statestore").option("stateVarName", "buffer").load(str(tmp_path / "cp"))
    assert held.select(F.col("key.session_id")).distinct().count() <= 1


def test_restarted_batch_writes_each_row_once(spark, tmp_path):
    schema = "session_id string, timestamp_ms long, seq long"
    batches = [[("a", 100_000, 0), ("b", 5_000, 1)], [("a", 20_000, 2), ("a", 99_000, 3), ("b", 9_000, 4), ("a", 100_000, 5)], [("a", 1_000, 6), ("a", 200_000, 7)]]
    folder, cp = str(tmp_path / "out"), tmp_path / "cp"

    def run():
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = write_on_time_and_late(source, 5_000, folder).option("checkpointLocation", str(cp)).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None

    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
        last = max(int(f) for f in os.listdir(cp / "commits") if f.isdigit())
        for name in (f"{last}", f".{last}.crc"):  # as if the driver had been lost before the batch was committed
            os.remove(cp / "commits" / name)
        run()
    rows = lambda name: sorted((r.seq, r.late_by_ms) for r in spark.read.parquet(f"{folder}/{name}").collect())
    assert rows("late") == [(2, 80_000), (6, 99_000)] and rows("on_time") == [(0, 0), (1, 0), (3, 1_000), (4, 0), (5, 0), (7, 0)]

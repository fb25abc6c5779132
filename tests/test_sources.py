"""The session iterator, the older argument, first-seen order, hooks and the small readers and writers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from worktrace.functions import columns as C
from worktrace.operators import label, mining, policy, stats, views, vision
from worktrace.sources import sessions, sinks, telemetry


def write_session(folder, name, chunks):
    for chunk, events in chunks.items():
        (folder / name / chunk).mkdir(parents=True)
        (folder / name / chunk / "events.jsonl").write_text("\n".join(json.dumps(e) for e in events))


def event(i, t, seq=0, kind="x"):
    return {"event_id": str(i), "timestamp_ms": t, "event_type": kind, "correlation": {"sequence_number": seq}}


def test_iterator_gives_a_session_in_order(spark, tmp_path):
    write_session(tmp_path, "ses_a", {"chunk_2": [event(i, (i * 7919) % 1000, i % 3) for i in range(900)], "chunk_1": [event(5000, 500), event(5001, 500), event(5002, 1, kind="text_input_complete")]})
    write_session(tmp_path, "ses_b", {"chunk_1": [event(1, 5), event(2, 3)]})
    for name, n in (("ses_a", 902), ("ses_b", 2)):
        got = list(telemetry.iter_session_events(spark, str(tmp_path / name)))
        keys = [tuple(r[c] for c in telemetry.EVENT_ORDER) for r in got]
        assert len(got) == n and keys == sorted(keys) and {r.session_id for r in got} == {name}
    assert [r.event_id for r in got] == ["2", "1"]
    same_time = [r.event_id for r in telemetry.iter_session_events(spark, str(tmp_path / "ses_a")) if r.timestamp_ms == 500 and r.seq == 0]
    assert same_time[:2] == ["5000", "5001"]  # of equal time and number, by chunk and line


def test_the_older_argument_decides(spark, tmp_path):
    write_session(tmp_path, "ses_a", {"chunk_1": [event(1, 1, kind="text_input_complete"), event(2, 2)]})
    read = lambda **kw: telemetry.read_sessions(spark, str(tmp_path), **kw)
    assert read(policy="keep", drop_text_input_complete=True).count() == 1
    assert read(policy="drop", drop_text_input_complete=False).where("_is_unreliable").count() == 1
    assert sum(1 for _ in telemetry.iter_session_events(spark, str(tmp_path / "ses_a"), drop_text_input_complete=False)) == 2


def test_ties_go_to_what_is_seen_first(spark, tmp_path):
    rows = [("s1", "z"), ("s1", "a"), ("s2", "m")]
    (tmp_path / "segments.jsonl").write_text("\n".join(json.dumps({"session_id": s, "start": "2026-01-01T00:00:00Z", "end": "2026-01-01T00:01:00Z", "label": x}) for s, x in rows))
    found = sessions.segments(spark, str(tmp_path / "segments.jsonl"))
    events = spark.createDataFrame([("s1", 1_767_225_600_000 + 1000, "app_switch", "A"), ("s2", 1_767_225_600_000 + 1000, "app_switch", "A")], "session_id string, timestamp_ms long, event_type string, app_name string")
    ranked = mining.roi_ranking(found, events, 600_000).orderBy("rank").collect()
    assert [r.process for r in ranked] == ["z", "a", "m"] and len({r.roi_score for r in ranked}) == 1
    assert [r.process for r in mining.roi_ranking(found.drop("seen"), events, 600_000).orderBy("rank").collect()][2] == "m"
    counted = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "at int, v string")
    assert [r.v for r in stats.top_counts(counted, 2, ["v"], "at").collect()] == ["b", "a"]


def test_a_failing_hook_does_not_end_the_job(spark):
    def find(context):
        if context["n"] == 1:
            raise ValueError("no")
        return {0: " 　named ", 2: 7, 3: ""}.get(context["n"], "x" * 99)

    df = spark.createDataFrame([(i, C.PORTALS[0], []) for i in range(5)], "n int, p string, t array<string>")
    got = df.select("n", label.hooked_label(F.struct("n"), F.col("p"), F.col("t"), label.python_hook(find), True).alias("x")).orderBy("n").collect()
    assert [r.x for r in got] == ["named", "hr_process", "hr_process", "hr_process", "x" * 64]


def test_codes_have_labels(spark):
    got = spark.createDataFrame([("A",), ("O",), ("?",), (None,)], "c string").select(label.code_label(F.col("c"))).collect()
    assert [r[0] for r in got] == ["resident_tax_verification", "return_processing", None, None] and len(label.CODE_LABELS) == 15


def test_images_boundaries_lines_and_stamps(spark, tmp_path):
    shots = tmp_path / "ses_a" / "screenshots"
    shots.mkdir(parents=True)
    for t in (1700000000001, 1700000000002):
        (shots / f"scr_smart_{t}_monitor_1_post.jpg").write_bytes(b"x")
    (shots / "other.jpg").write_bytes(b"x")
    found = sessions.images(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.session_id, r.timestamp_ms) for r in found] == [("ses_a", 1700000000001), ("ses_a", 1700000000002)]
    bounds = spark.createDataFrame([(r.path, 0.5) for r in found], "boundary_detected_at string, similarity_score double")
    sinks.write_lines(bounds, str(tmp_path / "bounds"), "boundary_detected_at")
    back = sessions.vision_boundaries(spark, str(tmp_path / "bounds"))
    assert sorted(map(tuple, back.collect())) == [("ses_a", 1700000000001), ("ses_a", 1700000000002)]
    parts = vision.boundary_segments(back)
    sinks.write_lines(sinks.deliverable(parts), str(tmp_path / "parts"))
    assert sessions.segments(spark, str(tmp_path / "parts")).first().label == vision.LABEL
    labelled = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "label string, n int")
    assert [r.label for r in views.choices(labelled, "label").collect()] == ["a", "b"]
    assert spark.range(1).select(views.percent(F.lit(0.9375))).first()[0] == "93.8%"
    assert policy.stamped(labelled).where("processed_at is not null").count() == 3


def test_views_of_results(spark):
    columns = "process string, volume long, total_duration_min double, avg_duration_s double, avg_app_switches double, avg_clipboard_ops double, friction double, roi_score double, rank long"
    ranking = spark.createDataFrame([("b", 2, 3.0, 9.0, 1.0, 1.0, 2.0, 0.5, 2), ("a", 4, 3.0, 4.5, 1.0, 0.0, 1.0, 0.9, 1), ("c", 1, 1.0, 6.0, 0.0, 0.0, 0.0, 0.0, 3)], columns)
    table = views.ranking_table(ranking)
    assert table.columns == list(views.RANKING_TITLES.values()) and [r["Business Process"] for r in table.collect()] == ["a", "b", "c"]
    bars = {r.place: (r.process, r.value) for r in views.bars(ranking, "total_duration_min").collect()}
    assert bars == {1: ("c", 1.0), 2: ("a", 3.0), 3: ("b", 3.0)}  # ties by rank
    assert sorted(map(tuple, views.scatter(ranking).collect()))[0] == ("a", 4, 0.9, 1.0)

    segments = spark.createDataFrame([("s", 0, 1500, "x")], "session_id string, start_ms long, end_ms long, label string")
    row = views.segment_table(segments).first().asDict()
    assert list(row) == list(views.SEGMENT_TITLES.values()) and row["Duration (s)"] == 1.5 and row["Start (UTC)"].startswith("1970-01-01T00:00:00")

    scores = [("s2", 3, 4, 0.5, 0.25), ("s1" + "x" * 60, 1, 1, 0.5, 1.0), ("s0", 2, 2, 0.0, 0.0), ("s9", 5, 5, 0.96875, 0.9375)]
    scores = spark.createDataFrame(scores, "session_id string, pred_count long, true_exec_count long, boundary_f1 double, segment_f1 double")
    got = [tuple(r) for r in views.session_report(scores).orderBy("place").collect()]
    assert got == [(1, "s9", 5, 5, "96.9%", "93.8%"), (2, "s1" + "x" * 46, 1, 1, "50.0%", "100.0%"), (3, "s2", 3, 4, "50.0%", "25.0%"), (4, "s0", 2, 2, "0.0%", "0.0%")]

    codes = spark.createDataFrame([("x", "p", 1), ("x", "q", 3), ("x", "o", 1), ("y", "p", 2), ("w", "z", 7)], "label string, code string, c long")
    got = [tuple(r) for r in views.label_report(codes).orderBy("place").collect()]
    assert got == [(1, "w", "100.0%", "z(7)"), (2, "y", "100.0%", "p(2)"), (3, "x", "60.0%", "q(3)  o(1)  p(1)")]

    many = spark.createDataFrame([(f"s{i}",) for i in range(7)], "session_id string")
    lines = lambda df: [r.line for r in views.warned(df).orderBy("place").collect()]
    assert lines(many) == [f"- s{i}" for i in range(5)] + ["... and 2 more"] and lines(many.limit(0)) == [] and len(lines(many.where("session_id < 's5'"))) == 5

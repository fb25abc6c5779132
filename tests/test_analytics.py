"""Analytics operators: against their SQL on the smallest tables, and against small cases worked out by hand."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from worktrace.functions import columns as C
from worktrace.operators import evaluate, label, mining, policy, segment, stats, vision
from worktrace.plans.queries import ORACLES, QUERIES
from worktrace.sources import telemetry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    names, rows = want.columns, want.fetchall()
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    sort = lambda rs: sorted((tuple(cell(r[c]) for c in sorted(names)) for r in rs), key=repr)
    assert sort(got.collect()) == sort(dict(zip(names, r)) for r in rows)


def rows(*events):
    """(seconds, type, app, title, url, anchor) as events of one session."""
    return [("ses_1", int(t * 1000), i, *rest) for i, (t, *rest) in enumerate(events)]


COLUMNS = "session_id string, timestamp_ms long, seq long, event_type string, app_name string, window_title string, url string, anchor string"
HR, FIN = C.PORTALS[:2]


def spans(spark, *events, **rules):
    found = segment.rule_segments(spark.createDataFrame(rows(*events), COLUMNS), segment.Rules(**rules)).orderBy("start_ms").collect()
    return [(r.start_ms // 1000, r.end_ms // 1000, r.event_count) for r in found]


def test_idle_gap_of_exactly_the_timeout_ends_a_segment(spark):
    at = lambda t: (t, "window_title_change", "Notepad", "", "", None)
    assert spans(spark, at(0), at(10), at(70), at(80)) == [(0, 10, 2), (70, 80, 2)]
    assert spans(spark, at(0), at(10), at(69.999), at(80)) == [(0, 80, 4)]


def test_portal_change_hub_return_and_anchor(spark):
    chrome = lambda t, title, url="": (t, "app_switch", "Google Chrome", title, url, None)
    note = lambda t: (t, "app_switch", "Notepad", "", "", None)
    assert spans(spark, chrome(0, HR), note(9), chrome(10, FIN), note(20)) == [(0, 9, 2), (10, 20, 2)]
    hub = "http://127.0.0.1:5122/#/dashboard"
    assert spans(spark, chrome(0, HR), note(12), chrome(13, HR, hub), note(25)) == [(0, 12, 2), (13, 25, 2)]
    assert spans(spark, chrome(0, HR), note(11.999), chrome(13, HR, hub), note(25)) == [(0, 25, 4)]
    clip = lambda t, a: (t, "clipboard_change", "Notepad", "", "", a)
    assert spans(spark, note(0), clip(1, "a"), note(20), clip(21, "b"), note(30)) == [(0, 20, 3), (21, 30, 2)]
    assert spans(spark, note(0), clip(1, "a"), note(19.5), clip(21, "b"), note(30)) == [(0, 30, 5)]


def test_short_pieces_wait_for_each_other(spark):
    at = lambda t: (t, "window_title_change", "Notepad", "", "", None)
    assert spans(spark, at(0), at(3), at(100), at(104)) == [(0, 104, 4)]  # two short ones become a long one
    assert spans(spark, at(0), at(3), at(100), at(110)) == [(100, 110, 2)]  # a short one alone is dropped
    assert spans(spark, at(0), at(3)) == []


def merged(spark, *parts, **rules):
    df = spark.createDataFrame([("s", a * 1000, b * 1000, lab, n, anchors) for a, b, lab, n, anchors in parts], "session_id string, start_ms long, end_ms long, label string, event_count long, anchor_texts array<string>")
    return [(r.start_ms // 1000, r.end_ms // 1000, r.event_count) for r in segment.merged_segments(df, segment.Rules(**rules)).orderBy("start_ms").collect()]


def test_merge_rules(spark):
    assert merged(spark, (100, 120, "x", 10, ["a"]), (125, 150, "x", 8, ["a"])) == [(100, 150, 18)]
    assert merged(spark, (100, 120, "x", 10, ["a"]), (150, 160, "x", 8, [])) == [(100, 160, 18)]  # the longest gap still merges
    assert len(merged(spark, (100, 120, "x", 10, []), (151, 160, "x", 8, []))) == 2
    assert len(merged(spark, (100, 120, "x", 10, []), (125, 150, "y", 8, []))) == 2
    assert len(merged(spark, (100, 120, "x", 10, ["a"]), (125, 150, "x", 8, ["b"]))) == 2
    assert len(merged(spark, (100, 190, "x", 10, []), (195, 230, "x", 8, []))) == 2
    assert len(merged(spark, (100, 120, label.UNKNOWN, 1, []), (121, 130, label.UNKNOWN, 1, []))) == 2


def test_peaks_and_windows(spark):
    p = [(0, 0.6), (5, 0.9), (14, 0.7), (20, 0.95), (40, 0.5)]
    events = spark.createDataFrame([("s", t, t, x) for t, x in p], "session_id string, timestamp_ms long, seq long, p double")
    found = sorted((r.timestamp_ms, r.p) for r in segment.peaks(events, 0.5, 12).collect())
    assert found == [(5, 0.9), (20, 0.95), (40, 0.5)]

    def windows(ends, peaks):
        e = spark.createDataFrame([("s", t, t) for t in ends], "session_id string, timestamp_ms long, seq long")
        k = spark.createDataFrame([("s", t) for t in peaks], "session_id string, timestamp_ms long")
        return sorted((r.start_ms, r.end_ms) for r in segment.candidate_windows(e, k, 12).collect())

    assert windows((0, 25), (5, 20)) == [(0, 25)]  # what is too short at the end joins the window before
    assert windows((0, 20), (5, 20)) == [(0, 20)] and windows((0, 5), (5,)) == []
    assert windows((0, 32), (5, 20)) == [(0, 20), (20, 32)]


def test_greedy_matching():
    assert evaluate.greedy_boundaries([0, 60, 70, 120], [0, 60, 70, 120], 5) == 4
    assert evaluate.greedy_boundaries([3], [0, 6], 5) == 1 and evaluate.greedy_boundaries([0, 0], [0], 5) == 1
    assert evaluate.greedy_boundaries([6], [0], 5) == 0
    assert evaluate.greedy_overlaps([(50, 120)], [(0, 70)], 0.5) == 0 and evaluate.greedy_overlaps([(5, 65)], [(0, 60)], 0.5) == 1


def test_scores_equal_matching_without_islands(spark):
    pred, true = QUERIES["idle_segments"](spark, SF), segment.idle_segments(telemetry.tele(spark, SF), 6 * 3_600_000)
    for got, match, side in (
        (evaluate.boundary_f1(evaluate.boundaries(pred), evaluate.boundaries(true), 1_800_000), None, evaluate.boundaries),
        (evaluate.segment_iou(pred, true), evaluate.greedy_overlaps, None),
    ):
        by = {}
        for k, df in enumerate((pred, true)):
            for r in (side(df) if side else df.where("end_ms > start_ms")).collect():
                by.setdefault(r.session_id, ([], []))[k].append(r.timestamp_ms if side else (r.start_ms, r.end_ms))
        want = {}
        for s, (a, b) in by.items():
            a, b = sorted(a), sorted(b)
            if a and b:
                want[s] = evaluate.greedy_boundaries(a, b, 1_800_000) if side else match(a, b, 0.5)
        assert {r.session_id: r.n_hits for r in got.collect()} == want


def test_session_reader(spark, tmp_path):
    event = lambda i, t, kind, **more: json.dumps({"event_id": str(i), "timestamp_ms": t, "event_type": kind} | more, ensure_ascii=False)
    for chunk, lines in {
        "chunk_2": [event(3, 3000, "text_input_complete"), event(4, 4000, "keystroke", payload={"key": "C", "modifiers": {"ctrl": True}}), "{bad", "", "123"],
        "chunk_1": [event(1, 1000, "app_switch", payload={"new_app": {"app_name": "住民税通知確認"}}),
                    event(2, 2000, "x", context={"extracted_text": ["a", {"text": "b"}, ""]}, correlation={"sequence_number": 7})],
    }.items():
        d = tmp_path / "ses_20260101-000000-AB" / chunk
        d.mkdir(parents=True)
        (d / "events.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = telemetry.read_sessions(spark, str(tmp_path)).orderBy("timestamp_ms", "seq", "chunk", "line_no").collect()
    assert [r.event_id for r in got] == ["1", "2", "4"] and got[0].app_name == "住民税通知確認" and got[1].texts == ["a", "b"] and got[1].seq == 7
    assert got[2].ctrl and got[2].key == "c" and got[0].session_id == "ses_20260101-000000-AB"
    flagged = telemetry.read_sessions(spark, str(tmp_path), "flag").where("_is_unreliable").collect()
    assert [r.event_id for r in flagged] == ["3"] and telemetry.read_sessions(spark, str(tmp_path), bad_lines=True).count() == 2
    with pytest.raises(ValueError):
        telemetry.read_sessions(spark, str(tmp_path), "other")


def test_noise_and_labels(spark):
    df = spark.createDataFrame([("keystroke", True, "c", None), ("keystroke", False, "c", None), ("mouse_click", False, None, "確定"), ("mouse_click", False, None, "x"), ("other", False, None, None)], "k string, c boolean, key string, t string")
    kept = df.select(C.keeps_event(F.col("k"), F.col("c"), F.col("key"), F.col("t"))).collect()
    assert [r[0] for r in kept] == [True, False, True, False, True]
    cases = [("財務会計システム 交通費・宿泊費の精算申請", "http://127.0.0.1:5123/", "expense_processing"), ("住民税通知確認", ":5122/#/resident-tax", "resident_tax_verification"),
             ("Supplier_List - Word", "", "supplier_communication"), ("", "", "process_unknown"), ("RMA-12", "", "return_processing"), (None, None, "process_unknown")]
    df = spark.createDataFrame(cases, "p string, u string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", label.predict_label(F.col("p"), F.col("u"))).collect())


def test_policies(spark):
    ask = spark.createDataFrame(
        [("1", " A ", "quantity_change", 100, 125, 10.0, 5.0, 5), ("2", "A", "price_revision", 100, 100, 10.0, 15.0, 0), ("3", "A", "none", 0, 9, 1.0, -20.0, 8)],
        "po_id string, vendor_name string, request_type string, original_qty int, requested_qty int, unit_price double, price_change_pct double, delivery_date_shift_days int",
    )
    got = {r.po_id: r for r in policy.supplier_policy(ask).collect()}
    assert got["1"].status == policy.APPROVED and "(Original: 100 -> Requested: 125)" in got["1"].comment and "Vendor: A |" in got["1"].comment
    assert got["2"].reason == "Price increase (15.0%) exceeds standard limit (5.0%)" and got["3"].reason.startswith("Delivery delay (8 days)")
    claim = "claim_id string, employee_id string, employee_name string, department string, expense_category string, amount double, attendee_count int, has_receipt boolean"
    claims = [("a", "e", "n", "d", "entertainment", 18000.0, 2, True), ("b", "e", "n", "d", "entertainment", 5000.0, 0, True), ("c", "e", "n", "d", "travel_transit", 35000.0, 1, None), ("d", "e", "n", "d", "x", 1e6, 1, True)]
    got = policy.expense_policy(spark.createDataFrame(claims, claim))
    assert [r.status == policy.APPROVED for r in got.orderBy("claim_id").collect()] == [True, False, False, True]
    assert policy.scorecard(got).first().straight_through_pct == 50.0
    assert policy.scorecard(got.limit(0)).first().straight_through_pct == 0.0


def test_frames_across_block_borders(spark, monkeypatch):
    monkeypatch.setattr(vision, "BLOCK", 4)
    got = vision.multi_frame(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", 0.15).orderBy("vec_id").collect()
    monkeypatch.setattr(vision, "BLOCK", 1 << 20)
    assert got == vision.multi_frame(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", 0.15).orderBy("vec_id").collect() and got


def test_stream_gives_the_batch_segments(spark, tmp_path):
    from worktrace.streaming.sessions import stream_idle_segments

    events = telemetry.tele(spark, SF).select("session_id", "timestamp_ms", "seq")
    end = [("ses_end", 4_102_444_800_000, 0)]
    events.unionAll(spark.createDataFrame(end, events.schema)).write.parquet(str(tmp_path / "in"))
    stream = stream_idle_segments(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 43_200_000)
    q = stream.writeStream.format("memory").queryName("idle_stream").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = segment.idle_segments(events, 43_200_000).drop("seg_no")
    got = spark.table("idle_stream").where("session_id <> 'ses_end'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def streamed(spark, path, batches, schema, transform):
    """What ``transform`` of a stream gives, one file of ``batches`` a batch; the second run starts from the state of the first."""
    out = path / "out"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
        made = transform(spark.readStream.schema(schema).parquet(str(path / "in")))
        q = made.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None
    return sorted(map(tuple, spark.read.parquet(str(out)).collect()))


def test_stream_of_late_and_repeated_events(spark, tmp_path):
    from worktrace.streaming.sessions import stream_late_events, stream_once

    schema = "session_id string, timestamp_ms long, event_type string"
    batches = [[("a", 100_000, "x"), ("a", 100_000, "x"), ("a", 20_000, "y"), ("b", 5_000, "x")], [("a", 100_000, "x"), ("a", 30_000, "z"), ("a", 95_000, "z"), ("b", 9_000, "x")]]
    late = streamed(spark, tmp_path / "late", batches, schema, lambda s: stream_late_events(s, 10_000))
    assert late == [("a", 30_000, 70_000)]  # earlier in the same batch is no delay
    once = streamed(spark, tmp_path / "once", batches, schema, lambda s: stream_once(s, "event_type"))
    assert once == sorted(set(batches[0] + batches[1]))


def test_stream_of_frames_gives_the_batch_drops(spark, tmp_path):
    from worktrace.streaming.sessions import stream_frame_drops

    frames = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [("s", r.vec_id, [float(x) for x in r.embedding]) for r in frames.orderBy("vec_id").collect()]
    cut = len(rows) // 2 + 1
    schema = "session_id string, timestamp_ms long, embedding array<double>"
    got = streamed(spark, tmp_path, [rows[cut - 1 :: -1], rows[cut:]], schema, lambda s: stream_frame_drops(s, 0.15))
    want = vision.multi_frame(frames, "vec_id", 0.15).collect()
    assert [(n, round(d, 4)) for _, n, d in got] == sorted((r.vec_id, r.drop_magnitude) for r in want) and want


def test_markdown_and_empty_input(spark):
    assert mining.markdown(QUERIES["roi_ranking"](spark, SF)).count("\n") >= 3
    none = telemetry.tele(spark, SF).limit(0)
    assert segment.idle_segments(none, 10).count() == 0 and segment.rule_segments(none).count() == 0 and stats.idle_gaps(none).count() == 0


ISO = lambda s: f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}Z"


def session_folder(tmp_path):
    """Two sessions with ground truth of their own, one in the collection only, one without any."""
    run = lambda a, b=None, **more: {"start_ts": ISO(a), "end_ts": None if b is None else ISO(b), "exec_id": f"e{a}", "apps": ["Notepad"], "variant": "v"} | more
    manifest = lambda *processes: {"processes": [{"code": c, "family_name": c.lower(), "executions": e} for c, e in processes], "expected_boundaries": [{"ts": ISO(0), "type": "process_started"}, {"ts": ISO(9), "type": "other"}]}
    mine = {"ses_a": manifest(("A", [run(0, 60)]), ("B", [run(70, 120), run(200)])), "ses_b": manifest(("A", [run(0, 60), run(200, 260)]))}
    for name, content in mine.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "gt_manifest.json").write_text(json.dumps(content))
    (tmp_path / "ses_a" / "gt.jsonl").write_text("\n".join(json.dumps(x) for x in ({"event": "process_started", "process_code": "A"}, {"event": "process_started", "process_code": "A", "from": "B"})) + "\n{bad\n\n")
    (tmp_path / "ground_truth_manifests.json").write_text(json.dumps({"ses_c": manifest(("A", [run(0, 60)])), "ses_a": manifest()}))
    return str(tmp_path)


def test_ground_truth_files(spark, tmp_path):
    from worktrace.operators import truth
    from worktrace.sources import sessions

    folder = session_folder(tmp_path)
    found = sessions.manifests(spark, folder)
    assert sorted(r.session_id for r in found.collect()) == ["ses_a", "ses_b", "ses_c"]
    kinds = [(r.session_id, r.code, r.kind) for r in truth.true_boundaries(found).where("session_id = 'ses_a'").orderBy("timestamp_ms").collect()]
    assert kinds == [("ses_a", "A", "start"), ("ses_a", "A", "end"), ("ses_a", "B", "start"), ("ses_a", "B", "end"), ("ses_a", "B", "start")]
    assert truth.true_executions(found).count() == 5 and truth.expected_boundaries(found).where("session_id = 'ses_a'").count() == 1
    stats_ = {r.code: (r.exec_count, r.null_end_count) for r in truth.execution_stats(found).collect()}
    assert stats_ == {"A": (4, 0), "B": (1, 1)} and truth.value_counts(found, "apps").where("code = 'A'").first().n == 4
    log = sessions.ground_truth_log(spark, folder)
    assert [(r.session_id, r.process_code, r.from_code) for r in log.orderBy("block", "line_no").collect()] == [("ses_a", "A", None), ("ses_a", "A", "B")]
    assert [r.session_id for r in sessions.complete_sessions(found, log).collect()] == ["ses_a"]
    assert stats.consecutive_repeats(log.where("event = 'process_started'"), "session_id", "line_no", "process_code").first().n_repeats == 1
    empty = tmp_path / "none"
    empty.mkdir()
    assert sessions.manifests(spark, str(empty)).count() == 0 and sessions.ground_truth_log(spark, str(empty)).count() == 0
    (tmp_path / "ses_b" / "gt_manifest.json").write_text("{broken")
    with pytest.raises(Exception):
        sessions.manifests(spark, folder).collect()
    with pytest.raises(FileNotFoundError):
        sessions.session_chunks(spark, str(tmp_path / "ses_x"))
    with pytest.raises(NotADirectoryError):
        sessions.session_chunks(spark, str(tmp_path / "ses_b" / "gt_manifest.json"))
    (tmp_path / "ses_b" / "chunk_1").mkdir()
    (tmp_path / "ses_b" / "chunk_1" / "events.jsonl").write_text("")
    assert [x.rpartition("/")[2] for x in sessions.event_files(spark, str(tmp_path / "ses_b"))] == ["events.jsonl"]


def test_evaluation_of_files(spark, tmp_path):
    from worktrace.sources import sessions, sinks

    folder = session_folder(tmp_path)
    line = lambda s, a, b, **more: json.dumps({"session_id": s, "start": ISO(a), "end": ISO(b), "label": "x"} | more)
    lines = [line("ses_a", 3, 63), line("ses_a", 3, 63), line("ses_b", 6, 66), line("ses_b", 206, 266, label="y"), line("ses_c", 50, 40), line("ses_z", 0, 9), "{bad", "", json.dumps({"session_id": "ses_a", "start": ISO(1)})]
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    pred, true = sessions.predictions(spark, str(tmp_path / "p.jsonl")), sessions.manifests(spark, folder)
    assert pred.count() == 6 and [r.session_id for r in evaluate.unmatched_sessions(pred, true).collect()] == ["ses_z"]
    got = {r.session_id: r for r in evaluate.evaluated_sessions(pred, true).collect()}
    assert set(got) == {"ses_a", "ses_b", "ses_c"}
    a, b, c = got["ses_a"], got["ses_b"], got["ses_c"]
    assert (a.boundary_precision, a.boundary_recall, a.segment_precision, a.segment_recall) == (0.5, 0.4, 0.5, 0.5) and (a.pred_count, a.true_boundary_count, a.true_exec_count) == (2, 5, 2)
    assert b.boundary_f1 == 0 and b.segment_f1 == 1 and c.segment_f1 == 0 and c.pred_count == 1  # invalid predictions alone: 0, not absent
    macro = evaluate.macro_scores(evaluate.evaluated_sessions(pred, true))
    assert macro.first().segment_f1 == pytest.approx((a.segment_f1 + 1 + 0) / 3)
    from worktrace.operators import truth

    runs = truth.true_executions(true)
    codes = evaluate.label_codes(pred, runs, 600_000)
    purity = evaluate.label_purity(pred, runs, 600_000)
    assert {r.label: r.codes for r in evaluate.label_histogram(codes).collect()} == {"x": {"A": 3}, "y": {"A": 1}}  # equal predictions count each
    assert evaluate.macro_purity(purity).first()[0] == 1.0
    sinks.write_evaluation(evaluate.evaluated_sessions(pred, true), purity, evaluate.label_histogram(codes), macro, str(tmp_path / "out" / "eval.json"))
    kept = json.loads((tmp_path / "out" / "eval.json").read_text())
    assert kept["label_consistency"]["label_to_codes"] == {"x": {"A": 3}, "y": {"A": 1}} and spark.read.json(str(tmp_path / "out" / "eval.json.sessions")).count() == 3
    sinks.write_segments(pred, str(tmp_path / "out" / "segments"))
    assert sessions.segments(spark, str(tmp_path / "out" / "segments")).count() == 6 and sessions.segment_table(spark, str(tmp_path / "no.jsonl")).count() == 0
    assert sessions.segment_table(spark, str(tmp_path / "out" / "segments")).agg(F.max("duration_s")).first()[0] == 60.0
    sinks.write_ranking(QUERIES["roi_ranking"](spark, SF), str(tmp_path / "out" / "ranking.json"))
    assert len(json.loads((tmp_path / "out" / "ranking.json").read_text())) == QUERIES["roi_ranking"](spark, SF).count() and sessions.results(spark, str(tmp_path / "no.json")) is None
    assert sinks.load_model(str(tmp_path / "no-model")) is None
    (tmp_path / "ask.json").write_text(json.dumps([{"po_id": "1", "colour": "red"}]))
    with pytest.raises(TypeError):
        sessions.supplier_requests(spark, str(tmp_path / "ask.json"))


def test_reader_features_and_texts(spark, tmp_path):
    from worktrace.operators import chain, features

    event = lambda i, t, kind, **more: json.dumps({"event_id": str(i), "timestamp_ms": t, "event_type": kind} | more, ensure_ascii=False)
    app = lambda name, title, **more: {"active_app": {"app_name": name, "window_title": title}} | more
    lines = [
        event(1, 1000, "app_switch", payload={"new_app": {"app_name": "Excel", "window_title": "new"}}, context=app("Google Chrome", "住民税", active_browser_tab={"url": "http://h:5122/#/resident-tax"})),
        event(2, 5000, "clipboard_change", payload={"text_content": "EMP_98234"}, context=app("Google Chrome", "住民税", extracted_text="  text one  "), correlation={"ms_since_last_event": None}),
        event(3, 45_000, "mouse_click", payload={"target_element": {"name": "東京都渋谷区"}, "element": {"text": "zzz", "attributes": {"value": "save"}}}, context=app("Notepad", "n", extracted_text=["a", {"text": "b"}, "c", "d"]), correlation={"ms_since_last_event": 70_000}),
        event(4, 46_000, "mouse_click", payload={"element": {"text": "zzz", "attributes": {"text": "nothing", "value": "save"}}}),
        event(5, 47_000, "keystroke", payload={"character": "V", "modifiers": {"ctrl": False, "control": True}}),
    ]
    d = tmp_path / "ses_1" / "chunk_1"
    d.mkdir(parents=True)
    (d / "events.jsonl").write_text("\n".join(lines), encoding="utf-8")
    events = telemetry.read_sessions(spark, str(tmp_path))
    kept = events.where(C.keeps_event(F.col("event_type"), F.col("ctrl"), F.col("key"), F.col("element_text"))).orderBy("timestamp_ms").collect()
    assert [r.event_id for r in kept] == ["1", "2", "3", "5"]  # of an element's texts, the first that is not empty counts
    f = features.features(events).orderBy("timestamp_ms").collect()
    assert [r.dt_prev for r in f] == [0, 4000, 60_000, 0, 0] and [r.app_category for r in f] == [1, 1, 4, 0, 0] and [r.title_changed for r in f] == [0, 0, 1, 1, 0]
    assert f[0].is_app_switch == 1 and f[1].has_id == 1 and f[1].is_clipboard == 1 and f[0].url_depth == 4 and f[1].clip_delta == 9 and f[2].idle_30 == 1
    spans = spark.createDataFrame([("ses_1", 0, 5000), ("ses_1", 40_000, 50_000), ("ses_1", 90_000, 91_000)], "session_id string, start_ms long, end_ms long")
    docs = [(r.event_count, r.text) for r in chain.documents(spans, events, 600_000).orderBy("start_ms").collect()]
    assert docs == [(2, "SYS_HR_5122 ROUTE__resident-tax 住民税 住民税   text one   CLIP_EMP_98234"), (3, "n a b c 東京都渋谷区 zzz"), (0, "")]
    seg = spark.createDataFrame([("ses_1", 1000, 5000, 2, 0, 1), ("ses_1", 5000, 47_000, 3, 2, 4)], "session_id string, start_ms long, end_ms long, event_count long, first_no long, last_no long")
    out = segment.with_context(seg, events, 600_000).orderBy("start_ms").collect()
    assert out[0].extracted_texts == ["text one"] and out[1].extracted_texts == ["a", "b", "c", "d", "東京都渋谷区", "zzz"] and out[0].label == "resident_tax_verification"
    assert out[1].apps_seen == ["Notepad"] and chain.segments(events, None, None, segment.Rules(min_ms=1000)).columns[:3] == ["session_id", "start_ms", "end_ms"]


def test_learned_labels_and_reports(spark, tmp_path):
    from worktrace.operators import chain, ml
    from worktrace.sources import sinks

    rows = [(i, f"payroll sheet {i}" if i % 2 else f"tax notice {i}", float(i % 2)) for i in range(60)]
    model, report = ml.validated_labels(spark.createDataFrame(rows, "id long, text string, label double"), "id", rounds=20)
    assert {r.name: (r.f1, r.support) for r in report.collect()} == {"0.0": (1.0, 6), "1.0": (1.0, 6), "accuracy": (1.0, 12), "macro avg": (1.0, 12), "weighted avg": (1.0, 12)}
    sinks.save_model(model, str(tmp_path / "m"), {"classes": ["tax", "payroll"]})
    docs = spark.createDataFrame([("s", 0, 1, 1, "tax notice"), ("s", 2, 3, 1, "")], "session_id string, start_ms long, end_ms long, event_count long, text string")
    out = chain.labelled(docs, sinks.load_model(str(tmp_path / "m")), ["tax", "payroll"]).orderBy("start_ms").collect()
    assert [r.label for r in out] == ["tax", label.UNKNOWN] and json.loads((tmp_path / "m.json").read_text())["classes"] == ["tax", "payroll"]
    titles = spark.createDataFrame([(None, ["Google Chrome", "Ab!", "Year-end plan (draft)"]), (C.PORTALS[2], []), (None, ["!!!!"])], "p string, t array<string>")
    assert [r[0] for r in titles.select(label.portal_label(F.col("p"), F.col("t"))).collect()] == ["year_end_plan_draft", "ops_process", label.UNKNOWN]
    hooked = titles.select(label.hooked_label(F.col("p"), F.col("p"), F.col("t"), lambda p: F.when(p.isNotNull(), F.repeat(F.lit("x"), 99)), True)).collect()
    assert [r[0] for r in hooked] == ["year_end_plan_draft", "x" * 64, label.UNKNOWN]

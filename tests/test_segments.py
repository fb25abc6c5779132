"""The rule engine, merging, peaks, windows and interval joins against plain folds on random sessions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from worktrace.functions import columns as C
from worktrace.operators import intervals, scan, segment
from worktrace.operators.label import UNKNOWN

EVENT = "session_id string, timestamp_ms long, seq long, event_type string, app_name string, window_title string, url string, nav_url string, anchor string"
HUB = "http://127.0.0.1:5122/#/dashboard"
HR, FIN, OPS = C.PORTALS


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables stay in as many partitions as large ones, so that values are carried across them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_segments(events: list[tuple], r: segment.Rules) -> list[tuple]:
    """(start_ms, end_ms, first_no, last_no) of one session's events, by the rules as they are told."""
    out, state, waiting, anchor = [], None, None, None
    span = lambda x: x["last"] - x["start"]

    def close():
        nonlocal state, waiting
        if span(state) >= r.least_ms:
            if waiting and span(waiting) >= segment.LEAST_MS:
                out.append(waiting)
            out.append(state)
            waiting = None
        elif waiting:
            waiting |= {"last": state["last"], "to": state["to"]}
        else:
            waiting = state
        state = None

    for no, (_, t, _, kind, app, title, url, nav, own) in enumerate(sorted(events, key=lambda e: (e[1], e[2]))):
        browser = "chrome" in app.lower()
        portal = next((p for p in C.PORTALS if p in title), None)
        hub = lambda u: u.endswith("/dashboard")
        if state and t - state["last"] >= r.idle_ms:
            close()
        if state and kind == "app_switch" and browser:
            moved = portal and state["portal"] and portal != state["portal"]
            if moved or (hub(url) and state["work"] and span(state) >= r.hub_ms):
                close()
        if state and kind == "browser_navigation" and hub(nav) and state["work"] and span(state) >= r.hub_ms:
            close()
        if state and own and span(state) >= r.anchor_ms and state["work"] and anchor and own != anchor:
            close()
        anchor = own or anchor
        if not state:
            state = {"start": t, "from": no, "work": False, "portal": portal}
        state |= {"last": t, "to": no, "work": state["work"] or app in C.WORK_APPS}
        if browser and portal:
            state["portal"] = portal
    if state:
        if waiting and span(state) < r.least_ms:
            state = waiting | {"last": state["last"], "to": state["to"]}
            waiting = None
        close()
    return [(x["start"], x["last"], x["from"], x["to"]) for x in out]


def random_session(rng: random.Random, name: str, n: int, quiet: float) -> list[tuple]:
    t, out = 0, []
    for i in range(n):
        t += rng.choice([0, 500, 3000, 9000, 20_000]) if rng.random() > quiet else rng.choice([59_999, 60_000, 200_000])
        kind = rng.choice(["app_switch", "browser_navigation", "clipboard_change", "window_title_change"])
        app = rng.choice(["Google Chrome", "Google Chrome", "Notepad", "Microsoft Excel", "Other"])
        own = rng.choice(["a", "b", "c", None]) if kind == "clipboard_change" else None
        out.append((name, t, i, kind, app, rng.choice([HR, FIN, OPS, "", "none"]), rng.choice([HUB, "x"]), rng.choice([HUB, "x", ""]), own))
    return out


def test_rules_equal_the_plain_fold(spark):
    rng = random.Random(11)
    sessions = {f"ses_{i}": random_session(rng, f"ses_{i}", rng.randrange(1, 90), rng.choice([0, 0.03, 0.2])) for i in range(60)}
    sessions["ses_long"] = random_session(rng, "ses_long", 6000, 0.0)
    frame = spark.createDataFrame([e for s in sessions.values() for e in s], EVENT).repartition(5)
    for rules in (segment.Rules(), segment.Rules(min_ms=12_000), segment.Rules(min_ms=1000, hub_ms=8000, anchor_ms=9000)):
        got: dict = {}
        for r in segment.rule_segments(frame, rules).collect():
            assert r.event_count == r.last_no - r.first_no + 1
            got.setdefault(r.session_id, []).append((r.start_ms, r.end_ms, r.first_no, r.last_no))
        want = {s: plain_segments(e, rules) for s, e in sessions.items()}
        assert {s: sorted(v) for s, v in got.items()} == {s: sorted(v) for s, v in want.items() if v}


def test_one_session_spreads_over_tasks(spark):
    rng = random.Random(2)
    frame = spark.createDataFrame(random_session(rng, "s", 20_000, 0.0), EVENT)
    places, marks = segment._marks(frame, segment.Rules())
    assert places.groupBy("_part").count().count() > 3
    most = marks.groupBy("island").count().agg(F.max("count")).first()[0]
    assert most < 200 and marks.select("island").distinct().count() > 300  # an island is little, however long the session


def one(spark, *events, **rules):
    rows = [("s", t, i, *rest) for i, (t, *rest) in enumerate(events)]
    found = segment.rule_segments(spark.createDataFrame(rows, EVENT), segment.Rules(**rules))
    return sorted((r.start_ms, r.end_ms) for r in found.collect())


def test_portal_of_the_first_event_counts_whatever_the_app(spark):
    events = [(0, "app_switch", "Notepad", HR + " notes", "", "", None), (19_000, "window_title_change", "Notepad", "", "", "", None)]
    events += [(20_000, "app_switch", "Google Chrome", FIN, "", "", None), (40_000, "window_title_change", "Google Chrome", "", "", "", None)]
    assert one(spark, *events) == [(0, 19_000), (20_000, 40_000)]


def test_a_visit_counts_by_its_own_address(spark):
    work = [(0, "app_switch", "Notepad", "", "", "", None), (16_000, "app_switch", "Notepad", "", "", "", None)]
    visit = lambda url, nav: (17_000, "browser_navigation", "Google Chrome", "", url, nav, None)
    end = (30_000, "app_switch", "Notepad", "", "", "", None)
    assert one(spark, *work, visit(HUB, ""), end) == [(0, 30_000)]  # the tab's address is no visit
    assert one(spark, *work, visit("x", HUB), end) == [(0, 16_000), (17_000, 30_000)]


def test_reader_keeps_both_addresses(spark, tmp_path):
    import json

    from worktrace.sources import telemetry

    tab = {"active_browser_tab": {"url": HUB}}
    lines = [{"event_type": "browser_navigation", "timestamp_ms": 1, "context": tab}, {"event_type": "browser_navigation", "timestamp_ms": 2, "context": tab, "payload": {"to_url": "x"}}]
    folder = tmp_path / "ses_1" / "chunk_1"
    folder.mkdir(parents=True)
    (folder / "events.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = telemetry.read_sessions(spark, str(tmp_path)).orderBy("timestamp_ms").collect()
    assert [(r.url, r.nav_url) for r in rows] == [(HUB, ""), ("x", "x")]


def test_limits_that_would_lose_events_are_refused():
    for bad in ({"min_ms": 13_000}, {"hub_ms": 7_999}, {"anchor_ms": 5_000}):
        with pytest.raises(ValueError):
            segment.Rules(**bad)


def plain_merge(parts: list[dict], r: segment.Rules) -> list[dict]:
    out: list[dict] = []
    for p in sorted(parts, key=lambda p: (p["start_ms"], p["end_ms"], p["label"])):
        if out:
            x = out[-1]
            a, b = set(x["anchor_texts"]), set(p["anchor_texts"])
            brief = min(x["end_ms"] - x["start_ms"], p["end_ms"] - p["start_ms"]) < r.merge_short_ms
            fits = x["label"] == p["label"] != UNKNOWN and p["start_ms"] - x["end_ms"] <= r.merge_gap_ms and not (a and b and not a & b)
            if fits and (p["start_ms"] - x["start_ms"] < r.merge_start_ms or brief):
                x |= {"end_ms": max(x["end_ms"], p["end_ms"]), "event_count": x["event_count"] + p["event_count"], "n_merged": x["n_merged"] + 1}
                x |= {k: sorted({*x[k], *p[k]}) for k in ("window_titles", "urls", "apps_seen")} | {k: x[k] + p[k] for k in ("extracted_texts", "anchor_texts")}
                continue
        out.append(p | {"n_merged": 1})
    return out


def test_merging_equals_the_plain_fold_with_context(spark):
    rng = random.Random(4)
    rows = []
    for s in range(40):
        t = 0
        for _ in range(rng.randrange(1, 30)):
            t += rng.choice([0, 5_000, 30_000, 30_001, 100_000])
            end = t + rng.choice([8_000, 24_999, 25_000, 60_000, 90_000])
            strings = lambda k: sorted(rng.sample("abcdef", rng.randrange(k)))
            rows.append({"session_id": f"s{s}", "start_ms": t, "end_ms": end, "label": rng.choice(["x", "x", "x", "y", UNKNOWN]), "event_count": rng.randrange(9),
                         "window_titles": strings(3), "urls": strings(3), "apps_seen": strings(4), "extracted_texts": strings(3)[::-1] * 2, "anchor_texts": rng.choice([[], ["a"], ["b", "a"], ["c"]])})
            t = end
    schema = "session_id string, start_ms long, end_ms long, label string, event_count long, " + ", ".join(f"{c} array<string>" for c in ("window_titles", "urls", "apps_seen", "extracted_texts", "anchor_texts"))
    out = segment.merged_segments(spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(7))
    sessions = {r["session_id"]: [x for x in rows if x["session_id"] == r["session_id"]] for r in rows}
    want = [m for parts in sessions.values() for m in plain_merge(parts, segment.Rules())]
    key = lambda x: (x["session_id"], x["start_ms"], x["end_ms"])
    assert sorted((r.asDict() for r in out.collect()), key=key) == sorted(want, key=key) and any(m["n_merged"] > 2 for m in want)


def test_no_python_in_merging_peaks_and_windows(spark):
    events = spark.createDataFrame([("s", 1, 1, 0.5)], "session_id string, timestamp_ms long, seq long, p double")
    found = segment.peaks(events, 0.1, 10)
    parts = spark.createDataFrame([("s", 1, 2, "x", 1)], "session_id string, start_ms long, end_ms long, label string, event_count long")
    for df in (found, segment.candidate_windows(events, found, 10), segment.merged_segments(parts)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def plain_peaks(rows, gap):
    out = []
    for t, p in rows:
        if out and t - out[-1][0] < gap:
            if p > out[-1][1]:
                out[-1] = (t, p)
        else:
            out.append((t, p))
    return out


def plain_windows(first, last, peaks, gap):
    cuts = [first]
    cuts += [t for t in peaks if t - cuts[-1] >= gap and not cuts.append(t)] and []
    if last - cuts[-1] >= gap or len(cuts) == 1:
        cuts.append(last)
    else:
        cuts[-1] = last
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b - a >= gap]


def test_peaks_and_windows_equal_plain_folds(spark):
    rng = random.Random(8)
    sessions = {f"s{i}": [(t, rng.choice([0.1, 0.6, 0.7, 0.9])) for t in sorted(rng.sample(range(400), rng.randrange(1, 60)))] for i in range(40)}
    frame = spark.createDataFrame([(s, t, i, p) for s, rows in sessions.items() for i, (t, p) in enumerate(rows)], "session_id string, timestamp_ms long, seq long, p double").repartition(6)
    found = segment.peaks(frame, 0.5, 12)
    want = {(s, *x) for s, rows in sessions.items() for x in plain_peaks([r for r in rows if r[1] >= 0.5], 12)}
    assert {tuple(r) for r in found.collect()} == want
    for gap in (5, 12, 30):
        got = {tuple(r) for r in segment.candidate_windows(frame, found, gap).select("session_id", "start_ms", "end_ms").collect()}
        peaks = lambda s: sorted(t for n, t, _ in want if n == s)
        assert got == {(s, *w) for s, rows in sessions.items() for w in plain_windows(rows[0][0], rows[-1][0], peaks(s), gap)}


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaab"), i, rng.choice([None, rng.randrange(100)])) for i in range(3000)]
    placed = scan.dealt(spark.createDataFrame(rows, "k string, at long, v long"), "k", "at")
    assert placed.select("_part").distinct().count() > 3
    v = F.col("v")
    out = scan.running(placed, "k", last={"last": v}, total={"sum": v, "n": F.lit(1)}, most={"top": v}, following={"next": v})
    got = {(r.k, r.at): (r.last, r.sum, r.n, r.top, r.next) for r in out.collect()}
    for key in "ab":
        own = [(at, x) for k, at, x in rows if k == key]
        for i, (at, _) in enumerate(own):
            before, after = [x for _, x in own[:i] if x is not None], [x for _, x in own[i + 1 :] if x is not None]
            assert got[key, at] == (before[-1] if before else None, sum(before), i, max(before, default=None), after[0] if after else None)


YEARS = 50 * 365 * 86_400_000


def spans_and_points(rng):
    lengths = [0, 1, 2, 999, 60_000, 3_600_000, 10**9, YEARS]
    spans = [(rng.choice("ab"), s, s + rng.choice(lengths)) for s in (rng.choice([0, 10**6, 10**12]) + rng.randrange(10**6) for _ in range(80))]
    spans += [("a", 0, YEARS), ("a", 5, 5), ("b", -10, 10), ("b", 7, 6)]
    points = [(rng.choice("abc"), rng.choice([0, 5, 10**6, 10**12]) + rng.randrange(10**6)) for _ in range(300)] + [("a", 5), ("b", -10), ("a", YEARS)]
    return spans, points


@pytest.mark.parametrize("least", [1, 1000, 600_000, 10**13])
def test_points_meet_spans_of_any_length(spark, least):
    spans, points = spans_and_points(random.Random(least))
    left = spark.createDataFrame([(*s, i) for i, s in enumerate(spans)], "session_id string, start_ms long, end_ms long, i long")
    right = spark.createDataFrame([(*p, j) for j, p in enumerate(points)], "session_id string, timestamp_ms long, j long")
    found = intervals.points_in_intervals(left, right, least)
    want = sorted((i, j) for i, (s, a, b) in enumerate(spans) for j, (p, t) in enumerate(points) if s == p and a <= t <= b)
    assert sorted((r.i, r.j) for r in found.collect()) == want
    assert "sequence" not in found._jdf.queryExecution().toString()
    both = intervals.points_in_intervals(left, right, least, "left")
    assert sorted((r.i, r.j) for r in both.where("j is not null").collect()) == want and both.select("i").distinct().count() == len(spans)


def test_spans_overlap_at_any_length(spark):
    rng = random.Random(9)
    one, two = spans_and_points(rng)[0], spans_and_points(rng)[0]
    a = spark.createDataFrame([(*s, i) for i, s in enumerate(one)], "session_id string, start_ms long, end_ms long, i long")
    b = spark.createDataFrame([(*s, j) for j, s in enumerate(two)], "other_session string, other_start long, other_end long, j long")
    want = sorted((i, j) for i, (s, x, y) in enumerate(one) for j, (p, u, v) in enumerate(two) if s == p and x < v and u < y and x < y and u < v)
    for least in (1, 600_000):
        assert sorted((r.i, r.j) for r in intervals.overlapping(a, b, least).collect()) == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_times_are_utc_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # The second and third are hours that New York skips or has twice.
        cases = [(0, "1970-01-01T00:00:00Z"), (1_772_953_200_999, "2026-03-08T07:00:00Z"), (1_772_937_000_000, "2026-03-08T02:30:00Z"), (1_793_509_200_000, "2026-11-01T05:00:00Z"), (-1, "1969-12-31T23:59:59Z")]
        df = spark.createDataFrame(cases, "ms long, iso string")
        for r in df.select("ms", "iso", C.ms_to_iso(F.col("ms")).alias("to"), C.iso_to_ms(F.col("iso")).alias("back")).collect():
            assert r.to == r.iso and r.back == r.ms // 1000 * 1000
        texts = [("2026-03-08T02:30:00", 1_772_937_000_000), ("2026-03-08", 1_772_928_000_000), ("2026-03-08T02:30:00.1239+00:00", 1_772_937_000_123), ("2026-03-08T11:30:00+09:00", 1_772_937_000_000), (None, None)]
        got = spark.createDataFrame(texts, "iso string, ms long").select("ms", C.iso_to_ms(F.col("iso")).alias("got")).collect()
        assert all(r.ms == r.got for r in got)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_contexts_without_joins_equal_those_by_join(spark):
    rng = random.Random(8)
    rows = [e for i in range(8) for e in random_session(rng, f"ses_{i}", 150, 0.1)]
    rows.append((None, 5, 1, "app_switch", "Notepad", "x", "x", "", None))
    events = spark.createDataFrame(rows, EVENT).repartition(5)
    spoken = events.withColumn("texts", F.when(F.col("seq") % 3 > 0, F.array(F.col("seq").cast("string"), F.lit("t"))).otherwise(F.array().cast("array<string>")))
    key = lambda r: repr(sorted(r.asDict().items()))
    same = lambda one, two: sorted(map(key, one.collect())) == sorted(map(key, two.collect()))
    for e in (events, spoken):
        assert same(segment.idle_context(e, 60_000), segment.with_context(segment.idle_segments(e, 60_000), e))
        assert same(segment.rule_context(e, most_texts=3), segment.with_context(segment.rule_segments(e), e, most_texts=3))


def test_contexts_are_made_once(spark):
    """A context joins no events with segments, and what reads it does not make it anew."""
    events = spark.createDataFrame(random_session(random.Random(3), "s", 300, 0.1), EVENT)
    for made in (segment.idle_context(events, 60_000), segment.rule_context(events)):
        plan = made._jdf.queryExecution().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "parquet" in plan

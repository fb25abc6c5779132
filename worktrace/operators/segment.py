"""Segments: runs of a session's events that belong to one piece of work."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrace.functions.columns import hub_url_v1, is_browser, portal, WORK_APPS
from worktrace.operators.intervals import points_in_intervals
from worktrace.operators.label import UNKNOWN, predict_label
from worktrace.operators.scan import dealt, running
from worktrace.sources.storage import stored

ORDER = ("timestamp_ms", "seq")
LEAST_MS = 8_000  # nothing shorter is ever given out, whatever the rules say


def idle_segments(events: DataFrame, idle_ms: int) -> DataFrame:
    """session_id, seg_no (from 1), start_ms, end_ms and event_count: a gap of ``idle_ms`` or more ends a segment."""
    return _idle_numbers(events.select("session_id", *ORDER), idle_ms).groupBy("session_id", "seg_no").agg(*_extent())


def _idle_numbers(events: DataFrame, idle_ms: int) -> DataFrame:
    """``events`` with seg_no, the number of their idle segment."""
    rows = running(dealt(events, "session_id", *ORDER), "session_id", last={"_last": F.col("timestamp_ms")})
    new = F.when(F.col("timestamp_ms") - F.col("_last") >= idle_ms, 1).otherwise(0)
    numbered = running(rows.withColumn("_new", new), "session_id", total={"_before": F.col("_new")})
    return numbered.select(*events.columns, (F.col("_before") + F.col("_new") + 1).cast("long").alias("seg_no"))


def _extent() -> list[Column]:
    return [F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.count("*").alias("event_count")]


def by_session(df: DataFrame, fold: Callable[[Iterator[dict]], Iterator[tuple]], schema: str, *order: str) -> DataFrame:
    """Runs ``fold`` over each session's rows in order, as a stream: no session is held in memory whole.

    ``fold`` gets an iterator of rows (dicts) of one session and yields tuples without the session's id.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames):
        def rows():
            for frame in frames:
                yield from frame.to_dict("records")

        stream, ahead = rows(), None
        ahead = next(stream, None)
        buffer: list[tuple] = []
        while ahead is not None:
            session = ahead["session_id"]

            def own():
                nonlocal ahead
                while ahead is not None and ahead["session_id"] == session:
                    row = ahead
                    ahead = next(stream, None)
                    yield row

            for out in fold(own()):
                buffer.append((session, *out))
                if len(buffer) >= 10_000:
                    yield pd.DataFrame(buffer, columns=names)
                    buffer = []
        yield pd.DataFrame(buffer, columns=names)

    return df.repartition("session_id").sortWithinPartitions("session_id", *order).mapInPandas(run, schema)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the rule engine, in milliseconds.

    A segment shorter than ``min_ms`` (``LEAST_MS`` at least) waits and joins the next short one. Segments are ranges of events because a
    return to the start page, or a new anchor, only ends what is long enough to stand: both limits must reach that least length.
    """

    idle_ms: int = 60_000
    min_ms: int = 8_000
    hub_ms: int = 12_000
    anchor_ms: int = 20_000
    merge_gap_ms: int = 30_000
    merge_start_ms: int = 75_000
    merge_short_ms: int = 25_000

    def __post_init__(self) -> None:
        if self.least_ms > min(self.hub_ms, self.anchor_ms):
            raise ValueError("min_ms must not exceed hub_ms or anchor_ms")

    @property
    def least_ms(self) -> int:
        return max(self.min_ms, LEAST_MS)


def signals(events: DataFrame, more: Iterable[Column] = ()) -> DataFrame:
    """What the rules look at: session_id, timestamp_ms, seq, work, home, switched, shown, title_portal, anchor; and ``more``.

    ``home``: a switch to, or in a browser a visit of, a portal's start page (a visit counts by the address in its own payload, ``nav_url``
    where events have it). ``switched``: the portal that a switch to a browser shows. ``shown``: the portal of any browser event.
    """
    kind, browser, system = F.col("event_type"), is_browser(F.col("app_name")), portal(F.col("window_title"))
    visited = F.col("nav_url" if "nav_url" in events.columns else "url")
    switch = (kind == "app_switch") & browser
    home = F.when(switch, hub_url_v1(F.col("url"))).when(kind == "browser_navigation", hub_url_v1(visited)).otherwise(F.lit(False))
    return events.select(
        "session_id", "timestamp_ms", "seq", F.coalesce(F.col("app_name").isin(*WORK_APPS), F.lit(False)).alias("work"), home.alias("home"),
        F.when(switch, system).alias("switched"), F.when(browser, system).alias("shown"), system.alias("title_portal"), F.col("anchor").alias("anchor"), *more,
    )


def next_cut(start: tuple, rows: Iterable[tuple], r: Rules) -> tuple | None:
    """The first of ``rows`` that ends the segment that begins with ``start``."""
    pos, begins, own = start[0], start[1], start[-1]
    for row in rows:
        _, _, last, home, switched, changed, work, shown_pos, shown, _ = row
        current = shown if shown_pos is not None and shown_pos >= pos else own
        moved = switched is not None and current is not None and switched != current
        worked, lasted = work is not None and work >= pos, last - begins
        if moved or (worked and ((home and lasted >= r.hub_ms) or (changed and lasted >= r.anchor_ms))):
            return row
    return None


def _cuts(marks: DataFrame, r: Rules) -> DataFrame:
    """session_id and _pos of the events that segments begin with; ``marks`` has the events of each island that can be such.

    An island begins with an event that ends a segment whatever came before. Only the segment at hand is kept of it.
    """
    names = ["_pos", "timestamp_ms", "last_ms", "home", "switched", "changed", "work_pos", "shown_pos", "last_shown", "title_portal"]

    def run(batches):
        island = start = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 2 + len(names))))
            out = []
            for key, row in zip(keys, rows):
                if key != island or next_cut(start, [row], r):
                    island, start = key, row
                    out.append((key[0], row[0]))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), pa.array([p for _, p in out], pa.int64())], names=["session_id", "_pos"])

    ordered = marks.repartition("session_id", "island").sortWithinPartitions("session_id", "island", "_pos")
    return ordered.select("session_id", "island", *names).mapInArrow(run, "session_id string, _pos long")


def _marks(events: DataFrame, r: Rules, context: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """All events with their places and ``context``, and those that can begin a segment with the island that they belong to, their
    number and, with a context, ``said``, the number of earlier events of the session with texts."""
    # Written before they are dealt, as dealing looks at its rows twice.
    places = dealt(stored(signals(events, context or ()), "signals"), "session_id", *ORDER)
    lean = places.select(*signals(events).columns, "_part", "_pos", *([_speaks().alias("speaks")] if context else []))
    seen = lambda c: F.when(c, F.col("_pos"))
    maybe = F.col("home") | F.col("switched").isNotNull() | F.col("anchor").isNotNull()
    shown = F.when(F.col("shown").isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col("timestamp_ms").alias("ms"), F.col("shown").alias("portal")))
    rows = running(
        lean, "session_id", total={"no": F.lit(1)} | ({"said": F.col("speaks")} if context else {}),
        last={"last_ms": F.col("timestamp_ms"), "work_pos": seen(F.col("work")), "last_show": shown, "last_anchor": F.col("anchor"), "maybe_pos": seen(maybe)},
    )
    show = F.col("last_show")
    idle = F.col("last_ms").isNull() | (F.col("timestamp_ms") - F.col("last_ms") >= r.idle_ms)
    # No segment can have begun since the browser showed another portal: the switch ends the one at hand in any case.
    certain = (F.col("switched") != show["portal"]) & (F.coalesce("maybe_pos", F.lit(-1)) <= show["pos"]) & (F.col("timestamp_ms") - show["ms"] < r.idle_ms)
    changed = F.col("anchor").isNotNull() & F.col("last_anchor").isNotNull() & (F.col("anchor") != F.col("last_anchor"))
    rows = rows.select(
        "*", F.coalesce(idle | certain, F.lit(False)).alias("ends"), F.coalesce(changed, F.lit(False)).alias("changed"), show["pos"].alias("shown_pos"), show["portal"].alias("last_shown")
    ).drop("last_show")
    marks = stored(rows.where(F.col("ends") | F.col("home") | F.col("switched").isNotNull() | F.col("changed")), "marks")
    marks = running(marks, "session_id", last={"before": seen(F.col("ends"))})
    return places, marks.withColumn("island", F.when(F.col("ends"), F.col("_pos")).otherwise(F.col("before")))


def rule_segments(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """session_id, start_ms, end_ms, first_no, last_no (from 0) and event_count of the segments that the rules find.

    A segment ends before an event that follows a long gap, a change to another portal, a return to the start page after work
    elsewhere, or a new clipboard anchor after such work. What is too short waits and joins the next short one; it is given out before
    the next long one if it lasts ``LEAST_MS``, and at the end of the session if it is long enough by the rules.

    Where segments are cut does not depend on what waits. So events that end a segment in any case split a session into islands, which
    are folded apart; numbers, times and what waits are running values. Ties of (timestamp_ms, seq) are in any order.
    """
    return _ruled(*_marks(events, rules), rules).drop("head")


def _ruled(places: DataFrame, marks: DataFrame, rules: Rules) -> DataFrame:
    """Segments as ``rule_segments`` gives them, with ``head``: pos, part and, where marks have it, said of the event that each begins with."""
    cuts = _cuts(marks, rules).withColumnRenamed("_pos", "_cut").withColumnRenamed("session_id", "_session")
    begun = marks.join(cuts, (F.col("session_id") == F.col("_session")) & (F.col("_pos") == F.col("_cut")))
    ends = places.groupBy("session_id").agg(F.max("timestamp_ms").alias("_last"), F.count("*").alias("_n")).withColumnRenamed("session_id", "_session")
    head = F.struct(F.col("_pos").alias("pos"), F.col("_part").alias("part"), *(["said"] if "said" in marks.columns else []))
    runs = dealt(begun.select("session_id", "timestamp_ms", "no", F.col("last_ms").alias("gone_ms"), head.alias("head")), "session_id", "no")
    runs = running(runs, "session_id", following={"end_no": F.col("no"), "end_ms": F.col("gone_ms")})
    runs = runs.join(ends, F.col("session_id") == F.col("_session"))
    runs = runs.select("session_id", "_part", "_pos", F.col("timestamp_ms").alias("start_ms"), F.coalesce("end_ms", "_last").alias("end_ms"), F.col("no").alias("first_no"), (F.coalesce("end_no", "_n") - 1).alias("last_no"), "head")
    long = F.col("end_ms") - F.col("start_ms") >= rules.least_ms
    stands = F.when(long, F.lit(1))
    runs = running(stored(runs, "runs"), "session_id", total={"group": F.when(long, 1).otherwise(0)}, following={"more": stands})
    lasted = F.col("end_ms") - F.col("start_ms")
    shorts = runs.where(~long).groupBy("session_id", "group").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "last_no").alias("end_ms"), F.min("first_no").alias("first_no"), F.max("last_no").alias("last_no"), F.max("more").alias("more"), F.min("head").alias("head")
    )
    shorts = shorts.where(lasted >= F.when(F.col("more").isNotNull(), LEAST_MS).otherwise(rules.least_ms))
    columns = ["session_id", "start_ms", "end_ms", "first_no", "last_no", "head"]
    out = runs.where(long).select(*columns).unionAll(shorts.select(*columns))
    return out.withColumn("event_count", F.col("last_no") - F.col("first_no") + 1)


def _by_number(segments: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs of a segment and its events by their numbers: an event of two segments' common time is in one only."""
    numbered = running(dealt(events, "session_id", *ORDER), "session_id", total={"_no": F.lit(1)}).drop("_part", "_pos")
    spans = segments.select("session_id", F.struct("start_ms", "end_ms", "event_count").alias("seg"), F.col("first_no").alias("start_ms"), F.col("last_no").alias("end_ms"))
    points = numbered.withColumn("_at", F.col("timestamp_ms")).withColumn("timestamp_ms", F.col("_no")).drop("_no")
    found = points_in_intervals(spans, points, 1024)
    return found.drop("start_ms", "end_ms", "timestamp_ms").withColumnRenamed("_at", "timestamp_ms").select("*", "seg.*").drop("seg")


def _strings(column: str | Column) -> Column:
    """The distinct strings of a group but '', in order."""
    return F.sort_array(F.collect_set(F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(""))))


def _speaks() -> Column:
    return F.when(F.size("_texts") > 0, 1).otherwise(0)


def _context_columns(events: DataFrame) -> list[Column]:
    """What contexts are made of; ``_texts`` only where the events have texts."""
    columns = [F.col(c) for c in ("window_title", "url", "app_name")] + [F.col("anchor").alias("_anchor")]
    parts = [F.col("texts")] if "texts" in events.columns else []
    parts += [F.array_compact(F.array(F.nullif("form_text", F.lit(""))))] if "form_text" in events.columns else []
    return [*columns, F.concat(*parts).alias("_texts")] if parts else columns


def _gathered() -> list[Column]:
    """The context of a group of events but for its texts."""
    place, system = F.struct("timestamp_ms", "seq"), portal(F.col("window_title"))
    anchors = F.sort_array(F.collect_list(F.when(F.col("_anchor").isNotNull(), F.struct("timestamp_ms", "seq", "_anchor"))))
    return [
        _strings("window_title").alias("window_titles"), _strings("url").alias("urls"), _strings("app_name").alias("apps_seen"),
        F.transform(anchors, lambda a: a["_anchor"]).alias("anchor_texts"), F.min_by(system, F.when(system.isNotNull(), place)).alias("portal_system"),
    ]


def _first_texts(order: str, wanted: Column, most_texts: int) -> Column:
    listed = F.sort_array(F.collect_list(F.when(wanted, F.struct(order, "_texts"))))
    return F.slice(F.flatten(F.transform(listed, lambda x: x["_texts"])), 1, most_texts).alias("extracted_texts")


def _named(out: DataFrame) -> DataFrame:
    return out.withColumn("label", predict_label(F.array_join(F.concat("window_titles", "extracted_texts"), " "), F.array_join("urls", " ")))


def _context(found: DataFrame, own: list[str], most_texts: int, *more: Column) -> DataFrame:
    """The context of each group by ``own`` of events (with ``_context_columns``), ``more`` and a label."""
    out, none = found.groupBy(*own).agg(*more, *_gathered()), F.array().cast("array<string>")
    if "_texts" not in found.columns:
        return _named(out.withColumn("extracted_texts", none))
    # Every such event has a text: as many events as texts are enough.
    first = F.row_number().over(Window.partitionBy(*own).orderBy("timestamp_ms", "seq"))
    spoken = found.where(F.size("_texts") > 0).withColumn("_n", first).where(F.col("_n") <= most_texts)
    texts = spoken.groupBy(*own).agg(_first_texts("_n", F.lit(True), most_texts))
    return _named(out.join(texts, own, "left").withColumn("extracted_texts", F.coalesce("extracted_texts", none)))


def with_context(segments: DataFrame, events: DataFrame, bucket_ms: int = 600_000, most_texts: int = 10) -> DataFrame:
    """``segments`` with window_titles, urls and apps_seen (sorted), anchor_texts and the first extracted_texts of their events (in
    order), portal_system (that of the first title with one) and a label from them.

    Events are found by first_no and last_no where the segments have them, else by time. Texts are those of the columns ``texts``
    and ``form_text``, where the events have them. ``idle_context`` and ``rule_context`` give the same for their segments without a join.
    """
    at = events.select("session_id", *ORDER, *_context_columns(events))
    if {"first_no", "last_no"} <= set(segments.columns):
        found = _by_number(segments, at)
    else:
        found = points_in_intervals(segments.select("session_id", "start_ms", "end_ms", "event_count"), at, bucket_ms)
    return _context(found, ["session_id", "start_ms", "end_ms", "event_count"], most_texts)


def idle_context(events: DataFrame, idle_ms: int, most_texts: int = 10) -> DataFrame:
    """``with_context`` of ``idle_segments``: events are dealt once and gathered by the number of their segment.

    Written once, since labels cost most. An event without a session or time is in no segment's context.
    """
    if idle_ms <= 0:  # events of one time can then be in several segments
        return with_context(idle_segments(events, idle_ms), events, most_texts=most_texts)
    numbered = _idle_numbers(events.select("session_id", *ORDER, *_context_columns(events)), idle_ms).where("session_id is not null")
    timed = F.col("timestamp_ms").isNotNull()
    found = numbered.select("session_id", *ORDER, "seg_no", *[F.when(timed, F.col(c)).alias(c) for c in numbered.columns if c not in ("session_id", *ORDER, "seg_no")])
    out = _context(found, ["session_id", "seg_no"], most_texts, *_extent()).where("start_ms is not null").drop("seg_no")
    return stored(out, "idle-context")


def rule_context(events: DataFrame, rules: Rules = Rules(), most_texts: int = 10) -> DataFrame:
    """``with_context`` of ``rule_segments``: events are dealt once, for the rules and for the context.

    Segments of the rules are apart, so that an event is in the one that begins last before it, or in none: beginnings are rows between
    the events, and what they hold runs on. The number of texts said before a segment tells which of its events have its first ones.
    Written once, since labels cost most.
    """
    context = _context_columns(events)
    if not {"texts", "form_text"} & set(events.columns):
        context.append(F.array().cast("array<string>").alias("_texts"))
    places, marks = _marks(events, rules, context)
    segments = stored(_ruled(places, marks, rules), "rule-segments")
    seg = F.struct("start_ms", "end_ms", "event_count", "last_no", F.col("head.said").alias("said"))
    begun = segments.select("session_id", F.col("head.part").alias("_part"), (2 * F.col("head.pos")).alias("_pos"), seg.alias("_begun"))
    names = ["window_title", "url", "app_name", "_anchor", "_texts"]
    at = places.select("session_id", "_part", (2 * F.col("_pos") + 1).alias("_pos"), *ORDER, *names)
    both = at.unionByName(begun, allowMissingColumns=True)
    event = F.col("_begun").isNull()
    both = running(both, "session_id", last={"_own": F.col("_begun")}, total={"_no": F.when(event, 1).otherwise(0), "_said": F.when(event, _speaks()).otherwise(0)})
    found = both.where(event & (F.col("_no") <= F.col("_own.last_no"))).select("*", "_own.start_ms", "_own.end_ms", "_own.event_count", "_own.last_no")
    wanted = (F.size("_texts") > 0) & (F.col("_said") - F.col("_own.said") < most_texts)
    own = ["session_id", "start_ms", "end_ms", "event_count", "last_no"]
    out = found.groupBy(*own).agg(*_gathered(), _first_texts("_pos", wanted, most_texts)).drop("last_no")
    return stored(_named(out), "rule-context")


def islands(df: DataFrame, starts: Column, *order: str, last: dict[str, Column], most: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``island``: the place of the row that its island begins with.

    ``starts`` is true for such rows; it may use the names of ``last`` and ``most``: earlier rows' last and greatest values.
    """
    return _islands(dealt(df, "session_id", *order), starts, last, most)


def _islands(placed: DataFrame, starts: Column, last: dict[str, Column], most: dict[str, Column] | None) -> DataFrame:
    placed = running(placed, "session_id", last=last, most=most)
    placed = stored(placed.withColumn("_starts", F.coalesce(starts, F.lit(False))), "islands")
    placed = running(placed, "session_id", last={"_begun": F.when(F.col("_starts"), F.col("_pos"))})
    return placed.withColumn("island", F.when(F.col("_starts"), F.col("_pos")).otherwise(F.col("_begun"))).drop("_starts", "_begun")


def _folded(df: DataFrame, row: Column, first: Callable[[Column], Column], step: Callable[[Column, Column], Column], *keep: Column) -> DataFrame:
    """session_id, island and ``state`` after all rows of an island in order; ``row`` is a struct of _pos and what the fold needs."""
    rows = df.groupBy("session_id", "island").agg(F.array_sort(F.collect_list(row)).alias("rows"), *keep)
    begin = first(F.get("rows", F.lit(0)))
    return rows.withColumn("state", F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), begin, step))


def merged_segments(segments: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Neighbours of one label become one segment, with their context, where the gap, their anchors and their lengths allow it.

    session_id, start_ms, end_ms, label, event_count, n_merged and, of those columns of ``segments`` that there are, window_titles,
    urls, apps_seen (distinct and sorted), extracted_texts and anchor_texts (one after the other). A gap, another label or the unknown one
    ends an island; within an island, a fold decides which segments join the one before.
    """
    sets = [c for c in ("window_titles", "urls", "apps_seen") if c in segments.columns]
    lists = [c for c in ("extracted_texts", "anchor_texts") if c in segments.columns]
    anchors = F.array_distinct("anchor_texts") if "anchor_texts" in segments.columns else F.array().cast("array<string>")
    lean = segments.select("session_id", "start_ms", "end_ms", "label", "event_count", *sets, *lists)
    apart = F.col("_label").isNull() | F.col("label").isNull() | (F.col("_label") != F.col("label")) | (F.col("label") == UNKNOWN) | (F.col("start_ms") - F.col("_reach") > rules.merge_gap_ms)
    placed = dealt(lean, "session_id", "start_ms", "end_ms", "label")
    # Contexts stay where they are until it is known what joins what.
    bounds = placed.select("session_id", "_part", "_pos", "start_ms", "end_ms", "label", anchors.alias("anchors"))
    rows = _islands(bounds, apart, {"_label": F.col("label")}, {"_reach": F.col("end_ms")})
    row = F.struct("_pos", "_part", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "anchors")
    place = lambda x: F.struct(x["_pos"].alias("pos"), x["_part"].alias("part"))

    def first(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["anchors"].alias("anchors"), F.array(place(x)).alias("heads"))

    def step(state: Column, x: Column) -> Column:
        near = x["start"] - state["end"] <= rules.merge_gap_ms
        differ = (F.size(state["anchors"]) > 0) & (F.size(x["anchors"]) > 0) & ~F.arrays_overlap(state["anchors"], x["anchors"])
        brief = F.least(state["end"] - state["start"], x["end"] - x["start"]) < rules.merge_short_ms
        joins = near & ~differ & ((x["start"] - state["start"] < rules.merge_start_ms) | brief)
        longer = F.struct(
            state["start"].alias("start"), F.greatest(state["end"], x["end"]).alias("end"), F.array_union(state["anchors"], x["anchors"]).alias("anchors"), state["heads"].alias("heads")
        )
        fresh = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["anchors"].alias("anchors"), F.concat(state["heads"], F.array(place(x))).alias("heads"))
        return F.when(joins, longer).otherwise(fresh)

    heads = stored(_folded(rows, row, first, step).select("session_id", F.explode("state.heads").alias("_head")), "heads")
    # Heads are rows of their own, each just before the segment that is one.
    heads = heads.select("session_id", F.col("_head.part").alias("_part"), (2 * F.col("_head.pos")).alias("_pos"), F.col("_head.pos").alias("_head"))
    marked = placed.withColumn("_pos", 2 * F.col("_pos") + 1).unionByName(heads, allowMissingColumns=True)
    marked = running(marked, "session_id", last={"_group": F.col("_head")}).where("_head is null")
    inner = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_pos", F.col(c).alias("v")))), lambda x: x["v"])).alias(c)
    out = marked.groupBy("session_id", "_group").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("label").alias("label"), F.sum("event_count").cast("long").alias("event_count"),
        F.count("*").alias("n_merged"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets], *[inner(c) for c in lists],
    )
    return out.drop("_group")


def peaks(events: DataFrame, threshold: float, gap_ms: int) -> DataFrame:
    """session_id, timestamp_ms and p of peaks at least ``gap_ms`` apart; a higher one within the gap takes the place of the last, and
    the gap starts anew. ``events`` needs session_id, timestamp_ms, seq and the probability p of a boundary.
    """
    likely = events.where(F.col("p") >= threshold).select("session_id", "timestamp_ms", "seq", "p")
    far = F.col("_last").isNull() | (F.col("timestamp_ms") - F.col("_last") >= gap_ms)
    rows = islands(likely, far, *ORDER, last={"_last": F.col("timestamp_ms")})
    peak = lambda x: F.struct(x["t"].alias("timestamp_ms"), x["p"].alias("p"))

    def step(state: Column, x: Column) -> Column:
        top = state["top"]
        new = x["t"] - top["timestamp_ms"] >= gap_ms
        done = F.when(new, F.concat(state["done"], F.array(top))).otherwise(state["done"])
        return F.struct(F.when(new | (x["p"] > top["p"]), peak(x)).otherwise(top).alias("top"), done.alias("done"))

    first = lambda x: F.struct(peak(x).alias("top"), F.array().cast("array<struct<timestamp_ms:bigint,p:double>>").alias("done"))
    folded = _folded(rows, F.struct("_pos", F.col("timestamp_ms").alias("t"), F.col("p").cast("double").alias("p")), first, step)
    return folded.select("session_id", F.explode(F.concat("state.done", F.array("state.top"))).alias("x")).select("session_id", "x.*")


def candidate_windows(events: DataFrame, found: DataFrame, gap_ms: int) -> DataFrame:
    """session_id, start_ms and end_ms of the windows between cuts at least ``gap_ms`` apart: the first event, peaks, the last event.

    What is left after the last cut and is shorter belongs to the window before; a session shorter than that has none.
    """
    ends = events.groupBy("session_id").agg(F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))
    marks = found.select("session_id", "timestamp_ms").unionByName(ends.select("session_id", F.col("first_ms").alias("timestamp_ms")))
    # What comes a gap after the mark before it is a cut whatever that mark is.
    far = F.col("_last").isNull() | (F.col("timestamp_ms") - F.col("_last") >= gap_ms)
    rows = islands(marks, far, "timestamp_ms", last={"_last": F.col("timestamp_ms")})

    def step(cuts: Column, x: Column) -> Column:
        return F.when(x["t"] - F.element_at(cuts, -1) >= gap_ms, F.concat(cuts, F.array(x["t"]))).otherwise(cuts)

    cuts = _folded(rows, F.struct("_pos", F.col("timestamp_ms").alias("t")), lambda x: F.array(x["t"]), step).select("session_id", F.explode("state").alias("start_ms"))
    placed = running(dealt(cuts, "session_id", "start_ms"), "session_id", following={"next_ms": F.col("start_ms")})
    placed = running(placed, "session_id", following={"after_ms": F.col("next_ms")})
    out = placed.join(ends.select(F.col("session_id").alias("_s"), "last_ms"), F.col("session_id") == F.col("_s"))
    # The last cut begins no window if it is near the end; the window before it then reaches to the end.
    rest = lambda c: F.col("last_ms") - F.col(c) >= gap_ms
    end = F.when(F.col("next_ms").isNull(), F.when(rest("start_ms"), F.col("last_ms")))
    end = end.when(F.col("after_ms").isNull() & ~rest("next_ms"), F.col("last_ms")).otherwise(F.col("next_ms"))
    return out.select("session_id", "start_ms", end.alias("end_ms")).where("end_ms is not null")

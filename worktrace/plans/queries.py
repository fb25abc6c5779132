"""The analytics queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace.functions import columns as C
from worktrace.operators import chain, evaluate, features, intervals, label, mining, ml, policy, segment, stats, truth, views, vision
from worktrace.sources.storage import stored, table
from worktrace.sources.telemetry import QUIRK_REASON, TELE_SQL, quirk_policy, tele

HOUR = 3_600_000
IDLE, LONG_IDLE, BUCKET, TOLERANCE = 12 * HOUR, 24 * HOUR, 24 * HOUR, HOUR // 2
#: Thresholds for the sparse ``events`` table, whose users act every few hours.
RULES = segment.Rules(36 * HOUR, HOUR // 2, int(3.3 * HOUR), int(5.5 * HOUR), 18 * HOUR, int(20.8 * HOUR), int(6.9 * HOUR))
PEAK, PEAK_GAP = 0.1, 12 * HOUR

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return tele(spark, sf_dir).where(C.keeps_event(F.col("event_type"), F.lit(False), none, none))


def _idle(spark: SparkSession, sf_dir: str, gap: int = IDLE) -> DataFrame:
    return segment.idle_segments(_clean(spark, sf_dir), gap)


def _labelled(spark: SparkSession, sf_dir: str, gap: int = IDLE) -> DataFrame:
    return segment.idle_context(_clean(spark, sf_dir), gap)


CLEAN_SQL = f"WITH RECURSIVE {TELE_SQL}, clean AS (SELECT * FROM tele WHERE event_type <> 'mouse_scroll')"


def _idle_sql(name: str, gap: int) -> str:
    w = "(PARTITION BY session_id ORDER BY timestamp_ms, seq)"
    return f"""{name}_g AS (SELECT *, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER {w} >= {gap} THEN 1 ELSE 0 END AS new FROM clean),
{name}_n AS (SELECT *, 1 + sum(new) OVER {w} AS seg FROM {name}_g),
{name} AS (SELECT session_id, CAST(seg AS BIGINT) AS seg_no, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS event_count FROM {name}_n GROUP BY 1, 2)"""


def _labelled_sql(name: str, gap: int) -> str:
    return f"""{_idle_sql(name + "_i", gap)},
{name}_c AS (SELECT i.session_id, i.start_ms, i.end_ms, i.event_count, string_agg(DISTINCT window_title, ' ') AS titles, string_agg(DISTINCT url, ' ') AS urls
  FROM {name}_i i JOIN clean e ON e.session_id = i.session_id AND e.timestamp_ms BETWEEN i.start_ms AND i.end_ms GROUP BY ALL),
{name} AS (SELECT session_id, start_ms, end_ms, event_count, {label.predict_label_sql("titles", "urls")} AS label FROM {name}_c)"""


@query(f"""{CLEAN_SQL}, {_labelled_sql("seg", IDLE)},
one AS (SELECT s.session_id, s.label, s.start_ms, s.start_ms // 1000 * 1000 AS a, s.end_ms // 1000 * 1000 AS b, count(*) FILTER (event_type = 'app_switch') AS sw,
  count(*) FILTER (event_type = 'clipboard_change') AS cl, list(DISTINCT app_name) FILTER (app_name <> '') AS apps FROM seg s LEFT JOIN tele e ON e.session_id = s.session_id
  AND e.timestamp_ms BETWEEN s.start_ms // 1000 * 1000 AND s.end_ms // 1000 * 1000 GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT label, count(*) AS n, sum(b - a) / 1000 AS s, sum(sw) AS sw, sum(cl) AS cl, len(list_distinct(flatten(list(coalesce(apps, []))))) AS apps,
  count(DISTINCT session_id) AS ses, count(DISTINCT session_id[-2:]) AS st, min({{'s': session_id, 't': start_ms}}) AS seen FROM one WHERE label <> 'process_unknown' GROUP BY 1),
r AS (SELECT label AS process, n AS volume, round(s / 60, 1) AS total_duration_min, round(s / n, 1) AS avg_duration_s, round(sw / n, 1) AS avg_app_switches,
  round(cl / n, 1) AS avg_clipboard_ops, round((sw + cl) / n, 2) AS friction, CAST(apps AS BIGINT) AS apps_count, ses AS sessions_count, st AS staff_count,
  round(CASE WHEN s > 0 THEN n * ((sw + cl) / n) / (s / n) ELSE 0.0 END, 2) AS roi_score, seen FROM m)
SELECT * EXCLUDE (seen), row_number() OVER (ORDER BY roi_score DESC, seen) AS rank FROM r""")
def roi_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.roi_ranking(_labelled(spark, sf_dir), tele(spark, sf_dir), BUCKET)


@query(f"{CLEAN_SQL} SELECT session_id, timestamp_ms, seq, event_type FROM clean")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).select("session_id", "timestamp_ms", "seq", "event_type")


@query(f"""{CLEAN_SQL} SELECT session_id, seq, event_type, event_type = 'dialog_opened' AS _is_unreliable,
CASE WHEN event_type = 'dialog_opened' THEN '{QUIRK_REASON}' END AS _quirk_reason, event_type = 'dialog_opened' AS is_buggy_recording FROM tele""")
def quirk_policy_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quirk_policy(tele(spark, sf_dir).select("session_id", "seq", "event_type"), "flag", "dialog_opened")


_TOKENS = "CASE " + " ".join(f"WHEN contains(url, '{k}') THEN '{v}'" for k, v in C.PORT_TOKENS.items()) + " END"
_HUB_3 = " OR ".join(f"ends_with(c, '{e}')" for e in C.HUB_ENDINGS)


@query(f"""{CLEAN_SQL}, u AS (SELECT url FROM tele UNION ALL SELECT url FROM pages),
v AS (SELECT url, rtrim(split_part(url, '?', 1), '/') AS c FROM u WHERE url IS NOT NULL)
SELECT url, regexp_matches(lower(rtrim(url, '/')), '(/dashboard|/index|/index\\.html)$') OR regexp_matches(url, '^https?://[^/]+/?(?:#/?)?$') AS hub_v1, {_HUB_3} AS hub_v3,
CAST(length(url) - length(replace(url, '/', '')) AS BIGINT) AS depth, {_TOKENS} AS port_token,
CASE WHEN contains(url, '#') THEN 'ROUTE_' || replace(list_extract(string_split(url, '#'), -1), '/', '_') END AS route_token, count(*) AS n FROM v GROUP BY ALL""")
def url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    urls = tele(spark, sf_dir).select("url").unionAll(table(spark, sf_dir, "pages").select("url")).where("url is not null")
    return urls.groupBy("url").agg(F.count("*").alias("n")).select(
        "url", C.hub_url_v1(u).alias("hub_v1"), C.hub_url_v3(u).alias("hub_v3"), C.url_depth(u).cast("long").alias("depth"),
        C.port_token(u).alias("port_token"), C.route_token(u).alias("route_token"), "n",
    )


@query(f"""{CLEAN_SQL} SELECT seq, list_extract(string_split(session_id, '-'), -1) AS machine, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS iso,
timestamp_ms // 1000 * 1000 AS back_ms FROM tele""")
def machine_and_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tele(spark, sf_dir).select("seq", C.machine(F.col("session_id")).alias("machine"), C.ms_to_iso(F.col("timestamp_ms")).alias("iso"))
    return out.withColumn("back_ms", C.iso_to_ms(F.col("iso")))


_W = "(PARTITION BY session_id ORDER BY timestamp_ms, seq)"
_SQL_18 = {
    "dt_prev": f"least(coalesce(timestamp_ms - lag(timestamp_ms) OVER {_W}, 0), 60000)",
    "dt_next": f"least(greatest(coalesce(lead(timestamp_ms) OVER {_W} - timestamp_ms, 0), 0), 60000)",
    "is_app_switch": "event_type = 'app_switch'", "is_clipboard": "event_type = 'clipboard_change'", "is_navigation": "event_type = 'browser_navigation'",
    "is_shortcut": "event_type = 'shortcut'", "is_click": "contains(event_type, 'click')", "clip_len": "length(t)",
    "clip_delta": "CASE WHEN event_type = 'clipboard_change' THEN abs(length(t) - coalesce(last_value(CASE WHEN event_type = 'clipboard_change' THEN length(t) END IGNORE NULLS) "
    f"OVER {_W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) ELSE 0 END",
    "has_id": "regexp_matches(t, '[A-Za-z0-9_-]{4,}')", "is_hub": f"({_HUB_3})", "url_depth": "length(url) - length(replace(url, '/', ''))", "app_category": "cat",
    "app_changed": f"coalesce(lag(cat) OVER {_W} <> cat, false)", "title_len": "length(window_title)", "title_changed": f"coalesce(lag(window_title) OVER {_W} <> window_title, false)",
    "idle_10": f"coalesce(timestamp_ms - lag(timestamp_ms) OVER {_W}, 0) >= 10000", "idle_30": f"coalesce(timestamp_ms - lag(timestamp_ms) OVER {_W}, 0) >= 30000",
}


@query(f"""{CLEAN_SQL}, t AS (SELECT *, coalesce(anchor, '') AS t, rtrim(split_part(url, '?', 1), '/') AS c,
CASE WHEN contains(app_name, 'Chrome') THEN 1 WHEN contains(app_name, 'Excel') THEN 2 WHEN contains(app_name, 'Notepad') THEN 4 ELSE 0 END AS cat FROM tele)
SELECT session_id, timestamp_ms, seq, {", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in _SQL_18.items())} FROM t""")
def features_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tele(spark, sf_dir).withColumn("text_content", F.col("anchor")).withColumn("ms_since", F.lit(None).cast("double"))
    return features.features(events)


_SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query(f"""{CLEAN_SQL}, g AS (SELECT timestamp_ms - lag(timestamp_ms) OVER {_W} AS gap FROM tele), r AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, count(*) OVER () AS n FROM g WHERE gap > 0)
SELECT CAST(n AS BIGINT) AS n, {", ".join(f"CAST(min(gap) FILTER (i = CAST(floor(n * {v}::DOUBLE) AS BIGINT)) AS BIGINT) AS {k}" for k, v in _SHARES.items())} FROM r GROUP BY n""")
def idle_gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.at_rank(stats.idle_gaps(tele(spark, sf_dir)), "gap_ms", _SHARES)


@query(f"""{CLEAN_SQL}, {_labelled_sql("seg", IDLE)}, d AS (SELECT label, end_ms - start_ms AS d FROM seg), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d) - 1 AS i,
count(*) OVER (PARTITION BY label) AS n FROM d) SELECT label, CAST(n AS BIGINT) AS n, min(d) AS min_ms, max(d) AS max_ms, CAST(sum(d) AS DOUBLE) / n AS mean_ms, min(d) FILTER (i = n // 2) AS median_ms FROM r GROUP BY label, n""")
def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir).select("label", (F.col("end_ms") - F.col("start_ms")).alias("d"))
    whole = d.groupBy("label").agg(F.min("d").alias("min_ms"), F.max("d").alias("max_ms"), (F.sum("d").cast("double") / F.count("*")).alias("mean_ms"))
    return stats.at_rank(d, "d", {"median_ms": 0.5}, "label").join(whole, "label")


@query(f"""{CLEAN_SQL} SELECT event_type, app_name, n FROM (SELECT event_type, app_name, count(*) AS n, min({{'s': session_id, 't': timestamp_ms, 'q': seq}}) AS f FROM tele GROUP BY ALL)
ORDER BY n DESC, f LIMIT 5""")
def top_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_counts(tele(spark, sf_dir), 5, ["event_type", "app_name"], "session_id", "timestamp_ms", "seq")


@query("""SELECT conv_id, count(*) FILTER (role = p) AS n_repeats FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY 1""")
def consecutive_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.consecutive_repeats(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query(f"{CLEAN_SQL}, {_idle_sql('idle', IDLE)} SELECT * FROM idle")
def idle_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _idle(spark, sf_dir)


#: The rules as they are told, event by event: the open segment, what waits, the anchor, and the list of what is closed.
_LONG, _LEAST = RULES.least_ms, segment.LEAST_MS
_HUB_1 = "(regexp_matches(lower(rtrim(url, '/')), '(/dashboard|/index|/index\\.html)$') OR regexp_matches(url, '^https?://[^/]+/?(?:#/?)?$'))"
_V1_SQL = f"""ev AS (SELECT session_id, timestamp_ms AS t, row_number() OVER {_W} AS i, event_type, app_name = 'Google Chrome' AS browser, app_name IN ('Microsoft Excel', 'Notepad') AS work,
  window_title AS title, {_HUB_1} AS hub, anchor FROM clean),
v1_r AS (SELECT session_id, i, t AS s, t AS l, i AS f, work AS w, title AS p, CAST(NULL AS STRUCT(s BIGINT, l BIGINT, f BIGINT, n BIGINT)) AS wait, anchor AS a, CAST([] AS STRUCT(s BIGINT, l BIGINT, f BIGINT, n BIGINT)[]) AS done
  FROM ev WHERE i = 1 UNION ALL
SELECT session_id, i, CASE WHEN cut THEN t ELSE s END, t, CASE WHEN cut THEN i ELSE f END, CASE WHEN cut THEN work ELSE w OR work END, CASE WHEN cut OR browser THEN title ELSE p END,
  CASE WHEN NOT cut THEN wait WHEN l - s >= {_LONG} THEN NULL WHEN wait IS NULL THEN {{'s': s, 'l': l, 'f': f, 'n': i - 1}} ELSE {{'s': wait.s, 'l': l, 'f': wait.f, 'n': i - 1}} END, coalesce(anchor, a),
  CASE WHEN cut AND l - s >= {_LONG} THEN list_concat(done, CASE WHEN wait.l - wait.s >= {_LEAST} THEN [wait] ELSE [] END, [{{'s': s, 'l': l, 'f': f, 'n': i - 1}}]) ELSE done END
  FROM (SELECT r.* EXCLUDE (i), e.* EXCLUDE (session_id), coalesce(t - l >= {RULES.idle_ms} OR (event_type = 'app_switch' AND browser AND title <> p)
    OR ((event_type = 'browser_navigation' OR (event_type = 'app_switch' AND browser)) AND hub AND w AND l - s >= {RULES.hub_ms})
    OR (anchor IS NOT NULL AND anchor <> a AND w AND l - s >= {RULES.anchor_ms}), false) AS cut
    FROM v1_r r JOIN ev e ON e.session_id = r.session_id AND e.i = r.i + 1)),
v1_e AS (SELECT *, l - s >= {_LONG} AS long FROM v1_r WHERE i = (SELECT max(i) FROM ev WHERE ev.session_id = v1_r.session_id)),
v1_l AS (SELECT session_id, unnest(list_concat(done, CASE WHEN long AND wait.l - wait.s >= {_LEAST} THEN [wait] WHEN NOT long AND l - wait.s >= {_LONG} THEN [{{'s': wait.s, 'l': l, 'f': wait.f, 'n': i}}] ELSE [] END,
  CASE WHEN long THEN [{{'s': s, 'l': l, 'f': f, 'n': i}}] ELSE [] END)) AS x FROM v1_e),
v1 AS (SELECT session_id, x.s AS start_ms, x.l AS end_ms, x.f - 1 AS first_no, x.n - 1 AS last_no, x.n - x.f + 1 AS event_count FROM v1_l)"""


@query(f"{CLEAN_SQL}, {_V1_SQL} SELECT * FROM v1")
def v1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.rule_segments(_clean(spark, sf_dir), RULES)


_SORTED = "list_sort(list_distinct(list({})))"
#: Parts are taken in order; the last merged segment is the state, and what it can no longer take goes to the list.
_MERGED_SQL = f"""{_V1_SQL}, ctx AS (SELECT v.session_id, v.start_ms, v.end_ms, v.event_count, v.first_no, {_SORTED.format("title")} AS window_titles, {_SORTED.format("url")} AS urls,
  {_SORTED.format("app_name")} AS apps_seen, coalesce(list(anchor ORDER BY timestamp_ms, seq) FILTER (anchor IS NOT NULL), []) AS anchor_texts FROM v1 v
  JOIN (SELECT *, window_title AS title, row_number() OVER {_W} - 1 AS no FROM clean) e ON e.session_id = v.session_id AND e.no BETWEEN v.first_no AND v.last_no GROUP BY ALL),
part AS (SELECT *, {label.predict_label_sql("array_to_string(window_titles, ' ')", "array_to_string(urls, ' ')")} AS label, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, end_ms) AS i FROM ctx),
m_r AS (SELECT session_id, i, start_ms AS s, end_ms AS l, label, event_count AS n, window_titles AS tt, urls AS uu, apps_seen AS pp, anchor_texts AS aa, 1 AS parts, i AS head FROM part WHERE i = 1 UNION ALL
SELECT session_id, i, CASE WHEN fit THEN s ELSE start_ms END, CASE WHEN fit THEN greatest(l, end_ms) ELSE end_ms END, label, CASE WHEN fit THEN n + event_count ELSE event_count END,
  CASE WHEN fit THEN list_sort(list_distinct(list_concat(tt, window_titles))) ELSE window_titles END, CASE WHEN fit THEN list_sort(list_distinct(list_concat(uu, urls))) ELSE urls END,
  CASE WHEN fit THEN list_sort(list_distinct(list_concat(pp, apps_seen))) ELSE apps_seen END, CASE WHEN fit THEN list_concat(aa, anchor_texts) ELSE anchor_texts END, CASE WHEN fit THEN parts + 1 ELSE 1 END, CASE WHEN fit THEN head ELSE i END
  FROM (SELECT r.* EXCLUDE (session_id, i, label), p.*, r.label = p.label AND p.label <> 'process_unknown' AND start_ms - l <= {RULES.merge_gap_ms} AND NOT (len(aa) > 0 AND len(anchor_texts) > 0 AND NOT list_has_any(aa, anchor_texts))
    AND (start_ms - s < {RULES.merge_start_ms} OR l - s < {RULES.merge_short_ms} OR end_ms - start_ms < {RULES.merge_short_ms}) AS fit FROM m_r r JOIN part p ON p.session_id = r.session_id AND p.i = r.i + 1)),
merged AS (SELECT session_id, arg_max(s, i) AS start_ms, arg_max(l, i) AS end_ms, arg_max(label, i) AS label, CAST(arg_max(n, i) AS BIGINT) AS event_count, CAST(arg_max(parts, i) AS BIGINT) AS n_merged, arg_max(tt, i) AS window_titles,
  arg_max(uu, i) AS urls, arg_max(pp, i) AS apps_seen, arg_max(aa, i) AS anchor_texts FROM m_r GROUP BY session_id, head)"""
#: Texts of the ``events`` table's own fields, as a reader of pages would have them; some have none, some two.
_TEXTS_SQL = "CASE WHEN k % 4 = 0 THEN [] WHEN k % 4 = 1 THEN ['k' || k] ELSE ['k' || k, event_type] END"


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.concat(F.lit("k"), F.col("k").cast("string"))
    none = F.array().cast("array<string>")
    return _clean(spark, sf_dir).withColumn("texts", F.when(F.col("k") % 4 == 0, none).when(F.col("k") % 4 == 1, F.array(k)).otherwise(F.array(k, "event_type")))


@query(f"""{CLEAN_SQL}, {_MERGED_SQL}, said AS (SELECT v.session_id, v.start_ms, flatten(list({_TEXTS_SQL} ORDER BY timestamp_ms, seq))[:10] AS texts FROM v1 v
  JOIN (SELECT *, row_number() OVER {_W} - 1 AS no FROM clean) e ON e.session_id = v.session_id AND e.no BETWEEN v.first_no AND v.last_no GROUP BY 1, 2)
SELECT m.*, flatten(list(texts ORDER BY s.start_ms)) AS extracted_texts FROM merged m JOIN said s ON s.session_id = m.session_id AND s.start_ms BETWEEN m.start_ms AND m.end_ms GROUP BY ALL""")
def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule segments with their context; texts count in it, but label nothing here, since no rule knows them."""
    events = _read(spark, sf_dir)
    return segment.merged_segments(segment.rule_context(events, RULES), RULES)


_PEAKS_SQL = f"""c AS (SELECT session_id, timestamp_ms, value / 500 AS p, row_number() OVER {_W} AS i FROM tele WHERE value / 500 >= {PEAK}),
r AS (SELECT session_id, i, 1 AS no, timestamp_ms, p FROM c WHERE i = 1 UNION ALL
SELECT c.session_id, c.i, CASE WHEN c.timestamp_ms - r.timestamp_ms >= {PEAK_GAP} THEN r.no + 1 ELSE r.no END,
CASE WHEN c.timestamp_ms - r.timestamp_ms >= {PEAK_GAP} OR c.p > r.p THEN c.timestamp_ms ELSE r.timestamp_ms END,
CASE WHEN c.timestamp_ms - r.timestamp_ms >= {PEAK_GAP} OR c.p > r.p THEN c.p ELSE r.p END FROM r JOIN c ON c.session_id = r.session_id AND c.i = r.i + 1),
peaks AS (SELECT session_id, arg_max(timestamp_ms, i) AS timestamp_ms, arg_max(p, i) AS p FROM r GROUP BY session_id, no)"""
#: Cuts are a list that grows along the peaks of a session; the last event ends the last window.
_WINDOWS_SQL = f"""s AS (SELECT session_id, min(timestamp_ms) AS t0, max(timestamp_ms) AS t1 FROM tele GROUP BY 1),
l AS (SELECT s.session_id, t0, t1, coalesce(ps, []) AS ps FROM s LEFT JOIN (SELECT session_id, list(timestamp_ms ORDER BY timestamp_ms) AS ps FROM peaks GROUP BY 1) USING (session_id)),
k AS (SELECT session_id, t1, ps, 1 AS i, [t0] AS cuts FROM l UNION ALL
SELECT session_id, t1, ps, i + 1, CASE WHEN ps[i] - cuts[-1] >= {PEAK_GAP} THEN list_append(cuts, ps[i]) ELSE cuts END FROM k WHERE i <= len(ps)),
e AS (SELECT session_id, CASE WHEN t1 - cuts[-1] >= {PEAK_GAP} OR len(cuts) = 1 THEN list_append(cuts, t1) ELSE list_append(cuts[:-2], t1) END AS cuts FROM k WHERE i = len(ps) + 1),
w AS (SELECT session_id, cuts, unnest(range(1, len(cuts))) AS i FROM e),
win AS (SELECT session_id, cuts[i] AS start_ms, cuts[i + 1] AS end_ms FROM w WHERE cuts[i + 1] - cuts[i] >= {PEAK_GAP})"""


@query(f"{CLEAN_SQL}, {_PEAKS_SQL} SELECT * FROM peaks")
def peaks_refractory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.peaks(tele(spark, sf_dir).withColumn("p", F.col("value") / 500), PEAK, PEAK_GAP)


@query(f"{CLEAN_SQL}, {_PEAKS_SQL}, {_WINDOWS_SQL} SELECT * FROM win")
def candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tele(spark, sf_dir).withColumn("p", F.col("value") / 500)
    return segment.candidate_windows(events, segment.peaks(events, PEAK, PEAK_GAP), PEAK_GAP)


@query(f"""{CLEAN_SQL}, c AS (SELECT 'd' || doc_id AS id, text AS t, '' AS u FROM documents UNION ALL SELECT 'e' || seq, window_title, url FROM tele)
SELECT id, {label.predict_label_sql("t", "u")} AS label FROM c""")
def label_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("t"), F.lit("").alias("u"))
    events = tele(spark, sf_dir).select(F.concat(F.lit("e"), F.col("seq").cast("string")), "window_title", "url")
    return docs.unionAll(events).select("id", label.predict_label(F.col("t"), F.col("u")).alias("label"))


_MARKS = "marks AS (SELECT session_id, start_ms AS b FROM idle UNION SELECT session_id, end_ms FROM idle)"


@query(f"""{CLEAN_SQL}, {_idle_sql("idle", IDLE)}, {_MARKS} SELECT session_id, seq,
EXISTS (SELECT 1 FROM marks m WHERE m.session_id = t.session_id AND t.timestamp_ms BETWEEN m.b - {TOLERANCE} AND m.b + {TOLERANCE}) AS is_near FROM tele t""")
def boundary_labels_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.near_any(tele(spark, sf_dir), evaluate.boundaries(_idle(spark, sf_dir)), TOLERANCE, BUCKET)


@query(f"""{CLEAN_SQL}, {_idle_sql("idle", IDLE)}, n AS (SELECT i.session_id, i.start_ms AS mark_ms, t.seq, t.event_type,
row_number() OVER (PARTITION BY i.session_id, i.start_ms ORDER BY t.timestamp_ms, t.seq) AS step FROM idle i JOIN tele t ON t.session_id = i.session_id AND t.timestamp_ms >= i.start_ms)
SELECT session_id, mark_ms, step, seq, event_type FROM n WHERE step <= 3""")
def next_k_after_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _idle(spark, sf_dir).select("session_id", F.col("start_ms").alias("timestamp_ms"))
    return intervals.next_events(marks, tele(spark, sf_dir), 3)


def _greedy_sql(name: str, pred: str, true: str, best: str) -> str:
    """CTE ``name``_h: hits per session of predictions that take, in order, the ``best`` unused row of ``true`` (both: session_id, a, b)."""
    lists = lambda side, rows: f"{name}_{side} AS (SELECT session_id, list({{'a': a, 'b': b}} ORDER BY a, b) AS {side}s FROM {rows} GROUP BY 1)"
    return f"""{lists("p", pred)}, {lists("t", true)},
{name}_r AS (SELECT session_id, 1 AS i, ps, ts, CAST([] AS BIGINT[]) AS used FROM {name}_p JOIN {name}_t USING (session_id) UNION ALL
SELECT session_id, i + 1, ps, ts, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END FROM (SELECT *, {best} AS best FROM {name}_r WHERE i <= len(ps))),
{name}_h AS (SELECT session_id, max(len(used)) AS hits FROM {name}_r GROUP BY 1)"""


def _score_sql(name: str, sessions: str, pred: str, true: str) -> str:
    """CTE ``name``: n_pred, n_true, n_hits, precision, recall and f1 of ``sessions``."""
    n = lambda rows: f"(SELECT session_id, count(*) AS n FROM {rows} GROUP BY 1)"
    return f"""{name}_0 AS (SELECT s.session_id, coalesce(p.n, 0) AS n_pred, coalesce(t.n, 0) AS n_true, CAST(coalesce(h.hits, 0) AS BIGINT) AS n_hits FROM {sessions} s
LEFT JOIN {n(pred)} p USING (session_id) LEFT JOIN {n(true)} t USING (session_id) LEFT JOIN {name}_h h USING (session_id)),
{name}_1 AS (SELECT *, CASE WHEN n_pred > 0 THEN n_hits / n_pred ELSE 0.0::DOUBLE END AS precision, CASE WHEN n_true > 0 THEN n_hits / n_true ELSE 0.0::DOUBLE END AS recall FROM {name}_0),
{name} AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM {name}_1)"""


def _nearest_sql(tolerance: int) -> str:
    free = f"list_filter(range(1, len(ts) + 1), lambda j: abs(ts[j].a - ps[i].a) <= {tolerance} AND NOT list_contains(used, j))"
    return f"list_sort(list_transform({free}, lambda j: [abs(ts[j].a - ps[i].a), j]))[1][2]"


_BOTH = "greatest(0, least(ts[j].b, ps[i].b) - greatest(ts[j].a, ps[i].a))"
_BEST_IOU = f"""list_filter([list_sort(list_transform(list_filter(range(1, len(ts) + 1), lambda j: NOT list_contains(used, j)),
lambda j: [CAST(-({_BOTH} / (ps[i].b - ps[i].a + ts[j].b - ts[j].a - {_BOTH})) AS DOUBLE), CAST(j AS DOUBLE)]))[1]], lambda x: x[1] <= -0.5)[1][2]"""
_MARK_ROWS = "(SELECT session_id, start_ms AS a, start_ms AS b FROM {0} UNION ALL SELECT session_id, end_ms, end_ms FROM {0} WHERE end_ms IS NOT NULL)"
_SPAN_ROWS = "(SELECT session_id, start_ms AS a, end_ms AS b FROM {0} WHERE end_ms > start_ms)"
_TWO_IDLE = f"{CLEAN_SQL}, {_idle_sql('idle', IDLE)}, {_idle_sql('rough', LONG_IDLE)}, ses AS (SELECT DISTINCT session_id FROM rough SEMI JOIN idle USING (session_id))"


@query(f"""{_TWO_IDLE}, {_greedy_sql("o", _MARK_ROWS.format("rough"), _MARK_ROWS.format("idle"), _nearest_sql(TOLERANCE))},
{_score_sql("o", "ses", _MARK_ROWS.format("rough"), _MARK_ROWS.format("idle"))} SELECT * FROM o""")
def eval_boundary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.boundary_f1(evaluate.boundaries(_idle(spark, sf_dir, LONG_IDLE)), evaluate.boundaries(_idle(spark, sf_dir)), TOLERANCE)


@query(f"""{_TWO_IDLE}, {_greedy_sql("o", _SPAN_ROWS.format("rough"), _SPAN_ROWS.format("idle"), _BEST_IOU)},
{_score_sql("o", "ses", _SPAN_ROWS.format("rough"), "idle")} SELECT * FROM o""")
def eval_segment_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.segment_iou(_idle(spark, sf_dir, LONG_IDLE), _idle(spark, sf_dir))


_CODES_SQL = f"""{CLEAN_SQL}, {_labelled_sql("p", LONG_IDLE)}, {_labelled_sql("t", IDLE)},
o AS (SELECT p.session_id, p.start_ms, p.label, t.label AS code, t.start_ms AS t0, least(p.end_ms, t.end_ms) - greatest(p.start_ms, t.start_ms) AS b, p.end_ms - p.start_ms + t.end_ms - t.start_ms AS s
  FROM p JOIN t ON p.session_id = t.session_id AND p.start_ms < t.end_ms AND t.start_ms < p.end_ms WHERE p.end_ms > p.start_ms AND t.end_ms > t.start_ms),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, start_ms ORDER BY b / (s - b) DESC, t0) AS i FROM o WHERE b / (s - b) >= 0.5),
c AS (SELECT label, code, count(*) AS c FROM k WHERE i = 1 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c DESC, code) AS i, sum(c) OVER (PARTITION BY label) AS n FROM c)"""


@query(f"{_CODES_SQL} SELECT label, CAST(n AS BIGINT) AS n_matched, code AS top_code, CAST(c AS DOUBLE) / CAST(n AS DOUBLE) AS purity FROM r WHERE i = 1")
def label_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.label_purity(_labelled(spark, sf_dir, LONG_IDLE), _labelled(spark, sf_dir).withColumnRenamed("label", "code"), BUCKET)


_TYPES = ["quantity_change", "price_revision", "spec_change", "cert_request", "none", "other"]
_SQL_LIST = "[" + ", ".join(f"'{t}'" for t in _TYPES) + "]"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from order lines; lines without an order or supplier are none."""
    li, o, s = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "supplier"))
    rows = li.join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(s.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    qty = F.col("l_quantity").cast("int")
    return rows.select(
        F.concat_ws("-", F.lit("PO"), "l_orderkey", "l_linenumber", "l_partkey").alias("po_id"), F.col("s_name").alias("vendor_name"),
        F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("l_partkey") % 6 + 1).cast("int")).alias("request_type"), qty.alias("original_qty"),
        (qty + (F.col("l_partkey") % 21 - 5).cast("int")).alias("requested_qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_suppkey") % 19 - 10).cast("double").alias("price_change_pct"), (F.col("l_orderkey") % 9 - 2).cast("int").alias("delivery_date_shift_days"),
    )


_SUPPLIER_SQL = f"""WITH q AS (SELECT concat_ws('-', 'PO', l_orderkey, l_linenumber, l_partkey) AS po_id, s_name AS vendor_name, {_SQL_LIST}[l_partkey % 6 + 1] AS kind, CAST(l_quantity AS INT) AS old,
CAST(l_quantity AS INT) + CAST(l_partkey % 21 - 5 AS INT) AS new, l_extendedprice / l_quantity AS price, CAST(l_suppkey % 19 - 10 AS DOUBLE) AS pct, l_orderkey % 9 - 2 AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
v AS (SELECT *, CASE WHEN old > 0 THEN abs(new - old) / old * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS var, '[AUTO-APPROVED] Vendor: ' || trim(vendor_name) || ' | PO: ' || po_id || ' - ' AS ok FROM q),
w AS (SELECT *, nullif(concat_ws('; ', CASE WHEN var > 25 THEN format('Quantity variance ({{:.1f}}%) exceeds auto-approval threshold (25.0%)', var) END,
CASE WHEN pct > 5 THEN format('Price increase ({{:.1f}}%) exceeds standard limit (5.0%)', pct) END,
CASE WHEN days > 5 THEN 'Delivery delay (' || days || ' days) exceeds auto-tolerance (5 days)' END), '') AS reason FROM v),
decided AS (SELECT po_id, CASE WHEN reason IS NULL THEN 'AUTO_APPROVED' ELSE 'ESCALATED_TO_MANAGER' END AS status,
CASE WHEN reason IS NULL THEN 'Auto-dispatched vendor confirmation' ELSE 'Escalated for human procurement review' END AS action, reason,
CASE WHEN reason IS NOT NULL THEN '[HOLD / APPROVAL REQUIRED] Attention Manager | Vendor: ' || vendor_name || ' | PO: ' || po_id || '. Reason: ' || reason || '. Department Manager review required.'
WHEN kind = 'quantity_change' AND new = old THEN ok || 'Quantity confirmed (No Change in Quantity).'
WHEN kind = 'quantity_change' THEN ok || 'Quantity change request approved. (Original: ' || old || ' -> Requested: ' || new || ')'
WHEN kind = 'price_revision' AND pct = 0 THEN ok || 'Unit price confirmed (No Change in Price).'
WHEN kind = 'price_revision' THEN ok || 'Price revision approved (' || CASE WHEN pct > 0 THEN '+' ELSE '' END || format('{{:.1f}}', pct) || '%, revised unit price: ~¥' || format('{{:,}}', CAST(round_even(price * (1.0::DOUBLE + pct / 100.0::DOUBLE), 0) AS BIGINT)) || ').'
WHEN kind = 'spec_change' THEN ok || 'Item specification change registered successfully.'
WHEN kind = 'cert_request' THEN ok || 'Quality certificate request issued successfully.'
WHEN kind = 'none' THEN '[CONFIRMED - NO CHANGE] Vendor: ' || trim(vendor_name) || ' | PO: ' || po_id || ' - No change requested. Standard contract terms active.'
ELSE ok || 'Supplier communication processed successfully.' END AS comment FROM w)"""
_SCORE_SQL = """SELECT count(*) AS n_processed, count(*) FILTER (status = 'AUTO_APPROVED') AS n_approved, count(*) FILTER (status = 'ESCALATED_TO_MANAGER') AS n_escalated,
round(100.0::DOUBLE * count(*) FILTER (status = 'AUTO_APPROVED') / count(*), 1) AS straight_through_pct FROM decided"""


@query(f"{_SUPPLIER_SQL} SELECT * FROM decided")
def supplier_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.supplier_policy(_requests(spark, sf_dir)).select("po_id", "status", "action", "reason", "comment")


@query(f"{_SUPPLIER_SQL} {_SCORE_SQL}")
def supplier_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.scorecard(policy.supplier_policy(_requests(spark, sf_dir)))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kinds = F.array(*[F.lit(x) for x in [*policy.CATEGORIES, "other"]])
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("EX-"), F.col("o_orderkey").cast("string")).alias("claim_id"), F.col("c_custkey").cast("string").alias("employee_id"),
        F.col("c_name").alias("employee_name"), F.col("c_mktsegment").alias("department"), F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("expense_category"),
        (F.col("o_totalprice") / 10).alias("amount"), (F.col("o_orderkey") % 6).cast("int").alias("attendee_count"), (F.col("o_orderkey") % 11 != 0).alias("has_receipt"),
    )


def _yen(x: str) -> str:
    return f"'¥' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


_KIND_SQL = "[" + ", ".join(f"'{k}'" for k in [*policy.CATEGORIES, "other"]) + "]"
_LABEL_SQL = "[" + ", ".join(f"'{v}'" for v in [*policy.CATEGORIES.values(), "Expense Claim"]) + "]"
_EXPENSE_SQL = f"""WITH q AS (SELECT 'EX-' || o_orderkey AS id, c_custkey AS eid, trim(c_name) AS who, c_mktsegment AS dep, {_KIND_SQL}[o_orderkey % 5 + 1] AS kind, {_LABEL_SQL}[o_orderkey % 5 + 1] AS lab,
o_totalprice / 10 AS amount, o_orderkey % 6 AS n, greatest(1, o_orderkey % 6) AS heads, o_orderkey % 11 <> 0 AS receipt FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT *, nullif(concat_ws('; ', CASE WHEN NOT receipt THEN 'Official receipt is missing (receipt verification required)' END,
CASE WHEN kind = 'entertainment' AND amount / heads > 10000 THEN 'Per-head entertainment expense (' || {_yen("amount / heads")} || ') exceeds corporate policy limit (¥10,000/head)' END,
CASE WHEN kind = 'entertainment' AND n <= 0 THEN 'Attendee count must be at least 1' END,
CASE WHEN kind = 'travel_transit' AND amount > 30000 THEN 'Domestic travel expense (' || {_yen("amount")} || ') exceeds auto-approval threshold (¥30,000)' END,
CASE WHEN kind = 'supplies' AND amount > 50000 THEN 'Office supplies purchase (' || {_yen("amount")} || ') exceeds auto-approval threshold (¥50,000)' END), '') AS reason,
'[ACCOUNTING APPROVED] Claimant: ' || who || ' (' || eid || ') | Claim ID: ' || id || ' | Category: ' || lab || ' | Amount: ' || {_yen("amount")} AS ok FROM q),
decided AS (SELECT id AS claim_id, CASE WHEN reason IS NULL THEN 'AUTO_APPROVED' ELSE 'ESCALATED_TO_MANAGER' END AS status,
CASE WHEN reason IS NULL THEN 'Auto-reimbursed and posted to General Ledger (ERP)' ELSE 'Escalated for Department Manager Financial Sign-off' END AS action, reason,
CASE WHEN reason IS NOT NULL THEN '[FINANCIAL HOLD / APPROVAL REQUIRED] Claimant: ' || who || ' (' || eid || ' / ' || dep || ') | Claim ID: ' || id || ' | Amount: ' || {_yen("amount")} || ' (' || lab || '). Reason: ' || reason || '. Department Director approval required.'
WHEN kind = 'entertainment' THEN ok || ' (' || heads || ' attendees, ' || {_yen("amount / heads")} || '/person). Within corporate entertainment policy limit. Auto-reimbursement and ledger journal entry completed.'
WHEN kind = 'travel_transit' THEN ok || '. Within travel policy limit. Auto-reimbursement completed.'
ELSE ok || '. Fully compliant with corporate expense regulations. Journal posting completed.' END AS comment FROM w)"""


@query(f"{_EXPENSE_SQL} SELECT * FROM decided")
def expense_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.expense_policy(_claims(spark, sf_dir)).select("claim_id", "status", "action", "reason", "comment")


@query(f"{_EXPENSE_SQL} {_SCORE_SQL}")
def expense_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.scorecard(policy.expense_policy(_claims(spark, sf_dir)))


_SIM = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_FRAMES = "WITH f AS (SELECT vec_id, embedding AS e, lag(embedding) OVER w AS b1, lag(embedding, 2) OVER w AS b2, lead(embedding) OVER w AS a1 FROM embeddings WINDOW w AS (ORDER BY vec_id))"
_SINGLE_SQL = f"{_FRAMES}, one AS (SELECT vec_id, {_SIM.format('b1', 'e')} AS s FROM f WHERE b1 IS NOT NULL)"


@query(f"{_SINGLE_SQL} SELECT vec_id, round(s, 4) AS similarity_score FROM one WHERE s < 0")
def vision_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.single_frame(table(spark, sf_dir, "embeddings"), "vec_id", 0.0)


@query(f"""{_FRAMES}, s AS (SELECT vec_id, {_SIM.format("b2", "b1")} AS b, {_SIM.format("b1", "e")} AS t, {_SIM.format("e", "a1")} AS a FROM f WHERE b2 IS NOT NULL AND a1 IS NOT NULL)
SELECT vec_id, round((b + a) / 2 - t, 4) AS drop_magnitude, round(t, 4) AS transition_similarity, round(b, 4) AS stability_before, round(a, 4) AS stability_after FROM s WHERE (b + a) / 2 - t > 0.15""")
def vision_multiframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.multi_frame(table(spark, sf_dir, "embeddings"), "vec_id", 0.15)


@query(f"""{_SINGLE_SQL}, b AS (SELECT DISTINCT 'ses_' || label AS session_id, o.vec_id * 1000 AS start_ms FROM one o JOIN embeddings USING (vec_id) WHERE s < 0),
n AS (SELECT session_id, start_ms, lead(start_ms) OVER (PARTITION BY session_id ORDER BY start_ms) AS end_ms FROM b) SELECT *, 'Automated Vision Segment' AS label FROM n WHERE end_ms IS NOT NULL""")
def vision_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "embeddings")
    found = vision.single_frame(frames, "vec_id", 0.0).join(frames.select("vec_id", F.concat(F.lit("ses_"), F.col("label").cast("string")).alias("session_id")), "vec_id")
    return vision.boundary_segments(found.select("session_id", (F.col("vec_id") * 1000).alias("timestamp_ms")))


@query("""WITH w AS (SELECT doc_id, ' ' || unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) || ' ' AS p FROM documents), d AS (SELECT DISTINCT doc_id, p FROM w),
g AS (SELECT doc_id, p, unnest([1, 2, 3]) AS k FROM d), i AS (SELECT doc_id, p, k, unnest(range(1, length(p) - k + 2)) AS i FROM g)
SELECT substr(p, i, k) AS gram, count(DISTINCT doc_id) AS n_documents FROM i GROUP BY 1""")
def char_ngram_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ngram_documents(table(spark, sf_dir, "documents"))


@query("SELECT quality, n, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_weights(table(spark, sf_dir, "labels"), "quality")


@query("SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 < CAST(floor(count(*) OVER () * 0.8::DOUBLE) AS BIGINT) AS is_train FROM labels")
def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ordered_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query()
def boundary_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a boundary near each event, by trees over the 18 features of the first 80 % of events in order."""
    rows = features_18(spark, sf_dir).join(boundary_labels_nearest(spark, sf_dir), ["session_id", "seq"]).withColumn("label", F.col("is_near").cast("double"))
    split = stored(stats.ordered_split(rows, "session_id", "timestamp_ms", "seq"), "boundary-rows")
    model = ml.fit_boundaries(split.where("is_train").drop("is_train"))
    return model.transform(split.select("session_id", "timestamp_ms", "seq", "is_train", *features.NAMES)).select("session_id", "timestamp_ms", "seq", "p", "is_train")


#: A score with ties, so that the figures have to do with them.
_SCORED_SQL = f"""marked AS (SELECT t.session_id, t.timestamp_ms, t.seq, round(value / 500, 1) AS p, EXISTS (SELECT 1 FROM marks m WHERE m.session_id = t.session_id AND t.timestamp_ms BETWEEN m.b - {TOLERANCE} AND m.b + {TOLERANCE}) AS y,
  row_number() OVER (ORDER BY session_id, timestamp_ms, seq) - 1 AS i, count(*) OVER () AS n FROM tele t),
rest AS (SELECT * FROM marked WHERE i >= CAST(floor(n * 0.8::DOUBLE) AS BIGINT)), g AS (SELECT p, CAST(count(*) FILTER (y) AS DOUBLE) AS pos, CAST(count(*) FILTER (NOT y) AS DOUBLE) AS neg FROM rest WHERE p IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g),
h AS (SELECT sum(pos) FILTER (p >= 0.5) AS tp, sum(neg) FILTER (p >= 0.5) AS fp, sum(pos) AS np, sum(neg) AS nn, sum(neg * (tp - pos + pos / 2)) / (any_value(np) * any_value(nn)) AS roc_auc, sum(pos * tp / (tp + fp)) / any_value(np) AS average_precision FROM c)"""


@query(f"""{CLEAN_SQL}, {_idle_sql("idle", IDLE)}, {_MARKS}, {_SCORED_SQL} SELECT CAST(np + nn AS BIGINT) AS n, CAST(np AS BIGINT) AS n_positive, round(np / (np + nn), 9) AS prevalence, round(roc_auc, 9) AS roc_auc,
round(average_precision, 9) AS average_precision, round(tp / (tp + fp), 9) AS precision, round(tp / np, 9) AS recall, round(2 * tp / (tp + fp + np), 9) AS f1, round((tp + nn - fp) / (np + nn), 9) AS accuracy FROM h""")
def boundary_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a score against the boundaries near events, on the last 20 % of events in order."""
    rows = tele(spark, sf_dir).select("session_id", "timestamp_ms", "seq", F.round(F.col("value") / 500, 1).alias("p"))
    rows = stats.ordered_split(rows, "session_id", "timestamp_ms", "seq").where("not is_train")
    scored = rows.join(boundary_labels_nearest(spark, sf_dir), ["session_id", "seq"])
    out = ml.ranking_metrics(scored, F.col("p"), F.col("is_near"))
    return out.select("n", "n_positive", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth made of idle segments: three processes a session, every seventh execution without an end."""
    s = _idle(spark, sf_dir)
    end = F.when(F.col("seg_no") % 7 != 0, C.ms_to_iso(F.col("end_ms")))
    run = F.struct(
        F.lit(None).cast("string").alias("variant"), F.concat(F.lit("x"), F.col("seg_no").cast("string")).alias("exec_id"), C.ms_to_iso(F.col("start_ms")).alias("start_ts"), end.alias("end_ts"),
        F.array(F.lit("Notepad")).alias("apps"),
    )
    code = F.concat(F.lit("P"), (F.col("seg_no") % 3).cast("string"))
    processes = s.groupBy("session_id", code.alias("code")).agg(F.sort_array(F.collect_list(run)).alias("executions"))
    process = F.struct("code", F.lit("family").alias("family_name"), F.lit("domain").alias("domain"), "executions")
    expected = F.array().cast("array<struct<ts: string, type: string>>")
    return processes.groupBy("session_id").agg(F.struct(F.sort_array(F.collect_list(process)).alias("processes"), expected.alias("expected_boundaries")).alias("manifest"))


_TRUE_SQL = f"""{_TWO_IDLE}, ex AS (SELECT session_id, 'P' || (seg_no % 3) AS code, 'x' || seg_no AS exec_id, start_ms // 1000 * 1000 AS start_ms,
CASE WHEN seg_no % 7 <> 0 THEN end_ms // 1000 * 1000 END AS end_ms FROM idle), whole AS (SELECT * FROM ex WHERE end_ms IS NOT NULL)"""


@query(f"""{_TRUE_SQL}, m AS (SELECT session_id, code, start_ms AS timestamp_ms, 'start' AS kind FROM ex UNION ALL SELECT session_id, code, end_ms, 'end' FROM whole)
SELECT session_id, timestamp_ms, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS ts_iso, code, 'family' AS family_name, kind FROM m""")
def true_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.true_boundaries(_manifests(spark, sf_dir))


@query(f"{_TRUE_SQL} SELECT session_id, code, 'family' AS family_name, exec_id, start_ms, end_ms FROM whole")
def true_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.true_executions(_manifests(spark, sf_dir))


@query(f"""{_TRUE_SQL} SELECT code, count(end_ms) AS exec_count, count(*) FILTER (end_ms IS NULL) AS null_end_count, CAST(coalesce(sum(end_ms - start_ms), 0) AS BIGINT) AS total_ms,
min(end_ms - start_ms) AS min_ms, max(end_ms - start_ms) AS max_ms, count(DISTINCT session_id) FILTER (end_ms IS NOT NULL) AS sessions_count FROM ex GROUP BY 1""")
def execution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.execution_stats(_manifests(spark, sf_dir))


@query(f"{_TRUE_SQL} SELECT code, '?' AS value, count(*) AS n FROM whole GROUP BY 1")
def execution_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.value_counts(_manifests(spark, sf_dir), "variant")


@query(f"{_TRUE_SQL} SELECT session_id, count(end_ms) AS n FROM ex GROUP BY 1")
def executions_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.executions_per_session(_manifests(spark, sf_dir))


_EVALUATED_SQL = f"""{_TRUE_SQL}, {_greedy_sql("b", _MARK_ROWS.format("rough"), _MARK_ROWS.format("ex"), _nearest_sql(TOLERANCE))}, {_score_sql("b", "ses", _MARK_ROWS.format("rough"), _MARK_ROWS.format("ex"))},
{_greedy_sql("v", _SPAN_ROWS.format("rough"), _SPAN_ROWS.format("whole"), _BEST_IOU)}, {_score_sql("v", "ses", _SPAN_ROWS.format("rough"), "whole")},
scores AS (SELECT b.session_id, (SELECT count(*) FROM rough WHERE rough.session_id = b.session_id) AS pred_count, b.n_true AS true_boundary_count, v.n_true AS true_exec_count,
{", ".join(f"{t}.{c} AS {k}_{c}" for t, k in (("b", "boundary"), ("v", "segment")) for c in ("precision", "recall", "f1"))} FROM b JOIN v USING (session_id))"""


@query(f"{_EVALUATED_SQL} SELECT * FROM scores")
def session_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluated_sessions(_idle(spark, sf_dir, LONG_IDLE), _manifests(spark, sf_dir), TOLERANCE)


_MACRO = [f"{k}_{c}" for k in ("boundary", "segment") for c in ("precision", "recall", "f1")]


@query(f"{_EVALUATED_SQL} SELECT count(*) AS n_sessions, {', '.join(f'round(avg({c}), 9) AS {c}' for c in _MACRO)} FROM scores")
def macro_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.macro_scores(session_evaluation(spark, sf_dir))
    return out.select("n_sessions", *[F.round(c, 9).alias(c) for c in _MACRO])


@query(f"{_TRUE_SQL} SELECT session_id FROM (SELECT DISTINCT session_id FROM tele) ANTI JOIN ex USING (session_id)")
def unmatched_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.unmatched_sessions(tele(spark, sf_dir), _manifests(spark, sf_dir))


@query(f"""{CLEAN_SQL}, g AS (SELECT timestamp_ms - lag(timestamp_ms) OVER {_W} AS gap FROM tele), k AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, count(*) OVER () AS n FROM g WHERE gap >= {IDLE})
SELECT count(*) AS large_gap_count, coalesce(max(gap), 0) AS large_gap_max_ms, coalesce(max(gap) FILTER (i = n // 2), 0) AS large_gap_median_ms FROM k""")
def large_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.large_gaps(tele(spark, sf_dir), IDLE)


_EVENT_WORDS = f"""concat_ws(' ', {_TOKENS}, CASE WHEN contains(url, '#') THEN 'ROUTE_' || replace(list_extract(string_split(url, '#'), -1), '/', '_') END, window_title, 'CLIP_' || substr(anchor, 1, 50))"""


def _documents_sql(spans: str) -> str:
    return f"""docs AS (SELECT i.session_id, i.start_ms, i.end_ms, count(*) AS event_count, string_agg({_EVENT_WORDS}, ' ' ORDER BY timestamp_ms, seq) AS text
FROM {spans} i JOIN tele e ON e.session_id = i.session_id AND e.timestamp_ms BETWEEN i.start_ms AND i.end_ms GROUP BY 1, 2, 3)"""


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tele(spark, sf_dir).withColumn("text_content", F.col("anchor")).withColumn("p", F.col("value") / 500)


@query(f"{CLEAN_SQL}, {_idle_sql('idle', IDLE)}, {_documents_sql('idle')} SELECT * FROM docs")
def execution_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.documents(_idle(spark, sf_dir), _spoken(spark, sf_dir), BUCKET)


_V3 = dict(threshold=PEAK, peak_gap_ms=PEAK_GAP, min_ms=PEAK_GAP, bucket_ms=BUCKET, least_events=3, idle_ms=4 * PEAK_GAP)


@query(f"""{CLEAN_SQL}, {_PEAKS_SQL}, {_WINDOWS_SQL}, {_documents_sql("win")} SELECT * FROM docs WHERE NOT (event_count < 3 AND end_ms - start_ms > {4 * PEAK_GAP})""")
def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.windows(_spoken(spark, sf_dir), **_V3)


_GRAMS_SQL = """wd AS (SELECT key, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM d), pd AS (SELECT key, ' ' || w || ' ' AS p, count(*) AS c FROM wd GROUP BY 1, 2),
gk AS (SELECT key, p, c, unnest([1, 2, 3]) AS k FROM pd), gi AS (SELECT key, p, c, k, unnest(range(1, length(p) - k + 2)) AS i FROM gk), g AS (SELECT key, substr(p, i, k) AS gram, sum(c) AS n FROM gi GROUP BY 1, 2),
v AS (SELECT gram, sum(n) AS total, count(*) AS df FROM g GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, encode(gram) LIMIT 5000), raw AS (SELECT key, g.gram, n * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS r FROM g JOIN v USING (gram))"""


def _execution_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of idle segments, with a key."""
    return execution_documents(spark, sf_dir).withColumn("key", F.concat_ws("@", "session_id", "start_ms"))


@query(f"""{CLEAN_SQL}, {_idle_sql("idle", IDLE)}, {_documents_sql("idle")}, d AS (SELECT session_id || '@' || start_ms AS key, text FROM docs), {_GRAMS_SQL}
SELECT key, gram, round(r / sqrt(sum(r * r) OVER (PARTITION BY key)), 9) AS weight FROM raw""")
def document_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the character n-grams of executions' documents, as the label model takes them."""
    return ml.tfidf(_execution_texts(spark, sf_dir), "key").withColumn("weight", F.round("weight", 9))


_NAMES = label.PERSONNEL + label.FINANCE + label.OPERATIONS


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of idle segments with the number of the label that the rules give them; the unknown one is the last."""
    named = label.predict_label(F.col("text"), F.lit(""))
    number = F.array_position(F.array(*[F.lit(n) for n in _NAMES]), named).cast("int")
    return _execution_texts(spark, sf_dir).withColumn("label", F.when(number > 0, number - 1).otherwise(len(_NAMES)).cast("double"))


@query()
def label_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the label model, fitted to the first 80 % of executions' documents, on the rest."""
    split = stored(stats.ordered_split(_labelled_documents(spark, sf_dir), "session_id", "start_ms"), "label-rows")
    model = ml.fit_labels(split.where("is_train"), rounds=100)
    return ml.class_report(ml.predicted_labels(model, split.where("not is_train")))


@query()
def model_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows labelled by the label model, which learns from executions' documents, merged with their context."""
    model = ml.fit_labels(_labelled_documents(spark, sf_dir), rounds=100)
    docs = chain.labelled(model_windows(spark, sf_dir), model, [*_NAMES, label.UNKNOWN])
    return chain.merged(docs, _spoken(spark, sf_dir), RULES, BUCKET)


@query(f"""{CLEAN_SQL}, {_labelled_sql("seg", IDLE)}, d AS (SELECT *, (end_ms - start_ms) / 1000 AS duration_s FROM seg)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, end_ms, label) AS execution_no, start_ms, end_ms, duration_s, least(duration_s, 120.0::DOUBLE) AS shown_s, label FROM d WHERE label = 'payroll_adjustment'""")
def explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.explorer(_labelled(spark, sf_dir), "payroll_adjustment")


@query(f"""{_SUPPLIER_SQL} SELECT po_id, var AS quantity_variance_pct, var <= 25 AS quantity_passed, pct <= 5 AS price_passed, days <= 5 AS delivery_passed FROM v""")
def supplier_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.supplier_audit(_requests(spark, sf_dir))


@query(f"""{_EXPENSE_SQL} SELECT id AS claim_id, amount / heads AS per_head_amount, receipt AS receipt_passed, CASE WHEN kind = 'entertainment' THEN amount / heads <= 10000
WHEN kind = 'travel_transit' THEN amount <= 30000 WHEN kind = 'supplies' THEN amount <= 50000 ELSE true END AS limit_passed FROM q""")
def expense_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.expense_audit(_claims(spark, sf_dir))


@query("SELECT " + ", ".join(f'{c} AS "{t}"' for c, t in views.RANKING_TITLES.items()) + f" FROM ({ORACLES['roi_ranking']})")
def ranking_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ranking_table(roi_ranking(spark, sf_dir))


_BARS = ("total_duration_min", "friction")


@query(f"WITH shown AS MATERIALIZED ({ORACLES['roi_ranking']}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS series, row_number() OVER (ORDER BY {c}, rank) AS place, process, CAST({c} AS DOUBLE) AS value FROM shown" for c in _BARS))
def ranking_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = stored(roi_ranking(spark, sf_dir), "ranking")
    return views.bars(ranking, _BARS[0]).unionAll(views.bars(ranking, _BARS[1]))


@query(f"""{_EVALUATED_SQL} SELECT row_number() OVER (ORDER BY round(-boundary_f1, 9), session_id) AS place, left(session_id, {views.SESSION_WIDTH}) AS session, pred_count, true_exec_count,
format('{{:.1f}}%', boundary_f1 * 100) AS boundary_f1, format('{{:.1f}}%', segment_f1 * 100) AS segment_f1 FROM scores""")
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.session_report(session_evaluation(spark, sf_dir))


@query(f"""{_CODES_SQL}, s AS (SELECT label, CAST(max(c) AS DOUBLE) / CAST(sum(c) AS DOUBLE) AS share, string_agg(code || '(' || c || ')', '  ' ORDER BY c DESC, code) AS codes FROM c GROUP BY 1)
SELECT row_number() OVER (ORDER BY round(-share, 9), label) AS place, label, format('{{:.1f}}%', share * 100) AS purity, codes FROM s""")
def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.label_report(evaluate.label_codes(_labelled(spark, sf_dir, LONG_IDLE), _labelled(spark, sf_dir).withColumnRenamed("label", "code"), BUCKET))

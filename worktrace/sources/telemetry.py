"""Event logs: the reader of session folders, and the view that lets the ``events`` table play one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from worktrace.functions.columns import PORTALS, ROUTES, falsy, stripped
from worktrace.sources.storage import table

BUGGY_TYPE = "text_input_complete"
POLICIES = ("drop", "flag", "keep")
QUIRK_REASON = "text_input_complete is unreliable per schema; use keystroke or clipboard_change"  # fixed value


def quirk_policy(events: DataFrame, policy: str = "drop", buggy_type: str = BUGGY_TYPE) -> DataFrame:
    """Events of an unreliable type dropped, flagged (``_is_unreliable``, ``_quirk_reason``, ``is_buggy_recording``) or kept as they are."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    buggy = F.coalesce(F.col("event_type") == buggy_type, F.lit(False))
    if policy == "drop":
        return events.where(~buggy)
    if policy == "flag":
        return events.withColumn("_is_unreliable", buggy).withColumn("_quirk_reason", F.when(buggy, F.lit(QUIRK_REASON))).withColumn("is_buggy_recording", buggy)
    return events


def chosen_policy(policy: str, drop_text_input_complete: bool | None) -> str:
    """The older argument, where it is given, decides: true drops, false flags."""
    return policy if drop_text_input_complete is None else "drop" if drop_text_input_complete else "flag"


def read_sessions(spark: SparkSession, dataset_dir: str, policy: str = "drop", bad_lines: bool = False, drop_text_input_complete: bool | None = None) -> DataFrame:
    """Typed events of ``<dataset_dir>/ses_*/chunk*/events.jsonl`` with session_id, chunk and line_no.

    Blank and malformed lines and values that are no objects are left out (``bad_lines``: only those are returned).
    The total order of a session is (timestamp_ms, seq, chunk, block, line_no); a missing time or number counts as 0. Files are read
    by blocks of lines; line numbers ascend within a block and have gaps. ``drop_text_input_complete`` is an older name of the policy.
    """
    return _read(spark, f"{dataset_dir}/ses_*/chunk*/events.jsonl", chosen_policy(policy, drop_text_input_complete), bad_lines)


def iter_session_events(spark: SparkSession, session_dir: str, policy: str = "drop", drop_text_input_complete: bool | None = None) -> Iterator[Row]:
    """The events of one session folder in their total order, one by one.

    The session is sorted by ranges over tasks, and one range at a time is brought here: never the whole session.
    """
    events = _read(spark, f"{session_dir.rstrip('/')}/chunk*/events.jsonl", chosen_policy(policy, drop_text_input_complete))
    yield from events.orderBy(*EVENT_ORDER).toLocalIterator()


EVENT_ORDER = ("timestamp_ms", "seq", "chunk", "block", "line_no")


def _read(spark: SparkSession, files: str, policy: str, bad_lines: bool = False) -> DataFrame:
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")
    )
    lines = lines.select(
        F.regexp_extract("path", r"/(ses_[^/]*)/", 1).alias("session_id"), F.regexp_extract("path", r"/(chunk[^/]*)/", 1).alias("chunk"), "block", "line_no", "line"
    ).where(F.btrim("line") != "")
    parsed = lines.withColumn("v", F.try_parse_json("line"))
    good = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    if bad_lines:
        return parsed.where(~good).select("session_id", "chunk", "block", "line_no", "line")
    get = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    out = parsed.where(good).select(
        "session_id", "chunk", "block", "line_no",
        get("event_id").alias("event_id"),
        F.coalesce(get("timestamp_ms", "bigint"), F.lit(0)).alias("timestamp_ms"),
        F.coalesce(get("correlation.sequence_number", "bigint"), F.lit(0)).alias("seq"),
        F.coalesce(get("event_type"), F.lit("")).alias("event_type"),
        app_name(get).alias("app_name"), window_title(get).alias("window_title"), browser_url(get).alias("url"),
        F.coalesce(get("context.active_browser_tab.url"), F.lit("")).alias("tab_url"),
        falsy(get("payload.url"), get("payload.to_url")).alias("nav_url"),
        anchor(get("event_type"), get("payload.text_content"), get("payload.text_length", "bigint")).alias("anchor"),
        get("payload.text_content").alias("text_content"),
        # Absent: 0. Null: to be made from the event before.
        F.when(get("correlation.ms_since_last_event", "variant").isNull(), 0.0).otherwise(get("correlation.ms_since_last_event", "double")).alias("ms_since"),
        falsy(get("context.active_app.app_name"), get("context.active_app.process_name")).alias("ctx_app"),
        F.coalesce(get("context.active_app.window_title"), F.lit("")).alias("ctx_title"),
        F.lower(falsy(get("payload.key"), get("payload.character"))).alias("key"),
        (F.coalesce(get("payload.modifiers.ctrl", "boolean"), F.lit(False)) | F.coalesce(get("payload.modifiers.control", "boolean"), F.lit(False))).alias("ctrl"),
        F.lower(F.concat_ws(" ", get("payload.target_element.name"), get("payload.target_element.automation_id"),
                            falsy(*[get(f"payload.element.attributes.{a}") for a in ("text", "innerText", "value")], get("payload.element.text")),
                            get("payload.element.attributes.id"))).alias("element_text"),
        form_text(get).alias("form_text"),
        texts(F.try_variant_get("v", "$.context.extracted_text", "variant")).alias("texts"),
        plain_text(F.try_variant_get("v", "$.context.extracted_text", "variant")).alias("plain_text"),
        document_texts(F.try_variant_get("v", "$.context.extracted_text", "variant")).alias("doc_texts"),
    )
    return quirk_policy(out, policy)


def app_name(get) -> Column:
    switched = F.when(get("event_type") == "app_switch", get("payload.new_app.app_name"))
    return falsy(switched, get("context.active_app.app_name"), get("context.active_app.process_name"))


def window_title(get) -> Column:
    kind = get("event_type")
    own = F.when(kind == "app_switch", get("payload.new_app.window_title")).when(kind == "window_title_change", get("payload.new_title"))
    return falsy(own, get("context.active_app.window_title"))


def browser_url(get) -> Column:
    own = F.when(get("event_type") == "browser_navigation", falsy(get("payload.url"), get("payload.to_url")))
    return falsy(own, get("context.active_browser_tab.url"))


def anchor(kind: Column, content: Column, length: Column) -> Column:
    """What a clipboard event carries: its text, else its length; null for other events."""
    text = stripped(F.coalesce(content, F.lit("")))
    return F.when(kind == "clipboard_change", F.when(text != "", text).when(length > 0, F.concat(F.lit("len_"), length.cast("string"))))


def form_text(get) -> Column:
    """What names the element that an event is about, at most 100 characters; '' if nothing does."""
    named = [get("payload.target_element.name"), get("payload.element.text"), *[get(f"payload.element.attributes.{a}") for a in ("innerText", "placeholder", "value")]]
    return F.substring(stripped(falsy(*named)), 1, 100)


def document_texts(v: Column) -> Column:
    """As documents of executions take them: the beginning of a string, or the first three of a list; no objects."""
    kind = F.schema_of_variant(v)
    one = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.nullif(F.try_variant_get(x, "$.text", "string"), F.lit("")))
    listed = F.when(kind.startswith("ARRAY"), F.transform(F.slice(F.try_variant_get(v, "$", "array<variant>"), 1, 3), one))
    listed = listed.when(kind == "STRING", F.array(F.nullif(F.substring(F.try_variant_get(v, "$", "string"), 1, 100), F.lit(""))))
    return F.array_compact(F.coalesce(listed, F.array().cast("array<string>")))


def plain_text(v: Column) -> Column:
    """The beginning of a text that is a string; '' for lists and objects."""
    string = F.substring(stripped(F.try_variant_get(v, "$", "string")), 1, 100)
    return F.when(F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)), string).otherwise("")


def texts(v: Column) -> Column:
    """A string, an object with text, or a list of either, as a list of strings."""
    kind = F.schema_of_variant(v)
    string = lambda x: F.substring(stripped(F.try_variant_get(x, "$", "string")), 1, 200)
    object_text = lambda x: F.substring(stripped(F.try_variant_get(x, "$.text", "string")), 1, 300)
    one = lambda x: F.when(F.schema_of_variant(x) == "STRING", string(x)).otherwise(object_text(x))
    many = F.transform(F.try_variant_get(v, "$", "array<variant>"), one)
    listed = F.when(kind.startswith("ARRAY"), many).when(v.isNotNull(), F.array(one(v)))
    return F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


#: The ``events`` table as telemetry: kinds and apps are dealt by event type and by the number in ``props``.
KINDS = {"click": "app_switch", "view": "browser_navigation", "purchase": "clipboard_change", "signup": "dialog_opened", "error": "mouse_scroll"}
APPS = ("Google Chrome", "Microsoft Excel", "Notepad")


def tele(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A column of its own first, so that a row's JSON is parsed once, however many columns are made of it.
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type"))
    system = (k / 3).cast("int") % 3
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
    page = F.when(k % 5 == 0, F.lit("dashboard")).otherwise(pick(ROUTES, (k / 5).cast("int") % 5))
    return e.select(
        F.concat(F.lit("ses_"), F.col("user_id").cast("string"), F.lit("-000000-M"), (F.col("user_id") % 4).cast("string")).alias("session_id"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000").alias("timestamp_ms"),
        F.col("event_id").alias("seq"), kind.alias("event_type"), "k", pick(APPS, k % 3).alias("app_name"),
        pick(PORTALS, system).alias("window_title"),
        F.concat(F.lit("http://127.0.0.1:"), (5122 + system).cast("string"), F.lit("/#/"), page).alias("url"),
        F.when((kind == "clipboard_change") & (k > 0), F.concat(F.lit("len_"), k.cast("string"))).alias("anchor"), "value",
    )


_WHEN = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
TELE_SQL = f"""tele0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
tele AS (SELECT 'ses_' || user_id || '-000000-M' || (user_id % 4) AS session_id, epoch_us(ts) // 1000 AS timestamp_ms, event_id AS seq,
  CASE event_type {_WHEN} END AS event_type, k, {_LIST(APPS)}[k % 3 + 1] AS app_name, {_LIST(PORTALS)}[(k // 3) % 3 + 1] AS window_title,
  'http://127.0.0.1:' || (5122 + (k // 3) % 3) || '/#/' || CASE WHEN k % 5 = 0 THEN 'dashboard' ELSE {_LIST(ROUTES)}[(k // 5) % 5 + 1] END AS url,
  CASE WHEN event_type = 'purchase' AND k > 0 THEN 'len_' || k END AS anchor, value FROM tele0)"""

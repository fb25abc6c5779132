"""Scalar expressions over event columns; every function takes and gives Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PORTALS = ("HR人事給与システム", "財務会計システム", "受発注在庫管理システム")
ROUTES = ("resident-tax", "payroll-items", "leave-applications", "social-insurance", "onboarding")
PORT_TOKENS = {":5122": "SYS_HR_5122", ":5123": "SYS_FIN_5123", ":5124": "SYS_OPS_5124", ":5132": "SYS_HR_5132", ":5133": "SYS_FIN_5133", ":5134": "SYS_OPS_5134"}
HUB_ENDINGS = ("/dashboard", "/index", "/home", ":5122", ":5123", ":5124", ":5132", ":5133", ":5134")
NOISE_TYPES = (
    "mouse_scroll", "screenshot_smart", "session_start", "session_end", "upload_started", "upload_completed", "upload_failed",
    "extension_connected", "extension_disconnected",
)
SHORTCUT_KEYS = ("c", "v", "x", "s", "f", "a", "z")
CONFIRM_WORDS = (
    "submit", "confirm", "save", "apply", "ok", "execute", "next", "search", "update", "done", "complete", "register", "send",
    "登録", "確定", "保存", "送信", "実行", "次へ", "検索", "更新", "決定", "完了", "承認", "申請", "作成", "閉じる",
)
WORK_APPS = (
    "Microsoft Excel", "excel", "Notepad", "notepad", "Microsoft Word", "word", "Microsoft Teams", "teams", "OneNote", "onenote",
    "Outlook", "outlook", "olk", "File Explorer", "Windows Explorer", "explorer",
)
CLICK_TYPES = ("mouse_click", "mouse_double_click", "mouse_drag_drop")


def falsy(*values: Column) -> Column:
    """The first value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def contains_any(text: Column, values) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(v) for v in values])


def keeps_event(kind: Column, ctrl: Column, key: Column, element_text: Column) -> Column:
    """False for noise: recordings' own events, keys that are no shortcuts, clicks that confirm nothing."""
    shortcut = F.coalesce(ctrl & key.isin(*SHORTCUT_KEYS), F.lit(False))
    confirms = F.coalesce(contains_any(element_text, CONFIRM_WORDS), F.lit(False))
    return F.when(kind == "keystroke", shortcut).when(kind.isin(*CLICK_TYPES), confirms).otherwise(~F.coalesce(kind.isin(*NOISE_TYPES), F.lit(False)))


def hub_url_v1(url: Column) -> Column:
    """Start pages of a portal, by ending or by an address without a path."""
    raw = stripped(url)
    low = F.lower(F.regexp_replace(raw, "/+$", ""))
    return F.coalesce(low.rlike(r"(/dashboard|/index|/index\.html)$") | raw.rlike(r"^https?://[^/]+/?(?:#/?)?$"), F.lit(False))


def hub_url_v3(url: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(url, r"(?s)\?.*$", ""), "/+$", "")
    return F.coalesce(reduce(lambda a, b: a | b, [cut.endswith(e) for e in HUB_ENDINGS]), F.lit(False))


def portal(title: Column) -> Column:
    return reduce(lambda a, p: F.when(title.contains(p), F.lit(p)).otherwise(a), reversed(PORTALS), F.lit(None).cast("string"))


def is_browser(app: Column) -> Column:
    return F.coalesce(F.lower(app).rlike("chrome|edge|browser"), F.lit(False))


def app_category(app: Column, browsers: str = "chrome") -> Column:
    """1 browser, 2 spreadsheet, 3 document, 4 notes, 0 others."""
    a = F.lower(app)
    return F.when(a.rlike(browsers), 1).when(a.rlike("excel|calc"), 2).when(a.rlike("word|doc"), 3).when(a.rlike("notepad|memo"), 4).otherwise(0)


def port_token(url: Column) -> Column:
    return reduce(lambda a, kv: F.when(url.contains(kv[0]), F.lit(kv[1])).otherwise(a), reversed(PORT_TOKENS.items()), F.lit(None).cast("string"))


def route_token(url: Column) -> Column:
    return F.when(url.contains("#"), F.concat(F.lit("ROUTE_"), F.replace(F.substring_index(url, "#", -1), F.lit("/"), F.lit("_"))))


def url_depth(url: Column) -> Column:
    return F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))


def machine(session_id: Column) -> Column:
    parts = F.split(session_id, "-")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(session_id)


def iso_to_ms(iso: Column) -> Column:
    """Milliseconds of an ISO time, cut to whole ones; without a zone it is UTC, whatever the session's zone."""
    timed = F.when(iso.rlike(r"^\d+-\d+-\d+$"), F.concat(iso, F.lit("T00:00:00"))).otherwise(iso)
    return F.unix_millis(F.to_timestamp(F.when(timed.rlike(r"(?i)(z|[+-]\d{2}(:?\d{2})?)$"), timed).otherwise(F.concat(timed, F.lit("Z")))))


def ms_to_iso(ms: Column) -> Column:
    """UTC to the second, whatever the session's zone: a time without a zone is made and read as text."""
    at = F.timestamp_add("MILLISECOND", ms, F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("string")
    return F.concat(F.substring(at, 1, 10), F.lit("T"), F.substring(at, 12, 8), F.lit("Z"))


def slug(text: Column, length: int = 30) -> Column:
    clean = stripped(F.regexp_replace(text, r"(?U)[^\w\s-]", ""))
    return F.translate(F.substring(clean, 1, length), " -", "__")


def session_of_path(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(?:^|.*/)(ses_[^/]*)/", 1), F.lit("")), F.lit("default_session"))


def ms_of_file_name(path: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.get(F.filter(F.split(stem, "_"), lambda p: p.rlike(r"^\d{10,}$")), F.lit(0)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    return ratio(both, (e1 - s1) + (e2 - s2) - both)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)

"""Labels of work by rules: tables of fixed values, read in order, become one CASE expression."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from worktrace.functions.columns import PORTALS, ROUTES, slug, stripped

UNKNOWN = "process_unknown"

# Words and the label of a text that holds one of them, in order of precedence.
TITLES = [
    (("supplier_list", "shinkuitorihikisaki", "shinkui_keiyaku", "getsujitsu_teigaku", "新規取引先", "新規契約"), "supplier_communication"),
    (("hr_policy", "ikuji_kyuugyou", "kaigo_kyuugyou", "育児休業", "介護休業"), "leave_application_processing"),
    (("budget_report", "powerpoint", "budget_analysis", "予算分析"), "budget_variance_analysis"),
    (("inventory catalog", "在庫調整メモ"), "inventory_adjustment"),
    (("expense_calc", "gyomu_itaku_keihi", "settai_keihi", "精算確認メモ", "経費計算"), "expense_processing"),
    (("nyusha_checklist", "gyomu_itaku_ukeire", "入社チェック"), "onboarding_verification"),
    (("kazoku_teate", "gyomu_itaku_kyuuyo", "家族手当"), "payroll_adjustment"),
]
FORMS = [
    (("照合内容・確認コメント",), "resident_tax_verification"),
    (("差戻し理由", "承認コメントまたは"), "leave_application_processing"),
    (("届出先・対応状況",), "insurance_pension_processing"),
    (("手当設定内容",), "onboarding_verification"),
    (("照合内容・承認コメント", "承認コメントを入力"), "invoice_approval"),
    (("消込理由", "照合結果または差異"), "bank_reconciliation"),
    (("支払実行", "保留理由・特記事項"), "payment_processing"),
    (("仕入先への依頼",), "supplier_communication"),
    (("追跡番号", "倉庫連携内容"), "shipment_tracking"),
    (("検品結果", "在庫戻し"), "return_processing"),
]
CODES = [("rma", "return_processing"), ("so", "order_processing"), ("inv", "invoice_approval"), ("pm", "payment_processing"), ("po", "supplier_communication")]
DOMAINS = [
    (("日本通運", "ヤマト運輸", "トナミ運輸", "近鉄ロジスティクス"), "shipment_tracking"),
    (("埼玉りそな", "みずほ", "mizuho", "chiba"), "bank_reconciliation"),
    (("会議費", "接待交際費", "消耗品費", "宿泊費", "交通費", "通信費"), "expense_processing"),
    (("時間外手当調整", "扶養手当追加", "育休控除取消"), "payroll_adjustment"),
    (("年金記録訂正", "標準報酬月額変更", "月額変更届提出", "算定基礎届提出"), "insurance_pension_processing"),
    (("継電器", "筐体パネル", "インバーター", "電源モジュール"), "inventory_adjustment"),
]
PERSONNEL = ("resident_tax_verification", "payroll_adjustment", "leave_application_processing", "insurance_pension_processing", "onboarding_verification")
FINANCE = ("invoice_approval", "expense_processing", "bank_reconciliation", "budget_variance_analysis", "payment_processing")
OPERATIONS = ("order_processing", "inventory_adjustment", "supplier_communication", "shipment_tracking", "return_processing")
# The ports of systems and the labels of their pages.
PORTS = [("5122", PERSONNEL), ("5123", FINANCE), ("5124", OPERATIONS), ("5132", PERSONNEL), ("5133", FINANCE), ("5134", OPERATIONS)]
TOPICS = [
    (("住民税", "住民税通知"), "resident_tax_verification"),
    (("給与備考", "控除整備"), "payroll_adjustment"),
    (("社保", "年金", "社保免除", "年金補正"), "insurance_pension_processing"),
    (("入社照合", "手当確認"), "onboarding_verification"),
    (("請求書", "invoice"), "invoice_approval"),
    (("経費精算", "expense"), "expense_processing"),
    (("銀行勘定", "銀行"), "bank_reconciliation"),
    (("支払処理", "支払", "振込"), "payment_processing"),
    (("出荷追跡", "出荷", "追跡"), "shipment_tracking"),
    (("返品処理", "返品"), "return_processing"),
    (("受注処理", "受注"), "order_processing"),
    (("仕入先", "supplier"), "supplier_communication"),
    (("在庫調整", "在庫"), "inventory_adjustment"),
    (("予算差異", "予算"), "budget_variance_analysis"),
    (("育児", "産休"), "leave_application_processing"),
    (("leave-applications",), "leave_application_processing"),
    (("social-insurance",), "insurance_pension_processing"),
    (("onboarding",), "onboarding_verification"),
    (("payroll-items",), "payroll_adjustment"),
    (("resident-tax",), "resident_tax_verification"),
]
# The last resort looks for the words of earlier steps again, codes without numbers included.
KEYWORDS = [
    (("supplier_list",), "supplier_communication"), (("hr_policy",), "leave_application_processing"),
    (("budget_report", "powerpoint"), "budget_variance_analysis"), (("inventory catalog",), "inventory_adjustment"),
    *FORMS, *[((f"{code}-",), label) for code, label in CODES], *DOMAINS, *TOPICS,
]
# The label of each process code of ground truth.
CODE_LABELS = {
    "A": "resident_tax_verification",
    "B": "payroll_adjustment",
    "C": "leave_application_processing",
    "D": "insurance_pension_processing",
    "E": "onboarding_verification",
    "F": "invoice_approval",
    "G": "expense_processing",
    "H": "bank_reconciliation",
    "I": "budget_variance_analysis",
    "J": "payment_processing",
    "K": "order_processing",
    "L": "inventory_adjustment",
    "M": "supplier_communication",
    "N": "shipment_tracking",
    "O": "return_processing",
}


def code_label(code: Column) -> Column:
    """The label of a ground-truth process code; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CODE_LABELS.items() for x in kv]), code)


def rules() -> list[tuple[str, str, str, str]]:
    """(text, word, needed, label) in order: the first whose text holds the word, and all of whose words hold ``needed``, counts."""
    out = [("primary", w, "", label) for words, label in TITLES for w in words]
    out += [("full", w, "", label) for words, label in FORMS for w in words]
    out += [("codes", f"{code}-", "", label) for code, label in CODES]
    out += [("full", w, "", label) for words, label in DOMAINS for w in words]
    for port, labels in PORTS:
        for route, label in zip(ROUTES, labels):
            out += [("full", f"{port}/#/{route}", port, label), ("urls", f"#/{route}", port, label)]
    return out + [(text, w, "", label) for text in ("primary", "urls") for words, label in KEYWORDS for w in words]


def _live_rules() -> list[tuple[str, str, str, str]]:
    """``rules`` without those that cannot be the first: a word not found in the full text is in no part of it."""
    out: list[tuple[str, str, str, str]] = []
    absent: set[str] = set()
    for where, word, needed, found in rules():
        if word not in absent:
            out.append((where, word, needed, found))
        if where == "full" and not needed:
            absent.add(word)
    return out


def predict_label(primary: Column, urls: Column) -> Column:
    """The label of a context: ``primary`` joins titles and texts, ``urls`` the addresses.

    The first rule that holds ends the search. Rules that need a port are asked only where the text has it, and codes are
    extracted only where no earlier rule holds, from texts with a hyphen before a digit. Words without ASCII are looked for in what is left of a
    text without ASCII, which is short where texts are addresses. The texts are bound once, by a transform of an array of one element; its
    body is not compiled, as a CASE of all rules would outgrow a compiled method.
    """
    p, u = F.lower(F.coalesce(primary, F.lit(""))), F.lower(F.coalesce(urls, F.lit("")))

    def first(tests: list[tuple[Column, str]]) -> Column:
        case = F
        for test, found in tests:
            case = case.when(test, F.lit(found))
        return case

    def step(t: Column, where: str, needed: str, block: list[tuple[str, str, str, str]]) -> Column:
        if where == "codes":
            joined = F.array_join(F.regexp_extract_all(t["full"], F.lit(rf"(?iU)\b(?:{'|'.join(c for c, _ in CODES)})-\d"), F.lit(0)), " ")
            named = F.get(F.transform(F.array(joined), lambda c: first([(c.contains(word), found) for _, word, _, found in block])), F.lit(0))
            return F.when(t["full"].rlike(r"(?U)-\d"), named)
        found = first([(t[f"wide_{at}" if not any(c.isascii() for c in word) else at].contains(word), label) for at, word, _, label in block])
        return F.when(t["full"].contains(needed), found) if needed else found

    def search(t: Column) -> Column:
        blocks = groupby(_live_rules(), key=lambda r: (r[0] == "codes", r[2]))
        steps = [step(t, "codes" if codes else "", needed, list(block)) for (codes, needed), block in blocks]
        return F.coalesce(*steps, F.lit(UNKNOWN))

    def wide(t: Column) -> Column:
        own, addresses = (F.regexp_replace(t[at], r"[\x00-\x7F]+", " ") for at in ("primary", "urls"))
        return F.struct(t["primary"].alias("primary"), t["urls"].alias("urls"), F.concat_ws(" ", t["primary"], t["urls"]).alias("full"), own.alias("wide_primary"), addresses.alias("wide_urls"))

    def whole(t: Column) -> Column:
        return F.struct(*[t[c].alias(c) for c in ("primary", "urls", "full", "wide_primary", "wide_urls")], F.concat_ws(" ", t["wide_primary"], t["wide_urls"]).alias("wide_full"))

    texts = F.array(F.struct(p.alias("primary"), u.alias("urls")))
    return F.get(F.transform(F.transform(F.transform(texts, wide), whole), search), F.lit(0))


def predict_label_sql(primary: str, urls: str) -> str:
    p, u = f"lower(coalesce({primary}, ''))", f"lower(coalesce({urls}, ''))"
    text = {"primary": p, "urls": u, "full": f"({p} || ' ' || {u})"}

    def test(where: str, word: str, needed: str) -> str:
        if where == "codes":
            return f"regexp_matches({text['full']}, '\\b{word}\\d+')"
        return f"contains({text[where]}, '{word}')" + (f" AND contains({text['full']}, '{needed}')" if needed else "")

    return "CASE " + " ".join(f"WHEN {test(t, w, n)} THEN '{x}'" for t, w, n, x in rules()) + f" ELSE '{UNKNOWN}' END"


def portal_label(portal: Column, titles: Column) -> Column:
    """A coarse label: that of the portal, else the slug of the first title that is no browser's."""
    slugs = F.transform(F.filter(titles, lambda t: ~t.contains("Chrome") & (F.length(t) > 3)), lambda t: F.lower(slug(t)))
    case = F.when(portal == PORTALS[0], "hr_process").when(portal == PORTALS[1], "finance_process").when(portal == PORTALS[2], "ops_process")
    return case.otherwise(F.coalesce(F.get(F.filter(slugs, lambda s: s != ""), F.lit(0)), F.lit(UNKNOWN)))


def python_hook(find: Callable[[dict], str]) -> Callable[[Column], Column]:
    """A hook for ``hooked_label`` from a function of a context (a dict); where it fails or gives no string, it gives null."""

    @F.pandas_udf("string")
    def found(contexts: pd.DataFrame) -> pd.Series:
        def one(context: dict) -> str | None:
            try:
                label = find(context)
            except Exception:  # noqa: BLE001 - a label that cannot be found is no reason to end the job
                return None
            return label if isinstance(label, str) else None

        return pd.Series([one(c) for c in contexts.to_dict("records")], dtype="object")

    return found


def hooked_label(context: Column, portal: Column, titles: Column, hook=None, fall_back: bool = False) -> Column:
    """The label that ``hook`` (a Column function of the context that gives null on failure, as those of ``python_hook`` do) finds, without
    white space around it and cut to 64 characters; else that of the portal, if ``fall_back``; else unknown."""
    found = F.nullif(stripped(hook(context)), F.lit("")) if hook is not None else F.lit(None).cast("string")
    return F.coalesce(F.substring(found, 1, 64), portal_label(portal, titles) if fall_back else F.lit(UNKNOWN))

"""Policies over purchase-order requests and expense claims, as column expressions: one row in, one decision out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCALATED, APPROVED = "ESCALATED_TO_MANAGER", "AUTO_APPROVED"
CATEGORIES = {
    "entertainment": "Entertainment & Dining", "travel_transit": "Travel & Transit", "supplies": "Office Supplies", "general": "General Corporate Expense",
}


def one_digit(x: Column) -> Column:
    """One digit after the point, halves to even, no thousands separators."""
    return F.call_function("format_number", x, F.lit("0.0"))


def whole(x: Column) -> Column:
    return F.format_number(x, 0)


def text(*parts: Column | str) -> Column:
    """Columns and strings joined; null counts as nothing."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def decide(df: DataFrame, reasons: list[Column], approved: Column, held, actions: tuple[str, str]) -> DataFrame:
    """Adds status, action, reason and comment: rows for which any of ``reasons`` is not null are escalated."""
    found = df.withColumn("_why", F.array_compact(F.array(*reasons)))
    reason = F.when(F.size("_why") > 0, F.array_join("_why", "; "))
    out = found.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNotNull(), ESCALATED).otherwise(APPROVED))
    out = out.withColumn("action", F.when(F.col("reason").isNotNull(), actions[0]).otherwise(actions[1]))
    return out.withColumn("comment", F.when(F.col("reason").isNotNull(), held(F.col("reason"))).otherwise(approved)).drop("_why")


def supplier_policy(requests: DataFrame, most_qty_pct: float = 25.0, most_price_pct: float = 5.0, most_days: int = 5) -> DataFrame:
    """Decisions on requests (po_id, vendor_name, request_type, original_qty, requested_qty, unit_price, price_change_pct, delivery_date_shift_days)."""
    old, new, pct, days = (F.col(c) for c in ("original_qty", "requested_qty", "price_change_pct", "delivery_date_shift_days"))
    variance = F.when(old > 0, F.abs(new - old) / old * 100.0).otherwise(0.0)
    reasons = [
        F.when(variance > most_qty_pct, text("Quantity variance (", one_digit(variance), f"%) exceeds auto-approval threshold ({most_qty_pct}%)")),
        F.when(pct > most_price_pct, text("Price increase (", one_digit(pct), f"%) exceeds standard limit ({most_price_pct}%)")),
        F.when(days > most_days, text("Delivery delay (", days, f" days) exceeds auto-tolerance ({most_days} days)")),
    ]
    vendor, po, kind = F.btrim("vendor_name"), F.col("po_id"), F.col("request_type")
    line = lambda mark, *rest: text(f"[{mark}] Vendor: ", vendor, " | PO: ", po, " - ", *rest)
    ok = lambda *rest: line("AUTO-APPROVED", *rest)
    quantity = F.when(new == old, ok("Quantity confirmed (No Change in Quantity).")).otherwise(
        ok("Quantity change request approved. (Original: ", old, " -> Requested: ", new, ")")
    )
    revised = F.col("unit_price") * (1.0 + pct / 100.0)
    price = F.when(pct == 0, ok("Unit price confirmed (No Change in Price).")).otherwise(
        ok("Price revision approved (", F.when(pct > 0, "+").otherwise(""), one_digit(pct), "%, revised unit price: ~¥", whole(revised), ").")
    )
    approved = (
        F.when(kind == "quantity_change", quantity)
        .when(kind == "price_revision", price)
        .when(kind.isin("item_specification_change", "spec_change", "product_spec_change"), ok("Item specification change registered successfully."))
        .when(kind.isin("quality_certificate_request", "cert_request", "certificate_request"), ok("Quality certificate request issued successfully."))
        .when(kind.isin("none", "no_request", "nothing"), line("CONFIRMED - NO CHANGE", "No change requested. Standard contract terms active."))
        .otherwise(ok("Supplier communication processed successfully."))
    )
    held = lambda why: text(
        "[HOLD / APPROVAL REQUIRED] Attention Manager | Vendor: ", F.col("vendor_name"), " | PO: ", po, ". Reason: ", why, ". Department Manager review required."
    )
    return decide(requests, reasons, approved, held, ("Escalated for human procurement review", "Auto-dispatched vendor confirmation"))


def expense_policy(claims: DataFrame, per_head: float = 10_000.0, travel: float = 30_000.0, supplies: float = 50_000.0) -> DataFrame:
    """Decisions on claims (claim_id, employee_id, employee_name, department, expense_category, amount, attendee_count, has_receipt)."""
    amount, category = F.col("amount"), F.col("expense_category")
    attendees = F.greatest(F.col("attendee_count"), F.lit(1))
    each = amount / attendees
    yen = lambda x: f"¥{x:,.0f}"
    fun = category == "entertainment"
    reasons = [
        F.when(~F.coalesce("has_receipt", F.lit(False)), "Official receipt is missing (receipt verification required)"),
        F.when(fun & (each > per_head), text("Per-head entertainment expense (¥", whole(each), f") exceeds corporate policy limit ({yen(per_head)}/head)")),
        F.when(fun & (F.col("attendee_count") <= 0), "Attendee count must be at least 1"),
        F.when((category == "travel_transit") & (amount > travel), text("Domestic travel expense (¥", whole(amount), f") exceeds auto-approval threshold ({yen(travel)})")),
        F.when((category == "supplies") & (amount > supplies), text("Office supplies purchase (¥", whole(amount), f") exceeds auto-approval threshold ({yen(supplies)})")),
    ]
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), category), F.lit("Expense Claim"))
    who, claim = F.btrim("employee_name"), F.col("claim_id")
    ok = lambda *rest: text("[ACCOUNTING APPROVED] Claimant: ", who, " (", F.col("employee_id"), ") | Claim ID: ", claim, " | Category: ", label, " | Amount: ¥", whole(amount), *rest)
    approved = (
        F.when(fun, ok(" (", attendees, " attendees, ¥", whole(each), "/person). Within corporate entertainment policy limit. Auto-reimbursement and ledger journal entry completed."))
        .when(category == "travel_transit", ok(". Within travel policy limit. Auto-reimbursement completed."))
        .otherwise(ok(". Fully compliant with corporate expense regulations. Journal posting completed."))
    )
    held = lambda why: text(
        "[FINANCIAL HOLD / APPROVAL REQUIRED] Claimant: ", who, " (", F.col("employee_id"), " / ", F.col("department"), ") | Claim ID: ", claim,
        " | Amount: ¥", whole(amount), " (", label, "). Reason: ", why, ". Department Director approval required.",
    )
    return decide(claims, reasons, approved, held, ("Escalated for Department Manager Financial Sign-off", "Auto-reimbursed and posted to General Ledger (ERP)"))


def supplier_audit(requests: DataFrame, most_qty_pct: float = 25.0, most_price_pct: float = 5.0, most_days: int = 5) -> DataFrame:
    """po_id, the audited values and whether each rule is passed."""
    old, new = F.col("original_qty"), F.col("requested_qty")
    variance = F.when(old > 0, F.abs(new - old) / old * 100.0).otherwise(0.0)
    return requests.select(
        "po_id", variance.alias("quantity_variance_pct"), (variance <= most_qty_pct).alias("quantity_passed"), (F.col("price_change_pct") <= most_price_pct).alias("price_passed"),
        (F.col("delivery_date_shift_days") <= most_days).alias("delivery_passed"),
    )


def expense_audit(claims: DataFrame, per_head: float = 10_000.0, travel: float = 30_000.0, supplies: float = 50_000.0) -> DataFrame:
    """claim_id, the amount per head, whether there is a receipt and whether the category's limit is kept (true where there is none)."""
    amount, kind = F.col("amount"), F.col("expense_category")
    each = amount / F.greatest(F.col("attendee_count"), F.lit(1))
    limit = F.when(kind == "entertainment", each <= per_head).when(kind == "travel_transit", amount <= travel).when(kind == "supplies", amount <= supplies).otherwise(True)
    return claims.select("claim_id", each.alias("per_head_amount"), F.coalesce("has_receipt", F.lit(False)).alias("receipt_passed"), limit.alias("limit_passed"))


def stamped(decisions: DataFrame) -> DataFrame:
    """``decisions`` with the time at which they were made: rows of an audit log."""
    return decisions.withColumn("processed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))


def scorecard(decisions: DataFrame) -> DataFrame:
    """n_processed, n_approved, n_escalated and the straight-through rate in percent."""
    approved = F.count_if(F.col("status") == APPROVED)
    out = decisions.agg(F.count("*").alias("n_processed"), approved.alias("n_approved"), F.count_if(F.col("status") == ESCALATED).alias("n_escalated"))
    return out.withColumn("straight_through_pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("n_approved"), F.col("n_processed")), F.lit(0.0)), 1))

"""Segmentation, labels, mining, evaluation, policies."""

from worktrace.operators.label import hooked_label, portal_label, predict_label
from worktrace.operators.policy import expense_audit, expense_policy, scorecard, supplier_audit, supplier_policy
from worktrace.operators.segment import Rules, candidate_windows, idle_context, idle_segments, merged_segments, peaks, rule_context, rule_segments, with_context

__all__ = [
    "Rules", "candidate_windows", "expense_audit", "expense_policy", "hooked_label", "idle_context", "idle_segments", "merged_segments", "peaks", "portal_label", "predict_label",
    "rule_context", "rule_segments", "scorecard", "supplier_audit", "supplier_policy", "with_context",
]

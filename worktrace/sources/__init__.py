"""Readers and writers."""

from worktrace.sources.sessions import complete_sessions, event_files, ground_truth_log, manifests, predictions, segments, session_chunks
from worktrace.sources.telemetry import quirk_policy, read_sessions

__all__ = ["complete_sessions", "event_files", "ground_truth_log", "manifests", "predictions", "quirk_policy", "read_sessions", "segments", "session_chunks"]

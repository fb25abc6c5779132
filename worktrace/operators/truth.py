"""Executions and boundaries of ground-truth manifests (session_id, manifest)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.functions.columns import iso_to_ms


def executions(manifests: DataFrame) -> DataFrame:
    """One row per execution, with its process; times may be null."""
    processes = manifests.select("session_id", F.posexplode("manifest.processes").alias("p_no", "p"))
    rows = processes.select("session_id", "p_no", "p", F.posexplode("p.executions").alias("e_no", "e"))
    return rows.select(
        "session_id", (F.col("p_no").cast("long") * 2**31 + F.col("e_no")).alias("no"), "p.code", F.coalesce("p.family_name", F.lit("")).alias("family_name"),
        F.coalesce("p.domain", F.lit("")).alias("domain"), F.coalesce("e.variant", F.lit("?")).alias("variant"), F.coalesce("e.exec_id", F.lit("")).alias("exec_id"),
        F.coalesce("e.apps", F.array().cast("array<string>")).alias("apps"),
        F.nullif("e.start_ts", F.lit("")).alias("start_ts"), F.nullif("e.end_ts", F.lit("")).alias("end_ts"),
        iso_to_ms(F.nullif("e.start_ts", F.lit(""))).alias("start_ms"), iso_to_ms(F.nullif("e.end_ts", F.lit(""))).alias("end_ms"),
    )


def true_boundaries(manifests: DataFrame) -> DataFrame:
    """session_id, timestamp_ms, ts_iso, code, family_name and kind of every start and end that is there."""
    e = executions(manifests)
    kinds = F.array(*[F.struct(F.col(f"{k}_ms").alias("timestamp_ms"), F.col(f"{k}_ts").alias("ts_iso"), F.lit(k).alias("kind")) for k in ("start", "end")])
    rows = e.select("session_id", "code", "family_name", F.explode(kinds).alias("b")).where("b.timestamp_ms is not null")
    return rows.select("session_id", "b.timestamp_ms", "b.ts_iso", "code", "family_name", "b.kind")


def true_executions(manifests: DataFrame) -> DataFrame:
    """session_id, code, family_name, exec_id, start_ms and end_ms of executions that have both times."""
    return executions(manifests).where("start_ms is not null and end_ms is not null").select("session_id", "code", "family_name", "exec_id", "start_ms", "end_ms")


def expected_boundaries(manifests: DataFrame, kinds: tuple[str, ...] = ("process_started", "process_resumed")) -> DataFrame:
    """session_id and timestamp_ms of the boundaries of some kinds that a manifest expects."""
    rows = manifests.select("session_id", F.explode("manifest.expected_boundaries").alias("b")).where(F.col("b.type").isin(*kinds))
    return rows.select("session_id", iso_to_ms(F.col("b.ts")).alias("timestamp_ms"))


def execution_stats(manifests: DataFrame) -> DataFrame:
    """Per process code: executions with both times, those that never end, total, least and greatest duration, sessions."""
    e = executions(manifests).where("start_ms is not null")
    d, whole = F.col("end_ms") - F.col("start_ms"), F.col("end_ms").isNotNull()
    return e.groupBy("code").agg(
        F.count_if(whole).alias("exec_count"), F.count_if(~whole).alias("null_end_count"), F.coalesce(F.sum(d), F.lit(0)).alias("total_ms"), F.min(d).alias("min_ms"),
        F.max(d).alias("max_ms"), F.count_distinct(F.when(whole, F.col("session_id"))).alias("sessions_count"),
    )


def value_counts(manifests: DataFrame, column: str) -> DataFrame:
    """Per code: how often ended executions have each variant, or each of their apps."""
    e = executions(manifests).where("start_ms is not null and end_ms is not null")
    value = F.explode("apps") if column == "apps" else F.col(column)
    return e.select("code", value.alias("value")).groupBy("code", "value").agg(F.count("*").alias("n"))


def executions_per_session(manifests: DataFrame) -> DataFrame:
    """session_id and how many executions with both times it has, 0 included."""
    n = true_executions(manifests).groupBy("session_id").agg(F.count("*").alias("n"))
    return manifests.select("session_id").join(n, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("n"))

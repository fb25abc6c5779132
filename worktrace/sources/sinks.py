"""Writers of results: JSON lines by Spark, one small JSON document by the driver through Spark's file systems, and models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace.functions.columns import ms_to_iso
from worktrace.operators.trees import Trees


def deliverable(segments: DataFrame) -> DataFrame:
    """session_id, start, end (to the second) and label, as text."""
    return segments.select("session_id", ms_to_iso(F.col("start_ms")).alias("start"), ms_to_iso(F.col("end_ms")).alias("end"), "label")


def write_segments(segments: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Deliverable segments as JSON lines, by session and time over all files in their order."""
    deliverable(segments).orderBy("session_id", "start", "end").write.mode(mode).json(path)


def write_lines(rows: DataFrame, path: str, *order: str, mode: str = "errorifexists") -> None:
    """Boundaries, decisions and other rows as JSON lines."""
    (rows.orderBy(*order) if order else rows).write.mode(mode).json(path)


def write_document(spark: SparkSession, content, path: str) -> None:
    """A JSON document, indented, its parent folders made; for what is small by its kind, as a row for each label."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(json.dumps(content, ensure_ascii=False, indent=2).encode()))
    stream.close()


def write_ranking(ranking: DataFrame, path: str) -> None:
    """The ranking (a row for each label) as a JSON array."""
    write_document(ranking.sparkSession, [r.asDict() for r in ranking.orderBy("rank").drop("rank", "apps_count").collect()], path)


def write_evaluation(sessions: DataFrame, purity: DataFrame, histogram: DataFrame, macro: DataFrame, path: str) -> None:
    """Macro averages and label consistency as a document, and the sessions' scores as JSON lines beside it (``.sessions``)."""
    scores = macro.first().asDict()
    labels = {r["label"]: r["purity"] for r in purity.select("label", "purity").collect()}  # a row for each label
    codes = {r["label"]: r["codes"] for r in histogram.collect()}
    consistency = {"label_to_codes": codes, "label_purities": labels, "macro_purity": sum(labels.values()) / len(labels) if labels else 0.0}
    document = {"label_consistency": consistency, "macro_boundary_f1": scores["boundary_f1"], "macro_segment_f1": scores["segment_f1"]}
    write_document(sessions.sparkSession, document, path)
    sessions.orderBy("session_id").write.mode("overwrite").json(path + ".sessions")


def save_model(model: PipelineModel, path: str, about: dict) -> None:
    """The model, and what is to be known ``about`` it (names, metrics) as JSON beside it."""
    model.write().overwrite().save(path)
    write_document(SparkSession.active(), about, path.rstrip("/") + ".json")


def save_trees(model: Trees, path: str, about: dict) -> None:
    """Boundary trees as a JSON document, and what is to be known ``about`` them beside it."""
    write_document(SparkSession.active(), json.loads(model.to_json()), path)
    write_document(SparkSession.active(), about, path.removesuffix(".json") + ".about.json")


def load_trees(spark: SparkSession, path: str) -> Trees | None:
    """The trees at ``path``; none if there are none or they cannot be read."""
    try:
        return Trees.from_json(spark.read.text(path, wholetext=True).first()["value"])
    except Exception:  # noqa: BLE001 - whatever is wrong with them, the rules take over
        return None


def load_model(path: str) -> PipelineModel | None:
    """The model at ``path``; none if there is none or it cannot be read."""
    try:
        return PipelineModel.load(path)
    except Exception:  # noqa: BLE001 - whatever is wrong with it, the rules take over
        return None

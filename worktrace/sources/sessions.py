"""Files of sessions besides their events: ground truth, predictions, segments, results and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from worktrace.functions.columns import iso_to_ms, ms_of_file_name, session_of_path
from worktrace.operators.label import UNKNOWN

def _fields(types: dict[str, str], sign: str) -> str:
    return ", ".join(f"{name}{sign} {kind}" for name, kind in types.items())


EXECUTION = dict.fromkeys(("code", "variant", "case_id", "exec_id", "start_ts", "end_ts"), "string")
EXECUTION |= {"apps": "array<string>", "phase": "int", "seq": "int", "continues_from_prev": "boolean", "continues_to_next": "boolean"}
PROCESS = dict.fromkeys(("code", "family_name", "domain"), "string") | {"executions": f"array<struct<{_fields(EXECUTION, ':')}>>"}
MANIFEST = {
    "schema_version": "string", "run_id": "string", "session": "struct<start_ts: string, end_ts: string>",
    "processes": f"array<struct<{_fields(PROCESS, ':')}>>", "expected_boundaries": "array<struct<ts: string, type: string>>",
}
REQUEST = (
    "po_id string, vendor_id string, vendor_name string, request_type string, item_code string, original_qty int, requested_qty int, "
    "unit_price double, price_change_pct double, delivery_date_shift_days int, memo string"
)
PREDICTION = "session_id string, start string, end string, label string"


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in any file system of Spark's, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or [])


def session_chunks(spark: SparkSession, session_dir: str) -> list[str]:
    """The chunk folders of a session that hold events, by name; a missing folder and a file raise as Python's own listing does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise FileNotFoundError(session_dir)
    if not system.getFileStatus(path).isDirectory():
        raise NotADirectoryError(session_dir)
    return [x.rpartition("/")[0] for x in _files(spark, f"{session_dir}/chunk*/events.jsonl")]


def event_files(spark: SparkSession, session_dir: str) -> list[str]:
    return [f"{chunk}/events.jsonl" for chunk in session_chunks(spark, session_dir)]


def _variants(spark: SparkSession, path: str) -> DataFrame:
    """path, block, line_no and v of the lines of JSON-lines files that are objects."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")
    )
    parsed = lines.withColumn("v", F.try_parse_json("line"))
    return parsed.where(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))


def ground_truth_log(spark: SparkSession, dataset_dir: str) -> DataFrame:
    """Records of ``ses_*/gt.jsonl`` in file order (block, line_no); malformed lines are left out, absent logs give no rows."""
    get = lambda path: F.try_variant_get("v", f"$.{path}", "string")
    names = {"event": "event", "ts_utc": "ts_utc", "process_code": "process_code", "process_name": "process_name", "case_id": "case_id", "from_code": "from", "to_code": "to"}
    if not _files(spark, f"{dataset_dir}/ses_*/gt.jsonl"):
        return spark.createDataFrame([], "session_id string, block long, line_no long, " + ", ".join(f"{n} string" for n in names))
    rows = _variants(spark, f"{dataset_dir}/ses_*/gt.jsonl")
    return rows.select(session_of_path(F.col("path")).alias("session_id"), "block", "line_no", *[get(path).alias(n) for n, path in names.items()])


def manifests(spark: SparkSession, dataset_dir: str) -> DataFrame:
    """session_id and manifest: that of a session's own ``gt_manifest.json``, else the one in ``ground_truth_manifests.json``.

    A malformed manifest raises; a malformed collection counts as none.
    """
    kind = f"struct<{_fields(MANIFEST, ':')}>"
    none = spark.range(0).select(F.lit("").alias("session_id"), F.lit(None).cast(kind).alias("manifest"))
    own = cached = none
    if _files(spark, f"{dataset_dir}/ses_*/gt_manifest.json"):
        read = spark.read.schema(_fields(MANIFEST, "")).option("multiLine", True).option("mode", "FAILFAST").json(f"{dataset_dir}/ses_*/gt_manifest.json")
        own = read.select(session_of_path(F.col("_metadata.file_path")).alias("session_id"), F.struct(*MANIFEST).alias("manifest"))
    if _files(spark, f"{dataset_dir}/ground_truth_manifests.json"):
        text = spark.read.text(f"{dataset_dir}/ground_truth_manifests.json", wholetext=True)
        parsed = F.from_json("value", f"map<string, {kind}>")
        cached = text.select(F.explode(parsed).alias("session_id", "manifest")).where("manifest is not null")
    cached = cached.select(F.col("session_id").alias("cached_id"), F.col("manifest").alias("cached"))
    both = own.join(cached, F.col("session_id") == F.col("cached_id"), "full")
    return both.select(F.coalesce("session_id", "cached_id").alias("session_id"), F.coalesce("manifest", "cached").alias("manifest"))


def complete_sessions(manifest_rows: DataFrame, log: DataFrame) -> DataFrame:
    """Sessions that have both a manifest and a log."""
    return manifest_rows.select("session_id").distinct().join(log.select("session_id").distinct(), "session_id")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """session_id, start_ms, end_ms, label ('' if missing), in file order; malformed and incomplete records are left out, times that are none raise."""
    get = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    rows = _variants(spark, path).select("block", "line_no", *[get(n).alias(n) for n in ("session_id", "start", "end", "label")])
    rows = rows.where("session_id <> '' and start <> '' and end <> ''")
    return rows.select("session_id", iso_to_ms(F.col("start")).alias("start_ms"), iso_to_ms(F.col("end")).alias("end_ms"), F.coalesce("label", F.lit("")).alias("label"), "block", "line_no")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Deliverable segments for mining, with ``seen``, their place in the files; a malformed line raises."""
    rows = spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"))
    return rows.select("session_id", iso_to_ms(F.col("start")).alias("start_ms"), iso_to_ms(F.col("end")).alias("end_ms"), F.coalesce("label", F.lit(UNKNOWN)).alias("label"), place.alias("seen"))


def segment_table(spark: SparkSession, path: str) -> DataFrame:
    """Deliverable segments with start_dt, end_dt and duration_s; empty if the file is absent."""
    if not _files(spark, path):
        rows = spark.createDataFrame([], PREDICTION)
    else:
        rows = spark.read.schema(PREDICTION).json(path)
    out = rows.withColumn("start_dt", F.to_timestamp("start")).withColumn("end_dt", F.to_timestamp("end"))
    return out.withColumn("duration_s", (F.unix_millis("end_dt") - F.unix_millis("start_dt")) / 1000)


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of a JSON array of results; none if the file is absent."""
    return spark.read.option("multiLine", True).json(path) if _files(spark, path) else None


def supplier_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of a JSON array; a key that no request has raises."""
    known = StructType.fromDDL(REQUEST).names
    unknown = sorted(set(spark.read.option("multiLine", True).json(path).columns) - set(known))
    if unknown:
        raise TypeError(f"unknown keys: {', '.join(unknown)}")
    return spark.read.schema(REQUEST).option("multiLine", True).option("mode", "FAILFAST").json(path)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, session_id and timestamp_ms of screenshots below ``folder``; frames are ordered by path. Their vectors come from outside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "scr_smart_*").load(folder)
    return files.select("path", session_of_path(F.col("path")).alias("session_id"), ms_of_file_name(F.col("path")).alias("timestamp_ms"))


def vision_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """session_id and timestamp_ms of the frames that a detector wrote (boundary_detected_at is the frame's path)."""
    rows = spark.read.schema("boundary_detected_at string, similarity_score double").json(path)
    at = F.col("boundary_detected_at")
    return rows.select(session_of_path(at).alias("session_id"), ms_of_file_name(at).alias("timestamp_ms")).where("timestamp_ms is not null")

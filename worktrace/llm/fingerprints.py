"""Document fingerprints: improbable-feature digests in chained Bloom filters.

The features of a text are its windows of ``WINDOW`` UTF-8 bytes. A window's entropy, in thousandths of the most possible,
has a rank by how rare it is among all windows of the corpus; windows of very low entropy (repeated bytes) are not ranked. Of every
``WINDOW`` neighbouring windows the rarest scores a point; features with enough points go into a chain of Bloom filters
of 2048 bits and up to 160 features. The likeness of two digests is the mean, over the filters of the shorter chain, of the
best bit overlap, normalised so that the overlap expected by chance counts 0 and a contained filter 1.

A text too short for a window is one feature; an empty or null text has no filter, is like another such text (1) and
unlike the rest (0). Very long texts have long chains. Rows of one id follow each other in the order of their texts; null
ids come first. The last document is followed by the first one, in an empty table by none; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.common import splitmix, stored

WINDOW = 32
LEAST_POINTS = 8
LEAST_ENTROPY = 100
BITS = 2048
FEATURES = 160
HASHES = 5
_UNRANKED = 1 << 20
# c * log2(c) in whole units, so that sums are exact in any order
_TERMS = np.round(np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 1)]) * 2**20).astype(np.int64)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of every window of ``data`` (uint8), 0 to 1000; empty if it is shorter than a window."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int64)
    order = np.argsort(data, kind="stable")
    keys = data[order].astype(np.int64) * (n + WINDOW) + order
    right = np.searchsorted(keys, keys + WINDOW - 1, "right")
    place = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    ahead[order] = right - place  # equal bytes in the window that begins with a byte
    behind[order] = place - np.cumsum(np.bincount(right, minlength=n + 1))[:n] + 1  # and in the one that ends with it
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _TERMS[np.bincount(data[:WINDOW])].sum()
    leaves = _TERMS[ahead[: n - WINDOW] - 1] - _TERMS[ahead[: n - WINDOW]]
    comes = _TERMS[behind[WINDOW:]] - _TERMS[behind[WINDOW:] - 1]
    total[1:] = total[0] + np.cumsum(leaves + comes)
    most = int(_TERMS[WINDOW])
    return (most - total) * 1000 // most


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank by entropy, 0 for the rarest in ``counts`` (1001 numbers of windows)."""
    ranks = np.empty(1001, np.int64)
    ranks[np.lexsort((np.arange(1001), counts))] = np.arange(1001)
    ranks[:LEAST_ENTROPY] = _UNRANKED
    return ranks


def features(data: bytes, ranks: np.ndarray) -> np.ndarray:
    """64-bit hashes of the selected features, in order of place, each once."""
    if not data:
        return np.empty(0, np.uint64)
    x = np.frombuffer(data, np.uint8)
    rank = ranks[entropies(x)]
    if not len(rank):
        return np.array([int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")], np.uint64)
    best = (rank << 32) | np.arange(len(rank))
    width = min(WINDOW, len(rank))
    have = 1
    while have < width:  # minima of doubling widths
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    points = np.bincount(best & 0xFFFFFFFF, minlength=len(rank))
    points[rank == _UNRANKED] = 0
    chosen = np.flatnonzero(points >= LEAST_POINTS)
    if not len(chosen):
        chosen = np.flatnonzero(points == points.max())[:1]
    parts = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[chosen]
    h = np.zeros(len(chosen), np.uint64)
    for column in np.ascontiguousarray(parts).view(np.uint64).T:
        h = splitmix(h ^ column)
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters, one row of bits each."""
    n = -(-len(hashes) // FEATURES)
    bits = np.zeros((n, BITS), np.uint8)
    row = np.arange(len(hashes)) // FEATURES
    for i in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return bits


def encoded(bits: np.ndarray) -> str:
    return f"{len(bits)}:{base64.b64encode(np.packbits(bits, axis=1).tobytes()).decode()}"


def decoded(digest: str) -> np.ndarray:
    n, _, data = digest.partition(":")
    return np.unpackbits(np.frombuffer(base64.b64decode(data), np.uint8).reshape(int(n), BITS // 8), axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1, of two chains."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0 if len(b) else 1.0
    overlap = a.astype(np.float32) @ b.astype(np.float32).T
    in_a, in_b = a.sum(axis=1, dtype=np.float64)[:, None], b.sum(axis=1, dtype=np.float64)[None, :]
    least = np.minimum(in_a, in_b)
    chance = in_a * in_b / BITS
    floor = chance + 0.3 * (least - chance)
    return float(np.clip((overlap - floor) / np.maximum(least - floor, 1e-9), 0, 1).max(axis=1).mean())


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks by the entropies of all windows of all texts; 1001 counts reach the driver."""

    def run(batches):
        counts = np.zeros(1001, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text := text.as_py():
                    counts += np.bincount(entropies(np.frombuffer(text.encode(), np.uint8)), minlength=1001)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["entropy", "n"])

    counts = np.zeros(1001, np.int64)
    for r in docs.select("text").mapInArrow(run, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect():
        counts[r["entropy"]] = r["n"]
    return rarity(counts)


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc_id, text: str, own: np.ndarray, next_text: str, next_own: np.ndarray, ranks: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = (text[: len(text) - half] + next_text[:half]).encode()
    bits = filters(features(edited, ranks))
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), encoded(own), encoded(bits), likeness(own, bits), likeness(own, next_own))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row, for use as a digest alone."""
    ranks = corpus_ranks(docs)

    def run(batches):
        for batch in batches:
            digests = [encoded(filters(features((t.as_py() or "").encode(), ranks))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def fingerprints_with_next(docs: DataFrame) -> DataFrame:
    """Every document with its fingerprint, that of an edited text (its last half replaced from the next document), and
    the likenesses of its own to both.

    Documents are sorted by ranges of ids, so that the next one is the next row of a task. The last row of a task
    waits for the first row of the next task; these two of each task are all that is joined later.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranks = corpus_ranks(docs)
    edge_names, edge_types = [*_COLUMNS, "edge", "task", "text"], [*_TYPES, pa.int32(), pa.int32(), pa.string()]

    def batch_of(rows, names, types):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        task = TaskContext.get().partitionId()
        before = None
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                own = filters(features(text.encode(), ranks))
                if before is None:
                    rows.append((doc_id, len(text), None, encoded(own), None, None, None, 1, task, text))
                else:
                    rows.append((*_compared(*before, text, own, ranks), 0, task, None))
                before = (doc_id, text, own)
                if len(rows) >= 200:
                    yield batch_of(rows, edge_names, edge_types)
                    rows = []
        if before is not None:
            doc_id, text, own = before
            rows.append((doc_id, len(text), None, encoded(own), None, None, None, 2, task, text))
            yield batch_of(rows, edge_names, edge_types)

    found = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _SCHEMA + ", edge int, task int, text string")
    found = stored(found, "fingerprints")
    tasks = sorted(r["task"] for r in found.where("edge = 1").select("task").collect())
    if not tasks:
        return found.select(*_COLUMNS)
    follows = docs.sparkSession.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1])), "task int, follower int")
    last = found.where("edge = 2").select("task", "doc_id", "text", "fingerprint").join(follows, "task")
    first = found.where("edge = 1").select(F.col("task").alias("follower"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))

    def resolve(batches):
        for batch in batches:
            rows = [_compared(i, t, decoded(f), nt, decoded(nf), ranks) for i, t, f, nt, nf in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield batch_of(rows, _COLUMNS, _TYPES)

    resolved = last.join(first, "follower").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(resolve, _SCHEMA)
    return found.where("edge = 0").select(*_COLUMNS).unionAll(resolved)

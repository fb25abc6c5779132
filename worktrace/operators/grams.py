"""Character n-grams of texts, counted where the texts are: a word is cut once a task, and no (text, gram) pair moves."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StringType, StructType

SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
KEPT_WORDS, KEPT_LENGTH, KEPT_GRAMS, ROWS = 20_000, 64, 200_000, 500


def cutter(low: int = 1, high: int = 3) -> Callable[[str | None], dict[str, int]]:
    """A function that counts the runs of ``low`` to ``high`` characters of a text's words, each padded with a space on either side."""
    known: dict[str, Counter] = {}

    def of(word: str) -> Counter:
        found = known.get(word)
        if found is None:
            p = f" {word} "
            found = Counter(p[i : i + k] for k in range(low, high + 1) for i in range(max(len(p) - k + 1, 1)))
            if len(word) <= KEPT_LENGTH:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                known[word] = found
        return found

    def cut(text: str | None) -> dict[str, int]:
        counts: dict[str, int] = {}
        for word, n in Counter(SPACE.split(text or "")).items():
            if word:
                for gram, k in of(word).items():
                    counts[gram] = counts.get(gram, 0) + n * k
        return counts

    return cut


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _lists(lengths: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def _pairs(name: str, kind: DataType) -> ArrayType:
    return ArrayType(StructType().add("gram", StringType()).add(name, kind))


def word_bag(text: Column) -> Column:
    """The words of a text in lower case and in order: texts of one bag have the same grams."""
    return F.array_join(F.array_sort(F.array_remove(F.split(F.lower(text), r"\s+"), "")), " ")


def gram_set(text: str | None, low: int, high: int) -> set[str]:
    """The distinct grams of a text. Those that hold two spaces lie over the end of a word and are none: the caller drops them."""
    p = "".join([f" {word} " for word in set(SPACE.split(text or "")) if word])
    runs, out = p, set()
    for k in range(1, high + 1):
        if k > 1:
            runs = list(map(add, runs, p[k - 1 :]))
        if k >= low:
            out.update(runs)
    return out


def gram_documents(documents: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """gram and n_documents, the number of rows of ``documents`` (text) that hold it; ``high`` is 3 at most, as long as the shortest word is
    with its spaces."""
    if high > 3:
        return gram_totals(documents, low, high).select("gram", "n_documents")

    def run(batches):
        held: Counter[str] = Counter()

        def out():
            found = [(g, n) for g, n in held.items() if "  " not in g]
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["gram", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(gram_set(text.as_py(), low, high))
                if len(held) >= KEPT_GRAMS:
                    yield out()
                    held.clear()
        yield out()

    parts = documents.select(F.lower("text").alias("text")).mapInArrow(run, "gram string, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n_documents"))


def gram_totals(documents: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """gram, total and n_documents: how often it stands in the rows of ``documents`` (text, and copies where a row stands for many), and in
    how many of them."""

    def run(batches):
        cut, total, held = cutter(low, high), Counter(), Counter()

        def out():
            columns = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([held[g] for g in total], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["gram", "total", "n_documents"])

        for batch in batches:
            for text, copies in zip(batch.column(0), batch.column(1).to_pylist()):
                for gram, n in cut(text.as_py()).items():
                    total[gram] += n * copies
                    held[gram] += copies
                if len(total) >= KEPT_GRAMS:
                    yield out()
                    total.clear(), held.clear()
        yield out()

    copies = F.col("copies") if "copies" in documents.columns else F.lit(1)
    parts = documents.select(F.lower("text").alias("text"), copies.cast("long").alias("copies")).mapInArrow(run, "gram string, total long, n_documents long")
    return parts.groupBy("gram").agg(F.sum("total").alias("total"), F.sum("n_documents").alias("n_documents"))


def gram_lists(documents: DataFrame, key: str, low: int = 1, high: int = 3) -> DataFrame:
    """key and grams (gram, count) of each row of ``documents`` (``key``, text)."""

    def run(batches):
        cut = cutter(low, high)
        for batch in _slices(batches):
            counts = [cut(text) for text in batch.column(1).to_pylist()]
            grams, numbers = pa.array([g for c in counts for g in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())
            lists = _lists([len(c) for c in counts], pa.StructArray.from_arrays([grams, numbers], ["gram", "count"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "grams"])

    lean = documents.select(F.col(key).alias("key"), F.lower("text").alias("text"))
    return lean.mapInArrow(run, StructType([lean.schema["key"]]).add("grams", _pairs("count", LongType())))


def weigher(grams: list[str], idf: list[float]) -> Callable[[str | None], tuple[np.ndarray, np.ndarray]]:
    """A function that gives the places of a text's known grams, ascending, and their weights: count times idf, of unit length."""
    cut, place, scale = cutter(), {g: i for i, g in enumerate(grams)}, np.array(idf)
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def of(word: str) -> tuple[np.ndarray, np.ndarray]:
        found = known.get(word)
        if found is None:
            own = [(place[g], n) for g, n in cut(word).items() if g in place]
            found = np.array([i for i, _ in own], np.int32), np.array([n for _, n in own], np.float64)
            if len(word) <= KEPT_LENGTH:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                known[word] = found
        return found

    def weights(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        parts = [(of(word), n) for word, n in Counter(SPACE.split(text or "")).items() if word]
        if not parts or not len(scale):
            return np.empty(0, np.int32), np.empty(0)
        counts = np.bincount(np.concatenate([at for (at, _), _ in parts]), np.concatenate([c if n == 1 else c * n for (_, c), n in parts]), len(scale))
        at = np.flatnonzero(counts)
        raw = counts[at] * scale[at]
        return at.astype(np.int32), raw / np.sqrt((raw * raw).sum()) if len(raw) else raw

    return weights


def weight_lists(documents: DataFrame, key: str, grams: list[str], idf: list[float]) -> DataFrame:
    """key and weights (gram, weight) of the known ``grams`` of each row of ``documents`` (``key``, text)."""

    def run(batches):
        weights, names = weigher(grams, idf), pa.array(grams, pa.string())
        for batch in _slices(batches):
            found = [weights(text) for text in batch.column(1).to_pylist()]
            places, values = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            lists = _lists([len(at) for at, _ in found], pa.StructArray.from_arrays([names.take(pa.array(places)), pa.array(values)], ["gram", "weight"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "weights"])

    lean = documents.select(F.col(key).alias("key"), F.lower("text").alias("text"))
    return lean.mapInArrow(run, StructType([lean.schema["key"]]).add("weights", _pairs("weight", DoubleType())))


def with_features(documents: DataFrame, grams: list[str], idf: list[float]) -> DataFrame:
    """``documents`` with ``features``, the sparse vector of the weights of their text's known ``grams``."""

    def run(batches):
        weights = weigher(grams, idf)
        for batch in _slices(batches):
            found = [weights(text) for text in batch.column(batch.num_columns - 1).to_pylist()]
            n, lengths = len(found), [len(at) for at, _ in found]
            places, values = (pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1))
            parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(grams), np.int32)), _lists(lengths, places), _lists(lengths, values)]
            vectors = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=[*batch.schema.names[:-1], "features"])

    lean = documents.drop("features").withColumn("_lower", F.lower("text"))
    return lean.mapInArrow(run, StructType([*lean.schema.fields[:-1]]).add("features", VectorUDT()))

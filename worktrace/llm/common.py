"""What the training-data operators share: word rules, shared storage, mixing hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace.sources.storage import stored  # noqa: F401

#: White space that separates words; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names) -> list[Column]:
    """Columns by name, whatever the names hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def small_side(df: DataFrame, rows: int, limit: int = 20_000) -> DataFrame:
    """Broadcast hint for a side of a known row count below ``limit``; beyond it the plan decides."""
    return F.broadcast(df) if rows <= limit else df


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, over uint64 arrays."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; an absolute path stays as it is."""
    if name.startswith("/"):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache(dict):
    """A dict that computes missing values and starts afresh when it holds ``limit`` entries."""

    def __init__(self, compute, limit: int = 400_000):
        super().__init__()
        self.compute = compute
        self.limit = limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def slices(batch, max_bytes: int = 8 << 20):
    """(ids, texts) lists of an Arrow batch of (doc_id, text), each of about ``max_bytes`` of text at most.

    Only one slice is in Python objects at a time, however large the batch.
    """
    ids: list = []
    texts: list = []
    used = 0
    for doc_id, text in zip(batch.column(0), batch.column(1)):
        ids.append(doc_id.as_py())
        texts.append(text.as_py())
        used += len(texts[-1] or "") + 64
        if used >= max_bytes:
            yield ids, texts
            ids, texts, used = [], [], 0
    if ids:
        yield ids, texts

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pairs are summed in linear time by the identity
sum over f of ((sum v_if x_i)^2 - sum (v_if x_i)^2) / 2. Features are the distinct words and word shapes of a text, hashed, and
its structure: shares of capitals, digits, marks, separators and repeated words and lines, word and text lengths.

It learns from up to ``per_class`` labelled rows of each class, never from held-out ones; labels, lang, source and
doc_id are no features. Null and empty texts are scored by their structure alone; long texts whole; repeated rows alike.
Without labelled rows of both classes every score is 0.5. Further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.common import Cache, slices
from worktrace.llm.learning import held_out, training_rows

PER_CLASS = 2_500
HASH_BITS = 16
FACTORS = 8
STRUCTURE = 14
DIM = (1 << HASH_BITS) + STRUCTURE
_SHAPES = [(re.compile(p), r) for p, r in ((r"[^\W\d_a-z]*[A-Z][^\W\d_a-z]*", "A"), (r"[^\W\dA_]+", "a"), (r"\d+", "0"), (r"(.)\1+", r"\1\1"))]


def _shape(word: str) -> str:
    for pattern, by in _SHAPES:
        word = pattern.sub(by, word)
    return word


def _places(word: str) -> tuple[int, int]:
    mask = (1 << HASH_BITS) - 1
    return xxhash.xxh3_64_intdigest(word.lower()) & mask, xxhash.xxh3_64_intdigest("\0" + _shape(word)) & mask


def _structure(text: str, n_words: int, n_distinct: int) -> list[float]:
    n = max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(text.count, filter(str.isupper, set(text))))
    count = lambda chars: sum(map(text.count, chars)) / n
    return [
        1.0,
        np.log1p(len(text)) / 10,
        np.log1p(n_words) / 10,
        n_words / n * 2,
        upper / n * 2,
        len(re.findall(r"\d", text)) / n * 4,
        min(1.0, count("#*$%&") * 4),
        min(1.0, count("|<>{}\\") * 8),
        min(1.0, count("!?") * 4),
        min(1.0, count(".,") * 8),
        1 - n_distinct / max(n_words, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(x.rstrip()[-1:] not in ".!?" for x in lines) / max(len(lines), 1),
        1.0 if n_words < 20 else 0.0,
    ]


def rows_of(texts: list[str], cache: Cache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat (row, feature, value) of the features of ``texts``."""
    at, where, value = [], [], []
    for r, text in enumerate(texts):
        found = text.split()
        distinct = set(found)
        places = set()
        for w in distinct:
            places.update(cache[w])
        k = len(places)
        at.append(np.full(k + STRUCTURE, r))
        where.append(np.fromiter(places, np.int64, k))
        where.append(np.arange(DIM - STRUCTURE, DIM))
        value.append(np.full(k, 1 / np.sqrt(max(k, 1))))
        value.append(np.array(_structure(text, len(found), len(distinct))))
    return np.concatenate(at), np.concatenate(where), np.concatenate(value)


class Machine:
    def __init__(self, seed: int = 0):
        self.w = np.zeros(DIM, np.float32)
        self.v = (np.random.default_rng(seed).standard_normal((DIM, FACTORS)) * 0.05).astype(np.float32)

    def raw(self, row, feature, value, n):
        vx = self.v[feature] * value[:, None].astype(np.float32)
        sums = np.stack([np.bincount(row, vx[:, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(row, (vx * vx).sum(axis=1), n)
        return np.bincount(row, self.w[feature] * value, n) + ((sums * sums).sum(axis=1) - squares) / 2, sums

    def scores(self, texts: list[str], cache: Cache) -> np.ndarray:
        if not texts:
            return np.empty(0)
        row, feature, value = rows_of(texts, cache)
        return 1 / (1 + np.exp(-np.clip(self.raw(row, feature, value, len(texts))[0], -30, 30)))

    def fit(self, texts: list[str], labels: np.ndarray, rounds: int = 12, rate: float = 0.1, decay: float = 1e-4, size: int = 64) -> Machine:
        """Mini-batches with AdaGrad; a class counts as much as its rows."""
        cache = Cache(_places)
        row, feature, value = rows_of(texts, cache)
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        w2, v2 = np.full(DIM, 1e-3), np.full((DIM, FACTORS), 1e-3)
        rng = np.random.default_rng(1)
        for _ in range(rounds):
            for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // size)):
                span = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in part])
                own = np.repeat(np.arange(len(part)), bounds[part + 1] - bounds[part])
                x, f = value[span], feature[span]
                raw, sums = self.raw(own, f, x, len(part))
                wrong = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]
                used, at = np.unique(f, return_inverse=True)
                slope = wrong[own] * x
                gw = np.bincount(at, slope, len(used)) / len(part) + decay * self.w[used]
                terms = slope[:, None] * (sums[own] - self.v[f] * x[:, None])
                gv = np.stack([np.bincount(at, terms[:, k], len(used)) for k in range(FACTORS)], axis=1) / len(part) + decay * self.v[used]
                w2[used] += gw * gw
                v2[used] += gv * gv
                self.w[used] -= (rate * gw / np.sqrt(w2[used])).astype(np.float32)
                self.v[used] -= (rate * gv / np.sqrt(v2[used])).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    rows = training_rows(docs, labels, "quality", per_class)
    machine = Machine()
    if len({y for _, y in rows}) < 2:
        machine.v[:] = 0
        return machine
    return machine.fit([t for t, _ in rows], np.array([y for _, y in rows], float))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.w, machine.v))  # a fixed number of weights

    def run(batches):
        own, cache = Machine.__new__(Machine), Cache(_places)
        own.w, own.v = shared.value
        for batch in batches:
            for ids, texts in slices(batch, 2 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own.scores([t or "" for t in texts], cache))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

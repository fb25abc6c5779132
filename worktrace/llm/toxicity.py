"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A document is toxic if a sentence is: p = 1 - product of (1 - p_s), noisy-or over its sentences. A sentence's logit is a
low constant and the weights of its words; what the constant alone would give is taken off, so that sentences without a telling
word give nothing, however many there are. A word has the features of its whole lower-case form and of its beginnings of
3 to 7 letters, so that inflected forms count. Weights are trained through the noisy-or from document labels, over the
features that stand out in toxic documents; sentences then tell which of them is to blame.

It learns from up to ``per_class`` labelled rows of each class, never from held-out ones; labels, lang, source and doc_id are no
features. Null and empty texts score 0; long texts whole; repeated rows alike. Without
labelled rows of both classes every text scores 0. Further columns are ignored by ``score`` and kept by ``without_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.common import Cache, slices
from worktrace.llm.learning import held_out, training_rows

PER_CLASS = 3_000
THRESHOLD = 0.7
ROWS = 256  # handed back at a time
BASE = -9.5  # the logit of a sentence without a telling word
BEGINNINGS = range(3, 8)
_END = 1000.0
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_SPLIT = re.compile(r"[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*")


def word_features(word: str) -> tuple[str, ...]:
    """The lower-case word without outer marks, in brackets, and its beginnings."""
    word = _EDGES.sub("", word.lower())
    return (f"<{word}>", *(word[:n] for n in BEGINNINGS if len(word) > n - 1)) if word else ()


def tokens(text: str) -> list[str]:
    """Words, and a line feed for every line's end."""
    return _SPLIT.sub(" \n ", text).split(" ")


def ends_sentence(token: str) -> bool:
    return token == "\n" or token.rstrip("\"')]”’»")[-1:] in (".", "!", "?") and token != ""


def evidence(logits: np.ndarray) -> np.ndarray:
    """-log of not toxic, of sentences by logit, above that of one without a telling word."""
    return np.logaddexp(0, logits) - np.logaddexp(0, BASE)


class Lexicon:
    """Feature weights; ``cache`` has the weight of each word, and ``_END`` more where it ends a sentence, twice for a line feed."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.cache = Cache(self.value, 200_000)

    def value(self, token: str) -> float:
        known = self.weights
        return sum(known.get(f, 0.0) for f in word_features(token)) + (2 * _END if token == "\n" else _END if ends_sentence(token) else 0.0)

    def sentences(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Tokens, the sentence of each, and the logits of the sentences; a line feed belongs to the sentence before it."""
        found = tokens(text)
        v = np.fromiter(map(self.cache.__getitem__, found), float, len(found))
        feeds = v > 1.5 * _END
        ends = v > _END / 2
        v = v - _END * ends - _END * feeds
        ends[:-1] &= ~feeds[1:]
        place = np.cumsum(ends) - ends
        return found, place, BASE + np.bincount(place, v)

    def score(self, text: str) -> float:
        logits = self.sentences(text)[2]
        return float(-np.expm1(-np.maximum(evidence(logits), 0).sum()))

    def located(self, text: str, least: float = 0.5, threshold: float = THRESHOLD) -> list[tuple[int, float, str]]:
        """(place, score, text) of the sentences that score ``least`` or more, and of the fewest that reach ``threshold`` together."""
        found, place, logits = self.sentences(text)
        p = 1 / (1 + np.exp(-logits))
        bounds = np.searchsorted(place, np.arange(len(p) + 1))
        order = np.argsort(-logits, kind="stable")
        so_far = -np.expm1(-np.cumsum(np.maximum(evidence(logits[order]), 0)))
        blamed, reached = p >= least, so_far >= threshold - 1e-9  # sums in another order than the score's
        if reached[-1]:
            blamed[order[: np.argmax(reached) + 1]] = True
        return [(int(i), float(p[i]), " ".join(found[bounds[i] : bounds[i + 1]]).strip()) for i in np.flatnonzero(blamed)]


def telling_features(rows: list[tuple[str, int]]) -> list[str]:
    """Features over-represented in toxic documents, by a likelihood ratio that chance among so many would not reach.

    One document's features are held at a time, and counts only of those that three toxic documents have.
    """
    cache = Cache(word_features, 50_000)
    features = lambda text: {f for t in set(tokens(text)) for f in cache[t]}
    total = [sum(y == c for _, y in rows) for c in (0, 1)]
    toxic: Counter[str] = Counter()
    for text, y in rows:
        if y:
            toxic.update(features(text))
    toxic = {f: n for f, n in toxic.items() if n >= 3}
    names = list(toxic)
    if not names:
        return []
    clean = dict.fromkeys(names, 0)
    for text, y in rows:
        if not y:
            for f in features(text) & clean.keys():
                clean[f] += 1
    base = total[1] / sum(total)
    n0, n1 = np.array([[clean[f] for f in names], [toxic[f] for f in names]], float)
    n = n0 + n1
    log = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / b), 0)
    ratio = 2 * (log(n1, n * base) + log(n0, n * (1 - base)))
    telling = (n1 > n * base) & (ratio > 2 * np.log(len(names)) + 2) & (n1 / n > max(0.6, (1 + base) / 2))
    return sorted(f for f, t in zip(names, telling) if t)


def train(rows: list[tuple[str, int]], rounds: int = 200, rate: float = 0.3, decay: float = 1e-4) -> Lexicon:
    """Adam on the noisy-or likelihood, over sentences by telling features."""
    names = telling_features(rows)
    index = {f: i for i, f in enumerate(names)}
    if not names:
        return Lexicon({})
    cache = Cache(lambda t: tuple(index[f] for f in word_features(t) if f in index), 50_000)
    at, feature, owner = [], [], []
    s = 0
    for d, (text, _) in enumerate(rows):
        known: set[int] = set()
        found = tokens(text)
        for last, t in enumerate(found, 1):
            known.update(cache[t])
            if last == len(found) or ends_sentence(t):
                if known:
                    at += [s] * len(known)
                    feature += sorted(known)
                    owner.append(d)
                    s += 1
                    known = set()
    at, feature, owner = np.array(at), np.array(feature), np.array(owner)
    y = np.array([label for _, label in rows])
    w, m, v = np.full(len(names), 1.0), np.zeros(len(names)), np.zeros(len(names))
    for t in range(1, rounds + 1):
        logit = BASE + np.bincount(at, w[feature], s)
        clean = np.bincount(owner, evidence(logit), len(y))  # -log of no toxic sentence
        p = np.maximum(-np.expm1(-clean), 1e-12)
        slope = np.where(y == 1, -np.exp(-clean) / p, 1.0)[owner] / (1 + np.exp(-logit))
        g = np.bincount(feature, slope[at], len(names)) / len(y) * 100 + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = np.clip(w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), -20, 20)
    return Lexicon({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Lexicon:
    rows = training_rows(docs, labels, "toxic", per_class)
    return train(rows) if len({y for _, y in rows}) == 2 else Lexicon({})


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the sentences to blame where predicted is 1."""
    weights = lexicon.weights  # features of a bounded sample

    def run(batches):
        own = Lexicon(weights)
        for batch in batches:
            for ids, texts in slices(batch):
                scores = [own.score(t or "") for t in texts]
                blamed = [own.located(t or "", threshold=threshold) if p >= threshold else [] for p, t in zip(scores, texts)]
                blamed = pa.array([[{"place": a, "score": b, "text": c} for a, b, c in x] for x in blamed], pa.list_(struct))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores), blamed], names=["doc_id", "score", "sentences"])

    struct = pa.struct([("place", pa.int32()), ("score", pa.float64()), ("text", pa.string())])
    schema = "doc_id long, score double, sentences array<struct<place: int, score: double, text: string>>"
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, in one pass."""
    weights = lexicon.weights
    place = docs.columns.index("text")

    def run(batches):
        own = Lexicon(weights)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):  # so that no second copy of a whole batch is made, here or in the JVM
                part = batch.slice(lo, ROWS)
                keep = [own.score(t.as_py() or "") < threshold for t in part.column(place)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

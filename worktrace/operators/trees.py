"""Gradient-boosted trees by histograms: binned features, best-first growth, balanced weights.

Features are cut into bins at their quantiles over all rows (sketches of bounded size). A model is fitted to all rows: those of the same
bins, label and weight are counted first, and are one row with its number from then on. While there are ``most_rows`` of these at most,
one task of an executor learns from them, since each split depends on the one before; more of them stay dealt over tasks in blocks, and a
job adds up the sums of all leaves that may be split next, which are of one size whatever the rows. Both ways grow the same trees. Of two sibling
leaves only the smaller is added up, the other is the difference to their parent. The leaf of the greatest gain is split first, until a
tree has ``leaves`` of them.
"""

from __future__ import annotations

import heapq
import itertools
import json
import pickle
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.sources.storage import stored

BINS = 255
LEAST_HESSIAN = 1e-3
#: Different rows that one task learns from; more are learned from by all tasks.
MOST_ROWS = 1_000_000
BLOCK_ROWS = 1 << 16
#: Trees after which scores are made anew from the rows, so that the lineage of scores stays short.
LINEAGE = 25
#: Sums of so many tasks are added up on the driver, those of more by tasks first.
FEW_PARTS = 64


@dataclass
class Tree:
    """Nodes by number: feature (-1 for a leaf), the last bin that goes left, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        self.feature[node], self.bin[node] = feature, at
        for side in (self.left, self.right):
            side[node] = len(self.feature)
            for values, new in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                values.append(new)
        return self.left[node], self.right[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, at, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        going = np.arange(len(bins)) if self.feature[0] >= 0 else np.empty(0, np.int64)
        while len(going):
            own = node[going]
            node[going] = np.where(bins[going, feature[own]] <= at[own], left[own], right[own])
            going = going[feature[node[going]] >= 0]
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Trees:
    """A fitted model: names of features, their cuts, the trees and the score that all begin with."""

    names: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]
    base: float

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with p, the probability of the label 1."""
        names, cuts, trees, base = self.names, self.cuts, self.trees, self.base

        def run(batches):
            for batch in batches:
                bins, place = distinct(binned(batch, names, cuts))
                score = np.full(len(bins), base)
                for tree in trees:
                    score += tree.values(bins)
                yield batch.append_column("p", pa.array((1 / (1 + np.exp(-score)))[place]))

        schema = rows.drop("p").schema
        return rows.drop("p").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", p double")

    def to_json(self) -> str:
        return json.dumps({"names": self.names, "cuts": [c.tolist() for c in self.cuts], "base": self.base, "trees": [vars(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Trees:
        d = json.loads(text)
        return cls(d["names"], [np.array(c) for c in d["cuts"]], [Tree(**t) for t in d["trees"]], d["base"])


def binned(batch: pa.RecordBatch, names: Sequence[str], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins (rows x features) of an Arrow batch; null counts as the greatest value."""
    columns = [batch.column(batch.schema.get_field_index(n)).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]
    return np.column_stack([np.searchsorted(c, x) for c, x in zip(cuts, columns)]).astype(np.uint8)


def distinct(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of bins (uint8), and for each row the place of its own among them."""
    if not bins.size:
        return bins[: min(1, len(bins))], np.zeros(len(bins), np.int64)
    rows = np.ascontiguousarray(bins).view(np.dtype((np.void, bins.shape[1]))).ravel()
    _, first, place = np.unique(rows, return_index=True, return_inverse=True)
    return bins[first], place.ravel()


def counted(bins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different rows of (bins, label, weight) and how often each is there."""
    values = np.column_stack([label, weight]).astype(np.float64)
    rows, place = distinct(np.hstack([bins, values.view(np.uint8)]))
    values = np.ascontiguousarray(rows[:, bins.shape[1] :]).view(np.float64)
    return rows[:, : bins.shape[1]].copy(), values[:, 0].copy(), values[:, 1].copy(), np.bincount(place, minlength=len(rows)).astype(float)


def bin_cuts(rows: DataFrame, names: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """The values that end the bins of each feature but the last."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in names], *[F.max(n).alias("_" + n) for n in names]).first()
    return [np.unique([x for x in found[n] or [] if x < found["_" + n]]) for n in names]


def _sums(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, copies: np.ndarray | None = None) -> np.ndarray:
    """Gradients, hessians and counts (3 x feature x bin) of some rows; ``copies`` is how many rows a row stands for."""
    weights = [gradient[rows], hessian[rows], None if copies is None else copies[rows]]
    out = np.empty((3, bins.shape[1], BINS + 1))
    for feature in range(bins.shape[1]):  # one at a time: a row of places for all of them would be 8 bytes each
        at = bins[rows, feature].astype(np.intp)
        out[:, feature] = [np.bincount(at, w, BINS + 1) for w in weights]
    return out


def best_split(sums: np.ndarray, least_rows: int) -> tuple[float, int, int]:
    """(gain, feature, last bin that goes left) of the best split of a node, with gain 0 if there is none."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = sums.sum(axis=2)[:, :, None] - left
    whole = sums[:, 0].sum(axis=1)
    allowed = (left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1], 0.0)
    feature, at = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[feature, at]), int(feature), int(at)


#: A leaf, the feature and the last bin that goes left, the leaves that its rows go to, and the smaller of these.
Split = tuple[int, int, int, int, int, int]


class Part:
    """Rows with gradients and hessians (sums, where a row stands for ``copies`` of them), dealt to the leaves of a growing tree."""

    def __init__(self, bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, copies: np.ndarray | None = None):
        self.bins, self.gradient, self.hessian, self.copies = bins, gradient, hessian, copies
        self.rows = {0: np.arange(len(bins)) if copies is None else np.flatnonzero(copies)}

    def sums(self, leaf: int) -> np.ndarray:
        return _sums(self.bins, self.gradient, self.hessian, self.rows[leaf], self.copies)

    def halves(self, splits: Iterable[Split]) -> list[np.ndarray]:
        self.deal(splits)
        return [self.sums(small) for *_, small in splits]

    def deal(self, splits: Iterable[Split]) -> None:
        for leaf, feature, at, left, right, _ in splits:
            own = self.rows.pop(leaf)
            goes = self.bins[own, feature] <= at
            self.rows |= {left: own[goes], right: own[~goes]}


def best_first(root: np.ndarray, halves: Callable[[list[Split]], Iterable[np.ndarray]], step: float, leaves: int, least_rows: int, ahead: bool = False) -> Tree:
    """A tree from the sums of all its rows; the leaf of the greatest gain is split first, of equal ones the first made.

    ``halves`` deals the rows of leaves to the sides of their splits and gives the sums of the smaller sides. With ``ahead`` a call deals all
    leaves that may be split yet (one that has as many better ones before it as splits are left is not), so that there are fewer
    calls; the tree is the same.
    """
    tree, sums, names, sides = Tree(), {0: root}, {0: 0}, {}
    open_: list[tuple[float, int, int, int]] = []  # (-gain, node, feature, bin)
    new = itertools.count(1)

    def offer(node: int) -> None:
        gain, feature, at = best_split(sums[node], least_rows)
        if gain > 1e-12:
            heapq.heappush(open_, (-gain, node, feature, at))

    def look_ahead() -> None:
        asked = [x for x in sorted(open_)[: leaves - len(sums) if ahead else 1] if x[1] not in sides]
        splits = []
        for _, node, feature, at in asked:
            left, right, counts = next(new), next(new), sums[node][2, feature]
            splits.append((names[node], feature, at, left, right, left if 2 * counts[: at + 1].sum() <= counts.sum() else right))
        for (_, node, *_), (*_, left, right, small), own in zip(asked, splits, halves(splits)):
            other = sums[node] - own
            sides[node] = [(left, own if small == left else other), (right, own if small == right else other)]

    offer(0)
    while open_ and len(sums) < leaves:
        if open_[0][1] not in sides:
            look_ahead()
        _, node, feature, at = heapq.heappop(open_)
        del sums[node]
        for child, (names[child], sums[child]) in zip(tree.split(node, feature, at), sides.pop(node)):
            offer(child)
    for node, own in sums.items():
        gradient, hessian = own[:2, 0].sum(axis=1)
        tree.value[node] = float(-step * gradient / hessian) if hessian > 0 else 0.0
    return tree


def grow(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, step: float, leaves: int, least_rows: int, copies: np.ndarray | None = None) -> Tree:
    """A tree for the gradients and hessians of rows (sums, where a row stands for ``copies`` of them)."""
    part = Part(bins, gradient, hessian, copies)
    return best_first(part.sums(0), part.halves, step, leaves, least_rows)


@dataclass
class Block:
    """Different rows with their numbers in what is learned from and in what is held out, and their scores."""

    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    learned: np.ndarray
    held: np.ndarray
    score: np.ndarray

    @classmethod
    def of(cls, batches: Sequence[pa.RecordBatch], features: int, base: float) -> Block:
        bins = np.frombuffer(b"".join(x for b in batches for x in b.column(0).to_pylist()), np.uint8).reshape(-1, features)
        values = [np.concatenate([b.column(i).to_numpy() for b in batches] or [np.empty(0)]) for i in range(1, 5)]
        return cls(np.asfortranarray(bins), *values, np.full(len(bins), base))

    def plus(self, trees: Iterable[Tree]) -> Block:
        return replace(self, score=reduce(lambda score, tree: score + tree.values(self.bins), trees, self.score))

    def part(self) -> Part:
        p, weight = 1 / (1 + np.exp(-self.score)), self.weight * self.learned
        return Part(self.bins, weight * (p - self.label), weight * p * (1 - p), self.learned)

    def loss(self) -> float:
        """The logistic loss of the rows held out."""
        return float((self.weight * self.held * (np.logaddexp(0, self.score) - self.label * self.score)).sum())


class OneBlock:
    """Rows that one task learns from."""

    ahead = False

    def __init__(self, block: Block):
        self.block = block

    def begin(self, *more: Tree) -> tuple[np.ndarray, float]:
        """The sums of all rows, and the loss, when ``more`` trees are added to the scores."""
        self.block = self.block.plus(more)
        self.part = self.block.part()
        return self.part.sums(0), self.block.loss()

    def halves(self, splits: list[Split]) -> list[np.ndarray]:
        return self.part.halves(splits)


class DealtBlocks:
    """Rows that all tasks learn from: scores are kept in blocks, and a job adds up the sums of the leaves asked for."""

    ahead = True

    def __init__(self, groups: DataFrame, cuts: Sequence[np.ndarray], base: float):
        features = len(cuts)

        def blocks(batches):
            open_ = []
            for batch in batches:
                open_.append(batch)
                if sum(map(len, open_)) >= BLOCK_ROWS:
                    yield pa.RecordBatch.from_pydict({"block": [pickle.dumps(Block.of(open_, features, base))]})
                    open_ = []
            if open_:
                yield pa.RecordBatch.from_pydict({"block": [pickle.dumps(Block.of(open_, features, base))]})

        self.blocks = groups.mapInArrow(blocks, "block binary").rdd.map(lambda row: pickle.loads(row[0]))
        self.scored, self.trees = None, []
        self.cells = np.arange(BINS + 1) <= np.array([[len(c)] for c in cuts])  # what sums of a feature can hold

    def begin(self, *more: Tree) -> tuple[np.ndarray, float]:
        before, self.trees = self.scored, [*self.trees, *more]
        anew = before is None or len(self.trees) % LINEAGE == 0
        start, added, cells = (self.blocks, list(self.trees), self.cells) if anew else (before, more, self.cells)
        self.scored = start.map(lambda block: block.plus(added)).persist(StorageLevel.MEMORY_AND_DISK)
        self.splits: list[Split] = []
        total = self._added(lambda block: np.append(block.part().sums(0)[:, cells], block.loss()))
        if before is not None:
            before.unpersist()
        return self._whole(total[:-1].reshape(1, 3, -1))[0], float(total[-1])

    def halves(self, splits: list[Split]) -> np.ndarray:
        self.splits += splits
        smalls, cells, need, way = [s[-1] for s in splits], self.cells, {s[-1] for s in splits}, []
        for split in reversed(self.splits):  # only those on the way to what is asked for
            if need & {split[3], split[4]}:
                need.add(split[0])
                way.insert(0, split)

        def sums(block: Block) -> np.ndarray:
            part = block.part()
            part.deal(way)
            return np.stack([part.sums(small)[:, cells] for small in smalls])

        return self._whole(self._added(sums))

    def close(self) -> None:
        if self.scored is not None:
            self.scored.unpersist()

    def _added(self, of: Callable[[Block], np.ndarray]) -> np.ndarray:
        def run(blocks):
            total = None
            for block in blocks:
                total = of(block) if total is None else total + of(block)
            return [] if total is None else [total]

        parts = self.scored.mapPartitions(run)
        return parts.treeReduce(np.add, 1 if parts.getNumPartitions() <= FEW_PARTS else 2)

    def _whole(self, sums: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sums), 3, *self.cells.shape))
        out[:, :, self.cells] = sums
        return out


def boosted(rows: OneBlock | DealtBlocks, held: float, rounds: int, step: float, leaves: int, least_rows: int, patience: int = 10) -> list[Tree]:
    """Trees of the logistic loss.

    ``held`` is the weight of the rows that are not learned from: when none of the last ``patience`` trees has made the loss of these
    less than it was before them, no more are made.
    """
    trees: list[Tree] = []
    root, loss = rows.begin()
    losses = [loss / max(held, 1e-12)]
    while len(trees) < rounds:
        trees.append(best_first(root, rows.halves, step, leaves, least_rows, rows.ahead))
        if trees[-1].feature[0] < 0 or len(trees) == rounds:
            break
        root, loss = rows.begin(trees[-1])
        losses.append(loss / max(held, 1e-12))
        if held and len(losses) > patience and min(losses[-patience:]) > losses[-patience - 1] - 1e-7:
            break
    return trees


def counted_rows(rows: DataFrame, names: Sequence[str], cuts: Sequence[np.ndarray], held: float) -> DataFrame:
    """bins, label, weight, learned and held: each different row, and how many of it are learned from and held out.

    Each copy is held out with the chance ``held`` of its own; with equal shares of all rows, loss on what is held out would fall for trees
    that learn noise, too. The seed is the row's hash, so that it does not matter which tasks its copies are in.
    """

    def as_bins(batches):
        for batch in batches:
            y, w = (batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
            bins, y, w, copies = counted(np.ascontiguousarray(binned(batch, names, cuts)), y, w)
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(names)), len(bins), [None, pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([keys.cast(pa.binary()), pa.array(y), pa.array(w), pa.array(copies)], names=["bins", "label", "weight", "copies"])

    def dealt(batches):
        for batch in batches:
            copies, seed = batch.column(3).to_numpy(), batch.column(4).to_numpy().view(np.uint64)
            aside = ((copies == 1) & (seed / 2.0**64 < held)).astype(float)
            for i in np.flatnonzero(copies > 1):
                aside[i] = np.random.default_rng(seed[i]).binomial(int(copies[i]), held)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(copies - aside), pa.array(aside)], names=["bins", "label", "weight", "learned", "held"])

    key, values = ["bins", "label", "weight"], "bins binary, label double, weight double"
    each = rows.mapInArrow(as_bins, f"{values}, copies double").groupBy(*key).agg(F.sum("copies").alias("copies"))
    return each.select(*key, "copies", F.xxhash64(*key).alias("seed")).mapInArrow(dealt, f"{values}, learned double, held double")


def fit_trees(rows: DataFrame, names: Sequence[str], rounds: int = 150, step: float = 0.08, leaves: int = 31, least_rows: int = 20, most_rows: int = MOST_ROWS, held: float = 0.1) -> Trees:
    """A model of all ``rows`` with the features ``names``, a 0/1 ``label`` and a ``weight``; without rows it gives 0.5, with one class no trees.

    More than ``most_rows`` different rows are learned from by all tasks instead of one. Growth ends early as ``boosted`` says.
    """
    names = list(names)
    kept = stored(rows.select(*names, "label", "weight"), "tree-rows")
    cuts = bin_cuts(kept, names)
    groups = stored(counted_rows(kept, names, cuts, held), "tree-groups")
    learned, y = F.col("weight") * F.col("learned"), F.col("label")
    n, one, zero, aside = groups.agg(F.count("*"), F.sum(learned * y), F.sum(learned * (1 - y)), F.sum(F.col("weight") * F.col("held"))).first()
    if not one or not zero:
        return Trees(names, cuts, [], 20.0 if one else -20.0 if zero else 0.0)
    base = float(np.log(one / zero))
    if n > most_rows:
        dealt = DealtBlocks(groups, cuts, base)
        try:
            return Trees(names, cuts, boosted(dealt, aside, rounds, step, leaves, least_rows), base)
        finally:
            dealt.close()

    def fitted(batches):
        trees = boosted(OneBlock(Block.of(list(batches), len(names), base)), aside, rounds, step, leaves, least_rows)
        yield pa.RecordBatch.from_arrays([pa.array([Trees(names, cuts, trees, base).to_json()])], names=["model"])

    alone = groups.repartition(1).sortWithinPartitions("bins", "label", "weight").mapInArrow(fitted, "model string")
    return Trees.from_json(alone.first()["model"])  # one model: rounds x leaves

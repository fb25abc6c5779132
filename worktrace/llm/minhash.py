"""MinHash near-dedup by SuperMinHash signatures, banding, verification on full sets and union-find grouping.

A document's set holds the hashes of its distinct runs of ``shingle`` words; with fewer words, the whole sequence is one.
Documents are linked where the similarity of their sets (intersection by union) reaches ``PERCENT``.

1. Documents with equal sets are one class, spoken for by a text of the smallest id that has the set.
2. SuperMinHash gives each class a signature: every element deals itself, by a permutation of its own, one rank in each
   step; steps stop as soon as no slot can fall further. Bands of the signature are buckets.
3. Each class is compared with the first class and a few random ones of its buckets, on full sets, in groups of one of them
   and up to ``CHUNK`` others. What that links grows together (connected components).
4. Buckets that still hold several components are searched on: members outside a bucket's largest component, in blocks,
   against all others. A block and the members that pass it are bounded, and several tasks share a large bucket; no bucket is
   cut off, each of its pairs is compared or connected. Sizes and a sketch of the signature rule out most pairs; every link
   is confirmed on the full sets, and only links that join two components leave a block, never its pairs.

Two chances can lose a link at the least similarity: no common band, (1 - 0.8**6)**40 = 5e-6, and a sketch of more than
``most_different`` differing bits, about 1e-8 at 46. ``most_different=SKETCH`` compares all pairs of a bucket on full sets.

Null and empty texts have empty sets and are linked with nothing; very long texts are taken whole; rows of one id are
united as if they were copies, and the set of each of them is compared with all others; ties go to the
smaller id; an empty table gives an empty result; further columns do not matter. Ids must be integers and not null:
rows without id are kept as documents of their own, linked with nothing.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.common import Cache, slices, splitmix, stored

SHINGLE = 5
PERCENT = 80
BANDS = 40
ROWS = 6
CHUNK = 64
#: Random members of buckets that each class is compared with, beside the first, before components are formed.
PIVOTS = 6
#: Blocks of a bucket hold so many shingles, on average, and are compared with so many members in one group.
BLOCK_SHINGLES = 400_000
BLOCK_MEMBERS = 2048
#: Of 192 bits, one of each of as many slots, a pair at the least similarity differs in 19.2 on average, with a deviation
#: of 4.2 at most: more than 46 are never seen, so that such pairs need no look at their sets.
SKETCH = 192
MOST_DIFFERENT = 46

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


@lru_cache(maxsize=1)
def _word_hashes() -> Cache:
    return Cache(xxhash.xxh3_64_intdigest, 200_000)


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``n`` words, letters A-Z in lower case."""
    if not text:
        return np.empty(0, np.uint64)
    found = text.encode().lower().split()  # of bytes: ASCII only, for letters as for white space
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, found), np.uint64, len(found))
    if len(h) < n:
        out = np.array([len(h)], np.uint64)
        for x in h:
            out = splitmix(out * _FACTORS[4] + x)
        return out
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total += splitmix(h[i : len(h) - n + 1 + i]) * _FACTORS[i % 4] * np.uint64(2 * (i // 4) + 1)
    return np.unique(splitmix(total))


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (len(sets) x m) of sets of uint64; a row of infinities for an empty set.

    Slot values are j + r: r uniform in [0, 1), j the step in which an element's permutation reached the slot. A set whose
    largest slot is below j cannot gain in step j and stops.
    """
    n = len(sets)
    values = np.full((n, m), np.inf)
    flat = values.reshape(-1)
    elements = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    swaps: list[np.ndarray] = []
    order = None
    for j in range(m):
        going = values.max(axis=1) >= j
        keep = going[owner]
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
            swaps = [k[keep] for k in swaps]
            order = order[keep] if order is not None else None
        if not len(elements):
            break
        z = splitmix(elements + np.uint64((j + 1) * int(_FACTORS[1]) & 0xFFFFFFFFFFFFFFFF))
        rank = (z >> np.uint64(32)).astype(np.float64) * 2.0**-32
        k = (j + (((z & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        if order is None and j < 8:
            slot = k.copy()  # what k held, found by undoing the swaps so far
            for i in range(j - 1, -1, -1):
                slot = np.where(slot == swaps[i], i, slot)
            swaps.append(k)
        else:
            at = np.arange(len(elements))
            if order is None:
                order = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
                for i, s in enumerate(swaps):
                    order[at, s], order[at, i] = order[at, i], order[at, s]
                swaps = []
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[at, j]
            order[at, j] = slot
        np.minimum.at(flat, owner * m + slot, rank + j)
    return values


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, a and b (128 bits of the set), band hashes and sketch of every row of ``docs``."""

    def run(batches):
        for batch in batches:
            at = 0
            for ids, texts in slices(batch, 1 << 19):
                t, at = batch.column(2).slice(at, len(ids)), at + len(ids)
                sets = [shingle_set(t, shingle) for t in texts]
                values = superminhash(sets, bands * rows).view(np.uint64).reshape(len(sets), bands, rows)
                keys = np.arange(bands, dtype=np.uint64) * _FACTORS[0] + np.zeros((len(sets), 1), np.uint64)
                for i in range(rows):
                    keys = splitmix(keys * _FACTORS[2] ^ values[:, :, i])
                sizes = np.array([len(s) for s in sets], np.int64)
                digest = [np.array([splitmix(s).sum(dtype=np.uint64), (splitmix(s ^ _FACTORS[3]) * _FACTORS[2]).sum(dtype=np.uint64)]) for s in sets]
                digest = np.array(digest, np.uint64).reshape(-1, 2).view(np.int64)
                bits = (splitmix(values.reshape(len(sets), -1)[:, :SKETCH]) & np.uint64(1)).astype(np.uint8)
                sketch = np.packbits(bits, axis=1).view(np.int64)
                offsets = pa.array(np.where(sizes > 0, bands, 0).cumsum(), pa.int32())
                offsets = pa.concat_arrays([pa.array([0], pa.int32()), offsets])
                listed = pa.ListArray.from_arrays(offsets, pa.array(keys[sizes > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), t, pa.array(sizes), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), listed]
                    + [pa.array(sketch[:, i].copy()) for i in range(3)],
                    names=["doc_id", "t", "n_shingles", "a", "b", "bands", "s0", "s1", "s2"],
                )
        _word_hashes().clear()  # the worker lives on, and serves other operators

    texts_of = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text"))
    return texts_of.mapInArrow(run, "doc_id long, t long, n_shingles long, a long, b long, bands array<long>, s0 long, s1 long, s2 long")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows (c, x) of ``pairs`` whose full sets are similar enough; ``texts`` has id and text of all of them."""
    chunks = pairs.groupBy("c").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    cut = pairs.join(chunks, "c").withColumn("chunk", F.pmod(F.xxhash64("x"), F.col("chunks")))
    cut = cut.select("c", "x", "chunk")
    members = cut.join(texts, F.col("x") == F.col("id")).select("c", "chunk", "x", "text")
    firsts = cut.select("c", "chunk").distinct().join(texts, F.col("c") == F.col("id")).select("c", "chunk", F.lit(None).cast("long").alias("x"), "text")

    def run(batches):
        group, own = None, None
        for batch in batches:
            c, chunk, x, text = (batch.column(i) for i in range(4))
            out_c, out_x = [], []
            for i, (a, b, m) in enumerate(zip(c.to_pylist(), chunk.to_pylist(), x.to_pylist())):
                s = shingle_set(text[i].as_py(), shingle)
                if m is None:
                    group, own = (a, b), s
                    continue
                if group != (a, b):
                    raise ValueError(f"the text of id {a} is missing")
                small, large = sorted((len(own), len(s)))
                if small * 100 < PERCENT * large:
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= PERCENT * (small + large - both):
                    out_c.append(a)
                    out_x.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(out_c, pa.int64()), pa.array(out_x, pa.int64())], names=["c", "x"])

    grouped = firsts.unionAll(members).repartition("c", "chunk").sortWithinPartitions("c", "chunk", F.col("x").asc_nulls_first())
    return grouped.mapInArrow(run, "c long, x long")


def components(edges: DataFrame) -> DataFrame:
    """id and root (smallest id connected with it) of all ends of ``edges`` (c, x): alternating large and small stars."""
    edges = stored(edges.select(F.greatest("c", "x").alias("u"), F.least("c", "x").alias("v")).where("u > v").distinct(), "star")
    before = None
    while True:
        # large star: larger neighbours of a node move to its smallest neighbour
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stored(large, "large-star")
        # small star: smaller neighbours of a node, and itself, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        moved = large.join(least, F.col("u") == F.col("n"))
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(moved.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = stored(small, "small-star")
        now = edges.agg(F.count("*"), F.coalesce(F.sum("v"), F.lit(0)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (bucket, id, ...) with the component of each id."""
    roots = roots.withColumnRenamed("id", "_id")
    return members.join(roots, F.col("id") == F.col("_id"), "left").withColumn("root", F.coalesce("root", "id")).drop("_id")


def across(dealt: DataFrame, shingle: int = SHINGLE, most_different: int = MOST_DIFFERENT) -> DataFrame:
    """Links (c, x) between components, found block by block.

    ``dealt`` has bucket, chunk, salt, asked, id, root and a member's n, sketch, bands and text. Rows with ``asked`` are a
    block; the others of its group stream past it. A pair is looked at in the first of its common buckets only, if its
    components have not met in this group yet, and if the sketches allow it; intersections are those of full sets.
    """

    def run(batches):
        sets, kept = {}, 0

        def set_of(i, text):
            nonlocal kept
            if i not in sets:
                if kept > 4_000_000:
                    sets.clear()
                    kept = 0
                sets[i] = shingle_set(text, shingle)
                kept += len(sets[i])
            return sets[i]

        group, block = None, None
        for batch in batches:
            bucket, chunk, salt, asked, ids, roots, sizes = (batch.column(i).to_pylist() for i in range(7))
            sketch = np.column_stack([batch.column(i).to_numpy() for i in range(7, 10)]).view(np.uint64)
            bands = batch.column(10).flatten().to_numpy().reshape(len(ids), -1)
            text = batch.column(11)
            out_c, out_x = [], []
            for i, key in enumerate(zip(bucket, chunk, salt)):
                if key != group:
                    group, block = key, Block(key[0], most_different)
                if asked[i]:
                    block.add(ids[i], roots[i], sizes[i], sketch[i], bands[i], text[i].as_py())
                    continue
                for c in block.links(ids[i], roots[i], sizes[i], sketch[i], bands[i], text[i], set_of):
                    out_c.append(c)
                    out_x.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_c, pa.int64()), pa.array(out_x, pa.int64())], names=["c", "x"])

    grouped = dealt.repartition("bucket", "chunk", "salt").sortWithinPartitions("bucket", "chunk", "salt", F.desc("asked"))
    columns = ["bucket", "chunk", "salt", "asked", "id", "root", "n", "s0", "s1", "s2", "bands", "text"]
    return grouped.select(*columns).mapInArrow(run, "c long, x long")


class Block:
    """Members of a bucket that others are compared with."""

    def __init__(self, bucket: int, most_different: int = MOST_DIFFERENT):
        self.bucket, self.most_different = bucket, most_different
        self.rows: list[tuple] = []
        self.met: dict[int, int] = {}
        self.ids = self.tokens = None

    def add(self, *row) -> None:
        self.rows.append(row)

    def links(self, i, root, size, sketch, bands, text, set_of):
        """Ids of the block whose components the member ``i`` joins with its own, one for each."""
        if self.ids is None:
            if not self.rows:
                return
            ids, self.roots, sizes, sketches, listed, self.texts = zip(*self.rows)
            self.ids, self.sizes, self.sketches, self.bands = np.array(ids), np.array(sizes), np.array(sketches), np.array(listed)
            self.labels = np.array([self.met.setdefault(r, r) for r in self.roots])
            self.rows.clear()
        own = self.met.setdefault(root, root)
        open_ = np.flatnonzero(self.labels != own)
        if not len(open_):
            return
        differ = np.bitwise_count(self.sketches[open_] ^ sketch).sum(axis=1)
        small, large = np.minimum(self.sizes[open_], size), np.maximum(self.sizes[open_], size)
        open_ = open_[(differ <= self.most_different) & (small * 100 >= large * PERCENT)]
        common = self.bands[open_] == bands
        open_ = open_[bands[common.argmax(axis=1)] == self.bucket] if len(open_) else open_
        if not len(open_):
            return
        if self.tokens is None:
            sets = [set_of(j, t) for j, t in zip(self.ids.tolist(), self.texts)]
            tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            order = np.argsort(tokens, kind="stable")
            self.tokens, self.owners = tokens[order], owners[order]
        s = set_of(i, text.as_py())
        low, n = np.searchsorted(self.tokens, s), np.searchsorted(self.tokens, s, "right")
        n = n - low
        places = np.repeat(low - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owners[places], minlength=len(self.ids))[open_]
        for j in open_[100 * both >= PERCENT * (size + self.sizes[open_] - both)]:
            own = self.met[root]
            other = self.labels[j]
            if other != own:
                self.labels[self.labels == other] = own
                for r, label in self.met.items():
                    if label == other:
                        self.met[r] = own
                yield int(self.ids[j])


def similar_classes(classes: DataFrame, docs: DataFrame, united: DataFrame, shingle: int = SHINGLE, most_different: int = MOST_DIFFERENT) -> DataFrame:
    """id and root of the classes (id, doc_id and t of a text, bands, n, s0, s1, s2) that are connected with others, or by ``united`` (c, x)."""
    buckets = classes.select("id", F.explode("bands").alias("bucket"))
    first = buckets.groupBy("bucket").agg(
        F.min("id").alias("first"), F.min_by("id", F.xxhash64("id", "bucket")).alias("pivot"), F.count("*").alias("members")
    )
    members = stored(buckets.join(first.where("members > 1"), "bucket").select("bucket", "id", "first", "pivot"), "buckets")
    wanted = classes.join(members.select("id").distinct(), "id", "left_semi")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    texts = own.join(wanted.select("doc_id", "t"), ["doc_id", "t"], "left_semi").groupBy("doc_id", "t").agg(F.min("text").alias("text"))
    details = stored(wanted.join(texts, ["doc_id", "t"]).drop("doc_id", "t"), "bucket-members")

    centres = members.groupBy(F.col("id").alias("x")).agg(F.min("first").alias("first"), F.sort_array(F.collect_set("pivot")).alias("pivots"))
    centres = centres.select(F.explode(F.array_union(F.array("first"), F.slice("pivots", 1, PIVOTS))).alias("c"), "x")
    tried = centres.where("c != x").select(F.least("c", "x").alias("c"), F.greatest("c", "x").alias("x"))
    links = stored(verified(stored(tried.distinct(), "pairs"), details.select("id", "text"), shingle).unionAll(united), "links")

    now = labelled(members.select("bucket", "id"), components(links))
    sizes = now.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    opened = now.join(largest.select("bucket", F.col("top.root").alias("top")), "bucket").join(details.select("id", "n"), "id")
    opened = stored(opened.select("bucket", "id", "n", "root", (F.col("root") != F.col("top")).alias("outside")), "open")
    parts = opened.groupBy("bucket").agg(
        F.ceil(F.sum(F.when(F.col("outside"), F.col("n"))) / BLOCK_SHINGLES).alias("chunks"), F.ceil(F.count("*") / BLOCK_MEMBERS).alias("salts")
    )
    cut = opened.join(parts, "bucket")
    chunk, salt = F.pmod(F.xxhash64("id"), F.col("chunks")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("salts"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = cut.where("outside").select("bucket", chunk.alias("chunk"), every("salts").alias("salt"), F.lit(True).alias("asked"), "id", "root")
    others = cut.select("bucket", every("chunks").alias("chunk"), salt.alias("salt"), F.lit(False).alias("asked"), "id", "root")
    found = stored(across(asked.unionAll(others).join(details, "id"), shingle, most_different), "links")
    return components(links.unionAll(found))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most_different: int = MOST_DIFFERENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest id of a component) of every row of ``docs``."""
    s = stored(signatures(docs, shingle), "signatures")
    digest = ["n_shingles", "a", "b"]
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    full = s.where(linkable)
    # Equal sets have equal bands and sketches. The table is written, so that the numbers of its classes stay.
    classes = full.groupBy(*digest).agg(F.min(F.struct("doc_id", "t")).alias("text"), *[F.first(c).alias(c) for c in ("bands", "s0", "s1", "s2")])
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "text.doc_id", "text.t", *digest, "bands", "s0", "s1", "s2"), "classes")

    sets = F.struct(*digest)
    several = full.groupBy("doc_id").agg(F.min(sets).alias("least"), F.max(sets).alias("most")).where("least != most").select("doc_id")
    shared = full.select("doc_id", *digest).join(several, "doc_id").join(classes.select("id", *digest), digest).select("doc_id", "id").distinct()
    united = shared.join(shared.groupBy("doc_id").agg(F.min("id").alias("c")), "doc_id").where("c != id").select("c", F.col("id").alias("x"))

    compared = classes.select("id", "doc_id", "t", "bands", F.col("n_shingles").alias("n"), "s0", "s1", "s2")
    rooted = labelled(classes.select("id", "doc_id", *digest), similar_classes(compared, docs, united, shingle, most_different))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(smallest, "root").select(*digest, "component_id")
    out = full.select("doc_id", *digest).join(named, digest).select("doc_id", "n_shingles", "component_id")
    alone = s.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

"""SimHash near-dedup: exact tiled comparison of 64-bit fingerprints with exclusive-or and bit counts.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles, repeats included. With
fewer words than a shingle, the whole sequence is one; without words the fingerprint is zero and is linked like any other.
Documents are linked where fingerprints differ in ``RADIUS`` bits or fewer.

1. Equal fingerprints are one class, spoken for by the smallest id; copies are gone after a combined aggregation.
2. Fingerprints that differ in at most r bits agree in at least two of r + 2 blocks of bits. So classes are dealt by the values
   of each two blocks, which loses no pair; tiles are filled in the order of population counts from classes that agree so.
3. Within a tile, and between tiles of one deal whose population counts lie within the radius, all fingerprints are compared by
   exclusive-or and bit counts; other tile pairs are skipped. A deal that fills one tile is compared where it is read; tiles of a larger
   one are written out and paired, and the pairs are dealt over tasks.
4. Of the links in a pair of tiles those go on that join two groups not yet joined there: at most one for each row.

Null and empty texts have the fingerprint zero; very long texts are taken whole, in pieces; ties go to the smaller id; an empty
table gives an empty result; further columns do not matter. Rows of one id all come back, with the fingerprints of their own texts;
the component of each is that of its fingerprint. Rows without id have a component where a row with an id shares it, else none (null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.common import slices, stored
from worktrace.llm.minhash import components

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 2048
#: So many shingles are hashed at a time.
PIECE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits of a text, letters A-Z in lower case."""
    found = text.encode().lower().split() if text else []  # of bytes: ASCII only, for letters as for white space
    if not found:
        return 0
    joined = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(found) - shingle + 1)
    starts, ends = starts[:last].tolist(), ends[min(shingle, len(found)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, last, PIECE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + PIECE], ends[at : at + PIECE])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > last).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and bits (the fingerprint as a long) of every row."""

    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch, 1 << 20):
                bits = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bits)], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, bits long")


def deals(radius: int = RADIUS) -> list[int]:
    """Masks of each two of radius + 2 blocks of the 64 bits."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int).tolist()
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def joining_links(bits: np.ndarray, others: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked fingerprints, within a tile or between two, that join groups not joined before."""
    inside = others is None
    if inside and len(bits) <= 256 and (np.bitwise_count(bits[:, None] ^ bits) <= radius).sum() == len(bits):
        return np.empty(0, np.int64), np.empty(0, np.int64)  # most deals of few fingerprints
    both = bits if inside else np.concatenate([bits, others])
    group = np.arange(len(both))
    out_i, out_j = [], []
    for i in range(len(bits)):
        first = i + 1 if inside else len(bits)
        near = np.flatnonzero(np.bitwise_count(both[first:] ^ both[i]) <= radius) + first
        for j in near[group[near] != group[i]].tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out_i.append(i)
                out_j.append(j)
    return np.array(out_i, np.int64), np.array(out_j, np.int64)


class Deal:
    """The rows of one deal as they stream by; no more than a tile of them is held."""

    def __init__(self, name: tuple[int, int], tile: int):
        self.name, self.tile, self.part, self.size, self.held = name, tile, 0, 0, []

    def add(self, bits: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        """Takes rows in, and gives out tiles that are full and not the deal's only one."""
        self.held.append((bits, ids))
        self.size += len(bits)
        while self.size > self.tile:
            yield self.packed()

    def packed(self) -> tuple:
        bits, ids = (np.concatenate(a) for a in zip(*self.held))
        self.held, self.size, self.part = [(bits[self.tile :], ids[self.tile :])], max(0, len(bits) - self.tile), self.part + 1
        bits, ids = bits[: self.tile], ids[: self.tile]
        counts = np.bitwise_count(bits)
        return (None, None, *self.name, self.part, int(counts.min()), int(counts.max()), bits.tobytes() + ids.tobytes())


def tiles(dealt: DataFrame, radius: int, tile: int) -> DataFrame:
    """Of ``dealt`` (deal, key, bits, id; sorted by deal, key and population count): the links (c, x) of deals that fill one tile,
    and the tiles (deal, key, part, low, high, packed) of the others."""
    fields = [("c", pa.int64()), ("x", pa.int64()), ("deal", pa.int64()), ("key", pa.int64()), ("part", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("packed", pa.binary())]
    schema = pa.schema(fields)

    def run(batches):
        now: Deal | None = None
        c: list[np.ndarray] = []
        x: list[np.ndarray] = []

        def closed(deal: Deal | None) -> Iterator[tuple]:
            if deal is None or not deal.size:
                return
            if deal.part:
                yield deal.packed()
            elif deal.size > 1:
                bits, ids = (np.concatenate(a) for a in zip(*deal.held))
                i, j = joining_links(bits, None, radius)
                c.append(ids[i])
                x.append(ids[j])

        def written(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if c:
                one, other = np.concatenate(c), np.concatenate(x)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(other), *[pa.nulls(len(one), t) for _, t in fields[2:]]], schema=schema)
                c.clear()
                x.clear()
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, fields)], schema=schema)

        for batch in batches:
            deal, key, bits, ids = (batch.column(i).to_numpy() for i in range(4))
            if not len(deal):
                continue
            bits, rows = bits.view(np.uint64), []
            starts = np.flatnonzero(np.concatenate([[True], (deal[1:] != deal[:-1]) | (key[1:] != key[:-1])]))
            ends = np.append(starts[1:], len(deal))
            counted = ends - starts > 1
            counted[[0, -1]] = True  # others may belong to rows of the next batch, or of the one before
            for a, b in zip(starts[counted].tolist(), ends[counted].tolist()):
                name = (int(deal[a]), int(key[a]))
                if now is None or now.name != name:
                    rows += closed(now)
                    now = Deal(name, tile)
                rows += now.add(bits[a:b], ids[a:b])
            yield from written(rows)
        yield from written(list(closed(now)))

    return dealt.mapInArrow(run, "c long, x long, deal long, key long, part long, low int, high int, packed binary")


def linked_tiles(pairs: DataFrame, radius: int) -> DataFrame:
    """Links (c, x) of rows (one, other) of packed tiles; of a tile with itself where both are the same."""

    def run(batches):
        for batch in batches:
            for one, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits, ids = np.frombuffer(one, np.uint64).reshape(2, -1)
                more, others = (None, ids) if other is None else np.frombuffer(other, np.uint64).reshape(2, -1)
                i, j = joining_links(bits, more, radius)
                names = ids if other is None else np.concatenate([ids, others])
                yield pa.RecordBatch.from_arrays([pa.array(names[i].view(np.int64)), pa.array(names[j].view(np.int64))], names=["c", "x"])

    return pairs.mapInArrow(run, "c long, x long")


def similar_fingerprints(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (c, x) of the classes (id, bits), enough to connect all that lie within the radius of one another."""
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = F.array(*[F.lit(signed(m)).cast("long") for m in deals(radius)])
    dealt = classes.select(F.posexplode(masks).alias("deal", "mask"), "bits", "id")
    dealt = dealt.select(F.col("deal").cast("long").alias("deal"), F.col("bits").bitwiseAND(F.col("mask")).alias("key"), "bits", "id")
    ordered = dealt.repartition("deal", "key").sortWithinPartitions("deal", "key", F.bit_count("bits"))
    made = stored(tiles(ordered.select("deal", "key", "bits", "id"), radius, tile), "tiles")
    links = made.where("c is not null").select("c", "x")
    large = made.where("packed is not null")
    one, other = (large.select("deal", "key", *[F.col(c).alias(c + n) for c in ("part", "low", "high", "packed")]) for n in "12")
    near = (F.col("low2") - F.col("high1") <= radius) & (F.col("low1") - F.col("high2") <= radius)
    pairs = one.join(other, ["deal", "key"]).where((F.col("part1") < F.col("part2")) & near).select("deal", "key", "part1", "part2", "packed1", "packed2")
    alone = large.select("deal", "key", F.col("part").alias("part1"), F.col("part").alias("part2"), F.col("packed").alias("packed1"), F.lit(None).cast("binary").alias("packed2"))
    spread = pairs.unionAll(alone).repartition("deal", "key", "part1", "part2").select("packed1", "packed2")
    return links.unionAll(linked_tiles(spread, radius))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(prints.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("id")), "simhash-classes")
    links = stored(similar_fingerprints(classes, radius, tile), "simhash-links")
    # Several fingerprints can have one id as their smallest: such rows are connected through the id.
    roots = components(links).select(F.col("id").alias("_id"), "root")
    named = classes.join(roots, F.col("id") == F.col("_id"), "left").select(F.col("bits").alias("_bits"), F.coalesce("root", "id").alias("component_id"))
    out = prints.join(named, F.col("bits") == F.col("_bits"), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")

"""Best-fit packing of documents into sequences by a linear grouping scheme.

Documents are tokenized, ended by a separator and cut into pieces of at most ``capacity`` tokens. Which piece goes where
depends on lengths alone, so the plan is made from the histogram of lengths, at most ``capacity`` counts whatever the
size of the corpus:

1. Lengths above ``capacity * SMALL`` are dealt in descending order into groups of equal cardinality and rounded up to the
   longest of their group.
2. The rounded instance has few sizes; column generation finds the best mix of configurations of them. Rounded-down
   counts are used, and what remains is packed first-fit.
3. Actual lengths take the places of rounded ones, in runs of equal sequences.
4. Small lengths go, longest first, to the sequences with the least room that holds them.

Pieces then find their places by their rank among equal lengths. Ranks come from counts by (length, salt), so that a
length that many documents share is dealt over many tasks.

Null text: empty, a piece of the separator alone. An empty table gives an empty result. Repeated rows are packed each;
further columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from worktrace.llm.common import slices, stored, tokenizer_file

CAPACITY = 1024
SEPARATOR = 2
SMALL = 1 / 8
GROUPS = 64
TOKENIZER = "byte_bpe_50k.json"
ROWS_PER_SALT = 20_000
MOST_PARTS = 150_000  # encodings that a task keeps, and
MOST_BYTES = 8 << 20  # the characters and bytes of them
SLICE = 1 << 20  # characters split at a time; parts take ten times their length in memory


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, by a ``tokenizers`` file whose pre-tokenizer splits before spaces.

    A byte-level BPE treats a space and what follows it up to the next one alone, unless spaces stand together; parts
    are therefore encoded once and kept, by the same vocabulary in its faster form as ranks. Texts with neighbouring
    spaces, and those that hold an added token of the file, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path.replace(".json", ".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.token_bytes[list(ranks.values())] = [len(t) for t in ranks]
        self.parts: dict[str, bytes] = {}
        self.kept = 0

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, parts: list[str]) -> None:
        """Encodes new parts in one run; ids are dealt to their parts by the bytes they stand for."""
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(parts)), np.uint32)
        ends = np.cumsum(self.token_bytes[ids])
        wanted = np.cumsum([len(x.encode()) + 1 for x in parts])
        at = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[at], wanted):
            found = {x: self.whole(" " + x) for x in parts}
            self.parts |= found
            self.kept += sum(len(x) + len(data) for x, data in found.items())
            return
        data, start = ids.tobytes(), 0
        self.kept += int(wanted[-1]) + len(data)
        for x, stop in zip(parts, ((at + 1) * 4).tolist()):
            self.parts[x] = data[start:stop]
            start = stop

    def forget(self) -> None:
        self.parts.clear()
        self.kept = 0

    def batch(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 64):
            if len(self.parts) > MOST_PARTS or self.kept > MOST_BYTES:
                self.forget()
            own = texts[lo : lo + 64]
            split = [None if "  " in t or t[-1:] == " " or any(x in t for x in self.added) else t.split(" ") for t in own]
            if new := set().union(*(s[1:] for s in split if s)).difference(self.parts):
                self.learn(sorted(new))
            for text, s in zip(own, split):
                if s:
                    first = array("I", self.fast.encode_ordinary(s[0])).tobytes()
                    out.append(first + b"".join([self.parts[x] for x in s[1:]]))
                else:
                    out.append(self.whole(text))
        return out


@lru_cache(maxsize=2)
def _encoder(name: str) -> Encoder:
    return Encoder(tokenizer_file(name))


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """Pieces of ``docs``: doc_id, piece, start, length and ids_crc32. Of a cut document the first piece is the short one."""
    end = np.array([separator], "<u4").tobytes()

    def run(batches):
        encode = _encoder(tokenizer)
        for batch in batches:
            for ids, texts in slices(batch, SLICE):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, data in zip(ids, encode.batch([t or "" for t in texts])):
                    data += end
                    n = len(data) // 4
                    start, stop = 0, (n - 1) % capacity + 1
                    piece = 0
                    while start < n:
                        for column, value in zip(rows, (doc_id, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop]))):
                            column.append(value)
                        piece, start, stop = piece + 1, stop, stop + capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encode.forget()  # the worker lives on, and serves other operators

    kind = docs.schema["doc_id"].dataType
    types = [to_arrow_type(kind), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths in descending order, dealt into groups of equal cardinality: lists of (length, count)."""
    total = sum(counts.values())
    size = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            n = min(left, room)
            out[-1].append((length, n))
            left, room = left - n, room - n
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number of sequences, places by size) that hold ``demand`` items of few ``sizes``: column generation, rounded down,
    then first-fit for the remainder."""
    k = len(sizes)
    s, need = np.array(sizes), np.array(demand, float)
    basis = np.diag([float(capacity // x) for x in sizes])
    columns = [basis[:, j].copy() for j in range(k)]
    amount = need / np.diag(basis)
    for _ in range(40 * k):
        prices = np.linalg.solve(basis.T, np.ones(k))
        # best value by capacity: an unbounded knapsack over few sizes
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(s.min(), capacity + 1):
            fits = np.where(s <= c, value[np.maximum(c - s, 0)] + prices, -1.0)
            j = int(fits.argmax())
            if fits[j] > value[c - 1] + 1e-12:
                value[c], choice[c] = fits[j], j
            else:
                value[c], choice[c] = value[c - 1], -2
        if value[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0 and choice[c] != -1:
            if choice[c] == -2:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= s[choice[c]]
        move = np.linalg.solve(basis, column)
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        amount = amount - ratio[out] * move
        amount[out] = ratio[out]
        amount = np.maximum(amount, 0)
        basis[:, out] = column
        columns[out] = column
    result, left = [], list(demand)
    for n, column in zip(np.floor(amount + 1e-9).astype(int), columns):
        places = [int(x) for x in column]
        n = min([int(n)] + [left[j] // p for j, p in enumerate(places) if p])
        if n > 0:
            result.append((n, places))
            left = [x - n * p for x, p in zip(left, places)]
    while any(left):
        places, room = [0] * k, capacity
        for j in sorted(range(k), key=lambda j: -sizes[j]):
            take = min(left[j], room // sizes[j])
            places[j], room = take, room - take * sizes[j]
        n = min(left[j] // p for j, p in enumerate(places) if p)
        result.append((n, places))
        left = [x - n * p for x, p in zip(left, places)]
    return result


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """(number of sequences, actual lengths in them) that hold all of ``counts`` (length: pieces)."""
    blocks: list[tuple[int, list[int]]] = []
    if counts.get(capacity):
        blocks.append((counts[capacity], [capacity]))
    large = {x: n for x, n in counts.items() if capacity > x > capacity * SMALL and n}
    small = {x: n for x, n in counts.items() if x <= capacity * SMALL and n}
    if large:
        dealt = linear_groups(large, groups)
        queues = [[list(x) for x in g] for g in dealt]
        for n, places in configurations([g[0][0] for g in dealt], [sum(c for _, c in g) for g in dealt], capacity):
            runs = []  # one list of (length, count) for each place, n items each
            for j, p in enumerate(places):
                for _ in range(p):
                    run, want = [], n
                    while want:
                        length, have = queues[j][0]
                        take = min(want, have)
                        run.append([length, take])
                        want -= take
                        queues[j][0][1] -= take
                        if not queues[j][0][1]:
                            queues[j].pop(0)
                    runs.append(run)
            while runs and runs[0]:
                step = min(r[0][1] for r in runs)
                blocks.append((step, [r[0][0] for r in runs]))
                for r in runs:
                    r[0][1] -= step
                    if not r[0][1]:
                        r.pop(0)
    rooms: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    order: list[int] = []

    def put(n: int, lengths: list[int]) -> None:
        room = capacity - sum(lengths)
        if not rooms[room]:
            insort(order, room)
        rooms[room].append((n, lengths))

    for n, lengths in blocks:
        put(n, lengths)
    for x in sorted(small, reverse=True):
        left = small[x]
        while left:
            at = bisect_left(order, x)
            if at == len(order):
                put(-(-left // (capacity // x)), [])
                continue
            room = order[at]
            n, lengths = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
            per = min(room // x, left)
            used = min(n, left // per)
            put(used, lengths + [x] * per)
            if n > used:
                put(n - used, lengths)
            left -= used * per
    return [(n, lengths) for room in rooms.values() for n, lengths in room if lengths]


def places(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of runs, the sequence of each first rank, and the place in its sequences."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for n, lengths in plan:
        offset = 0
        for x in lengths:
            runs[x].append((used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every piece of ``docs`` with its sequence_id and its offset in that sequence."""
    cut = stored(pieces(docs, capacity, tokenizer), "pack-pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(32, sum(counts.values()) // ROWS_PER_SALT)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sums = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    sums = sums.select(F.col("length").alias("_length"), F.col("salt").alias("_salt"), first.alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("own", own).join(sums, (F.col("length") == F.col("_length")) & (F.col("salt") == F.col("_salt")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own")).alias("rank"))
    table = places(make_plan(counts, capacity))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                starts, sequences, offsets = table[int(x)]
                at = np.searchsorted(starts, rank[rows], "right") - 1
                sequence[rows], offset[rows] = sequences[at] + rank[rows] - starts[at], offsets[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

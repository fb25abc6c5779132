"""Repair of the structure of conversations: the cheapest edits, by dynamic programming over a prefix trie of signatures.

A row's fault is the first of: ``blank`` (nothing but white space), ``duplicate`` (role and text of an earlier row of the conversation),
``truncated`` (does not end in one of ``.!?``). Its sign is that of its role (s, u, a, or o for every other) and whether it is
truncated; blank and duplicate rows, which have to go, share one sign. A conversation's signature is its signs in order.

Edits: keep (0), give the role user or assistant (3), delete (4), insert an empty row of user or assistant (3); truncated rows that
stay cost 3 more. Roles have to become nothing, or perhaps a system row and then pairs of user and assistant. Of the cheapest edit
sequences that with the least initials (D, I, K, R) is taken; it also fixes all roles.

Signatures are sorted and inserted into a prefix trie, whose path to the signature at hand is all that is held. A layer of the
dynamic program (for each state of the role pattern the least cost and edits) belongs to a node, so that it is made once
for all signatures that share the prefix; answers are given out where signatures end, for all conversations of that signature.

Rows stream through tasks in order, and a conversation of any length is never held: what is kept of it are its signature (a byte a
row), the layers of one path, and the edits that the result returns anyway. Its digest is made row by row.

Null roles and texts count as one space; a null turn sorts first and does not count in gaps; rows of equal turns are in the order of
role and then of the text's SHA-256; repeated rows are duplicates; an empty role, and a role of another initial, cannot stay as it is;
rows without conversation id are one conversation without id; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Signs of rows: roles, then truncated ones, then those that have to go.
SIGNS = "suaoSUAOx"
#: States of the role pattern: nothing yet, after system, after user, after assistant; only the first and the last may end it.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INSERTED = ("u", "u", "a", "u")
ENDS = (0, 3)
ROLES = {"s": "system", "u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"

#: A layer: for each state that can be reached, (cost, rank, state before, edits since). Ranks order the edits up to this layer, which
#: all end with the edit of a row, so that none begins with another.
Layer = dict[int, tuple[int, int, int, str]]
ROOT: Layer = {0: (0, 0, 0, "")}


def _inserted(layer: Layer) -> list[tuple[int, int, int, str, int]]:
    """(cost, rank, state before, insertions, state now): up to two insertions; three would only come back to a state."""
    out = []
    for state, (cost, rank, _, _) in layer.items():
        at = state
        for n in range(3):
            out.append((cost + INSERT * n, rank, state, "I" * n, at))
            at = NEXT[at][INSERTED[at]]
    return out


def layer_after(layer: Layer, sign: str) -> Layer:
    """The layer of a node from that of its parent."""
    more = TRUNCATED if sign in "SUAO" else 0
    best: dict[int, tuple[int, int, str, int]] = {}
    for cost, rank, before, edits, at in _inserted(layer):
        options = [("D", DELETE, at)]
        if sign != "x":
            options += [("K", KEEP + more, NEXT[at].get(sign.lower())), ("R", REROLE + more, NEXT[at][INSERTED[at]])]
        for edit, price, now in options:
            if now is not None:
                new = (cost + price, rank, edits + edit, before)
                if now not in best or new < best[now]:
                    best[now] = new
    order = {key: i for i, key in enumerate(sorted({(rank, edits) for _, rank, edits, _ in best.values()}))}
    return {now: (cost, order[rank, edits], before, edits) for now, (cost, rank, edits, before) in best.items()}


def answer(path: list[Layer]) -> tuple[int, str]:
    """Cost and edits of the signature whose layers are ``path``, the root's first."""
    cost, _, edits, state = min((cost, rank, edits, before) for cost, rank, before, edits, at in _inserted(path[-1]) if at in ENDS)
    parts = [edits]
    for layer in reversed(path[1:]):
        _, _, before, edits = layer[state]
        parts.append(edits)
        state = before
    return cost, "".join(reversed(parts))


def repairs(signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """Cost and edits of sorted signatures; the layers of the prefix that one shares with the one before are used again."""
    path, before, last = [ROOT], "", None
    for signature in signatures:
        if last is None or signature != before:
            same = next((i for i, (a, b) in enumerate(zip(before, signature)) if a != b), min(len(before), len(signature)))
            del path[same + 1 :]
            for sign in signature[same:]:
                path.append(layer_after(path[-1], sign))
            last, before = answer(path), signature
        yield last


class Edited:
    """The edits of one conversation, applied to its rows as they come: (edit, role, text) of each row that stays or comes in."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state = edits, 0, 0

    def _new(self, initial: str) -> str:
        self.state = NEXT[self.state][initial]
        return ROLES[initial]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._new(INSERTED[self.state]), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self._new(role[0])
            yield edit, role, text
        elif edit == "R":
            yield edit, self._new(INSERTED[self.state]), text


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and gone: rows after damage by the remainder of crc32(conv_id:turn) by 20; dropped ones are gone."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    by = (F.crc32(F.concat_ws(":", *named)) % 20).alias("_by")
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], by)
    by = F.col("_by")
    text = F.when(by == 1, "").when(by == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(by == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(by == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (by == 0).alias("gone"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns of ``conversations`` as they are."""
    texts = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", "turn", *texts, F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def _with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _order() -> list:
    return [F.col("turn").asc_nulls_first(), "role", "digest", "copy"]


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, n_rows, gaps, blank, duplicate, truncated and illegal of every conversation of ``rows``."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    lean = _with_digest(rows).select("conv_id", "turn", "role", "digest", "copy", "gone", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    # Equal rows of one turn are counted before they move; of each role and text the first place is no duplicate.
    counted = lean.groupBy("conv_id", "turn", "role", "digest", "copy", "blank", "truncated").agg(F.count_if(~F.col("gone")).alias("n"))
    counted = stored(counted, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "copy")
    firsts = counted.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("_first"))
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    marked = counted.join(firsts, same, "left").withColumn("first", F.coalesce(place.eqNullSafe(F.col("_first")), F.lit(False)))
    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", *_order()).select("conv_id", "turn", "role", "n", "first", "blank", "truncated")
    names = ["conv_id", "signature", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal"]
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, some = None, False
        signs: list[str] = []
        turns: tuple = (None, None, 0)  # first, last, distinct
        counts, last = [0, 0, 0, 0], None

        def closed():
            low, high, distinct = turns
            return (now, "".join(signs), sum(map(len, signs)), 0 if low is None else high - low + 1 - distinct, *counts)

        def written(out):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], id_type)] + [pa.array([r[i] for r in out], pa.string() if i == 1 else pa.int64()) for i in range(1, 8)], names=names)

        for batch in batches:
            out, id_type = [], batch.schema.field(0).type
            for conv, turn, role, n, first, blank, cut in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if not some or conv != now:
                    if some:
                        out.append(closed())
                    now, some, signs, turns, counts, last = conv, True, [], (None, None, 0), [0, 0, 0, 0], None
                if not n:
                    continue
                initial = role[:1]
                sign = initial if initial in ("s", "u", "a") else "o"
                new = 0 if blank or not first else 1
                signs.append(new * (sign.upper() if cut else sign) + (n - new) * "x")
                counts[0 if blank else 1] += n - new
                counts[2] += new * bool(cut)
                counts[3] += n - 1 + (last is not None and last + initial not in LEGAL)
                last = initial
                if turn is not None:
                    low, high, distinct = turns
                    turns = (turn if low is None else low, turn, distinct + (turn != high))
            yield written(out)
        if some:
            yield written([closed()])

    return ordered.mapInArrow(run, f"conv_id {kind}, signature string, " + ", ".join(f"{c} long" for c in names[2:]))


def audits(found: DataFrame) -> DataFrame:
    """``found`` (from ``signatures``) with cost and audit instead of the signature; each task makes a trie of the signatures it has."""
    kept = [c for c in found.columns if c != "signature"]
    at = found.columns.index("signature")

    def run(batches):
        def column(batch):
            return batch.column(at).to_pylist()

        batch = None

        def stream():
            nonlocal batch
            for batch in batches:
                yield from column(batch)

        out: list[tuple[int, str]] = []
        for pair in repairs(stream()):
            out.append(pair)
            if len(out) == batch.num_rows:
                arrays = [batch.column(c) for c in kept] + [pa.array([c for c, _ in out], pa.int64()), pa.array([e for _, e in out], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "cost", "audit"])
                out = []

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "signature")
    return found.sortWithinPartitions("signature").mapInArrow(run, f"{schema}, cost long, audit string")


def _streamed(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Each conversation's head (as ``head``), then its rows in order; what is gone is left out."""
    lean = _with_digest(rows).where("not gone").select("conv_id", F.lit(1).alias("_side"), "turn", "role", "digest", "copy", "text", F.lit(None).cast(_head_type(heads)).alias("head"))
    none = lambda c: F.lit(None).cast(lean.schema[c].dataType).alias(c)
    own = heads.select("conv_id", F.lit(0).alias("_side"), *[none(c) for c in ("turn", "role", "digest", "copy", "text")], F.struct(*[c for c in heads.columns if c != "conv_id"]).alias("head"))
    both = own.unionAll(lean).repartition("conv_id").sortWithinPartitions("conv_id", "_side", *_order())
    return both.select("conv_id", F.col("head.audit").alias("audit"), "role", "text", "head")


def _head_type(heads: DataFrame) -> str:
    return "struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in heads.schema if f.name != "conv_id") + ">"


def repaired_rows(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """conv_id, place (from 1), edit, role and text of the rows of repaired conversations; ``heads`` has each conversation's audit."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        edited, now, place = Edited(""), None, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, audit, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if audit is not None:
                    for x in edited.inserted():
                        place += 1
                        out.append((now, place, *x))
                    edited, now, place = Edited(audit), conv, 0
                    continue
                for x in edited.row(role, text):
                    place += 1
                    out.append((now, place, *x))
            yield _rows(out, batch.schema.field(0).type)
            id_type = batch.schema.field(0).type
        last = [(now, place + i, *x) for i, x in enumerate(edited.inserted(), 1)]
        if last:
            yield _rows(last, id_type)

    def _rows(out, id_type):
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["conv_id", "place", "edit", "role", "text"])

    return _streamed(rows, heads).mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def with_digests(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``heads`` with repaired_sha256: of the repaired rows as role:text, joined by newlines, hashed row by row."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        edited, now, line = Edited(""), None, 0
        digest = hashlib.sha256()

        def take(found):
            nonlocal line
            for _, role, text in found:
                digest.update((("\n" if line else "") + role + ":" + text).encode())
                line += 1

        def written(out, schema):
            ids = pa.array([r[0] for r in out], schema.field(0).type)
            heads_ = pa.array([r[1] for r in out], schema.field(4).type)
            return pa.RecordBatch.from_arrays([ids, heads_, pa.array([r[2] for r in out], pa.string())], names=["conv_id", "head", "repaired_sha256"])

        head = None
        for batch in batches:
            out: list[tuple] = []
            for i, (conv, audit, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if audit is None:
                    take(edited.row(role, text))
                    continue
                if head is not None:
                    take(edited.inserted())
                    out.append((now, head, digest.hexdigest()))
                edited, now, line, head, digest = Edited(audit), conv, 0, batch.column(4)[i].as_py(), hashlib.sha256()
            yield written(out, batch.schema)
            schema = batch.schema
        if head is not None:
            take(edited.inserted())
            yield written([(now, head, digest.hexdigest())], schema)

    out = _streamed(rows, heads).mapInArrow(run, f"conv_id {kind}, head {_head_type(heads)}, repaired_sha256 string")
    return out.select("conv_id", "head.*", "repaired_sha256")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of ``rows``
    (from ``damaged`` or ``undamaged``)."""
    return with_digests(rows, stored(audits(signatures(rows)), "audits"))

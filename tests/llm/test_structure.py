"""Whitening, SimHash near-dedup and repair of conversations against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from worktrace.llm import queries, repair, simhash, whitening

SF = "/root/testdata/sf0.001"


# whitening


def plain_whitening(vectors: list, k: int = 32):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    deviation = [int(v) for v in (y * y).sum(axis=1)]
    y = y.astype(float) / n
    values, turn = np.linalg.eigh(y.T @ y / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return deviation, y @ turn / np.sqrt(values), values / (y * y).sum() * n


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_whitening_equals_eigenvectors(spark):
    out = queries.op11_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    deviation, whitened, explained = plain_whitening(table["embedding"].tolist())
    n, k = whitened.shape
    assert len(out) == n * k and (out["n"] == n).all()
    assert out["deviation"].tolist() == np.repeat(deviation, k).tolist()
    mine = out["whitened"].to_numpy().reshape(n, k)
    assert np.abs(np.abs(mine) - np.abs(whitened)).max() < 1e-8
    assert np.allclose(out["explained"].to_numpy().reshape(n, k)[0], explained, rtol=1e-9)
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9
    assert np.abs(mine.T @ mine / n - np.eye(k)).max() < 1e-9


def test_whitening_iterates_until_certified(spark):
    """More dimensions than the block has columns: several passes, same components."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 40)) * np.geomspace(4, 0.02, 40)
    frame = vectors_frame(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(x)])
    model = whitening.fit(frame, k=5)
    assert model.passes > 2 and model.residual <= whitening.TOLERANCE * model.values[0] and model.vectors.shape == (40, 5)
    _, whitened, explained = plain_whitening(x.tolist(), 5)
    mine = whitening.whitened(frame, model).toPandas().sort_values(["vec_id", "component"])["whitened"].to_numpy().reshape(-1, 5)
    assert np.abs(np.abs(mine) - np.abs(whitened)).max() < 1e-7
    with pytest.raises(RuntimeError, match="1 passes"):
        whitening.fit(frame, k=5, most_passes=1)


def test_whitening_edges(spark):
    good = [(i, [float((i * j) % 7), float(i % 3), 1.0], 1) for i, j in zip(range(20), range(3, 23))]
    bad = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [float("nan"), 1.0, 1.0], 1), (103, [float("inf"), 1.0, 1.0], 1), (104, [], 1), (105, [1.0, 2.0], 1), (106, [1e30, 0.0, 0.0], 1)]
    twice = [*good, good[0], good[0], (None, [2.0, 1.0, 1.0], 1)]
    frame = vectors_frame(spark, [*twice, *bad])
    out = whitening.whitened(frame, whitening.fit(frame)).toPandas()
    assert set(out["component"]) == {1, 2}  # the third dimension is constant
    assert len(out) == 2 * len(twice) and (out["n"] == len(twice)).all() and out["vec_id"].isna().sum() == 2
    assert out["identity_error"].iloc[0] < 1e-9
    for rows in ([], bad[:1], good[:1], [good[0]] * 5):
        frame = vectors_frame(spark, rows)
        assert whitening.whitened(frame, whitening.fit(frame)).count() == 0
    n, sums = 3, np.array([3_000_000])
    assert whitening.deviations(np.array([[1 << 40], [1_000_000]]), n, sums) == [None, 0]
    extra = vectors_frame(spark, good).withColumn("n", F.lit(1)).withColumn("whitened", F.lit("x")).withColumn("size", F.lit(2))
    assert whitening.whitened(extra, whitening.fit(extra)).count() == 40


# SimHash


def plain_fingerprint(text: str | None) -> int:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints: dict) -> dict:
    ids, root = sorted(prints), {}
    for start in ids:
        if start in root:
            continue
        todo, root[start] = [start], start
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in root and (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[b] = start
                    todo.append(b)
    return root


def test_simhash_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    out = queries.op12_simhash(spark, SF).toPandas().set_index("doc_id")
    prints = {i: plain_fingerprint(t) for i, t in zip(docs["doc_id"], docs["text"])}
    assert {i: f"{p:016x}" for i, p in prints.items()} == out["fingerprint"].to_dict()
    roots = plain_components(prints)
    assert roots == out["component_id"].to_dict() and len(set(roots.values())) < len(roots)


@pytest.mark.parametrize("tile", [7, 64, 2048])
def test_simhash_links_across_tiles(spark, tile):
    """Crowded fingerprints, so that deals fill several tiles; the same components at each tile size as by all pairs."""
    rng = random.Random(tile)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {}
    for i in range(700):
        p = rng.choice(centres)
        for _ in range(rng.choice([0, 2, 4, 6, 9])):
            p ^= 1 << rng.randrange(64)
        prints[i] = p
    signed = [(i, p - (1 << 64) if p >= 1 << 63 else p) for i, p in prints.items()]
    classes = spark.createDataFrame(signed, "id long, bits long").groupBy("bits").agg(F.min("id").alias("id"))
    from worktrace.llm.minhash import components

    links = simhash.similar_fingerprints(classes, tile=tile)
    found = {r["c"]: r["x"] for r in links.collect()}
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in found.items())
    roots = {r["id"]: r["root"] for r in components(links).collect()}
    first = {}
    for i, p in prints.items():
        first.setdefault(p, i)
    assert {i: roots.get(first[p], first[p]) for i, p in prints.items()} == plain_components(prints)


def test_simhash_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    rows = [
        (5, None), (3, ""), (9, " \t\n"), (7, "One"), (8, "one"), (20, long), (21, long), (21, long), (21, "another text of some words"),
        (None, "one"), (None, "nobody else says this"), (30, "ÀB cd"), (31, "àb cd"), (32, "a b c d e"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bits", F.lit(1)).withColumn("id", F.lit("x"))
    out = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    expected = {t: f"{plain_fingerprint(t):016x}" for _, t in rows}
    assert sorted((str(i), p) for i, p, _ in out) == sorted((str(i), expected[t]) for i, t in rows)
    by_print = {(i, p): c for i, p, c in out}
    assert by_print[3, "0" * 16] == by_print[5, "0" * 16] == by_print[9, "0" * 16] == 3
    assert by_print[None, expected["one"]] == by_print[8, expected["one"]] == 7 and by_print[None, expected["nobody else says this"]] is None
    assert by_print[21, expected[long]] == 20 and by_print[30, expected["ÀB cd"]] == 30 and by_print[31, expected["àb cd"]] == 31
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_masks_leave_two_blocks():
    masks = simhash.deals(4)
    assert len(masks) == 15
    rng = random.Random(0)
    for _ in range(200):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in masks)


# repair of conversations


def plain_repair(signature: str) -> tuple[int, str]:
    """By recursion from the end, with whole strings."""

    @cache
    def best(i: int, state: int, inserted: int) -> tuple[int, str]:
        options = [(0, "")] if i == len(signature) and state in (0, 3) else []
        step = lambda cost, edit, rest: options.append((cost + rest[0], edit + rest[1]))
        nexts = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
        goes = {"s": 1, "u": 2, "a": 3}
        if inserted < 4:
            for r in nexts.replace("s", ""):
                step(3, "I", best(i, goes[r], inserted + 1))
        if i < len(signature):
            sign = signature[i]
            step(4, "D", best(i + 1, state, 0))
            if sign != "x":
                more = 3 if sign.isupper() else 0
                for r in nexts:
                    if r == sign.lower():
                        step(more, "K", best(i + 1, goes[r], 0))
                    if r != "s":
                        step(3 + more, "R", best(i + 1, goes[r], 0))
        return min(options, default=(10**9, ""))

    return best(0, 0, 0)


def test_trie_equals_recursion():
    rng = random.Random(3)
    cases = sorted({"".join(rng.choices(repair.SIGNS, k=rng.randrange(0, 9))) for _ in range(1500)} | {"", "x", "ua" * 20, "s" * 9, "xxxx"})
    assert list(repair.repairs(iter(cases))) == [plain_repair(c) for c in cases]


def test_layers_are_made_once(monkeypatch):
    made = []
    real = repair.layer_after
    monkeypatch.setattr(repair, "layer_after", lambda layer, sign: made.append(sign) or real(layer, sign))
    cases = sorted(["uaua", "uaua", "uaus", "ua", "xx"] * 3)
    list(repair.repairs(iter(cases)))
    assert len(made) == len({c[: i + 1] for c in cases for i in range(len(c))})


def plain_conversation(rows: list[tuple]) -> tuple:
    """All columns of one conversation from its (conv_id, turn, role, text)."""
    after = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        role = "user" if k == 4 else role
        after += [(turn, role, text)] * (2 if k == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, signs, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in after:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        sign = role[:1] if role[:1] in ("s", "u", "a") else "o"
        signs.append("x" if fault in ("blank", "duplicate") else sign.upper() if fault else sign)
    cost, audit = plain_repair("".join(signs))
    state, at, lines = 0, 0, []
    for e in audit:
        role, text = ("", "") if e == "I" else after[at][1:]
        at += e != "I"
        if e == "D":
            continue
        if e != "K":
            role = "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        lines.append(f"{role}:{text}")
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = [r[:1] for _, r, _ in after]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check_repair(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit(1)).withColumn("sign", F.lit(2)).withColumn("n", F.lit(2))
    out = repair.repair(repair.damaged(frame)).collect()
    conversations: dict = {}
    for r in rows:
        conversations.setdefault(r[0], []).append(r)
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in out} == {c: plain_conversation(v) for c, v in conversations.items()} and len(out) == len(conversations)


def test_repair_equals_plain_version(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", "What?", " ", "", None, "a ", "end.\n", "　", "x" * 50_000 + "!", "line\n\n", "Ho!  "]
    roles = ["user", "assistant", "system", "tool", "", None, "umpire", "User"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 12)):
            row = (conv, rng.choice([turn, turn, turn, turn * 2, None]), rng.choices(roles, [8, 8, 3, 1, 1, 1, 1, 1])[0], rng.choices(texts, [6, 3, 4, 1, 1, 1, 1, 3, 1, 1, 1, 2])[0])
            rows += [row] * rng.choice([1, 1, 1, 1, 1, 3])
    check_repair(spark, rows)


def test_repair_of_one_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"text {i % 900}.") for i in range(3000)] + [(2, 1, "user", "same.")] * 500
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in repair.repair(repair.damaged(frame)).collect()}
    assert set(out) == {1, 2} and len(out[1]["audit"]) >= out[1]["n_rows"] > 2800 and out[2]["duplicate"] == out[2]["n_rows"] - 1
    assert out[2]["audit"] == "D" * out[2]["n_rows"] or out[2]["cost"] == 4 * (out[2]["n_rows"] - 1) + 3


def test_repaired_rows_are_legal_and_whole(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = repair.damaged(conversations)
    heads = repair.audits(repair.signatures(rows))
    out = repair.repaired_rows(rows, heads).toPandas().sort_values(["conv_id", "place"])
    digests = {r["conv_id"]: r["repaired_sha256"] for r in queries.op13_repair(spark, SF).collect()}
    for conv, own in out.groupby("conv_id"):
        initials = "".join(r[0] for r in own["role"])
        assert __import__("re").fullmatch("(s?(ua)+)?", initials) and own["place"].tolist() == list(range(1, len(own) + 1))
        assert hashlib.sha256("\n".join(own["role"] + ":" + own["text"]).encode()).hexdigest() == digests[conv]
    assert set(digests) == {r["conv_id"] for r in conversations.select("conv_id").distinct().collect()}


def test_undamaged_and_empty(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "assistant", "Hi.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (one,) = repair.repair(repair.undamaged(frame)).collect()
    assert (one["cost"], one["audit"], one["repaired_sha256"]) == (0, "KK", hashlib.sha256(b"user:Hello.\nassistant:Hi.").hexdigest())
    assert repair.repair(repair.damaged(frame.limit(0))).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    check_repair(spark, [(gone, 0, "user", "Hello.")])

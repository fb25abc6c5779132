"""Training-data operators against brute force, round trips and held-out labels, on whole small tables."""

import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from worktrace.llm import fingerprints, line_dedup, minhash, mixing, packing, quality_fm, quality_rules, queries, token_counts, toxicity, warc
from worktrace.llm.common import slices

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n ", "en", "a", 3), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3), (5, "word " * 30_000, "en", "a", 150_000), (6, "Ünïcode línea.\nÜnïcode línea.\n", None, "b", 30)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_quality_statistics(spark, docs, texts, odd):
    def brute(text):
        w, t = words(text), text or ""
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    assert quality_rules.judge(odd.limit(0)).count() == 0
    for df, want in ((docs, texts), (odd, {i: t for i, t, *_ in ODD})):
        for r in quality_rules.judge(df.select("doc_id", "text")).collect():
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got == brute(want[r.doc_id]), r.doc_id
            assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0]) and not (r.base_failed and r.kept)


def test_quality_verdict_by_line(spark, docs, texts):
    import regex

    end, letter, marks, navigation = (regex.compile(re.sub(r"\\x\{(\w+)\}", r"\\u\1", p)) for p in (quality_rules.END_MARK, quality_rules.LETTER, quality_rules.MARKS, quality_rules.NAVIGATION))

    def fails(x):
        phrases = len(re.findall("|".join(quality_rules.BOILERPLATE), x.lower()))
        return not end.search(x) or not letter.search(x) or len(marks.findall(x)) * 20 > len(x) or bool(navigation.search(x)) or phrases * 300 >= max(len(x), 1) and phrases > 0

    prose = "这是一个写得很好的句子，它有很多字。"
    long = lambda n, more="": " ".join(f"w{k}" for k in range(100))[: n - 21 - len(more)] + more + " ends with a full st."
    made = {10**6 + i: x for i, x in enumerate([f"{prose} a b c d e f g h i j\n{prose}", long(299, " cookie"), long(305, " cookie"), "x " * 20 + "cookie " * 200 + ".", "12 34 56 78 90 12 34 56 78 90.", "مرحبا " * 12 + "؟"])}
    everything = {i: t for i, t in (texts | made).items()}
    df = spark.createDataFrame([(i, t, "x") for i, t in everything.items()], "doc_id long, text string, lines string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    for i, t in everything.items():
        lines = [x for x in (t or "").split("\n") if words(x)]
        good = [x for x in lines if not fails(x)]
        kept = not got[i].base_failed and len("".join(good)) >= 0.5 * len("".join(lines))
        assert (got[i].n_lines, got[i].n_removed_lines, got[i].kept, got[i].clean_text) == (len(lines), len(lines) - len(good), kept, "\n".join(good)), i
    assert [got[10**6 + i].n_removed_lines for i in range(6)] == [0, 1, 0, 1, 1, 0]
    rows = [(7, long(200), "a"), (7, "| | | | | |", "b"), (7, long(210), "c")]
    clean = quality_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, row string"))
    assert clean.columns == ["doc_id", "text", "row"] and sorted(map(tuple, clean.collect())) == [rows[0], rows[2]]


def test_line_dedup(spark, odd):
    rng = random.Random(1)
    sentence = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12)) + "."
    shared = [sentence() for _ in range(5)]
    own = [[sentence() for _ in range(4)] for _ in range(6)]
    rows = [(i, "\n".join(own[i][:2] + (shared if i in (1, 3, 4) else []) + own[i][2:])) for i in range(6)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i].text == ("\n".join(own[i]) if i in (3, 4) else text), i
    out = line_dedup.dedup_lines(odd.withColumn("n_removed_units", F.lit("clash")))
    assert out.count() == len(ODD) and {r.doc_id: r.text for r in out.where("doc_id < 5").collect()} == {1: None, 2: "", 3: " \n ", 4: "one"}


def brute_kept_units(rows):
    """Units of each document outside of all runs of 30 words that occur before, by all runs of all documents."""
    seen, kept = set(), {}
    for i, text in sorted(rows):
        parts = re.split(line_dedup.UNIT_ENDS, text)
        bare = [" ".join(words(p)).lower() for p in parts]
        at = [j for j, x in enumerate(bare) if x] + [len(parts)]
        gone = set()
        for b in range(len(at) - 1):
            for a in range(b, -1, -1):
                if sum(bare[j].count(" ") + 1 for j in at[a : b + 1]) >= 30:
                    run = tuple(bare[j] for j in at[a : b + 1])
                    if run in seen:
                        gone.update(range(at[a], at[b + 1]))
                    seen.add(run)
        kept[i] = [p for j, p in enumerate(parts) if j not in gone]
    return kept


def test_line_dedup_finds_runs_behind_partial_earlier_copies(spark):
    rng = random.Random(4)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n)) + "\n"
    s = [line(12) for _ in range(6)]
    rows = ["".join(s[0:2]), "".join(s[1:3]), "".join(s[0:3]), line(9) + "".join(s[0:3]) + line(9)]
    rows += [s[3] + line(5) + s[4], s[4] + s[5], "".join(s[3:6]), line(40) + "\n\n" + "".join(s[3:6]) + "\n"]
    pool = [line(n) for n in (1, 4, 7, 12, 12, 16, 29, 30, 35)] + ["\n"] * 3
    rows += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(120)]
    check_line_dedup(spark, list(enumerate(rows)))
    assert not set(s[0:3]) <= set(brute_kept_units(list(enumerate(rows)))[3])


def check_line_dedup(spark, rows):
    want = brute_kept_units(rows)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    for r in out:
        text = dict(rows)[r.doc_id]
        n_units = len(re.split(line_dedup.UNIT_ENDS, text))
        assert n_units - r.n_removed_units == len(want[r.doc_id]), r.doc_id
        assert r.text == (text if r.n_removed_units == 0 else "".join(want[r.doc_id]).rstrip(" \n")), r.doc_id


def test_line_dedup_equals_all_runs(spark, texts, monkeypatch):
    """Whole small tables; sentences, tabs, blanks and marks inside texts; and the way of hot windows for all windows."""
    short = [(i, t) for i, t in texts.items() if t and len(t) < 20_000]
    rng = random.Random(5)
    pool = ["A b c d e f g h. ", "I j k! ", "l m n o\tp q r s t u?  ", "\x01 \x02b v w x y z\n", " \t\n", "\n", "One two three four five six seven eight nine ten. \n", "Yes.\x01"]
    odd = [(10**6 + i, "".join(rng.choices(pool, k=rng.randrange(1, 25)))) for i in range(150)]
    check_line_dedup(spark, short + odd)
    monkeypatch.setattr(line_dedup, "HOT", 10**9)
    check_line_dedup(spark, odd)


def test_line_dedup_of_repeated_ids_and_clashing_names(spark):
    run = " ".join(f"w{i}" for i in range(40))
    rows = [(1, run, "a"), (1, run, "a"), (1, "own words. " + run, "b"), (None, run, "c"), (2, run, "d")]
    names = ["doc_id", "text", "d", "t", "runs", "row", "old", "new", "kept", "all", "k", "_k"]
    df = spark.createDataFrame([(i, t, *[x] * 10) for i, t, x in rows], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = line_dedup.dedup_lines(df)
    assert out.columns == [n for n in names if n != "text"] + ["text", "n_removed_units", "n_removed_chars"]
    got = sorted((r.runs, r.text) for r in out.collect())  # of an id's texts, a hash says which is the first; null ids are last
    assert got in ([("a", run), ("a", run), ("b", "own words."), ("c", ""), ("d", "")], [("a", ""), ("a", ""), ("b", "own words. " + run), ("c", ""), ("d", "")])
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_components(pairs, n=4):
    sets = {}
    for i, text in pairs:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    r = sorted((find(a), find(b)))
                    root[r[1]] = r[0]
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash_equals_all_pairs(spark, docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=4).collect()}
    assert got == brute_components(texts.items())


def test_minhash_on_a_group_of_edited_copies(spark):
    rng = random.Random(2)
    base = ["w%d" % rng.randrange(10**6) for _ in range(120)]
    rows = []
    for i in range(150):  # from 0 to 12 words changed: some links, some not
        own = list(base)
        for at in rng.sample(range(120), i % 13):
            own[at] = "x%d" % rng.randrange(10**6)
        rows.append((i * 3, " ".join(own)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, most in ((4, minhash.MOST_DIFFERENT), (5, minhash.SKETCH)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, n, most).collect()}
        assert got == brute_components(rows, n) and len({c for _, c in got.values()}) > 5
    more = df.withColumn("bucket", F.lit(1)).withColumn("root", F.lit("x")).unionAll(spark.createDataFrame([(None, "a b c d e f g", 1, "x")] * 2 + [(2000, "long " * 100_000, 1, "x")], "doc_id long, text string, bucket int, root string"))
    out = minhash.near_duplicates(more)
    assert out.count() == len(rows) + 3 and all(r.kept for r in out.where("doc_id is null or doc_id = 2000").collect())
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_of_repeated_ids(spark):
    """Every text of an id is compared, and what is near any of them is one group with the id."""
    rng = random.Random(5)
    text = lambda: " ".join("w%d" % rng.randrange(10**6) for _ in range(60))
    near = lambda t: t + " more words"
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(7, a), (7, b), (7, c), (9, near(a)), (3, near(b)), (20, near(c)), (20, d), (8, near(d)), (5, e), (5, e), (6, None), (6, e), (4, ""), (4, None)]
    # 12 has the smallest id of two sets, which are not alike but for it
    rows += [(12, "one two three four five six"), (12, "six five four three two one"), (13, "one two three four five six"), (14, "six five four three two one")]
    want = {7: 3, 9: 3, 3: 3, 20: 3, 8: 3, 5: 5, 4: 4, 12: 12, 13: 12, 14: 12}
    for order in (rows, rows[::-1]):
        got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()]
        assert len(got) == len(rows)
        assert sorted(x for x in got if x[0] != 6) == sorted((i, want[i], i == want[i]) for i, _ in rows if i != 6)
        # of an id, a row without words is linked with nothing
        assert sorted(x for x in got if x[0] == 6) == [(6, 5, False), (6, 6, True)]


def test_fingerprints(spark, docs, texts, odd):
    ids = sorted(texts)
    import hashlib

    for r in fingerprints.fingerprints_with_next(docs).collect():
        text, after = texts[r.doc_id] or "", texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]] or ""
        half = len(text) // 2
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    scores = fingerprints.fingerprints_with_next(docs).where("n_chars > 500").agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert scores[0] > scores[1] + 0.2
    out = fingerprints.fingerprints_with_next(odd).collect()
    assert len(out) == len(ODD) and len({r.fingerprint for r in out if r.doc_id == 4}) == 1
    assert fingerprints.fingerprints_with_next(odd.limit(0)).count() == 0


def test_fingerprints_equal_a_plain_digest(spark, docs, texts, odd):
    """Rarity, selection, filters and likeness once more, window by window."""
    import math

    def entropy(window):
        terms = {c: round(c * math.log2(c) * 2**20) for c in range(1, 33)}
        return (terms[32] - sum(terms[c] for c in Counter(window).values())) * 1000 // terms[32]

    some = [(i, t or "") for i, t in sorted(texts.items()) if len(t or "") < 1500][:25] + [(10**6, "x" * 100), (10**6 + 1, "short"), (10**6 + 2, ""), (10**6 + 3, "é" * 20 + "abc " * 30)]
    counts = Counter(entropy(b[k : k + 32]) for _, t in some for b in [t.encode()] for k in range(len(b) - 31))
    rank = {e: n for n, e in enumerate(sorted(range(1001), key=lambda e: (counts[e], e)))}

    def chain(text):
        b = text.encode()
        if not b:
            return []
        if len(b) < 32:
            import hashlib

            found = [int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")]
        else:
            ranks = [rank[e] if e >= 100 else 1 << 20 for e in (entropy(b[k : k + 32]) for k in range(len(b) - 31))]
            points = Counter()
            for k in range(max(1, len(ranks) - 31)):
                points[min(range(k, min(k + 32, len(ranks))), key=lambda j: (ranks[j], j))] += 1
            points = [0 if ranks[k] == 1 << 20 else points[k] for k in range(len(ranks))]
            chosen = [k for k, p in enumerate(points) if p >= 8] or [points.index(max(points))]
            found, mask = [], 2**64 - 1
            for k in chosen:
                h = 0
                for j in range(0, 32, 8):
                    h = (h ^ int.from_bytes(b[k + j : k + j + 8], "little")) + 0x9E3779B97F4A7C15 & mask
                    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
                    h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
                    h ^= h >> 31
                found += [h] if h not in found else []
        return [{h >> 11 * i & 2047 for h in found[k : k + 160] for i in range(5)} for k in range(0, len(found), 160)]

    def alike(a, b):
        a, b = sorted((a, b), key=len)
        if not a:
            return 0.0 if b else 1.0

        def two(x, y):
            least, chance = min(len(x), len(y)), len(x) * len(y) / 2048
            floor = chance + 0.3 * (least - chance)
            return min(1, max(0, (len(x & y) - floor) / max(least - floor, 1e-9)))

        return sum(max(two(x, y) for y in b) for x in a) / len(a)

    df = spark.createDataFrame(some, "doc_id long, text string").withColumn("edge", F.lit("clash")).withColumn("task", F.lit(0))
    got = {r.doc_id: r for r in fingerprints.fingerprints_with_next(df).collect()}
    for (i, text), (_, after) in zip(some, some[1:] + some[:1]):
        half = len(text) // 2
        own, edited = chain(text), chain(text[: len(text) - half] + after[:half])
        bits = fingerprints.decoded(got[i].fingerprint)
        assert [set(x.nonzero()[0].tolist()) for x in bits] == own, i
        assert got[i].near_edited == pytest.approx(alike(own, edited), abs=1e-6) and got[i].near_next == pytest.approx(alike(own, chain(after)), abs=1e-6)
    assert fingerprints.fingerprints_with_next(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")).count() == 2


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op5_quality_fm, "quality", 0.9), (queries.op6_toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    folder = "/root/testdata/sf0.01"
    out = query(spark, folder)
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    known = spark.read.parquet(f"{folder}/labels.parquet")
    rows = out.where("held_out").join(known, "doc_id").select("predicted", label, "doc_id").collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(r.predicted == r[label] for r in rows) >= least * len(rows)


def test_factorisation_machine_equals_all_pairs():
    import numpy as np

    machine = quality_fm.Machine()
    rng = np.random.default_rng(3)
    machine.w, machine.v = rng.standard_normal(quality_fm.DIM), rng.standard_normal((quality_fm.DIM, quality_fm.FACTORS))
    sample = ["A short text with words. And MORE words!", "", "x y z x y z 123 <b>", "Internationalisation " + "abcdefghijklmnopqrstuvwxyz" * 3]
    cache = quality_fm.Cache(quality_fm._places)
    row, feature, value = quality_fm.rows_of(sample, cache)
    raw = machine.raw(row, feature, value, len(sample))[0]
    for r in range(len(sample)):
        f, x = feature[row == r], value[row == r]
        want = sum(machine.w[i] * a for i, a in zip(f, x))
        want += sum(machine.v[f[a]] @ machine.v[f[b]] * x[a] * x[b] for a in range(len(f)) for b in range(a + 1, len(f)))
        assert raw[r] == pytest.approx(want, rel=1e-4, abs=1e-4)
    assert quality_fm._shape("abcdEFGH1234-x" * 9) != quality_fm._shape("abcdEFGH1234-x" * 8)  # whole words count


def test_toxicity_equals_a_plain_noisy_or():
    import math

    learned = toxicity.Lexicon({"<bad>": 7.5, "wors": 6.0, "<" + "z" * 50 + ">": 12.0})
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for parts in ([["bad"]], [["fine"], ["bad", "worse"], ["bad"]], [["z" * 50], ["z" * 41]], [["fine"]] * 30):
        clean = 1.0
        for s in parts:
            logit = toxicity.BASE + sum(7.5 if w == "bad" else 6.0 if w == "worse" else 12.0 if w == "z" * 50 else 0.0 for w in s)
            clean *= (1 - sigmoid(logit)) / (1 - sigmoid(toxicity.BASE))
        assert learned.score(" ".join(" ".join(s) + "." for s in parts)) == pytest.approx(1 - clean, abs=1e-9)


def test_classifiers_take_odd_tables(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = [(i, f"You vile grobnak number {i}." if i % 2 else f"A calm day number {i}.", 1, "x") for i in range(40)] * 2 + [(None, None, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, label string")
    for op in (quality_fm, toxicity):
        out = op.score(df, op.fit(df, labels))
        assert out.count() == len(rows) and out.where("score between 0 and 1").count() == len(rows)
        assert op.score(df.limit(0), op.fit(df.limit(0), labels)).count() == 0
    from worktrace.llm.learning import training_rows

    assert len(training_rows(df, labels, "toxic", 1000, most_chars=60)) < len(training_rows(df, labels, "toxic", 1000))


def test_classifiers_without_labels_and_with_odd_texts(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_fm.score(odd, quality_fm.fit(odd, none)).collect()} == {0.5}
    assert all(r.predicted == 0 for r in toxicity.score(odd, toxicity.fit(odd, none)).collect())
    assert toxicity.without_toxic(odd, toxicity.fit(odd, none)).count() == len(ODD)


def test_toxicity_learns_and_locates():
    rows = [(f"Good day number {i}. All is calm here.", 0) for i in range(60)] + [(f"Good day number {i}. You vile grobnak.", 1) for i in range(60)]
    learned = toxicity.train(rows)
    assert learned.score("Calm. What a grobnak. Fine.") >= 0.7 > learned.score("Calm and fine.")
    assert [place for place, _, _ in learned.located("Calm. What a grobnak. Fine.")] == [1]


def test_toxicity_does_not_grow_with_clean_length():
    rows = [(f"Good day number {i}. All is calm here.", 0) for i in range(60)] + [(f"Good day number {i}. You vile grobnak.", 1) for i in range(60)]
    clean = "This line is calm.\n" * 20_000
    for learned in (toxicity.train(rows), toxicity.Lexicon({})):
        assert learned.score(clean) < 0.01
    learned = toxicity.train(rows)
    assert learned.score(clean + "What a grobnak.\n" + clean) >= 0.7
    assert [place for place, _, _ in learned.located("Calm.\nFine.\nWhat a grobnak.\nFine.")] == [2]


def test_toxicity_locates_what_only_together_is_toxic():
    learned = toxicity.Lexicon({"<nasty>": 9.1})  # about 0.4 a sentence
    text = "Calm. So nasty. Nasty one. Fine. A nasty day. Calm."
    assert learned.score(text) >= 0.7 > learned.score("So nasty. Nasty one. Fine.")
    assert [place for place, _, _ in learned.located(text)] == [1, 2, 4]


def test_quality_counts_capitals_alike_at_all_lengths():
    share = lambda text: quality_fm._structure(text, 1, 1)[4]
    for text in ("ΑΒγδ ЖЗик ", "ABcd×× ÀÞß "):
        assert share(text) == pytest.approx(share(text * 100)) and share(text) == sum(map(str.isupper, text)) / len(text) * 2


class Caught:
    """Stands for a DataFrame of documents; keeps the function that workers run."""

    columns, schema = ["doc_id", "text"], {"doc_id": SimpleNamespace(dataType=LongType())}

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        self.run = run


def test_workers_hold_a_slice_of_a_batch_and_forget_it():
    texts = [f"{i} " + " ".join(f"w{i}x{j}" for j in range(2_000)) for i in range(1_200)]
    texts[3:5] = [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    seen = 0
    for ids, part in slices(batch, 1 << 20):
        assert part == texts[seen : seen + len(ids)] and ids == list(range(seen, seen + len(ids)))
        seen += len(ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(texts) and most < batch.nbytes / 4

    docs = Caught()
    toxicity.without_toxic(docs, toxicity.Lexicon({"<w7x>": 20.0}))
    out = list(docs.run(iter([batch])))
    assert max(b.nbytes for b in out) < batch.nbytes / 4
    assert [i for b in out for i in b.column(0).to_pylist()] == [i for i in range(len(texts)) if i != 7]

    few = batch.slice(0, 120)
    packing.pieces(docs)
    encode = packing._encoder(packing.TOKENIZER)
    got = {(i, p): (n, c) for b in docs.run(iter([few])) for i, p, n, c in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4)))}
    assert not encode.parts and not encode.kept
    end = (packing.SEPARATOR).to_bytes(4, "little")
    for i, text in enumerate(texts[:120]):
        ids = encode.whole(text or "") + end
        assert sum(n for (d, _), (n, _) in got.items() if d == i) == len(ids) // 4
        assert got[i, 0][1] == zlib.crc32(ids[: 4 * got[i, 0][0]])
    encode.batch([text or "" for text in texts[:64]])
    assert encode.kept
    encode.kept = packing.MOST_BYTES + 1
    assert encode.batch(["one two"]) == [encode.whole("one two")] and len(encode.parts) == 1
    encode.forget()


def test_pipeline_hands_workers_small_batches(spark, docs, texts):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for own, wanted in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("100", 100)):
            spark.conf.set(key, own)
            kept = corpus_pipeline.drop_toxic(spark, docs, SF)
            assert int(spark.conf.get(key)) == wanted
        assert 0 < kept.count() < len(texts)
    finally:
        spark.conf.unset(key)


def test_packing_is_whole_and_gapless(spark, docs, texts, odd):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df, want in ((docs, list(texts.items())), (odd, [(i, t) for i, t, *_ in ODD])):
        rows = packing.pack(df).collect()
        ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in want}
        total, sequences = Counter(), {}
        for r in rows:
            own = ids[r.doc_id][r.start : r.start + r.length]
            assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)) == r.ids_crc32 and 0 < r.length <= 1024
            assert len(ids[r.doc_id]) > 1024 or r.piece == 0 and r.length == len(ids[r.doc_id])
            assert r.piece in (0,) or r.start > 0
            total[r.doc_id] += r.length
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        copies = Counter(i for i, _ in want)
        assert total == {i: copies[i] * len(x) for i, x in ids.items()}
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(sequences) <= 1.1 * -(-sum(total.values()) // 1024) + 2
    assert packing.pack(odd.limit(0)).count() == 0


def test_token_counts_equal_a_plain_viterbi():
    vocabulary = [("<unk>", -100.0), ("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("▁a", -2.5), ("ba", -4.5), ("▁ab", -5.0), ("aba", -6.5)]
    counter = token_counts.PieceCounter(vocabulary, byte_fallback=False)
    score = dict(vocabulary)

    def brute(word):
        best = [(0.0, 0)] + [(-1e300, 0)] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):  # from the longest piece
                if word[start:end] in score and best[start][0] + score[word[start:end]] > best[end][0]:
                    best[end] = best[start][0] + score[word[start:end]], best[start][1] + 1
        return best[-1][1]

    rng = random.Random(3)
    for _ in range(500):
        word = "▁" + "".join(rng.choices("ab", k=rng.randrange(1, 9)))
        assert counter.count(word) == brute(word)


def test_token_counts_equal_the_library(docs, texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.zipf_vocabulary()
    unknown = next(i for i, (piece, _) in enumerate(vocabulary) if piece == "<unk>")
    library = Tokenizer(models.Unigram(vocabulary, unk_id=unknown, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    odd = ["", " ", "a  b", " lead", "trail ", "日本語 テキスト", "\u2581x\u2581", "tab\tnew\nline", "x" * 3000, "\x00\ufffd\U0001f600"]
    cache = token_counts._cache(token_counts.DEFAULT_MODEL)
    for text in [*[t for t in texts.values() if t and len(t) < 4000], *odd]:
        assert token_counts.count_text(text, cache) == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_token_counts_of_all_rows(spark, docs, odd):
    assert token_counts.token_counts(docs).where("n_tokens > 0").count() == docs.where("text <> ''").count()
    assert token_counts.token_counts(odd.limit(0)).count() == 0
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd.withColumn("n_tokens", F.lit("clash"))).collect()}
    assert got[1] == got[2] == 0 and got[5] >= 30_000


def test_warc_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").unionAll(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string"))
    source = warc.responses(pages)
    made = warc.derivatives(source).drop("page_id")
    assert made.count() == 2 * pages.count() and made.join(source, made.refers_to == source.record_id, "left_anti").count() == 0
    warc.write_warc(made.select(*warc.COLUMNS), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    rows = lambda df: sorted(map(repr, df.select(*warc.COLUMNS).collect()))
    assert rows(back) == rows(made)


def test_warc_text_and_headers(spark):
    import html
    from html.parser import HTMLParser

    class Text(HTMLParser):
        blocks = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table article section nav header footer main aside title head body html blockquote pre hr".split())

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript", "template")
            self.out.append("\n" if tag in self.blocks else "")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "noscript", "template")
            self.out.append("\n" if tag in self.blocks else "")

        def handle_data(self, data):
            self.out.append("" if self.hidden else data)

    def plain(page):
        parser = Text()
        parser.feed(page)
        parser.close()
        return re.sub(r" ?\n[ \n]*", "\n", re.sub("[ \t\r\f\xa0]+", " ", "".join(parser.out))).strip(" \n")

    made = ["<p>a &amp;lt; b &eacute;&#233;&#xE9; &hearts; &#128512; &nbsp; c &copy;</p>", "x &unknown; &amp y & z &#0; &#xD800;", "<title> T &amp; U\n V</title>", "", "no tags"]
    pages = [(i, None, x) for i, x in enumerate(made)] + [(r.page_id + 100, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame([(*p, "2025-05-05T05:05:05Z", "x", "x") for p in pages], "page_id long, url string, html string, date string, row string, new string")
    source = warc.responses(df).join(df.select("page_id", "row", "new"), "page_id")
    out = warc.derivatives(source)
    assert out.columns[:3] == ["page_id", "row", "new"] and warc.derivatives(source.limit(0)).count() == 0
    text = {(r.page_id, r.record_type): r.block for r in out.collect()}
    assert text[0, "conversion"] == plain(made[0]) == "a &lt; b ééé ♥ 😀 c ©" and text[1, "conversion"] == "x &unknown; &amp y & z \ufffd \ufffd"
    assert text[2, "metadata"].endswith("title: T & U V") and "source-header: Content-Type: text/html; charset=utf-8\r\n" in text[0, "metadata"]
    assert "source-date: 2025-05-05T05:05:05Z" in text[0, "metadata"] and "source-status: HTTP/1.1 200 OK" in text[0, "metadata"]
    same = sum(text[i, "conversion"] == plain(x) for i, _, x in pages if i >= 100 and html.unescape(x or "") is not None)
    assert same >= 0.95 * (len(pages) - len(made)), same


def test_warc_reader_of_broken_files(spark, tmp_path):
    import gzip

    one = b"WARC/1.1\r\nwarc-type: conversion\r\nWARC-RECORD-ID:<urn:uuid:1>\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n"
    bad = b"WARC/1.1\r\nWARC-Type: x\r\n\r\nno length\r\n\r\n"
    cut = b"WARC/1.1\r\nWARC-Type: y\r\nContent-Length: 99\r\n\r\nabc"
    d = tmp_path / "w"
    d.mkdir()
    for name, data in {"a": bad + one + cut, "b": gzip.compress(one) + gzip.compress(one) + b"\x1f\x8bbroken", "c": b"", "d": b"WARC/1.1 no end", "e": gzip.compress(one)[:-9]}.items():
        (d / name).write_bytes(data)
    got = warc.read_warc(spark, str(d)).collect()
    assert len(got) >= 3 and {(r.record_type, r.record_id, r.block) for r in got} == {("conversion", "urn:uuid:1", "abc")}


def plain_key(doc_id, text):
    """The exponential key by its definition."""
    import hashlib
    import math

    u = (int(hashlib.md5(f"0:{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
    text = text or ""
    weight = max(0.05, 1.0 - sum(c in "#*$%&|<>!" for c in text) * 5.0 / max(len(text), 1))
    return -math.log(u) / weight


def test_mixing_equals_a_plain_sort(spark, docs, texts):
    rows = mixing.mix_sizes(docs).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        total, target = own[0].source_size, own[0].target
        epochs = int(target // total) if total else 0
        budget, before, more, taken = target - epochs * total, 0, set(), 0
        ordered = sorted((plain_key(r.doc_id, texts[r.doc_id]), r.doc_id, r.size) for r in own)
        for _, i, size in ordered:
            if before + size / 2 <= budget:
                more.add(i)
                taken = before + size
            before += size
        later = [(abs(size - (budget - taken)), key, i) for key, i, size in ordered if i not in more]
        if budget > taken and later and min(later)[0] < budget - taken:
            more.add(min(later)[2])
        for r in own:
            assert r.taken == r.size * min(2, epochs + (r.doc_id in more and budget > 0)), r
        # As near as one more document, or one less, can bring it.
        gap = abs(sum(r.taken for r in own) - target)
        assert gap <= min((abs(size - (budget - taken)) for _, i, size in ordered if i not in more), default=gap) + 1e-6


def test_mixing_by_a_weight_of_ones_own(spark, docs):
    best = F.when(F.col("doc_id") % 7 == 0, 1000.0).otherwise(0.001)
    rows = mixing.mix_sizes(docs, weight=best).collect()
    share = lambda own: sum(r.taken for r in own) / max(1, sum(r.size for r in own))
    short = [r for r in rows if r.target < r.source_size]
    assert not short or share([r for r in short if r.doc_id % 7 == 0]) > share([r for r in short if r.doc_id % 7])


def test_columns_with_dots_stay(spark):
    rows = [(i, f"This is the text of document {i}, which has more than ten words in it.", "en", "s", 70) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("a.b", F.lit("x")).withColumn("c`d", F.lit(1))
    for out in (quality_rules.clean_lines(df), line_dedup.dedup_lines(df).drop("n_removed_units", "n_removed_chars"), mixing.mixed(df)):
        assert set(out.columns) == set(df.columns) and {r["a.b"] for r in out.collect()} == {"x"}


def test_a_long_or_clashing_label_leaves_the_others_in(spark):
    from worktrace.llm.learning import training_rows

    rows = [(i, f"text {i}") for i in range(60)] + [(1000, "long " * 3000), (1001, "twice")]
    labels = [(i, i % 2) for i in range(60)] + [(1000, 0), (1000, 0), (1001, 0), (1001, 1)]
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    got = training_rows(df, known, "toxic", 1000, most_chars=10_000)
    assert sorted(got) == sorted((f"text {i}", i % 2) for i in range(60) if fold(i))  # the long one alone is beyond the bound
    got = training_rows(df, known, "toxic", 1000, most_chars=50_000)
    assert ("long " * 3000, 0) in got if fold(1000) else True
    assert not any(t == "twice" for t, _ in got)


def test_toxicity_recall_held_out(spark):
    """Of held-out toxic documents; the rest mostly hold no word that any other toxic document has (README)."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = queries.op6_toxicity(spark, folder).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert hit >= 0.75 * sum(r.toxic for r in rows) and hit >= 0.85 * sum(r.predicted for r in rows)


def test_ranges_hold_little_whatever_the_weights(spark, docs):
    weights = docs.sparkSession.createDataFrame([(i, "#$%&" * 30 if i % 50 else "plain words here", "hot") for i in range(20_000)], "doc_id long, text string, source string")
    bins = mixing.sized(weights).groupBy(mixing.key_range(F.col("key"))).count().agg(F.max("count")).first()[0]
    assert bins <= 40


def test_mixed_keeps_columns_of_any_name(spark, docs):
    extra = ["size", "key", "epochs", "times", "row", "target", "bucket", "_source"]
    df = docs
    for c in extra:
        df = df.withColumn(c, F.lit(c))
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.select(*docs.columns).exceptAll(mixing.mixed(docs)).count() == 0
    assert {r[0] for r in out.select("times").distinct().collect()} == {"times"}
    assert mixing.mix_sizes(df).count() == docs.count()


def test_mixing(spark, docs, texts, odd):
    for df in (docs, odd):
        rows = mixing.mix_sizes(df).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_sizes(df).collect())) and len(rows) == df.count()
        by = {}
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size
            by.setdefault(r.source, []).append(r)
        total = sum(r.size for r in rows)
        names = sorted(by, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        size, target, open_, left = {s: by[s][0].source_size for s in names}, {}, set(names), 1.5 * total
        while open_:
            share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
            full = {s for s in open_ if share[s] > 2 * size[s]}
            if not full:
                target |= share
                break
            for s in full:
                target[s] = 2.0 * size[s]
                left -= target[s]
            open_ -= full
        for s in names:
            assert sum(r.size for r in by[s]) == size[s] and abs(by[s][0].target - target[s]) < 1e-6 * max(1, total)
            assert abs(sum(r.taken for r in by[s]) - target[s]) <= max(r.size for r in by[s]) + 1
    assert mixing.mix_sizes(odd.limit(0)).count() == 0


def test_pipeline_stages_take_effect(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, odd.limit(0), SF).count() == 0, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        if name.startswith("minhash"):
            left = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(i == c for i, (_, c) in brute_components(left, 5).items())
    assert corpus_pipeline.run(spark, SF).count() == packing.pack(docs).count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() >= len(ODD)

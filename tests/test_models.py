"""Boosted trees, TF-IDF and ranking figures against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from worktrace.operators import chain, grams, label, ml, stats, trees
from worktrace.plans import queries as Q
from worktrace.sources import sinks

SF = "/root/testdata/sf0.001"


def plain_areas(scores, truth):
    """Area under the curve by all pairs, and average precision by its definition."""
    ones, zeros = ([s for s, y in zip(scores, truth) if y == k] for k in (1, 0))
    pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for a in ones for b in zeros]
    steps, before = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        said = [y for s, y in zip(scores, truth) if s >= t]
        recall = sum(said) / len(ones)
        steps += (recall - before) * sum(said) / len(said)
        before = recall
    return sum(pairs) / len(pairs), steps


def test_ranking_metrics_equal_all_pairs(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(0)
    rows = [(rng.choice([0.1, 0.2, 0.5, 0.5, 0.9, rng.random()]), rng.randrange(2)) for _ in range(400)]
    df = spark.createDataFrame([*rows, (None, 1), (0.5, None)], "p double, y int").repartition(4)
    got = ml.ranking_metrics(df, F.col("p"), F.col("y") == 1).first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    area, ap = plain_areas(*zip(*rows))
    assert math.isclose(got.roc_auc, area) and math.isclose(got.average_precision, ap) and got.n == 400
    hits = sum(y for p, y in rows if p >= 0.5)
    assert math.isclose(got.precision, hits / sum(p >= 0.5 for p, _ in rows)) and math.isclose(got.recall, hits / sum(y for _, y in rows))
    none = ml.ranking_metrics(df.limit(0), F.col("p"), F.col("y") == 1).first()
    assert (none.n, none.roc_auc, none.average_precision) == (0, 0.0, 0.0)


def test_tfidf_by_its_definition(spark):
    docs = {"a": "pay roll pay", "b": "Pay tax", "c": "", "d": "tax x"}
    df = spark.createDataFrame(list(docs.items()), "key string, text string")

    def grams(text):
        return Counter(p[i : i + n] for w in text.lower().split() for p in [f" {w} "] for n in (1, 2, 3) for i in range(len(p) - n + 1))

    counts = {k: grams(t) for k, t in docs.items()}
    df_ = Counter(g for c in counts.values() for g in c)
    total = sum((Counter(c) for c in counts.values()), Counter())
    for words in (5000, 6):
        known = sorted((g for g in df_ if df_[g] >= 2), key=lambda g: (-total[g], g.encode()))[:words]
        want = {}
        for k, c in counts.items():
            raw = {g: c[g] * (math.log((1 + 4) / (1 + df_[g])) + 1) for g in known if c[g]}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            want |= {(k, g): v / norm for g, v in raw.items()}
        got = {(r.key, r.gram): r.weight for r in ml.tfidf(df, "key", words).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[x], want[x]) for x in want)
    assert {g: i for g, i in ((r.gram, r.idf) for r in ml.vocabulary(ml.gram_counts(df, "key"), 4).collect())}[" "] == math.log(5 / 4) + 1  # in most documents, and not 0


def test_the_label_model_is_fed_from_tfidf(spark):
    rows = [(f"d{i}", f"payroll sheet {i}" if i % 2 else f"tax notice {i}", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, text string, label double")
    model = ml.fit_labels(df, rounds=5)
    names = model.stages[0].vocabulary
    weights = {(r.key, r.gram): r.weight for r in ml.tfidf(df, "key").collect()}
    for r in ml.predicted_labels(model, df).select("key", "features").collect():
        own = {names[i]: v for i, v in zip(r.features.indices.tolist(), r.features.values.tolist())}
        assert all(math.isclose(v, weights[r.key, g]) for g, v in own.items()) and len(own) == sum(k == r.key for k, _ in weights)


def test_trees_find_what_single_features_do_not(spark):
    rng = np.random.default_rng(5)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    df = spark.createDataFrame([(*map(float, v), float(c), 1.0) for v, c in zip(x, y)], "a double, b double, c double, d double, label double, weight double")
    model = trees.fit_trees(df, ["a", "b", "c", "d"], rounds=30)
    scored = model.transform(df).toPandas()
    assert ((scored["p"] > 0.5) == (scored["label"] == 1)).mean() > 0.99
    for tree in model.trees:
        leaves = [i for i, f in enumerate(tree.feature) if f < 0]
        assert len(leaves) <= 31
    again = trees.Trees.from_json(model.to_json())
    assert np.allclose(again.transform(df).toPandas()["p"], scored["p"])


def test_a_tree_is_grown_best_first():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 20, (3000, 3)).astype(np.uint8)
    gradient, hessian = rng.standard_normal(3000) + (bins[:, 0] > 9), np.ones(3000)
    tree = trees.grow(bins, gradient, hessian, 1.0, 6, 100)
    leaf = tree.nodes(bins)
    counts = Counter(leaf.tolist())
    assert len(counts) == 6 and min(counts.values()) >= 100
    for node, n in counts.items():
        assert math.isclose(tree.value[node], -gradient[leaf == node].sum() / n)

    def gain(rows):  # by trying every cut
        best, whole = 0.0, gradient[rows].sum() ** 2 / rows.sum()
        for f in range(3):
            for cut in range(19):
                left, right = rows & (bins[:, f] <= cut), rows & (bins[:, f] > cut)
                if min(left.sum(), right.sum()) >= 100:
                    best = max(best, gradient[left].sum() ** 2 / left.sum() + gradient[right].sum() ** 2 / right.sum() - whole)
        return best

    assert math.isclose(trees.best_split(trees._sums(bins, gradient, hessian, np.arange(3000)), 100)[0], gain(np.ones(3000, bool)))


def test_boundary_model_is_no_worse_than_levelwise_trees(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    folder = "/root/testdata/sf0.01"
    rows = Q.features_18(spark, folder).join(Q.boundary_labels_nearest(spark, folder), ["session_id", "seq"]).withColumn("label", F.col("is_near").cast("double"))
    split = stats.ordered_split(rows, "session_id", "timestamp_ms", "seq").cache()
    train, rest = split.where("is_train").drop("is_train"), split.where("not is_train")
    mine = ml.ranking_metrics(ml.fit_boundaries(train).transform(rest), F.col("p"), F.col("label") == 1).first()
    others = Pipeline(stages=[VectorAssembler(inputCols=list(ml.NAMES), outputCol="x"), GBTClassifier(featuresCol="x", maxIter=20, stepSize=0.08, minInstancesPerNode=20, weightCol="weight", seed=42)])
    scored = others.fit(ml.weighted(train)).transform(rest).withColumn("p", vector_to_array("probability")[1])
    theirs = ml.ranking_metrics(scored, F.col("p"), F.col("label") == 1).first()
    split.unpersist()
    assert mine.roc_auc > theirs.roc_auc - 0.01 and mine.average_precision > theirs.average_precision - 0.01 and mine.roc_auc > 0.55


def test_degenerate_rows_and_files(spark, tmp_path):
    schema = "a double, label double, weight double"
    assert trees.fit_trees(spark.createDataFrame([], schema), ["a"]).trees == []
    one = trees.fit_trees(spark.createDataFrame([(1.0, 1.0, 1.0)] * 50, schema), ["a"])
    assert one.trees == [] and one.transform(spark.createDataFrame([(None,)], "a double")).first()["p"] > 0.99
    sampled = trees.fit_trees(spark.createDataFrame([(float(i % 7), float(i % 7 > 3), 1.0) for i in range(3000)], schema), ["a"], rounds=3, most_rows=500)
    assert sampled.transform(spark.createDataFrame([(0.0,), (6.0,)], "a double")).toPandas()["p"].tolist()[0] < 0.5
    sinks.save_trees(sampled, str(tmp_path / "t.json"), {"threshold": 0.55})
    assert sinks.load_trees(spark, str(tmp_path / "t.json")).to_json() == sampled.to_json() and sinks.load_trees(spark, str(tmp_path / "no.json")) is None


def test_model_segments_take_the_label_model(spark):
    out = Q.model_segments(spark, SF).collect()
    assert out and {r.label for r in out} <= {*Q._NAMES, label.UNKNOWN} and all(r.window_titles and r.urls for r in out) and any(r.n_merged > 1 for r in out)
    report = {r.name: r.f1 for r in Q.label_logreg(spark, SF).collect()}
    assert report["accuracy"] > 0.9


def test_context_of_model_windows(spark):
    events = spark.createDataFrame(
        [("s", 1, 1, "T", "u", "A", "b", " say "), ("s", 5, 2, "T", "", "B", "a", ""), ("s", 5, 3, "S", "v", "A", None, "then"), ("s", 9, 4, "late", "w", "C", "z", "no")],
        "session_id string, timestamp_ms long, seq long, ctx_title string, tab_url string, ctx_app string, text_content string, plain_text string",
    )
    docs = spark.createDataFrame([("s", 1, 5, 3, "x"), ("s", 20, 30, 0, "y")], "session_id string, start_ms long, end_ms long, event_count long, label string")
    one, two = chain.with_context(docs, events).orderBy("start_ms").collect()
    assert (one.window_titles, one.urls, one.apps_seen, one.extracted_texts, one.anchor_texts) == (["S", "T"], ["u", "v"], ["A", "B"], [" say ", "then"], ["b", "a"])
    assert (two.window_titles, two.anchor_texts) == ([], [])


def test_equal_documents_are_learned_from_once(spark):
    rows = [(f"d{i}", f"payroll sheet {i % 5}" if i % 3 else f"tax notice {i % 5}", float(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, text string, label double")
    seen = []
    with_features, ml.with_features = ml.with_features, lambda docs, *a: seen.append(docs.count()) or with_features(docs, *a)
    try:
        model = ml.fit_labels(df, rounds=50)
    finally:
        ml.with_features = with_features
    assert seen == [10]  # bags of words and labels, not 300 documents
    one = ml.fit_labels(df.unionAll(df).unionAll(df), rounds=50)  # thrice the documents: the same loss but for the penalty
    assert np.allclose(model.stages[-1].coefficientMatrix.toArray()[0] > 0, one.stages[-1].coefficientMatrix.toArray()[0] > 0)
    assert all(r.label == r.prediction for r in ml.predicted_labels(model, df).collect())


def test_grams_are_counted_where_documents_are(spark):
    docs = spark.createDataFrame([(1, "pay Pay x"), (2, "pay"), (2, "tax pay"), (3, None), (4, "")], "doc_id long, text string")

    def moved(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]

    got = {r.gram: r.n_documents for r in stats.ngram_documents(docs).collect()}
    texts = ["pay pay x", "pay tax pay"]
    want = Counter(g for t in texts for g in {p[i : i + n] for w in t.split() for p in [f" {w} "] for n in (1, 2, 3) for i in range(len(p) - n + 1)})
    assert got == want
    assert not moved(grams.gram_lists(docs, "doc_id"))
    assert not moved(ml.gram_counts(docs, "doc_id")) and not moved(ml.tfidf(docs.where("doc_id <> 2"), "doc_id"))


def test_equal_rows_are_learned_once_with_their_number():
    rng = np.random.default_rng(5)
    bins, label = rng.integers(0, 4, (3000, 3)).astype(np.uint8), rng.integers(0, 2, 3000).astype(float)
    weight = np.where(label > 0, 0.75, 1.5)
    rows, labels, weights, copies = trees.counted(bins, label, weight)
    assert len(rows) == len({(*b, y) for b, y in zip(bins.tolist(), label)}) <= 128 and copies.sum() == 3000
    plain = trees.grow(bins, weight * (0.3 - label), weight * 0.21, 0.1, 6, 20)
    once = trees.grow(rows, copies * weights * (0.3 - labels), copies * weights * 0.21, 0.1, 6, 20, copies)
    assert np.allclose(plain.values(bins), once.values(bins), atol=1e-12)
    found, place = trees.distinct(bins)
    assert len(found) == 64 and (found[place] == bins).all() and [len(x) for x in trees.distinct(bins[:0])] == [0, 0]


def test_trees_learn_from_every_row(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.random((6000, 2)), np.arange(6000) % 100 == 7])  # all different; a rare value alone has the label
    y = np.where(x[:, 2] > 0, 1, rng.random(6000) < 0.1 + 0.2 * ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)))
    df = spark.createDataFrame([(*map(float, v), float(c), 4.0 if c else 0.6) for v, c in zip(x, y)], "a double, b double, c double, label double, weight double").repartition(3)
    block, lineage, trees.BLOCK_ROWS, trees.LINEAGE = trees.BLOCK_ROWS, trees.LINEAGE, 500, 4
    try:
        one, many = (trees.fit_trees(df, ["a", "b", "c"], rounds=6, least_rows=40, most_rows=n) for n in (1_000_000, 500))
    finally:
        trees.BLOCK_ROWS, trees.LINEAGE = block, lineage
    shape = lambda m: [(t.feature, t.bin, t.left, t.right) for t in m.trees]
    assert shape(one) == shape(many) and np.allclose(one.base, many.base) and all(np.allclose(a.value, b.value) for a, b in zip(one.trees, many.trees))
    assert any(2 in t.feature for t in many.trees)  # 60 rows of the rare value, of which a sample of 500 has about five


def test_rows_are_counted_wherever_they_are(spark):
    df = spark.createDataFrame([(float(i % 4), float(i % 4 > 1), 1.0) for i in range(4000)], "a double, label double, weight double")
    cuts = trees.bin_cuts(df, ["a"])
    one, many = (sorted(map(tuple, trees.counted_rows(df.repartition(n), ["a"], cuts, 0.1).collect())) for n in (1, 7))
    assert one == many and len(one) == 4 and all(learned + held == 1000 and 60 < held < 140 for *_, learned, held in one) and len({held for *_, held in one}) > 1


def test_a_tree_looked_ahead_for_is_the_same():
    rng = np.random.default_rng(8)
    bins = rng.integers(0, 30, (5000, 4)).astype(np.uint8)
    gradient, copies, calls = rng.standard_normal(5000) + np.sin(bins[:, 0]) * (bins[:, 1] > 9), rng.integers(0, 3, 5000).astype(float), []
    plain = trees.grow(bins, gradient * copies, copies, 1.0, 20, 50, copies)
    part = trees.Part(bins, gradient * copies, copies, copies)
    ahead = trees.best_first(part.sums(0), lambda splits: calls.append(len(splits)) or part.halves(splits), 1.0, 20, 50, True)
    assert vars(ahead).keys() == vars(plain).keys() and all(np.allclose(vars(ahead)[k], vars(plain)[k]) for k in vars(plain))
    assert len(calls) < 19

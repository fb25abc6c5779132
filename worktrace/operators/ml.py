"""The two learned models, boundaries from features and labels from documents, and the figures of their validation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.functions.columns import f1, ratio
from worktrace.operators.features import NAMES
from worktrace.operators.grams import gram_lists, gram_totals, weight_lists, with_features, word_bag
from worktrace.operators.scan import dealt, running
from worktrace.operators.stats import class_weights, ordered_split
from worktrace.operators.trees import Trees, fit_trees
from worktrace.sources.storage import stored


def weighted(df: DataFrame, label: str = "label", copies: str | None = None) -> DataFrame:
    """Adds the balanced class weight; there are as many weights as classes. ``copies`` is how many rows a row stands for."""
    return df.join(F.broadcast(class_weights(df, label, copies).select(label, "weight")), label)


def fit_boundaries(features: DataFrame, rounds: int = 150) -> Trees:
    """Gradient-boosted trees over ``features`` with a 0/1 ``label``: best-first, 31 leaves, 20 rows a leaf, balanced classes."""
    return fit_trees(weighted(features), NAMES, rounds=rounds)


def validated_boundaries(rows: DataFrame, rounds: int = 150) -> tuple[Trees, dict]:
    """A model of the first 80 % of ``rows`` in order, and its figures on the rest (``ranking_metrics``)."""
    split = stored(ordered_split(rows, "session_id", "timestamp_ms", "seq"), "boundary-split")
    model = fit_boundaries(split.where("is_train").drop("is_train"), rounds)
    scored = model.transform(split.where("not is_train"))
    return model, ranking_metrics(scored, F.col("p"), F.col("label") == 1).first().asDict()


def ranking_metrics(rows: DataFrame, score: Column, positive: Column, threshold: float = 0.5) -> DataFrame:
    """One row of figures of a score against the truth, exact with ties: n, n_positive, prevalence, roc_auc, average_precision, and at the
    ``threshold`` precision, recall, f1 and accuracy. What has no denominator is 0; rows without score or truth do not count.

    Rows of one score are counted first. The counts are dealt by range of the score and summed up from the highest on, so that
    neither all scores nor all rows meet in one task. The area under the curve takes half of the pairs that are tied; average precision
    is the sum of precision times the step of recall at each score.
    """
    lean = rows.select(score.cast("double").alias("_score"), positive.cast("int").alias("_true")).where("_score is not null and _true is not null")
    groups = lean.groupBy("_score").agg(F.sum("_true").alias("_yes"), F.sum(1 - F.col("_true")).alias("_no")).withColumn("_all", F.lit(0))
    run = running(dealt(groups, "_all", F.desc("_score")), "_all", total={"_yes_before": F.col("_yes"), "_no_before": F.col("_no")})
    true, said = F.col("_yes_before") + F.col("_yes"), F.col("_yes_before") + F.col("_yes") + F.col("_no_before") + F.col("_no")
    above = F.col("_score") >= threshold
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = run.agg(
        count("_yes").alias("p"), count("_no").alias("n"), F.coalesce(F.sum(F.col("_no") * (2 * F.col("_yes_before") + F.col("_yes"))).cast("decimal(38,0)"), F.lit(0)).alias("twice"),
        F.coalesce(F.sum(F.col("_yes") * (true / said)), F.lit(0.0)).alias("steps"), count(F.when(above, F.col("_yes"))).alias("tp"), count(F.when(above, F.col("_no"))).alias("fp"),
    )
    p, n, tp, fp = (F.col(c) for c in ("p", "n", "tp", "fp"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, p)
    return sums.select(
        (p + n).alias("n"), p.alias("n_positive"), ratio(p, p + n).alias("prevalence"), ratio(F.col("twice"), 2.0 * p * n).alias("roc_auc"), ratio(F.col("steps"), p).alias("average_precision"),
        precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"), ratio(tp + n - fp, p + n).alias("accuracy"),
    )


def validated_labels(documents: DataFrame, order: str, rounds: int = 500) -> tuple[PipelineModel, DataFrame]:
    """A model of all ``documents``, and the report of one of their first 80 % in order on the rest."""
    split = stored(ordered_split(documents, order), "label-split")
    part = fit_labels(split.where("is_train"), rounds)
    return fit_labels(split, rounds), class_report(predicted_labels(part, split.where("not is_train")))


def class_report(scored: DataFrame) -> DataFrame:
    """name, precision, recall, f1 and support of ``scored`` (label, prediction): a row for each class, and ``accuracy`` (in all columns),
    ``macro avg`` and ``weighted avg`` over the classes."""
    true = scored.groupBy(F.col("label").cast("double").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("label") == F.col("prediction")).alias("hits"))
    said = scored.groupBy(F.col("prediction").alias("label")).agg(F.count("*").alias("said"))
    out = true.join(said, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "hits", "said")])
    p, r = ratio(F.col("hits"), F.col("said")), ratio(F.col("hits"), F.col("support"))
    out = out.select("label", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), "support", "hits")
    scores, all_ = ("precision", "recall", "f1"), F.sum("support").alias("support")
    hits = ratio(F.sum("hits"), F.sum("support"))
    rows = [
        out.agg(*[hits.alias(c) for c in scores], all_).withColumn("name", F.lit("accuracy")),
        out.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in scores], all_).withColumn("name", F.lit("macro avg")),
        out.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in scores], all_).withColumn("name", F.lit("weighted avg")),
    ]
    named = out.withColumn("name", F.col("label").cast("string"))
    for more in rows:
        named = named.unionByName(more, allowMissingColumns=True)
    return named.select("name", "label", *scores, F.coalesce("support", F.lit(0)).alias("support"))


def boundary_probability(model: Trees, features: DataFrame) -> DataFrame:
    return model.transform(features).select("session_id", "timestamp_ms", "seq", "p")


def vocabulary(totals: DataFrame, n: int, words: int = 5000, min_df: int = 2) -> DataFrame:
    """gram, n_documents and idf of the ``words`` most frequent grams that ``min_df`` documents hold; equal counts by the gram itself.

    ``totals`` has gram, total and n_documents, or key, gram and count; ``n`` is the number of documents, those without grams included.
    idf is log((1 + n) / (1 + df)) + 1.
    """
    if "count" in totals.columns:
        totals = totals.groupBy("gram").agg(F.sum("count").alias("total"), F.count("*").alias("n_documents"))
    top = totals.where(F.col("n_documents") >= min_df).orderBy(F.desc("total"), "gram").limit(words)
    return top.select("gram", "n_documents", (F.log(F.lit(1.0 + n) / (1.0 + F.col("n_documents"))) + 1.0).alias("idf"))


def gram_counts(documents: DataFrame, key: str) -> DataFrame:
    """key, gram and count: how often each document (key, text) holds each run of one to three characters of its padded words."""
    return gram_lists(documents, key).select("key", F.inline("grams"))


def tfidf(documents: DataFrame, key: str, words: int = 5000, min_df: int = 2) -> DataFrame:
    """key, gram and weight: count times idf of the vocabulary's grams, of unit length per document. Keys are distinct.

    Grams are counted and weighed where the document is; the vocabulary and its weights, ``words`` at most, pass through the driver.
    """
    kept = stored(documents.select(F.col(key).alias("key"), "text"), "texts")
    known = vocabulary(gram_totals(kept), kept.count(), words, min_df).orderBy("gram").collect()
    return weight_lists(kept, "key", [r["gram"] for r in known], [r["idf"] for r in known]).select("key", F.inline("weights"))


def fit_labels(documents: DataFrame, rounds: int = 500, words: int = 5000, min_df: int = 2) -> PipelineModel:
    """Logistic regression over TF-IDF of character n-grams, the weights of ``tfidf``; ``documents`` has text and a numeric label.

    Documents with the same words and label are one row with the sum of their weights, which leaves the loss what it is. The vocabulary
    and its weights, ``words`` at most, are the only values that pass through the driver.
    """
    bags = documents.select("label", word_bag(F.col("text")).alias("text")).groupBy("label", "text").agg(F.count("*").alias("copies"))
    kept = stored(bags, "label-documents")
    n = kept.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    known = vocabulary(gram_totals(kept), n, words, min_df).orderBy("gram").collect()
    if not known:
        raise ValueError(f"no n-gram is in {min_df} documents")
    grams, idf = [r["gram"] for r in known], [r["idf"] for r in known]
    stages = [
        CountVectorizerModel.from_vocabulary(grams, "grams", "counts"), ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="features"),
    ]
    # As many tasks as cores: each round goes over all rows.
    spread = weighted(kept, copies="copies").repartition(kept.sparkSession.sparkContext.defaultParallelism)
    rows = with_features(spread.select("text", "label", (F.col("weight") * F.col("copies")).alias("weight")), grams, idf)
    model = LogisticRegression(maxIter=rounds, regParam=1 / (5 * max(1, n)), standardization=False, weightCol="weight")
    return PipelineModel([*stages, model.fit(stored(rows.drop("text"), "label-vectors"))])


def predicted_labels(model: PipelineModel, documents: DataFrame) -> DataFrame:
    """``documents`` with what the model of ``fit_labels`` says; features are made without the grams of each document as rows."""
    counts, scaled = model.stages[0], model.stages[1]
    return model.stages[-1].transform(with_features(documents, counts.vocabulary, scaled.getScalingVec().toArray().tolist()))

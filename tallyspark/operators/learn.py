"""Learned classifier: TF-IDF of one- and two-word terms, multinomial logistic regression.

Narrations repeat, so equal (terms, label) are one row with its number of samples before
anything is fitted. Document frequencies, class weights and the loss are sums over samples,
hence the same sums over these rows weighted by their numbers: the optimum is unchanged and a
pass of the optimiser costs what the distinct texts cost.
"""

import math
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, IndexToString, NGram,
                                Normalizer, RegexTokenizer, SQLTransformer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices, Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.operators import softmax
from tallyspark.operators.classify import classify
from tallyspark.operators.sinks import materialise


def distinct_samples(terms: DataFrame, *keys: str) -> DataFrame:
    """One row for each (keys, label, _terms) with ``n``, its number of samples."""
    return _with_terms(_distinct_texts(terms, *keys)).select(*keys, "label", "_terms", "n")


def _distinct_texts(tokenised: DataFrame, *keys: str) -> DataFrame:
    """One row for each (keys, label, _text) with ``n``, its number of samples. ``_text`` has the
    words in order, which tell all terms in an eighth of their room."""
    return (tokenised.groupBy(*keys, "label", F.array_join("_words", " ").alias("_text"))
            .agg(F.count(F.lit(1)).alias("n")))


def _with_terms(texts: DataFrame) -> DataFrame:
    """Add the terms of texts made of words."""
    df = texts.withColumn("_words", F.array_remove(F.split("_text", " "), ""))
    for stage in _tokenisers()[1:]:
        df = stage.transform(df)
    return df


def _texts_of(distinct: DataFrame) -> DataFrame:
    """Rows of terms as rows of texts made of their words."""
    words = F.filter("_terms", lambda t: ~t.contains(" "))
    return distinct.select("label", F.array_join(words, " ").alias("_text"), "n",
                           F.lit(0).alias("_part"))


def balanced(samples: DataFrame, *keys: str) -> DataFrame:
    """Add a weight per row so that every label weighs the same in total, among rows of equal
    ``keys``. A row stands for ``n`` samples, if there is such a column."""
    n = F.col("n") if "n" in samples.columns else F.lit(1)
    counts = samples.groupBy(*keys, "label").agg(F.sum(n).alias("_n"))
    # One row per label: few enough for a window over all of them.
    every = Window.partitionBy(*keys or [F.lit(1)])
    weights = counts.select(*keys, "label", (
        F.sum("_n").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n")))
        .alias("weight"))
    return samples.join(weights, [*keys, "label"]).withColumn("weight", F.col("weight") * n)


def _tokenisers() -> list:
    """Stages from text to terms: words of two or more letters, and pairs of them."""
    return [
        RegexTokenizer(inputCol="description", outputCol="_words", gaps=False,
                       pattern=r"\b[a-zA-Z][a-zA-Z]+\b", toLowercase=True),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__")]


def _tokenised(df: DataFrame) -> DataFrame:
    for stage in _tokenisers():
        df = stage.transform(df)
    return df


def _counted(texts: DataFrame, parts: int) -> DataFrame:
    """(term, uses_0, samples_0, ...): by part, how often samples use each term and how many
    hold it. ``texts`` has _text, n and _part, from 0 to ``parts`` - 1."""
    names = [f"{what}_{p}" for p in range(parts) for what in ("uses", "samples")]
    counts = texts.select("_text", "n", "_part").mapInArrow(
        lambda batches: softmax.count_terms(batches, parts),
        ", ".join(["term string"] + [f"{name} long" for name in names]))
    return counts.groupBy("term").agg(*[F.sum(name).alias(name) for name in names])


def _most_used(counts: DataFrame, parts: list) -> list:
    """The most frequent terms that enough samples of some parts hold, each with its number of
    samples. At most ``ML_MAX_FEATURES`` rows; ties go by the term."""
    def over(what):
        return reduce(Column.__add__, [F.col(f"{what}_{p}") for p in parts]).alias(what)

    return (counts.select("term", over("uses"), over("samples"))
            .where(F.col("samples") >= V.ML_MIN_DOC_FREQ)
            .orderBy(F.desc("uses"), "term").limit(V.ML_MAX_FEATURES).collect())


def vocabulary(distinct: DataFrame) -> list:
    """The most frequent terms that enough samples hold, each with its number of samples.

    At most ``ML_MAX_FEATURES`` rows; ties go by the term.
    """
    return _most_used(_counted(_texts_of(distinct), 1), [0])


def _fit_texts(texts: DataFrame, unseen: list) -> list:
    """For each of ``unseen``, the stages from terms to a named category, fitted on all parts of
    the samples but that one; on all if it is None.

    ``texts`` has label, _text, n and _part, from 0 up, and is read three times. Terms are
    counted by part once, and each pass of the optimiser serves all models.
    """
    spark = texts.sparkSession
    sizes = texts.groupBy("_part", "label").agg(F.sum("n").alias("n")).collect()
    parts = 1 + max((r._part for r in sizes), default=0)
    counts = _counted(texts.where("label is not null"), parts)
    if len(unseen) > 1:
        counts = materialise(counts, "counts")
    seen_by = [[p for p in range(parts) if p != part] for part in unseen]
    weighed = balanced(spark.createDataFrame(
        [(m, r.label, r.n) for m, seen in enumerate(seen_by) for r in sizes if r._part in seen],
        "model int, label string, n long").groupBy("model", "label").agg(F.sum("n").alias("n")),
        "model").collect()
    models, samples = [], []
    for m, (part, seen) in enumerate(zip(unseen, seen_by)):
        by_label = {r.label: r for r in weighed if r.model == m}
        if not by_label:
            raise ValueError("no labelled samples to fit on")
        # In the order of Spark's strings in memory, as its indexer has them.
        labels = sorted(by_label, key=lambda name: name.encode("utf-16-be"))
        found = _most_used(counts, seen)
        samples.append(sum(r.n for r in by_label.values()))
        # Term weight: ln((1 + n) / (1 + df)) + 1.
        scale = [math.log((1 + samples[-1]) / (1 + r.samples)) + 1 for r in found]
        models.append(softmax.Model(
            [r.term for r in found], None, np.array(scale), labels,
            [by_label[name].weight / by_label[name].n for name in labels], part))
    terms = sorted({t for m in models for t in m.terms})
    place = {t: k for k, t in enumerate(terms)}
    for m in models:
        m.places = np.array([place[t] for t in m.terms], np.int64)
    blocks = softmax.stored_blocks(texts, terms, models)
    try:
        # Weights sum to the number of samples, so C = 1 is a penalty of 1 / n.
        fitted = softmax.fit_all(blocks, len(terms), models, samples, V.ML_TOLERANCE,
                                 V.ML_MAX_ITERATIONS)
    finally:
        blocks.unpersist()
    return [_stages(spark, m, *f) for m, f in zip(models, fitted)]


def _stages(spark: SparkSession, model: softmax.Model, coefficients: np.ndarray,
            intercepts: np.ndarray) -> list:
    counter = CountVectorizerModel.from_vocabulary(
        model.terms, inputCol="_terms", outputCol="_counts")
    scale = ElementwiseProduct(inputCol="_counts", outputCol="_tfidf",
                               scalingVec=Vectors.dense(model.scale))
    unit = Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)
    context, labels = spark.sparkContext, len(model.labels)
    learned = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        LogisticRegression().uid,
        _py2java(context, Matrices.dense(*coefficients.shape, coefficients.ravel("F"))),
        _py2java(context, Vectors.dense(intercepts)), labels, True)
    for name, value in (("featuresCol", "features"), ("labelCol", "_label"),
                        ("weightCol", "weight"), ("predictionCol", "_prediction"),
                        ("probabilityCol", "_probability"), ("rawPredictionCol", "_raw"),
                        ("family", "multinomial")):
        learned.set(learned.getParam(name), value)
    named = IndexToString(inputCol="_prediction", outputCol="category_ml", labels=model.labels)
    return [counter, scale, unit, LogisticRegressionModel._from_java(learned), named]


def _fit_terms(distinct: DataFrame) -> list:
    """Fitted stages from terms to a named category; ``distinct`` has label, _terms and n."""
    return _fit_texts(_texts_of(distinct), [None])[0]


def fit_classifier(samples: DataFrame) -> PipelineModel:
    """Fit on (description, label). The result is an ordinary saveable PipelineModel.

    The only data on the driver is the vocabulary, at most 10,000 terms, and one
    coefficient row per label.
    """
    texts = materialise(_distinct_texts(_tokenised(samples)), "texts")
    return PipelineModel(stages=[
        *_tokenisers(), *_fit_texts(texts.withColumn("_part", F.lit(0)), [None])[0]])


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add category_ml and its probability."""
    scored = model.transform(df)
    return (scored.withColumn("probability", F.array_max(vector_to_array("_probability")))
            .select(*df.columns, "category_ml", "probability"))


def score_classifier(tx: DataFrame, model: PipelineModel) -> DataFrame:
    """Learned category where its probability is at least 0.65, rule category elsewhere."""
    unsure = F.col("probability") < V.ML_MIN_CONFIDENCE
    # The rules search the texts of unsure rows alone.
    scored = classify(predict(tx, model).withColumns({
        "_whole": F.col("description"), "description": F.when(unsure, F.col("description"))}))
    return scored.withColumn("description", F.col("_whole")).select(
        *tx.columns,
        F.when(unsure, F.col("category")).otherwise(F.col("category_ml")).alias("category"),
        F.when(unsure, F.col("confidence")).otherwise(F.col("probability")).alias("confidence"),
        F.when(unsure, "rule").otherwise("ml").alias("classified_by"))


def stratified_folds(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Add ``fold``: every label's samples are dealt to the folds in turn, so that a label's
    numbers in two folds differ by one at most.

    Samples are ordered by a hash of their key. Each bucket of hashes is numbered on its own and
    starts where the label's earlier buckets end, which their counts tell: no label is sorted
    as a whole, however many samples it has. Equal keys are numbered in any order.
    """
    keyed = samples.withColumn("_bucket", F.substring(
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, V.ML_FOLD_BUCKET_DIGITS))
    counts = keyed.groupBy("label", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("label").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select(F.col("label").alias("_of"), F.col("_bucket").alias("_at"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("label", "_bucket").orderBy(key)
    return (keyed.withColumn("_place", F.row_number().over(own) - 1)
            .join(starts, F.col("label").eqNullSafe(F.col("_of"))
                  & (F.col("_bucket") == F.col("_at")))
            .select(*samples.columns, F.pmod(F.col("_start") + F.col("_place"),
                                             F.lit(V.ML_FOLDS)).cast("int").alias("fold")))


def out_of_fold(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """(fold, label, prediction, n): predictions by models that have not seen their fold, with
    the number of samples they stand for. Texts are split into terms once, for all folds."""
    texts = materialise(_distinct_texts(_tokenised(stratified_folds(samples, key)), "fold"),
                        "texts")
    folds = range(V.ML_FOLDS)
    fitted = _fit_texts(texts.withColumnRenamed("fold", "_part"), list(folds))
    parts = [PipelineModel(stages=stages).transform(_with_terms(texts.where(F.col("fold") == k)))
             .select("fold", "label", F.col("category_ml").alias("prediction"), "n")
             for k, stages in zip(folds, fitted)]
    return materialise(reduce(DataFrame.unionByName, parts), "predictions")


def fold_f1(predictions: DataFrame) -> DataFrame:
    """Macro F1 per fold: plain mean over the labels seen or predicted in it. A row stands for
    ``n`` samples, if there is such a column."""
    n = F.sum("n") if "n" in predictions.columns else F.count(F.lit(1))
    cells = predictions.groupBy("fold", "label", "prediction").agg(n.alias("n"))
    hit = F.col("label") == F.col("prediction")
    per_label = cells.select("fold", F.explode(F.array(
        F.struct(F.col("label").alias("name"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("missed")),
        F.struct(F.col("prediction").alias("name"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("missed")))).alias("c"))
    scores = per_label.groupBy("fold", "c.name").agg(
        F.sum("c.tp").alias("tp"), F.sum("c.missed").alias("missed"))
    f1 = F.col("tp") * 2.0 / (F.col("tp") * 2 + F.col("missed"))
    return scores.groupBy("fold").agg(F.avg(f1).alias("f1_macro"))


def macro_f1(predictions: DataFrame) -> DataFrame:
    """Mean and spread of macro F1 over the folds."""
    return fold_f1(predictions).agg(
        F.round(F.avg("f1_macro"), 4).alias("cv_f1_macro_mean"),
        F.round(F.stddev_pop("f1_macro"), 4).alias("cv_f1_macro_std"))


def train_classifier(samples: DataFrame, key: str = "sample_id",
                     save_path: str | None = None) -> tuple[PipelineModel, DataFrame]:
    """Fit on all samples; report sample and class counts and cross-validated macro F1."""
    model = fit_classifier(samples)
    if save_path:
        model.write().overwrite().save(save_path)
    classes = samples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = classes.agg(
        F.sum("n").alias("samples"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n"))))
        .alias("classes"))
    # Two one-row results side by side.
    report = counts.unionByName(macro_f1(out_of_fold(samples, key)),
                                allowMissingColumns=True)
    return model, report.agg(*[F.first(c, ignorenulls=True).alias(c)
                               for c in report.columns],
                             F.lit(save_path).cast("string").alias("model_path"))

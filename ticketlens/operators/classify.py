"""Ticket classification: candidate models as Spark ML pipelines, selection, triage.

A model learns from all labelled rows. Its vocabulary and its coefficients are tables (``linear``); the
driver holds a few numbers per row that is learnt from.
``bayes_fit`` and ``bayes_predict`` are the same complement naive Bayes in long form over all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.fixed_values import (
    AUTO_ROUTE_THRESHOLD,
    CHAR_FEATURES,
    CV_FOLDS,
    DEFAULT_CHANNEL,
    DEFAULT_TIER,
    NB_SMOOTHING,
)
from ticketlens.functions.text import clean_text, mask_pii, pii_counts
from ticketlens.operators import linear
from ticketlens.operators.features import char_vocabulary, known_words
from ticketlens.operators.grams import char_texts
from ticketlens.operators.scale import join_counted
from ticketlens.operators.scores import classification_metrics, macro_f1_by
from ticketlens.operators.splits import stratified_folds
from ticketlens.operators.validation import (
    TOLERANCE,
    dummy_by_fold,
    fold_matrix,
    predicted,
)
from ticketlens.session import materialise

#: steps after which a regression ends even if it has not converged
MAX_ITER, PRIORITY_MAX_ITER = 2_000, 3_000


def most_frequent(train: DataFrame, label: str) -> str:
    """The baseline: most frequent class, smallest name on ties."""
    return train.agg(F.mode(label, True)).first()[0]


class Constant(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    value = Param(Params._dummy(), "value", "class", TypeConverters.toString)
    prediction = Param(Params._dummy(), "prediction", "name column", TypeConverters.toString)
    confidence = Param(Params._dummy(), "confidence", "number column", TypeConverters.toString)

    @keyword_only
    def __init__(self, value=None, prediction=None, confidence=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(
            self.getOrDefault("prediction"), F.lit(self.getOrDefault("value"))
        ).withColumn(self.getOrDefault("confidence"), F.lit(1.0))


class _TermScoresWriter(MLWriter):
    def __init__(self, stage: TermScores):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sc)
        self.stage.model.write.parquet(f"{path}/model")
        self.stage.grams.write.parquet(f"{path}/grams")


class _TermScoresReader(MLReader):
    def load(self, path: str) -> TermScores:
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        read = self.sparkSession.read
        stage = TermScores(model=read.parquet(f"{path}/model"), grams=read.parquet(f"{path}/grams"))
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class TermScores(Transformer, MLWritable, MLReadable):
    """Class of the largest sum of coefficients and its softmax. Coefficients are a table
    (``linear.score``), as is the list of character n-grams. Batch rows only."""

    text = Param(Params._dummy(), "text", "text column", TypeConverters.toString)
    categorical = Param(Params._dummy(), "categorical", "value columns", TypeConverters.toListString)
    labels = Param(Params._dummy(), "labels", "class names", TypeConverters.toListString)
    intercepts = Param(Params._dummy(), "intercepts", "per class", TypeConverters.toListFloat)
    prediction = Param(Params._dummy(), "prediction", "name column", TypeConverters.toString)
    confidence = Param(Params._dummy(), "confidence", "number column", TypeConverters.toString)

    def __init__(self, model: DataFrame, grams: DataFrame, **settings):
        super().__init__()
        self.model, self.grams = model, grams
        self._set(**settings)

    def write(self) -> MLWriter:
        return _TermScoresWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TermScoresReader()

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "asked")
        labels = self.getOrDefault("labels")
        found = linear.score(rows, self.getOrDefault("text"), named_values(self.getOrDefault("categorical")),
                             self.grams, self.model, len(labels))
        sums = [F.coalesce(f"s{k}", F.lit(0.0)) + F.lit(b)
                for k, b in enumerate(self.getOrDefault("intercepts"))]
        scores = rows.join(found, "_row", "left").withColumn("_s", F.array(*sums))
        top = F.array_max("_s")
        total = F.aggregate("_s", F.lit(0.0), lambda t, x: t + F.exp(x - top))
        names = F.array(*[F.lit(v) for v in labels])
        return scores.select(
            *[F.col(f"`{c}`") for c in df.columns],
            F.element_at(names, F.array_position("_s", top).cast("int")).alias(self.getOrDefault("prediction")),
            (F.lit(1.0) / total).alias(self.getOrDefault("confidence")))


def named_values(columns: Sequence[str]) -> list[Column]:
    return [F.concat(F.lit(f"{name}:"), F.col(name)) for name in columns]


def fit_classifier(
    train: DataFrame, label: str, model: str, text: str = "text", prediction: str = "prediction",
    confidence: str = "confidence", c: float = 4.0, max_iter: int = MAX_ITER,
    categorical: tuple[str, ...] = (), char_features: int = CHAR_FEATURES, key: str = "ticket_id",
) -> PipelineModel:
    """``model`` is ``dummy``, ``bayes`` or ``logistic``, each learnt from all labelled rows.
    ``categorical`` columns are added one-hot; a value not seen in training becomes all zeros."""
    if model == "dummy":
        value = most_frequent(train, label)
        return PipelineModel([Constant(value=value, prediction=prediction, confidence=confidence)])
    linear.bound_batches(train.sparkSession)
    train = train.filter(F.col(label).isNotNull())
    labels = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    position = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)) - 1
    rows, known = linear.numbered_rows(train.select(key, text, *categorical, position.alias("_label")), "_label")
    y = known.orderBy("_row").toPandas()["_label"].to_numpy()  # a number per row that is learnt from
    n, classes = len(y), len(labels)
    texts = char_texts(rows, key, text, False)
    grams = materialise(char_vocabulary(texts, 3, char_features).select("term", "idf"), "char-vocabulary")
    found = linear.pieces(rows, text, named_values(categorical), grams, linear.bucket_bits(n))
    features = linear.RowMatrix(linear.blocks(found, n, 2), n, np.ones((3, n))).with_unit_rows()
    if model == "bayes":
        table = linear.complement(features.column_sums(np.eye(classes)[y]), classes, NB_SMOOTHING)
        intercepts = np.zeros(classes)
    else:
        weight = (n / (classes * np.bincount(y, minlength=classes)))[y]
        alpha, intercepts = linear.regress(
            features.times_transposed, y, weight, classes, 1.0 / (c * n), max_iter, TOLERANCE)
        table = features.column_sums(alpha)
    return PipelineModel([TermScores(
        model=table, grams=grams, text=text, categorical=list(categorical), labels=labels,
        intercepts=intercepts.tolist(), prediction=prediction, confidence=confidence)])


CANDIDATES = ["dummy", "bayes", "logistic"]


def cross_validate(
    train: DataFrame, label: str, key: str, models: list[str] = CANDIDATES, folds: int = CV_FOLDS,
    text: str = "text", c: float = 4.0, max_iter: int = MAX_ITER,
    char_features: int | None = CHAR_FEATURES,
) -> DataFrame:
    """(model, fold, macro_f1) for stratified folds. All candidates share the term counts, from which
    the vocabularies and weights of all folds follow, and see all rows."""
    dealt = materialise(stratified_folds(train.select(key, label, text), label, key, folds), "folds")
    parts = []
    if "dummy" in models:
        parts.append(("dummy", dummy_by_fold(dealt, label, folds)))
    if set(models) - {"dummy"}:
        classes = [r[0] for r in dealt.filter(F.col(label).isNotNull()).select(label).distinct().orderBy(label)
                   .collect()]
        if classes:
            matrix = fold_matrix(dealt, label, text, folds, classes, char_features)
            if "bayes" in models:
                parts.append(("bayes", predicted(matrix, matrix.bayes(), classes)))
            if "logistic" in models:
                parts.append(("logistic", predicted(matrix, matrix.logistic(c, max_iter), classes)))
    named = [part.select(F.lit(name).alias("model"), F.col("fold").cast("int").alias("fold"), "label",
                         "prediction") for name, part in parts]
    return macro_f1_by(reduce(DataFrame.unionByName, named), ["model", "fold"])


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(
        F.avg("macro_f1").alias("cv_macro_f1_mean"),
        F.stddev_pop("macro_f1").alias("cv_macro_f1_std"),
    )


def select_model(summary: DataFrame, models: list[str] = CANDIDATES) -> str:
    """The highest mean; the first listed wins ties."""
    means = {r["model"]: r["cv_macro_f1_mean"] for r in summary.collect()}
    return max(models, key=lambda m: means[m])


def train_category(
    train: DataFrame, test: DataFrame, label: str, key: str, models: list[str] = CANDIDATES,
    **settings,
) -> tuple[PipelineModel, str, DataFrame]:
    """Select by cross-validation on the training rows, refit on all of them, score the test."""
    scores = materialise(cross_validate(train, label, key, models, **settings), "fold-scores")
    best = select_model(cv_summary(scores), models)
    fitted = fit_classifier(train, label, best, key=key, **settings)
    tested = fitted.transform(test).select(F.col(label).alias("label"), "prediction", "confidence")
    return fitted, best, classification_metrics(tested)


def fit_priority(train: DataFrame, label: str = "priority", max_iter: int = PRIORITY_MAX_ITER,
                 **settings) -> PipelineModel:
    return fit_classifier(
        train, label, "logistic", prediction="predicted_priority",
        confidence="priority_confidence", c=2.0, categorical=("tier", "channel", "category"),
        max_iter=max_iter, **settings,
    )


def triage_batch(
    rows: DataFrame, category_model: PipelineModel, priority_model: PipelineModel,
    text: str = "text", threshold: float = AUTO_ROUTE_THRESHOLD,
) -> DataFrame:
    """Category from the cleaned text, then priority from the text and the *predicted* category.
    Missing tiers and channels take the defaults. ``rows`` are batch rows; a stream hands over its
    micro-batches."""
    defaults = {"tier": DEFAULT_TIER, "channel": DEFAULT_CHANNEL}
    named = rows.withColumn("_original", F.col(text)).withColumn("text", clean_text(F.col(text)))
    for name, value in defaults.items():
        present = F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value)
        named = named.withColumn(name, present)
    categorised = category_model.transform(named.drop("category")).withColumnsRenamed(
        {"prediction": "category", "confidence": "category_confidence"}
    )
    done = priority_model.transform(categorised).withColumnRenamed("predicted_priority", "priority")
    return (
        done.drop(text, "text").withColumnRenamed("_original", text)
        .withColumn("auto_routed", F.col("category_confidence") >= threshold)
        .withColumn("category_confidence", F.bround("category_confidence", 3))
        .withColumn("priority_confidence", F.bround("priority_confidence", 3))
    )


def classify_masked(
    rows: DataFrame, category_model: PipelineModel, priority_model: PipelineModel,
    text: str = "text",
) -> DataFrame:
    """Triage of the masked text, with the masked text and the counts of what was masked."""
    counts = [n.alias(f"n_{label.lower()}") for label, n in pii_counts(F.col(text)).items()]
    masked = rows.select("*", *counts, mask_pii(F.col(text)).alias("masked_text")).drop(text)
    return triage_batch(masked, category_model, priority_model, text="masked_text")


# --- complement naive Bayes in long form --------------------------------------------------------


def bayes_fit(weights: DataFrame, labels: DataFrame, key: str, label: str, classes: list[str],
              smoothing: float = NB_SMOOTHING) -> DataFrame:
    """(term, df, w0, w1, …): per class the negated log share of the term in all other classes."""
    # A term in many documents is combined within tasks first; the classes are few and listed.
    joined = weights.join(labels.select(key, F.col(label).alias("_y")), key)
    sums = joined.groupBy("term").agg(
        F.count("*").alias("df"),
        F.sum("weight").alias("_all"),
        *[F.sum(F.when(F.col("_y") == c, F.col("weight")).otherwise(0.0)).alias(f"_in{i}")
          for i, c in enumerate(classes)],
    )
    rest = [F.col("_all") + smoothing - F.col(f"_in{i}") for i in range(len(classes))]
    totals = sums.agg(*[F.sum(r).alias(f"_total{i}") for i, r in enumerate(rest)])
    return sums.join(F.broadcast(totals), F.lit(True)).select(
        "term", "df",
        *[(-F.ln(r / F.col(f"_total{i}"))).alias(f"w{i}") for i, r in enumerate(rest)],
    )


def bayes_predict(documents: DataFrame, weights: DataFrame, model: DataFrame, key: str,
                  classes: list[str]) -> DataFrame:
    """(key, prediction, confidence) for every row of ``documents``: class with the largest score,
    softmax of the scores. A text without a known term scores 0 in every class, so it gets the first
    class with confidence 1 / classes."""
    joined = join_counted(weights, model, "term", "df", key)
    found = joined.groupBy(key).agg(*[
        F.sum(F.col("weight") * F.col(f"w{i}")).alias(f"_s{i}") for i in range(len(classes))
    ])
    return _named(documents, found, key, classes)


def bayes_fitted_on(documents: DataFrame, key: str, text: str, label: str, classes: list[str],
                    smoothing: float = NB_SMOOTHING) -> DataFrame:
    """What ``bayes_predict`` says of the ``documents`` that ``bayes_fit`` has learnt from, all of them.
    Texts stay in their pieces, and terms do not become rows."""
    words = known_words(documents, key, text, label=label)
    if documents.groupBy(key).count().filter("count > 1").isEmpty():
        return _named(documents, words.complement_scores(key, classes, smoothing), key, classes)
    weights = materialise(words.weights(key), "weights")  # one text may have several labels
    model = bayes_fit(weights, documents, key, label, classes, smoothing)
    return bayes_predict(documents, weights, model, key, classes)


def _named(documents: DataFrame, found: DataFrame, key: str, classes: list[str]) -> DataFrame:
    scores = documents.select(key).join(found, key, "left").select(
        key, *[F.coalesce(f"_s{i}", F.lit(0.0)).alias(f"_s{i}") for i in range(len(classes))]
    )
    top = F.greatest(*[F.col(f"_s{i}") for i in range(len(classes))])
    total = sum((F.exp(F.col(f"_s{i}") - F.col("_top")) for i in range(len(classes))), F.lit(0.0))
    name = F.when(F.lit(False), F.lit(""))
    for i, c in enumerate(classes):
        name = name.when(F.col(f"_s{i}") == F.col("_top"), F.lit(c))
    return scores.withColumn("_top", top).select(
        key, name.alias("prediction"), (F.lit(1.0) / total).alias("confidence")
    )

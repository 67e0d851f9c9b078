"""Scale features, balance classes, train and apply classifiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.functions.numeric import argmax, cross_entropy, dot, softmax
from seqtables.operators.stats import balanced_accuracy, balanced_sample_size, class_weights, group_counts, long_vectors

SCALED = "scaled"
COPIES = 10_000  # copies of a row that are written out at once


def fit_scaler(df: DataFrame, vector: str = "features") -> DataFrame:
    """One row (means, scales): per feature mean and population deviation, constant features scale 1."""
    per = long_vectors(df, vector=vector).groupBy("dim").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    scale = F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    rows = F.array_sort(F.collect_list(F.struct("dim", "mean", scale.alias("scale"))))  # one entry per feature
    return per.agg(rows.alias("stats")).select(
        F.col("stats.mean").alias("means"), F.col("stats.scale").alias("scales")
    )


def apply_scaler(df: DataFrame, means: Column, scales: Column, vector: str = "features") -> DataFrame:
    """Standardized features; a table that is already scaled is refused."""
    if df.schema[vector].metadata.get(SCALED):
        raise ValueError("the features have already been scaled")
    centered = F.zip_with(F.col(vector), means, lambda x, m: x.cast("double") - m)
    scaled = F.zip_with(centered, scales, lambda x, s: x / s)
    return df.withColumn(vector, scaled.alias(vector, metadata={SCALED: True}))


def standardize(df: DataFrame, vector: str = "features") -> DataFrame:
    """Fit and apply in one plan; the one-row statistics come in as a scalar subquery."""
    stats = fit_scaler(df, vector).select(F.struct("means", "scales")).scalar()
    with_stats = df.withColumn("__stats", stats)
    return apply_scaler(with_stats, F.col("__stats.means"), F.col("__stats.scales"), vector).drop("__stats")


def balanced_resample(df: DataFrame, label: str = "label", p: float = 0.99, seed: int = 42, key: str = "id") -> DataFrame:
    """Draw rows so that all classes weigh the same, about as many as ``balanced_sample_size`` says.

    Every row is repeated by its class's rate, the fraction decided by a seeded hash of the
    key, so the draw does not depend on the partitioning.
    """
    sizes = group_counts(df, label)
    total = balanced_sample_size(df, label, p)
    target = total.select(F.col("sample_size") / F.col("classes")).scalar()
    rates = sizes.withColumn("__target", target).select(label, (F.col("__target") / F.col("n")).alias("__rate"))
    joined = df.join(rates, label)  # one row per class on the right
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor("__rate") + F.when(drawn < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)).cast("long")
    # a row of a rare class may stand for more copies than one array should hold
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / COPIES))
    begin = F.col("__block") * COPIES
    return (
        joined.withColumn("__copies", copies)
        .where("__copies > 0")
        .withColumn("__block", F.explode(blocks))
        .select(*[F.col(c) for c in df.columns], F.explode(F.sequence(begin + 1, F.least(begin + COPIES, F.col("__copies")))).alias("copy"))
    )


def weighted_cross_entropy(df: DataFrame, logits: str, label: str = "label") -> DataFrame:
    """Mean of the row cross entropies times the inverse-frequency class weight.

    Rows are summed per class first; the weights meet one row per class.
    """
    rows = df.select(F.col(label), cross_entropy(F.col(logits), F.col(label)).alias("ce"))
    per = rows.groupBy(label).agg(F.sum("ce").alias("total"), F.count(F.lit(1)).alias("n"))
    joined = per.join(class_weights(df, label).select(label, "weight"), label)
    return joined.agg((F.sum(F.col("total") * F.col("weight")) / F.sum("n")).alias("loss"))


def linear_logits(features: Column, weights: Sequence[Sequence[float]], biases: Sequence[float]) -> Column:
    """Array of w . x + b per class from literal weights."""
    vector = lambda row: F.array(*[F.lit(float(w)) for w in row])
    return F.array(*[dot(features, vector(row)) + F.lit(float(b)) for row, b in zip(weights, biases)])


def with_probabilities(df: DataFrame, probabilities: Column, classes: int) -> DataFrame:
    """Add ``probability_i`` and the most probable class as ``prediction``."""
    return (
        df.withColumn("__p", probabilities)
        .withColumns({f"probability_{i}": F.get("__p", F.lit(i)) for i in range(classes)})
        .withColumn("prediction", argmax(F.col("__p")))
        .drop("__p")
    )


def predict_linear(df: DataFrame, weights: Sequence[Sequence[float]], biases: Sequence[float]) -> DataFrame:
    """Class probabilities of a linear model with given weights."""
    return with_probabilities(df, softmax(linear_logits(F.col("features"), weights, biases)), len(weights))


@dataclass
class Classifier:
    """The model of the best epoch, the scaling of its training data and the training curve.

    ``last`` are the weights after the last epoch, where training goes on; their number is the
    network's. A linear model has none.
    """

    model: PipelineModel
    means: list[float]
    scales: list[float]
    classes: int
    curve: list[tuple]
    last: list[float] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        """Scale, score and name the predictions of a table (id, features, ..)."""
        scaled = _to_vectors(df, self.means, self.scales)
        scored = self.model.transform(scaled)
        kept = scored.select(*[F.col(c) for c in df.columns], vector_to_array("probability").alias("__prob"))
        return with_probabilities(kept, F.col("__prob"), self.classes).drop("__prob")

    def training_curve(self, spark: SparkSession) -> DataFrame:
        """Table (epoch, iterations, train_loss, val_accuracy, is_best), epoch 0 before any step."""
        return spark.createDataFrame(
            self.curve, "epoch int, iterations int, train_loss double, val_accuracy double, is_best boolean"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model, the scaling and the curve below a path."""
        self.model.write().overwrite().save(f"{path}/model")
        stats = [(self.means, self.scales, self.classes, self.last)]
        spark.createDataFrame(stats, "means array<double>, scales array<double>, classes int, last array<double>").write.mode(
            "overwrite"
        ).parquet(f"{path}/scaler")
        self.training_curve(spark).write.mode("overwrite").parquet(f"{path}/curve")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Classifier:
        """Read what ``save`` wrote."""
        stats = spark.read.parquet(f"{path}/scaler").first()
        curve = [tuple(row) for row in spark.read.parquet(f"{path}/curve").orderBy("epoch").collect()]  # a row per epoch
        model = PipelineModel.load(f"{path}/model")
        return cls(model, list(stats.means), list(stats.scales), stats.classes, curve, list(stats.last))


def _to_vectors(df: DataFrame, means: list[float], scales: list[float]) -> DataFrame:
    constant = lambda values: F.array(*[F.lit(float(v)) for v in values])
    scaled = apply_scaler(df.withColumn("__x", F.col("features")), constant(means), constant(scales), "__x")
    return scaled.withColumn("__x", array_to_vector("__x"))


def train_classifier(
    train: DataFrame,
    val: DataFrame,
    classes: int,
    hidden: Sequence[int] = (512,),
    epochs: int = 20,
    steps: int = 5,
    balanced: bool = True,
    weighted: bool = False,
    seed: int = 42,
    resume: Classifier | None = None,
) -> Classifier:
    """Train on (id, features, label) epoch by epoch; the one with the best balanced validation accuracy stays.

    An epoch is ``steps`` full-batch steps from the weights of the epoch before; epoch 0 is the
    untrained network. The scaling is fitted on the training rows alone. ``resume`` goes on after
    the last epoch of a classifier, with its scaling and its best epoch so far. ``balanced``
    resamples the classes; ``weighted`` fits a class-weighted linear model instead of the
    perceptron, which Spark starts anew for every epoch with as many steps as all epochs so far.
    """
    if resume is not None:
        means, scales, classes = resume.means, resume.scales, resume.classes
    else:
        stats = fit_scaler(train).first()  # one row, one number per feature
        means, scales = list(stats.means), list(stats.scales)
    rows = balanced_resample(train, seed=seed).drop("copy") if balanced and not weighted else train
    fitted = _to_vectors(rows, means, scales).select("__x", F.col("label").cast("double").alias("__y"), "label")
    if weighted:
        weights = class_weights(train, "label").select("label", F.col("weight").alias("__w"))
        fitted = fitted.join(weights, "label")
    fitted = fitted.persist()
    last = list(resume.last) if resume is not None else []
    curve = [list(line) for line in resume.curve] if resume is not None else []
    best = resume.model if resume is not None else None
    top = max((line[3] for line in curve), default=-1.0)
    begin = curve[-1][0] + 1 if curve else 0
    taken = curve[-1][1] if curve else 0
    for epoch in range(begin, begin + epochs + (resume is None)):
        if weighted:
            trainer = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=epoch * steps, family="multinomial")
        else:
            layers = [len(means), *hidden, classes]
            trainer = MultilayerPerceptronClassifier(featuresCol="__x", labelCol="__y", layers=layers, maxIter=steps if epoch else 0, seed=seed)
            if last:
                trainer = trainer.setInitialWeights(Vectors.dense(last))
        model = trainer.fit(fitted)
        summary = model.summary if weighted else model.summary()
        history = list(summary.objectiveHistory)
        if not weighted:
            last = model.weights.toArray().tolist()
        taken = max(len(history) - 1, 0) + (0 if weighted else taken)
        candidate = Classifier(PipelineModel([model]), means, scales, classes, [])
        accuracy = float(balanced_accuracy(candidate.predict(val), "label", "prediction").first()[0])
        curve.append([epoch, taken, float(history[-1]), accuracy, False])
        if best is None or accuracy > top:
            best, top = candidate.model, accuracy
    fitted.unpersist()
    first = next(i for i, line in enumerate(curve) if line[3] == top)
    curve = [(*line[:4], i == first) for i, line in enumerate(curve)]
    return Classifier(best, means, scales, classes, curve, last)


def predict_positives(classifier: Classifier, features: DataFrame) -> DataFrame:
    """Score a whole feature table and keep the rows predicted as class 1."""
    return classifier.predict(features).where("prediction = 1")



"""Classification on distances to centroids, and its confusion report."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions import kernels
from vecspark.functions.uniform import uniform
from vecspark.operators.search import centroid_arrays
from vecspark.operators.stats import label_ids


def centroid_distance_features(vec: str | Column, centroids: DataFrame | tuple) -> Column:
    """Squared distance to every centroid, in id order."""
    _, mat = centroid_arrays(centroids)

    @F.arrow_udf("array<double>")
    def distances(col: pa.Array) -> pa.Array:
        x = kernels.to_matrix(col)
        out = np.empty((len(x), len(mat)))
        for i, c in enumerate(mat):
            out[:, i] = kernels.paired_sqeuclidean(x, np.broadcast_to(c, x.shape)) if len(x) else 0.0
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(mat))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return distances(vec)


index_labels = label_ids


def held_out(seed: int, share: float = 0.25, key: str = "id") -> Column:
    """True for a share of the rows, by a draw that follows from seed and id: those a model is judged on, not trained on."""
    return uniform(seed, F.lit("held out"), key) < share


def with_features(points: DataFrame, centroids: DataFrame | tuple) -> DataFrame:
    return points.withColumn("features", array_to_vector(centroid_distance_features("vec", centroids)))


def _labelled(points: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    """``(id, vec, label_id)``. A common label would crowd a shuffled join; the label
    table is sent along once adaptive execution has measured that it is small."""
    return (points.select("id", "vec", F.col(label).alias("label"))
            .join(labels, "label").select("id", "vec", "label_id"))


def train_on_distances(points: DataFrame, label: str, centroids: DataFrame, *, reg: float = 1e-3,
                       max_iter: int = 100) -> tuple[PipelineModel, DataFrame]:
    """Multinomial logistic regression with an L1 prior on centroid distances.

    Returns the model and the label table ``(label, label_id)`` it was trained with.
    """
    labels = label_ids(points, label)
    rows = with_features(_labelled(points, label, labels).withColumn(
        "label_id", F.col("label_id").cast("double")), centroids)
    lr = LogisticRegression(featuresCol="features", labelCol="label_id", family="multinomial",
                            elasticNetParam=1.0, regParam=reg, maxIter=max_iter)
    return Pipeline(stages=[lr]).fit(rows), labels


def score(model: PipelineModel, points: DataFrame, label: str, labels: DataFrame,
          centroids: DataFrame) -> DataFrame:
    """``(id, label_id, predicted, max_score, log_likelihood, scores)`` per point."""
    rows = with_features(_labelled(points, label, labels), centroids)
    p = vector_to_array("probability")
    return model.transform(rows).select(
        "id", "label_id", F.col("prediction").cast("int").alias("predicted"),
        F.array_max(p).alias("max_score"),
        F.log(F.greatest(F.element_at(p, F.col("label_id") + 1), F.lit(1e-300))).alias("log_likelihood"),
        p.alias("scores"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def confusion(scored: DataFrame, actual: str = "label_id", predicted: str = "predicted") -> DataFrame:
    """Long confusion matrix ``(actual, predicted, n)``."""
    return scored.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"))


def confusion_matrix(scored: DataFrame, classes: list, actual: str = "label_id",
                     predicted: str = "predicted") -> DataFrame:
    """One row per actual class, one column ``p_<class>`` per predicted class."""
    cols = [F.count(F.when(F.col(predicted) == c, 1)).alias(f"p_{c}") for c in classes]
    return scored.groupBy(F.col(actual).alias("actual")).agg(*cols)


def accuracy_report(scored: DataFrame, actual: str = "label_id", predicted: str = "predicted") -> DataFrame:
    """Totals: rows, hits, accuracy, and mean score and likelihood where present."""
    hit = F.col(actual) == F.col(predicted)
    extra = [F.avg(c).alias(f"mean_{c}") for c in ("max_score", "log_likelihood") if c in scored.columns]
    return scored.agg(F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("correct"),
                      F.avg(hit.cast("double")).alias("accuracy"), *extra)


def evaluate(scored: DataFrame, metric: str = "f1", actual: str = "label_id",
             predicted: str = "predicted") -> float:
    rows = scored.select(F.col(actual).cast("double").alias("l"), F.col(predicted).cast("double").alias("p"))
    return MulticlassClassificationEvaluator(labelCol="l", predictionCol="p", metricName=metric).evaluate(rows)

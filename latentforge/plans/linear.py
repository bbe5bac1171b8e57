"""Linear SVM on vector rows, with the score threshold cleared.

The original (known only from its build record) trained an SVM by stochastic
subgradient descent and cleared the threshold to obtain raw margins for an
ROC curve. ``fit_hinge`` is that: in step t the subgradients of the hinge loss,
−y·x of the rows with y·(w·x + b) < 1, are summed by one Spark aggregate
over all rows or over a mini-batch drawn by a hash of the row's key, and

    w ← (1 − η·reg)·w − η·gradient / rows,    η = step_size / √t

(the intercept is not shrunk). ``hinge_scores`` gives raw margins.
``fit_svm`` is the DataFrame-API estimator ``LinearSVC`` (OWL-QN, not SGD);
raw margins come from its ``rawPrediction`` column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SCALE, hash_int, key


def embedding_rows(embeddings: DataFrame, positive_label: int = 0) -> DataFrame:
    """(vec_id, features vector, label 1.0 for ``positive_label`` else 0.0)."""
    from pyspark.ml.functions import array_to_vector
    return embeddings.select(
        "vec_id",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        (F.col("label") == F.lit(positive_label)).cast("double").alias("label"))


def fit_svm(rows: DataFrame, *, max_iter: int = 50, reg: float = 0.01):
    from pyspark.ml.classification import LinearSVC
    return LinearSVC(maxIter=max_iter, regParam=reg, featuresCol="features",
                     labelCol="label").fit(rows)


def svm_scores(model, rows: DataFrame) -> DataFrame:
    """(vec_id, label, score = raw margin, prediction)."""
    from pyspark.ml.functions import vector_to_array
    p = model.transform(rows)
    return p.select("vec_id", "label",
                    vector_to_array("rawPrediction").getItem(1).alias("score"),
                    "prediction")


@dataclass
class HingeModel:
    """``weights`` and ``intercept``; ``trace`` has a row (step, rows of the
    mini-batch, mean hinge loss before the step) for each step."""
    weights: list[float]
    intercept: float = 0.0
    trace: list = field(default_factory=list)


def margin(features: Column, weights: list[float], intercept: float) -> Column:
    """w·x + b of an array column: one generated expression, no UDF."""
    total = F.lit(float(intercept))
    for j, w in enumerate(weights):
        total = total + F.lit(float(w)) * features[j]
    return total


def in_batch(id_col: str, step: int, fraction: float, seed: int) -> Column:
    """Whether a row is in the mini-batch of a step, by hash of its key."""
    return hash_int(key("batch", seed, step, "@" + id_col)) < F.lit(int(fraction * SCALE))


def fit_hinge(rows: DataFrame, dims: int, *, features: str = "features", label: str = "label",
              id_col: str = "vec_id", steps: int = 20, step_size: float = 1.0, reg: float = 0.01,
              fraction: float = 1.0, intercept: bool = True, seed: int = 0) -> HingeModel:
    """Weights after ``steps`` hinge steps over ``rows(id_col, features
    array<double> of length dims, label 0/1)``. A step is one aggregate of
    ``dims + 3`` sums, combined in every task before its single row is sent:
    what reaches the driver is bounded by ``dims``. Rows with a null label or
    vector are left out; a step without rows changes nothing."""
    x = F.col("_x")
    rows = (rows.where(F.col(features).isNotNull() & F.col(label).isNotNull())
            .select(F.col(id_col).alias("_id"), F.col(features).alias("_x"),
                    (F.lit(2.0) * F.col(label).cast("double") - F.lit(1.0)).alias("_y")))
    model = HingeModel([0.0] * dims)
    for t in range(1, steps + 1):
        batch = rows if fraction >= 1.0 else rows.where(in_batch("_id", t, fraction, seed))
        loss = F.lit(1.0) - F.col("_y") * margin(x, model.weights, model.intercept)
        near = batch.withColumn("_loss", loss).withColumn(
            "_g", F.when(F.col("_loss") > 0, -F.col("_y")).otherwise(F.lit(0.0)))
        got = near.agg(F.count(F.lit(1)).alias("n"), F.sum("_g").alias("b"),
                       F.sum(F.greatest("_loss", F.lit(0.0))).alias("loss"),
                       *[F.sum(F.col("_g") * x[j]).alias(f"g{j}") for j in range(dims)]).first()
        n = got["n"]
        if not n:
            model.trace.append((t, 0, None))
            continue
        eta = step_size / t ** 0.5
        model.weights = [(1.0 - eta * reg) * w - eta * got[f"g{j}"] / n
                         for j, w in enumerate(model.weights)]
        if intercept:
            model.intercept -= eta * got["b"] / n
        model.trace.append((t, n, got["loss"] / n))
    return model


def hinge_scores(model: HingeModel, rows: DataFrame, features: str = "features") -> DataFrame:
    """``rows`` with ``score``, the raw margin (no threshold)."""
    return rows.withColumn("score", margin(F.col(features), model.weights, model.intercept))

"""Scoring and evaluation: predictions, RMSE variants, AUROC.

Predictions join rating rows to the factor tables (size-checked
broadcast, else salted shuffle join) and evaluate the model as a JVM
expression. Every metric is one aggregate with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import prefix_sums
from ..functions.vectors import at, dot
from ..operators.joins import join_factors


def score(pairs: DataFrame, user_f: DataFrame, item_f: DataFrame, mu, k: int, *,
          biased: bool = True, n_users: int | None = None, n_items: int | None = None,
          sizes: tuple[int, int, int] | None = None) -> DataFrame:
    """Add ``prediction`` and ``has_factors`` to (user_id, item_id, ...).

    Pairs whose user or item has no factor row are kept (left joins): the
    missing side contributes nothing, so the biased model falls back to
    ``mu`` plus the known bias. ``mu`` is a number or a scalar Column (for
    example ``train.select(F.avg("rating")).scalar()``).
    """
    j = join_factors(pairs, user_f, item_f, k, n_users=n_users, n_items=n_items, sizes=sizes,
                     how="left")
    has = F.col("fu").isNotNull() & F.col("fi").isNotNull()
    d = F.when(has, dot(F.col("fu"), F.col("fi"))).otherwise(F.lit(0.0))
    if biased:
        m = mu if isinstance(mu, Column) else F.lit(float(mu))
        pred = (m + F.coalesce(F.col("bu"), F.lit(0.0)) +
                F.coalesce(F.col("bi"), F.lit(0.0)) + d)
    else:
        pred = d
    return (j.withColumn("prediction", pred).withColumn("has_factors", has)
             .drop("bu", "bi", "fu", "fi"))


def rmse(pred: DataFrame, label: str = "rating", col: str = "prediction",
         by: tuple[str, ...] = ()) -> DataFrame:
    """(n, rmse) in one aggregate; with ``by``, one row per group."""
    return pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                    F.sqrt(F.avg(F.pow(F.col(label) - F.col(col), 2))).alias("rmse"))


def rmse_evaluator(pred: DataFrame, label: str = "rating", col: str = "prediction") -> float:
    """The same RMSE through ``RegressionEvaluator`` (NaN rows dropped first)."""
    from pyspark.ml.evaluation import RegressionEvaluator
    ok = pred.where(F.col(col).isNotNull() & ~F.isnan(F.col(col)))
    return RegressionEvaluator(metricName="rmse", labelCol=label,
                               predictionCol=col).evaluate(ok)


def auroc_evaluator(scored: DataFrame, score_col: str = "score",
                    label_col: str = "label") -> float:
    """AUROC through ``BinaryClassificationEvaluator`` (cross-check)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    return BinaryClassificationEvaluator(rawPredictionCol=score_col, labelCol=label_col,
                                         metricName="areaUnderROC").evaluate(
        scored.select(F.col(score_col).cast("double"), F.col(label_col).cast("double")))


def rmse_subset(pred: DataFrame, max_user: int) -> DataFrame:
    """RMSE over users with id <= max_user, with its own count."""
    return rmse(pred.where(F.col("user_id") <= F.lit(max_user)))


def rmse_nan_safe(pred: DataFrame, col: str = "prediction") -> DataFrame:
    """Drop NaN / null predictions (cold-start rows) before the mean."""
    ok = F.col(col).isNotNull() & ~F.isnan(F.col(col))
    return rmse(pred.where(ok), col=col)


def rmse_pairs(pairs: DataFrame, truth: DataFrame, user_f: DataFrame, item_f: DataFrame,
               mu, k: int, **kw) -> DataFrame:
    """RMSE on given pairs that exist in ``truth``; missing pairs counted."""
    t = truth.select("user_id", "item_id", "rating")
    looked = pairs.select("user_id", "item_id").join(t, ["user_id", "item_id"], "left")
    scored = score(looked, user_f, item_f, mu, k, **kw)
    found = F.col("rating").isNotNull()
    return scored.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(F.when(found, 1).otherwise(0)).cast("long").alias("n_found"),
        F.sum(F.when(found, 0).otherwise(1)).cast("long").alias("n_missing"),
        F.sqrt(F.avg(F.when(found, F.pow(F.col("rating") - F.col("prediction"), 2))))
         .alias("rmse"))


def _gram(side: DataFrame, width: int) -> DataFrame:
    """One row: ``n`` and ``g``, the upper triangle of Σ v vᵀ over the rows;
    fixed-width sums, one partial row per task."""
    v = F.col("v")
    return side.agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.coalesce(F.sum(at(v, a) * at(v, b)), F.lit(0.0))
        for a in range(width) for b in range(a, width)]).alias("g"))


def rmse_dense(user_f: DataFrame, item_f: DataFrame, user_t: DataFrame,
               item_t: DataFrame, *, width: int | None = None) -> DataFrame:
    """RMSE of M·Uᵀ against the planted M₀·U₀ᵀ over every (item, user) cell.

    No cell is enumerated: with A = [M, M₀] and B = [U, −U₀],
    Σ_ij (m_i·u_j − m0_i·u0_j)² = ‖A Bᵀ‖² = Σ_kl (AᵀA)_kl (BᵀB)_kl,
    two Gram matrices of ``width``² cells (K + R, read from a row if not given),
    each one row. Inputs are (id, factors) tables; the two sides must share
    their ids.
    """
    a = item_f.select("id", F.col("factors").alias("m")).join(
        item_t.select("id", F.col("factors").alias("m0")), "id")
    b = user_f.select("id", F.col("factors").alias("u")).join(
        user_t.select("id", F.col("factors").alias("u0")), "id")
    a = a.select(F.concat("m", "m0").alias("v"))
    b = b.select(F.concat("u", F.transform("u0", lambda x: -x)).alias("v"))
    if width is None:
        first = a.first()
        width = len(first["v"]) if first else 0
    ga, gb = _gram(a, width), _gram(b, width).withColumnsRenamed({"n": "m", "g": "h"})
    # off the diagonal a cell stands for two
    twice = F.array(*[F.lit(1.0 if x == y else 2.0) for x in range(width)
                      for y in range(x, width)])
    sse = F.aggregate(F.zip_with(F.zip_with("g", "h", lambda x, y: x * y), twice,
                                 lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return ga.crossJoin(F.broadcast(gb)).select(
        F.col("n").alias("n_items"), F.col("m").alias("n_users"),
        F.sqrt(sse / (F.col("n") * F.col("m"))).alias("rmse"))


def prediction_listing(scored: DataFrame) -> DataFrame:
    return scored.select("user_id", "item_id", "rating", "prediction",
                         F.col("has_factors").cast("int").alias("has_factors"))


def predict_user(scored: DataFrame, user_id) -> DataFrame:
    return scored.where(F.col("user_id") == user_id)


def auroc(scored: DataFrame, score_col: str = "score", label_col: str = "label") -> DataFrame:
    """Area under ROC with ties at mid-rank, exact and distributed.

    Rows are first reduced to one row per distinct score (p positives, n
    negatives); then AUC = Σ_s p_s (N_<s + n_s / 2) / (P · N), where the
    running count of lower negatives N_<s is a distributed prefix sum.
    """
    pos = F.col(label_col) > F.lit(0.5)
    g = scored.groupBy(F.col(score_col).alias("s")).agg(
        F.sum(F.when(pos, 1).otherwise(0)).cast("long").alias("p"),
        F.sum(F.when(pos, 0).otherwise(1)).cast("long").alias("q"))
    c = prefix_sums(g, ["s"], ["q"])
    return c.agg(
        (F.sum(F.col("p") * (F.col("q_before") + F.col("q") / F.lit(2.0))) /
         (F.sum("p") * F.sum("q"))).alias("auroc"),
        F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))

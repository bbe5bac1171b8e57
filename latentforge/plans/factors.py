"""Factor tables and the per-rating model arithmetic.

A factor table is ``(id long, bias double, factors array<double>)``, one
per side. The prediction of the biased model is
``mu + b_u + b_i + f_u · f_i`` (the dot product of the augmented vectors
``[mu, b_u, 1, f_u]`` and ``[1, 1, b_i, f_i]``); the unbiased model
predicts ``f_u · f_i``. Everything here is a Catalyst expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_gaussian, hash_uniform, key
from ..functions.vectors import at, dot, elementwise, sgd_feature_step

FACTOR_SCHEMA = "id long, bias double, factors array<double>"


@dataclass(frozen=True)
class SgdParams:
    """Hyper-parameters; defaults are those of the original serial program."""
    k: int = 20
    epochs: int = 26
    lr: float = 0.1
    lr_bias: float = 0.5
    lam: float = 0.1
    bias_reg: float = 0.1
    decay: float = 0.9
    noise: float = 0.1
    biased: bool = True
    train_dims: int | None = None   # train only the first n features (None: all)
    seed: int = 0
    gaussian_init: bool = False
    schedule: str = "epoch"         # "epoch": lr·decay^epoch; "step": also per update


def init_vector(id_col: Column, side: str, k: int, *, seed: int = 0, noise: float = 0.1,
                gaussian: bool = False) -> Column:
    """noise * U[0,1) (or N(0,1)) k times; a shorter vector is a prefix of a longer one."""
    gen = hash_gaussian if gaussian else hash_uniform
    tag = "gauss" if gaussian else "init"
    return elementwise(k, lambda j: gen(key(tag, seed, side, id_col, j)) * F.lit(noise))


def init_factors(ids: DataFrame, id_col: str, side: str, k: int, *, seed: int = 0,
                 noise: float = 0.1, gaussian: bool = False) -> DataFrame:
    """(id, bias=0, factors) with factors[k] = noise * U[0,1) (or N(0,1))."""
    vec = init_vector(F.col(id_col), side, k, seed=seed, noise=noise, gaussian=gaussian)
    return ids.select(F.col(id_col).cast("long").alias("id"), F.lit(0.0).alias("bias"),
                      vec.alias("factors"))


def init_model(train: DataFrame, p: SgdParams) -> tuple[DataFrame, DataFrame]:
    users = train.select("user_id").distinct()
    items = train.select("item_id").distinct()
    return (init_factors(users, "user_id", "u", p.k, seed=p.seed, noise=p.noise,
                         gaussian=p.gaussian_init),
            init_factors(items, "item_id", "i", p.k, seed=p.seed, noise=p.noise,
                         gaussian=p.gaussian_init))


def prediction(mu: Column | float, biased: bool = True) -> Column:
    """Over joined columns ``bu, fu, bi, fi`` (see ``join_factors``)."""
    d = dot(F.col("fu"), F.col("fi"))
    if not biased:
        return d
    m = mu if isinstance(mu, Column) else F.lit(float(mu))
    return m + F.col("bu") + F.col("bi") + d


def sgd_deltas(joined: DataFrame, mu, p: SgdParams, lr: float | None = None) -> DataFrame:
    """Per rating: error and the new user/item state after one SGD step.

    Old values are used on both sides of the update (the original reads the
    user feature before writing it, and uses that read for the item).
    """
    lr_c = F.lit(p.lr if lr is None else lr)
    lam = F.lit(p.lam)
    err = F.col("rating") - prediction(mu, p.biased)
    out = joined.withColumn("err", err)
    if p.biased:
        lb = F.lit(p.lr_bias)
        breg = F.lit(p.bias_reg * p.lam)
        out = (out.withColumn("new_bu", F.col("bu") + lb * (F.col("err") - breg * F.col("bu")))
                  .withColumn("new_bi", F.col("bi") + lb * (F.col("err") - breg * F.col("bi"))))
    else:
        out = out.withColumn("new_bu", F.col("bu")).withColumn("new_bi", F.col("bi"))
    return (out.withColumn("new_fu", sgd_feature_step(F.col("fu"), F.col("fi"), F.col("err"),
                                                      lr_c, lam, p.k, p.train_dims))
               .withColumn("new_fi", sgd_feature_step(F.col("fi"), F.col("fu"), F.col("err"),
                                                      lr_c, lam, p.k, p.train_dims)))


def gradient_sums(joined: DataFrame, mu, p: SgdParams) -> DataFrame:
    """(side, id, n, g array): full-batch gradient summed per id.

    Per rating the user feature gradient is ``e·f_i − λ·f_u`` (items
    likewise) and the bias gradient, first in ``g`` if the model is biased,
    ``e − biasReg·λ·b``. The joined ratings are planned once and give a row
    for each side; a grouped aggregate of fixed-width sums combines them
    before the shuffle, so a hot id costs one partial row per task.
    """
    lam = F.lit(p.lam)
    breg = F.lit(p.bias_reg * p.lam)
    j = joined.withColumn("err", F.col("rating") - prediction(mu, p.biased))
    err = F.col("err")

    def terms(own, other, bias_col):
        out = [err - breg * F.col(bias_col)] if p.biased else []
        return F.array(*out, *[err * at(other, q) - lam * at(own, q) for q in range(p.k)])

    fu, fi = F.col("fu"), F.col("fi")
    rows = j.select(F.explode(F.array(
        F.struct(F.lit("user").alias("side"), F.col("user_id").alias("id"),
                 terms(fu, fi, "bu").alias("g")),
        F.struct(F.lit("item").alias("side"), F.col("item_id").alias("id"),
                 terms(fi, fu, "bi").alias("g")))).alias("r")).select("r.*")
    width = p.k + int(p.biased)
    sums = rows.groupBy("side", "id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(at(F.col("g"), q)).alias(f"_g{q}") for q in range(width)])
    return sums.select("side", "id", "n",
                       F.array(*[F.col(f"_g{q}") for q in range(width)]).alias("g"))


def gradient_step(joined: DataFrame, mu, p: SgdParams) -> DataFrame:
    """``gradient_sums`` as rows per (side, id, k); k = -1 is the bias."""
    first_k = -1 if p.biased else 0
    return gradient_sums(joined, mu, p).select(
        "side", "id", F.posexplode("g").alias("pos", "grad")).select(
        "side", "id", (F.col("pos") + F.lit(first_k)).alias("k"), "grad")


def flat_factors(f: DataFrame, side: str) -> DataFrame:
    """(side, id, k, value) with k = -1 for the bias."""
    return f.select(F.lit(side).alias("side"), "id",
                    F.posexplode(F.concat(F.array("bias"), F.col("factors")))) \
            .select("side", "id", (F.col("pos") - 1).alias("k"), F.col("col").alias("value"))

"""Alternating least squares: the MLlib estimator and the normal equations.

``fit_als`` wraps ``pyspark.ml.recommendation.ALS`` (blocked, shuffled
in/out links inside MLlib) with checkpointing so long runs do not grow
an unbounded lineage.

``als_half_step`` is the textbook update written with DataFrames: for
every id on one side, G = Σ v vᵀ + λ·n·I and b = Σ r·v over its ratings
(regularisation scaled by the rating count), then x = G⁻¹ b. The Gram
sums are plain aggregates with one K² buffer per group and task (map-side
partial sums, so a hot id costs nothing extra); the solves are batched
numpy calls in ``mapInPandas``, one K×K system per row.

``als_blocked_loop`` is the same alternation with the ratings laid out once
per side. The ids to solve are dealt to in-blocks of bounded size (a block
beyond the bound, as one with a hot id, is cut by the other id; the Gram sums
of its pieces are added up). A routing table says which blocks need which
vector of the other side, so in a half step a vector is sent once to each
block that has a rating for it, instead of once per rating, and the ratings
are not shuffled again: both tables are bucketed by what they are joined on.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import at, elementwise
from ..operators.joins import factor_row_bytes, join_per_id
from ..session import (cut_lineage, drop_path, ensure_checkpoint_dir, new_scratch_path,
                       write_table)
from .factors import init_factors

INT_MAX = 2 ** 31 - 1


def check_int_ids(ratings: DataFrame) -> bool:
    r = ratings.agg(F.min("user_id"), F.max("user_id"), F.min("item_id"),
                    F.max("item_id")).first()
    return all(v is None or (0 <= v <= INT_MAX) for v in r)


@dataclass
class AlsFit:
    """An MLlib ALS model plus, when ids were re-encoded, the dictionaries
    (id -> dense int index) built by a distributed sort."""
    model: object
    user_dict: DataFrame | None = None
    item_dict: DataFrame | None = None


def _encode(df: DataFrame, col: str) -> DataFrame:
    from ..functions.ranking import global_position
    return global_position(df.select(col).distinct(), [col], "_idx")


def _to_index(df: DataFrame, d: DataFrame | None, col: str) -> DataFrame:
    if d is None:
        return df.withColumn(col, F.col(col).cast("int"))
    # dictionary joins: one partner per row; AQE splits skewed partitions
    return df.join(d, col, "left").drop(col).withColumnRenamed("_idx", col) \
             .withColumn(col, F.col(col).cast("int"))


def als_ids(train: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Ratings with the int ids MLlib takes, and the dictionaries where the
    ids had to be encoded."""
    ud = idict = None
    if not check_int_ids(train):
        ud, idict = _encode(train, "user_id"), _encode(train, "item_id")
    data = _to_index(_to_index(train.select("user_id", "item_id", "rating"), ud, "user_id"),
                     idict, "item_id")
    return data.select("user_id", "item_id", F.col("rating").cast("float")), ud, idict


def fit_als(train: DataFrame, *, rank: int = 10, reg: float = 0.1, max_iter: int = 10,
            blocks: int = 10, seed: int = 0, checkpoint_interval: int = 5,
            cold_start: str = "nan") -> AlsFit:
    """MLlib ALS with lineage cut every ``checkpoint_interval`` iterations.

    MLlib takes int ids; when the ids do not fit, both sides are encoded to
    dense indices first (the item-encoding operator) and decoded on predict.
    """
    from pyspark.ml.recommendation import ALS
    ensure_checkpoint_dir(train.sparkSession)
    data, ud, idict = als_ids(train)
    als = ALS(userCol="user_id", itemCol="item_id", ratingCol="rating", rank=rank,
              maxIter=max_iter, regParam=reg, numUserBlocks=blocks, numItemBlocks=blocks,
              seed=seed, checkpointInterval=checkpoint_interval,
              coldStartStrategy=cold_start)
    model = als.fit(data)
    return AlsFit(model, ud, idict)


def als_predict(fit: AlsFit, pairs: DataFrame) -> DataFrame:
    """(user_id, item_id, rating, prediction) in the original ids."""
    p = pairs.select(F.col("user_id").alias("_u"), F.col("item_id").alias("_i"),
                     "user_id", "item_id", F.col("rating").cast("float"))
    p = _to_index(_to_index(p, fit.user_dict, "user_id"), fit.item_dict, "item_id")
    out = fit.model.transform(p)
    return out.select(F.col("_u").cast("long").alias("user_id"),
                      F.col("_i").cast("long").alias("item_id"),
                      F.col("rating").cast("double"),
                      F.col("prediction").cast("double").alias("prediction"))


def normal_equations(ratings: DataFrame, other: DataFrame, solve_for: str, k: int,
                     lam: float, *, n_other: int | None = None) -> DataFrame:
    """(id, n, gram array[K²], rhs array[K]) for every id of ``solve_for``.

    ``other`` holds the fixed side's factors (id, factors). The join to it
    is size-checked (broadcast or salted shuffle).
    """
    other_col = "item_id" if solve_for == "user_id" else "user_id"
    o = other.select(F.col("id").alias(other_col), F.col("factors").alias("v"))
    j = join_per_id(ratings.select("user_id", "item_id", "rating"), o, other_col,
                    n_small=n_other, row_bytes=factor_row_bytes(k),
                    salt_cols=["user_id", "item_id"])
    v, rating = F.col("v"), F.col("rating")
    # the Gram matrix is symmetric: sum the upper triangle only, K(K+1)/2 terms
    upper = [(a, b) for a in range(k) for b in range(a, k)]
    rv = elementwise(k, lambda q: at(v, q) * rating)
    j = j.select(F.col(solve_for).alias("id"), v, rv.alias("rv"))
    aggs = ([F.count(F.lit(1)).alias("n")] +
            [F.sum(at(v, a) * at(v, b)).alias(f"_g{a}_{b}") for a, b in upper] +
            [F.sum(F.element_at("rv", i + 1)).alias(f"_b{i}") for i in range(k)])
    g = j.groupBy("id").agg(*aggs)
    diag = F.lit(lam) * F.col("n").cast("double")

    def cell(a, b):
        c = F.col(f"_g{min(a, b)}_{max(a, b)}")
        return c + diag if a == b else c
    gram = F.array(*[cell(a, b) for a in range(k) for b in range(k)])
    return g.select("id", "n", gram.alias("gram"),
                    F.array(*[F.col(f"_b{i}") for i in range(k)]).alias("rhs"))


def _solve_batches(k: int):
    def solve(batches):
        for pdf in batches:
            if pdf.empty:
                yield pd.DataFrame({"id": [], "factors": []})
                continue
            G = np.stack(pdf["gram"].to_numpy()).reshape(-1, k, k)
            b = np.stack(pdf["rhs"].to_numpy()).reshape(-1, k, 1)
            x = np.linalg.solve(G, b).reshape(-1, k)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "factors": list(x)})
    return solve


def als_half_step(ratings: DataFrame, other: DataFrame, solve_for: str, k: int,
                  lam: float, **kw) -> DataFrame:
    """New factors (id, bias=0, factors) for every id of ``solve_for``."""
    ne = normal_equations(ratings, other, solve_for, k, lam, **kw)
    x = ne.select("id", "gram", "rhs").mapInPandas(_solve_batches(k),
                                                   "id long, factors array<double>")
    return x.select("id", F.lit(0.0).alias("bias"), "factors")


def als_loop(ratings: DataFrame, k: int = 10, iters: int = 5, lam: float = 0.01,
             seed: int = 0, eval_fn=None):
    """Alternate item and user half-steps; lineage cut every half-step.

    Returns (user factors, item factors, trace of eval_fn results).
    """
    users = init_factors(ratings.select("user_id").distinct(), "user_id", "u", k,
                         seed=seed, noise=1.0)
    items = init_factors(ratings.select("item_id").distinct(), "item_id", "i", k,
                         seed=seed, noise=1.0)
    users, items = cut_lineage(users), cut_lineage(items)
    n_users = users.count()
    trace = []
    for it in range(iters):
        items = cut_lineage(als_half_step(ratings, users, "item_id", k, lam, n_other=n_users))
        n_items = items.count()
        users = cut_lineage(als_half_step(ratings, items, "user_id", k, lam, n_other=n_items))
        if eval_fn is not None:
            trace.append((it + 1, eval_fn(users, items)))
    return users, items, trace


# ---- in-blocks and routing tables -------------------------------------------

#: ratings of an in-block
ROWS_PER_BLOCK = 1 << 18
#: rating rows whose outer products a task holds at a time
OUTER_ROWS = 1 << 14


@dataclass
class InBlocks:
    """Ratings of one side, laid out for its half steps."""
    ratings: DataFrame    # grp, id, other, rating: bucketed by grp
    routes: DataFrame     # other, grp: which groups need a vector; bucketed by other
    cut: bool             # some id's ratings lie in several groups
    names: tuple          # of the two tables in the session
    paths: tuple

    def drop(self) -> None:
        """Deletes the two tables."""
        spark = self.ratings.sparkSession
        for name, path in zip(self.names, self.paths, strict=True):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(spark, path)


def _bucketed(df: DataFrame, by: str, sort: list[str], kind: str) -> tuple[DataFrame, str, str]:
    """``df`` as a table bucketed by ``by``, as wide as the session's shuffles."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"als_{kind}_{uuid.uuid4().hex[:12]}", new_scratch_path(spark, "als-" + kind)
    spark.sql(f"CREATE TABLE {name} ({', '.join(f'{c} {t}' for c, t in df.dtypes)}) USING parquet "
              f"CLUSTERED BY ({by}) SORTED BY ({', '.join(sort)}) INTO {n} BUCKETS LOCATION '{path}'")
    df.repartition(n, by).write.insertInto(name)
    return spark.table(name), name, path


def in_blocks(ratings: DataFrame, solve_for: str,
              rows_per_block: int = ROWS_PER_BLOCK) -> InBlocks:
    """Deals the ratings to blocks by ``solve_for``; a block beyond
    ``rows_per_block`` is cut into pieces by the other id."""
    other = "item_id" if solve_for == "user_id" else "user_id"
    spark = ratings.sparkSession
    r = ratings.select(F.col(solve_for).alias("id"), F.col(other).alias("other"), "rating")
    blocks = max(1, math.ceil(r.count() / rows_per_block))
    r = r.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    sizes = r.groupBy("blk").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > F.lit(2 * rows_per_block))
    over = write_table(sizes.select("blk", F.ceil(F.col("n") / F.lit(rows_per_block)).alias("pieces")),
                       new_scratch_path(spark, "als-cut-blocks"))
    most = over.agg(F.max("pieces")).first()[0]
    piece = F.lit(0)
    if most:
        r = r.join(over, "blk", "left")
        piece = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64("other", F.lit("piece")), F.col("pieces")))
    grp = (piece * F.lit(blocks) + F.col("blk")).cast("long")
    table, name, path = _bucketed(r.select(grp.alias("grp"), "id", "other", "rating"),
                                  "grp", ["grp"], "ratings")
    routes, name2, path2 = _bucketed(table.select("other", "grp").distinct(), "other", ["other"],
                                     "routes")
    return InBlocks(table, routes, bool(most), (name, name2), (path, path2))


def routed_vectors(blocks: InBlocks, factors: DataFrame) -> DataFrame:
    """(grp, other, factors): each vector once for every group that needs it."""
    f = factors.select(F.col("id").alias("other"), "factors")
    return blocks.routes.join(f.hint("merge"), "other").select("grp", "other", "factors")


def _partial_sums(k: int):
    """Numpy step of a group: per id the count, the upper triangle of the Gram
    sum and the right-hand side, over the group's ratings."""
    a, b = np.triu_indices(k)

    def sums(ratings: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if ratings.empty:
            return pd.DataFrame({"id": [], "n": [], "sums": []})
        V = np.vstack(vectors["factors"].to_numpy())
        at = pd.Index(vectors["other"]).get_indexer(ratings["other"])
        order = np.argsort(ratings["id"].to_numpy(), kind="stable")
        at, rating = at[order], ratings["rating"].to_numpy(float)[order]
        ids, first, n = np.unique(ratings["id"].to_numpy()[order], return_index=True,
                                  return_counts=True)
        out = np.zeros((len(ids), len(a) + k))
        place = np.repeat(np.arange(len(ids)), n)
        for lo in range(0, len(at), OUTER_ROWS):
            v, p = V[at[lo:lo + OUTER_ROWS]], place[lo:lo + OUTER_ROWS]
            rows = np.hstack([v[:, a] * v[:, b], v * rating[lo:lo + OUTER_ROWS, None]])
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            out[p[starts]] += np.add.reduceat(rows, starts)
        return pd.DataFrame({"id": ids, "n": n, "sums": list(out)})

    return sums


def _solve_sums(k: int, lam: float):
    a, b = np.triu_indices(k)

    def solve(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            s = np.vstack(pdf["sums"].to_numpy())
            G = np.zeros((len(s), k, k))
            G[:, a, b] = G[:, b, a] = s[:, :len(a)]
            G[:, np.arange(k), np.arange(k)] += lam * pdf["n"].to_numpy(float)[:, None]
            x = np.linalg.solve(G, s[:, len(a):, None])[:, :, 0]
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "factors": list(x)})
    return solve


def als_blocked_half_step(blocks: InBlocks, factors: DataFrame, k: int, lam: float) -> DataFrame:
    """New factors (id, bias=0, factors) of the side that ``blocks`` solves."""
    width = k * (k + 1) // 2 + k
    sums = (blocks.ratings.groupBy("grp").cogroup(routed_vectors(blocks, factors).groupBy("grp"))
            .applyInPandas(_partial_sums(k), "id long, n long, sums array<double>"))
    if blocks.cut:   # the pieces of an id are added up
        s = sums.groupBy("id").agg(F.sum("n").alias("n"), *[
            F.sum(F.element_at("sums", q + 1)).alias(f"_s{q}") for q in range(width)])
        sums = s.select("id", "n", F.array(*[F.col(f"_s{q}") for q in range(width)]).alias("sums"))
    x = sums.mapInPandas(_solve_sums(k, lam), "id long, factors array<double>")
    return x.select("id", F.lit(0.0).alias("bias"), "factors")


def als_blocked_loop(ratings: DataFrame, k: int = 10, iters: int = 5, lam: float = 0.01,
                     seed: int = 0, rows_per_block: int = ROWS_PER_BLOCK, eval_fn=None):
    """``als_loop`` over in-blocks; the ratings are computed once and stored, the
    factors of each half step too; superseded ones and all ratings are deleted."""
    spark = ratings.sparkSession
    path = new_scratch_path(spark, "als-train")
    ratings = write_table(ratings.select("user_id", "item_id", "rating"), path)
    for_users = in_blocks(ratings, "user_id", rows_per_block)
    for_items = in_blocks(ratings, "item_id", rows_per_block)
    drop_path(spark, path)
    held: dict[str, str] = {}

    def store(side: str, df: DataFrame) -> DataFrame:
        path = new_scratch_path(spark, "als-factors")
        out = write_table(df, path)
        if side in held:
            drop_path(spark, held[side])
        held[side] = path
        return out

    users = store("u", init_factors(for_users.ratings.select("id").distinct(), "id", "u", k,
                                    seed=seed, noise=1.0))
    items, trace = None, []
    for it in range(iters):
        items = store("i", als_blocked_half_step(for_items, users, k, lam))
        users = store("u", als_blocked_half_step(for_users, items, k, lam))
        if eval_fn is not None:
            trace.append((it + 1, eval_fn(users, items)))
    if items is None:
        items = store("i", init_factors(for_items.ratings.select("id").distinct(), "id", "i", k,
                                        seed=seed, noise=1.0))
    for_users.drop()
    for_items.drop()
    return users, items, trace

"""ALS half-step, dense RMSE by Gram matrices, AUROC with ties."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from latentforge.plans import als, evaluate as ev
from latentforge.plans import factors as fac
from latentforge.sources import synth, tables
from tests.conftest import SF_SMALL


def test_half_step_k1_closed_form(spark):
    r = tables.ratings_view(spark, SF_SMALL).select("user_id", "item_id", "rating")
    users = fac.init_factors(r.select("user_id").distinct(), "user_id", "u", 1)
    x = {row.id: row.factors[0] for row in als.als_half_step(r, users, "item_id", 1, 0.1).collect()}
    u = {row.id: row.factors[0] for row in users.collect()}
    pdf = r.toPandas()
    pdf["u"] = pdf.user_id.map(u)
    g = pdf.groupby("item_id").apply(
        lambda d: (d.u * d.rating).sum() / ((d.u ** 2).sum() + 0.1 * len(d)), include_groups=False)
    assert all(np.isclose(x[i], v) for i, v in g.items())


def test_half_step_k3_matches_numpy(spark):
    r = tables.ratings_view(spark, SF_SMALL).select("user_id", "item_id", "rating").limit(800)
    r = r.cache()
    users = fac.init_factors(r.select("user_id").distinct(), "user_id", "u", 3, noise=1.0)
    got = {row.id: np.array(row.factors) for row in
           als.als_half_step(r, users, "item_id", 3, 0.1).collect()}
    U = {row.id: np.array(row.factors) for row in users.collect()}
    pdf = r.toPandas()
    for item, d in pdf.groupby("item_id"):
        V = np.stack([U[u] for u in d.user_id])
        G = V.T @ V + 0.1 * len(d) * np.eye(3)
        b = V.T @ d.rating.to_numpy()
        assert np.allclose(got[item], np.linalg.solve(G, b))


def test_als_loop_reduces_train_error(spark):
    pairs = tables.ratings_view(spark, SF_SMALL).select("user_id", "item_id").distinct()
    r = synth.synth_ratings(pairs, rank=3, seed=2).cache()

    def err(u, i):
        return ev.rmse(ev.score(r, u, i, 0.0, 3, biased=False)).first()["rmse"]
    _, _, trace = als.als_loop(r, k=3, iters=3, lam=0.01, eval_fn=err)
    vals = [v for _, v in trace]
    assert vals[-1] <= vals[0] + 1e-9
    assert vals[-1] < r.agg(F.stddev("rating")).first()[0]


def test_rmse_dense_equals_brute_force(spark):
    users = spark.range(1, 31).select(F.col("id").alias("user_id"))
    items = spark.range(1, 21).select(F.col("id").alias("item_id"))
    uf = fac.init_factors(users, "user_id", "u", 3, noise=0.5)
    itf = fac.init_factors(items, "item_id", "i", 3, noise=0.5)
    ut = synth.planted_factors(users, "user_id", "u", 2)
    it = synth.planted_factors(items, "item_id", "m", 2)
    got = ev.rmse_dense(uf, itf, ut, it).first()
    M = np.stack([x.factors for x in itf.orderBy("id").collect()])
    U = np.stack([x.factors for x in uf.orderBy("id").collect()])
    M0 = np.stack([x.factors for x in it.orderBy("id").collect()])
    U0 = np.stack([x.factors for x in ut.orderBy("id").collect()])
    ref = np.sqrt(np.mean((M @ U.T - M0 @ U0.T) ** 2))
    assert np.isclose(got.rmse, ref) and got.n_items == 20 and got.n_users == 30


def test_auroc_with_ties_matches_rank_formula(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"score": rng.integers(0, 20, 500).astype(float),
                        "label": rng.integers(0, 2, 500).astype(float)})
    got = ev.auroc(spark.createDataFrame(pdf)).first().auroc
    ranks = pdf.score.rank()   # mid-ranks
    p = (pdf.label == 1).sum()
    n = len(pdf) - p
    ref = (ranks[pdf.label == 1].sum() - p * (p + 1) / 2) / (p * n)
    assert np.isclose(got, ref)


def test_evaluators_agree(spark):
    from latentforge.plans import linear
    pdf = pd.DataFrame({"rating": [1.0, 2.0, 3.0, 4.0], "prediction": [1.5, float("nan"), 2.0, 4.5]})
    pred = spark.createDataFrame(pdf)
    assert np.isclose(ev.rmse_evaluator(pred), ev.rmse_nan_safe(pred).first().rmse)
    rows = linear.embedding_rows(tables.table(spark, SF_SMALL, "embeddings"), 0)
    scored = linear.svm_scores(linear.fit_svm(rows, max_iter=10), rows)
    assert np.isclose(ev.auroc(scored).first().auroc, ev.auroc_evaluator(scored))


def test_als_sweep_picks_min(spark):
    from latentforge.plans import tuning
    r = tables.ratings_view(spark, SF_SMALL).select("user_id", "item_id", "rating")
    out = tuning.als_sweep(r, ranks=(2, 4), regs=(0.1,), max_iter=2, blocks=2).toPandas()
    assert len(out) == 2 and out.is_best.sum() == 1
    assert out.loc[out.is_best, "rmse"].iloc[0] == out.rmse.min()


def test_fit_als_encodes_wide_ids(spark):
    # ids beyond int range are encoded for MLlib and decoded on predict
    r = tables.ratings_view(spark, SF_SMALL).select(
        (F.col("user_id") + F.lit(10 ** 12)).alias("user_id"),
        (F.col("item_id") + F.lit(10 ** 11)).alias("item_id"), "rating")
    fit = als.fit_als(r, rank=3, max_iter=2, blocks=2)
    assert fit.user_dict is not None
    pred = als.als_predict(fit, r)
    assert pred.count() == r.count()
    assert pred.agg(F.min("user_id")).first()[0] >= 10 ** 12
    assert pred.where(F.isnan("prediction")).count() == 0


def test_sgd_sweep_is_registered(spark):
    from latentforge import catalog
    rows = catalog.QUERIES["fit_sgd_sweep"](spark, SF_SMALL).collect()
    assert {r.config for r in rows} == set(catalog.SGD_NAMES) and len(set(catalog.SGD_NAMES)) == 3
    assert {(r.epoch, r.split) for r in rows} == {(e, s) for e in (0, 3) for s in ("train", "test")}
    assert len(rows) == 12 and all(r.finite == 1 and r.n > 0 for r in rows)
    (best,) = catalog.QUERIES["fit_sgd_best_config"](spark, SF_SMALL).collect()
    assert (best.n_best, best.known, best.finite) == (1, 1, 1)
    assert best.n_test == next(r.n for r in rows if r.split == "test")

"""Model operators: the SGD update rule, planted-model quality, hot ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentforge.operators import joins, prep
from latentforge.plans import evaluate as ev
from latentforge.plans import factors as fac
from latentforge.plans import sgd
from latentforge.sources import synth, tables
from tests.conftest import SF_SMALL


def _one_rating(spark):
    return spark.createDataFrame([(5, 9, 4.0)], "user_id long, item_id long, rating double")


@pytest.mark.parametrize("biased,train_dims", [(True, None), (False, None), (True, 2)])
def test_one_rating_block_equals_delta(spark, biased, train_dims):
    r = _one_rating(spark)
    p = fac.SgdParams(k=4, epochs=1, lr=0.1, lr_bias=0.5, lam=0.1, bias_reg=0.1,
                      decay=1.0, biased=biased, train_dims=train_dims)
    mu = 3.0 if biased else 0.0
    m = sgd.fit_sgd(r, p, blocks=1, mu=mu)
    uf, itf = fac.init_model(r, p)
    d = fac.sgd_deltas(joins.join_factors(r, uf, itf, 4), mu, p).first()
    u = m.user_factors.first()
    i = m.item_factors.first()
    assert np.allclose(u.factors, d.new_fu) and np.allclose(i.factors, d.new_fi)
    assert np.isclose(u.bias, d.new_bu) and np.isclose(i.bias, d.new_bi)
    if train_dims:
        assert np.allclose(u.factors[train_dims:], uf.first().factors[train_dims:])


def _planted(spark):
    pairs = tables.ratings_view(spark, SF_SMALL).select("user_id", "item_id").distinct()
    return synth.synth_ratings(pairs, rank=4, seed=1).cache()


def test_planted_sgd_learns(spark):
    r = _planted(spark)
    train, test = prep.train_test_split(r, 0)
    sd = r.agg(F.stddev("rating")).first()[0]
    p = fac.SgdParams(k=8, epochs=8, lr=0.05, lr_bias=0.02, lam=0.02, bias_reg=1.0,
                      decay=1.0)
    m = sgd.fit_sgd(train, p, blocks=4, eval_sets={"test": test}, trace_every=4)
    final = [x for x in m.trace if x[1] == "test"]
    assert final[-1][2] < 0.75 * sd
    assert final[-1][2] < final[0][2]
    # one row per trained id, all finite
    n_users = train.select("user_id").distinct().count()
    assert m.user_factors.count() == n_users
    assert m.user_factors.select("id").distinct().count() == n_users
    vals = np.concatenate([np.asarray(x.factors) for x in m.item_factors.collect()])
    assert np.isfinite(vals).all()


def test_same_seed_same_model(spark):
    r = _planted(spark)
    p = fac.SgdParams(k=4, epochs=2, lr=0.05, lr_bias=0.02, lam=0.02, decay=1.0)
    a = {x.id: x.factors for x in sgd.fit_sgd(r, p, blocks=4).user_factors.collect()}
    b = {x.id: x.factors for x in sgd.fit_sgd(r.repartition(7), p, blocks=4)
         .user_factors.collect()}
    assert a.keys() == b.keys()
    assert all(np.allclose(a[k], b[k]) for k in a)


def test_hot_ids_are_split_and_merged(spark):
    # one user holds a third of all ratings: it is trained as several replicas
    base = _planted(spark)
    hot = base.select(F.lit(999999).cast("long").alias("user_id"), "item_id", "rating")
    r = base.unionByName(hot)
    p = fac.SgdParams(k=4, epochs=2, lr=0.05, lr_bias=0.02, lam=0.02, decay=1.0)
    m = sgd.fit_sgd(r, p, blocks=4, split_threshold=500)
    ids = [x.id for x in m.user_factors.collect()]
    assert len(ids) == len(set(ids)) == r.select("user_id").distinct().count()
    assert 999999 in set(ids)
    big = m.block_sizes.agg(F.max("n_ratings")).first()[0]
    assert big < hot.count()


def test_sampled_pairs_one_per_user_position(spark):
    r = _planted(spark)
    n = r.select("user_id").distinct().count()
    s = sgd.sampled_pairs(r.select("user_id", "item_id"), seed=0, epoch=0)
    assert s.count() == n
    assert sorted(x.position for x in s.collect()) == list(range(n))


def test_gradient_matches_numpy(spark):
    r = _planted(spark).limit(300).cache()
    p = fac.SgdParams(k=3, lam=0.1, bias_reg=0.1)
    uf, itf = fac.init_model(r, p)
    g = {(x.side, x.id, x.k): x.grad for x in
         fac.gradient_step(joins.join_factors(r, uf, itf, 3), 1.0, p).collect()}
    U = {x.id: np.array(x.factors) for x in uf.collect()}
    V = {x.id: np.array(x.factors) for x in itf.collect()}
    ref = {}
    for x in r.collect():
        e = x.rating - (1.0 + U[x.user_id] @ V[x.item_id])
        gu = e * V[x.item_id] - 0.1 * U[x.user_id]
        gi = e * U[x.user_id] - 0.1 * V[x.item_id]
        for k in range(3):
            ref[("user", x.user_id, k)] = ref.get(("user", x.user_id, k), 0) + gu[k]
            ref[("item", x.item_id, k)] = ref.get(("item", x.item_id, k), 0) + gi[k]
    for key_, v in ref.items():
        assert np.isclose(g[key_], v)


def test_hot_item_is_split_and_merged(spark):
    base = _planted(spark)
    hot = base.select("user_id", F.lit(888888).cast("long").alias("item_id"), "rating")
    r = base.unionByName(hot.dropDuplicates(["user_id"]))
    r = r.unionByName(base.select((F.col("user_id") + 100000).alias("user_id"),
                                  F.lit(888888).cast("long").alias("item_id"), "rating"))
    p = fac.SgdParams(k=4, epochs=2, lr=0.05, lr_bias=0.02, lam=0.02, decay=1.0)
    m = sgd.fit_sgd(r, p, blocks=4, split_threshold=500)
    items = [x.id for x in m.item_factors.collect()]
    assert len(items) == len(set(items)) == r.select("item_id").distinct().count()
    n_hot = r.where("item_id = 888888").count()
    assert n_hot > r.count() / 3
    assert m.block_sizes.agg(F.max("n_ratings")).first()[0] < n_hot
    vals = np.concatenate([np.asarray(x.factors) for x in m.item_factors.collect()])
    assert np.isfinite(vals).all()


def test_step_schedule_and_gaussian_init(spark):
    r = _planted(spark)
    train, test = prep.train_test_split(r, 0)
    p = fac.SgdParams(k=4, epochs=2, lr=0.05, lr_bias=0.02, lam=0.02, bias_reg=1.0,
                      decay=0.99999, schedule="step", gaussian_init=True, noise=0.05)
    m = sgd.fit_sgd(train, p, blocks=2, eval_sets={"test": test}, trace_every=2)
    first, last = m.trace[0][2], m.trace[-1][2]
    assert np.isfinite(last) and last < first


def test_any_long_ids_with_a_split_id(spark):
    """Negative and very large ids stay themselves, split or not."""
    rows = [(u, i, float((u + i) % 5 + 1)) for u in (-7, -5, 9, 2 ** 45)
            for i in range(-40, 40)] + [(77, i, 3.0) for i in range(-300, 300)]
    r = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    m = sgd.fit_sgd(r, fac.SgdParams(k=3, epochs=2, decay=1.0, lr=0.02), blocks=2,
                    split_threshold=100)
    got = {x.id: x.n_updates for x in m.user_factors.collect()}
    assert got == {-7: 160, -5: 160, 9: 160, 2 ** 45: 160, 77: 1200}
    assert {x.id for x in m.item_factors.collect()} == set(range(-300, 300))
    assert m.user_factors.agg(F.sum("n_updates")).first()[0] == 2 * len(rows)


def test_gradient_descent_lowers_the_error(spark):
    from latentforge.plans.gradient import fit_gradient
    r = _planted(spark)
    both = r.withColumn("split", F.lit("all"))
    p = fac.SgdParams(k=3, epochs=6, lr=0.5, lr_bias=0.5, lam=0.01, decay=1.0)
    _, _, trace = fit_gradient(r, p, eval_set=both, trace_every=5)
    assert [t[1] for t in trace] == [0, 5, 6]
    assert trace[-1][4] < trace[0][4]

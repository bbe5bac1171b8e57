"""Blocks in pieces: bounded groups with a hot user, and still serial SGD."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentforge.plans import factors as fac
from latentforge.plans import sgd

ROWS = 40


def hot_ratings(spark):
    """One user and one item hold about a third of the ratings each."""
    rng = np.random.default_rng(4)
    pairs = {(0, i) for i in range(200)} | {(u, 3) for u in range(180)}
    while len(pairs) < 600:
        pairs.add((int(rng.integers(0, 180)), int(rng.integers(0, 200))))
    return spark.createDataFrame([(u, i, float(rng.integers(1, 6))) for u, i in sorted(pairs)],
                                 "user_id long, item_id long, rating double")


def serial(rows, f0, mu, p):
    """The pass over (stratum, user block, piece, order of the epoch)."""
    u, i, r, ord_ = (np.array([x[c] for x in rows]) for c in ("user_id", "item_id", "rating", "ord"))
    outer = [np.array([x[c] for x in rows]) for c in ("piece", "ublk", "stratum")]
    bias = {k: 0.0 for k in f0}
    vec = {k: np.array(v) for k, v in f0.items()}
    done = 0
    for e in range(p.epochs):
        for t in np.lexsort((i, u, sgd.epoch_order(ord_, e), *outer)):
            a, b = ("u", u[t]), ("i", i[t])
            err = r[t] - (mu + bias[a] + bias[b] + vec[a] @ vec[b])
            rate = p.lr * p.decay ** (done if p.schedule == "step" else e)
            for x in (a, b):
                bias[x] += p.lr_bias * (err - p.bias_reg * p.lam * bias[x])
            vec[a], vec[b] = (vec[a] + rate * (err * vec[b] - p.lam * vec[a]),
                              vec[b] + rate * (err * vec[a] - p.lam * vec[b]))
            done += 1
    return bias, vec


@pytest.mark.parametrize("schedule,decay", [("epoch", 0.9), ("step", 0.999)])
def test_pieces_are_bounded_and_equal_serial_sgd(spark, schedule, decay):
    train = hot_ratings(spark)
    p = fac.SgdParams(k=3, epochs=2, lr=0.05, lr_bias=0.05, decay=decay, schedule=schedule)
    ready = sgd.prepare(train, rows_per_block=ROWS)
    assert ready.pieces and ready.reps is None
    group = ["stratum", "ublk", "piece"]
    assert ready.ratings.groupBy(*group).count().agg(F.max("count")).first()[0] <= 2 * ROWS
    # without pieces a block of the hot user would be beyond that
    assert ready.ratings.groupBy("stratum", "ublk").count().agg(F.max("count")).first()[0] > 2 * ROWS
    m = sgd.fit_sgd(p=p, prepared=ready)
    rows = ready.ratings.collect()
    assert len(rows) == 600
    f0 = {}
    for kind, col in (("u", "user_id"), ("i", "item_id")):
        for x in fac.init_factors(train.select(col).distinct(), col, kind, 3).collect():
            f0[(kind, x["id"])] = x["factors"]
    bias, vec = serial(rows, f0, ready.mu, p)
    for kind, f in (("u", m.user_factors), ("i", m.item_factors)):
        got = f.collect()
        assert len(got) == len({x["user_id" if kind == "u" else "item_id"] for x in rows})
        for x in got:
            assert abs(x["bias"] - bias[(kind, x["id"])]) < 1e-9
            assert np.allclose(x["factors"], vec[(kind, x["id"])], atol=1e-9)
        counts = {x["id"]: x["n_updates"] for x in got}
        assert sum(counts.values()) == 2 * 600


def test_same_model_on_any_partitioning(spark):
    p = fac.SgdParams(k=2, epochs=1)
    a, b = (sorted((x["id"], x["bias"], tuple(x["factors"])) for x in sgd.fit_sgd(
        hot_ratings(spark).repartition(n), p, rows_per_block=ROWS).user_factors.collect())
        for n in (1, 7))
    assert a == b

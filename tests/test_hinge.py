"""SVM by hinge steps, against numpy."""

import numpy as np
import pytest

from latentforge.plans import evaluate as ev
from latentforge.plans import linear


def data(spark, n=400, d=5, parts=3):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d))
    y = (x @ np.array([1.0, -2.0, 0.5, 0.0, 0.0]) + 0.3 > 0).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * d, None)]
    return x, 2.0 * y - 1, spark.createDataFrame(
        rows, "vec_id long, features array<double>, label int").repartition(parts)


@pytest.mark.parametrize("intercept", [True, False])
def test_full_batch_equals_numpy(spark, intercept):
    x, y, rows = data(spark)
    m = linear.fit_hinge(rows, 5, steps=6, step_size=0.7, reg=0.05, intercept=intercept)
    w, c = np.zeros(5), 0.0
    for t in range(1, 7):
        on = y * (x @ w + c) < 1
        eta = 0.7 / np.sqrt(t)
        step = -(y * on) @ x / len(y)
        w = (1 - eta * 0.05) * w - eta * step
        c -= eta * -(y * on).mean() if intercept else 0
    assert np.allclose(m.weights, w, atol=1e-12) and abs(m.intercept - c) < 1e-12
    assert [t for t, _, _ in m.trace] == [*range(1, 7)] and all(n == 400 for _, n, _ in m.trace)


def test_mini_batches_are_drawn_by_key_and_learn(spark):
    _, _, rows = data(spark)
    a = linear.fit_hinge(rows, 5, steps=15, fraction=0.4, seed=3)
    b = linear.fit_hinge(rows.repartition(9), 5, steps=15, fraction=0.4, seed=3)
    assert np.allclose(a.weights, b.weights, atol=1e-12)
    sizes = [n for _, n, _ in a.trace]
    assert len(set(sizes)) > 1 and all(100 < n < 220 for n in sizes)
    scored = linear.hinge_scores(a, rows.where("label is not null and features is not null"))
    auroc = ev.auroc(scored.selectExpr("score", "cast(label as double) as label")).first()["auroc"]
    assert auroc > 0.97 and a.trace[-1][2] < a.trace[0][2]


def test_no_rows_change_nothing(spark):
    _, _, rows = data(spark)
    m = linear.fit_hinge(rows.where("vec_id < 0"), 5, steps=2)
    assert m.weights == [0.0] * 5 and m.trace == [(1, 0, None), (2, 0, None)]

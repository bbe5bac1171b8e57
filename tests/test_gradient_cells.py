"""Gradient descent of many settings in one pass over cells of the ratings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sgd_pieces import hot_ratings

from latentforge.plans import factors as fac
from latentforge.plans import gradient, sgd

BASE = fac.SgdParams(k=3, epochs=2, lr=0.3, lr_bias=0.4, lam=0.05)
SETTINGS = {"base": BASE, "short": sgd.with_params(BASE, k=2, epochs=1, lam=0.5),
            "plain": sgd.with_params(BASE, biased=False, decay=0.5),
            "dims": sgd.with_params(BASE, train_dims=1, noise=0.7)}


def numpy_traces(spark, train_df, test_df, p):
    train, test = ([tuple(x) for x in d.collect()] for d in (train_df, test_df))
    mu = float(np.mean([r for _, _, r in train if r is not None])) if p.biased else 0.0
    vec, bias = {}, {}
    for df, s in zip(fac.init_model(train_df, p), "ui", strict=True):
        for x in df.collect():
            if x["id"] is not None:
                vec[s, x["id"]], bias[s, x["id"]] = np.array(x["factors"]), 0.0

    def pred(u, i):
        both = ("u", u) in vec and ("i", i) in vec
        d = vec["u", u] @ vec["i", i] if both else 0.0
        return d + (mu + bias.get(("u", u), 0.0) + bias.get(("i", i), 0.0) if p.biased else 0.0)

    out = []
    for e in range(p.epochs + 1):
        for name, rows in (("train", train), ("test", test)):
            errors = [(r - pred(u, i)) ** 2 for u, i, r in rows if r is not None]
            out.append((e, name, len(rows), math.sqrt(np.mean(errors))))
        g, gb, n = {}, {}, {}
        for u, i, r in train:
            a, b = ("u", u), ("i", i)
            if a not in vec or b not in vec:
                continue
            for own, far in ((a, b), (b, a)):
                n[own] = n.get(own, 0) + 1
                if r is not None:
                    err = r - pred(u, i)
                    g[own] = g.get(own, 0) + err * vec[far] - p.lam * vec[own]
                    gb[own] = gb.get(own, 0) + err - p.bias_reg * p.lam * bias[own]
        kk = p.k if p.train_dims is None else p.train_dims
        for x, count in n.items():
            step = p.lr * p.decay ** e * g[x] / count
            step[kk:] = 0.0
            vec[x] = vec[x] + step
            bias[x] += p.lr_bias * gb[x] / count if p.biased else 0.0
        for x in [x for x in vec if x not in n]:
            del vec[x], bias[x]
    return out


@pytest.mark.parametrize("side_blocks,cell_rows", [(1, 10 ** 6), (3, 40)])
def test_traces_equal_plain_gradient_descent(spark, side_blocks, cell_rows, monkeypatch):
    odd = spark.createDataFrame([(None, 3, 4.0), (5, None, 2.0), (3, 900, None), (3, 901, 5.0),
                                 (901, None, 1.0), (3, 900, 2.0)], hot_ratings(spark).schema)
    train = hot_ratings(spark).unionByName(odd)
    test = spark.createDataFrame([(0, 3, 4.0), (5, 777, 2.0), (901, 4, 1.0), (None, None, 3.0)],
                                 train.schema)
    marked = (train.withColumn("split", F.lit("train")).withColumn("trains", F.lit(True))
              .unionByName(test.withColumn("split", F.lit("test")).withColumn("trains", F.lit(False)))
              .withColumn("counted", F.lit(True)))
    calls, made = [], gradient.cell_sums
    monkeypatch.setattr(gradient, "cell_sums", lambda *a: calls.append(a) or made(*a))
    got = gradient.gradient_sweep(marked, SETTINGS, side_blocks=side_blocks,
                                  cell_rows=cell_rows).collect()
    assert len(calls) == 3       # one pass an epoch for all settings and both sets, and the last
    for name, p in SETTINGS.items():
        want = {x[:2]: x[2:] for x in numpy_traces(spark, train, test, p)}
        mine = {(x["epoch"], x["split"]): (x["n"], x["rmse"]) for x in got if x["config"] == name}
        assert mine.keys() == want.keys()
        for x, (n, rmse) in want.items():
            assert mine[x][0] == n and abs(mine[x][1] - rmse) < 1e-9, (name, x)


def test_cells_of_a_hot_id_are_bounded(spark):
    marked = hot_ratings(spark).withColumn("trains", F.lit(True)).withColumn("counted", F.lit(True))
    cells, n = gradient._cells(marked, 2, 40)
    piece = F.pmod(F.xxhash64("user_id", "item_id"), F.col("pieces"))
    placed = marked.select("*", *gradient._blocks(2)).join(cells, ["ub", "ib"]).where(
        F.col("piece") == piece)
    sizes = [x["count"] for x in placed.groupBy("label").count().collect()]
    assert sum(sizes) == 600 and max(sizes) < 90 and n > 4

"""Factors and ratings in chunks: bounded groups, the same step, the same errors."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from test_block_step import _ratings, _side
from test_sgd_pieces import hot_ratings

from latentforge import catalog, session
from latentforge.plans import evaluate as ev
from latentforge.plans import factors as fac
from latentforge.plans import gradient, packed, sgd, tuning


def test_groups_are_bounded_by_the_bytes_of_their_factors(spark):
    p = fac.SgdParams(k=2, epochs=1, lr=0.05, lr_bias=0.05)
    train = hot_ratings(spark)
    wide = sgd.prepare(train, rows_per_block=1)
    ready = sgd.prepare(train, rows_per_block=1, values=100, group_bytes=380 * 8 * 102 // 13)
    assert wide.blocks == ready.blocks == 25 and wide.groups == 7 and ready.groups == 13
    got, want = (sorted((x["id"], x["bias"], tuple(x["factors"]), x["n_updates"]) for x in sgd.fit_sgd(
        p=p, prepared=r).user_factors.collect()) for r in (ready, wide))
    assert got == want


def test_a_step_over_chunks_is_the_step_over_rows(monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_BYTES", 5 * 8 * 4)    # four rows a chunk
    rng = np.random.default_rng(5)
    r = _ratings(rng.integers(0, 20, 300), rng.integers(0, 15, 300),
                 rng.integers(1, 6, 300).astype(float), rng.integers(0, 2 ** 28, 300))
    f = pd.concat([_side("u", np.arange(20), rng.random((20, 4))),
                   _side("i", np.arange(15), rng.random((15, 4)))])
    step = sgd._make_step(3.0, fac.SgdParams(k=4), 0, 300)
    want = step(r, f)
    chunks = []
    for kind in "ui":
        own = f[f["kind"] == kind]
        body = np.column_stack([own["bias"], np.vstack(own["factors"])])
        chunks += packed.factor_chunks(kind, 3, own["id"].to_numpy(), np.ones(len(own), bool), body,
                                       own["n_updates"].to_numpy())
    cols = {"user_id": np.int64, "item_id": np.int64, "rating": np.float64, "ord": np.int64}
    halves = [b"".join(h[c].to_numpy().astype(t).tobytes() for c, t in cols.items())
              for h in (r[:100], r[100:])]
    given = pa.Table.from_batches(chunks)
    assert given.num_rows == 9 and max(len(x.as_py()) for x in given["body"]) == packed.CHUNK_BYTES
    run = packed.on_chunks(step.update, cols)
    got = run(pa.table({"data": pa.array(halves, pa.binary())}), given)
    for kind in "ui":
        side, rows = packed.Side(got, kind), want[want["kind"] == kind]
        assert (side.ids == rows["id"]).all() and (side.count == rows["n_updates"]).all()
        assert (side.body[:, 0] == rows["bias"]).all() and side.blk == 3
        assert np.allclose(side.body[:, 1:], np.vstack(rows["factors"]), rtol=0, atol=1e-14)
    none = pa.table({"data": pa.array([], pa.binary())})
    assert run(none, given).equals(given)


def test_a_fit_moves_chunks_and_takes_null_ids(spark, monkeypatch):
    odd = spark.createDataFrame([(None, 3, 4.0), (5, None, 2.0), (None, None, 1.0)],
                                hot_ratings(spark).schema)
    train, seen, plain = hot_ratings(spark).unionByName(odd), [], sgd.stratum_step
    monkeypatch.setattr(sgd, "stratum_step", lambda f, *a: seen.append(
        (f.columns, 0 if seen else f.count())) or plain(f, *a))
    m = sgd.fit_sgd(train, fac.SgdParams(k=2, epochs=1), rows_per_block=100)
    # a chunk for each side and block, not a row for each of 382 ids
    assert all(columns == packed.COLUMNS for columns, _ in seen) and seen[0][1] == 2 * m.blocks
    for side, col in ((m.user_factors, "user_id"), (m.item_factors, "item_id")):
        want = {x[0]: x[1] for x in train.groupBy(col).count().collect()}
        assert {x["id"]: x["n_updates"] for x in side.collect()} == want and None in want


def test_errors_from_the_blocks_are_those_of_the_join(spark, monkeypatch):
    train = hot_ratings(spark)
    odd = spark.createDataFrame([(None, 3, 4.0), (5, None, 2.0), (10 ** 9, 3, 1.0), (7, 10 ** 9, 5.0),
                                 (3, 4, None), (10 ** 9, 10 ** 9, 2.0)], train.schema)
    sets = {"train": train, "test": odd, "none": odd.limit(0), "unrated": odd.where("rating IS NULL")}
    monkeypatch.setattr(sgd, "TRACE_BYTES", 40_000)     # a few stages a job
    joins = []
    monkeypatch.setattr(ev, "score", lambda *a, **k: joins.append(a))
    # a null rating leaves its user and item, and whom they meet later, without features
    unrated = spark.createDataFrame([(178, 198, None)], train.schema)
    for rows, biased, train in ((40, True, train), (200, False, train),
                                (200, True, train.unionByName(unrated))):
        sets["train"] = train
        p = fac.SgdParams(k=3, epochs=1, lr=0.05, lr_bias=0.05, biased=biased)
        ready = sgd.prepare(train, rows_per_block=rows)
        m = sgd.fit_sgd(p=p, prepared=ready, eval_sets=sets)
        u, i = ({x["id"]: x for x in f.collect()} for f in (m.user_factors, m.item_factors))
        got = {x[1]: (x[3], x[2]) for x in m.trace if x[0] == 1}
        for name, df in sets.items():
            errors, data = [], df.collect()
            for a, b, r in data:
                e = (m.mu + sum(s[c]["bias"] or 0.0 for s, c in ((u, a), (i, b)) if c in s)
                     if biased else 0.0)
                if a in u and b in i:
                    e += np.dot(np.array(u[a]["factors"], float), np.array(i[b]["factors"], float))
                errors += [(r - e) ** 2] if r is not None and not np.isnan(e) else []
            n, rmse = got[name]
            assert n == len(data) and (rmse is None) == (not errors)
            assert rmse is None or abs(rmse - math.sqrt(np.mean(errors))) < 1e-9
    assert not joins
    assert any(None in x["factors"] and x["bias"] is None for x in u.values())


def test_shuffle_files_are_released(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(session, "release", lambda s: calls.append(1))
    train = hot_ratings(spark)
    sgd.fit_sgd(train, fac.SgdParams(k=2, epochs=1), rows_per_block=10 ** 6)
    assert not calls
    monkeypatch.setattr(sgd, "RELEASE_BYTES", 1)
    sgd.fit_sgd(train, fac.SgdParams(k=2, epochs=1), rows_per_block=10 ** 6)
    assert len(calls) == 2      # the first factors, and those of the epoch


def test_every_fit_of_the_als_sweep_begins_with_a_release(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(session, "release", lambda s: calls.append(1))
    out = tuning.als_sweep(hot_ratings(spark), ranks=(2,), regs=(0.1, 0.5), max_iter=1, blocks=2)
    assert len(calls) == 3      # two settings, and the best one again
    assert out.where("is_best").count() == 1


def test_settings_beyond_the_bytes_of_a_cell_take_several_passes(spark, monkeypatch):
    train = hot_ratings(spark).withColumn("trains", F.lit(True)).withColumn("counted", F.lit(True))
    p = fac.SgdParams(k=2, epochs=1, lr=0.3, lr_bias=0.4)
    ps = {"a": p, "b": sgd.with_params(p, lam=0.5), "c": sgd.with_params(p, k=1)}

    def fit():
        rows, trace = gradient.fit_settings(train, ps, side_blocks=2)
        return ({(x["side"], x["id"]): x["values"] for x in rows.collect()},
                {x[:2]: x[2:] for x in trace})

    want, traced = fit()
    widths, plain = [], gradient.cell_sums
    monkeypatch.setattr(gradient, "cell_sums",
                        lambda s, *a: widths.append(sum(x.k + 1 for x in s)) or plain(s, *a))
    monkeypatch.setattr(gradient, "CELL_BYTES", 190 * 8 * 4)
    got, again = fit()
    assert widths == [3, 3, 3, 3, 2, 2]     # a row of all settings has 8 numbers
    assert got.keys() == want.keys() and len(want) == 380
    assert all(np.allclose(got[x], want[x], rtol=0, atol=1e-12) for x in want)
    assert again.keys() == traced.keys()
    assert all(a[0] == b[0] == 600 and abs(a[1] - b[1]) < 1e-12
               for a, b in zip(again.values(), (traced[x] for x in again), strict=True))


def test_the_split_is_stored(spark):
    """The flag of a rating is hashed once, not by each read of one side."""
    for df in catalog._stored_split(spark, "/root/testdata/sf0.001"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "md5" not in plan and df.columns == ["user_id", "item_id", "rating"]
    assert df.where(F.col("rating").isNull()).count() == 0

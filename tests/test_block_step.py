"""The vectorised block step equals a plain serial SGD loop (no Spark)."""

import numpy as np
import pandas as pd
import pytest

from latentforge.plans import factors as fac
from latentforge.plans import sgd


def _serial(r, U, V, bu, bi, seq, mu, p, rates):
    kk = U.shape[1] if p.train_dims is None else p.train_dims
    breg = p.bias_reg * p.lam
    for t, lr in zip(seq, rates, strict=True):
        a, b = r.user_id[t], r.item_id[t]
        fu, fi = U[a], V[b]
        pred = fu @ fi + ((mu + bu[a] + bi[b]) if p.biased else 0.0)
        e = r.rating[t] - pred
        if p.biased:
            bu[a] += p.lr_bias * (e - breg * bu[a])
            bi[b] += p.lr_bias * (e - breg * bi[b])
        old = fu[:kk].copy()
        fu[:kk] += lr * (e * fi[:kk] - p.lam * fu[:kk])
        fi[:kk] += lr * (e * old - p.lam * fi[:kk])


def _side(kind, ids, vectors, rep=0):
    return pd.DataFrame({"kind": kind, "id": ids, "rep": rep, "bias": 0.0,
                         "factors": list(vectors.copy()), "hblk": 0, "n_updates": 0})


def _ratings(users, items, rating, ords):
    return pd.DataFrame({"user_id": users, "urep": 0, "item_id": items, "irep": 0,
                         "rating": rating, "ord": ords})


@pytest.mark.parametrize("biased,train_dims,schedule", [
    (True, None, "epoch"), (False, None, "epoch"), (True, 3, "epoch"), (True, None, "step")])
def test_block_step_is_serial_sgd(biased, train_dims, schedule):
    rng = np.random.default_rng(3)
    n_u, n_i, n_r, k = 40, 30, 600, 5
    U0 = rng.random((n_u, k)) * 0.1
    V0 = rng.random((n_i, k)) * 0.1
    f = pd.concat([
        _side("u", np.arange(n_u), U0), _side("i", np.arange(n_i), V0)], ignore_index=True)
    r = _ratings(rng.integers(0, n_u, n_r), rng.integers(0, n_i, n_r),
                 rng.integers(1, 6, n_r).astype(float), rng.integers(0, 2 ** 28, n_r))
    r["first_step"] = 70
    p = fac.SgdParams(k=k, biased=biased, train_dims=train_dims, lr_bias=0.2, lr=0.05,
                      decay=0.999, schedule=schedule)
    out = sgd._make_step(3.0, p, 2, 1000)(r, f)
    # the same permutation, applied one rating at a time
    order = np.lexsort((r.item_id.to_numpy(), r.user_id.to_numpy(),
                        sgd.epoch_order(r["ord"].to_numpy(), 2)))
    U, V, bu, bi = U0.copy(), V0.copy(), np.zeros(n_u), np.zeros(n_i)
    # by step, the count goes on: 2 epochs of 1000 and 70 earlier in this one
    rates = [0.05 * 0.999 ** (2 if schedule == "epoch" else 2070 + t) for t in range(n_r)]
    _serial(r, U, V, bu, bi, order, 3.0, p, rates)
    assert out.n_updates.sum() == 2 * n_r
    assert (out[out.kind == "u"].n_updates.to_numpy()
            == np.bincount(r.user_id, minlength=n_u)).all()
    got_u = np.vstack(out[out.kind == "u"].factors.to_numpy())
    got_i = np.vstack(out[out.kind == "i"].factors.to_numpy())
    assert np.allclose(got_u, U, atol=1e-12) and np.allclose(got_i, V, atol=1e-12)
    assert np.allclose(out[out.kind == "u"].bias.to_numpy(), bu, atol=1e-12)


def test_rounds_keep_per_id_order_and_are_conflict_free():
    rng = np.random.default_rng(5)
    u = rng.integers(0, 20, 500)
    i = rng.integers(0, 15, 500)
    rd = sgd.conflict_free_rounds(u, i)
    for x in range(20):
        assert (np.diff(rd[u == x]) > 0).all()
    for y in range(15):
        assert (np.diff(rd[i == y]) > 0).all()
    for k in np.unique(rd):
        sel = rd == k
        assert len(set(u[sel])) == sel.sum() and len(set(i[sel])) == sel.sum()


def test_rounds_are_the_levels_of_the_waiting_graph():
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 300):
        u, i = rng.integers(0, 9, n), rng.integers(0, 9, n)
        level, nu, ni = [], {}, {}
        for a, b in zip(u.tolist(), i.tolist(), strict=True):
            x = max(nu.get(a, 0), ni.get(b, 0))
            level.append(x)
            nu[a] = ni[b] = x + 1
        assert sgd.conflict_free_rounds(u, i).tolist() == level


def test_epochs_reshuffle():
    h = np.random.default_rng(0).integers(0, 2 ** 28, 2000)
    a, b = (np.argsort(sgd.epoch_order(h, e)) for e in (0, 5))
    place = np.argsort(b)[a]
    # neither the same order nor a rotation of it
    assert len(np.unique((place - np.arange(2000)) % 2000)) > 1000


def test_no_ratings_leave_factors_unchanged_and_missing_factors_raise():
    f = _side("u", [1], np.ones((1, 3)))
    step = sgd._make_step(3.0, fac.SgdParams(k=3), 0, 10)
    assert step(_ratings([], [], [], []), f).equals(f)
    with pytest.raises(RuntimeError, match="no item factors"):
        step(_ratings([1], [7], [4.0], [1]), pd.concat([f, _side("i", [8], np.ones((1, 3)))]))
    with pytest.raises(RuntimeError, match="no user factors"):
        step(_ratings([2], [8], [4.0], [1]), pd.concat([f, _side("i", [8], np.ones((1, 3)))]))


def test_blocks_follow_from_the_rows_alone():
    assert sgd.choose_blocks(10 ** 12, 10 ** 6) == 1000
    assert sgd.choose_blocks(1000) == 2 and sgd.choose_blocks(0) == 2
    assert sgd.choose_blocks(479_677) == 4


def test_a_step_over_feature_columns_is_the_step_over_arrays():
    rng = np.random.default_rng(5)
    r = _ratings(rng.integers(0, 20, 300), rng.integers(0, 15, 300),
                 rng.integers(1, 6, 300).astype(float), rng.integers(0, 2 ** 28, 300))
    f = pd.concat([_side("u", np.arange(20), rng.random((20, 4))),
                   _side("i", np.arange(15), rng.random((15, 4)))]).sample(frac=1, random_state=1)
    step = sgd._make_step(3.0, fac.SgdParams(k=4), 0, 300)
    want, names = step(r, f), [f"v{j}" for j in range(step.width)]
    flat = f.drop(columns="factors").assign(**dict(zip(names, np.vstack(f["factors"]).T, strict=True)))
    got = sgd.on_columns(step.update, names)(r, flat)
    assert (got[names].to_numpy() == np.vstack(want["factors"])).all()
    for c in ("kind", "id", "bias", "n_updates"):
        assert (got[c].to_numpy() == want[c].to_numpy()).all()
    assert sgd.on_columns(step.update, names)(r[:0], flat)[names].equals(flat[names])

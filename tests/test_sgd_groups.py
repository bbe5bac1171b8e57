"""Blocks that run together: the model of the strata one by one, in fewer stages."""

from pyspark.sql import functions as F
from test_sgd_pieces import hot_ratings

from latentforge.plans import factors as fac
from latentforge.plans import grid, sgd


def rows_of(m):
    return sorted((side, x["id"], x["bias"], tuple(x["factors"]), x["n_updates"])
                  for side, f in (("u", m.user_factors), ("i", m.item_factors))
                  for x in f.collect())


def test_groups_give_the_model_of_the_strata(spark):
    p = fac.SgdParams(k=3, epochs=2, lr=0.05, lr_bias=0.05, decay=0.999, schedule="step")
    train = hot_ratings(spark)
    one = sgd.prepare(train, rows_per_block=16, groups=99)
    want = rows_of(sgd.fit_sgd(p=p, prepared=one))
    assert one.span == 1 and one.pieces and one.blocks == 7
    # 7 blocks a side in groups of 3, 3 and 1; whole, and in runs
    for rows, runs in ((10 ** 6, False), (50, True)):
        many = sgd.prepare(train, rows_per_block=16, groups=3, group_rows=rows)
        assert (many.span, many.groups, many.stages) == (3, 3, 4) and bool(many.pieces) == runs
        assert rows_of(sgd.fit_sgd(p=p, prepared=many)) == want
        size = many.ratings.groupBy("stage", "grp", "run").count().agg(F.max("count")).first()[0]
        assert size < rows + 2 * 16
    got = grid.fit_sgd_grid(settings=[p], prepared=many)[0]
    assert [x[:2] for x in rows_of(got)] == [x[:2] for x in want]
    assert all(abs(a - b) < 1e-9 for x, y in zip(rows_of(got), want, strict=True)
               for a, b in zip(x[3], y[3], strict=True))


def test_stages_of_an_epoch_do_not_grow_with_small_blocks(spark):
    ready = sgd.prepare(hot_ratings(spark), rows_per_block=1)
    calls, plain = [], sgd.stratum_step
    sgd.stratum_step = lambda *a, **k: calls.append(a[3]) or plain(*a, **k)
    try:
        m = sgd.fit_sgd(p=fac.SgdParams(k=2, epochs=1), prepared=ready)
    finally:
        sgd.stratum_step = plain
    assert ready.blocks == 25 and m.blocks == 25
    assert calls == list(range(8))      # 25 before, and one more for each further piece
    assert m.user_factors.agg(F.sum("n_updates")).first()[0] == 600


def test_split_ids_in_groups(spark):
    train = hot_ratings(spark)
    p = fac.SgdParams(k=2, epochs=2, lr=0.05, lr_bias=0.05)
    a, b = (rows_of(sgd.fit_sgd(p=p, prepared=sgd.prepare(
        train, rows_per_block=16, split_threshold=50, groups=g))) for g in (99, 2))
    assert [x[:2] + x[4:] for x in a] == [x[:2] + x[4:] for x in b]
    assert all(abs(u - v) < 1e-9 for x, y in zip(a, b, strict=True)
               for u, v in zip(x[3], y[3], strict=True))

"""ALS over in-blocks and routing tables: same as the plain loop."""

import re

import numpy as np
from pyspark.sql import functions as F

from latentforge.plans import als
from latentforge.plans.factors import init_factors

ROWS = 60


def ratings(spark):
    """An item with a third of all ratings."""
    rng = np.random.default_rng(2)
    pairs = {(u, 7) for u in range(150)}
    while len(pairs) < 450:
        pairs.add((int(rng.integers(0, 150)), int(rng.integers(0, 40))))
    return spark.createDataFrame([(u, i, float(rng.integers(1, 6))) for u, i in sorted(pairs)],
                                 "user_id long, item_id long, rating double")


def vectors(df):
    return {r["id"]: np.array(r["factors"]) for r in df.collect()}


def test_equals_the_plain_loop_with_a_hot_item_cut(spark):
    r = ratings(spark)
    a = als.als_loop(r, k=3, iters=2, lam=0.1)
    b = als.als_blocked_loop(r, k=3, iters=2, lam=0.1, rows_per_block=ROWS)
    for x, y in zip(a[:2], b[:2]):
        x, y = vectors(x), vectors(y)
        assert x.keys() == y.keys()
        assert max(np.abs(x[i] - y[i]).max() for i in x) < 1e-9


def test_groups_are_bounded_and_vectors_go_once_to_each(spark):
    r = ratings(spark)
    blocks = als.in_blocks(r, "item_id", ROWS)
    assert blocks.cut
    sizes = blocks.ratings.groupBy("grp").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * ROWS
    assert sizes.agg(F.sum("count")).first()[0] == 450
    users = init_factors(r.select("user_id").distinct(), "user_id", "u", 3)
    sent = als.routed_vectors(blocks, users)
    needed = blocks.ratings.select("grp", "other").distinct().count()
    assert sent.count() == needed < 450
    blocks.drop()


def test_ratings_are_not_shuffled_again(spark):
    """A half step moves factors and routed vectors only."""
    blocks = als.in_blocks(ratings(spark), "user_id", 10 ** 6)
    assert not blocks.cut
    items = init_factors(blocks.ratings.select(F.col("other").alias("id")).distinct(), "id", "i", 3)
    path = blocks.paths[0] + "-items"
    items.write.parquet(path)
    step = als.als_blocked_half_step(blocks, spark.read.parquet(path), 3, 0.1)
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 2
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "rating#" in x)
    assert "Bucketed: true" in scan
    blocks.drop()


def test_no_rounds_and_no_ratings(spark):
    none = ratings(spark).where("user_id < 0")
    users, items, trace = als.als_blocked_loop(none, k=2, iters=1)
    assert users.count() == items.count() == 0 and trace == []


def test_loop_computes_the_ratings_once(spark):
    """The ratings' own plan (joins, hashes) runs once, not once per layout."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(u, i, float((u * i) % 5 + 1)) for u in range(12) for i in range(9)]
    schema = "user_id long, item_id long, rating double"

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    train = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    users, items, _ = als.als_blocked_loop(train, k=2, iters=1, lam=0.1)
    assert users.count() == 12 and items.count() == 9
    assert seen.value == len(rows)


def test_sweep_blocks_follow_the_ratings(spark, monkeypatch):
    from pyspark.ml.tuning import TrainValidationSplit

    from latentforge.plans import tuning
    assert tuning.als_blocks(1000, 4) == 4
    assert tuning.als_blocks(100 * tuning.ALS_ROWS_PER_BLOCK, 4) == 100
    given, real = [], TrainValidationSplit.fit
    monkeypatch.setattr(TrainValidationSplit, "fit", lambda self, data: given.append(
        self.getEstimator()) or real(self, data))
    monkeypatch.setattr(tuning, "ALS_ROWS_PER_BLOCK", 20)
    train = spark.createDataFrame([(u, i, float((u + i) % 5 + 1)) for u in range(12) for i in range(9)],
                                  "user_id long, item_id long, rating double")
    out = tuning.als_sweep(train, ranks=(2,), regs=(0.1, 0.2), max_iter=1, blocks=2).collect()
    assert given[0].getNumUserBlocks() == given[0].getNumItemBlocks() == 6
    assert len(out) == 2 and sum(r.is_best for r in out) == 1

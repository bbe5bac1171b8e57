"""Edge cases: cold start, empty blocks, salted vs broadcast joins, SGD plan."""

import numpy as np
from pyspark.sql import functions as F

from latentforge.operators import joins
from latentforge.plans import evaluate as ev
from latentforge.plans import factors as fac
from latentforge.plans import sgd
from latentforge.session import new_scratch_path, write_table


def _tiny(spark):
    return spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (2, 1, 4.0)],
                                 "user_id long, item_id long, rating double")


def test_cold_start_falls_back_to_mean(spark):
    r = _tiny(spark)
    uf, itf = fac.init_model(r, fac.SgdParams(k=3))
    test = spark.createDataFrame([(3, 1, 2.0), (1, 9, 1.0), (1, 1, 5.0)],
                                 "user_id long, item_id long, rating double")
    got = {(x.user_id, x.item_id): x for x in ev.score(test, uf, itf, 4.0, 3).collect()}
    assert not got[(3, 1)].has_factors and not got[(1, 9)].has_factors
    assert got[(3, 1)].prediction == 4.0 and got[(1, 9)].prediction == 4.0
    assert got[(1, 1)].has_factors and got[(1, 1)].prediction != 4.0


def test_more_blocks_than_data(spark):
    r = _tiny(spark)
    m = sgd.fit_sgd(r, fac.SgdParams(k=3, epochs=2, decay=1.0), blocks=8)
    assert m.user_factors.count() == 2 and m.item_factors.count() == 2
    vals = np.concatenate([x.factors for x in m.user_factors.collect()])
    assert np.isfinite(vals).all()


def test_salted_join_equals_broadcast_join(spark):
    ratings = spark.range(0, 3000).select((F.col("id") % 3).alias("user_id"),
                                          (F.col("id") % 50).alias("item_id"),
                                          F.lit(1.0).alias("rating"))
    users = spark.range(0, 3).select(F.col("id").alias("user_id"), (F.col("id") * 10).alias("x"))
    a = joins.join_per_id(ratings, users, "user_id", n_small=3, row_bytes=64)
    b = joins.join_per_id(ratings, users, "user_id", n_small=10**9, row_bytes=64, salt=8)
    assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()
    assert sorted(a.collect()) == sorted(b.collect())
    assert b.count() == 3000


def test_planning_many_blocks_is_quick(spark):
    """A job's plan has a bounded number of strata, whatever B is."""
    import time
    r = _tiny(spark)
    p = fac.SgdParams(k=3)
    prep = sgd.prepare(r, blocks=512)
    f = sgd._expand(fac.init_model(r, p)[0].withColumn("n_updates", F.lit(0)), None, "u", prep)
    t0 = time.time()
    step = sgd._make_step(3.0, p, 0, 3)
    for g in range(sgd.STRATA_PER_JOB):
        f = sgd.stratum_step(f, prep.ratings, prep, g, step)
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") >= sgd.STRATA_PER_JOB
    assert time.time() - t0 < 30


def test_stratum_reads_its_own_files_and_conf_is_left_alone(spark):
    r = _tiny(spark).unionByName(
        spark.range(3, 400).select(F.col("id").alias("user_id"), (F.col("id") % 17).alias("item_id"),
                                   F.lit(3.0).alias("rating")))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                             "spark.sql.adaptive.enabled")}
    prep = sgd.prepare(r, blocks=4)
    one = prep.ratings.where("stratum = 1")
    assert "PartitionFilters: [isnotnull(stratum" in one._jdf.queryExecution().executedPlan().toString()
    assert sum(prep.ratings.where(F.col("stratum") == g).count() for g in range(4)) == r.count()
    m = sgd.fit_sgd(p=fac.SgdParams(k=2, epochs=1), prepared=prep)
    assert m.blocks == 4
    assert {k: spark.conf.get(k) for k in before} == before


def test_skewed_join_is_split(spark):
    """A stored factor table lets adaptive execution split a hot user."""
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        r = write_table(spark.range(0, 120_000).select(
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("user_id"),
            F.col("id").alias("item_id"), F.lit(1.0).alias("rating")),
            new_scratch_path(spark, "skew"))
        uf, itf = (write_table(f, new_scratch_path(spark, "skew-f"))
                   for f in fac.init_model(r, fac.SgdParams(k=2)))
        j = joins.join_factors(r, uf, itf, 2)
        assert j.count() == 120_000
        out = j.agg(F.sum("rating"))
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

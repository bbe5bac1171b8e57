"""Per-user lists in chunks: positions, bounds and the plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentforge.operators import chunks, prep
from latentforge.session import new_scratch_path, write_table


def skewed(spark, scale=1, offset=0):
    """A user with a third of the ratings, a second big one with other items, many small."""
    rng = np.random.default_rng(8)
    pairs = {(7, int(i)) for i in rng.choice(5000, 2000, replace=False)}
    pairs |= {(8, int(i)) for i in rng.choice(600, 500, replace=False)}
    while len(pairs) < 6000:
        pairs.add((int(rng.integers(20, 220)), int(rng.integers(0, 5000))))
    rows = [(u, i * scale + offset, float((u + i) % 5)) for u, i in sorted(pairs)]
    return rows, write_table(spark.createDataFrame(rows, "user_id long, item_id long, rating double")
                             .repartition(6), new_scratch_path(spark, "test-pairs"))


def wanted(rows, size):
    lists = {}
    for u, i, r in sorted(rows):
        lists.setdefault(u, []).append((i, r))
    return {(u, c // size): x[c:c + size] for u, x in lists.items() for c in range(0, len(x), size)}


@pytest.mark.parametrize("size", [1, 7, 50, 4096])
@pytest.mark.parametrize("per_range", [40, 300, 10 ** 6])
def test_chunks_are_those_of_the_sorted_list(spark, size, per_range):
    rows, df = skewed(spark)
    want = wanted(rows, size)
    got = {(x["user_id"], x["chunk"]): list(zip(x["indices"], x["values"], strict=True))
           for x in prep.user_rows(df, size, per_range).collect()}
    assert got == want
    if size == 50:
        items = prep.user_items(df, size, per_range).collect()
        assert {(x["user_id"], x["chunk"]): x["items"] for x in items} == {
            k: [i for i, _ in v] for k, v in want.items()}
        assert len(items) == len(want)


def test_negative_and_far_apart_ids(spark):
    rows, df = skewed(spark, scale=10 ** 14, offset=-10 ** 17)
    got = {(x["user_id"], x["chunk"]): x["items"] for x in prep.user_items(df, 33, 100).collect()}
    assert got == {k: [i for i, _ in v] for k, v in wanted(rows, 33).items()}


def test_ranges_are_bounded_whoever_the_user_is(spark):
    rows, df = skewed(spark)
    hot = df.where("user_id in (7, 8)")
    cuts = chunks.item_cuts(hot.select("item_id").distinct(), 100)
    for user in (7, 8):
        at = np.searchsorted(cuts, [i for u, i, _ in rows if u == user], "right")
        assert np.bincount(at).max() <= 120     # of 2000 and 500


def test_no_rows(spark):
    _, df = skewed(spark)
    none = prep.user_rows(df.where("user_id < 0"), 5)
    assert none.count() == 0 and none.columns == ["user_id", "chunk", "indices", "values"]


def test_the_ratings_are_shuffled_once(spark):
    _, df = skewed(spark)
    plain = prep.user_items(df, 50)._jdf.queryExecution().executedPlan().toString()
    assert plain.count("Exchange hashpartitioning(user_id") == 1
    assert "rangepartitioning" not in plain and "ExistingRDD" not in plain
    cut = prep.user_items(df, 50, 300)
    cut.collect()
    final = cut._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "rangepartitioning" not in final and "ExistingRDD" not in final
    assert "ReusedExchange" in final        # the border chunks read the same shuffle
    assert df.agg(F.count("*")).first()[0] == 6000

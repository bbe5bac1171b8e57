"""The factor join on a grid of blocks: rows, choice and plan."""

import pytest

from latentforge import catalog
from latentforge.operators import joins, prep
from tests.conftest import SF_SMALL

RATINGS = "user_id long, item_id long, rating double, tag string"
FACTORS = "id long, bias double, factors array<double>"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(repr, df.collect()))


def _odd(spark):
    """Null and unknown ids, repeated ratings, ids of both sides, null vectors."""
    rows = [(None, 1, 1.0, "a"), (1, None, 2.0, "b"), (None, None, 2.0, "n"), (1, 1, 3.0, "c"),
            (1, 1, 3.0, "c"), (2, 7, 1.0, "d"), (9, 1, 1.0, "e"), (2, 2, None, None),
            (-5, 2 ** 45, 4.0, "f")]
    rows += [(u % 17, u % 23, float(u), "z") for u in range(400)]
    rows += [(3, i, 1.0, "hot") for i in range(2000)]

    def side(ids):
        return spark.createDataFrame(
            [(i, 0.5 * (i or 0), [float(i or 3), 2.0] if i != 2 else None) for i in ids], FACTORS)
    return (spark.createDataFrame(rows, RATINGS), side([1, 2, 3, 4, 7, 11, -5, None]),
            side([1, 2, 3, 7, 8, 9, 10, 2 ** 45, None]))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("blocks", [1, 3])
def test_grid_join_equals_the_plain_joins(spark, how, blocks):
    r, uf, itf = _odd(spark)
    plain = joins.join_factors(r, uf, itf, 2, how=how)
    grid = joins.grid_join(r, uf, itf, blocks, how)
    assert grid.dtypes == plain.dtypes
    assert _rows(grid) == _rows(plain)


def test_grid_is_for_two_big_tables_of_fewer_rows():
    assert joins.grid_blocks((36_000_000, 900_000, 1_200_000), 8) == 6
    assert joins.grid_blocks((36_000_000, 900, 1_200_000), 8) is None      # broadcast
    assert joins.grid_blocks((3_600_000, 90_000, 120_000), 8) is None
    assert joins.grid_blocks((2_000_000, 900_000, 1_200_000), 8) is None   # copies of rows
    # never more copies of factor rows than ratings, whatever the size
    for n in (10 ** 7, 10 ** 8, 10 ** 9, 10 ** 11):
        blocks = joins.grid_blocks((n, n // 40, n // 30), 8)
        assert blocks is None or blocks * (n // 40 + n // 30) < n


def test_ratings_are_shuffled_once_and_without_vectors(spark):
    r, uf, itf = _odd(spark)
    plan = _plan(joins.join_factors(r, uf, itf, 2, sizes=(36_000_000, 900_000, 1_200_000)))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "Window" in plan


@pytest.mark.parametrize("name", ["rmse", "sgd_deltas", "sgd_deltas_nb", "join_factors",
                                  "gradient_step"])
def test_queries_give_the_same_rows_on_the_grid(spark, monkeypatch, name):
    plain = _rows(catalog.QUERIES[name](spark, SF_SMALL))
    monkeypatch.setattr(joins, "grid_blocks", lambda sizes, k: 2)
    grid = catalog.QUERIES[name](spark, SF_SMALL)
    assert "_lf_cell" in _plan(grid)
    assert _rows(grid) == plain


def test_last_rating_wins_and_is_moved_once(spark):
    rows = [(1, 1, 2.0, 5, 7, 1), (1, 1, 4.0, 5, 7, 1), (1, 1, 5.0, 4, 9, 1), (1, 1, None, 5, 7, 1),
            (2, 1, None, 1, 1, 1), (None, 1, 3.0, 1, 1, 1), (None, 1, 1.0, 2, 1, 1)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long, "
                                     "l_orderkey long, l_linenumber int")
    out = prep.dedupe_ratings(df)
    assert {tuple(x) for x in out.collect()} == {(1, 1, 4.0), (2, 1, None), (None, 1, 1.0)}
    assert "_v" not in _plan(out)
    by_time = prep.dedupe_ratings(df.where("user_id = 1"), ["ts"])
    assert [x.rating for x in by_time.collect()] == [4.0]

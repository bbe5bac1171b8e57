"""Plan shape: no Python in the expression hot path, no cartesian product,
pruned parquet scans, no re-shuffle of the SGD rating side."""

from latentforge import catalog
from latentforge.plans import factors as fac
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predict_and_rmse_stay_in_jvm(spark):
    for name in ("predict", "rmse", "sgd_deltas", "gradient_step", "join_factors"):
        p = _plan(catalog.QUERIES[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_scan_is_pruned(spark):
    from latentforge.sources import tables
    p = _plan(tables.ratings_view(spark, SF_SMALL))
    assert "l_extendedprice" not in p and "o_totalprice" not in p


def test_no_cartesian_anywhere_in_checked_queries(spark):
    for name in catalog.SQL:
        if name in ("read_ratings", "read_items", "read_book_ratings", "reject_counts",
                    "sweep", "best_config", "rmse_trace", "sgd_trace") or name.startswith(
                        ("fit_", "als_sweep", "als_loop")):
            continue  # these write a fixture file or fit a model first
        p = _plan(catalog.QUERIES[name](spark, SF_SMALL))
        assert "CartesianProduct" not in p, name


def test_ratings_are_joined_once_per_query(spark):
    """The gradient and the error read the stored ratings once."""
    for name in ("gradient_step", "rmse"):
        p = _plan(catalog.QUERIES[name](spark, SF_SMALL))
        assert "lineitem" not in p, name   # the split is stored
        # ratings once, the mean's subquery, one scan per factor table
        assert p.count("FileScan") <= 6, (name, p.count("FileScan"))


def test_user_filter_is_pushed_into_the_scan(spark):
    from latentforge.operators import prep
    from latentforge.sources import tables
    p = _plan(prep.user_ratings(tables.ratings_view(spark, SF_SMALL), 7))
    assert "EqualTo(o_custkey,7)" in p

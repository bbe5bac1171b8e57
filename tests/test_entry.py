"""Driver contract."""

import __spark_entry__ as E


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert {r.split for r in rows} == {"train", "test"}
    assert all(r.n > 0 and r.rmse > 0 for r in rows)


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 40


def test_imports_without_the_llm_subpackage():
    """Taken out as a whole, it leaves the other queries as they are."""
    import subprocess
    import sys
    code = ("import sys; sys.modules['corpus_pipeline'] = sys.modules['latentforge.llm'] = None; import __spark_entry__ as e; "
            "q = e.queries(); assert 'rmse' in q and 'pipeline' not in q; "
            "assert set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=E.__file__.rpartition("/")[0])


def test_all_queries_of_the_catalog_have_a_twin():
    from latentforge import catalog
    assert set(catalog.QUERIES) == set(catalog.SQL)

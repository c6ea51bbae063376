"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import numbers

import duckdb
import pandas as pd
import pytest

from skein import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, FOLDER).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).toPandas() is not None


def test_entry_module_without_the_subpackage():
    """The entry module gives the library's queries with the subpackage missing."""
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(repo)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name == 'skein.llm' or name.startswith('skein.llm.'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'j5_topk_cosine' in e.queries() and not any(k.startswith('op1') for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    assert subprocess.run([sys.executable, "-c", code], cwd="/").returncode == 0

"""Queries over pairs of vectors, block by block, against their SQL and brute force."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from skein import catalog
from skein.operators import blocks

PAIRS = ("j5_topk_cosine", "p3_minimum_similarity", "m1_cosine", "m6_base_score", "m9_ramp", "w2_domain_rank", "t2_pool", "a19_ir_metrics", "a20_metrics_grouping_sets", "w9_reciprocal_rank", "m12_gain")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Equal vectors, more labels than rows of some of them, and queries that are alone with their label, whose first
    relevant row is the last of all, or that have none."""
    where, rng = str(tmp_path_factory.mktemp("pairs")), np.random.default_rng(5)
    base = rng.normal(size=(400, 64)).round(3)
    base[200:260] = base[7]
    labels = rng.integers(0, 6, 400)
    labels[0] = labels[399] = 77
    base[399] = -base[0]
    labels[50] = 88
    labels[100], labels[101] = 99, None or 100
    rows = [(k, [float(x) for x in base[k]], int(labels[k])) for k in range(400)] + [(None, [float(x) for x in base[3]], 2), (401, [float(x) for x in base[4]], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{where}/embeddings.parquet")
    return where


@pytest.mark.parametrize("name", PAIRS)
def test_pairs_by_block_equal_their_sql(spark, folder, name, monkeypatch):
    monkeypatch.setattr(blocks, "QUERIES", 3)  # several groups
    monkeypatch.setattr(blocks, "TASK", 500)
    made = catalog.queries()[name](spark, folder)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    plain = lambda frame: sorted(repr(tuple(None if v != v or v is None else float(v) if not isinstance(v, str) else v for v in r)) for r in frame[list(want.columns)].astype(object).where(frame[list(want.columns)].notna(), None).itertuples(index=False))
    assert plain(made.toPandas()) == plain(want)


def test_pool_meets_texts_late(spark, tmp_path):
    """Only rows of the pool get a text: scored pairs are not joined with documents."""
    from skein.plans import selecting

    source = "/root/testdata/sf0.001"
    for by_label, groups in ((True, ["query_id", "label"]), (False, ["query_id"])):
        pool = selecting.pool_rows(spark, source, by_label)
        assert pool.groupBy(*groups).count().agg({"count": "max"}).first()[0] <= 30


def test_products_next_to_ties_are_summed_as_sql_does():
    """Both ways of rounding agree for vectors whose similarities lie at ties of nine digits."""
    rng = np.random.default_rng(3)
    import pyarrow as pa

    v = rng.normal(size=(3000, 8)).round(2)
    sides = [blocks.Vectors({"id": pa.array(range(len(x))), "label": pa.array([0] * len(x)), "tag": pa.nulls(len(x), pa.string())}, x) for x in (v[:60], v)]
    tile = blocks.Tile(*sides)
    i, j = np.divmod(np.arange(60 * 3000), 3000)
    exact = blocks.rounded(blocks._dots(v[i], v[j]) / (sides[0].norm[i] * sides[1].norm[j]), 9)
    assert (tile.similarity.ravel() == exact).all()
    assert blocks.rounded(np.array([0.5, 1.5, -0.5, 2.5, 0.49999999999999994]), 0).tolist() == [1, 2, -1, 3, 0]

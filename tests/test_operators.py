"""Operators on literal inputs."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from skein.functions import coverage, text, vectors
from skein.operators.components import components
from skein.operators.similarity import similar_pairs
from skein.plans.selecting import hard_negatives
from skein.sources import scratch


def test_components_of_a_small_graph(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 3), (None, 4), (8, 7)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 7: 7, 8: 7}


def test_components_of_a_path_and_nothing(spark):
    nodes = list(range(60))
    random.Random(1).shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a long, b long")
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_similar_pairs_are_all_pairs(spark):
    rng = random.Random(2)
    sets = {i: {rng.randrange(12) for _ in range(rng.randrange(1, 9))} for i in range(80)}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, tokens array<string>")
    for t in (0.5, 0.72, 0.94):
        firsts = {i for i in sets if not any(j < i and sets[j] == sets[i] for j in sets)}  # copies are one class
        want = {(a, b) for a in firsts for b in firsts if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}
        assert {(r.a, r.b) for r in similar_pairs(df, t).collect()} == want


def test_golden_scores(spark):
    one = spark.range(1)
    parts = coverage.components(F.lit(1.0), F.lit(9), F.lit(3), F.lit(1.0), F.lit(1.0), F.lit(False), F.lit(False), 3)
    assert sum(one.select(*parts.values()).first()) == pytest.approx(100.0)
    assert one.select(vectors.base_score(F.lit(0.677493453), F.lit(0.690002348), F.lit(1.0), F.lit(0.85))).first()[0] == pytest.approx(0.737621986, abs=1e-8)
    rows = spark.createDataFrame([(88.21, 0.806848), (87.25, 0.774936), (74.54, 0.484578)], "s double, w double")
    assert rows.agg(coverage.overall_score(F.col("s"), F.col("w"))).first()[0] == pytest.approx(84.64, abs=0.011)


def test_normalisers(spark):
    row = spark.createDataFrame([("Māyā’s  Re-al_ity ﬁ ß", None)], "t string, n string")
    r = row.select(text.strip_marks("t"), text.compose_terms("t"), text.search_text("t"), text.search_text("n")).first()
    assert tuple(r) == ("mayas re-al_ity fi ss", "māyā s re al_ity fi ss", "mayas re al_ity fi ss", None)


def brute_negatives(rows):
    left = sorted(rows, key=lambda r: (r[4], r[0]))
    chosen = [next(r for r in left if r[3] == c) for c in sorted({r[3] for r in left})]
    while len(chosen) < min(6, len(left)):
        chosen.append(min((r for r in left if r not in chosen), key=lambda r: (sum(c[1] == r[1] for c in chosen), r[4], r[0])))
    return {(r[2], r[0]) for r in chosen}


def test_hard_negatives_against_brute_force(spark):
    """A hot source of equal copies, few sources, many sources."""
    rng = random.Random(3)
    rows = [(i, "hot", "en", "0/0", 5) for i in range(40)] + [(40 + i, f"s{i}", "en", "0/0", 10 + i) for i in range(8)] + [(60, "hot", "en", "1/1", 90)]
    for k in range(12):
        rows += [(100 * (k + 1) + i, f"s{rng.randrange(1 + k)}", f"l{k}", rng.choice(("0/0", "0/1", "1/1")), rng.randrange(9)) for i in range(rng.choice((3, 30, 90)))]
    got = hard_negatives(spark.createDataFrame(rows, "doc_id long, source string, lang string, category string, off long")).collect()
    want = set().union(*(brute_negatives([r for r in rows if r[2] == lang]) for lang in {r[2] for r in rows}))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_shuffles_end_with_the_table_they_are_for(spark):
    """Shuffle files of a table that is cut go when it is written, though the frame it was cut from is still held."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {file for k in range(found.length()) if (file := found.apply(k).getName()).startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(name, None)
    frame = spark.range(1000).repartition(5, "id")
    out = scratch.cut(frame)
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and out.count() == 1000
    assert spark.conf.get(name, None) == setting


def test_similar_pairs_of_one_source_and_what_is_written(spark, tmp_path):
    """Pairs against brute force, with sources that are null and sets that come twice; no table of whole sets stays."""
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(240):
        words = list(bases[i % 12])
        for _ in range(rng.randrange(14)):
            words[rng.randrange(60)] = f"x{rng.randrange(200)}"
        rows.append((i, rng.choice(("s", "t", None)), sorted(set(words))))
    rows += [(300 + i, s, t) for i, (_, s, t) in enumerate(rows[:20])]
    df = spark.createDataFrame(rows, "id long, source string, tokens array<string>")
    written = []
    for t in (0.72, 0.94):
        heads = {}
        for i, s, w in rows:
            heads.setdefault((s, tuple(w)), i)
        want = {(a, b) for (s, x), a in heads.items() for (u, y), b in heads.items() if s is not None and s == u and a < b and len(set(x) & set(y)) >= t * len(set(x) | set(y))}
        found = similar_pairs(df, t, ["source"], 12)
        written.append(found)
        assert {(r.a, r.b) for r in found.collect()} == want and (want or t > 0.9)
    assert all(f.schema.names == ["a", "b", "similarity"] and getattr(f, "scratch_path", None) for f in written)

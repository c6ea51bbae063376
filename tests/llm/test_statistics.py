"""Source divergence against its SQL and plain Python; whitening against a dense eigensolver."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from skein.llm import divergence, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def by_hand(rows):
    """lang, source, part, item, value, rank of (text, lang, source), one pair of sources and one term at a time."""
    counts, docs, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        groups = {s: counts[k, s] for k, s in counts if k == lang}
        whole = sum(groups.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = shares(groups[source]), shares(whole)
        pairs = [(s, sum((p[t] - r[t]) ** 2 // r[t] for t in kept)) for s in groups if s != source for r in [shares(groups[s])]]
        terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if groups[source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, k + 1) for k, (i, v) in enumerate(found) if part == "pair" or k < 200]
    return sorted(out)


def divergences(spark, rows):
    frame = spark.createDataFrame([(i, *r, 0, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string, docs long")
    return sorted(map(tuple, divergence.audit(frame).collect()))


def test_divergence_against_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(divergence.OP11_SQL)
    got = divergence.op11_source_divergence(spark, folder).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_divergence_by_hand(spark):
    """Nulls, empty texts, groups without terms, ties, repeated rows, case beyond ASCII, a text of many words, clashing
    columns; a small buffer makes tasks send their counts in parts."""
    rows = [(None, None, None), ("", "en", "x"), ("One TWO two ÄB ab", "en", "a"), ("one two äb", "en", "b"), ("one two ÄB", "en", "b"), ("one two ÄB", "en", "b"), ("1 2 3", "en", "c")]
    rows += [("q w e", "de", "one")] * 2 + [("solo", "fr", "s"), ("le le chat_noir l'été", "fr", "s"), ("le chat", None, "s")]
    rows += [("wort " * 5000 + "one", "en", "a")] + [(f"t{'abc'[k % 3] * (k % 4 + 1)} two", "en", "abc"[k % 3]) for k in range(60)]
    assert divergences(spark, rows) == by_hand(rows)


def test_divergence_in_parts_and_of_nothing(spark):
    rows = [(f"w{chr(97 + k % 26)} common", "en", f"s{k % 5}") for k in range(300)]
    held, divergence.HELD = divergence.HELD, 3
    try:
        assert divergences(spark, rows) == by_hand(rows)
    finally:
        divergence.HELD = held
    assert divergences(spark, []) == []


def vectors(spark, rows):
    return spark.createDataFrame([(i, r, 0, 1.0) for i, r in rows], "vec_id long, embedding array<float>, n long, whitened double")


def dense(rows, components):
    x = np.floor(np.array(rows, np.float32).astype(float) * 1024) + 100000
    c = x - x.mean(0)
    values, q = np.linalg.eigh(c.T @ c / len(x))
    values, q = values[::-1], q[:, ::-1]
    return x.astype(np.int64), values, c @ q[:, :components] / np.sqrt(values[:components])


def check_whitened(got, ids, rows, components=8):
    x, values, want = dense(rows, components)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(table) == len(got) == len(ids) * components
    w = np.array([[table[i, k + 1].whitened for k in range(components)] for i in ids])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-8
    n, sums = len(x), x.sum(0)
    for i, row in zip(ids, x.tolist(), strict=True):
        r = table[i, 1]
        assert (r.n, r.deviation) == (n, sum((n * v - int(s)) ** 2 for v, s in zip(row, sums, strict=True)))
        assert 0 <= r.identity_error < 1e-9 and math.isclose(r.explained, values[0] / values.sum(), rel_tol=1e-9)


@pytest.mark.parametrize("dim", [3, 12, 64, 150])
def test_whitening_against_a_dense_solver(spark, dim):
    """Every size of block against the dimension: the basis is the whole space, or needs many turns."""
    rng = np.random.default_rng(dim)
    rows = (rng.standard_normal((400, dim)) * np.linspace(1, 3, dim)).astype(np.float32).tolist()
    check_whitened(whitening.whiten(vectors(spark, list(enumerate(rows)))).collect(), range(400), rows, min(8, dim))


def test_whitening_over_a_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitened(whitening.op13_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_drops_what_is_no_vector(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((50, 4)).astype(np.float32).tolist()
    bad = [None, [1.0, None, 2.0, 3.0], [1.0, float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [], [1.0, 2.0], [1e20, 0.0, 0.0, 0.0]]
    got = whitening.whiten(vectors(spark, list(enumerate(good)) + [(100 + i, b) for i, b in enumerate(bad)])).collect()
    check_whitened(got, range(50), good, 4)


def test_whitening_without_variance(spark):
    """One vector, equal vectors, a line of vectors, repeated null ids, an empty table."""
    one = whitening.whiten(vectors(spark, [(None, [1.0, 2.0])] * 3)).collect()
    assert sorted((r.component, r.n) for r in one) == [(1, 3)] * 3 + [(2, 3)] * 3
    assert all(r.whitened is None and r.explained is None and r.deviation == 0 for r in one)
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(10)])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    assert all(r.identity_error < 1e-9 and math.isclose(r.explained, float(r.component == 1)) for r in line)
    assert whitening.whiten(vectors(spark, [])).collect() == []


def test_deviations_beyond_64_bits():
    x = np.array([[0, 0], [10**7, 10**7]])
    n = 10**6
    sums = np.array([n * 5000, n * 5000])
    small = (n * 5000) ** 2 * 2
    assert whitening._deviations(x[:1], n, sums).to_pylist() == [small if small < 1 << 63 else None]
    assert whitening._deviations(x, n, sums).to_pylist()[1] is None

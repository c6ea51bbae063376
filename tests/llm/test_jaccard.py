"""The n-gram Jaccard join against all pairs."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np

from skein.llm import jaccard, linking

DOCS = "doc_id long, text string, n int, node long, keys string, part long, token long"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()


def by_hand(rows):
    """doc_id, n_shingles, component_id of (doc_id, text), every pair compared."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if min(len(x), len(y)) * 10 >= max(len(x), len(y)) * 9 and x and 100 * len(x & y) >= 90 * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(spark, rows):
    frame = spark.createDataFrame([(d, t, 0, 0, "x", 0, 0) for d, t in rows], DOCS).repartition(5)
    return sorted(map(tuple, jaccard.linked(frame).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def prose(rng, n, size=5000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus(rng):
    texts = [None, "", " \t\n", "one", "One", "one two", "one two three", "TWO ONE", "İ ß É", "i̇ ß é", "a b c a b c a b c", "a b c a b"]
    for n in (9, 10, 11, 12, 13, 25, 60, 200, 1500):
        base = prose(rng, n)
        texts += [" ".join(base[: n - cut]) for cut in (0, 1, 2)] + [" ".join(edited(rng, base, k)) for k in (0, 1, 1, n // 60, n // 60, n // 50, n // 40) for _ in range(3)]
        texts += [" ".join([*base, *prose(rng, n // 10 + extra)]) for extra in (-1, 0, 1) if n // 10 + extra >= 0]
    return texts


def test_components_against_all_pairs(spark):
    rng = random.Random(3)
    rows = list(enumerate(corpus(rng)))
    rng.shuffle(rows)
    assert got(spark, rows) == by_hand(rows)


def test_common_passages_and_groups_of_near_copies(spark):
    """A passage in a third of all texts, texts that are mixtures of a few passages, and groups of edited copies around
    the threshold, with and without the original."""
    rng = random.Random(4)
    passage, texts = prose(rng, 30), []
    texts += [" ".join(prose(rng, 20) + passage + prose(rng, 20)) for _ in range(120)]
    blocks = [prose(rng, 12) for _ in range(8)]
    texts += [" ".join(w for b in rng.sample(blocks, 6) for w in b) for _ in range(80)]
    for edits in (1, 2, 3, 4):
        base = prose(rng, 90)
        texts += [" ".join(edited(rng, base, edits)) for _ in range(40)]
    rows = list(enumerate(texts))
    assert got(spark, rows) == by_hand(rows)


def test_chain_of_links(spark):
    """Each text is like the next only."""
    rng = random.Random(5)
    words = prose(rng, 400, 10**9)
    rows = [(100 - k, " ".join(words[k * 5 : k * 5 + 120])) for k in range(50)]
    want = by_hand(rows)
    assert {c for _, _, c in want} == {51}
    assert got(spark, rows) == want


def test_ids_that_repeat_or_are_null(spark):
    text = " ".join(prose(random.Random(6), 30))
    rows = [(7, text), (7, text), (7, "other words here and more of them"), (None, text), (None, "alone " * 3), (3, text + " more"), (None, None), (9, None)]
    assert got(spark, rows) == by_hand(rows)


def test_of_nothing(spark):
    assert got(spark, []) == []


def test_components_over_a_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    out = jaccard.op12_ngram_jaccard_join(spark, folder).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, out), key=str) == by_hand(rows)


def test_keys_are_few_and_prefixes_suffice():
    """Any two sets at the threshold share the tokens that their prefixes must share."""
    rng = np.random.default_rng(7)
    for n in range(9, 400, 7):
        common = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        for extra in range(n // 9 + 2):
            x, y = np.unique(common), np.unique(np.r_[common, rng.integers(0, 1 << 62, extra, dtype=np.uint64)])
            if jaccard._linked(x, y):
                both = np.intersect1d(x[: jaccard.window(len(x))], y[: jaccard.window(len(y))])
                assert len(both) >= min(jaccard.needed(len(x)), jaccard.needed(len(y)))


def test_parities_never_say_more_than_the_difference():
    rng = np.random.default_rng(8)
    for n in (9, 50, 600, 5000):
        common = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        for extra in (0, 1, n // 10, n):
            other = np.unique(np.r_[common[extra // 2 :], rng.integers(0, 1 << 62, extra, dtype=np.uint64)])
            x, y = (np.array(jaccard.parities(s)).view(np.uint64) for s in (common, other))
            assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(common, other))


def test_linked_sets_share_a_part():
    """Sets that differ as much as linked ones can, of sizes on both sides of the levels' bounds."""
    rng = np.random.default_rng(9)
    for n in [*range(9, 120), *(b + k for b in jaccard.BOUNDS[:30] for k in (-1, 0, 1) if 9 <= b + k < 4000)]:
        for extra in sorted({0, n // 20, n // 19, n // 10, n // 9}):
            for gone in sorted({0, n // 20, n // 19}):
                common = rng.integers(0, 1 << 64, n, dtype=np.uint64)
                x, y = np.unique(common), np.unique(np.r_[common[gone:], rng.integers(0, 1 << 64, extra, dtype=np.uint64)])
                if len(x) >= jaccard.SMALL <= len(y) and jaccard._linked(x, y):
                    assert set(jaccard.parts(x)) & set(jaccard.parts(y))


def test_a_common_passage_brings_few_texts_together():
    """Texts half of which is one passage: hardly a part is the same, though each two share 0.33 of their tokens."""
    rng = np.random.default_rng(10)
    passage = rng.integers(0, 1 << 64, 100, dtype=np.uint64)
    sets = [set(jaccard.parts(np.unique(np.r_[passage, rng.integers(0, 1 << 64, 100, dtype=np.uint64)]))) for _ in range(100)]
    assert sum(bool(x & y) for i, x in enumerate(sets) for y in sets[:i]) < 0.05 * 4950


def test_a_pair_that_shares_many_parts_is_met_once(spark):
    """Of near copies just below the threshold and above it, the join of parts makes no more rows than there are pairs."""
    rng = random.Random(11)
    base = prose(rng, 160, 10**9)
    texts = [" ".join(edited(rng, base, 2)) for _ in range(30)]
    join = jaccard._Join(spark.createDataFrame([(d, t, 0, 0, "x", 0, 0) for d, t in enumerate(texts)], DOCS).repartition(5))
    met = join.met(None)
    assert met.count() == met.distinct().count() > 0


def test_links_of_near_copies_left_apart_grow_with_the_group(spark, monkeypatch):
    """Near copies that are all linked, none of them by the first step: links are found by comparing with leads."""
    links, components = [], linking.components
    monkeypatch.setattr(linking, "components", lambda found: (links.append(found.distinct().count()), components(found))[1])
    rng = random.Random(12)
    for n in (40, 80):
        base = prose(rng, 160, 10**9)
        rows = [(d, " ".join(edited(rng, base, 1)), 0, 0, "x", 0, 0) for d in range(n)]
        links.clear()
        labels = jaccard._Join(spark.createDataFrame(rows, DOCS).repartition(5)).rest(None)
        assert labels.select("component").distinct().count() == 1 and labels.count() == n
        assert sum(links) < 10 * n

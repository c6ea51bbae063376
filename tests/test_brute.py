"""Queries that SQL cannot express, against plain Python over the smallest tables."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein import catalog
from skein.functions import metrics
from skein.operators import chunking, fitting, selection, similarity
from skein.plans import selecting
from skein.sources import files, parsers

FOLDER = "/root/testdata/sf0.001"
RATIOS = selecting.RATIOS


def read(table):
    return pd.read_parquet(f"{FOLDER}/{table}.parquet")


def got(spark, name):
    return catalog.queries()[name](spark, FOLDER).toPandas()


def test_logistic_fit_equals_a_loop(spark):
    rows = read("embeddings")
    x, y = np.stack(rows["embedding"].to_numpy()).astype(float), (rows["label"] == 0).to_numpy().astype(float)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(fitting.LOGISTIC_STEPS):
        off = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y
        w, b = w - 0.15 * (off @ x / len(y) + 0.01 * w), b - 0.15 * off.mean()
    found = got(spark, "m16_logistic_fit").set_index("place")["weight"]
    assert found[-1] == pytest.approx(b) and np.allclose(found[[*range(len(w))]], w)


def structure_noise(t):
    if not t:
        return 1.0
    n, count = len(t), lambda p: len(re.findall(p, t))
    letters = sum(unicodedata.category(c)[0] == "L" for c in t)
    visible = count(r"\S")
    odd = min(0.003 * count(r"[^A-Za-z0-9\s.,;:'\"!?()\-ऀ-ॿ]{3,}"), 0.03)
    score = 8.0 * t.count("�") / n + odd + min(0.002 * count(r"[A-Za-z]-\s*\n\s*[A-Za-z]"), 0.02) + min(0.004 * sum(1 for _ in re.finditer(r"([^\w\s])\1{3,}", t)), 0.02)
    printable = sum(unicodedata.category(c)[0] not in "CZ" or c in " \n\t" for c in t) / n
    score += 0.98 - printable if printable < 0.98 else 0.0
    score += 0.1 * (0.45 - letters / visible) if visible and letters / visible < 0.45 else 0.0
    return min(1.0, max(0.0, score))


def test_structure_noise(spark):
    texts = read("documents").set_index("doc_id")["text"]
    found = got(spark, "f18_structure_noise").set_index("doc_id")["noise"]
    for i, t in texts.items():
        assert found[i] == pytest.approx(structure_noise(t), abs=2e-6), i


def test_semantic_similarity(spark):
    from difflib import SequenceMatcher

    texts = read("benchmark").set_index("item_id")["text"].to_dict()
    found = got(spark, "f27_semantic_similarity").set_index("item_id")["similarity"].to_dict()
    assert set(found) == {i for i in texts if i + 1 in texts}
    for i, v in found.items():
        a, b = texts[i], texts[i + 1]
        p, q = set(a.lower().split()), set(b.lower().split())
        assert v == pytest.approx(0.5 * len(p & q) / len(p | q) + 0.5 * SequenceMatcher(None, a, b).ratio(), abs=1e-6)


def capped(spark):
    rows = selecting.candidates(spark, FOLDER).toPandas().sort_values(["p1", "p2", "p3", "id"])
    used, picked = Counter(), []
    for r in rows.itertuples():
        keys = [(c, getattr(r, c)) for c in selecting.CAPS]
        if len(picked) < selecting.TARGET and all(used[k] < selecting.CAPS[k[0]] for k in keys):
            picked.append(r.id)
            used.update(keys)
    return rows, picked, used


def test_capped_selection_and_reasons(spark):
    rows, picked, used = capped(spark)
    found = got(spark, "g7_capped_selection").sort_values("rank")
    assert found["id"].tolist() == picked
    reasons = Counter()
    for r in rows[~rows["id"].isin(picked)].itertuples():
        full = {c: used[c, getattr(r, c)] >= n for c, n in selecting.CAPS.items()}
        reasons["cap of the section" if full["section"] else "cap of the source" if full["source"] else "cap of the domain" if full["lang"] else "target reached" if len(picked) >= selecting.TARGET else "lower priority"] += 1
    assert dict(zip(*got(spark, "g8_exclusion_reasons")[["reason", "n"]].to_numpy().T, strict=True)) == dict(reasons)


def test_reserved_families(spark):
    rows = read("documents").merge(read("labels"), on="doc_id")
    sizes = rows[rows["toxic"] == 1].groupby("source").size()
    found = got(spark, "g5_reserved_families").set_index("source")["split"].to_dict()
    targets, held, want = selection.largest_remainder(int(sizes.sum()), RATIOS), Counter(), {}
    for source, size in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0])):
        fills = [held[s] / max(1, targets[s]) for s in RATIOS]
        want[source] = list(RATIOS)[fills.index(min(fills))]
        held[want[source]] += size
    assert found == want


def test_balanced_families(spark):
    """Each source is in one split; no move of one source makes the overflow of the splits smaller."""
    docs = read("documents")
    found = got(spark, "g6_balanced_families").set_index("source")["split"].to_dict()
    sizes = docs.groupby("source").size().to_dict()
    assert set(found) == set(sizes)
    targets = selection.largest_remainder(len(docs), RATIOS)
    held = Counter()
    for source, split in found.items():
        held[split] += sizes[source]
    largest = max(sizes.values())
    assert all(held[s] <= targets[s] + largest for s in RATIOS) and all(held[s] > 0 for s in RATIOS)


def test_chunks_by_registry(spark):
    found = got(spark, "sc10_chunker_registry")
    for r in read("documents").itertuples():
        own = found[found["doc_id"] == r.doc_id].sort_values("number")["text"].tolist()
        assert own == chunking.chunk(r.text or "", chunking.SCIENTIFIC if r.lang == "en" else chunking.CLASSICAL)
    with pytest.raises(ValueError):
        chunking.resolve("science", "scripture")
    with pytest.raises(ValueError):
        chunking.register(str.split, ["science"], ["paper"])


def test_word_split_of_every_text(spark):
    found = got(spark, "g11_word_split")
    for r in read("documents").itertuples():
        assert found[found["doc_id"] == r.doc_id].sort_values("number")["piece"].tolist() == chunking.split_words(r.text or "", 300, 40)


def test_batches(spark):
    found = got(spark, "g14_greedy_batches")
    assert len(found) == len(read("documents"))
    groups = found.groupby(["block", "batch"])["tokens"]
    assert groups.size().max() <= 16 and ((groups.sum() <= 8000) | (groups.size() == 1)).all()


def test_links_keep_components_and_expand_no_copies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(30):
        base = set(rng.integers(0, 60, 20).tolist())
        for _ in range(4):
            tokens = base - set(rng.choice(sorted(base), 2).tolist()) if rng.random() < 0.7 else base
            rows.append((len(rows), f"s{rng.integers(0, 3)}", [str(t) for t in sorted(tokens)]))
    rows += [(len(rows) + k, f"s{k % 3}", rows[0][2]) for k in range(60)]
    frame = spark.createDataFrame(rows, "id long, source string, tokens array<string>")

    def components(edges):
        parent = {r[0]: r[0] for r in rows}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return {i: root(i) for i in parent}

    def jaccard(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b))

    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and jaccard(a[2], b[2]) >= (0.8 if a[1] == b[1] else 0.9) - 1e-9]
    links = [(r.a, r.b) for r in similarity.links(frame, 0.8, 0.9, 1).collect()]
    assert components(links) == components(want) and len(set(links)) < len(want) / 3
    assert all(pair in set(want) for pair in links)


def test_nearest_rank_of_skewed_values(spark):
    rng = np.random.default_rng(6)
    values = {"a": np.exp(rng.normal(0, 4, 700)), "b": np.full(50, 3.0), "c": rng.integers(0, 5, 333).astype(float)}
    frame = spark.createDataFrame([(k, float(v)) for k, own in values.items() for v in own] + [("d", None)], "g string, v double")
    for share in (0.05, 0.5, 0.95, 1.0):
        found = {r.g: r.v for r in metrics.nearest_rank(frame, ["g"], "v", share).collect()}
        assert found == {k: sorted(own)[math.ceil(share * len(own)) - 1] for k, own in values.items()}


def test_config_reader_and_atomic_writer(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "x", "size": 3}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{")
    assert files.read_config(spark, f"{tmp_path}/a.json", ["name"]) == {"name": "x", "size": 3}
    for name, required in (("a", ["name", "type"]), ("b", []), ("c", [])):
        with pytest.raises(ValueError):
            files.read_config(spark, f"{tmp_path}/{name}.json", required)
    for n in (3, 5):
        files.write_atomic(spark.range(n), f"{tmp_path}/out")
        assert spark.read.json(f"{tmp_path}/out").count() == n
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.json", "b.json", "c.json", "out"]
    found = spark.createDataFrame([('{"a": 1}',), ("[]",), (None,)], "c string").select(files.missing_fields(F.col("c"), ("a", "b")).alias("m")).collect()
    assert [r.m for r in found] == [["b"], None, None]


def test_articles_and_books():
    article = json.loads(json.dumps(
        "<article xmlns:x='u'><front><article-meta><title-group><article-title>T <i>i</i></article-title></title-group><abstract><title>Sum</title><p>A</p></abstract><abstract><p>B</p></abstract></article-meta></front>"
        "<body><p>lead</p><sec><label>1</label><p>one</p><fig><label>F</label><caption><p>cap</p></caption></fig><sec><title>SS</title><list><list-item><p>two</p></list-item></list><fn><p>note</p></fn></sec></sec><sec><title>E</title></sec></body><back><ref-list><p>no</p></ref-list></back></article>"
    ))
    blocks, warnings = parsers.jats(article)
    assert blocks == [
        ("title", "", "front/article-meta/title-group", "T i"), ("abstract", "Sum", "front/article-meta/abstract[1]/p[1]", "A"), ("abstract", "Abstract 2", "front/article-meta/abstract[2]/p[1]", "B"), ("p", "Body", "body/p[1]", "lead"),
        ("p", "1", "body/sec[1]/p[1]", "one"), ("fig", "1", "body/sec[1]/fig[1]/caption", "cap"), ("p", "SS", "body/sec[1]/sec[1]/list[1]/list-item[1]/p[1]", "two"), ("fn", "SS", "body/sec[1]/sec[1]/fn[1]", "note"),
    ]
    assert warnings == [("empty_section", "body/sec[2]")]
    assert {c for c, _ in parsers.jats("<article><front/></article>")[1]} == {"missing_article_title", "missing_article_metadata", "missing_body"}
    with pytest.raises(ValueError):
        parsers.jats("<book/>")
    book = "<body><div class='toc x'><p>contents</p></div><span class=pagenum>[1]</span><h2 id=c1>One</h2><p>a<br>b<p>c <span class='pagenum'>12</span>d<form><p>no</p></form><svg><text>no</text></svg><div><ul><li>e<li>f</ul></div></body>"
    assert parsers.html_blocks(book) == [("h2", "One", "body[1]/h2[1]", "One"), ("p", "One", "body[1]/p[1]", "a b"), ("p", "One", "body[1]/p[2]", "c d"), ("li", "One", "body[1]/p[2]/div[1]/ul[1]/li[1]", "e"), ("li", "One", "body[1]/p[2]/div[1]/ul[1]/li[2]", "f")]

"""The corpus pipeline, stage by stage, against brute force over the smallest table."""

from __future__ import annotations

import re
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from skein.llm import packing, pii, quality
from test_search import brute_classes, repeated_words, shingle_list, word_list

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage of one run returns, in order, as rows; first the documents."""
    folder = tmp_path_factory.mktemp("stages")
    kept = [spark.read.parquet(f"{SMALL}/documents.parquet").collect()]

    def recorded(k, function):
        def run(session, docs, sf_dir):
            out = function(session, docs, sf_dir)
            out.write.parquet(f"{folder}/{k}")
            kept.append(spark.read.parquet(f"{folder}/{k}").collect())
            return spark.read.parquet(f"{folder}/{k}")

        return run

    every = corpus_pipeline.STAGES
    corpus_pipeline.STAGES = [(name, recorded(k, f)) for k, (name, f) in enumerate(every)]
    try:
        result = corpus_pipeline.run(spark, SMALL).collect()
    finally:
        corpus_pipeline.STAGES = every
    assert len(kept) == len(every) + 1 and sorted(map(str, result)) == sorted(map(str, kept[-1]))
    return kept


def test_stages_hand_on_documents(stages):
    assert [len(s) for s in stages[:5]] == sorted((len(s) for s in stages[:5]), reverse=True)
    assert all(r.__fields__ == COLUMNS for s in stages[:5] for r in s[:1])
    assert all(r.n_chars == len(r.text or "") for s in stages[1:5] for r in s)


def test_quality_stage(stages):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = {i for i, kept in con.sql(f"SELECT doc_id, kept FROM ({quality.OP5_SQL})").fetchall() if kept}
    assert {r.doc_id for r in stages[1]} == want
    assert sorted(map(str, stages[1])) == sorted(str(r) for r in stages[0] if r.doc_id in want)


def test_near_duplicate_stage(stages):
    """One document of each class goes on: classes are no finer than by shingles and no coarser than by words."""
    before, after = sorted(stages[1]), {r.doc_id: r for r in stages[2]}
    texts = [r.text for r in before]
    fine, coarse = brute_classes(texts, shingle_list), brute_classes(texts, word_list)
    left = [k for k, r in enumerate(before) if r.doc_id in after]
    assert len({fine[k] for k in left}) == len(left)
    assert {coarse[k] for k in left} == set(coarse.values())
    assert all(str(after[before[k].doc_id]) == str(before[k]) for k in left)


def test_passage_stage(stages):
    before, after = {r.doc_id: r for r in stages[2]}, {r.doc_id: r for r in stages[3]}
    assert set(before) == set(after)
    order = sorted(after)
    assert not any(repeated_words([after[i].text for i in order]).values())
    grams = {i: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, before[i].text.split()) for i in order)}
    for i in order:
        if after[i].text != before[i].text:  # cuts only, and of what another document has nearly
            it = iter(before[i].text.split())
            assert all(w in it for w in after[i].text.split())
            assert any(len(grams[i] & grams[j]) >= 25 for j in order if j != i)


def test_personal_data_stage(stages):
    before, after = {r.doc_id: r for r in stages[3]}, {r.doc_id: r.text for r in stages[4]}
    assert set(before) == set(after)
    for i, r in before.items():
        spans = [x for own in pii.base_spans(r.text or "").values() for x in own]
        assert all((r.text[a:b]) not in after[i] for a, b in spans)
        if not spans:
            assert after[i] == r.text


def test_packing_stage(stages):
    import tokenizers

    coder = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4]}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in stages[5]:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for found, total in [(pieces[i], n) for i, n in want.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == total if total is not None else at <= packing.WINDOW


def test_filter_of_the_quality_stage_computes_nothing_again(spark):
    """The predicate stays above what it is made of: one sorting of windows and one of places in the whole plan."""
    plan = quality.stage(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 2
    words = re.findall(r"xxhash64\(", plan)
    assert len(words) == 2

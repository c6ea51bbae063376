"""Packing, piece encoding, page extraction and language, against public libraries, invariants and known answers."""

from __future__ import annotations

import html as entities
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skein.llm import langid, packing, pieces, wrappers

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


# -- packing


def test_differencing_balances():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 1500) for _ in range(300)]
    parts = packing.differencing(sizes, 40)
    assert sorted(i for p in parts for i in p) == list(range(300))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) < 0.02 * max(sums)
    assert packing.differencing([8, 7, 6, 5, 4], 2) in ([[0, 3], [1, 2, 4]], [[1, 2, 4], [0, 3]], [[0, 2], [1, 3, 4]], [[1, 3, 4], [0, 2]])


def test_window_count_rises_when_full():
    assert sorted(map(tuple, packing.balanced([3, 3, 3], 5))) == [(0,), (1,), (2,)]
    assert packing.balanced([], 5) == []


def test_balancing_ends_soon():
    """Sizes just over half, just over a third and just over a quarter of the capacity, and mixtures."""
    import time

    rng = random.Random(9)
    began = time.time()
    for sizes in ([2049] * 1023, [1366] * 1023, [1025] * 1023, [rng.choice((2049, 1366, 1025, 700)) for _ in range(1023)]):
        parts = packing.balanced(sizes, 4096)
        assert sorted(i for p in parts for i in p) == list(range(1023))
        assert max(sum(sizes[i] for i in p) for p in parts) <= 4096
        assert len(parts) <= 1.5 * max(sum(sizes) / 4096, sum(2 * s > 4096 for s in sizes))
    assert time.time() - began < 40


def check_pieces(rows, texts, window):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for doc_id, own in docs.items():
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(r.length for r in rows) / (window * len(sequences))


def test_packing_over_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_pieces(packing.pack(docs).collect(), texts, 4096) > 0.97


def test_packing_edges(spark):
    texts = [None, "", "a b", "x " * 9000, "ΑΣ ΣΑΣ <|endoftext|> it's é 　 z", "\n \n"]
    rows = packing.pack(frame(spark, texts).coalesce(1), keep_ids=True).collect()
    check_pieces(rows, dict(enumerate(texts)), 4096)
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(frame(spark, []).limit(0)).count() == 0


# -- piece encoding


def test_encoding_equals_the_library(spark):
    import sentencepiece

    model = pieces.default_model()
    library, own = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Pieces(model)
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("abcdethe  \n\t.,<>é漢😀▁1230inǵ") for _ in range(rng.randrange(0, 40)))
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text
        assert own.decode(ids) == library.decode(library.encode(text))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for r in docs.join(pieces.encode(docs), "doc_id").collect():
        assert r.ids == library.encode(r.text) and r.decoded == r.text


def test_unigram_takes_the_best_sum():
    own = pieces.Pieces(pieces.default_model())
    own.unigram = True
    own.scores = [-float(len(t) ** 0.5) if (t := own.texts.get(i)) else -9.0 for i in range(len(own.scores))]
    for word in ("theater", "information", "xabcdx"):
        best = {0: 0.0}
        for e in range(1, len(word) + 1):
            found = [best[s] + own.scores[own.ids[word[s:e]]] for s in range(e) if word[s:e] in own.ids and s in best]
            if found:
                best[e] = max(found)
        ids = np.frombuffer(own._segment(word), "<u4").tolist()
        assert "".join(own.texts[i] for i in ids) == word
        assert sum(own.scores[i] for i in ids) == pytest.approx(best[len(word)])


def test_runs_of_spaces_are_encoded_by_merges_in_time():
    import time

    import sentencepiece

    model = pieces.default_model()
    library, own = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Pieces(model)
    rng = random.Random(4)
    texts = [" " * n + rng.choice(["", "word", "x\n", "é"]) + " " * rng.randrange(9) for n in [*range(1, 70), 200, 1001]]
    texts += ["".join(rng.choice(["  ", "   ", " a", "b", "\n", "\t"]) for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t), repr(t)
        parts = own.merged(t.replace(" ", pieces.SPACE))
        assert "".join(parts).replace(pieces.SPACE, " ") == t
    began = time.time()
    assert own.decode(own.encode(" " * 200_000 + "end")) == " " * 200_000 + "end"
    assert time.time() - began < 20


def test_scores_decide_in_a_unigram_model():
    """The same automaton with sums of scores, against all ways to cut a string; a character without a piece goes
    through as unknown."""
    own = pieces.Pieces(pieces.default_model())
    rng = random.Random(6)
    vocabulary = {x: -float(rng.randrange(1, 40)) for x in ["a", "b", "ab", "ba", "aab", "bb", "abab", "bcb"]}
    own.ids = {x: k for k, x in enumerate(vocabulary)}
    own.scores, own.unigram, own.least = list(vocabulary.values()), True, min(vocabulary.values())
    import ahocorasick

    own.automaton = ahocorasick.Automaton()
    for x, k in own.ids.items():
        own.automaton.add_word(x, (len(x), k))
    own.automaton.make_automaton()

    def best(t):
        if not t:
            return 0.0, ()
        cuts = []
        for n in range(1, len(t) + 1):
            if t[:n] in vocabulary or n == 1:
                score, rest = best(t[n:])
                cuts.append((score + vocabulary.get(t[:n], own.least - pieces.UNKNOWN_PENALTY), (t[:n], *rest)))
        return max(cuts)

    for _ in range(150):
        t = "".join(rng.choice("aabbc") for _ in range(rng.randrange(2, 9)))
        got, at, total = np.frombuffer(own._segment(t), "<u4").tolist(), 0, 0.0
        while got:
            if t[at] not in vocabulary and not any(t.startswith(x, at) and own.ids[x] == got[0] for x in vocabulary):
                assert got[: len(t[at].encode())] == [own.bytes[x] for x in t[at].encode()]
                got, at, total = got[len(t[at].encode()) :], at + 1, total + own.least - pieces.UNKNOWN_PENALTY
            else:
                x = next(x for x in vocabulary if own.ids[x] == got[0])
                assert t.startswith(x, at)
                got, at, total = got[1:], at + len(x), total + vocabulary[x]
        assert at == len(t) and total == pytest.approx(best(t)[0])


def test_encoding_edges(spark):
    rows = {r.doc_id: r for r in pieces.digests(frame(spark, [None, "", "a", "a▁b", "x" * 5000])).collect()}
    assert rows[0].n_ids == rows[1].n_ids == 0 and rows[0].round_trip
    assert rows[2].round_trip and not rows[3].round_trip and rows[4].round_trip
    assert pieces.digests(frame(spark, []).limit(0)).count() == 0


# -- pages


def truth(page):
    """What the pages of the tables hold: one article of headings and paragraphs."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in blocks if x)


def test_pages_of_a_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = wrappers.op6_html_extraction(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == truth(pages[r.page_id]) and r.n_chars == len(r.text)


def site(k):
    return f"""<html><head><title>t</title></head><body><div class="top"><p>Our site</p><p>Since 1999</p></div><div id="cookie-notice">We use it</div>
      <div class="links"><a href="1">one {k}</a> <a href="2">two {k}</a></div><div class="story"><h2>Title {k}</h2><p>Body &amp; more {k}.<p>Second   line {k} <i>x</i></div>
      <ul class="comments"><li>Nice {k}</ul><form>q<input></form><script>if (a<b) {{}}</script><p>Fixed end</p></body></html>"""


def test_wrapper_tells_template_from_content(spark):
    rows = [(k, f"http://a.b/{k}", site(k)) for k in range(12)] + [(50, None, None), (51, "x", ""), (52, "http://c.d/", "no tags &lt; here")]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", pytest.importorskip("pyspark.sql.functions").lit(1))).collect()}
    for k in range(12):
        assert got[k].blocks == [f"Title {k}", f"Body & more {k}.", f"Second line {k} x"]
    assert got[50].blocks == got[51].blocks == [] and got[52].blocks == ["no tags < here"]
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, pages):
    rows = [(k, f"http://c.com/{k}", f"<html><body>{p}</body></html>") for k, p in enumerate(pages)]
    return {r.page_id: "\n".join(r.blocks) for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_copies_do_not_make_main_text_template(spark):
    few = ["<div><p>Copied main text</p></div>"] * 2 + [f"<div><p>Text {k}</p></div>" for k in range(2)]
    assert extracted(spark, few)[0] == "Copied main text"
    many = ["<article><p>Copied main text</p></article>"] * 60 + [f"<article><p>Text {k}</p></article>" for k in range(3)]
    got = extracted(spark, many)
    assert all(got[k] == "Copied main text" for k in range(60)) and got[60] == "Text 0"


def test_no_article_is_left_without_content(spark):
    got = extracted(spark, [f"<article><p>Constant text</p></article><p>Beside {k}</p>" for k in range(30)])
    assert set(got.values()) == {"Constant text"}
    got = extracted(spark, [f"<article><h1>Title {k}</h1><p>Constant text</p></article>" for k in range(30)])
    assert got == {k: f"Title {k}" for k in range(30)}


def whole(spark, pages):
    rows = [(k, f"http://c.com/{k}", p) for k, p in enumerate(pages)]
    return ["\n".join(r.blocks) for r in sorted(wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_names_do_not_take_main_text(spark):
    """Ordinary class names around and inside the main text, each page on a host of its own kind."""
    pages = [
        '<article class="post"><header class="entry-header"><h1>Title</h1></header><p>Text one.</p></article>',
        '<html><body class="post has-sidebar"><article><h1>Title</h1><p>Text two.</p></article></body></html>',
        '<html><body class="sidebar"><h1>Title</h1><p>Text three.</p></body></html>',
        '<div class="legal-news"><h1>Title</h1><p>Text four.</p></div>',
        '<article><h1>Title</h1><p class="market-share">Text five.</p></article>',
        '<div id="menu"><article><h1>Title</h1><p>Text six.</p></article></div>',
        '<div class="notice"><h1>Title</h1><p>' + "Text seven. " * 20 + '</p></div><p>Beside</p>',
    ]
    got = whole(spark, pages)
    assert got[:6] == [f"Title\nText {w}." for w in ("one", "two", "three", "four", "five", "six")]
    assert got[6].startswith("Title\nText seven.")


def test_names_that_say_what_a_part_is(spark):
    """Whole names of menus, notices, adverts and comments go, comments in articles of their own among them."""
    parts = ['<div class="site-footer">f</div>', '<div id="mainNav">n</div>', '<div class="cookie-notice">c</div>', '<section class="ad-slot">a</section>', '<div class="sidebar left">s</div>', '<ol class="comment-list"><li>r</li></ol>', '<section class="comments"><article class="comment"><p>' + "long reply " * 50 + "</p></article></section>", '<article class="comment"><p>' + "other reply " * 50 + "</p></article>"]
    pages = [f"{part}<article><h1>Title</h1><p>Text.</p></article>" for part in parts] + [f"<article><h1>Title</h1>{part}<p>Text.</p></article>" for part in parts[:6]]
    pages += [f'<div class="story"><h1>Title</h1><p>Text.</p></div>{part}' for part in parts[:6]]
    assert set(whole(spark, pages)) == {"Title\nText."}


def test_tree_matching_is_the_largest():
    def tree(plain):
        root = wrappers._restore(plain)
        wrappers._number(root)
        return root

    a = tree(["r", [["x", [["p", []]]], ["y", []], ["x", [["p", []], ["q", []]]]]])
    b = tree(["r", [["x", [["p", []], ["q", []]]], ["y", []]]])
    assert len(wrappers.tree_matching(a, b)) == 4
    assert wrappers.tree_matching(a, tree(["s", []])) == {}


def test_long_alternating_siblings_take_a_second():
    import time

    began = time.time()
    pages = ["<main>" + "".join(f"<h2>t{k}</h2><p>x{k}</p>" + f"<ul><li>{k}</li></ul>" * (k % odd == 0) for k in range(4000)) + "</main>" for odd in (3, 7)]
    roots = []
    for page in pages:
        plain, blocks = wrappers.read(page)
        assert [t for _, t, _ in blocks][:2] == ["t0", "x0"] and sum(t.startswith("x") for _, t, _ in blocks) == 4000
        roots.append(wrappers._restore(json.loads(plain)))
        wrappers._number(roots[-1])
    match = wrappers.tree_matching(*roots)
    assert len(match) > 8000 and sorted(match.values()) == [match[k] for k in sorted(match)]
    assert time.time() - began < 20


def test_alignment_is_the_best_one_and_keeps_the_order(monkeypatch):
    rng = random.Random(8)
    plain = lambda a, b, w: wrappers._by_weight(a, b, w)
    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        weight = lambda x, y: {"x": 1, "y": 3, "z": 2}[x] * (x == y)
        for limit in (40_000, -1):
            monkeypatch.setattr(wrappers, "ALIGNED", limit)
            out = wrappers._aligned(a, b, weight, lambda x, y: x == y, lambda x: x)
            assert [i for i, _ in out if i is not None] == list(range(len(a))) and [j for _, j in out if j is not None] == list(range(len(b)))
            pairs = [(i, j) for i, j in out if i is not None and j is not None]
            assert all(a[i] == b[j] for i, j in pairs)
            if limit > 0:
                assert sum(weight(a[i], b[j]) for i, j in pairs) == sum(weight(a[i], b[j]) for i, j in plain(a, b, weight))


def test_formulas_and_fallback_texts_are_kept(spark):
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><object data=a.pdf>A file <b>here</b></object><noscript>No script.</noscript><p>See <video src=v>the film</video>.</p></article>"
    text = "\n".join(t for _, t, _ in wrappers.read(page)[1])
    assert text == "Let x=2 be.\nA file hereNo script.\nSee the film."


# -- language


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200").orderBy("doc_id").collect()
    train, held = rows[::2], rows[1::2]
    languages, model = langid.train(spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in train], "doc_id long, text string, lang string"))
    scores = langid.Likelihood(model)([r.text for r in held])
    right = sum(languages[int(np.argmax(s))] == r.lang for s, r in zip(scores, held, strict=True))
    assert right / len(held) > 0.97


def test_grams_of_whole_texts_whatever_the_pieces():
    """A word of n letters has n grams of one letter, n + 1 of two with its ends and n of three. Neither the size of
    pieces nor the texts beside one change what it has."""
    grams, rng = langid.Grams(), np.random.default_rng(3)
    texts = ["", "a", "Ab c", "é1ü_x-İstanbul " * 3] + ["".join(rng.choice(list("ab é1_.Zß\n")) for _ in range(n)) for n in (5, 40, 300)]

    def found(texts, size):
        out = [defaultdict(int) for _ in texts]
        for owners, buckets in langid.pieces(texts, grams, size):
            for k, x in zip(owners.tolist(), buckets.tolist(), strict=True):
                out[k][x] += 1
        return out

    alone = [found([t], 1 << 20)[0] for t in texts]
    for size in (1 << 20, 50, 7):
        assert found(texts, size) == alone
    for t, own in zip(texts, alone, strict=True):
        assert sum(own.values()) == sum(3 * len(w) + 1 for w in re.findall(r"[^\W\d_]+", "".join(c if c.isalnum() else " " for c in t.lower())))


def test_domains(spark):
    hosts = spark.createDataFrame([("www.a.co.uk",), ("a.co.uk",), ("x.y.com",), ("com",), (None,)], "host string")
    assert [r[0] for r in hosts.select(langid.domain_of(F.col("host"))).collect()] == ["a.co.uk", "a.co.uk", "y.com", "com", None]


def test_fusion_against_brute_force(spark):
    languages = ["de", "en"]
    rows = [(1, "a.x.com", "path:de", "de", [-5.0, -1.0]), (2, "a.x.com", None, "en", [-9.0, -2.0]), (3, "b.x.com", "path:de", None, [-1.0, -4.0]), (4, "", None, None, [0.0, 0.0]), (5, None, None, "xx", [-1.0, -4.0])]
    found = spark.createDataFrame(rows, "id long, host string, code string, declared string, scores array<double>")
    got = {r.id: r for r in langid.fuse(found, languages).collect()}
    best = {1: 1, 2: 1, 3: 0, 5: 0}
    overall = [(2 + 1) / 6, (2 + 1) / 6]
    domain = [(1 + 20 * overall[0]) / 23, (2 + 20 * overall[1]) / 23]
    host = {"a.x.com": [20 * domain[0] / 22, (2 + 20 * domain[1]) / 22], "b.x.com": [(1 + 20 * domain[0]) / 21, 20 * domain[1] / 21]}

    def given(column, value):
        kinds = len({r[column] for r in rows if r[column] and r[0] in best}) + 1
        return [(sum(1 for r in rows if r[column] == value and best.get(r[0]) == k) + 1) / (2 + kinds) for k in range(2)] if value else [1, 1]

    for i, h, c, d, s in rows:
        weights = [np.exp(s[k]) * host.get(h, overall)[k] * given(2, c)[k] * given(3, d)[k] for k in range(2)]
        assert got[i].lang == languages[int(np.argmax(weights))]
        assert got[i].confidence == pytest.approx(max(weights) / sum(weights))


def test_language_of_a_table(spark):
    rows = langid.op10_language(spark, SMALL).collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) > 200").collect()}
    got = {r.doc_id: r.lang for r in rows if r.doc_id is not None}
    assert sum(got[i] == x for i, x in docs.items()) > 0.97 * len(docs)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    of_pages = {r.page_id: r.lang for r in rows if r.page_id is not None}
    assert set(of_pages) == set(pages)
    assert sum(of_pages[i] == re.search('lang="(..)"', x)[1] for i, x in pages.items()) > 0.95 * len(pages)


def test_language_edges(spark):
    assert langid.train(frame(spark, []).limit(0))[0] == []
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.fuse(langid.evidence(langid.page_rows(empty), np.zeros((langid.BUCKETS, 2), np.float32), True), ["a", "b"]).count() == 0
    odd = spark.createDataFrame([(1, None, None), (None, "http://h.de/x", "<html lang=fr>")], "page_id long, url string, html string")
    assert langid.fuse(langid.evidence(langid.page_rows(odd), np.zeros((langid.BUCKETS, 2), np.float32), True), ["a", "b"]).count() == 2


def test_declaration_is_found_anywhere():
    late = [f"<!-- {'x ' * 4000} --><html lang='fr'><p>a</p></html>", f"{' ' * 9000}<HTML class=b xml:lang=de-AT><p>a</p>", f"<script>'<html lang=en>' {'y ' * 4000}</script><html lang=it><p>a</p>", "<p>a</p>"]
    assert [langid._page(x) for x in late] == [("fr", "a"), ("de", "a"), ("it", "a"), (None, "a")]


def test_no_label_is_dropped(spark):
    labels = sorted(f"l{k:02}" for k in range(66))
    docs = spark.createDataFrame([(k, x, f"text {x}") for k, x in enumerate(labels)], "doc_id long, lang string, text string").coalesce(1).cache()
    assert langid.train(docs)[0] == labels

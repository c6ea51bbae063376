"""Near duplicates, repeated passages and personal data against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import compactwindows, orderminhash, pii
from skein.llm.shingles import labelled, shingles
from skein.sources import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def by_id(docs):
    """Texts whose nodes are the ids, so that results name them."""
    return docs.selectExpr("doc_id node", "doc_id ord", "text")


def prose(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(4000)) for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[k : k + (kind != 0)] = [] if kind == 1 else [f"new{rng.randrange(10**6)}"]
    return words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def alike(a, b, of):
    """Similarity of two texts: the share of the longer one's words, or of all shingles of both, aligned in order."""
    a, b = of(a), of(b)
    if not a or not b:
        return float(len(a) == len(b))
    if min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or len(set(a) & set(b)) < 0.3 * len(set(a)):
        return 0.0
    m = lcs(a, b)
    return m / max(len(a), len(b)) if of is word_list else m / (len(a) + len(b) - m)


def word_list(text):
    return (text or "").split()


def shingle_list(text):
    return labelled(shingles(word_list(text))).tolist()


def brute_classes(texts, of, order=None):
    """Components of all pairs at 0.8 or more, named by their least document."""
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or alike(texts[i], texts[j], of) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in range(len(texts))}


def check_classes(got, texts):
    """No link of shingles is lost, none is made up, and of links of words hardly any is lost."""
    lower, upper = brute_classes(texts, shingle_list), brute_classes(texts, word_list)
    assert all(got[i] == got[lower[i]] for i in got)
    assert all(upper[i] == upper[got[i]] for i in got)
    linked = [i for i in got if upper[i] != i]
    assert sum(got[i] == got[upper[i]] for i in linked) >= 0.9 * len(linked)


def corpus():
    rng = random.Random(5)
    texts = [None, "", "one two", "one two", "a b c d e f g h", "a b c d e f g h i"]
    for n, group in ((30, 6), (60, 8), (66, 8), (200, 12), (900, 6)):
        base = prose(rng, n)
        texts += [" ".join(edited(rng, base, rng.randrange(0, max(2, n // 25)))) for _ in range(group)]
    passage = prose(rng, 60)
    texts += [" ".join(prose(rng, 20) + passage + prose(rng, 15)) for _ in range(40)]
    texts += [" ".join(prose(rng, 150)) for _ in range(60)] + [" ".join(["same"] * n) for n in (50, 55, 80)]
    return texts


def test_classes_against_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: r.class_id for r in orderminhash.classes(frame(spark, texts)).collect()}
    check_classes(got, texts)
    kept = orderminhash.stage(spark, frame(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_classes_over_a_table(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    check_classes({r.doc_id: r.class_id for r in orderminhash.classes(frame(spark, texts)).collect()}, texts)


def test_recall_of_near_copies(spark):
    """Pairs of 200 words with one in twenty edited: most are under 0.8 by shingles, all are over it by words."""
    rng = random.Random(23)
    texts = []
    for _ in range(150):
        base = prose(rng, 200)
        texts += [" ".join(base), " ".join(edited(rng, base, 10))]
    got = {r.doc_id: r.class_id for r in orderminhash.classes(frame(spark, texts)).collect()}
    assert sum(got[i] == i - 1 for i in range(1, len(texts), 2)) >= 0.95 * 150
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_no_pair_that_is_similar_is_left_out_by_its_bins(spark):
    rng = random.Random(37)
    texts = []
    for _ in range(40):
        base = prose(rng, rng.randrange(5, 120))
        texts += [" ".join(base), " ".join(edited(rng, base, len(base) // 6)), " ".join(edited(rng, base, len(base) // 3))]
    rows = orderminhash._sequences(frame(spark, texts).select(orderminhash.F.col("doc_id").alias("node"), "text"))
    rows = rows.withColumn("n", orderminhash.F.length("words") / 4)
    both = rows.join(rows.select(*[orderminhash.F.col(c).alias({"node": "lead"}.get(c, f"lead_{c}")) for c in ("node", "n", *orderminhash.BITS)]), orderminhash.F.expr("true"))
    got = {(r.node, r.lead) for r in both.where(orderminhash._can_be_similar()).select("node", "lead").collect()}
    every = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    want = {(i, j) for i, j in every if alike(texts[i], texts[j], word_list) >= 0.8}
    assert want <= got and len(want) > 100 and len(got) < len(every) / 4


def test_long_texts_below_the_threshold_are_told_apart_by_their_words(spark):
    """Texts of 800 words fill all bins; each two of these have 0.72 of their words in common."""
    rng = random.Random(38)
    base = prose(rng, 800)
    texts = [" ".join(f"own{t}x{i}" if rng.random() < 0.15 else w for i, w in enumerate(base)) for t in range(12)]
    rows = orderminhash._sequences(frame(spark, texts).select(orderminhash.F.col("doc_id").alias("node"), "text"))
    rows = rows.withColumn("n", orderminhash.F.length("words") / 4)
    both = rows.join(rows.select(*[orderminhash.F.col(c).alias({"node": "lead"}.get(c, f"lead_{c}")) for c in ("node", "n", *orderminhash.BITS)]), orderminhash.F.expr("node <> lead"))
    assert max(sum(a == b for a, b in zip(x.split(), y.split(), strict=True)) for i, x in enumerate(texts) for y in texts[:i]) < 0.79 * 800
    assert both.where(orderminhash._can_be_similar()).count() == 0


def test_shingles_have_one_label_whether_the_text_repeats_others_or_not():
    once, twice = np.arange(10, 20, dtype=np.uint64), np.r_[np.arange(10, 20), 15].astype(np.uint64)
    assert set(labelled(once).tolist()) < set(labelled(twice).tolist())


def test_documents_are_rows_of_id_and_text(spark):
    """Rows that share an id, or have none, are not one document; repeats of a row are, and the pipeline keeps one."""
    rng = random.Random(29)
    a, b = (" ".join(prose(rng, 80)) for _ in range(2))
    docs = spark.createDataFrame([(None, a), (None, b), (5, a), (7, b), (7, b), (9, None), (9, "")], "doc_id long, text string")
    docs = docs.selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    got = sorted((r.doc_id or 0, r.class_id, r.kept) for r in orderminhash.classes(docs).collect())
    assert got == [(0, 5, False), (0, 7, False), (5, 5, True), (7, 7, True), (7, 7, True), (9, 9, True), (9, 9, True)]
    kept = orderminhash.stage(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(5, a), (7, b), (9, "")]
    nameless = orderminhash.classes(docs.where("doc_id IS NULL")).collect()
    assert len({r.class_id for r in nameless}) == 2 and all(r.kept for r in nameless)


def test_edge_tables(spark):
    empty = frame(spark, []).limit(0)
    assert orderminhash.classes(empty).count() == 0
    assert compactwindows.located(empty).count() == 0 and compactwindows.stage(spark, empty, "").count() == 0
    assert pii.sanitise(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(70))
    odd = spark.createDataFrame([(None, long, "x", 1), (None, None, None, 2), (7, long, "y", 3), (7, long, "y", 3)], "doc_id long, text string, key string, part long")
    named = sorted((r.doc_id or -1, r.class_id == 7, r.kept) for r in orderminhash.classes(odd).collect())
    assert named == [(-1, False, True), (-1, True, False), (7, True, True), (7, True, True)]
    assert pii.sanitise(odd).count() == 4


def test_alignment_is_the_best_one(monkeypatch):
    rng = random.Random(1)
    for step in (256, 7):
        monkeypatch.setattr(orderminhash, "STEP", step)
        for _ in range(300):
            a, b = ([rng.randrange(rng.choice((3, 30))) for _ in range(rng.randrange(1, 60))] for _ in range(2))
            assert orderminhash.aligned(a, b, len(b), len(a)) == lcs(a, b)
            low, high = rng.randrange(12), rng.randrange(12)
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    hit = a[i] == b[j] and -low <= i - j <= high
                    best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + 1 if hit else 0)
            assert orderminhash.aligned(a, b, low, high) == best[-1][-1]
            for s in (0.5, 0.8):
                m = lcs(a, b)
                assert orderminhash.similar(np.array(a), np.array(b), s) == (m / max(len(a), len(b)) >= s - 1e-12)


def test_windows_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, width = int(rng.integers(1, 60)), int(rng.integers(2, 12))
        values = rng.integers(1, 30, n).astype(np.uint64)
        got = set(zip(*(x.tolist() for x in compactwindows.compact_windows(values, width)), strict=True))
        want = set()
        for c in range(n):
            lo = c
            while lo > 0 and values[lo - 1] > values[c]:
                lo -= 1
            hi = c
            while hi < n - 1 and values[hi + 1] >= values[c]:
                hi += 1
            if hi - lo + 1 >= width:
                want.add((lo, c, hi))
        assert got == want


def repeated_words(texts, size=50):
    """Words of each text in a run of ``size`` that an earlier text has."""
    seen, out = {}, {}
    for i, t in enumerate(texts):
        words = (t or "").split()
        grams = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]
        out[i] = {j for k, g in enumerate(grams) if g in seen for j in range(k, k + size)}
        for g in grams:
            seen.setdefault(g, i)
    return out


def crowded(rng):
    """Documents in which a near copy has only an earlier document with the same line in other text as its group's
    first: the line holds most pivots of the passages."""
    line = prose(rng, 40)
    texts = [prose(rng, 60) + line + prose(rng, 60), prose(rng, 40) + line + prose(rng, 40)]
    pairs = []
    for _ in range(12):
        passage = prose(rng, 11) + line + prose(rng, 3)
        near = [*passage[:10], "changed", *passage[11:]]
        pairs.append((len(texts), len(texts) + 1))
        texts += [prose(rng, 30) + passage + prose(rng, 30), prose(rng, 30) + near + prose(rng, 30)]
    return [" ".join(t) for t in texts], pairs


def test_passages_of_windows_that_their_group_s_first_does_not_confirm(spark):
    texts, pairs = crowded(random.Random(21))
    found = {(r.x, r.y) for r in compactwindows.passages(by_id(frame(spark, texts))).collect()}
    assert found >= {(b, a) for a, b in pairs}
    assert all((y, x) in pairs for x, y in found)


def test_passages_beside_another_place_of_the_same_line_in_the_first(spark):
    rng = random.Random(22)
    texts = []
    for _ in range(12):
        line, left, right = prose(rng, 40), prose(rng, 3), prose(rng, 7)
        texts.append(" ".join(prose(rng, 50) + line + prose(rng, 60) + left + line + right + prose(rng, 50)))
        texts.append(" ".join(prose(rng, 30) + left + line + right + prose(rng, 30)))
    found = compactwindows.passages(by_id(frame(spark, texts))).collect()
    for k in range(1, len(texts), 2):
        assert any(r.x == k and r.y == k - 1 and r.xa <= 30 and r.xb >= 80 for r in found)


def recalled(rng, edit, n, count=400):
    """The share of ``count`` passages of n words whose edited copy in other text is found, with the first of its group
    its only partner."""
    found = 0
    for _ in range(count):
        passage = prose(rng, n)
        texts = [prose(rng, 60) + passage + prose(rng, 60), prose(rng, 60) + edit(passage) + prose(rng, 60)]
        search = compactwindows._Windows(50)
        search({"node": [0, 1], "ord": [0, 1], "text": [" ".join(t) for t in texts]})
        rows = search.finish()
        pairs = [{c: int(v[k]) for c, v in rows.items()} for k in np.flatnonzero(~rows["lead"] & (rows["x"] == 1) & (rows["y"] == 0))]
        boxes = [(w["xc"] - w["yc"], max(w["xl"], w["yl"] + w["xc"] - w["yc"]), min(w["xr"], w["yr"] + w["xc"] - w["yc"])) for w in pairs]
        x, y = ((shingles(t) >> np.uint64(32)).astype("<u4") for t in (texts[1], texts[0]))
        found += any(a <= 62 and b >= 60 + n - 6 for a, b, _, _ in compactwindows.chains(x, y, boxes, 50, 0.8))
    return found / count


def test_near_passages_are_recalled():
    rng = random.Random(23)
    assert recalled(rng, lambda p: [*p[:25], "changed", *p[26:]], 50) >= 0.995
    for more in (5, 8):
        assert recalled(rng, lambda p, k=more: [*p[:40], *prose(rng, k), *p[40:]], 80) >= 0.995


def test_runs_listed_and_gone_through_are_the_same(monkeypatch):
    rng = np.random.default_rng(24)
    for _ in range(50):
        x, y = (rng.integers(1, 4, int(n)).astype("<u4") for n in rng.integers(30, 90, 2))
        x[10:25] = y[5:20]
        want = sorted(compactwindows._equal_runs(x, y, 5, 5, 60, 0.8))
        monkeypatch.setattr(compactwindows, "LISTED", -1)
        assert sorted(compactwindows._equal_runs(x, y, 5, 5, 60, 0.8)) == want
        monkeypatch.undo()


def test_passages_hold_exact_repeats(spark):
    rng = random.Random(9)
    shared = [prose(rng, n) for n in (50, 55, 80, 300)]
    line = prose(rng, 20)
    texts = [None, "", "short"]
    for k in range(120):
        body = prose(rng, rng.randrange(10, 200))
        if k % 2:
            body[len(body) // 2 : len(body) // 2] = shared[k % 4]
        if k % 3:
            body[5:5] = line
        texts.append(" ".join(body))
    near = edited(rng, shared[3], 3)
    texts.append(" ".join(prose(rng, 40) + near + prose(rng, 40)))
    found = compactwindows.passages(by_id(frame(spark, texts))).collect()
    spans = {i: [(r.xa, r.xb) for r in found if r.x == i] for i in range(len(texts))}
    caught = 0
    for i, places in repeated_words(texts).items():
        assert all(any(a <= j < b for a, b in spans[i]) for j in places)
        caught += len(places)
        if not places and i < len(texts) - 1:
            assert not spans[i]
    assert caught
    assert max(b - a for a, b in spans[len(texts) - 1]) > 0.8 * len(near)

    # The documents: every repeat of 50 words is left in one text only, and all that is cut is a repeat.
    docs = frame(spark, texts + texts[3:5])
    rows = {r.doc_id: [m for m in r.marks if m.cut] for r in compactwindows.located(docs).collect()}
    left = {r.doc_id: r.text for r in compactwindows.stage(spark, docs, "").collect()}
    assert set(left) == set(range(len(texts) + 2))
    for i, t in enumerate(texts + texts[3:5]):
        want, at = [], 0
        for m in sorted(rows.get(i, []), key=lambda m: m.a):
            want.append((t or "")[at : m.a])
            at = m.b
        assert left[i] == ("".join([*want, t[at:]]) if want else t)
    assert [left[len(texts)].strip(), left[len(texts) + 1].strip()] == ["", ""]
    assert not any(repeated_words([left[i] for i in range(len(texts) + 2)]).values())
    assert all(left[i] == texts[i] for i in range(3, 123, 6))


def test_dense_repeats_have_few_windows_and_are_found_whole(spark):
    """Runs of one word, and short lines over and over, that two texts have at different lengths."""
    rng = random.Random(33)
    line = prose(rng, 9)
    inner = {"run": (["same"] * 700, ["same"] * 60), "line": (line * 90, line * 8), "odd": (["a", "b"] * 400, ["b", "a"] * 33)}
    for long, short in inner.values():
        texts = [prose(rng, 40) + short + prose(rng, 40), prose(rng, 60) + long + prose(rng, 60)]
        search = compactwindows._Windows(50)
        search({"node": [0, 1], "ord": [0, 1], "text": [" ".join(t) for t in texts]})
        assert len(search.finish()["x"]) < 8 * (len(texts[0]) + len(texts[1])) * 2 / 23
        found = compactwindows.passages(by_id(frame(spark, [" ".join(t) for t in texts]))).collect()
        covered = {k for r in found if r.x == 1 for k in range(r.xa, r.xb)}
        assert set(range(62, 58 + len(long))) <= covered and covered <= set(range(50, 70 + len(long)))


def test_texts_under_one_id_keep_to_themselves(spark):
    """Ids decide nothing: an unrelated text under the id of a repeated one, or under none, is left alone."""
    rng = random.Random(31)
    passage = prose(rng, 80)
    a, b = (" ".join(prose(rng, 35) + passage + prose(rng, 35)) for _ in range(2))
    other = [" ".join(prose(rng, 150)) for _ in range(3)]
    docs = spark.createDataFrame([(1, a), (5, b), (5, other[0]), (None, other[1]), (None, other[2]), (7, other[2]), (5, other[0])], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    cut = sorted((r.doc_id or 0, r.text.strip()) for r in compactwindows.stage(spark, docs, "").collect())
    lost = [i for i, t in cut if (i, t) not in {(1, a), (5, b), (5, other[0]), (0, other[1]), (7, other[2])}]
    assert len(cut) == 7 and len(lost) == 2 and 0 in lost and (0, "") in cut
    assert [t for _, t in cut].count(other[0]) == 2 and (0, other[1]) in cut and (7, other[2]) in cut
    assert [i for i, t in cut if " ".join(passage) in t] == [1]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@pytest.mark.parametrize("seed", range(3))
def test_emails_are_the_leftmost_matches(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        text = "".join(rng.choice("ab@@.-_ é1%") for _ in range(rng.randrange(0, 40)))
        assert pii.base_spans(text)["email"] == [m.span() for m in EMAIL.finditer(text)]


def checked(text, pattern, fits):
    return [m.span() for m in re.finditer(pattern, text) if fits(m[0])]


def by_the_contract(text):
    digits = lambda x: re.sub(r"[^0-9]", "", x)

    def luhn(x):
        d = [int(c) for c in digits(x)]
        d[-2::-2] = [n * 2 - 9 * (n > 4) for n in d[-2::-2]]
        return 13 <= len(d) <= 19 and sum(d) % 10 == 0

    return {
        "email": checked(text, EMAIL, lambda x: True),
        "ip": checked(text, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": checked(text, r"[0-9]([\x20-]?[0-9])+", luhn),
        "phone": checked(text, r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    }


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_by_the_contract(seed):
    rng = random.Random(seed)
    for alphabet in ("0123456789.", "12..", "0123456789 -", "4- 1+().9", "+1 (2)-. a", "09a@.+ -\n"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 45)))
            assert pii.base_spans(text) == by_the_contract(text), text


def test_spans_of_long_texts_are_found_in_linear_time():
    import time

    began = time.time()
    for text in ("1" * 300_000, "1." * 100_000, "+1 " * 100_000, "a@" * 100_000, "alpha me@here.org " * 20_000, "x" * 300_000 + " 1.2.3.4"):
        list(pii.contexts(text))
    assert time.time() - began < 20


def test_neighbours_are_terms_whatever_their_length():
    long, far = "y" * 5000, " " * 3000
    (_, terms, _), = pii.contexts(f"one\n{long} {far} near me@here.org {far} after\nother")
    assert terms == [long, "near", "after"]
    got = next(pii.contexts("a " + " ".join(f"word{chr(97 + i)}" for i in range(20)) + " 1.2.3.4 end"))
    assert got[1] == [f"word{chr(97 + i)}" for i in range(12, 20)] + ["end"]


def test_entities_of_rows_without_ids(spark, monkeypatch):
    """Null ids neither crash nor change the result, on either side of the bound of what is broadcast."""
    texts = [f"a{chr(97 + i)}a zorblax me@here.org Quux b{chr(97 + i)}b" for i in range(6)] + ["nothing here at all"] * 20
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    direct = sorted((r.spans, r.text) for r in pii.sanitise(docs).collect())
    named = sorted((r.spans, r.text) for r in pii.sanitise(frame(spark, texts).select("doc_id", "text")).collect())
    assert direct == named and any("term" in x for x, _ in direct)
    monkeypatch.setattr(pii, "BROADCAST_PAIRS", 0)
    assert sorted((r.spans, r.text) for r in pii.sanitise(docs).collect()) == direct
    assert pii.sanitise(spark.createDataFrame([(None, "x me@here.org"), (None, "y me@here.org")], "doc_id long, text string")).count() == 2


def test_generalised_terms_keep_their_kind():
    assert [pii.general(x) for x in ("Miller", "NATO", "river")] == ["[NAME]", "[ACRONYM]", "[TERM]"]


def test_pii_spans(spark):
    texts = [None, "", "mail a.b@c.d.com, ip 1.2.3.4 and 1.2.3.999 card 4111 1111 1111 1111 or 4111111111111112 tel +1 (386) 555-3733.", "😀 x@y.z"]
    rows = {r.doc_id: r for r in pii.sanitise(frame(spark, texts)).collect()}
    r = rows[2]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.text == "mail [EMAIL], ip [IP] and 1.2.3.999 card [CARD] or 4111111111111112 tel [PHONE]."
    assert rows[3].spans == "email:2:7" and rows[3].base_sha256 == hashlib.sha256(b"email:2:7").hexdigest()
    assert rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def brute_disclosures(texts):
    import math
    from collections import Counter, defaultdict

    df, ent, co, ctx = Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        t = t or ""
        df.update(set(pii.TERM.findall(t.lower())))
        pairs, es = set(), set()
        for e, terms, digest in pii.contexts(t):
            es.add(e)
            for w in set(terms):
                pairs.add((e, w))
                ctx[e, w].add(digest)
        ent.update(es)
        co.update(pairs)
    n, out = len(texts), {}
    for (e, w), c in co.items():
        if len(ctx[e, w]) >= pii.SUPPORT and ent[e] < n:
            x = math.log(n * c / (ent[e] * df[w])) / math.log(n / ent[e])
            if x >= pii.GENERALISE:
                out[e, w] = round(x, 9)
    return out


def test_disclosures_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(60)]
    texts += [f"{rng.choice(words)} zorblax {rng.choice(words)} me@here.org {rng.choice(words)} quux end {i}" for i in range(5)]
    texts += ["zorblax alone", None]
    docs = frame(spark, texts)
    found = pii._found(docs.select("doc_id", "text"))
    got = {(r.entity, r.term): round(r.disclosure, 9) for r in pii.disclosures(docs, found).collect()}
    assert got == brute_disclosures(texts) and any(w == "zorblax" for _, w in got)
    direct = {r.doc_id: (r.spans, r.text) for r in pii.sanitise(docs).collect()}
    assert "term" in direct[60][0] and "zorblax" not in direct[60][1] and direct[65][1] == "zorblax alone"
    monkeypatch.setattr(pii, "BROADCAST_PAIRS", 0)
    assert {r.doc_id: (r.spans, r.text) for r in pii.sanitise(docs).collect()} == direct


def test_a_common_line_brings_few_windows_together(spark):
    """A line of 40 words, under a passage, in every text: the pairs that are compared grow with the texts; passages
    that some of the texts share beside the line are found."""
    rng = random.Random(11)
    own = lambda n: [f"w{rng.randrange(1 << 30)}" for _ in range(n)]
    counts = []
    for n in (100, 200):
        line, tail = own(40), own(30)
        texts = [" ".join(own(60) + line + (tail if i in (n // 2, n - 3) else own(30)) + own(30)) for i in range(n)]
        windows = compactwindows.candidate_pairs(by_id(frame(spark, texts)), 50)
        known = windows.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        sequences = compactwindows._packed(by_id(frame(spark, texts)), known)
        groups = windows.select("grp").distinct()
        counts.append(compactwindows._rest(windows, groups, sequences, 50, 0.8).count())
        found = {(r.x, r.y) for r in compactwindows.passages(by_id(frame(spark, texts))).collect()}
        assert found == {(n - 3, n // 2)}
    assert counts[1] < 2.5 * counts[0]


def test_pairs_are_deleted_before_those_of_open_groups_are_verified(spark, monkeypatch):
    """While the last pairs are verified, these and the sequences, and what the first have given, are all that is kept."""
    tables, verify, folder = [], compactwindows._verify, scratch.scratch_folder(spark).removeprefix("file:")
    os.makedirs(folder, exist_ok=True)

    def watched(pairs, *more):
        tables.append(set(os.listdir(folder)))
        return verify(pairs, *more)

    monkeypatch.setattr(compactwindows, "_verify", watched)
    rng = random.Random(39)
    line = prose(rng, 60)
    texts = frame(spark, [" ".join([*prose(rng, 40), *line, *prose(rng, 40)]) for _ in range(20)])
    before = set(os.listdir(folder))
    compactwindows.passages(texts.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("ord"), "text")).count()
    assert len(tables[0] - before) == 2 and len(tables[1] - before) == 3


def test_leads_gone_through_and_looked_up_are_the_same(monkeypatch):
    """Windows with one line or half of what is around it in common, by either way."""
    rng, found = np.random.default_rng(21), []
    line, blocks = rng.integers(1, 1 << 32, 60, dtype=np.uint32), rng.integers(1, 1 << 32, (5, 91), dtype=np.uint32)
    near = rng.integers(1, 1 << 32, (120, 91), dtype=np.uint32)
    near[:60, 15:75] = line
    for k in range(60, 120):
        near[k, k % 40 :] = blocks[k % 5, k % 40 :]
    rows = {"grp": [1] * 120, "ord": list(range(120)), "node": list(range(120)), "c": [45] * 120, "l": [0] * 120, "r": [90] * 120, "near": [x.tobytes() for x in near]}
    for direct in (0, 10**9):
        monkeypatch.setattr(compactwindows, "DIRECT", direct)
        found.append(compactwindows._Rest(50, 0.8)(rows))
    assert found[0] == found[1] and len(found[0]["x"]) > 60


def test_repeated_lines_are_searched_in_the_largest_boxes_only(monkeypatch):
    """Two texts of one line over and over, a word of one changed: their boxes lie in one another."""
    rng, calls, equal_runs = np.random.default_rng(41), [], compactwindows._equal_runs
    line = rng.integers(1, 1 << 32, 13, dtype=np.uint32)
    x, y = np.tile(line, 60), np.tile(line, 60)
    x[300:305] = rng.integers(1, 1 << 32, 5, dtype=np.uint32)
    boxes = [(13 * k, 65 * j, 65 * j + 50) for k in range(-4, 5) for j in range(1, 11)] + [(0, 0, 779)]
    monkeypatch.setattr(compactwindows, "_equal_runs", lambda *a: calls.append(a) or equal_runs(*a))
    found = compactwindows.chains(x, y, boxes, 50, 0.8)
    assert len(calls) == 1 and {k for a, b, _, _ in found for k in range(a, b)} >= set(range(780)) - set(range(290, 315))
    monkeypatch.setattr(compactwindows, "_outer", lambda boxes, *a: boxes)
    assert compactwindows.chains(x, y, boxes, 50, 0.8) == found and len(calls) > 9


def test_chains_in_lists_and_in_arrays_are_the_same(monkeypatch):
    rng, spans = random.Random(42), 0
    for _ in range(60):
        runs = sorted([a, a + rng.randrange(6, 40), rng.randrange(-9, 10)] for a in (rng.randrange(400) for _ in range(rng.randrange(2, 150))))
        found = []
        for few in (0, 10**9):
            monkeypatch.setattr(compactwindows, "FEW_RUNS", few)
            found.append(compactwindows._chained(runs, 46, 0.8))
        assert found[0] == found[1]
        spans += len(found[0])
    assert spans > 100


def test_windows_that_are_confirmed_are_not_compared_again(spark, monkeypatch):
    """A passage in 30 texts, and its first line in two others: hardly a pair of the 30 comes again."""
    rng, again, rest = random.Random(43), [], compactwindows._rest
    passage = prose(rng, 70)
    texts = [" ".join(prose(rng, 40) + passage + prose(rng, 40)) for _ in range(30)]
    texts += [" ".join(prose(rng, 60) + passage[:30] + prose(rng, 60)) for _ in range(2)]
    monkeypatch.setattr(compactwindows, "_rest", lambda *a: again.append(rest(*a)) or again[-1])
    monkeypatch.setattr(compactwindows, "discard", lambda *frames: None)
    found = {r.x for r in compactwindows.passages(by_id(frame(spark, texts))).collect()}
    assert found == set(range(1, 30))
    assert again[0].where("x < 30 AND y < 30").count() < 29

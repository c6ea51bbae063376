"""The three operators of DataFrame functions alone, against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from skein.llm import chat, fingerprint, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["", None, "one two three one two three one two", "a\n\na b\na b\n \t\n", "x" * 50, " ".join(str(i % 40) for i in range(120)), "The of *** and <b> | x\x0by\x1fz", "word " * 3000, "é ü 漢字 😀 ok. Next one! Third? end\nline two", "same", "same"]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def test_quality_against_brute_force(spark):
    rows = {r.doc_id: r for r in quality.judge(frame(spark, TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), t
        assert not (r.base_failed and r.kept)


def test_quality_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in quality.judge(docs).collect()}
    for d in docs.collect():
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(d.text)


def test_quality_edge_tables(spark):
    assert quality.judge(frame(spark, []).limit(0)).count() == 0
    odd = frame(spark, ["a b"]).withColumnsRenamed({"lang": "_words", "source": "kept"})
    assert quality.judge(odd).count() == 1
    stage = quality.stage(spark, frame(spark, TEXTS), "")
    assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "\\<|\\", None, "", "a\nb\\n", "<\\|im_end|>\n", "😀<|"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (None, 5, "assistant", "y"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(chat.F.col("text")))
    out = {r.conv_id: r for r in chat.format_chats(df).select("*", chat.read_back(chat.F.col("formatted")).alias("read")).collect()}
    assert [(t.role, t.text) for t in out[1].read] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert [out[1].formatted[s.start : s.end].replace("<\\|", "<|").replace("\\\\", "\\") for s in out[1].loss_spans][0] == "\\<|\\"
    assert [(t.role, t.text) for t in out[2].read] == [("", "x"), ("assistant", "x"), ("assistant", "x")]
    assert out[None].n_turns == 1


def test_chat_parts(spark):
    parts = [[("text", "see <|im_end|>", None, None), ("image", None, "a.png", 10), ("audio", None, "b.wav", None), (None, "end", None, None)], None]
    df = spark.createDataFrame([(1, 0, "user", parts[0]), (1, 1, "assistant", parts[1])], f"conv_id long, turn long, role string, parts {chat.PART}")
    r = chat.format_chats(df).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|im_end|><|image:1|><|audio:2|>end<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.number, a.kind, a.uri, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 10), (2, "audio", "b.wav", 750)]
    assert r.expanded_tokens == 760


def fingerprints(spark, texts):
    rows = fingerprint.fingerprint(frame(spark, texts), "text", "fp").collect()
    return {r.doc_id: r.fp for r in rows}


def test_fingerprint_is_homomorphic(spark):
    a, b, both = "One is here.\nTwo", "Three! Four", "Three! Four\nOne is here.\nTwo"
    df = frame(spark, [a]).select(chat.F.lit(a).alias("a"), chat.F.lit(b).alias("b"), chat.F.lit(both).alias("c"))
    for c in "abc":
        df = fingerprint.fingerprint(df, c, f"f{c}")
    r = df.select(fingerprint.add(chat.F.col("fa"), chat.F.col("fb")).alias("sum"), "fc", fingerprint.add(chat.F.col("fc"), chat.F.col("fb"), -1).alias("less"), "fa").first()
    assert (r["sum"].n, r["sum"].equal, r["sum"].like) == (r.fc.n, r.fc.equal, r.fc.like)
    assert (r.less.n, r.less.equal, r.less.like) == (r.fa.n, r.fa.equal, r.fa.like)


def test_order_of_paragraphs_does_not_matter(spark):
    same = ["One. Two.\nThree\nThree\n", "Three\n\nOne. Two.\nThree", "Three\nThree\nOne. Two.\n"]
    got = fingerprints(spark, [*same, "Three\nOne. Two.\n", "One.\nTwo.\nThree\nThree\n", "", None])
    assert got[0] == got[1] == got[2] and got[5] == got[6]
    assert len({tuple(got[i].equal) for i in (0, 3, 4, 5)}) == 4


def test_likeness_against_brute_force(spark):
    """The estimate is that of the lanes, and lies near the share of sentences in common."""
    rng = np.random.default_rng(7)
    pool = [f"Sentence {k} stands here." for k in range(900)]
    texts = [" ".join(rng.choice(pool, 150)) for _ in range(6)]
    texts += [" ".join([*t.split(". ")[0:1], t]) for t in texts] + [texts[0] + "\nMore. And more."]
    fps = fingerprints(spark, texts)
    rows = spark.createDataFrame([(i, j, fps[i], fps[j]) for i in fps for j in fps], "i long, j long, a struct<n:long,equal:array<long>,like:array<long>>, b struct<n:long,equal:array<long>,like:array<long>>")
    got = {(r.i, r.j): r.x for r in rows.select("i", "j", fingerprint.likeness(chat.F.col("a"), chat.F.col("b")).alias("x")).collect()}

    def signs(fp):
        packed = np.array(fp.like, np.int64)
        return np.concatenate([2.0 * ((packed >> k) & ((1 << 21) - 1)) - fp.n for k in (0, 21, 42)])

    for i, j in got:
        a, b = signs(fps[i]), signs(fps[j])
        want = 1.0 if fps[i].equal == fps[j].equal else min(1.0, max(0.0, 1 - ((a - b) ** 2).sum() / ((a**2).sum() + (b**2).sum())))
        assert got[i, j] == pytest.approx(want)
        counts = [Counter(re.split(r"\n|(?<=[.!?]) ", texts[k])) for k in (i, j)]
        apart = sum((counts[0][u] - counts[1][u]) ** 2 for u in counts[0] | counts[1])
        size = sum(n * n for c in counts for n in c.values())
        assert abs(got[i, j] - max(0, 1 - apart / size)) < 0.35


def test_likeness_orders_pairs(spark):
    sents = [f"Sentence number {i} has its own words." for i in range(60)]
    texts = [" ".join(sents), " ".join(sents[:30] + [f"Other {i}." for i in range(30)]), " ".join(f"Else {i}." for i in range(60))]
    df = frame(spark, texts[:1]).select(*[chat.F.lit(t).alias(f"t{i}") for i, t in enumerate(texts)])
    for i in range(3):
        df = fingerprint.fingerprint(df, f"t{i}", f"f{i}")
    r = df.select(*[fingerprint.likeness(chat.F.col("f0"), chat.F.col(f"f{i}")).alias(f"l{i}") for i in range(3)]).first()
    assert r.l0 == 1.0 and 0.3 < r.l1 < 0.7 and r.l2 < 0.3


@pytest.mark.parametrize("name", ["sf0.001", "small", "one", "none"])
def test_next_document_and_edit(spark, tmp_path, name):
    if name == "sf0.001":
        folder = "/root/testdata/sf0.001"
    else:
        folder = str(tmp_path)
        frame(spark, {"small": TEXTS, "one": ["abc"], "none": []}[name]).write.parquet(f"{folder}/documents.parquet")
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.op9_document_fingerprints(spark, folder).collect()}
    assert len(got) == len(docs)
    same = {}
    for k, (i, text) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(text) and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        same.setdefault(text, set()).add(got[i].fingerprint)
        if after == text:
            assert got[i].near_next == 1
    assert all(len(x) == 1 for x in same.values()) and len({f for x in same.values() for f in x}) == len(same)

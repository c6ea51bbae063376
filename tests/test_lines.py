"""Structured text against a plain reading, line by line."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from skein.sources import lines as L

WORDS = "part book chapter section lecture discourse appendix introduction preface foreword contents notes karika sutra".split()


def plain_blocks(text):
    """(level, text, locator) by one walk over the lines, with states kept by hand."""
    rows = [r.strip() for r in text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n[[PAGE_BREAK]]\n").split("\n")]
    out, held, page, breaks, k = [], [], "unpaginated", 0, 0

    def end():
        if held:
            a, b = held[0][0], held[-1][0]
            out.append((None, re.sub(r"\s+", " ", " ".join(t for _, t, _ in held)), f"text/page[{held[0][2]}]/" + (f"line[{a}]" if a == b else f"lines[{a}-{b}]")))
            held.clear()

    fits = lambda t: 1 <= len(t.split()) <= 18 and len(t) <= 120
    while k < len(rows):
        t, step, level, title = rows[k], 1, None, rows[k]
        number = re.fullmatch(r"[\[\(\--—_\s]*(?:page|pg\.?|p\.)\s*([0-9]+|[ivxlcdm]+)[\]\)\--—_\s]*", t, re.I)
        if t == "[[PAGE_BREAK]]" or number or not t:
            end()
            if t == "[[PAGE_BREAK]]":
                breaks += 1
                page = f"break-{breaks}"
            elif number:
                page = number[1].lower()
            k += 1
            continue
        hashes = len(t) - len(t.lstrip("#"))
        if 1 <= hashes <= 6 and t[hashes : hashes + 1].isspace():
            level, title = hashes, t[hashes:].strip()
            level, title = hashes, (title.rstrip("#").rstrip() or title[:1])
        elif k + 1 < len(rows) and rows[k + 1] and set(rows[k + 1]) in ({"="}, {"-"}) and fits(t):
            level, step = (1 if rows[k + 1][0] == "=" else 2), 2
        elif fits(t) and (any(re.match(w + r"\b", t, re.I) for w in WORDS) or re.match(r"(translator|editor)('s)?\s+note\b", t, re.I)):
            low = t.lower()
            level = 2 if low.startswith(("chapter", "lecture", "discourse")) else 3 if low.startswith(("section", "karika", "sutra")) else 1
        elif fits(t) and t[-1] not in ".?!;" and sum(c.isalpha() for c in t) >= 3 and all(c.isupper() for c in t if c.isalpha()):
            level = 2
        if level is None:
            held.append((k + 1, t, page))
        else:
            end()
            out.append((level, title, f"text/page[{page}]/" + (f"line[{k + 1}]" if step == 1 else f"lines[{k + 1}-{k + 2}]")))
        k += step
    end()
    return out


PIECES = ["# One", "## Two ##", "###### Six", "####### seven", "#tag", "Title here", "====", "---", "-----", "", "", "CAPITALS HERE", "CAPS END.", "Ab", "Chapter II", "partly so", "Part 1", "Section-3 x", "translator's note on it", "Editor note", "NOTES", "[[PAGE_BREAK]]", "Page 12", "[p. iv]", "see page 3", "— pg 7 —", "a  line\twith   gaps", "some words, and more of them", "word " * 19, "x" * 121, "12 345", "ÄÖÜ STRASSE", "देव नागरी", "a\fb", "one\r\ntwo\rthree"]


def _texts():
    import random

    draw = random.Random(5)
    return [*PIECES, "Title\n---\n---\n---\nend", "---\n---\n---\n---", "a\n\n# H\n# G\n\ntext\n"] + ["\n".join(draw.choice(PIECES) for _ in range(draw.randint(1, 25))) for _ in range(400)]


def test_blocks_equal_a_plain_reading(spark):
    texts = [t for t in _texts() if t.strip()]
    # Repeated ids, and a column with a clashing name.
    frame = spark.createDataFrame([(k // 2, t, "x", k) for k, t in enumerate(texts)], "doc_id int, text string, level string, place int")
    got: dict[int, list] = {}
    for r in L.text_blocks(frame).orderBy("place", "block").collect():
        got.setdefault(r["place"], []).append((r["level"], r["text"], r["locator"]))
    for k, t in enumerate(texts):
        assert got.get(k, []) == plain_blocks(t), t


def test_sections_units_and_warnings(spark):
    note = "Translator's note: " + "long " * 19 + "end"
    text = f"before\n\nPART ONE\n# Empty\n## Notes\n\nfirst\n\n{note}\n\n# Appendix A\nlast words-\nand more-\nagain-\n"
    frame = spark.createDataFrame([(1, "s", text), (2, "s", None), (3, "s", "  \n "), (4, "s", "a <DIV class='x'>b</DIV>"), (5, "s", "|" * 50 + "�")], "doc_id int, source string, text string")
    rows = L.text_units(L.text_blocks(frame)).where("doc_id = 1").orderBy("block").collect()
    assert [(r["section"], r["section_level"], r["title"], r["unit"], r["unit_type"], r["text"]) for r in rows] == [
        (0, 0, "Front Matter", 0, "body", "before"),
        (1, 1, "Notes", 0, "footnote", "first"),
        (1, 1, "Notes", 1, "translator_note", note),
        (2, 0, "Appendix A", 0, "appendix", "last words- and more- again-"),
    ]
    told = {(r["doc_id"], r["code"]): r["n"] for r in L.text_warnings(frame, "doc_id", scanned=F.lit(True)).collect()}
    assert told == {(1, "heading_without_content"): 2, (1, "possible_ocr_line_hyphenation"): 3, (1, "missing_page_markers"): 1, (2, "no_text"): 1, (3, "no_text"): 1, (4, "html_markup"): 1, (5, "replacement_characters_detected"): 1, (5, "possible_ocr_corruption"): 1, (5, "no_explicit_headings"): 1, (5, "missing_page_markers"): 1}
    assert L.text_blocks(frame.limit(0)).count() == 0


def test_one_exchange_for_blocks(spark):
    plan = L.text_blocks(spark.createDataFrame([(1, "a")], "doc_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

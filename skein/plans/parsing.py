"""Structured text: blocks, sections and warnings of ``documents`` by the rules of ``skein.sources.lines``."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.plans.registry import Plans
from skein.sources import lines as L
from skein.sources.tables import table

plans = Plans()


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_TRIM = f"regexp_replace(line, '^{L.SPACE}+|{L.SPACE}+$', '', 'g')"
_UNIX = f"replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(12), chr(10) || '{L.PAGE_BREAK}' || chr(10))"
_BLANK = r"coalesce(NOT regexp_matches(text, '[^\n\r\f\x0b\x1c-\x1e\x{85}\t\x1f\p{Z}]'), true)"
_MARKUP = f"regexp_matches(substring({_UNIX}, 1, {L.MARKUP_WITHIN}), {_q(L.MARKUP)})"
LINES_SQL = rf"""
raw AS (SELECT doc_id, source, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, string_split_regex({_UNIX}, '{L.LINE_ENDS}') AS l FROM documents WHERE NOT {_BLANK} AND NOT {_MARKUP})),
cut AS (SELECT doc_id, source, i, {_TRIM} AS line FROM raw),
told AS (SELECT *, line = '{L.PAGE_BREAK}' AS brk, CASE WHEN regexp_matches(line, {_q(L.PAGE)}) THEN lower(regexp_extract(line, {_q(L.PAGE)}, 1)) END AS label,
  length(regexp_extract(line, {_q(L.MARKDOWN)}, 1)) AS marks, regexp_matches(line, '{L.UNDERLINE}') AS underline,
  length(line) <= {L.MOST_CHARACTERS} AND len(regexp_extract_all(line, '[^ \t\x1f\p{{Z}}]+')) BETWEEN 1 AND {L.MOST_WORDS} AS short FROM cut),
upon AS (SELECT *, line <> '' AND NOT brk AND label IS NULL AS plain, line <> '' AND NOT brk AND label IS NULL AND marks = 0 AND short AND coalesce(lead(underline) OVER w, false) AS upon FROM told WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT *, upon AND (i - coalesce(max(CASE WHEN NOT upon THEN i END) OVER w, 0)) % 2 = 1 AS setext, lead(line) OVER w AS next_line, CASE WHEN brk THEN 'break-' || sum(CAST(brk AS INT)) OVER w ELSE label END AS mark FROM upon WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
lev AS (SELECT *, coalesce(lag(setext) OVER w, false) AS taken, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'unpaginated') AS page FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
kinds AS (SELECT *, CASE WHEN NOT plain OR taken THEN NULL WHEN marks > 0 THEN marks WHEN setext THEN CASE WHEN next_line LIKE '=%' THEN 1 ELSE 2 END
  WHEN short AND regexp_matches(line, {_q(L.EXPLICIT)}) THEN CASE WHEN regexp_matches(line, '{L.FIRST_LEVEL}') THEN 1 WHEN regexp_matches(line, '{L.SECOND_LEVEL}') THEN 2 WHEN regexp_matches(line, '{L.THIRD_LEVEL}') THEN 3 ELSE 1 END
  WHEN short AND len(regexp_extract_all(line, '\p{{L}}')) >= 3 AND NOT regexp_matches(line, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') AND NOT regexp_matches(line, '[.?!;]$') THEN 2 END AS level FROM lev)"""
BLOCKS_SQL = rf"""{LINES_SQL},
said AS (SELECT *, plain AND NOT taken AND level IS NULL AS para FROM kinds),
begun AS (SELECT *, sum(CAST(level IS NOT NULL OR (para AND NOT coalesce(before, false)) AS INT)) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block FROM (SELECT *, lag(para) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM said)),
blocks AS (SELECT doc_id, any_value(source) AS source, CAST(block AS INT) AS block, max(level) AS level,
  CASE WHEN max(marks) > 0 AND max(level) IS NOT NULL THEN regexp_extract(max(line), {_q(L.MARKDOWN)}, 2) WHEN max(level) IS NOT NULL THEN max(line) ELSE regexp_replace(string_agg(line, ' ' ORDER BY i), '{L.SPACE}+', ' ', 'g') END AS text,
  'text/page[' || min(page) || ']/' || CASE WHEN min(i) = max(i + CAST(setext AS INT)) THEN 'line[' || min(i) || ']' ELSE 'lines[' || min(i) || '-' || max(i + CAST(setext AS INT)) || ']' END AS locator
  FROM begun WHERE level IS NOT NULL OR para GROUP BY doc_id, block)"""
UNITS_SQL = rf"""{BLOCKS_SQL},
under AS (SELECT *, coalesce(max(CASE WHEN level IS NOT NULL THEN block END) OVER (PARTITION BY doc_id ORDER BY block), -1) AS h FROM blocks),
units AS (SELECT u.doc_id, u.source, u.block, u.text, u.locator, u.h, coalesce(b.text, 'Front Matter') AS title, least(12, greatest(0, coalesce(b.level - 1, 0))) AS section_level, coalesce(b.locator, 'text/front-matter') AS section_locator,
  dense_rank() OVER (PARTITION BY u.doc_id ORDER BY u.h) - 1 AS section, row_number() OVER (PARTITION BY u.doc_id, u.h ORDER BY u.block) - 1 AS unit
  FROM under u LEFT JOIN blocks b ON b.doc_id = u.doc_id AND b.block = u.h WHERE u.level IS NULL)"""
KIND_SQL = f"CASE WHEN regexp_matches(text, {_q(L.TRANSLATOR)}) THEN 'translator_note' WHEN regexp_matches(text, {_q(L.EDITOR)}) THEN 'editor_note' WHEN regexp_matches(title, {_q(L.TRANSLATOR)}) THEN 'translator_note' WHEN regexp_matches(title, {_q(L.EDITOR)}) THEN 'editor_note' WHEN regexp_matches(title, {_q(L.FOOTNOTES)}) THEN 'footnote' WHEN regexp_matches(title, {_q(L.APPENDIX)}) THEN 'appendix' ELSE 'body' END"
ID_SQL = "source || ':{0}:' || substring(sha256('{0}' || chr(10) || source || chr(10) || {1} || chr(10) || {2}), 1, 24)"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "text")


@plans("sc7_text_blocks", f"WITH {BLOCKS_SQL} SELECT doc_id, block, CAST(level AS INT) AS level, locator, sha256(text) AS digest FROM blocks")
def blocks(spark, sf):
    """Headings and paragraphs with page and line locators."""
    return L.text_blocks(docs(spark, sf)).select("doc_id", "block", "level", "locator", F.sha2("text", 256).alias("digest"))


@plans("sc7_text_units", f"WITH {UNITS_SQL} SELECT doc_id, CAST(section AS INT) AS section, CAST(section_level AS INT) AS section_level, {ID_SQL.format('section', 'section_locator', 'title')} AS section_id, CAST(unit AS INT) AS unit, {KIND_SQL} AS unit_type, {ID_SQL.format('unit', 'locator', 'text')} AS unit_id FROM units")
def units(spark, sf):
    """Paragraphs in sections, with ids made of source, locator and text."""
    found = L.text_units(L.text_blocks(docs(spark, sf)))
    return found.select("doc_id", "section", "section_level", L.stable_id(F.col("source"), "section", F.col("section_locator"), F.col("title")).alias("section_id"), "unit", "unit_type", L.stable_id(F.col("source"), "unit", F.col("locator"), F.col("text")).alias("unit_id"))


_N = "len(regexp_extract_all(text, '{}'))"
_ODD = f"level IS NULL AND length(text) >= 40 AND ({_N.format(chr(92) + 'p{L}')} / CAST(len(regexp_extract_all(text, '[^ \\t\\x1f\\p{{Z}}]')) AS DOUBLE) < 0.45 OR {_N.format(L.ODD_SYMBOLS)} >= 4)"
WARNINGS_SQL = rf"""WITH {BLOCKS_SQL},
good AS (SELECT doc_id, source, text, len(list_filter(string_split_regex({_UNIX}, '{L.LINE_ENDS}'), lambda x: regexp_matches(x, '-{L.SPACE}*$') AND length(regexp_replace(x, '^{L.SPACE}+|{L.SPACE}+$', '', 'g')) > 2)) AS hyphens FROM documents WHERE NOT {_BLANK} AND NOT {_MARKUP}),
bare AS (SELECT *, lead(level) OVER (PARTITION BY doc_id ORDER BY block) AS next_level FROM blocks),
counted AS (SELECT doc_id, count_if({_ODD}) AS odd, count_if(level IS NOT NULL AND next_level IS NOT NULL) AS bare, count(level) AS headings FROM bare GROUP BY doc_id)
SELECT doc_id, code, CAST(n AS BIGINT) AS n FROM (
SELECT doc_id, CASE WHEN {_BLANK} THEN 'no_text' ELSE 'html_markup' END AS code, 1 AS n FROM documents WHERE {_BLANK} OR {_MARKUP}
UNION ALL SELECT doc_id, 'ocr_source_requires_visual_review', 1 FROM good WHERE source LIKE '%3'
UNION ALL SELECT doc_id, 'replacement_characters_detected', {_N.format(chr(0xFFFD))} FROM good WHERE contains(text, chr(65533))
UNION ALL SELECT doc_id, 'possible_ocr_line_hyphenation', hyphens FROM good WHERE hyphens >= 3
UNION ALL SELECT doc_id, 'missing_page_markers', 1 FROM kinds WHERE source LIKE '%13' GROUP BY doc_id HAVING count_if(brk OR label IS NOT NULL) = 0
UNION ALL SELECT doc_id, 'possible_ocr_corruption', odd FROM counted WHERE odd > 0
UNION ALL SELECT doc_id, 'heading_without_content', bare FROM counted WHERE bare > 0
UNION ALL SELECT doc_id, 'no_explicit_headings', 1 FROM counted WHERE headings = 0)"""


@plans("sc7_text_warnings", WARNINGS_SQL)
def warnings(spark, sf):
    """What a reviewer should know of a text. Sources whose name ends in 3 stand for read images, in 13 for books."""
    return L.text_warnings(docs(spark, sf), "doc_id", ocr=F.col("source").endswith("3"), scanned=F.col("source").endswith("13"))


QUERIES, SQL = plans.queries, plans.sql

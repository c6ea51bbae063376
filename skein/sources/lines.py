"""Structured and OCR text to blocks, sections and warnings, as windows over the lines of each text.

A line is a page marker, blank, a heading, an underline of the line before it, or part of a paragraph. Paragraphs are
runs of such lines. All windows share one exchange by row and one sort by line, and the blocks are grouped in it as well:
a text crosses the network once, in lines. The largest unit of one task is a text.

Defined results. Rows are told apart by their place in the input, so repeated or missing ids mix no lines. A null, empty
or blank text has no blocks and the warning ``no_text``; one with page markup has no blocks and ``html_markup``. Other
columns of the input are kept as they are, except those that a result itself names (then the result's stands).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns of the format. The classes around a page number run from - to the long dash, so they take
# letters and digits as well.
PAGE = r"(?i)^[\[\(\--—_\s]*(?:page|pg\.?|p\.)\s*([0-9]+|[ivxlcdm]+)[\]\)\--—_\s]*$"
PAGE_CHARACTERS = r"^[\[\(\)\--—_\s]+$"
UNDERLINE = r"^(?:=+|-+)$"
EXPLICIT = r"(?i)^(?:part|book|chapter|section|lecture|discourse|appendix|introduction|preface|foreword|contents|translator(?:'s)?\s+note|editor(?:'s)?\s+note|notes|karika|sutra)(?:$|[^\p{L}\p{N}_].*$)"
FIRST_LEVEL = r"(?i)^(?:part|book)"
SECOND_LEVEL = r"(?i)^(?:chapter|lecture|discourse)"
THIRD_LEVEL = r"(?i)^(?:section|karika|sutra)"
MARKUP = r"(?i)<\s*(?:html|body|head|div|p|article)(?:$|[^\p{L}\p{N}_])"
PAGE_BREAK = "[[PAGE_BREAK]]"
MOST_WORDS, MOST_CHARACTERS = 18, 120
#: Section titles and paragraphs that name their kind.
TRANSLATOR = r"(?i)^\s*translator(?:'s)?\s+note(?:$|[^\p{L}\p{N}_])"
EDITOR = r"(?i)^\s*editor(?:'s)?\s+note(?:$|[^\p{L}\p{N}_])"
FOOTNOTES = r"(?i)^\s*(?:footnotes?|notes)(?:$|[^\p{L}\p{N}_])"
APPENDIX = r"(?i)^\s*appendix(?:$|[^\p{L}\p{N}_])"
ODD_SYMBOLS = "[|¬¦§¤]"

#: White space inside a line, and where lines end once \r\n, \r and \f are replaced.
SPACE = r"[ \t\x1f\p{Z}]"
LINE_ENDS = r"[\n\x0b\x1c-\x1e\x{85}\x{2028}\x{2029}]"
MARKDOWN = rf"^(#{{1,6}}){SPACE}+(.+?){SPACE}*#*{SPACE}*$"
MARKUP_WITHIN = 8_192


def _by_line(begin: int | None = None):
    """The lines of a text, or those up to the present one."""
    lines = Window.partitionBy("_row").orderBy("_i")
    return lines if begin is None else lines.rowsBetween(begin, 0)


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "")


def _unix(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, "\r\n?", "\n"), F.lit("\f"), F.lit(f"\n{PAGE_BREAK}\n"))


def _problem(text: Column) -> Column:
    """Why a text has no blocks, or null."""
    blank = text.isNull() | ~text.rlike(rf"[^\n\r\f\x0b\x1c-\x1e\x{{85}}\t\x1f\p{{Z}}]")
    return F.when(blank, "no_text").when(F.substring(_unix(text), 1, MARKUP_WITHIN).rlike(MARKUP), "html_markup")


def _upper(line: Column) -> Column:
    """At least three letters, all capital, no mark of a sentence at the end."""
    return (F.regexp_count(line, F.lit(r"\p{L}")) >= 3) & ~line.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]") & ~line.rlike("[.?!;]$")


def read_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """The lines of each text with what they are: ``_row``, ``_i`` (from 1), ``line`` and ``kind`` (break, page, blank,
    heading, underline, text), ``level`` of a heading, ``page`` and ``setext``."""
    kept = [c for c in docs.columns if c not in (text, "_row", "_i", "line", "kind", "level", "page", "setext")]
    rows = docs.select(*kept, F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id()).where(_problem(F.col("_text")).isNull())
    lines = rows.select(*kept, "_row", F.posexplode(F.split(_unix(F.col("_text")), LINE_ENDS)).alias("_i", "line"))
    s = F.col("line")
    lines = lines.withColumns({"_i": F.col("_i") + 1, "line": _stripped(s)})
    short = (F.length(s) <= MOST_CHARACTERS) & F.regexp_count(s, F.lit(r"[^ \t\x1f\p{Z}]+")).between(1, MOST_WORDS)
    lines = lines.withColumns(
        {
            "_break": s == PAGE_BREAK,
            "_label": F.when(s.rlike(PAGE_CHARACTERS) & s.rlike(PAGE), F.lower(F.regexp_extract(s, PAGE, 1))),
            "_marks": F.length(F.regexp_extract(s, MARKDOWN, 1)),
            "_line": s.rlike(UNDERLINE),
            "_short": short,
        }
    )
    lines = lines.withColumn("_plain", (s != "") & ~F.col("_break") & F.col("_label").isNull())
    # A line over an underline is a heading and takes it, so in a run of such lines every second one is.
    lines = lines.withColumn("_over", F.col("_plain") & (F.col("_marks") == 0) & F.col("_short") & F.coalesce(F.lead("_line").over(_by_line()), F.lit(False)))
    before_run = F.coalesce(F.max(F.when(~F.col("_over"), F.col("_i"))).over(_by_line(Window.unboundedPreceding)), F.lit(0))
    lines = lines.withColumn("setext", F.col("_over") & ((F.col("_i") - before_run) % 2 == 1))
    breaks = F.count_if("_break").over(_by_line(Window.unboundedPreceding))
    lines = lines.withColumns({"_taken": F.coalesce(F.lag("setext").over(_by_line()), F.lit(False)), "_page": F.when(F.col("_break"), F.concat(F.lit("break-"), breaks.cast("string"))).otherwise(F.col("_label"))})
    explicit = F.when(s.rlike(FIRST_LEVEL), 1).when(s.rlike(SECOND_LEVEL), 2).when(s.rlike(THIRD_LEVEL), 3).otherwise(1)
    marked = F.when(F.col("_marks") > 0, F.col("_marks")).when(F.col("setext"), F.when(F.lead("line").over(_by_line()).startswith("="), 1).otherwise(2))
    level = F.when(F.col("_plain") & ~F.col("_taken"), marked.when(F.col("_short") & s.rlike(EXPLICIT), explicit).when(F.col("_short") & _upper(s), 2))
    lines = lines.withColumn("level", level)
    kind = F.when(F.col("_break"), "break").when(F.col("_label").isNotNull(), "page").when(s == "", "blank").when(F.col("_taken"), "underline").when(F.col("level").isNotNull(), "heading").otherwise("text")
    page = F.coalesce(F.last("_page", ignorenulls=True).over(_by_line(Window.unboundedPreceding)), F.lit("unpaginated"))
    return lines.select(*kept, "_row", "_i", "line", kind.alias("kind"), "level", page.alias("page"), "setext")


def text_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Headings and paragraphs in order: ``block`` (from 0), ``level`` (null for a paragraph), ``text``, ``locator`` and
    the other columns of the input. ``_row`` tells the rows of the input apart."""
    own = ("block", "level", "text", "locator")
    lines = read_lines(docs, text)
    kept = [c for c in lines.columns if c not in ("_row", "_i", "line", "kind", "level", "page", "setext", *own)]
    first = (F.col("kind") == "heading") | ((F.col("kind") == "text") & (F.coalesce(F.lag("kind").over(_by_line()), F.lit("")) != "text"))
    lines = lines.withColumn("block", F.sum(first.cast("int")).over(_by_line(Window.unboundedPreceding)) - 1).where(F.col("kind").isin("heading", "text"))
    held = lines.groupBy("_row", "block").agg(
        *[F.first(c).alias(c) for c in kept],
        F.first("level").alias("level"),
        F.first("page").alias("page"),
        F.min("_i").alias("from"),
        F.max(F.col("_i") + F.col("setext").cast("int")).alias("to"),
        F.array_sort(F.collect_list(F.struct("_i", "line"))).alias("lines"),
        F.max(F.when(F.col("kind") == "heading", F.when(F.col("setext") | ~F.col("line").rlike(MARKDOWN), F.col("line")).otherwise(F.regexp_extract("line", MARKDOWN, 2)))).alias("title"),
    )
    joined = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["line"]), " "), f"{SPACE}+", " ")
    place = F.when(F.col("from") == F.col("to"), F.format_string("line[%d]", "from")).otherwise(F.format_string("lines[%d-%d]", "from", "to"))
    return held.select(*kept, "_row", "block", "level", F.coalesce("title", joined).alias("text"), F.concat(F.lit("text/page["), "page", F.lit("]/"), place).alias("locator"))


def text_units(blocks: DataFrame, default: Column | None = None) -> DataFrame:
    """Paragraphs under the heading before them: ``section`` (from 0, only those that have paragraphs), ``title``,
    ``section_level``, ``section_locator``, ``unit`` (from 0 in its section), ``unit_type`` and the columns of
    ``text_blocks``. ``default`` is the kind of a paragraph whose section and text name none (body)."""
    in_order = Window.partitionBy("_row").orderBy("block")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("level").isNotNull()
    last = lambda c: F.last(F.when(heading, c), ignorenulls=True).over(so_far)
    rows = blocks.withColumns(
        {
            "title": F.coalesce(last(F.col("text")), F.lit("Front Matter")),
            "section_level": F.greatest(F.lit(0), F.least(F.lit(12), F.coalesce(last(F.col("level") - 1), F.lit(0)))),
            "section_locator": F.coalesce(last(F.col("locator")), F.lit("text/front-matter")),
            "_heading": F.coalesce(F.max(F.when(heading, F.col("block"))).over(so_far), F.lit(-1)),
        }
    ).where(~heading)
    by_section = Window.partitionBy("_row").orderBy("_heading")
    of_title = F.when(F.col("title").rlike(TRANSLATOR), "translator_note").when(F.col("title").rlike(EDITOR), "editor_note").when(F.col("title").rlike(FOOTNOTES), "footnote").when(F.col("title").rlike(APPENDIX), "appendix").otherwise(F.lit("body") if default is None else default)
    kind = F.when(F.col("text").rlike(TRANSLATOR), "translator_note").when(F.col("text").rlike(EDITOR), "editor_note").otherwise(of_title)
    unit = F.col("block") - F.min("block").over(Window.partitionBy("_row", "_heading"))
    return rows.withColumns({"section": F.dense_rank().over(by_section) - 1, "unit": unit, "unit_type": kind}).drop("_heading")


def stable_id(source: Column, kind: str, locator: Column, text: Column) -> Column:
    """The source, the kind and the start of a digest of where it stands and what it says."""
    digest = F.sha2(F.concat_ws("\n", F.lit(kind), source, locator, text), 256)
    return F.concat(source, F.lit(f":{kind}:"), F.substring(digest, 1, 24))


def text_warnings(docs: DataFrame, key: str, text: str = "text", ocr: Column | None = None, scanned: Column | None = None) -> DataFrame:
    """``key``, ``code`` and ``n`` (how often). ``ocr`` and ``scanned`` are conditions on rows of ``docs``: its text
    comes from images; from images of a book, which should have page markers. Keys must be unique here."""
    no = F.lit(False)
    docs = docs.select(key, F.col(text).alias("text"), (no if ocr is None else ocr).alias("ocr"), (no if scanned is None else scanned).alias("scanned"))
    good = _problem(F.col("text")).isNull()
    array = F.split(_unix(F.col("text")), LINE_ENDS)
    hyphens = F.size(F.filter(array, lambda x: _stripped(x).endswith("-") & (F.length(_stripped(x)) > 2)))
    replaced = F.regexp_count("text", F.lit(r"\x{FFFD}"))
    one = lambda code, n, when: F.struct(F.lit(code).alias("code"), F.when(when, n.cast("bigint")).alias("n"))
    problem = F.struct(_problem(F.col("text")).alias("code"), F.when(~good, F.lit(1)).cast("bigint").alias("n"))
    whole = F.array(problem, one("ocr_source_requires_visual_review", F.lit(1), good & F.col("ocr")), one("replacement_characters_detected", replaced, good & (replaced > 0)), one("possible_ocr_line_hyphenation", hyphens, good & (hyphens >= 3)))
    of_text = docs.select(key, F.inline(F.filter(whole, lambda x: x["n"].isNotNull())))

    pages = read_lines(docs.select(key, "text", "scanned")).groupBy("_row").agg(F.first(key).alias(key), F.first("scanned").alias("scanned"), F.count_if(F.col("kind").isin("break", "page")).alias("pages"))
    of_pages = pages.where(F.col("scanned") & (F.col("pages") == 0)).select(key, F.lit("missing_page_markers").alias("code"), F.lit(1).cast("bigint").alias("n"))

    blocks = text_blocks(docs.select(key, "text"))
    t, heading = F.col("text"), F.col("level").isNotNull()
    visible = F.regexp_count(t, F.lit(r"[^ \t\x1f\p{Z}]"))
    odd = (F.length(t) >= 40) & ((F.regexp_count(t, F.lit(r"\p{L}")) / visible.cast("double") < 0.45) | (F.regexp_count(t, F.lit(ODD_SYMBOLS)) >= 4))
    followed = F.lead(heading).over(Window.partitionBy("_row").orderBy("block"))
    counted = blocks.withColumn("_bare", heading & F.coalesce(followed, F.lit(False))).groupBy("_row").agg(F.first(key).alias(key), F.count_if(~heading & odd).alias("odd"), F.count_if("_bare").alias("bare"), F.count_if(heading).alias("headings"))
    found = F.array(one("possible_ocr_corruption", F.col("odd"), F.col("odd") > 0), one("heading_without_content", F.col("bare"), F.col("bare") > 0), one("no_explicit_headings", F.lit(1), F.col("headings") == 0))
    of_blocks = counted.select(key, F.inline(F.filter(found, lambda x: x["n"].isNotNull())))
    return of_text.unionByName(of_pages).unionByName(of_blocks)

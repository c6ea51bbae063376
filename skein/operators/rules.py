"""Rule tables folded into column expressions, and operators on lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matching(rules: Iterable, condition: Callable, name: Callable) -> Column:
    """The names of the rules whose condition holds, as one array: texts are scanned in place, no rows are multiplied
    before it is known what matched."""
    return F.filter(F.array(*[F.when(condition(r), F.lit(name(r))) for r in rules]), lambda x: x.isNotNull())


def first_rule(path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The value of the first rule whose glob the path matches; * stands for anything."""
    out = None
    for glob, value in rules:
        like = path.like("".join("%" if c == "*" else "\\" + c if c in "%_\\" else c for c in glob.replace("[*]", "[\0]")).replace("\0", "*"))
        out = F.when(like, value) if out is None else out.when(like, value)
    return out


def between(text: Column, start: str, end: str) -> Column:
    """What lies between the first ``start`` and the first ``end``; the whole text if either is missing."""
    a, b = F.instr(text, start), F.instr(text, end)
    return F.when((a > 0) & (b > 0), F.substring(text, a + len(start), b - a - len(start))).otherwise(text)


def boundary_line(line: Column) -> Column:
    """A line fit to be counted as a running header: 8 to 140 characters, not digits alone; else empty."""
    flat = F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))
    return F.when(F.length(flat).between(8, 140) & ~flat.rlike("^[0-9]+$"), flat).otherwise("")


def enumeration(items: Column) -> Column:
    """a / a and b / a, b and c."""
    head = F.array_join(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(1))), ", ")
    return F.when(F.size(items) < 2, F.array_join(items, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def structure_action(flags: Mapping[str, Column]) -> Column:
    """The proposed action by priority; flags that are not given count as false."""
    of = lambda *names: _any(flags.get(n, F.lit(False)) for n in names)
    return (
        F.when(of("front_matter", "index_section", "references_section", "appendix_section"), "exclude_candidate")
        .when(of("ocr_heavy", "repeated_header_or_footer"), "source_specific_preprocessing")
        .when(of("verse_range_rule_candidate"), "manual_range_annotation")
        .when(of("large_unstructured_section", "missing_heading", "generic_heading"), "manual_section_review")
        .otherwise("structure_usable")
    )


def _any(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def sections(lines: DataFrame, heading: Column) -> DataFrame:
    """doc_id, section, first_line, last_line, chars from lines (doc_id, i, line). A document's lines meet in one task."""
    numbered = lines.withColumn("section", F.sum(heading.cast("int")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "section").agg(F.min("i").cast("bigint").alias("first_line"), F.max("i").cast("bigint").alias("last_line"), F.sum(F.length("line")).alias("chars"))

"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are runs of anything but space and the characters 9 to 13. All counts are over the whole text. Repetition inside
a text is found by sorting the hashes of its three-word windows, so a text of n words costs n log n.

The rule on stop words has lists of four languages: it judges texts that declare one of these or none, and passes others.

Defined results. Null or empty text: no words, so rejected. Lines without a word count nowhere. Repeated rows are
judged each on their own. An empty table gives an empty result. Two windows are the same if their 64-bit hashes are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.tables import table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of four languages; a text of any of them has some.
STOP_LANGUAGES = ("en", "fr", "de", "es")
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are at from",
    "le la les de des et un une que qui en est du pour dans au pas avec sur elle",
    "der die das und ist nicht mit von zu den ein eine sich auf auch es dem für im aus",
    "el los las del que y en un una es por con para se no su lo al como más",
)


@dataclass(frozen=True)
class Rule:
    """A text fails if ``measure`` (SQL over the counted columns) is under ``least`` or over ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The production thresholds. Ratios are divided by at least one, so that no rule meets a division by zero.
RULES = (
    Rule("length", "n_words", least=50),
    Rule("repetition", "100 * n_repeat_words / greatest(n_words, 1)", most=50),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", most=0.5),
    Rule("stop_words", "CASE WHEN stop_language THEN n_stop_words / greatest(n_words, 1) ELSE 1 END", least=0.02),
    Rule("word_length", "word_chars / greatest(n_words, 1)", least=2, most=16),
    Rule("lines", "n_dup_lines / greatest(n_lines, 1)", most=0.5),
)


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One expression for the names of the rules that a row fails, in the table's order."""
    failed = [F.when(F.expr(" OR ".join(x for x in (r.least is not None and f"({r.measure}) < {r.least}D", r.most is not None and f"({r.measure}) > {r.most}D") if x)), F.lit(r.name)) for r in rules]
    return F.filter(F.array(*failed), lambda x: x.isNotNull())


def all_stop_words() -> list[str]:
    words = sorted({w for line in STOP_WORDS for w in line.split()})
    return [*words, *(w.title() for w in words)]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), lang_col: str = "lang") -> DataFrame:
    """doc_id, the carried columns and the counts that rules can use. Rows need not have a language."""
    language = F.coalesce(F.col(lang_col).isin(*STOP_LANGUAGES), F.lit(True)) if lang_col in docs.columns else F.lit(True)
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), language.alias("stop_language"), *carry)
    kept = ("doc_id", "stop_language", *carry)
    words = text.select(*kept, "_text", F.filter(F.split("_text", SPACE), lambda w: w != "").alias("_words"), F.filter(F.split("_text", "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "").alias("_lines"))
    counted = words.select(
        *kept,
        F.size("_words").alias("n_words"),
        F.length(F.array_join("_words", "")).alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).alias("n_symbols"),
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(*all_stop_words()))).alias("n_stop_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    # Hashes of windows of three words, each with its place, sorted: equal ones become neighbours.
    windows = counted.select(
        *(c for c in counted.columns if c != "_hashes"),
        F.sort_array(
            F.transform(F.slice("_hashes", 1, F.greatest(F.size("_hashes") - 2, F.lit(0))), lambda h, i: F.struct(F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2)).alias("h"), i.alias("i")))
        ).alias("_sorted"),
    )
    repeated = F.filter("_sorted", lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"]) | (x["h"] == F.get("_sorted", k + 1)["h"]))
    at = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    # Windows overlap: each adds the words that the one before it has not covered.
    covered = F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")))["n"]
    counts = [*(F.col(c).alias(c) for c in windows.columns if c not in (*kept, "_sorted")), covered.alias("n_repeat_words")]
    # A filter on the counts stays above a generator. Below, it would compute the sorted windows anew for each of them.
    return windows.select(*kept, F.inline(F.array(F.struct(*counts))))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The counts with base_failed, failed (names of rules) and kept. ``base_failed`` always rejects."""
    longs = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")
    counted = measure(docs, id_col, text_col, carry)
    counted = counted.select(*(F.col(c).cast("bigint").alias(c) if c in longs else F.col(c) for c in counted.columns))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select("*", base.alias("base_failed"), compile_rules(rules).alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def _sql(rules: tuple[Rule, ...]) -> str:
    failed = ", ".join(f"CASE WHEN {' OR '.join(x for x in (r.least is not None and f'({r.measure}) < {r.least}', r.most is not None and f'({r.measure}) > {r.most}') if x)} THEN '{r.name}' END" for r in rules)
    stops = ", ".join(f"'{w}'" for w in all_stop_words())
    blank = " || ".join(f"chr({k})" for k in (32, 9, 10, 11, 12, 13))
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, coalesce(lang IN ({", ".join(f"'{x}'" for x in STOP_LANGUAGES)}), true) AS stop_language FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '{SPACE}'), lambda s: s <> '') AS words, list_filter(string_split(x, chr(10)), lambda s: trim(s, {blank}) <> '') AS lines FROM t),
p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM again) GROUP BY r),
c AS (SELECT doc_id, stop_language, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda s: length(s))), 0) AS BIGINT) AS word_chars,
  CAST(length(x) - length(regexp_replace(x, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(words, lambda s: list_contains([{stops}], s))) AS BIGINT) AS n_stop_words, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN repeats USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, array_to_string(list_filter([{failed}], lambda s: s IS NOT NULL), ',') AS failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM f"""


OP5_SQL = _sql(RULES)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects."""
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    return judge(docs, carry=columns[1:]).where("kept").select(*columns)

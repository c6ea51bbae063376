"""Column builders for text: normalisers, token counters, lexical scores, quality measures.

The normalisers differ on purpose and are not shared. Regular expressions name Unicode classes outright, as ``\\w`` of
Java knows ASCII only; lower-casing stands for case folding (they differ for ß and few other letters).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]"
GAP = r"[^\p{L}\p{N}_]"


def collapse(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


@F.pandas_udf(StringType())
def strip_marks(text: pd.Series) -> pd.Series:
    """NFKD without combining marks, folded, without apostrophes; anything but word characters and hyphens is a space."""
    import re

    def one(t):
        if t is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s-]", " ", re.sub(r"['’ʼ]", "", plain))).strip()

    return text.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def compose_terms(text: pd.Series) -> pd.Series:
    """NFKC, folded; runs of anything but word characters are a space."""
    import re

    return text.map(lambda t: re.sub(r"[^\w]+", " ", unicodedata.normalize("NFKC", t).casefold()).strip(), na_action="ignore")


@F.pandas_udf(StringType())
def search_text(text: pd.Series) -> pd.Series:
    """NFKD without combining marks, folded, without apostrophes; runs of anything but word characters are a space."""
    import re

    def one(t):
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()
        return re.sub(r"[^\w]+", " ", re.sub(r"['’ʼ]", "", plain)).strip()

    return text.map(one, na_action="ignore")


def simple_terms(text: Column) -> Column:
    """The native stand-in for texts that are composed already: lower case, runs of non-word characters as a space."""
    return F.trim(F.regexp_replace(F.lower(text), GAP + "+", " "))


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens of ASCII letters and digits, which one apostrophe or hyphen may join."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?"), F.lit(0)), F.lower))


def term_set(text: Column) -> Column:
    """Distinct words of two characters and more."""
    return F.array_distinct(F.filter(F.split(simple_terms(text), " "), lambda w: F.length(w) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def count_tokens(text: Column) -> Column:
    """Words, and each other visible character."""
    return F.regexp_count(text, F.lit(WORD + r"+|[^\p{L}\p{N}_\s]"))


def budget_tokens(text: Column) -> Column:
    """1.3 tokens a word, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.size(words(text)) * F.lit(1.3))).cast("bigint")


def batch_tokens(text: Column) -> Column:
    """A token for three characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(3.0))).cast("bigint")


def whole_term(text: Column, term: str) -> Column:
    """Whether the term occurs with no word character beside it; its spaces match any white space."""
    import re

    inner = r"\s+".join(re.escape(w) for w in term.split())
    return text.rlike(f"(?i)(^|{GAP}){inner}($|{GAP})")


def hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur as substrings."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def lexical_score(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """min(1, p / 3) - min(1, n / 2) / 2 for p and n substring hits, within 0..1."""
    raw = F.least(F.lit(1.0), hits(text, positive) / F.lit(3.0)) - 0.5 * F.least(F.lit(1.0), hits(text, negative) / F.lit(2.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def layout(text: Column) -> Column:
    """Line ends as \\n, runs of horizontal space as one, three or more line ends as two, trimmed."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[ \t\f\x0B]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    """Split after . ! ? where a capital, digit or quote follows the space."""
    return F.split(text, r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}\"'(])")


def sample(text: Column, most: int = 400) -> Column:
    """Collapsed white space; beyond ``most`` characters cut, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-")


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1), whole).cast("double")


def quality_counts(text: Column) -> dict[str, Column]:
    """What the ratios of ``quality`` are made of, each counted once. Tokens with two kinds of letters, or letters and
    digits, are counted in the text itself: a match begins where a token does."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    both = lambda x, y: count(rf"(?<!\S)(?:(?=\S*{x})(?=\S*{y}))\S+")
    return {
        "visible": count(r"\S"),
        "tokens": count(r"\S+"),
        "letters": count(r"\p{L}"),
        "digits": count(r"\p{Nd}"),
        "symbols": count(r"[^\p{L}\p{N}\s]"),
        "single": count(rf"(?<!\S)(?:{GAP}(?<!\s))*[\p{{L}}\p{{N}}_](?:{GAP}(?<!\s))*(?!\S)"),
        "mixed": both(r"\p{IsLatin}", r"\p{IsDevanagari}"),
        "intrusions": both(r"\p{L}", r"\p{Nd}"),
        "replaced": count("[\\x{FFFD}□■]"),
    }


def quality(least_alphabetic: float) -> dict[str, Column]:
    """Ratios over visible characters and tokens, and their weighted noise score, from the columns of
    ``quality_counts``."""
    of = lambda part, whole: ratio(F.col(part), F.col(whole))
    out = {
        "alphabetic_ratio": of("letters", "visible"),
        "digit_ratio": of("digits", "visible"),
        "symbol_ratio": of("symbols", "visible"),
        "single_ratio": of("single", "tokens"),
        "mixed_ratio": of("mixed", "tokens"),
        "intrusion_ratio": of("intrusions", "tokens"),
        "replacement_ratio": of("replaced", "visible"),
    }
    # The weights of the noise score.
    noise = 0.20 * out["symbol_ratio"] + 0.20 * out["digit_ratio"] + 0.15 * out["single_ratio"] + 0.25 * out["mixed_ratio"] + 0.25 * out["intrusion_ratio"] + 0.75 * out["replacement_ratio"] + 1.50 * F.greatest(F.lit(0.0), least_alphabetic - out["alphabetic_ratio"])
    return out | {"noise": F.least(F.lit(1.0), noise)}


def structure_noise(text: Column) -> Column:
    """The noise score of structure reports: replacement characters, odd runs, split hyphens, repeated punctuation,
    unprintable characters and too few letters. An empty text scores 1."""
    n = F.length(text).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    # Weights and caps.
    odd = F.least(0.003 * count(r"[^A-Za-z0-9\s.,;:'\"!?()\-\x{0900}-\x{097F}]{3,}"), F.lit(0.03))
    hyphens = F.least(0.002 * count(r"[A-Za-z]-\s*\n\s*[A-Za-z]"), F.lit(0.02))
    repeated = F.least(0.004 * count(r"([^\p{L}\p{N}_\s])\1{3,}"), F.lit(0.02))
    printable = (n - count(r"[\p{C}\p{Z}&&[^ \n\t]]")) / n
    alphabetic = count(r"\p{L}") / count(r"\S").cast("double")
    score = 8.0 * count(r"\x{FFFD}") / n + odd + hyphens + repeated + F.when(printable < 0.98, 0.98 - printable).otherwise(0.0) + F.coalesce(F.when(alphabetic < 0.45, 0.1 * (0.45 - alphabetic)), F.lit(0.0))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))

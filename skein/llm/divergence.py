"""Source divergence audit: how the sources of a language differ in the terms they use.

Of each pair of sources the distinct combinations of (count here, count there) are tallied with how many terms have
them, the implied cells with a zero among them, and the divergence is evaluated once a combination, times its terms.

* A term is a run of ASCII letters and characters beyond ASCII; only A-Z are lower-cased. A language keeps the terms of
  at least ``LEAST`` of its documents. Rows are documents: repeated rows and ids count as often as they are there.
* Null text, lang and source are ''. A document without terms still makes its group occur. An empty table gives no row,
  a language that keeps no term gives pairs of value 0. Other columns are not read.
* Shares are whole numbers, parts of ``SCALE`` with one added to each count; products go through decimals.

Counting needs one pass: a task adds up its counts by group and term and sends them on when it holds ``HELD`` of them,
so a hot group comes as a few partial sums a task. Then work is by (language, term), with a row a source. Pairs of
sources are the result, one row each; no pair is made of documents.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.arrow import map_rows
from skein.sources.scratch import cut
from skein.sources.tables import table

LEAST = 3
SCALE = 1_000_000_000
TOP = 200
#: Counts that a task holds before it sends them on.
HELD = 200_000
#: A byte of a term as it is (A-Z in lower case), all others a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class _Counts:
    """lang, source, term, n (occurrences), docs (documents with it); a row without a term for each group."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def __call__(self, columns: dict[str, list]) -> dict[str, list] | None:
        for lang, source, text in zip(columns["lang"], columns["source"], columns["text"], strict=True):
            total, docs = self.groups.setdefault((lang, source), (Counter(), Counter()))
            terms = text.translate(_TERMS).split()
            total.update(terms)
            docs.update(set(terms))
        return self.finish() if sum(len(total) for total, _ in self.groups.values()) > HELD else None

    def finish(self) -> dict[str, list]:
        out: dict[str, list] = {"lang": [], "source": [], "term": [], "n": [], "docs": []}
        for (lang, source), (total, docs) in self.groups.items():
            size = len(total) + 1
            out["lang"] += [lang] * size
            out["source"] += [source] * size
            out["term"] += [None, *total]
            out["n"] += [0, *total.values()]
            out["docs"] += [0, *map(docs.__getitem__, total)]
        self.groups = {}
        return out


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: one row a group and term, and one with a null term for each group."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = map_rows(texts, _Counts, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str) -> Column:
    """Its share of all kept terms, in parts of SCALE, with one added to each count."""
    return F.expr(f"1 + ({SCALE}BD * ({n} + 1)) div ({total} + {terms})")


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def tallies(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, ca, cb, m: of each pair of sources a < b of a language, how many kept terms occur ca times in a and
    cb times in b. ``cells`` (lang, source, term, n) has the counts above zero; the cells with a zero are implied: what
    the counts of one source alone leave when those in common are taken away."""
    one = cells.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("ca"))
    two = cells.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("cb"))
    joint = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "ca", "cb").agg(F.count("*").alias("m"))
    both = joint.selectExpr("lang", "a", "b", "stack(4, ca, cb, m, ca, 0L, -m, 0L, cb, -m, 0L, 0L, m) AS (ca, cb, m)")
    alone = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    pairs = _pairs(groups)
    here = pairs.select("lang", "a", "b").join(alone.withColumnsRenamed({"source": "a", "n": "ca"}), ["lang", "a"]).selectExpr("lang", "a", "b", "ca", "0L cb", "m")
    there = pairs.select("lang", "a", "b").join(alone.withColumnsRenamed({"source": "b", "n": "cb"}), ["lang", "b"]).selectExpr("lang", "a", "b", "0L ca", "cb", "m")
    neither = pairs.selectExpr("lang", "a", "b", "0L ca", "0L cb", "terms - of_a.terms - of_b.terms m")
    every = both.unionByName(here).unionByName(there).unionByName(neither)
    return every.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m <> 0")


def _pairs(groups: DataFrame) -> DataFrame:
    sides = [groups.select("lang", *(["terms"] if side == "a" else []), F.col("source").alias(side), F.struct(F.col("total"), F.col("own").alias("terms")).alias(f"of_{side}")) for side in "ab"]
    return sides[0].join(sides[1], "lang").where("a < b")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the divergence of the source from each other source of the
    language, all ranks. Part ``term``: the terms it uses more than its language does, the first ``TOP``."""
    counted = cut(counts(docs))
    kept = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST)
    cells = cut(counted.join(kept.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "of_lang"))
    langs = cells.groupBy("lang", "term").agg(F.first("of_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    own = cells.groupBy("lang", "source").agg(F.count("*").alias("own"), F.sum("n").alias("total"))
    groups = cut(counted.select("lang", "source").distinct().join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0))

    tally = tallies(cells.select("lang", "source", "term", "n"), groups)
    pairs = _pairs(groups)
    shares = tally.join(pairs.select("lang", "a", "b", "terms", F.col("of_a.total").alias("na"), F.col("of_b.total").alias("nb")), ["lang", "a", "b"])
    shares = shares.withColumns({"p": _share("ca", "na", "terms"), "q": _share("cb", "nb", "terms")})
    summed = [F.sum(_divergence(*way).cast("decimal(20,0)") * F.col("m").cast("decimal(18,0)")).cast("long").alias(name) for name, way in (("ab", ("p", "q")), ("ba", ("q", "p")))]
    values = pairs.select("lang", "a", "b").join(shares.groupBy("lang", "a", "b").agg(*summed), ["lang", "a", "b"], "left").na.fill(0, ["ab", "ba"])
    pair = values.selectExpr("lang", "stack(2, a, b, ab, b, a, ba) AS (source, item, value)").withColumn("part", F.lit("pair"))

    terms = cells.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total", "terms"), "q": _share("of_lang", "lang_total", "terms")}).where("p > q")
    term = terms.select("lang", "source", F.col("term").alias("item"), _divergence("p", "q").alias("value"), F.lit("term").alias("part"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked)
    out = pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= TOP))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH words AS (
  SELECT coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') terms
  FROM documents
), spread AS (SELECT lang, source, unnest(terms) term FROM words
), seen AS (SELECT lang, unnest(list_distinct(terms)) term FROM words
), kept AS (SELECT lang, term FROM seen GROUP BY lang, term HAVING count(*) >= 3
), sizes AS (SELECT lang, count(*) v FROM kept GROUP BY lang
), occurring AS (SELECT DISTINCT lang, source FROM words
), counted AS (SELECT lang, source, term, count(*) n FROM spread SEMI JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT lang, source, term, coalesce(n, 0)::HUGEINT n FROM (SELECT lang, source, term FROM occurring JOIN kept USING (lang)) LEFT JOIN counted USING (lang, source, term)
), own AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) p FROM dense JOIN sizes USING (lang)
), of_lang AS (
  SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) q FROM (SELECT lang, term, sum(n) n FROM dense GROUP BY ALL) JOIN sizes USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) f FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::BIGINT AS "value"
  FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM own JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY "value" DESC, item))::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, "value", rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

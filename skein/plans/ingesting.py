"""Parsing, chunking and rendering over the tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from skein.operators import chunking
from skein.plans import evidence as E
from skein.plans.registry import Plans
from skein.sources import files, parsers
from skein.sources.scratch import scratch_folder
from skein.sources.tables import table

plans = Plans()


@plans("sc5_html_blocks")
def sc5(spark, sf):
    """Blocks of pages, without what is skipped."""
    return parsers.parsed(table(spark, sf, "pages"), "html", "page_id", "html")


def articles(spark, sf):
    """Documents as articles: the first line is the title, lines by turns paragraphs of two nested sections."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    lines = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}\p{N}\p{P}\p{Z}\n]", " "), "\n"), lambda x: F.trim(x) != "")
    safe = F.transform(lines, lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    turn = lambda of: F.array_join(F.transform(F.filter("l", of), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    odd, even = turn(lambda _, i: i % 2 == 0), turn(lambda _, i: i % 2 == 1)
    parts = ("<article><front><article-meta><title-group><article-title>", F.get("l", F.lit(0)), "</article-title></title-group></article-meta></front><body><sec><title>One</title>", odd, "<sec><title>Two</title>", even, "</sec></sec></body></article>")
    return docs.select("doc_id", safe.alias("l")).where(F.size("l") > 0).select("doc_id", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("article"))


LINES_OF_ARTICLES_SQL = r"(SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^\p{L}\p{N}\p{P}\p{Z}\n]', ' ', 'g'), chr(10)), lambda x: trim(x) <> '') AS l FROM documents WHERE text IS NOT NULL)"


@plans("sc4_jats_units", f"SELECT doc_id AS id, len(l) + 1 AS units, len(l) - len(l) // 2 AS outer_units, CAST(len(l) // 2 AS BIGINT) AS inner_units, true AS titled FROM {LINES_OF_ARTICLES_SQL} WHERE len(l) > 0")
def sc4(spark, sf):
    """Units of articles by section."""
    found = parsers.parsed(articles(spark, sf), "jats", "doc_id", "article")
    return found.groupBy("id").agg(F.count("*").alias("units"), F.count_if(F.col("heading") == "One").alias("outer_units"), F.count_if(F.col("heading") == "Two").alias("inner_units"), F.bool_or(F.col("kind") == "title").alias("titled"))


@plans("sc10_chunker_registry")
def sc10(spark, sf):
    """Each document by the chunker of its domain and type of source."""
    english = F.col("lang") == "en"
    docs = table(spark, sf, "documents").select("doc_id", "text", F.when(english, "science").otherwise("samkhya").alias("domain"), F.when(english, "paper").otherwise("treatise").alias("source_type"))
    return chunking.dispatched(docs)


@plans("sc9_parser_registry", "SELECT doc_id AS id, 'text' AS format, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS n FROM documents UNION ALL SELECT page_id, 'html', NULL FROM pages WHERE false")
def sc9(spark, sf):
    """Each format by its parser; results are united. Every document has a row, also without lines."""
    found = parsers.counted(table(spark, sf, "documents"), "text", "doc_id", "text")
    return found.select("id", F.lit("text").alias("format"), "n")


@plans("sc6_charset")
def sc6(spark, sf):
    """The declared encoding of a page's bytes, and whether decoding by it gives the page back."""

    @F.pandas_udf(StringType())
    def declared(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else parsers.charset(b))

    @F.pandas_udf(StringType())
    def decoded(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else parsers.decode(b, parsers.charset(b)))

    pages = table(spark, sf, "pages").select("page_id", "html", F.encode("html", "utf-8").alias("data"))
    return pages.select("page_id", declared("data").alias("charset"), (decoded("data") == F.col("html")).alias("same"))


@plans("sc8_text_decode")
def sc8(spark, sf):
    @F.pandas_udf(StringType())
    def decoded(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else parsers.decode(b))

    docs = table(spark, sf, "documents").select("doc_id", "text", F.encode("text", "utf-16").alias("data"))
    return docs.select("doc_id", (decoded("data") == F.col("text")).alias("same"))


@plans("g9_scientific_chunks")
def g9(spark, sf):
    return chunking.chunked(table(spark, sf, "documents"), "scientific")


@plans("g10_classical_chunks")
def g10(spark, sf):
    return chunking.chunked(table(spark, sf, "documents"), "classical")


@plans("g11_word_split")
def g11(spark, sf):
    """Every text in pieces of a limited size at word ends, with an overlap."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([(d, k, p) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for k, p in enumerate(chunking.split_words(t or "", 300, 40))], columns=["doc_id", "number", "piece"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, number int, piece string")


@plans("f27_semantic_similarity")
def f27(spark, sf):
    """Half the Jaccard similarity of words, half the ratio of matching blocks, of each text and the next one."""

    @F.pandas_udf(DoubleType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def one(x, y):
            p, q = set(x.lower().split()), set(y.lower().split())
            return 0.5 * (len(p & q) / len(p | q) if p | q else 0.0) + 0.5 * SequenceMatcher(None, x, y).ratio()

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    items = table(spark, sf, "benchmark").where("item_id IS NOT NULL AND text IS NOT NULL")
    nxt = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return items.join(nxt, "item_id").select("item_id", F.round(alike("text", "other"), 6).alias("similarity"))


@plans("sc11_json_lines", "SELECT count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE props IS NOT NULL")
def sc11(spark, sf):
    """Objects from lines of JSON by an explicit schema; a line that is no object is an error."""
    lines = table(spark, sf, "events").where("props IS NOT NULL").select(F.from_json("props", "k bigint", {"mode": "FAILFAST"}).alias("o"))
    return lines.agg(F.count("*").alias("n"), F.sum("o.k").alias("total"))


REQUIRED = ("brand", "name", "size", "type")


@plans("sc12_config_guard", """SELECT p_partkey, array_to_string(list_sort(list_filter(['brand', 'name', 'size', 'type'], lambda f: (f = 'size' AND p_size % 3 = 0) OR (f = 'type' AND p_size % 5 = 0))), ',') AS missing FROM part""")
def sc12(spark, sf):
    """Which required fields each configuration lacks."""
    part = table(spark, sf, "part")
    config = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("size"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("type")))
    return part.select("p_partkey", F.array_join(files.missing_fields(config, REQUIRED), ",").alias("missing"))


@plans("sc14_atomic_write", "SELECT r_regionkey, r_name FROM region")
def sc14(spark, sf):
    """A table written twice to one place, the second time over the first, and read from there."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    rows = table(spark, sf, "region").select("r_regionkey", "r_name")
    files.write_atomic(rows.limit(1), path)
    files.write_atomic(rows, path)
    return spark.read.schema(rows.schema).json(path)


@plans("sc13_csv_lines", "SELECT p_partkey, p_name || ',' || p_size AS line FROM part")
def sc13(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.to_csv(F.struct("p_name", "p_size")).alias("line"))


@plans("sc18_markdown", f"WITH {E.EVIDENCE_SQL}, b AS (SELECT question, concept, '## ' || concept || chr(10) || string_agg('- ' || order_key || '.' || line, chr(10) ORDER BY order_key, line) AS body FROM ev WHERE claimed GROUP BY question, concept) SELECT question, '# ' || question || chr(10) || string_agg(body, chr(10) ORDER BY concept) AS markdown FROM b GROUP BY question")
def sc18(spark, sf):
    """Sections and items in order, as one text a question."""
    items = E.evidence(spark, sf).where("claimed").groupBy("question", "concept").agg(F.sort_array(F.collect_list(F.struct("order_key", "line"))).alias("r"))
    body = F.concat(F.lit("## "), "concept", F.lit("\n"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["order_key"].cast("string"), F.lit("."), x["line"].cast("string"))), "\n"))
    parts = items.select("question", F.struct("concept", body.alias("b")).alias("p")).groupBy("question").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return parts.select("question", F.concat(F.lit("# "), F.col("question").cast("string"), F.lit("\n"), F.array_join(F.transform("ps", lambda p: p["b"]), "\n")).alias("markdown"))


QUERIES, SQL = plans.queries, plans.sql

"""Language by Bayesian fusion of evidence.

Text likelihood: character n-grams (one to three letters, with word ends) under a multinomial model for each language,
fitted on a bounded sample of labelled documents: of each language the ``SAMPLE`` rows with the least hashes of id and
text, of each of these the first ``SAMPLE_CHARS`` characters. Texts that are judged are scored whole.
Everything else is counted over all rows: how often each language, by text alone, goes with a language declared in the
markup, with a code in the address (a path segment or a country ending), and with each host. Priors are smoothed along
the hierarchy all - registered domain - host, each level with the weight of ``PRIOR_WEIGHT`` rows of the level above.
The posterior is proportional to prior x P(declared | language) x P(code | language) x text likelihood, where a text
counts as at most ``EFFECTIVE`` independent n-grams, as neighbours are not independent.

Defined results. Null or empty text: the other evidence decides. Null or unknown declarations, codes and hosts: no such
evidence. Ties: the first language in alphabetical order. Rows that repeat an id are judged each. Without labelled
documents, the language is null. An empty table gives an empty result. Every label that occurs is a language. The
declared language is the one of the page's first html element, wherever it stands.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.arrow import map_rows
from skein.llm.dom import Node, parse
from skein.llm.wrappers import HOST, content_slots, read_tree
from skein.sources.scratch import cut
from skein.sources.tables import table

SAMPLE = 1000
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 16
EFFECTIVE = 60.0
PRIOR_WEIGHT = 20.0
COUNT_WEIGHT = 1.0
DECLARED = re.compile(r"\s*([a-zA-Z]{2,3})")
CODE = r"^[^?#]*//[^/?#]*/(?:[^?#]*/)?([a-z]{2})(?:[/?#]|$)"


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), bool, 0x110000)


class Grams:
    """Buckets of character n-grams: code points of texts in, buckets of the n-grams at each place out. Everything that
    is not a letter is one mark, the end of a word."""

    def __init__(self) -> None:
        self.letters = _letters()

    def codes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        return np.where(self.letters[codes], codes, np.uint32(0))

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and buckets of all n-grams of codes[1:-1]: one letter; two, of which this is the second; three around a
        letter. The first and the last code are what stands before and after."""
        before, at, after = codes[:-2], codes[1:-1], codes[2:]
        one, two = np.flatnonzero(at != 0), np.flatnonzero((at != 0) | (before != 0))
        a, b, c = (x[one] for x in (before, at, after))
        hashes = [b * np.uint32(0x9E3779B1), before[two] * np.uint32(0x85EBCA6B) + at[two] * np.uint32(0xC2B2AE35) + np.uint32(1), a * np.uint32(0x27D4EB2F) + b * np.uint32(0x165667B1) + c * np.uint32(0xD3A2646D) + np.uint32(2)]
        h = np.concatenate(hashes)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        return np.concatenate([one, two, one]), (h >> np.uint32(16)) & np.uint32(BUCKETS - 1)


def pieces(texts: list[str], grams: Grams, size: int):
    """The texts' n-grams in pieces of at most ``size`` code points: numbers of texts, buckets. A text that is longer
    comes in several pieces, short ones share one."""
    end = np.zeros(1, np.uint32)
    codes: list[np.ndarray] = []
    owners: list[int] = []

    def flush():
        places, buckets = grams(np.concatenate([end, *codes, end]))
        return np.repeat(owners, [len(c) for c in codes])[places], buckets

    for k, text in enumerate(texts):
        own = np.append(grams.codes(text), end)
        if len(own) > size:
            for at in range(0, len(own), size):
                before, after = own[at - 1 : at] if at else end, own[at + size : at + size + 1]
                places, buckets = grams(np.concatenate([before, own[at : at + size], after if len(after) else end]))
                yield np.full(len(places), k), buckets
            continue
        if codes and sum(map(len, codes)) + len(own) > size:
            yield flush()
            codes, owners = [], []
        codes.append(own)
        owners.append(k)
    if codes:
        yield flush()


class Likelihood:
    """log P(text | language) for each language, as of at most EFFECTIVE n-grams."""

    def __init__(self, model: np.ndarray) -> None:
        self.model, self.grams = model, Grams()
        self.size = max(4096, 2_000_000 // max(1, model.shape[1]))

    def __call__(self, texts: list[str]) -> list[list[float]]:
        width = self.model.shape[1]
        totals, counts = np.zeros((len(texts), width)), np.zeros(len(texts))
        for owners, buckets in pieces(texts, self.grams, self.size):
            counts += np.bincount(owners, minlength=len(texts))
            for k in range(width):
                totals[:, k] += np.bincount(owners, self.model[buckets, k], len(texts))
        return (totals * np.minimum(1.0, EFFECTIVE / np.maximum(counts, 1))[:, None]).tolist()


def fit(counts: dict[str, dict[int, float]]) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(n-gram | language) by bucket, from how often each language has each bucket."""
    languages = sorted(counts)
    table = np.full((BUCKETS, len(languages)), 0.5)
    for k, lang in enumerate(languages):
        for bucket, n in counts[lang].items():
            table[bucket, k] += n
    return languages, np.asfortranarray(np.log(table / table.sum(axis=0)).astype(np.float32))


def train(docs: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """The model of the labelled documents: ``sample`` of each language, of each the first ``sample_chars`` characters.

    Two scans whatever the number of languages: one counts the labels, the next keeps the rows with the least hashes
    (about twice as many as wanted, by a share of the range of hashes, then the exact number). The driver gets counts of
    buckets only: BUCKETS rows a language."""
    labelled = docs.select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 2 * sample / n)) for lang, n in sizes.items()], "lang string, share double")
    near = labelled.join(F.broadcast(shares), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) <= F.col("share")).select("lang", "h", F.substring("text", 1, sample_chars).alias("text"))
    rows = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("rank") <= sample).select("lang", "text")

    def make():
        grams = Grams()

        def run(batch):
            found: dict[str, np.ndarray] = {}
            for owners, buckets in pieces(batch["text"], grams, 1 << 20):
                for k in np.unique(owners):
                    own = np.bincount(buckets[owners == k], minlength=BUCKETS)
                    lang = batch["lang"][k]
                    found[lang] = found[lang] + own if lang in found else own
            out: dict[str, list] = {"lang": [], "bucket": [], "n": []}
            for lang, own in found.items():
                at = np.flatnonzero(own)
                out["lang"] += [lang] * len(at)
                out["bucket"] += at.tolist()
                out["n"] += own[at].tolist()
            return out

        return run

    counted = map_rows(rows, make, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[int, float]] = {lang: {} for lang in sizes}
    for batch in counted.toArrow().to_batches():
        for lang, bucket, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[lang][bucket] = n
    return fit(counts)


#: Endings of two labels under which names are registered; a parameter, as the public list changes.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "co.za", "co.in", "co.kr", "com.ar", "com.br", "com.cn", "com.mx", "com.tr")


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: two labels, or three under one of the suffixes."""
    return F.when(F.substring_index(host, ".", -2).isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def page_rows(pages: DataFrame) -> DataFrame:
    """id, host, code, and the markup to be read."""
    url = F.coalesce("url", F.lit(""))
    code = F.lower(F.regexp_extract(url, CODE, 1))
    host = F.lower(F.regexp_extract(url, HOST, 1))
    ending = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return pages.select(F.col("page_id").alias("id"), host.alias("host"), F.when(code != "", F.concat(F.lit("path:"), code)).when(ending != "", F.concat(F.lit("end:"), ending)).alias("code"), F.col("html").alias("raw"))


def _declared(root: Node) -> str | None:
    """The language of the first html element."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "html":
            m = DECLARED.match(node.attributes.get("lang") or node.attributes.get("xml:lang") or "")
            return m and m[1].lower()
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return None


def _page(page: str) -> tuple[str | None, str]:
    """The declared language and the main text."""
    import json

    from skein.llm.wrappers import _restore

    tree = parse(page)
    plain, blocks = read_tree(tree)
    root = _restore(json.loads(plain))
    kept = set(content_slots(root, [-1] * (plain.count("[") // 2 + 1), {}))
    return _declared(tree), "\n".join(text for slot, text, _ in blocks if slot in kept) or "\n".join(text for _, text, _ in blocks)


def evidence(rows: DataFrame, model: np.ndarray, markup: bool) -> DataFrame:
    """id, host, code, declared and the log likelihoods of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def make():
        score = Likelihood(shared.value)

        def run(batch):
            raw = [x or "" for x in batch["raw"]]
            pages = [_page(x) if markup else (None, x) for x in raw]
            return {"id": batch["id"], "host": batch["host"], "code": batch["code"], "declared": [d for d, _ in pages], "scores": score([x for _, x in pages])}

        return run

    return map_rows(rows, make, "id long, host string, code string, declared string, scores array<double>")


def _best(scores: Column) -> Column:
    """Place of the greatest, the first of equals; null if all are equal."""
    return F.when(F.array_max(scores) > F.array_min(scores), F.aggregate(scores, F.struct(F.lit(0).alias("at"), F.lit(0).alias("best"), F.lit(float("-inf")).alias("top")), lambda s, x: F.struct((s["at"] + 1).alias("at"), F.when(x > s["top"], s["at"] + 1).otherwise(s["best"]).alias("best"), F.greatest(s["top"], x).alias("top")))["best"])


def _counts(found: DataFrame, by: str, n: int) -> DataFrame:
    """by, counts: how many rows of each language by text alone."""
    return found.where(f"{by} IS NOT NULL AND best IS NOT NULL").groupBy(by).agg(F.array(*[F.sum((F.col("best") == k + 1).cast("double")) for k in range(n)]).alias("counts"))


def fuse(found: DataFrame, languages: list[str]) -> DataFrame:
    """id, host, code, declared, lang, confidence from evidence."""
    n = len(languages)
    if not n:
        return found.select("id", "host", "code", "declared", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    found = cut(found.withColumn("best", _best(F.col("scores"))).withColumn("domain", domain_of(F.col("host"))))
    every = found.where("best IS NOT NULL").agg(*[F.coalesce(F.sum((F.col("best") == k + 1).cast("double")), F.lit(0.0)).alias(f"c{k}") for k in range(n)]).first()
    totals = [float(x) for x in every]
    overall = F.lit([(x + 1) / (sum(totals) + n) for x in totals])

    def smoothed(counts: Column, above: Column) -> Column:
        return F.transform(F.zip_with(counts, above, lambda c, p: c + PRIOR_WEIGHT * p), lambda x: x / (F.aggregate(counts, F.lit(0.0), lambda s, c: s + c) + PRIOR_WEIGHT))

    domains = _counts(found, "domain", n).select("domain", smoothed(F.col("counts"), overall).alias("p_domain"))
    hosts = cut(_counts(found, "host", n).withColumn("domain", domain_of(F.col("host"))).join(domains, "domain", "left").select("host", smoothed(F.col("counts"), F.coalesce("p_domain", overall)).alias("p_host")))

    def given(by: str) -> DataFrame:
        """log P(value | language), smoothed over the values; values are codes of two or three letters."""
        counts = _counts(found, by, n)
        kinds = counts.count() + 1
        return counts.select(by, F.array(*[F.log((F.get("counts", F.lit(k)) + COUNT_WEIGHT) / F.lit(totals[k] + COUNT_WEIGHT * kinds)) for k in range(n)]).alias(f"l_{by}"))

    none = F.array(*[F.lit(0.0)] * n)
    both = found.join(hosts, "host", "left").join(F.broadcast(given("declared")), "declared", "left").join(F.broadcast(given("code")), "code", "left")
    parts = F.arrays_zip(F.col("scores").alias("s"), F.transform(F.coalesce("p_host", overall), lambda x: F.log(x)).alias("p"), F.coalesce("l_declared", none).alias("d"), F.coalesce("l_code", none).alias("c"))
    logs = both.withColumn("logs", F.transform(parts, lambda x: x["s"] + x["p"] + x["d"] + x["c"]))
    top = F.array_max("logs")
    total = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return logs.select("id", "host", "code", "declared", F.element_at(F.lit(languages), F.expr("array_position(logs, array_max(logs))").cast("int")).alias("lang"), (1 / total).alias("confidence"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, by all kinds of evidence, and every document, by its text and its source's prior."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    languages, model = train(docs)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("host"), F.lit(None).cast("string").alias("code"), F.col("text").alias("raw"))
    of_pages = fuse(evidence(page_rows(table(spark, sf_dir, "pages")), model, True), languages)
    of_docs = fuse(evidence(rows, model, False), languages)
    fields = ("host", "declared", "code", "lang", F.round("confidence", 6).alias("confidence"))
    return of_docs.select(F.col("id").alias("doc_id"), F.lit(None).cast("bigint").alias("page_id"), *fields).unionByName(of_pages.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("id").alias("page_id"), *fields))

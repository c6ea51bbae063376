"""Personal data and what reveals it: information-theoretic sanitisation.

Base spans are e-mail addresses, IP and card and phone numbers, by pattern. Each distinct value is a protected entity e.
Corpus co-occurrence estimates how much a term t near e tells about it: with N documents, df of them with e or t, and
c(e, t) with t within ``NEAR`` terms of e on its line, PMI(e, t) = log(N c(e, t) / (df(e) df(t))) against the
information of the entity itself, log(N / df(e)). Their ratio is the disclosure: 1 if t occurs with e only, 0 if t is
independent of it. A term whose disclosure reaches a threshold, on evidence of at least ``SUPPORT`` different contexts
(so that copies of one text prove nothing), is generalised, above a higher threshold removed, wherever it occurs in the
documents that have e.

Statistics cover all documents. Counts are made in each task before they are shuffled; terms that are no candidates are
kept out of the shuffle by a bitmap of fixed size (128 KiB), which only passes more when it fills.

A generalised term becomes its kind: a name, an acronym or another term, by its letters.

Defined results. Null text: empty. Empty texts have no spans. Ids take no part, so null and repeated ones change
nothing: every row is a document. Base spans may overlap across kinds and are all reported; a term never overlaps a base
span. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.arrow import map_rows
from skein.sources.scratch import cut
from skein.sources.tables import table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match from within a run of digits is one from its start, so only those are tried: linear on any text.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
NEAR = 8
SUPPORT = 2
GENERALISE, REMOVE = 0.6, 0.85
SLOTS = 1 << 20
#: Up to so many disclosing pairs go to every task; beyond, documents are joined with them.
BROADCAST_PAIRS = 200_000


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches, looked for from each @, as no match is without one."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            found.append((start, tail.end()))
            free = tail.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, ends exclusive."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        spans["email"] = _emails(text)
    if DIGIT.search(text):
        spans["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "." in text:
            spans["ip"] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        if "+" in text:
            spans["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _digits(value)}"


def free_terms(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Terms that no base span overlaps: term, start, end. One pass over terms and spans in order."""
    out, taken, k, covered = [], sorted(taken), 0, 0
    for m in TERM.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            covered = max(covered, taken[k][1])
            k += 1
        if covered <= m.start():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def contexts(text: str):
    """For each base span: its entity, the NEAR terms before and after it on its line, and a digest of them in order."""
    spans = base_spans(text)
    taken = [x for own in spans.values() for x in own]
    if not taken:
        return
    terms = free_terms(text, taken)
    starts = [s for _, s, _ in terms]
    for kind, own in spans.items():
        for start, end in own:
            lo = text.rfind("\n", 0, start) + 1
            hi = text.find("\n", end)
            at, after = bisect_left(starts, start), bisect_left(starts, end)
            left = [t for t, s, _ in terms[max(0, at - NEAR) : at] if s >= lo]
            right = [t for t, _, e in terms[after : after + NEAR] if hi < 0 or e <= hi]
            yield entity(kind, text[start:end]), left + right, int.from_bytes(hashlib.blake2b(" ".join([*left, "|", *right]).encode(), digest_size=8).digest(), "big", signed=True)


def _found(docs: DataFrame) -> DataFrame:
    """Of each document its entities and their different contexts: node (hash of the text), entity, whether it is the
    first context of the entity, terms near it and whether each is new for the entity, digest of the context."""

    def make():
        def run(rows):
            out: dict[str, list] = {"node": [], "entity": [], "first": [], "terms": [], "fresh": [], "context": []}
            for node, text in zip(rows["node"], rows["text"], strict=True):
                known: dict[str, set] = {}
                seen = set()
                for e, terms, digest in contexts(text or ""):
                    if (e, digest) in seen:
                        continue
                    seen.add((e, digest))
                    first = e not in known
                    before = known.setdefault(e, set())
                    own = sorted(set(terms))
                    for column, value in zip(out.values(), (node, e, first, own, [t not in before for t in own], digest), strict=True):
                        column.append(value)
                    before.update(own)
            return out

        return run

    return map_rows(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text"), make, "node long, entity string, first boolean, terms array<string>, fresh array<boolean>, context long")


class _Counts:
    """In how many documents each candidate term occurs; flushed before it grows large."""

    LIMIT = 300_000

    def __init__(self, bitmap: bytes) -> None:
        self.bitmap, self.counts = bitmap, Counter()

    def __call__(self, rows):
        for text in rows["text"]:
            if text:
                self.counts.update(set(TERM.findall(text.lower())))
        return self.finish() if len(self.counts) > self.LIMIT else None

    def finish(self):
        kept = [(t, n) for t, n in self.counts.items() if self.bitmap[(h := zlib.crc32(t.encode()) % SLOTS) >> 3] >> (h & 7) & 1]
        self.counts.clear()
        return {"term": [t for t, _ in kept], "n": [n for _, n in kept]}


def disclosures(docs: DataFrame, found: DataFrame, threshold: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """entity, term, disclosure for all pairs that reach the threshold."""
    spark = docs.sparkSession
    total = docs.count()
    entities = found.groupBy("entity").agg(F.sum(F.col("first").cast("long")).alias("df_e"))
    near = found.select("entity", "context", F.explode(F.arrays_zip("terms", "fresh")).alias("t")).select("entity", "context", F.col("t.terms").alias("term"), F.col("t.fresh").cast("long").alias("fresh"))
    pairs = cut(near.groupBy("entity", "term").agg(F.count_distinct("context").alias("n_contexts"), F.sum("fresh").alias("c")).where(F.col("n_contexts") >= support))
    # At most SLOTS / 32 rows, whatever the number of candidates.
    slots = pairs.select(F.expr(f"CAST(crc32(encode(term, 'utf-8')) % {SLOTS} AS INT)").alias("slot"))
    words = slots.groupBy(F.expr("slot DIV 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, slot % 32))").alias("bits")).collect()
    bitmap = bytearray(SLOTS // 8)
    for r in words:
        bitmap[4 * r["w"] : 4 * r["w"] + 4] = r["bits"].to_bytes(4, "little")
    shared = spark.sparkContext.broadcast(bytes(bitmap))
    counts = map_rows(docs.select("text"), lambda: _Counts(shared.value), "term string, n long").groupBy("term").agg(F.sum("n").alias("df_t"))
    ratio = F.log(F.lit(float(total)) * F.col("c") / (F.col("df_e") * F.col("df_t"))) / F.log(F.lit(float(total)) / F.col("df_e"))
    return pairs.join(entities, "entity").join(counts, "term").where(F.col("df_e") < total).select("entity", "term", ratio.alias("disclosure")).where(F.col("disclosure") >= threshold)


def _per_text(text: str, reveals) -> tuple[dict, list[tuple[int, int, float]]]:
    """Base spans, and the spans of terms with their disclosure. ``reveals``: from an entity to its terms."""
    spans = base_spans(text)
    terms: dict[str, float] = {}
    for kind, own in spans.items():
        for s, e in own:
            for t, x in reveals(entity(kind, text[s:e])):
                terms[t] = max(x, terms.get(t, 0))
    if not terms:
        return spans, []
    taken = [x for own in spans.values() for x in own]
    return spans, [(s, e, terms[t]) for t, s, e in free_terms(text, taken) if t in terms]


def general(term: str) -> str:
    """What a generalised term becomes."""
    return "[ACRONYM]" if term.isupper() else "[NAME]" if term[0].isupper() else "[TERM]"


def _sanitise(text: str, spans: dict, more: list[tuple[int, int, float]], remove: float) -> str:
    edits = sorted([(s, e, f"[{k.upper()}]") for k, own in spans.items() for s, e in own] + [(s, e, "" if x >= remove else general(text[s:e])) for s, e, x in more])
    out, at = [], 0
    for s, e, by in edits:
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sanitise(docs: DataFrame, threshold: float = GENERALISE, remove: float = REMOVE, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, counts and digests of spans, spans and, if asked for, the sanitised text; string columns to carry.

    Rules that fit a checked bound are sent to every task and texts are not shuffled; otherwise texts are joined with
    theirs, with the same result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", *carry)
    found = cut(_found(docs))
    rules = cut(disclosures(docs, found, threshold))
    held = rules.count()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long" + ", text string" * with_text + "".join(f", {c} string" for c in carry)

    def results(rows, reveals):
        doc_ids, texts = rows["doc_id"], rows["text"]
        out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        for k, (doc_id, text) in enumerate(zip(doc_ids, texts, strict=True)):
            text = text or ""
            spans, more = _per_text(text, reveals(k))
            base = [(kind, s, e) for kind in KINDS for s, e in spans[kind]]
            values = [doc_id, *(len(spans[kind]) for kind in KINDS), hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(base + [("term", s, e) for s, e, _ in more]), len(more)]
            for c, v in zip(out, [*values, *([_sanitise(text, spans, more, remove)] if with_text else []), *(rows[c][k] for c in carry)], strict=True):
                out[c].append(v)
        return out

    if held <= BROADCAST_PAIRS:
        by_entity: dict[str, list] = {}
        for r in rules.toLocalIterator():
            by_entity.setdefault(r["entity"], []).append((r["term"], r["disclosure"]))
        shared = spark.sparkContext.broadcast(by_entity)

        def make():
            reveals = shared.value
            return lambda rows: results(rows, lambda _: lambda e: reveals.get(e, ()))

        return map_rows(docs, make, schema)

    # The same rules by text: equal texts have the same entities.
    own = found.select("node", "entity").distinct().join(rules, "entity").groupBy("node").agg(F.collect_list(F.struct("entity", "term", "disclosure")).alias("rules"))
    joined = docs.withColumn("node", F.xxhash64(F.coalesce("text", F.lit("")))).join(own, "node", "left")

    def make_joined():
        def run(rows):
            def reveals(k):
                by: dict[str, list] = {}
                for r in rows["rules"][k] or ():
                    by.setdefault(r["entity"], []).append((r["term"], r["disclosure"]))
                return lambda e: by.get(e, ())

            return results(rows, reveals)

        return run

    return map_rows(joined, make_joined, schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents"), with_text=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with sanitised texts."""
    clean = sanitise(docs, carry=("lang", "source"))
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))

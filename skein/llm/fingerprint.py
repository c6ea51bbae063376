"""Document fingerprints: a homomorphic multiset hash over the paragraphs of a text.

A fingerprint is a sum of vectors, one a paragraph (a line), each coordinate modulo a power of two. The order of
paragraphs does not matter, and adding or removing one adds or subtracts its vector, here and in ``equal``. A
paragraph's vector has two kinds of lanes:

* eight lanes of 32 bits of four seeded 64-bit hashes of it, summed modulo 2**32: equality of multisets;
* 189 lanes of one bit of three seeded hashes of each of its sentences, summed modulo 2**21, three lanes to a 63-bit
  integer. Centred on half of the sentences, each is a sum of random signs, so the squared distance of two such vectors
  estimates by how many sentences two texts differ: likeness = 1 - |a - b|**2 / (|a|**2 + |b|**2), clipped to 0..1, as
  in second-moment sketches. Sentences are finer than paragraphs, of which many texts have few.

Equal texts have equal fingerprints; so have texts of the same paragraphs in another order. Only DataFrame functions are
used.

Defined results. Null text: empty. An empty text has one empty paragraph. Beyond 2**21 sentences lanes of the second
kind wrap and likeness loses its meaning, equality does not. Rows without an id come last. Rows that share an id are
ordered by their text. An empty table gives an empty result; in a table of one row, that row is its own next one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.sources.tables import table

EQUAL_SEEDS = (11, 12, 13, 14)
LIKE_SEEDS = (21, 22, 23)
STEPS = 21
#: One bit in each of three fields of 21 bits.
ONES = 1 | 1 << 21 | 1 << 42
FIELD = (1 << 21) - 1
LOW = (1 << 32) - 1
UNIT_BREAK = r"\n|(?<=[.!?]) "


def units(text: Column) -> Column:
    return F.split(text, UNIT_BREAK, -1)


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + of(x))


def fingerprint(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with a column ``name``: struct of n (units), equal (8 lanes) and like (63 packed lanes)."""
    carry = [c for c in docs.columns if c != name]
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = lambda parts, seeds: F.transform(parts, lambda u: F.struct(*[F.xxhash64(F.lit(s), u).alias(f"h{s}") for s in seeds]))
    hashed = docs.select(*carry, hashes(F.split(text, "\n", -1), EQUAL_SEEDS).alias("_paragraphs"), hashes(units(text), LIKE_SEEDS).alias("_units"))

    def wrapped(seed: int, part) -> Column:
        return _sum(F.col("_paragraphs"), lambda u: part(u[f"h{seed}"])).bitwiseAND(F.lit(LOW))

    equal = [wrapped(s, part) for s in EQUAL_SEEDS for part in (lambda h: h.bitwiseAND(F.lit(LOW)), lambda h: F.shiftrightunsigned(h, 32))]
    like = [_sum(F.col("_units"), lambda u, s=s, j=j: F.shiftrightunsigned(u[f"h{s}"], j).bitwiseAND(F.lit(ONES))) for s in LIKE_SEEDS for j in range(STEPS)]
    return hashed.select(*carry, F.struct(F.size("_units").cast("bigint").alias("n"), F.array(*equal).alias("equal"), F.array(*like).alias("like")).alias(name))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two multisets' sum (``sign`` -1: difference, where b is contained in a)."""
    return F.struct(
        (a["n"] + sign * b["n"]).alias("n"),
        F.zip_with(a["equal"], b["equal"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(LOW))).alias("equal"),
        F.zip_with(a["like"], b["like"], lambda x, y: x + sign * y).alias("like"),
    )


def _lanes(packed: Column) -> list[Column]:
    return [F.shiftrightunsigned(packed, k).bitwiseAND(F.lit(FIELD)).cast("double") for k in (0, 21, 42)]


def likeness(a: Column, b: Column) -> Column:
    """From the fingerprints alone; 1 for equal multisets."""

    def total(of) -> Column:
        return F.aggregate(F.zip_with(a["like"], b["like"], of), F.lit(0.0), lambda s, x: s + x)

    def centred(x: Column, n: Column) -> list[Column]:
        return [2 * lane - n.cast("double") for lane in _lanes(x)]

    def added(xs) -> Column:
        return reduce(lambda p, q: p + q, xs)

    apart = total(lambda x, y: added([(p - q) * (p - q) for p, q in zip(centred(x, a["n"]), centred(y, b["n"]), strict=True)]))
    size = total(lambda x, y: added([p * p + q * q for p, q in zip(centred(x, a["n"]), centred(y, b["n"]), strict=True)]))
    return F.when(a["equal"] == b["equal"], F.lit(1.0)).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(apart, size))), F.lit(0.0)))


def to_hex(fp: Column) -> Column:
    """Count, then lanes, in fixed widths."""
    return F.concat(F.lpad(F.lower(F.hex(fp["n"])), 8, "0"), F.array_join(F.transform(fp["equal"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.array_join(F.transform(fp["like"], lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""))


def _bucket(ids: Column, edges: list[int]) -> Column:
    """How many of the ascending ``edges`` are at most ``ids``, by bisection; 0 for null."""
    if not edges:
        return F.lit(0)
    known = F.lit(edges)
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]
    found = F.aggregate(F.lit(steps), F.lit(0), lambda low, step: F.when(F.coalesce(F.get(known, low + step - 1), F.lit((1 << 63) - 1)) <= ids, low + step).otherwise(low))
    return F.when(ids.isNull(), F.lit(0)).otherwise(found)


def with_next(docs: DataFrame, id_col: str, payload: list[str]) -> DataFrame:
    """``docs`` (id and payload) with the payload, as ``next``, of the row that follows by descending id; the first
    row follows the last.

    Rows are dealt by ranges of ids, in four times as many ranges as there are shuffle partitions; what the driver
    gets is a few numbers a range. The first row of each range is also sent to the range before it, so one shuffle of
    the rows is all there is.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("bigint").alias("id"))
    cuts = ids.agg(F.percentile_approx("id", F.lit([k / ranges for k in range(1, ranges)]), F.lit(10_000)).alias("e")).first()["e"] if ranges > 1 else []
    edges = sorted(set(cuts or []))
    # The bound of what comes to the driver is the number of ranges.
    found = ids.groupBy(_bucket(F.col("id"), edges).alias("b")).count().collect()
    order = sorted((r["b"] for r in found), reverse=True)
    before = dict(zip(order[1:] + order[:1], order, strict=True)) if order else {}
    rows = docs.select(F.col(id_col).alias(id_col), *payload, _bucket(F.col(id_col).cast("bigint"), edges).alias("_b"))
    descending = [F.col(id_col).desc_nulls_last(), *[F.col(c) for c in payload[:1]]]
    if not before:
        return rows.select(id_col, *payload, F.struct(*payload).alias("next"))
    firsts = (
        rows.groupBy("_b").agg(F.max(F.struct(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))))).alias("m")).select("_b", F.col("m.col1").alias("top"))
    )
    tops = {r["_b"]: r["top"] for r in firsts.collect()}
    # A sentinel is each row whose id is the highest of its range; of those that share it only the first is used.
    top_of = F.create_map(*[F.lit(x) for k, v in tops.items() for x in (k, v)]) if len(tops) <= 1 else F.map_from_arrays(F.lit(list(tops)), F.lit(list(tops.values())))
    sent_to = F.map_from_arrays(F.lit(list(before)), F.lit(list(before.values())))
    is_top = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))) == F.element_at(top_of, F.col("_b"))
    dealt = rows.withColumn("_to", F.explode(F.when(is_top, F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("late")), F.struct(F.element_at(sent_to, F.col("_b")).alias("b"), F.lit(1).alias("late")))).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("late"))))))
    in_range = Window.partitionBy("_to.b").orderBy(F.col("_to.late"), *descending)
    return dealt.withColumn("next", F.lead(F.struct(*payload)).over(in_range)).where("_to.late = 0").select(id_col, *payload, "next")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(fingerprint(docs, "text", "fp"), "doc_id", ["text", "fp"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = paired.select("doc_id", "text", "fp", F.col("next.fp").alias("next_fp"), F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next.text", F.lit(1), half)).alias("edited"))
    both = fingerprint(edited, "edited", "edited_fp")
    return both.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        to_hex(F.col("fp")).alias("fingerprint"),
        to_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        F.round(likeness(F.col("fp"), F.col("edited_fp")), 9).alias("near_edited"),
        F.round(likeness(F.col("fp"), F.col("next_fp")), 9).alias("near_next"),
    )

"""Exact set-similarity joins between classes of equal sets, and passage families."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.components import components
from skein.sources.scratch import cut, discard

#: Counters that tell how frequent tokens are, for their order, and the most turns in which prefixes are joined. A turn
#: takes a share of the sets, with about as many pairs as prefixes have tokens; its shuffle files are gone before the
#: next, and only pairs that share enough tokens stay.
COUNTERS, TURNS = 1 << 20, 64


def set_rows(sets: DataFrame, least_size: int, columns: Sequence[str] = ()) -> DataFrame:
    """id, columns, tokens (64-bit hashes, in order) and key (a digest of them) of the sets of at least ``least_size``."""
    hashed = F.array_sort(F.transform(F.array_distinct("tokens"), lambda t: F.xxhash64(t)))
    # The generator keeps the filter above it, so that sets are made once.
    rows = sets.select("id", *columns, F.explode(F.array(hashed)).alias("tokens")).where(F.size("tokens") >= least_size)
    return rows.withColumn("key", F.struct(F.xxhash64("tokens"), F.xxhash64(F.lit(1), "tokens")))


def classes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """id, rep: of the rows (id and ``by``) that agree in ``by``, the least id. A frequent value is summed before it is
    shuffled, and the join is one that adaptive execution can split."""
    reps = cut(rows.groupBy(*by).agg(F.min("id").alias("rep")))
    return rows.join(reps, list(by)).select("id", "rep")


def token_order(rows: DataFrame) -> Broadcast:
    """A table by which prefixes order tokens: a number of eight bits for each counter, that grows with how often its
    tokens are there. Any order that is the same for all sets will do, so tokens may share a counter."""
    tokens = rows.select(F.explode("tokens").alias("t"))
    counts = tokens.groupBy(F.pmod("t", F.lit(COUNTERS)).cast("int").alias("k")).agg(F.count("*").alias("n")).toArrow()
    table = np.zeros(COUNTERS, np.uint8)
    table[counts["k"].to_numpy()] = np.minimum(255, np.log2(counts["n"].to_numpy()) * 8)
    return rows.sparkSession.sparkContext.broadcast(table)


def least_length(n: int, threshold: float) -> int:
    """Tokens that a set shares at least with one that is similar."""
    return math.ceil(n * threshold - 1e-9)


def _prefixes(rows: DataFrame, order: Broadcast, threshold: float, columns: Sequence[str]) -> DataFrame:
    """id, key, columns, n, firsts: the tokens of the prefix, mixed with the columns."""
    plain = rows.select("id", "key", *columns, F.xxhash64(F.lit(0), *columns).alias("_of"), "tokens")

    def run(batches):
        table = order.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ends = np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)]).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            rank = (table[flat & (COUNTERS - 1)].astype(np.uint64) << np.uint64(56)) | (flat.view(np.uint64) >> np.uint64(8))
            of = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            kept, sizes = [], []
            for k, (start, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                n = int(end - start)
                first = np.argsort(rank[start:end], kind="stable")[: n - least_length(n, threshold) + 1]
                kept.append(flat[start:end][first] ^ of[k])
                sizes.append(n)
            offsets = pa.array(np.cumsum([0, *map(len, kept)]), pa.int32())
            firsts = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
            names = batch.schema.names[:-2]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(len(names))], pa.array(sizes, pa.int32()), firsts], names=[*names, "n", "firsts"])

    kinds = dict(rows.dtypes)
    return plain.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("id", "key", *columns)) + ", n int, firsts array<long>")


def _pairs(rows: DataFrame, order: Broadcast, threshold: float, columns: Sequence[str]) -> DataFrame:
    """What ``similar_pairs`` gives, of written set rows."""
    reps = rows.groupBy("key", *columns).agg(F.min("id").alias("id"))
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    heads = _prefixes(rows, order, threshold, columns).alias("h").join(reps.alias("r"), [F.col("h.id") == F.col("r.id"), F.col("h.key") == F.col("r.key"), *same], "left_semi")
    heads = cut(heads.select("id", "n", "firsts"))
    tokens = heads.select("id", "n", F.explode("firsts").alias("token"))
    mass = tokens.groupBy("token").agg(F.count("*").alias("c")).agg(F.sum("c").alias("tokens"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).first()
    turns = max(1, min(TURNS, math.ceil((mass["pairs"] or 0) / (mass["tokens"] or 1))))
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    least = lambda n: F.ceil(F.col(n) * threshold - 1e-9)
    enough = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-6) + 1 - F.greatest(least("na"), least("nb"))
    found = []
    for k in range(turns):
        mine = tokens.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == k)
        met = mine.withColumnsRenamed({"id": "a", "n": "na"}).join(tokens.withColumnsRenamed({"id": "b", "n": "nb"}), "token").where(near)
        found.append(cut(met.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c")).where(F.col("c") >= enough).select("a", "b")))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = cut(pairs.distinct())
    discard(heads, *found)
    wanted = cut(rows.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", "key", *columns, "tokens").dropDuplicates(["id", "key", *columns]))
    left, right = (wanted.select(F.col("id").alias(side), F.col("tokens").alias(f"of_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ab")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    scored = pairs.join(left, "a").join(right, "b")
    for c in columns:
        scored = scored.where(F.col(f"{c}_a") == F.col(f"{c}_b"))
    scored = scored.select("a", "b", (shared / (F.size("of_a") + F.size("of_b") - shared).cast("double")).alias("similarity"))
    out = cut(scored.where(F.col("similarity") >= threshold - 1e-9))
    discard(pairs, wanted)
    return out


def similar_pairs(sets: DataFrame, threshold: float, same: Sequence[str] = (), least_size: int = 1) -> DataFrame:
    """a, b, similarity for pairs of different sets (id, tokens) with Jaccard similarity of at least ``threshold``, a < b,
    each of at least ``least_size`` tokens and, if ``same`` is given, equal in these columns.

    Rows of equal sets (and equal ``same``) are one class, named by its least id; pairs are pairs of classes, and
    ``classes`` over the same rows has the members. So copies cost no pair. Tokens are compared by 64-bit hashes.

    Prefix filter, exact: order all tokens by how rare they are. If J(x, y) >= t, x and y share at least t |x| tokens,
    so they share one among the first |x| - ceil(t |x|) + 1 of x and likewise of y. Only these prefixes are joined, by
    token, and lengths must agree within t. Of the set whose prefix ends first, what it shares with the other lies in
    both prefixes or behind its own, so a pair must share a number of tokens in the prefixes that its sizes tell; few
    others are left, and only what is left meets whole sets.
    """
    rows = cut(set_rows(sets, least_size, list(same)))
    out = _pairs(rows, token_order(rows), threshold, list(same))
    discard(rows)
    return out


def _inside(rows: DataFrame, order: Broadcast, threshold: float) -> DataFrame:
    members = cut(classes(rows.select("id", "source", "key"), ["source", "key"]).where("rep <> id"))
    return _pairs(rows, order, threshold, ["source"]).unionByName(members.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def _across(rows: DataFrame, order: Broadcast, threshold: float) -> DataFrame:
    outer = cut(rows.groupBy("key").agg(F.min("id").alias("rep"), F.min("source").alias("first"), F.max("source").alias("last")))
    found = _pairs(rows, order, threshold, ())
    for side in "ab":
        found = found.join(outer.select(F.col("rep").alias(side), F.struct("first", "last").alias(f"of_{side}")), side)
    apart = found.where("NOT (of_a.first = of_a.last AND of_b.first = of_b.last AND of_a.first = of_b.first)").select("a", "b", "similarity")
    elsewhere = cut(rows.groupBy("key", "source").agg(F.min("id").alias("id")).join(outer.select("key", "rep"), "key").where("rep <> id").select("rep", "id"))
    return apart.unionByName(elsewhere.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def links_inside(sets: DataFrame, threshold: float, least_size: int) -> DataFrame:
    """a, b, similarity: rows (id, source, tokens) of equal sets in a source are a class named by its least id; links are
    between classes of a source, and from a class to each other member."""
    rows = cut(set_rows(sets, least_size, ["source"]))
    out = _inside(rows, token_order(rows), threshold)
    discard(rows)
    return out


def links_across(sets: DataFrame, threshold: float, least_size: int) -> DataFrame:
    """a, b, similarity: a class is all rows of equal sets; links are between classes that have rows in different sources,
    and from a class to its least row in each other source."""
    rows = cut(set_rows(sets, least_size, ["source"]))
    out = _across(rows, token_order(rows), threshold)
    discard(rows)
    return out


def links(sets: DataFrame, inside: float, across: float, least_size: int) -> DataFrame:
    """a, b, similarity, kind: the links of rows at ``inside`` in one source (kind: inside) and at ``across`` in different
    ones (kind: across). Copies are not expanded. Sets are made once."""
    rows = cut(set_rows(sets, least_size, ["source"]))
    order = token_order(rows)
    one, two = _inside(rows, order, inside), _across(rows, order, across)
    discard(rows)
    return one.withColumn("kind", F.lit("inside")).unionByName(two.withColumn("kind", F.lit("across")))


def families(members: DataFrame, edges: DataFrame) -> DataFrame:
    """id, family and size for all members; those without an edge are alone. A family's name is by definition a digest
    of all its ids in order, so they meet in one row, eight bytes each."""
    found = components(edges)
    labelled = cut(members.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("root")))
    listed = labelled.groupBy("root").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    named = listed.select("root", F.concat(F.lit("pf_"), F.substring(F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), "|"), 256), 1, 20)).alias("family"), F.size("ids").alias("size"))
    return labelled.join(named, "root").select("id", "family", "size")

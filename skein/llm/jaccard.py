"""N-gram Jaccard join: documents whose sets of three-word shingles agree to 0.9, by equal parts of their sets.

Documents of equal sets are one node. Two nodes x and y can be linked only if no more than a nineteenth of their sizes'
sum is in one of them alone. So if the space of tokens is cut into one part more than that number, at least one part of
x and y is the same.

1. Four orders by hash. Nodes whose first tokens agree under two of the orders meet in a bucket, and each is compared
   with the least of it. That links most of what is similar and costs a few comparisons a node.
2. The rest, exactly. Sizes are in levels, each a quarter wider than the one before it, so that partners are of one
   level or of two that follow each other; a node has the parts of its level, and of the next one if a partner may be
   there. A part holds about eight tokens, so a common passage or line fills hardly any part, whatever its length, and
   texts meet only if most of them is common. Parts that only one component has are dropped. Nodes of different
   components that share a part are a candidate if sizes agree and parities of 512 bins of tokens differ in no more bins
   than sets so similar may differ in tokens: near copies that miss the threshold by a few tokens make no pair. A pair
   that shares many parts is taken at the least of them. Before all candidates are compared, each node is compared with
   one of each of its parts, another each time, until that links next to nothing more: so a group of near copies that
   the first step has left apart is one component before its pairs are made, and few links are found twice.

No pair inside a component is compared once it is known.

Defined results. Words are runs without ASCII white space, A-Z in lower case; fewer than three words are one shingle.
Null or empty text: no set, linked with nothing, its component is its own id. Rows are documents: each gives a row, rows
of one id may have different texts. The least id of a component names it; rows without an id take part and get a name
only from the others. An empty table gives no row. Other columns are not read. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.arrow import map_rows
from skein.llm.linking import maybe_among, merged, text_hash, texts_of, with_parts
from skein.llm.shingles import CACHE_WORDS, family, mix, shingles
from skein.llm.wordcache import WordCache
from skein.sources.scratch import cut, discard
from skein.sources.tables import table

WORDS = 3
#: Similarity in hundredths, and the least size of a set that can be linked to another: 9 of 10 tokens.
LEAST, SMALL = 90, 9
#: Hash orders of the first step.
ORDERS = 4
#: Shared tokens asked for in the prefix by hash: one in so many of the set.
SHARED = 20
#: Rows of 64 bits, at most, of the table that keeps parts of one component out of a shuffle: 8 MiB of bits.
KEY_BIT_ROWS = 1 << 20
#: Parts that a pair is looked up in to find whether it has been taken before.
FIRST_PARTS = 16
#: Times that nodes are compared with one of each of their parts, at most, and the links, of so many nodes, that are
#: worth another time.
LEAD_ROUNDS, WORTH = 4, 1000
#: Bins whose parities tell how far two sets are apart at least, as 64-bit numbers.
BIT_WORDS = 8
#: Texts, and sets, that a task remembers.
REMEMBERED, SETS = 200_000, 16
_MULTIPLIERS = family(ORDERS, 12)


_WORDS = WordCache(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), CACHE_WORDS)


def tokens(text: bytes | None) -> np.ndarray:
    """The set of shingles of a text in UTF-8, as sorted hashes. Of bytes, only ASCII is lower-cased and white space."""
    words = (text or b"").lower().split()
    return np.unique(shingles(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)), WORDS))


def needed(n: int) -> int:
    """Tokens that sets of this size and its partners share in their prefixes by hash."""
    return max(1, n // SHARED)


def window(n: int) -> int:
    """Length of that prefix."""
    return min(n, n - -(-LEAST * n // 100) + needed(n))


def _bounds() -> list[int]:
    """Least sizes of the levels. Of a set of one level, partners are in it or in those beside it."""
    bounds = [SMALL]
    while bounds[-1] < 1 << 31:
        bounds.append(bounds[-1] * 5 // 4)
    return bounds


BOUNDS = _bounds()


@lru_cache(maxsize=64)
def _edges(level: int) -> np.ndarray:
    """Where the parts of a level start, but for the first. There is one more than linked sets of sizes up to the
    level's greatest may differ in tokens."""
    count = 2 * (BOUNDS[level + 1] - 1) * (100 - LEAST) // (100 + LEAST) + 1
    return np.arange(1, count, dtype=np.uint64) * np.uint64((1 << 64) // count)


def parts(found: np.ndarray) -> list[int]:
    """A number for each part of a set, given sorted: its level, its place and the tokens in it. The parts of the next
    level too, if a set that large can be linked to this one."""
    level, out = bisect_right(BOUNDS, len(found)) - 1, []
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(found), dtype=np.uint64)]
    for at in (level, level + 1):
        if at > level and len(found) * 100 // LEAST < BOUNDS[at]:
            break
        edges = _edges(at)
        ends = np.r_[0, np.searchsorted(found, edges), len(found)]
        places = np.arange(len(edges) + 1, dtype=np.uint64) + np.uint64(at << 32)
        out.append(mix(mix(places + np.uint64(1)) + (sums[ends[1:]] - sums[ends[:-1]]) * _MULTIPLIERS[0]))
    return np.concatenate(out).view(np.int64).tolist()


def _keys(found: np.ndarray) -> list[int]:
    """One number for each two orders under which two sets have the same first tokens."""
    firsts = [found[np.argmin(mix(found * m))] for m in _MULTIPLIERS]
    pairs = [[i, a, b] for i, ((_, a), (_, b)) in enumerate(combinations(enumerate(firsts), 2))]
    table = np.array(pairs, np.uint64)
    return mix(mix(table[:, 1] + table[:, 0]) * _MULTIPLIERS[0] + table[:, 2]).view(np.int64).tolist()


def parities(found: np.ndarray) -> list[int]:
    """A bit for each bin of tokens: whether an odd number of the set is in it. A token that one of two sets has alone
    changes one bit, so two sets differ in at least as many tokens as bits."""
    bins = 64 * BIT_WORDS
    counts = np.bincount((found % np.uint64(bins)).astype(np.intp), minlength=bins)
    return np.packbits((counts & 1).astype(np.uint8)).view("<i8").tolist()


class _Profiles:
    """doc_id, hash (of the text), node (hash of its set), n (its size), and once a node and task its keys, parts and
    parities."""

    def __init__(self) -> None:
        self.known: dict[int, tuple[int, int]] = {}
        self.sent: set[int] = set()

    def __call__(self, rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": rows["doc_id"], "hash": rows["hash"], "node": [], "n": [], "keys": [], "parts": [], "bits": []}
        for name, text in zip(rows["hash"], rows["text"], strict=True):
            keys = own = bits = None
            if name not in self.known:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                    self.sent.clear()
                found = tokens(text)
                node = int(np.bitwise_xor.reduce(mix(found * _MULTIPLIERS[1]) + mix(found) * np.uint64(len(found))).view(np.int64)) if len(found) else 0
                self.known[name] = node, len(found)
                if len(found) >= SMALL and node not in self.sent:
                    self.sent.add(node)
                    keys, own, bits = _keys(found), parts(found), parities(found)
            node, n = self.known[name]
            for column, value in (("node", node), ("n", n), ("keys", keys), ("parts", own), ("bits", bits)):
                out[column].append(value)
        return out


def _sizes_agree(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * LEAST


def _not_far(bits: str, other: str, a: str, b: str) -> Column:
    """Sets of similarity 0.9 differ in no more than a nineteenth of their sizes' sum."""
    apart = sum((F.bit_count(F.col(bits)[k].bitwiseXOR(F.col(other)[k])) for k in range(BIT_WORDS)), F.lit(0))
    return apart * (100 + LEAST) <= (F.col(a) + F.col(b)) * (100 - LEAST)


def _joined(labels: DataFrame | None) -> int:
    """Nodes that have another's component."""
    return 0 if labels is None else labels.where("node <> component").count()


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= LEAST * (len(x) + len(y) - both)


def _may_be_linked(x: np.ndarray, y: np.ndarray) -> bool:
    """The prefixes by hash share enough tokens: most sets that are not linked are told apart by these."""
    both = np.intersect1d(x[: window(len(x))], y[: window(len(y))], assume_unique=True)
    return len(both) >= min(needed(len(x)), needed(len(y)))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets agree. Both sides come by joins that adaptive execution can split."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("of_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("of_b"))

    def make():
        sets = WordCache(tokens, SETS)

        def run(rows):
            kept = [_may_be_linked(sets[x], sets[y]) and _linked(sets[x], sets[y]) for x, y in zip(rows["of_a"], rows["of_b"], strict=True)]
            return {c: [v for v, k in zip(rows[c], kept, strict=True) if k] for c in ("a", "b")}

        return run

    return map_rows(pairs.join(left, "a").join(right, "b"), make, "a long, b long")


class _Join:
    def __init__(self, docs: DataFrame) -> None:
        texts = docs.select("doc_id", text_hash().alias("hash"), F.col("text").cast("binary").alias("text"))
        self.texts = texts.select("hash", "text")
        self.rows = cut(map_rows(texts, _Profiles, "doc_id long, hash long, node long, n int, keys array<long>, parts array<long>, bits array<long>"))
        self.nodes = self.rows.where("keys IS NOT NULL")

    def wanted(self, nodes: DataFrame) -> DataFrame:
        """node, text of the given nodes."""
        names = cut(self.nodes.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("hash").alias("hash")))
        return cut(texts_of(self.texts, names))

    def compared(self, pairs: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        """Labels after the candidates (a, b)."""
        texts = self.wanted(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        found = cut(_verified(pairs, texts))
        labels = merged(labels, found)
        discard(pairs, texts, found)
        return labels

    def first(self) -> DataFrame | None:
        """Labels after comparing every node with the least of each of its buckets."""
        keyed = self.nodes.select("node", "n", F.explode("keys").alias("key"))
        leads = cut(keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last")).where("lead.node <> last").select("key", F.col("lead.node").alias("a"), F.col("lead.n").alias("na")))
        pairs = keyed.join(leads, "key").where((F.col("node") != F.col("a")) & _sizes_agree("n", "na")).select("a", F.col("node").alias("b")).distinct()
        return self.compared(cut(pairs), None)

    def heads(self, labels: DataFrame | None) -> DataFrame:
        """node, n, part, bits, firsts, key: the nodes by those of their parts that several components have."""
        nodes = with_parts(self.nodes.select("node", "n", "parts"), labels, ("node", "part"))
        rows = nodes.select("node", "n", "part", F.explode("parts").alias("key"))
        shared = cut(rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key"))
        live = cut(maybe_among(rows, shared, "key", KEY_BIT_ROWS).join(shared, "key").groupBy("node", "n", "part").agg(F.sort_array(F.collect_set("key")).alias("keys")))
        bits = self.nodes.select("node", "bits").join(live.select("node"), "node", "left_semi").dropDuplicates(["node"])
        # A pair is taken at the least part of both: the least of each node's are enough to tell most others.
        heads = cut(live.join(bits, "node").select("node", "n", "part", "bits", F.slice("keys", 1, FIRST_PARTS).alias("firsts"), F.explode("keys").alias("key")))
        discard(shared, live)
        return heads

    def led(self, heads: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
        """Candidates (a, b) of different components, a the one of a part of b that comes first in this turn's order."""
        heads = cut(with_parts(heads, labels, ("node", "part")))
        order = F.xxhash64("node", F.lit(turn))
        leads = heads.groupBy("key").agg(F.min(F.struct(order.alias("order"), "node", "n", "part", "bits")).alias("lead"))
        leads = cut(leads.select("key", *[F.col(f"lead.{c}").alias(name) for c, name in (("node", "a"), ("n", "na"), ("part", "of_a"), ("bits", "bits_a"))]))
        pairs = heads.join(leads, "key").where((F.col("part") != F.col("of_a")) & _sizes_agree("n", "na") & _not_far("bits", "bits_a", "n", "na"))
        out = cut(pairs.select("a", F.col("node").alias("b")).distinct())
        discard(heads, leads)
        return out

    def met(self, labels: DataFrame | None, heads: DataFrame | None = None) -> DataFrame:
        """Candidates (a, b) of different components; a pair that shares many parts may come again. Heads of earlier
        labels only have more parts than these need."""
        heads = cut(with_parts(heads, labels, ("node", "part"))) if heads else self.heads(labels)
        other = heads.withColumnsRenamed({"node": "b", "n": "nb", "part": "of_b", "bits": "bits_b", "firsts": "firsts_b"})
        new = F.coalesce(F.array_min(F.array_intersect("firsts", "firsts_b")) >= F.col("key"), F.lit(True))
        met = heads.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("part") != F.col("of_b")) & _sizes_agree("n", "nb") & _not_far("bits", "bits_b", "n", "nb"))
        return met.where(new).select(F.col("node").alias("a"), "b")

    def rest(self, labels: DataFrame | None) -> DataFrame | None:
        """Labels after comparing all candidates."""
        heads = self.heads(labels)
        for turn in range(LEAD_ROUNDS):
            before = _joined(labels)
            labels = self.compared(self.led(heads.drop("part"), labels, turn), labels)
            after = _joined(labels)
            if after - before < max(1, after // WORTH):
                break
        pairs = cut(self.met(labels, heads.drop("part")).distinct())
        discard(heads)
        return self.compared(pairs, labels)


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a row."""
    join = _Join(docs)
    labels = join.first()
    labels = join.rest(labels)
    rows = with_parts(join.rows.select("doc_id", "node", F.col("n").cast("long").alias("n_shingles")), labels, ("node", "part"))
    linking = F.col("n_shingles") > 0
    firsts = cut(rows.where(linking).groupBy("part").agg(F.min("doc_id").alias("least")))
    with_set = rows.where(linking).join(firsts, "part").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return with_set.unionByName(rows.where(~linking).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))

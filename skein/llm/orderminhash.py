"""Near-duplicate documents by Order MinHash.

A text is the sequence of its five-word shingles, each labelled with how many equal ones came before it. A sketch entry
takes the ``KEEP`` labelled shingles that are least under one hash function and keeps them in the order of the text;
texts that share most shingles in the same order share entries. Short texts (up to ``SHORT`` words) have entries of 3,
long ones of 5, and those of a length that may be near either have both.

Similarity is edit similarity: of n1 and n2 words, M can be aligned in order; it is M / max(n1, n2), and 0.8 or more is a
link. Candidates are verified by that alignment, in the band that a similarity of 0.8 leaves. Words are compared by
32-bit hashes. Texts whose labelled shingles agree in order to 0.8 (of all shingles of both) have words that do, and
share no entry with a chance under 1e-6; texts that only their words make similar, with edits spread evenly, share one
less surely (recall is in the README).

Candidates without all pairs. Rows of equal text are one node. In each bucket of an entry, all members are compared with
the least one, each first with the least of all its leads. Verified links give components. While a bucket has members
of several components, more of its members are compared with all others of other components and then leave it: first
some of its largest component, then some of the others, then all that are left. Inside a component nothing has to be
compared; no pair of different components that share a bucket goes without, so no link between classes is lost. Pairs
that cannot be similar are left out before their texts are brought together: each text has a bit for each of 256 bins
of words; a bin that only one of two texts has is a word of it that cannot be aligned. Pairs that pass are told apart by
the words that both have, counted as often as both have them: no more can be aligned.

Defined results. Null or empty text: no words; all such texts are copies of each other. A text of under five words has
one shingle. Rows are told apart by id and text: rows that share an id, or have none, are different documents if their
texts differ, and repeats of one document if not. The least id names a class; nulls come last, and a class of rows
without ids is named by a hash of a text. An empty table gives an empty result. Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.arrow import map_rows
from skein.llm.shingles import family, labelled, shingles, word_hashes
from skein.operators.components import components
from skein.sources.scratch import cut, discard
from skein.sources.tables import table

SIMILARITY = 0.8
#: Entries for short and for long texts: shingles kept, number of hash functions.
SHORT_KEEP, SHORT_ENTRIES = 3, 28
LONG_KEEP, LONG_ENTRIES = 5, 40
SHORT = 68
#: How many of the largest component of a bucket are compared with the others, in so many turns; then of the others.
MAJOR_TURNS, MAJOR_AT_ONCE, MINOR_AT_ONCE = 2, 4, 16
#: Texts that a task remembers, so that it sends a frequent one once.
REMEMBERED = 200_000
#: Words between two moves of the alignment's window.
STEP = 256


def _entries(labels: np.ndarray, keep: int, count: int, seed: int) -> list[int]:
    """One 64-bit number for each hash function."""
    multipliers = family(count, seed)
    n = len(labels)
    keep = min(keep, n)
    step = max(1, 2_000_000 // n)
    out: list[int] = []
    for at in range(0, count, step):
        values = labels[None, :] * multipliers[at : at + step, None]
        places = np.argpartition(values, keep - 1, axis=1)[:, :keep] if keep < n else np.tile(np.arange(n), (len(values), 1))
        places.sort(axis=1)
        kept = labels[places]
        folded = np.full(len(values), seed, np.uint64) + np.arange(at, at + len(values), dtype=np.uint64)
        for k in range(keep):
            folded = (folded ^ kept[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            folded ^= folded >> np.uint64(29)
        out += folded.view(np.int64).tolist()
    return out


def sketch(words: np.ndarray) -> list[int]:
    """Entries of a text, given the hashes of its words."""
    n = len(words)
    out: list[int] = []
    labels = labelled(shingles(words))
    if n and n * SIMILARITY <= SHORT:
        out += _entries(labels, SHORT_KEEP, SHORT_ENTRIES, 1)
    if n > SHORT:
        out += _entries(labels, LONG_KEEP, LONG_ENTRIES, 2)
    return out


def aligned(a: list[int], b: list[int], low: int, high: int) -> int:
    """The most pairs of equal places i of a and j of b, in order in both, with -low <= i - j <= high.

    One bit stands for each place of a that the band of the next STEP places of b reaches; a cleared bit is one more
    pair. So a step costs the width of the band, not the length of the text."""
    places: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(a):
        places[w].append(i)
    base = top = v = count = 0
    for j, w in enumerate(b):
        if j % STEP == 0:
            drop = min(max(j - low - base, 0), top - base)
            count += drop - (v & ((1 << drop) - 1)).bit_count()
            v >>= drop
            base += drop
            reach = max(top, min(len(a), j + STEP + high + 1))
            v |= ((1 << (reach - top)) - 1) << (top - base)
            top = reach
        at = places.get(w)
        if at is None:
            continue
        found = 0
        for p in at[bisect_left(at, max(j - low, base)) : bisect_right(at, j + high)]:
            found |= 1 << (p - base)
        if found:
            u = v & found
            v = ((v + u) | (v - u)) & ((1 << (top - base)) - 1)
    return count + (top - base) - v.bit_count()


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many places agree from the start."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    if len(a) == 0 or len(b) == 0:
        return len(a) == len(b)
    least = int(np.ceil(similarity * max(len(a), len(b)) - 1e-9))
    if min(len(a), len(b)) < least:
        return False
    # What both start and end with is part of a best alignment.
    same = _agreeing(a, b)
    a, b, least = a[same:], b[same:], least - same
    same = _agreeing(a[::-1], b[::-1])
    a, b, least = a[: len(a) - same], b[: len(b) - same], least - same
    if least <= 0 or min(len(a), len(b)) < least:
        return least <= 0
    return aligned(a.tolist(), b.tolist(), len(b) - least, len(a) - least) >= least


def node_of(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def once(nodes: list, seen: set) -> list[int]:
    """The places of those nodes that this task has not met. What it remembers is bounded."""
    out = []
    for k, node in enumerate(nodes):
        if node not in seen:
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(node)
            out.append(k)
    return out


def _sketches(texts: DataFrame) -> DataFrame:
    """node, number of words and entries, one row a node."""

    def make():
        seen: set = set()

        def run(rows):
            out: dict[str, list] = {"node": [], "n": [], "entries": []}
            for k in once(rows["node"], seen):
                words = word_hashes((rows["text"][k] or "").split())
                out["node"].append(rows["node"][k])
                out["n"].append(len(words))
                out["entries"].append(sketch(words))
            return out

        return run

    return map_rows(texts, make, "node long, n int, entries array<long>").dropDuplicates(["node"])


#: What tells pairs apart before their texts are brought together.
BINS = ("b0", "b1", "b2", "b3")
BITS = (*BINS, "tokens")


def _sequences(texts: DataFrame) -> DataFrame:
    """node, its words, four bytes each, which of 256 bins of words it has, and its words told apart by how many equal ones
    came before."""

    def make():
        seen: set = set()

        def run(rows):
            out: dict[str, list] = {c: [] for c in ("node", "words", *BITS)}
            for k in once(rows["node"], seen):
                words = word_hashes((rows["text"][k] or "").split())
                bins = np.zeros(256, np.uint8)
                bins[(words & np.uint64(255)).astype(np.intp)] = 1
                out["node"].append(rows["node"][k])
                out["words"].append((words >> np.uint64(32)).astype("<u4").tobytes())
                out["tokens"].append(np.unique(labelled(words >> np.uint64(32)).astype(np.uint32).view(np.int32)).tolist())
                for c, v in zip(BINS, np.packbits(bins).view("<i8").tolist(), strict=True):
                    out[c].append(v)
            return out

        return run

    return map_rows(texts, make, "node long, words binary, b0 long, b1 long, b2 long, b3 long, tokens array<int>")


def _verified(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar. Both sides come by joins that adaptive execution can split."""
    left = sequences.select(F.col("node").alias("a"), F.col("words").alias("of_a"))
    right = sequences.select(F.col("node").alias("b"), F.col("words").alias("of_b"))

    def make():
        def run(rows):
            kept = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(rows["of_a"], rows["of_b"], strict=True)]
            return {c: [v for v, k in zip(rows[c], kept, strict=True) if k] for c in ("a", "b")}

        return run

    return map_rows(pairs.join(left, "a").join(right, "b"), make, "a long, b long")


def _near_length(n: str, other: str) -> Column:
    return F.least(n, other) >= SIMILARITY * F.greatest(n, other)


def _with_parts(nodes: DataFrame, labels: DataFrame, *own: tuple[str, str]) -> DataFrame:
    """The component of each of the given (node, name of it) columns. A node without a label is its own component."""
    for node, part in own:
        side = labels.select(F.col("node").alias(node), F.col("component").alias(part))
        nodes = nodes.join(side, node, "left").withColumn(part, F.coalesce(part, node))
    return nodes


def _merged(labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """Components (node, component) after new links (a, b); None if there has never been one."""
    if labels is None:
        return None if found.isEmpty() else components(found)
    links = cut(_with_parts(found, labels, ("a", "of_a"), ("b", "of_b")).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).where("a <> b").distinct())
    if links.isEmpty():
        discard(links)
        return labels
    roots = components(links).select(F.col("node").alias("own"), F.col("component").alias("root"))
    fresh = roots.join(labels, roots["own"] == labels["node"], "left_anti").select(F.col("own").alias("node"), F.col("own").alias("component"))
    out = cut(labels.unionByName(fresh).join(roots, F.col("component") == F.col("own"), "left").select("node", F.coalesce("root", "component").alias("component")))
    discard(links, labels)
    return out


def _compared(pairs: DataFrame, labels: DataFrame | None, sequences: DataFrame) -> DataFrame | None:
    """Labels after comparing those of the pairs (a, b) that are not yet in one component."""
    if labels is not None:
        pairs = _with_parts(pairs, labels, ("a", "of_a"), ("b", "of_b")).where("of_a <> of_b").select("a", "b")
    pairs = cut(pairs)
    found = cut(_verified(pairs, sequences))
    labels = _merged(labels, found)
    discard(pairs, found)
    return labels


def _can_be_similar() -> Column:
    """Of a member (n, bits, tokens) and a lead: enough words of each could be aligned with the other. Bins tell most
    pairs apart; of the others the words in common are counted, each as often as both have it."""
    needed = SIMILARITY * F.greatest("n", "lead_n")

    def alone(own: str, other: str) -> Column:
        return sum((F.bit_count(F.col(own + c).bitwiseAND(F.bitwise_not(F.col(other + c)))) for c in BINS), F.lit(0))

    left = F.least(F.col("n") - F.size("tokens"), F.col("lead_n") - F.size("lead_tokens"))
    common = F.size(F.array_intersect("tokens", "lead_tokens"))
    return (F.col("n") - alone("", "lead_") >= needed) & (F.col("lead_n") - alone("lead_", "") >= needed) & (common + left >= needed)


def _candidates(members: DataFrame, leads: DataFrame) -> DataFrame:
    """Members with the leads of their bucket, if their components differ and they can be similar."""
    leads = leads.withColumnsRenamed({"node": "lead", **{c: f"lead_{c}" for c in ("n", "part", *BITS)}})
    both = members.join(leads, (members["key"] == leads["key"]) & (F.col("part") != F.col("lead_part")) & _near_length("n", "lead_n") & _can_be_similar())
    return both.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def node_classes(texts: DataFrame) -> DataFrame | None:
    """node, component for the nodes (of node, text) that are linked to others; None if there is no link."""
    sketches = cut(_sketches(texts))
    keyed = sketches.select("node", "n", F.explode("entries").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last")).where("lead.node <> last").select("key", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")))
    members = cut(keyed.join(shared, "key").select("key", "node", "n", "lead", "lead_n"))
    discard(sketches, shared)
    known = members.select("node").distinct()
    sequences = cut(_sequences(texts).join(known, "node", "left_semi").dropDuplicates(["node"]))
    pairs = cut(members.where("node <> lead").where(_near_length("n", "lead_n")).select("node", "lead").distinct())
    labels = _compared(pairs.groupBy("node").agg(F.min("lead").alias("a")).select("a", F.col("node").alias("b")), None, sequences)
    labels = _compared(pairs.select(F.col("lead").alias("a"), F.col("node").alias("b")), labels, sequences)
    discard(pairs)
    left = members.where("node <> lead").select("key", "node", "n")
    turn, last = 0, members
    while True:
        # Leads have met all others of their buckets. Buckets that are left with one component are done.
        rest = left.select("key", "node", "n", F.col("node").alias("part")) if labels is None else _with_parts(left, labels, ("node", "part"))
        rest = cut(rest)
        mixed = rest.groupBy("key", "part").agg(F.count("*").alias("size")).groupBy("key").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("size", "part")).alias("major")).where("parts > 1")
        members = cut(rest.join(cut(mixed.select("key", "major")), "key").join(sequences.select("node", *BITS), "node"))
        discard(last, rest)
        last = members
        if members.isEmpty():
            break
        turn += 1
        if turn > MAJOR_TURNS + 1:  # all that are left: those outside the largest component with all others
            leads = members.where("part <> major").select("key", "node", "n", "part", *BITS)
            labels = _compared(_candidates(members, leads), labels, sequences)
            break
        of_major = turn <= MAJOR_TURNS
        pool = members.where("part = major" if of_major else "part <> major")
        slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(MAJOR_AT_ONCE if of_major else MINOR_AT_ONCE))
        leads = cut(pool.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("part", "node", "n", *BITS)).alias("lead")).select("key", *[f"lead.{c}" for c in ("node", "n", "part", *BITS)]))
        labels = _compared(_candidates(members, leads), labels, sequences)
        left = members.join(leads.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", "n")
    discard(sequences)
    return labels


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the text), class_id, kept: one row for each row. Of a class, the least document is kept."""
    texts = docs.select("doc_id", node_of().alias("node"), "text")
    labels = node_classes(texts.select("node", "text"))
    rows = texts.select("doc_id", "node")
    rows = rows.withColumn("part", F.col("node")) if labels is None else _with_parts(rows, labels, ("node", "part"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    firsts = cut(rows.groupBy("part").agg(F.min(order).alias("first")))
    named = rows.join(firsts, "part")
    return named.select("doc_id", "node", F.coalesce("first.doc_id", "part").alias("class_id"), (order == F.col("first")).alias("kept"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. ``kept`` is true for one document of each class (for all its repeats, if rows agree in id and
    text)."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each class, once. Repeats meet in partial sums before the shuffle."""
    own = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    kept = classes(docs).where("kept").select(*own, F.col("node").alias("_node")).distinct()
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", *own, node_of().alias("_node"))
    return rows.dropDuplicates(["_id", "_none", "_node"]).join(kept, ["_id", "_none", "_node"], "left_semi").select("doc_id", "text", "lang", "source", "n_chars")

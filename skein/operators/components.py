"""Connected components of a graph given by its edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.scratch import cut, discard


def _jumped(parents: DataFrame) -> DataFrame:
    """Every node with the root that its parents lead to. A parent is never greater than its node, so parents form a
    forest; each turn halves the way to the root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        further = cut(parents.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
        discard(parents)
        if further.where("moved").isEmpty():
            return further.select("node", "parent")
        parents = further


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node of it) for every node of an edge.

    Each turn hangs every node on its least neighbour, follows these to their roots and contracts the edges to roots,
    which leaves at most half of the nodes that still have edges. A node of any degree is only ever the key of an
    aggregation with partial sums or of a join that adaptive execution can split. Null ends are ignored.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while labels is None or not pairs.isEmpty():
        ends = pairs.select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("other")), F.struct(F.col("a").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        roots = _jumped(cut(ends.groupBy("node").agg(F.min("other").alias("parent"))))
        if labels is None:
            labels = roots.select("node", F.col("parent").alias("component"))
        else:
            up = roots.select(F.col("node").alias("component"), "parent")
            labels = cut(labels.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        low = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        high = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        contracted = pairs.join(low, "a").join(high, "b").where("ra <> rb")
        rest = cut(contracted.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        discard(pairs)
        pairs = rest
    return labels

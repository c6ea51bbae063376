"""Classes that grow by links, and texts by their hashes: what the joins of similar documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.components import components
from skein.sources.scratch import cut, discard

#: Rows of the table of bits that keeps texts nobody asks for out of a shuffle: 64 bits each, 2 MiB in all.
BIT_ROWS = 1 << 17


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def with_parts(nodes: DataFrame, labels: DataFrame | None, *own: tuple[str, str]) -> DataFrame:
    """The component of each of the given (node, name of it) columns. A node without a label is its own component."""
    for node, part in own:
        if labels is None:
            nodes = nodes.withColumn(part, F.col(node))
            continue
        side = labels.select(F.col("node").alias(node), F.col("component").alias(part))
        nodes = nodes.join(side, node, "left").withColumn(part, F.coalesce(part, node))
    return nodes


def merged(labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """Components (node, component) after new links (a, b); None if there has never been one."""
    if labels is None:
        return None if found.isEmpty() else components(found)
    links = cut(with_parts(found, labels, ("a", "of_a"), ("b", "of_b")).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).where("a <> b").distinct())
    if links.isEmpty():
        discard(links)
        return labels
    roots = components(links).select(F.col("node").alias("own"), F.col("component").alias("root"))
    fresh = roots.join(labels, roots["own"] == labels["node"], "left_anti").select(F.col("own").alias("node"), F.col("own").alias("component"))
    out = cut(labels.unionByName(fresh).join(roots, F.col("component") == F.col("own"), "left").select("node", F.coalesce("root", "component").alias("component")))
    discard(links, labels)
    return out


def maybe_among(rows: DataFrame, wanted: DataFrame, name: str, bit_rows: int = BIT_ROWS) -> DataFrame:
    """Those of the rows whose 64-bit ``name`` sets a bit of a table of bounded size that holds all of the ``wanted``:
    all that are wanted, and few others. The table is broadcast, so the rest stays out of a shuffle."""
    row = F.pmod(F.shiftright(name, 6), F.lit(bit_rows))
    bits = wanted.groupBy(row.alias("row")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({name} & 63 AS INT))")).alias("set_bits"))
    near = rows.withColumn("row", row).join(F.broadcast(bits), "row")
    return near.where(F.expr(f"(shiftright(set_bits, CAST({name} & 63 AS INT)) & 1L) = 1L")).drop("row", "set_bits")


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the ``wanted`` (node, hash), once each, from ``texts`` (hash, text). Before texts are shuffled,
    those that are surely not wanted are left out, and copies in one task are one row."""
    near = maybe_among(texts, wanted, "hash").select("hash", "text")
    return near.dropDuplicates(["hash"]).join(wanted, "hash").select("node", "text")

"""Pairs of query vectors with all rows, block by block, in NumPy inside tasks.

Both sides are dealt out to tasks by a plain shuffle: a task gets a group of the queries (QUERIES of them) and a share
of the rows, its queries first, then its rows in batches. So nothing is held whole anywhere, whatever the number of
queries or rows, and pairs that a query does not want never leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Queries that a task holds, rows of a block, pairs of a tile, pairs of a task.
QUERIES, ROWS, TILE, TASK = 20_000, 8_192, 1 << 20, 1 << 26
#: Digits of a similarity.
DIGITS = 9
#: Keys of order: of what is left out, of nulls (last), of NaN (first).
OUT, LAST, FIRST = -np.inf, -1e300, 1e300


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero on the scaled double, which is what SQL's round does; never a negative zero."""
    scaled = x * 10.0**digits
    whole = np.rint(scaled)
    ties = np.abs(scaled - whole) == 0.5
    if ties.any():
        whole[ties] = np.trunc(scaled[ties]) + np.sign(scaled[ties])
    return whole / 10.0**digits + 0.0


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products in the order of places, as SQL adds them up."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class Vectors:
    """Columns of some queries or rows whose vectors have ``size`` places; of no use (null, or a null in it): -1."""

    def __init__(self, columns: dict[str, pa.Array], values: np.ndarray, norm: np.ndarray | None = None) -> None:
        self.columns, self.values, self.size = columns, values, values.shape[1] if values.ndim == 2 else -1
        self._order: np.ndarray | None = None
        self.n = len(columns["id"])
        self.no_id = columns["id"].is_null().to_numpy(zero_copy_only=False)
        self.id = columns["id"].fill_null(0).to_numpy(zero_copy_only=False)
        self.no_label = columns["label"].is_null().to_numpy(zero_copy_only=False)
        self.label = columns["label"].fill_null(0).to_numpy(zero_copy_only=False)
        if self.size >= 0:
            self.norm = np.sqrt(_dots(values, values)) if norm is None else norm
            self.zero = self.norm == 0
            with np.errstate(all="ignore"):
                self.unit = values / np.where(self.zero, 1.0, self.norm)[:, None]

    def slices(self, rows: int) -> Iterator[Vectors]:
        for at in range(0, self.n, rows):
            yield Vectors({c: a.slice(at, rows) for c, a in self.columns.items()}, self.values[at : at + rows], self.norm[at : at + rows] if self.size >= 0 else None)

    def order(self) -> np.ndarray:
        """Places of the rows in the order of their tags, if they have any, and ids."""
        if self._order is None:
            # By bytes of UTF-8, as Spark orders strings; nulls first.
            tags = self.columns["tag"].cast(pa.binary()).to_pylist()
            places = {t: k for k, t in enumerate(sorted({t for t in tags if t is not None}), 1)}
            self._order = np.empty(self.n, np.int64)
            self._order[np.lexsort((self.id, [places.get(t, 0) for t in tags]))] = np.arange(self.n)
        return self._order


def by_size(table: pa.Table) -> Iterator[Vectors]:
    """The rows of a table (id, label, v and others) by the length of their vectors."""
    table = table.combine_chunks()
    vectors = table.column("v").combine_chunks() if table.num_rows else None
    if vectors is None:
        return
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks)
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = vectors.flatten()
    if inner.null_count:
        owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
        broken = np.unique(owner[inner.is_null().to_numpy(zero_copy_only=False)])
    else:
        broken = np.zeros(0, np.int64)
    sizes = lengths.copy()
    sizes[broken] = -1
    starts = np.r_[0, np.cumsum(np.maximum(lengths, 0))]
    flat = inner.to_numpy(zero_copy_only=False).astype(np.float64)
    columns = {c: pa.concat_arrays(table.column(c).chunks) if table.column(c).num_chunks != 1 else table.column(c).chunk(0) for c in table.column_names if c != "v"}
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        values = flat[starts[at][:, None] + np.arange(size)] if size >= 0 else np.zeros(len(at))
        yield Vectors({c: a.take(pa.array(at)) for c, a in columns.items()}, values)


class Tile:
    """Queries ``q`` and rows ``v`` with their similarities, and where these are null."""

    def __init__(self, q: Vectors, v: Vectors) -> None:
        self.q, self.v = q, v
        if q.size != v.size or q.size < 0:
            self.similarity, self.null = np.zeros((q.n, v.n)), np.ones((q.n, v.n), bool)
            return
        # Products of unit vectors tell the digits of all but those next to a tie of rounding: these are added up again
        # in SQL's order.
        scale = 10.0**DIGITS
        with np.errstate(all="ignore"):
            near = (q.unit * scale) @ v.unit.T
            whole = np.rint(near)
            unsure = np.flatnonzero(np.abs(near - whole) > 0.5 - 8 * (q.size + 8) * np.finfo(float).eps * scale)
            whole /= scale
            if len(unsure):
                i, j = np.divmod(unsure, v.n)
                whole.flat[unsure] = rounded(_dots(q.values[i], v.values[j]) / (q.norm[i] * v.norm[j]), DIGITS)
        whole += 0.0
        self.similarity = whole
        self.null = q.zero[:, None] | v.zero if q.zero.any() or v.zero.any() else None

    def same(self) -> np.ndarray:
        """Where the labels agree."""
        return (self.q.label[:, None] == self.v.label) & ~(self.q.no_label[:, None] | self.v.no_label)

    def other(self) -> np.ndarray:
        """Where the row is another one than the query; a row without an id is neither."""
        return (self.q.id[:, None] != self.v.id) & ~self.v.no_id

    def at_least(self, bound: float) -> np.ndarray:
        """Where the similarity is so high; NaN is above all, null is not."""
        high = ~(self.similarity < bound)
        return high if self.null is None else high & ~self.null

    def key(self, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The values as keys of a falling order."""
        key = np.where(wanted, np.where(np.isnan(values), FIRST, values), OUT)
        if self.null is not None:
            key[self.null & wanted] = LAST
        return key


def best(key: np.ndarray, k: int, order: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest keys of each row; of equal ones first the greatest in ``second``, then the
    first in the order of columns."""
    n = key.shape[1]
    if n > k:
        at_least = np.partition(key, n - k, axis=1)[:, n - k]
        i, j = np.nonzero((key >= at_least[:, None]) & (key != OUT))
    else:
        i, j = np.nonzero(key != OUT)
    then = (order[j],) if second is None else (order[j], -second[i, j])
    p = np.lexsort((*then, -key[i, j], i))
    i, j = i[p], j[p]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept]


def best_by_label(v: Vectors, key: np.ndarray, k: int, order: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same for each label of the columns; those without one are a label of their own."""
    names = np.unique(np.where(v.no_label, np.int64(-(1 << 62)), v.label.astype(np.int64)), return_inverse=True)[1]
    few = np.bincount(names)[names] <= k  # nothing to choose
    i, j = np.nonzero((key != OUT) & few)
    found = [(i, j)]
    for name in np.unique(names[~few]):
        at = np.flatnonzero(names == name)
        i, j = best(key[:, at], k, order[at], None if second is None else second[:, at])
        found.append((i, at[j]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


#: Columns of the result that come from the queries and from the rows.
_FROM_Q, _FROM_V = {"query_id": "id", "query_label": "label"}, {"vec_id": "id", "label": "label"}
Emit = Callable[[Tile], tuple[np.ndarray | None, np.ndarray | None, dict[str, object]]]


def paired(queries: DataFrame, rows: DataFrame, emit: Emit, schema: str) -> DataFrame:
    """What ``emit`` gives for each tile: rows and columns of the pairs it keeps (None, None: all, in order) and further
    columns of them. ``queries``: id, label, v and, if wanted, bound and bound_id; ``rows``: id, label, v and, if
    wanted, tag."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = queries.sparkSession
    n_queries, n_rows = queries.count(), rows.count()
    groups = max(1, math.ceil(n_queries / QUERIES))
    shares = max(1, min(spark.sparkContext.defaultParallelism, math.ceil(n_rows / ROWS)), math.ceil(n_queries * n_rows / TASK / groups))
    column = lambda df, name, kind: (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
    common = lambda df, *first: df.select(*first, F.col("id").cast("long"), F.col("label").cast("long"), "v", column(df, "bound", "double"), column(df, "bound_id", "long"), column(df, "tag", "string"))
    hashed = lambda n: F.pmod(F.xxhash64("id", "label", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = common(queries.withColumn("_group", hashed(groups)).withColumn("_share", every(shares)), "_group", "_share", F.lit(False).alias("_row"))
    two = common(rows.withColumn("_share", hashed(shares)).withColumn("_group", every(groups)), "_group", "_share", F.lit(True).alias("_row"))
    dealt = one.unionByName(two).repartitionById(groups * shares, F.col("_group") * shares + F.col("_share")).sortWithinPartitions("_row").drop("_group", "_share")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def tiles(known: list[Vectors], block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in by_size(pa.Table.from_batches(block)):
            for all_q in known:
                for q in all_q.slices(max(1, TILE // v.n)):
                    i, j, values = emit(Tile(q, v))
                    if i is None:
                        i, j = np.repeat(np.arange(q.n), v.n), np.tile(np.arange(v.n), q.n)
                    if not len(i):
                        continue
                    out = []
                    for f in arrow:
                        if f.name in _FROM_Q:
                            out.append(q.columns[_FROM_Q[f.name]].take(pa.array(i)).cast(f.type))
                        elif f.name in _FROM_V:
                            out.append(v.columns[_FROM_V[f.name]].take(pa.array(j)).cast(f.type))
                        else:
                            given = values[f.name]
                            out.append(given if isinstance(given, pa.Array) else pa.array(given, type=f.type))
                    yield pa.RecordBatch.from_arrays(out, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[pa.RecordBatch] = []
        known: list[Vectors] | None = None
        block: list[pa.RecordBatch] = []
        for batch in batches:
            first = int(np.count_nonzero(~batch.column("_row").to_numpy(zero_copy_only=False)))
            if first:
                asked.append(batch.slice(0, first))
            for at in range(first, batch.num_rows, ROWS):
                if known is None:
                    known = list(by_size(pa.Table.from_batches(asked))) if asked else []
                    asked = []
                block.append(batch.slice(at, ROWS))
                if sum(b.num_rows for b in block) >= ROWS:
                    yield from tiles(known, block)
                    block = []
        if block:
            yield from tiles(known, block)

    return dealt.mapInArrow(run, schema)


def nullable(values: np.ndarray, null: np.ndarray | None) -> pa.Array:
    return pa.array(values, type=pa.float64(), mask=null)

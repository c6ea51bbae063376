"""Whitening of embeddings by LOBPCG: the leading eigenvectors of their covariance without that matrix.

Each turn is one pass over the centred rows: a task multiplies its rows with the block of basis vectors and sends one
partial product; the driver holds blocks of a few vectors only. The basis is the iterate, its residuals and the previous
directions; Rayleigh-Ritz on it gives the next iterate. It ends when the residuals of all wanted vectors are at most
``RESIDUAL`` of the largest eigenvalue, which is what certifies them; an end without that is an error.

* Rows whose vector is null or has null or non-finite entries are dropped, as are entries beyond ``LIMIT``, which have
  no whole number. Vectors of another length than the most frequent one (of the longest of these) have no covariance
  with the others and are dropped. Repeated rows and ids, and null ids, are rows like all others.
* An empty table, or vectors without entries, give no row. A component without variance (equal vectors, one row) has
  whitened null; explained is null if nothing varies, identity_error if no component does. Fewer dimensions than
  components: as many components as dimensions. Other columns are not read.
* Sums and deviations are exact whole numbers; a deviation beyond the range of a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.tables import table

COMPONENTS = 8
#: More vectors than wanted in a block: the last wanted ones converge as fast as those before.
GUARD = 12
RESIDUAL = 1e-13
#: Where rounding ends the descent of residuals: what is accepted if they fall no more.
STALLED, PATIENCE = 1e-11, 4
TURNS = 300
SCALE, SHIFT, LIMIT = 1024.0, 100_000, 2.0**42
#: Partial results are added up in so many tasks before the driver adds these.
FAN = 32
#: A component with a smaller share of the largest eigenvalue has no variance.
FLAT = 1e-13


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers. The vectors have no nulls and ``dim`` entries each."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64).reshape(-1, dim) + SHIFT


def _total(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], dim: int, kind: str) -> np.ndarray | None:
    """The sum of ``part(vectors)``, arrays of one length, over batches of rows: a row a task, then ``FAN`` rows."""
    dtype = {"long": np.int64, "double": np.float64}[kind]
    field = pa.field("sums", pa.list_({"long": pa.int64(), "double": pa.float64()}[kind]))

    def packed(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], type=field.type)], schema=pa.schema([field]))

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = part(_vectors(batch.column("embedding"), dim))
                total = more if total is None else total + more
        yield from packed(total)

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for one in batch.column("sums"):
                more = np.asarray(one.values, dtype)
                total = more if total is None else total + more
        yield from packed(total)

    schema = f"sums array<{kind}>"
    some = rows.select("embedding").mapInArrow(partial, schema).repartition(FAN).mapInArrow(added, schema).collect()
    return np.sum([np.asarray(r.sums, dtype) for r in some], axis=0) if some else None


def usable(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows with a usable ``vector`` (named embedding) of the most frequent length, and that length (0: none)."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LIMIT))
    rows = rows.where(fine & (F.size(vector) > 0)).withColumn("embedding", F.col(vector))
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return (rows.where(F.size("embedding") == common[0].dim), common[0].dim) if common else (rows, 0)


def _basis(*blocks: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span those of the blocks, the first block's as they are. Each vector is made orthogonal
    twice; what nothing is left of is left out."""
    out: list[np.ndarray] = list(blocks[0].T)
    for block in blocks[1:]:
        for v in block.T:
            size = np.linalg.norm(v)
            for _ in range(2):
                q = np.array(out).T
                v = v - q @ (q.T @ v)
            left = np.linalg.norm(v)
            if size > 0 and left > 1e-10 * size and len(out) < len(v):
                v = v / left
                out.append(v - np.array(out).T @ (np.array(out) @ v))
                out[-1] /= np.linalg.norm(out[-1])
    return np.array(out).T


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of the symmetric matrix that ``product`` multiplies by."""
    size = min(dim, wanted + GUARD)
    x = np.linalg.qr(np.random.default_rng(13).standard_normal((dim, size)))[0]
    residuals = directions = np.zeros((dim, 0))
    best, turns_since = np.inf, 0
    for _ in range(TURNS):
        basis = _basis(x, residuals, directions)
        image = product(basis)
        small = basis.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1][:size], y[:, ::-1][:, :size]
        kept = x.shape[1]
        x, ax = basis @ y, image @ y
        residuals, directions = ax - x * values, basis[:, kept:] @ y[kept:]
        top = max(values[0], 0.0)
        worst = np.linalg.norm(residuals[:, :wanted], axis=0).max()
        if worst <= RESIDUAL * top:
            return values[:wanted], x[:, :wanted]
        turns_since = 0 if worst < 0.5 * best else turns_since + 1
        best = min(best, worst)
        if turns_since >= PATIENCE and worst <= STALLED * top:
            return values[:wanted], x[:, :wanted]
        x = _basis(np.linalg.qr(x)[0])
    raise ArithmeticError(f"residuals of {worst} after {TURNS} turns, eigenvalue {top}")


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error."""
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good, dim = usable(rows.select(key, vector), vector)
    spark = rows.sparkSession
    if not dim:
        return spark.createDataFrame([], schema)
    first = _total(good, lambda x: np.r_[len(x), x.sum(0)], dim, "long")
    if first is None:
        return spark.createDataFrame([], schema)
    n, sums = int(first[0]), first[1:]
    # x - S/n as (x - floor(S/n)) - (S mod n)/n: no digits are lost before the difference
    whole, part = sums // n, (sums % n) / n
    wanted = min(components, dim)

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(np.float64) - part

    def product(block: np.ndarray) -> np.ndarray:
        def one(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return (c.T @ (c @ block)).ravel()

        return _total(good, one, dim, "double").reshape(block.shape) / n

    values, vectors = lobpcg(product, dim, wanted)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(wanted)] < 0, -1.0, 1.0)
    varies = values > FLAT * max(values[0], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        factors = np.where(varies, vectors / np.sqrt(values), 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        w = c @ factors
        return np.r_[(c * c).sum(), w.sum(0), (w.T @ w).ravel()]

    found = _total(good, moments, dim, "double") / n
    trace, mean, second = found[0], found[1 : 1 + wanted], found[1 + wanted :].reshape(wanted, wanted)
    off = np.abs(second - np.outer(mean, mean) - np.eye(wanted))[np.ix_(varies, varies)]
    error = float(off.max()) if varies.any() else None
    explained = [float(v / trace) if trace > 0 else None for v in np.where(varies, values, 0.0)]
    arrow = pa.schema([pa.field(key, pa.null()), pa.field("component", pa.int32()), pa.field("n", pa.int64()), pa.field("deviation", pa.int64()), pa.field("whitened", pa.float64()), pa.field("explained", pa.float64()), pa.field("identity_error", pa.float64())])

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, size = _vectors(batch.column("embedding"), dim), batch.num_rows
            w, deviation = centred(x) @ factors, _deviations(x, n, sums)
            ids = batch.column(key)
            for k in range(wanted):
                made = [ids, pa.array(np.full(size, k + 1, np.int32)), pa.array(np.full(size, n)), deviation, pa.array(w[:, k]) if varies[k] else pa.nulls(size, pa.float64()), pa.array([explained[k]] * size, pa.float64()), pa.array([error] * size, pa.float64())]
                yield pa.RecordBatch.from_arrays(made, schema=arrow.set(0, pa.field(key, ids.type)))

    return good.select(key, "embedding").mapInArrow(rows_of, schema)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Of each row the sum of (n x - S) squared, in 64 bits where all of it fits, else in long integers."""
    rough = ((x - sums / n) * float(n)) ** 2
    if rough.sum(1).max() < 2.0**61 and float(n) * np.abs(x).max() < 2.0**61:
        return pa.array(((x * n - sums) ** 2).sum(1))
    exact = (sum((int(v) * n - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x)
    return pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))

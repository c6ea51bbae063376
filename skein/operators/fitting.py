"""Small models fitted by gradient descent with a fixed number of steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.scratch import cut, discard

# Steps and rates of the calibration and of the classifier.
PLATT_STEPS, PLATT_RATE = 500, 0.05
LOGISTIC_STEPS, LOGISTIC_RATE, LOGISTIC_L2 = 350, 0.15, 0.01
BINS = 1000


def platt(rows: DataFrame) -> DataFrame:
    """concept, slope, bias. Scores are summed in bins of a thousandth, so what is fitted has a bounded size whatever
    the number of rows; a bin stands for the mean of its scores and targets. Beyond 4, to either side, one bin holds all:
    there calibrated probabilities are near 0 or 1 whatever the score."""
    spark = rows.sparkSession
    binned = rows.groupBy("concept", F.least(F.greatest(F.floor(F.col("raw") * BINS), F.lit(-4 * BINS)), F.lit(4 * BINS)).alias("bin")).agg(F.count("*").alias("n"), F.avg("raw").alias("x"), F.avg("target").alias("t"))
    by: dict[int, list[tuple[float, float, float]]] = {}
    for r in binned.collect():
        by.setdefault(r["concept"], []).append((float(r["n"]), r["x"], r["t"]))
    out = []
    for concept, values in sorted(by.items()):
        n, x, t = np.array(sorted(values)).T
        slope, bias = 1.0, 0.0
        for _ in range(PLATT_STEPS):
            off = (1 / (1 + np.exp(-np.clip(slope * x + bias, -40, 40))) - t) * n / n.sum()
            slope, bias = max(0.0, slope - PLATT_RATE * float((off * x).sum())), bias - PLATT_RATE * float(off.sum())
        out.append((concept, slope, bias))
    return spark.createDataFrame(out, "concept int, slope double, bias double")


def logistic(rows: DataFrame, steps: int = LOGISTIC_STEPS) -> DataFrame:
    """place, weight (place -1: bias) after full-batch steps over rows (x array, y target).

    The rows are written once as matrices, some thousand rows each; in a step each task sums the gradient of its
    matrices with NumPy, and one row a task comes to the driver."""
    spark = rows.sparkSession
    first = rows.select(F.size("x").alias("n")).first()
    width = first["n"] if first else 0
    if not width:
        return spark.createDataFrame([(-1, 0.0)], "place int, weight double")

    def matrices(batches):
        for batch in batches:
            x = np.stack([np.asarray(v, np.float64) for v in batch.column(0).to_pylist()])
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"x": [x.tobytes()], "y": [y.tobytes()]})

    blocks = cut(rows.select("x", "y").mapInArrow(matrices, "x binary, y binary"))
    weights, bias = np.zeros(width), 0.0
    for _ in range(steps):
        w, b = weights, bias

        def gradient(batches, w=w, b=b):
            total, count = np.zeros(len(w) + 1), 0
            for batch in batches:
                for xs, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    y = np.frombuffer(ys)
                    x = np.frombuffer(xs).reshape(len(y), -1)
                    off = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y
                    total += np.r_[off @ x, off.sum()]
                    count += len(y)
            yield pa.RecordBatch.from_pydict({"g": [total.tobytes()], "n": pa.array([count], pa.int64())})

        sums = blocks.mapInArrow(gradient, "g binary, n long").collect()
        g, n = sum(np.frombuffer(r["g"]) for r in sums), max(1, sum(r["n"] for r in sums))
        weights, bias = weights - LOGISTIC_RATE * (g[:-1] / n + LOGISTIC_L2 * weights), bias - LOGISTIC_RATE * g[-1] / n
    discard(blocks)
    return spark.createDataFrame([(-1, float(bias)), *enumerate(map(float, weights))], "place int, weight double")

"""Aggregate expressions of classification and retrieval measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def share(part: Column, whole: Column) -> Column:
    """part / whole; an empty whole counts as 1."""
    return F.when(whole == 0, 1.0).otherwise(part / whole.cast("double"))


def counts(truth: Column, predicted: Column) -> tuple[Column, Column, Column]:
    """Aggregates: true positives, false positives, false negatives."""
    return F.count_if(truth & predicted), F.count_if(~truth & predicted), F.count_if(truth & ~predicted)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def ranked_hits(rows: DataFrame, by: list[str], truth: str, score: str, tie: str) -> DataFrame:
    """rows with k, the rank by descending score, and hits, the positives down to it.

    A group is not sorted in one task: scores are dealt into bins of a thousandth, the bins' counts (a table of bounded
    size) are summed up, and rows are ranked inside their bin.
    """
    binned = rows.withColumn("_bin", -F.floor(F.col(score) * 1000))
    totals = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.count_if(truth).alias("_h"))
    above = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_bin", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"), F.coalesce(F.sum("_h").over(above), F.lit(0)).alias("_h"))
    inside = Window.partitionBy(*by, "_bin").orderBy(F.desc(score), tie)
    ranked = binned.join(starts, [*by, "_bin"]).withColumn("k", F.row_number().over(inside) + F.col("_n")).withColumn("hits", F.sum(F.col(truth).cast("bigint")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_h"))
    return ranked.drop("_bin", "_n", "_h")


def average_precision(rows: DataFrame, by: list[str], truth: str, score: str, tie: str) -> DataFrame:
    """Mean of the precision at each positive, by descending score; null without positives."""
    ranked = ranked_hits(rows.select(*by, truth, score, tie), by, truth, score, tie)
    return ranked.groupBy(*by).agg(F.avg(F.when(F.col(truth), F.col("hits") / F.col("k"))).alias("ap"))


def calibration_error(rows: DataFrame, by: list[str], score: str, target: str, bins: int = 10) -> DataFrame:
    """Expected difference of mean score and mean target over bins; the last one is closed."""
    binned = rows.withColumn("bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)))
    per = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(target).alias("t"))
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("t"))) / F.sum("n")).alias("ece"))


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


BINS = 1000


def nearest_rank(rows: DataFrame, by: list[str], value: str, share_of: float) -> DataFrame:
    """The value at place ceil(share * n) of the sorted ones. Values are dealt into bins of equal width; their counts (a
    table of bounded size a group) show the bin of the place, and only its distinct values are put in order."""
    rows = rows.where(F.col(value).isNotNull()).select(*by, value)
    bounds = rows.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_all"))
    place = F.least(F.coalesce(F.try_divide((F.col(value) - F.col("_low")) * BINS, F.col("_high") - F.col("_low")), F.lit(0.0)), F.lit(BINS - 1.0))
    counts = rows.join(bounds, by).groupBy(*by, "_all", F.floor(place).alias("_bin"), value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    bins = counts.groupBy(*by, "_all", "_bin").agg(F.sum("n").alias("n")).withColumn("_upto", F.sum("n").over(w.orderBy("_bin")))
    wanted = F.ceil(share_of * F.col("_all"))
    hit = bins.where(F.col("_upto") >= wanted).groupBy(*by).agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("n")).alias("_before"))).alias("h")).select(*by, "h._bin", "h._before")
    inside = counts.join(hit, [*by, "_bin"]).withColumn("_place", F.col("_before") + F.sum("n").over(w.orderBy(value)))
    return inside.where(F.col("_place") >= wanted).groupBy(*by).agg(F.min(value).alias(value))

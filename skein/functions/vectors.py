"""Vector arithmetic as column expressions: doubles throughout, no user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector over its norm; an error for zero or not finite norms."""
    size = norm(a)
    good = F.when((size > 0) & (size < float("inf")), size).otherwise(F.raise_error(F.lit("a vector has no finite norm")).cast("double"))
    return F.transform(a, lambda x: x / good)


def sigmoid(x: Column) -> Column:
    """Clipped at 40 on either side."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))


def ramp(similarity: Column, low: float = 0.20, high: float = 0.80) -> Column:
    """0 up to ``low``, 1 from ``high``, linear between, to six places."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity - low) / (high - low))), 6)


def centroids(vectors: DataFrame, by: str, of: str) -> DataFrame:
    """``by`` and centroid: the normalised mean, summed by place with partial sums."""
    places = vectors.select(by, F.posexplode(doubles(F.col(of))).alias("place", "x")).groupBy(by, "place").agg(F.avg("x").alias("x"))
    rows = places.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("r"))
    return rows.select(by, unit(F.transform("r", lambda p: p["x"])).alias("centroid"))


def base_score(similarity: Column, alignment: Column, relevance: Column, citation: Column) -> Column:
    """The weights of a concept-aware score."""
    return 0.55 * similarity + 0.25 * alignment + 0.15 * relevance + 0.05 * citation


def citation_quality(citation: Column, locator: Column, verified: Column) -> Column:
    """0.70 for a citation, 0.15 each for a locator and a verification; nothing without a citation."""
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(~said(citation), 0.0).otherwise(F.least(F.lit(1.0), 0.70 + F.when(said(locator), 0.15).otherwise(0.0) + F.when(verified, 0.15).otherwise(0.0)))


def rank_value(label: Column) -> Column:
    """A label's worth in ranking."""
    return F.when(label == "positive", 1.0).when(label == "partial", 0.65).otherwise(0.0)


def soft_target(label: Column) -> Column:
    """A label's worth as a target of calibration."""
    return F.when(label == "positive", 1.0).when(label == "partial", 0.5).otherwise(0.0)


def hybrid(positive: Column, negative: Column, lexical: Column, embed: float = 0.9, penalty: float = 0.5, weight: float = 0.2) -> Column:
    return embed * (positive - penalty * negative) + weight * lexical

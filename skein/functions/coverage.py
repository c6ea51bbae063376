"""How well evidence covers a question: component scores and statuses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the six components, the target of evidence, the penalties, the thresholds.
ACTIVATION, EVIDENCE, DOMAINS, CITATION, CONFIDENCE, UNSUPPORTED = 25.0, 20.0, 20.0, 15.0, 10.0, 10.0
TARGET_EVIDENCE = 9
UNSUPPORTED_PENALTY, INSUFFICIENT_PENALTY = 6.0, 4.0
SUPPORTED, PARTIAL = 70.0, 40.0
LEAST_WEIGHT = 0.01


def within(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def confidence(scores: Column, activation: Column, domains: Column, evidence: Column, n_domains: int) -> Column:
    """The mean score where there are scores, else a proxy of activation, domains and evidence."""
    proxy = 0.50 * activation + 0.30 * domains / n_domains + 0.20 * F.least(F.lit(1.0), evidence / n_domains)
    return F.round(F.coalesce(scores, within(proxy)), 6)


def components(activation: Column, evidence: Column, domains: Column, citation: Column, trust: Column, unsupported: Column, insufficient: Column, n_domains: int) -> dict[str, Column]:
    left = UNSUPPORTED - F.when(unsupported, UNSUPPORTED_PENALTY).otherwise(0.0) - F.when(insufficient, INSUFFICIENT_PENALTY).otherwise(0.0)
    return {
        "activation_part": F.round(within(activation) * ACTIVATION, 4),
        "evidence_part": F.round(F.least(F.lit(1.0), evidence / TARGET_EVIDENCE) * EVIDENCE, 4),
        "domain_part": F.round(domains / n_domains * DOMAINS, 4),
        "citation_part": F.round(within(citation) * CITATION, 4),
        "confidence_part": F.round(within(trust) * CONFIDENCE, 4),
        "unsupported_part": F.round(F.greatest(F.lit(0.0), left), 4),
    }


def concept_status(score: Column, evidence: Column, claims: Column, domains: Column, insufficient: Column) -> Column:
    """By score; nothing without evidence or claims; at most partial for one domain or insufficient comparison."""
    limited = (domains <= 1) | insufficient
    return F.when((evidence == 0) | (claims == 0), "Unsupported").when((score >= SUPPORTED) & ~limited, "Supported").when(score >= PARTIAL, "Partially Supported").otherwise("Unsupported")


def overall_score(score: Column, weight: Column) -> Column:
    """Aggregate: the mean by activation, no weight under 0.01."""
    w = F.greatest(weight, F.lit(LEAST_WEIGHT))
    return F.round(F.sum(score * w) / F.sum(w), 2)


def overall_status(score: Column, evidence: Column, domains: Column, n: Column, n_supported: Column, n_unsupported: Column) -> Column:
    outside = (n == 0) | (evidence == 0) | (domains == 0) | (n_unsupported == n)
    return F.when(outside, "Out of Corpus").when((score >= SUPPORTED) & (n_supported == n) & (domains > 1), "Supported").when(score >= PARTIAL, "Partially Supported").otherwise("Out of Corpus")

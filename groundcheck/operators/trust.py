"""Trust in a response from its claims' labels, similarity, severity, consistency and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.functions import scores as S, text as X
from groundcheck.schema import RESPONSE_KEY


def trust_scores(facts: DataFrame, consistency: DataFrame, key: list[str] = RESPONSE_KEY, policy: S.TrustPolicy = S.TrustPolicy()) -> DataFrame:
    """One row per response with claims and a consistency score: the score, its parts and rationale.

    ``facts`` has one row per claim with ``label, similarity, severity,
    confidence``; confidence is compared with the label being supported and is
    left out, counting 0, where there is none.  Similarities, confidences and
    consistency scores must be in [0, 1].
    """
    parts = checked(facts).groupBy(*key).agg(*signals(policy))
    joined = parts.join(consistency.select(*key, S.checked_unit(F.col("consistency_score"), "consistency_score").alias("consistency_score")), key)
    return joined.withColumns({"trust_score": trust_formula(policy.weights), "trust_rationale": rationale()})


def checked(facts: DataFrame) -> DataFrame:
    """``facts``, whose similarities and confidences must be null or in [0, 1]."""
    return facts.withColumns({c: S.checked_unit(F.col(c), c) for c in ("similarity", "confidence")})


def signals(policy: S.TrustPolicy = S.TrustPolicy()) -> list[Column]:
    """What a response's claims say of it, as aggregates."""
    hundredths = {k: round(100 * v) for k, v in policy.penalties.items()}  # whole numbers sum the same in any order
    right = (F.col("label") == "supported").cast("double")
    return [
        F.avg(right).alias("factual_score"),
        F.avg("similarity").alias("semantic_alignment"),
        F.avg(1 - F.abs(F.col("confidence") - right)).alias("confidence_calibration"),
        F.least(F.lit(1.0), F.coalesce(F.sum(S.by_severity(F.col("severity"), hundredths)), F.lit(0)) / (100 * F.count("*"))).alias("severity_penalty"),
        F.count("*").alias("claim_count"),
    ]


def trust_formula(weights: tuple[float, ...] = S.TRUST_WEIGHTS) -> Column:
    signals = ("factual_score", "semantic_alignment", "consistency_score")
    total = sum((w * F.col(c) for w, c in zip(weights, signals)), F.lit(0.0)) + weights[3] * F.coalesce("confidence_calibration", F.lit(0.0))
    return S.clamp_unit(total - F.col("severity_penalty"))


def rationale() -> Column:
    three = lambda c: X.three(F.round(c, 12))  # the last bits of a sum depend on its order
    return F.concat(
        F.lit("Factual="), three("factual_score"), F.lit("; semantic="), three("semantic_alignment"), F.lit("; consistency="), three("consistency_score"),
        F.lit("; confidence calibration="), F.coalesce(three("confidence_calibration"), F.lit("unavailable")), F.lit("; severity penalty="), three("severity_penalty"), F.lit("."),
    )

"""Claim verification: adjusted scores of every passage, the best of them, the label and its reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.functions import scores as S, text as X


def evidence_scores(hits: Column, similarity: Callable[[Column], Column], nli: Callable[[Column], Column]) -> Column:
    """Per hit the similarity, the entailment probabilities and their products with the retrieval score.

    ``similarity`` and ``nli`` are built from a hit; ``nli`` yields a struct of
    ``entailment, contradiction, neutral``.
    """
    seen = F.transform(hits, lambda h: F.struct(h.alias("h"), similarity(h).alias("s"), nli(h).alias("p")))

    def scored(x: Column) -> Column:
        h, s, p = x["h"], x["s"], x["p"]
        product = lambda c: c * h["combined_score"] * s
        return F.struct(
            h["evidence_id"].alias("evidence_id"), h["rank"].alias("rank"), h["combined_score"].alias("retrieval_score"), s.alias("similarity"),
            p["entailment"].alias("entailment_probability"), p["contradiction"].alias("contradiction_probability"), p["neutral"].alias("neutral_probability"),
            product(p["entailment"]).alias("support_score"), product(p["contradiction"]).alias("contradiction_score"), product(p["neutral"]).alias("neutral_score"),
        )

    return F.transform(seen, scored)


def _best(field: str) -> Column:
    return F.coalesce(F.array_max(F.transform("evidence_scores", lambda x: x[field])), F.lit(0.0))


def _first_best(field: str) -> Column:
    """The id of the passage of greatest score; of equal ones the first."""
    return F.array_max(F.transform("evidence_scores", lambda x: F.struct(x[field], -x["rank"], x["evidence_id"].alias("id"))))["id"]


def verify(scored: DataFrame, support_threshold: float = S.SUPPORT_THRESHOLD, contradiction_threshold: float = S.CONTRADICTION_THRESHOLD) -> DataFrame:
    """Rows with ``evidence_scores`` get the best scores, ``label`` and ``verification_reason``; no shuffle."""
    for name, value in (("support_threshold", support_threshold), ("contradiction_threshold", contradiction_threshold)):
        if not 0 <= value <= 1:
            raise ValueError(f"{name} must be in [0, 1]")
    out = scored.withColumns({c: _best(c) for c in ("similarity", "support_score", "contradiction_score", "neutral_score")})
    out = out.withColumn("label", S.label(F.col("support_score"), F.col("contradiction_score"), support_threshold, contradiction_threshold))
    quote = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    support, against = X.three(F.col("support_score")), X.three(F.col("contradiction_score"))
    reason = (
        F.when(F.size("evidence_scores") == 0, "No evidence passages were retrieved for this claim.")
        .when(F.col("label") == "supported", F.concat(F.lit("Evidence "), quote(_first_best("support_score")), F.lit(" most strongly entails the claim (adjusted support score "), support, F.lit(").")))
        .when(F.col("label") == "contradicted", F.concat(F.lit("Evidence "), quote(_first_best("contradiction_score")), F.lit(" most strongly contradicts the claim (adjusted contradiction score "), against, F.lit(").")))
        .otherwise(F.concat(F.lit("Retrieved evidence did not produce a decisive entailment or contradiction score (support "), support, F.lit("; contradiction "), against, F.lit(").")))
    )
    return out.withColumn("verification_reason", reason)


def assess_severity(verified: DataFrame, threshold: float | None = None, centrality: Column | float = 0.0, policy: S.SeverityPolicy = S.SeverityPolicy()) -> DataFrame:
    """Rows with ``claim_text, label, contradiction_score`` get ``severity, risk_domains, severity_reason``.

    ``threshold`` is the policy's unless given; it, centralities and scores must be in [0, 1].
    """
    threshold = policy.high_contradiction if threshold is None else threshold
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")
    if not isinstance(centrality, Column) and not 0 <= centrality <= 1:
        raise ValueError("centrality must be in [0, 1]")
    centrality = S.checked_unit(centrality, "centrality") if isinstance(centrality, Column) else centrality
    unsupported, text = F.col("label") != "supported", F.col("claim_text")
    out = verified.withColumns({"risk_domains": F.when(unsupported, S.risk_domains(text, policy.domains)).otherwise(F.array().cast("array<string>")), "_advice": S.gives_advice(text, policy.advice)})
    level, reason = S.severity(F.col("label"), S.checked_unit(F.col("contradiction_score"), "contradiction_score"), F.col("risk_domains"), F.col("_advice"), centrality, threshold, policy)
    return out.withColumns({"severity": level, "severity_reason": reason}).drop("_advice")


def baseline_verify(ranked: DataFrame, threshold: float = 0.25) -> DataFrame:
    """The lexical baseline: claims with ``hits`` get ``similarity`` (the best overlap of a hit) and ``label``.

    A claim is supported when its similarity is strictly above the threshold,
    else unknown.  Hits carry their overlap (``rank_passages(overlap=True)``), so
    nothing is joined or shuffled.
    """
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["overlap"])), F.lit(0.0))
    return ranked.withColumn("similarity", best).withColumn("label", F.when(F.col("similarity") > threshold, "supported").otherwise("unknown"))

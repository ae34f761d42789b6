"""Types of the engine's tables: enums as checked strings, explicit structs for reads."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values, in the order in which they are reported and compared.
LABELS = ("supported", "contradicted", "unknown")
SEVERITIES = ("mild", "moderate", "severe", "critical")

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PROMPTS = struct(dataset_item_id=_S, domain=_S, topic=_S, task_type=_S, risk_level=_S, prompt=_S, reference_evidence_ids=T.ArrayType(_S))
EVIDENCE = struct(evidence_id=_S, domain=_S, topic=_S, text=_S, source=_S, source_url=_S, publication_date=_S)
RESPONSES = struct(model_name=_S, dataset_item_id=_S, text=_S, confidence=_D)
ANNOTATIONS = struct(
    schema_version=_I, annotation_status=_S, annotator_id=_S, claim_review_status=_S, model_name=_S, dataset_item_id=_S,
    claim_id=_S, claim_text=_S, claim_start=_I, claim_end=_I, verification_label=_S, evidence_ids=T.ArrayType(_S), severity=_S, rationale=_S,
)

#: One ranked passage of a claim.
HIT = struct(pos=T.LongType(), evidence_id=_S, bm25_score=_D, embedding_score=_D, combined_score=_D, rank=_I)

_SCORED = struct(evidence=struct(id=_S), retrieval_score=_D, similarity=_D, support_score=_D, contradiction_score=_D)
_FOUND = struct(evidence=struct(id=_S), bm25_score=_D, embedding_score=_D, combined_score=_D, rank=_I)
_VERIFIED = struct(claim=struct(id=_S, text=_S, start=_I, end=_I), label=_S, similarity=_D, support_score=_D, contradiction_score=_D, explanation=_S, evidence_scores=T.ArrayType(_SCORED))
_CLAIM = struct(verification=_VERIFIED, severity=struct(severity=_S, risk_domains=T.ArrayType(_S), rationale=_S), retrieved_evidence=T.ArrayType(_FOUND))
#: What is read of a saved report.
REPORT = struct(
    schema_version=_I, dataset_item_ids=T.ArrayType(_S), responses=T.ArrayType(struct(response=RESPONSES, claims=T.ArrayType(_CLAIM), trust_score=_D)),
    model_metrics=T.ArrayType(struct(model_name=_S)), paired_comparisons=T.ArrayType(struct(model_a=_S, model_b=_S)),
)

CLAIM_KEY = ["model_name", "dataset_item_id", "claim_id"]
RESPONSE_KEY = ["model_name", "dataset_item_id"]

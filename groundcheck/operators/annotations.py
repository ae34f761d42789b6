"""Human annotations: rule checks, agreement, gold tables and worksheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundcheck.functions.text import is_blank
from groundcheck.operators.rules import Rule, violations
from groundcheck.schema import CLAIM_KEY, LABELS, SEVERITIES

TEXTS = ("annotator_id", "annotation_status", "model_name", "dataset_item_id", "claim_id", "claim_text", "rationale")


def annotation_rules(status: str) -> list[Rule]:
    """Checks of one record against itself and the claim it names (``found_*``)."""
    c = F.col
    ids = c("evidence_ids")
    return [
        Rule("schema_version", ~c("schema_version").eqNullSafe(1)),
        *(Rule(f"{t} is blank", is_blank(c(t))) for t in TEXTS),
        Rule("claim not reviewed", ~c("claim_review_status").eqNullSafe("accepted")),
        Rule("invalid offset", c("claim_start").isNull() | c("claim_end").isNull() | (c("claim_start") < 0) | (c("claim_end") < 0)),
        Rule("invalid label", ~F.coalesce(c("verification_label").isin(*LABELS), F.lit(False))),
        Rule("invalid severity", c("severity").isNotNull() & ~c("severity").isin(*SEVERITIES)),
        Rule("severity on supported claim", (c("verification_label") == "supported") & c("severity").isNotNull()),
        Rule("severity missing", c("verification_label").isin("contradicted", "unknown") & c("severity").isNull()),
        Rule("evidence ids missing or blank", ids.isNull() | F.exists(F.coalesce(ids, F.array()), lambda x: is_blank(x))),
        Rule("evidence ids repeat", F.size(F.array_distinct(ids)) < F.size(ids)),
        Rule("unknown evidence id", c("unknown_ids") > 0),
        Rule("wrong status", ~c("annotation_status").eqNullSafe(status)),
        Rule("unknown claim", c("found_text").isNull()),
        Rule("claim text or offsets differ", c("found_text").isNotNull() & ~((c("claim_text") == c("found_text")) & (c("claim_start") == c("found_start")) & (c("claim_end") == c("found_end")))),
        Rule("repeated claim key", c("copies") > 1),
        Rule("several annotators", c("annotators") > 1),
    ]


def validate_annotations(annotations: DataFrame, claims: DataFrame, evidence: DataFrame, status: str = "adjudicated") -> DataFrame:
    """``CLAIM_KEY, rule`` of every rule that a record breaks.

    ``claims`` are those extracted from the responses; ids are looked up by
    joins, so neither side has to be small.
    """
    found = claims.select(*CLAIM_KEY, F.col("claim_text").alias("found_text"), F.col("claim_start").alias("found_start"), F.col("claim_end").alias("found_end"))
    # a record's first place, or its only one without ids, counts the record
    named = annotations.select(*CLAIM_KEY, F.posexplode_outer("evidence_ids").alias("place", "evidence_id"))
    known = evidence.select("evidence_id").distinct().withColumn("known", F.lit(True))
    first, unknown = F.coalesce(F.col("place") == 0, F.lit(True)), F.col("place").isNotNull() & F.col("evidence_id").isNotNull() & F.col("known").isNull()
    tally = named.join(known, "evidence_id", "left").groupBy(*CLAIM_KEY).agg(F.count_if(first).alias("copies"), F.count_if(unknown).alias("unknown_ids"))
    annotators = annotations.agg(F.count_distinct("annotator_id").alias("annotators"))
    rows = annotations.join(tally, CLAIM_KEY).join(found, CLAIM_KEY, "left").crossJoin(F.broadcast(annotators))  # one row
    return violations(rows, annotation_rules(status), CLAIM_KEY)


def gold_table(annotations: DataFrame) -> DataFrame:
    """``CLAIM_KEY, gold_label, gold_severity, evidence_ids`` of adjudicated records."""
    return annotations.select(*CLAIM_KEY, F.col("verification_label").alias("gold_label"), F.col("severity").alias("gold_severity"), "evidence_ids")


def incomplete(annotations: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims without a record; a complete gold set has none."""
    return claims.select(*CLAIM_KEY).join(annotations.select(*CLAIM_KEY), CLAIM_KEY, "left_anti")


def unmatched(first: DataFrame, second: DataFrame) -> DataFrame:
    """Claims that only one of two annotators has."""
    a, b = first.select(*CLAIM_KEY), second.select(*CLAIM_KEY)
    return a.join(b, CLAIM_KEY, "left_anti").withColumn("only", F.lit("first")).unionByName(b.join(a, CLAIM_KEY, "left_anti").withColumn("only", F.lit("second")))


def label_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both annotators' labels of every claim."""
    return first.select(*CLAIM_KEY, F.col("label").alias("first_label")).join(second.select(*CLAIM_KEY, F.col("label").alias("second_label")), CLAIM_KEY)


def agreement(pairs: DataFrame) -> DataFrame:
    """Claims, exact agreement and Cohen's kappa (null where expected agreement is 1)."""
    counts = pairs.groupBy("first_label", "second_label").agg(F.count("*").alias("n"))  # nine cells at most
    a = counts.groupBy(F.col("first_label").alias("label")).agg(F.sum("n").alias("a"))
    b = counts.groupBy(F.col("second_label").alias("label")).agg(F.sum("n").alias("b"))
    both = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("first_label") == F.col("second_label"), F.col("n")).otherwise(0)).alias("same"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0)).alias("chance"))
    observed, expected = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return both.crossJoin(chance).where("n > 0").select(F.col("n").alias("claim_count"), observed.alias("exact_agreement"), F.when(expected != 1, (observed - expected) / F.nullif(1 - expected, F.lit(0.0))).alias("cohen_kappa"))


def worksheet(claims: DataFrame, prompts: DataFrame, evidence: DataFrame, annotator: str) -> DataFrame:
    """One empty annotation per claim with its prompt and the passages the prompt refers to, in their order."""
    if not annotator.strip():
        raise ValueError("annotator must not be blank")
    refs = prompts.select("dataset_item_id", F.posexplode("reference_evidence_ids").alias("k", "evidence_id")).join(evidence.select("evidence_id", F.col("text").alias("evidence_text"), "source"), "evidence_id")
    gathered = refs.groupBy("dataset_item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "evidence_id", "evidence_text", "source"))), lambda x: F.struct(x["evidence_id"], x["evidence_text"].alias("text"), x["source"])).alias("evidence_candidates"))
    blank = {"schema_version": F.lit(1), "annotation_status": F.lit("independent"), "annotator_id": F.lit(annotator), "claim_review_status": F.lit("pending"), "verification_label": F.lit(None).cast("string"), "severity": F.lit(None).cast("string"), "evidence_ids": F.array().cast("array<string>"), "rationale": F.lit("")}
    return claims.withColumns(blank).join(prompts.drop("reference_evidence_ids"), "dataset_item_id").join(gathered, "dataset_item_id", "left")

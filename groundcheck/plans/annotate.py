"""Worksheets for annotators and checks of what they return."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundcheck.operators import annotations as A, rules
from groundcheck.plans.evaluate import check_matrix
from groundcheck.plans.fixtures import extract
from groundcheck.plans.gates import load_gold
from groundcheck.schema import ANNOTATIONS, CLAIM_KEY
from groundcheck.sources import files
from groundcheck.sources.benchmark import Benchmark, read_table


def export_worksheet(responses: DataFrame, benchmark: Benchmark, path: str, annotator: str, allow_unfrozen: bool = False) -> int:
    """Write one empty annotation per claim; a worksheet that exists is never replaced.

    Responses must be complete; items and models go in order of first appearance.
    """
    if Path(path).exists():
        raise FileExistsError(path)
    if not benchmark.is_frozen and not allow_unfrozen:
        raise ValueError("freeze the benchmark before exporting worksheets")
    check_matrix(responses)
    rules.require(responses.select("dataset_item_id").distinct().join(benchmark.prompts, "dataset_item_id", "left_anti").withColumn("rule", F.lit("response to an unknown item")))
    claims = extract(responses.select("model_name", "dataset_item_id", "text", F.col("text").alias("response_text")))
    prompts = benchmark.prompts.select("dataset_item_id", "prompt", "domain", "topic", "task_type", "risk_level", "reference_evidence_ids")
    sheet = A.worksheet(claims, prompts, benchmark.evidence, annotator).orderBy("dataset_item_id", "model_name", "ordinal").drop("ordinal")
    count = 0
    with files.atomic(path) as f:
        for r in sheet.toLocalIterator():
            f.write(json.dumps(r.asDict(recursive=True), ensure_ascii=False) + "\n")
            count += 1
    return count


def compare_annotators(spark: SparkSession, first: str, second: str, responses: DataFrame, evidence: DataFrame) -> dict[str, Any]:
    """Agreement of two independent annotators over the same claims, and the claims on which they differ."""
    claims = extract(responses)
    tables = []
    for path in (first, second):
        rows = read_table(spark, path, ANNOTATIONS)
        rules.require(A.validate_annotations(rows, claims, evidence, "independent"))
        tables.append(rows.select(*CLAIM_KEY, F.col("verification_label").alias("label")))
    rules.require(A.unmatched(*tables).withColumn("rule", F.lit("annotated by one only")))
    pairs = A.label_pairs(*tables)
    differ = pairs.where("first_label <> second_label").orderBy(*CLAIM_KEY).collect()
    return {**A.agreement(pairs).first().asDict(), "disagreements": [tuple(r[k] for k in CLAIM_KEY) for r in differ]}


def gold_summary(spark: SparkSession, path: str, responses: DataFrame, evidence: DataFrame) -> dict[str, Any]:
    """Label and severity tallies of adjudicated annotations, and how many claims have none."""
    gold = load_gold(spark, path, responses, evidence)
    tally = lambda c: {r[0]: r[1] for r in gold.where(F.col(c).isNotNull()).groupBy(c).count().collect()}
    return {"labels": tally("gold_label"), "severities": tally("gold_severity"), "claims_without": A.incomplete(gold, extract(responses)).count()}

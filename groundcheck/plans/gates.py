"""Split manifests, calibration artifacts, the locked-test gate, release packages and readiness."""

from __future__ import annotations

import math
from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundcheck.functions import scores as S
from groundcheck.operators import annotations as A, calibration as C, retrieval, rules
from groundcheck.plans.fixtures import extract
from groundcheck.schema import ANNOTATIONS, CLAIM_KEY, LABELS, SEVERITIES
from groundcheck.session import cut, kept
from groundcheck.sources import files
from groundcheck.sources.benchmark import Benchmark, evidence_ids, load_benchmark, read_table
from groundcheck.sources.jsonl import read_responses
from groundcheck.sources.report import load_report, report_facts

SPLITS = ("train", "dev", "test")


def _now() -> str:
    return datetime.now(UTC).isoformat()


def write_split(benchmark: Benchmark, path: str, dataset: str, development: float = 0.2, test: float = 0.2, seed: int = 42) -> dict[str, Any]:
    """Assign whole topics to splits and write the manifest; an existing one is never replaced."""
    if Path(path).exists():
        raise FileExistsError(path)
    rows = C.topic_split(benchmark.prompts.select("dataset_item_id", "topic"), development, test, seed).collect()
    topics = {r.topic: r.split for r in rows}
    counts = {s: sum(v == s for v in topics.values()) for s in SPLITS}
    manifest = {
        "schema_version": 1, "dataset": dataset, "seed": seed, "development_fraction": development, "test_fraction": test, "prompt_sha256": benchmark.prompt_sha256, "evidence_sha256": benchmark.evidence_sha256,
        "topic_splits": dict(sorted(topics.items())), "item_splits": {r.dataset_item_id: r.split for r in sorted(rows, key=lambda r: r.dataset_item_id)}, "topic_counts": counts, "created_at_utc": _now(),
    }
    files.write_object(path, manifest)
    return manifest


def check_split(split: dict[str, Any], prompt_sha256: str, evidence_sha256: str, items: set[str] | None = None) -> dict[str, str]:
    """The items' splits of a manifest that belongs to the benchmark."""
    if split.get("schema_version") != 1:
        raise ValueError("the split manifest must have schema_version 1")
    if (split.get("prompt_sha256"), split.get("evidence_sha256")) != (prompt_sha256, evidence_sha256):
        raise ValueError("the split manifest's hashes are not the benchmark's")
    named = split.get("item_splits")
    if not isinstance(named, dict):
        raise ValueError("the split manifest has no item_splits")
    if items is not None and set(named) != items:
        raise ValueError("the split manifest does not cover exactly the benchmark's items")
    if any(v not in SPLITS for v in named.values()):
        raise ValueError("the split manifest has an invalid split")
    topics = split.get("topic_splits", {})
    if not isinstance(topics, dict) or any(v not in SPLITS for v in topics.values()):
        raise ValueError("the split manifest has an invalid split of topics")
    return named


def item_ids(benchmark: Benchmark) -> set[str]:
    """The benchmark's items, which a split manifest lists one by one as well."""
    return {r[0] for r in benchmark.prompts.select("dataset_item_id").collect()}


def load_gold(spark: SparkSession, path: str, responses: DataFrame, evidence: DataFrame, complete: bool = False) -> DataFrame:
    """Adjudicated annotations as a gold table; every rule must hold.

    Lines are parsed and claims extracted once, before the checks, which read what was kept.
    """
    rows = cut(read_table(spark, path, ANNOTATIONS))
    claims = kept(extract(responses).select(*CLAIM_KEY, "claim_text", "claim_start", "claim_end"), "claims")
    rules.require(A.validate_annotations(rows, claims, evidence))
    if complete:
        rules.require(A.incomplete(rows, claims).withColumn("rule", F.lit("no annotation")))
    return A.gold_table(rows)


def fit_thresholds(facts: DataFrame, gold: DataFrame, development: DataFrame, benchmark: Benchmark, split: dict[str, Any], provenance: dict[str, str], path: str, step: float = 0.05, objective: str = "macro_f1") -> dict[str, Any]:
    """Choose thresholds on development items by cached scores and write the artifact.

    ``facts`` come from a saved evaluation; their claims and those of ``gold``
    must be the same.  A labelled claim that the chosen thresholds call
    supported has no severity, which is an error.
    """
    if Path(path).exists():
        raise FileExistsError(path)
    if not benchmark.is_frozen:
        raise ValueError("freeze the benchmark before fitting thresholds")
    for a, b in ((facts, gold), (gold, facts)):
        rules.require(a.select(*CLAIM_KEY).join(b.select(*CLAIM_KEY), CLAIM_KEY, "left_anti").withColumn("rule", F.lit("report and gold claims differ")))
    C.check_observations(facts.select(*CLAIM_KEY, "support_score", "contradiction_score"), CLAIM_KEY)
    rules.require(rules.repeated(gold, CLAIM_KEY, "repeated gold label"))
    rows = facts.join(gold, CLAIM_KEY).join(development.select("dataset_item_id"), "dataset_item_id", "left_semi")
    values = C.threshold_grid(step)
    best = C.best_verification_thresholds(C.verification_grid(rows, values), objective).first()
    if best is None:
        raise ValueError("no development claims")
    relabelled = rows.withColumn("label", S.label(F.col("support_score"), F.col("contradiction_score"), best.support_threshold, best.contradiction_threshold))
    rules.require(relabelled.where(F.col("gold_severity").isNotNull() & (F.col("label") == "supported")).select(*CLAIM_KEY, F.lit("no predicted severity").alias("rule")))
    high = C.best_severity_threshold(C.severity_grid(relabelled, values)).first()
    if high is None:
        raise ValueError("no development claims with a severity")
    level, _ = S.severity(F.col("label"), F.col("contradiction_score"), S.risk_domains(F.col("claim_text")), S.gives_advice(F.col("claim_text")), 0.0, high.threshold)
    cells = C.confusion(relabelled.where(F.col("gold_severity").isNotNull()).select(F.col("gold_severity").alias("gold"), level.alias("predicted")), []).collect()
    matrix = [[next(r.n for r in cells if (r.gold, r.predicted) == (a, b)) for b in SEVERITIES] for a in SEVERITIES]
    ranked = retrieval.ranking_metrics(retrieval.retrieved(rows.select(*CLAIM_KEY, "hits"), CLAIM_KEY), gold.where(F.size("evidence_ids") > 0), CLAIM_KEY, (1, 3, 5)).join(gold.where(F.size("evidence_ids") > 0).select(*CLAIM_KEY), CLAIM_KEY, "left_semi")
    recall = ranked.agg(*(F.avg(f"recall_at_{k}").alias(str(k)) for k in (1, 3, 5))).first().asDict()
    items = sorted(r[0] for r in development.select("dataset_item_id").distinct().collect())
    artifact = {
        "schema_version": 1, "created_at_utc": _now(), "development_item_ids": items, "development_topics": sorted(t for t, s in split.get("topic_splits", {}).items() if s == "dev"), "development_claim_count": best.sample_size,
        "verification": {**best.asDict(), "objective": objective, "objective_score": best[objective], "candidates_evaluated": len(values) ** 2},
        "severity": {"high_contradiction_threshold": high.threshold, "accuracy": high.accuracy, "macro_f1": high.macro_f1, "quadratic_weighted_kappa": high.quadratic_weighted_kappa, "sample_size": high.sample_size, "labels": list(SEVERITIES), "confusion_matrix": matrix},
        "retrieval_recall_at_k": recall, "provenance": {"prompt_sha256": benchmark.prompt_sha256, "evidence_sha256": benchmark.evidence_sha256, **provenance},
    }
    files.write_object(path, artifact)
    return artifact


def calibrate(spark: SparkSession, report: str, responses: str, annotations: str, prompts: str, evidence: str, split: str, path: str, step: float = 0.05, objective: str = "macro_f1") -> dict[str, Any]:
    """Fit thresholds on the development items from the scores in a saved report, and write the artifact."""
    if Path(path).exists():
        raise FileExistsError(path)
    benchmark, named = load_benchmark(spark, prompts, evidence), files.read_object(split)
    splits = check_split(named, benchmark.prompt_sha256, benchmark.evidence_sha256, item_ids(benchmark))
    if not isinstance(named.get("topic_splits"), dict):
        raise ValueError("the split manifest has no topic_splits")
    items = sorted(k for k, v in splits.items() if v == "dev")
    if not items:
        raise ValueError("the split has no development items")
    rows = cut(read_responses(spark, responses))
    if rows.isEmpty():
        raise ValueError("there are no responses")
    gold = load_gold(spark, annotations, rows, benchmark.evidence, complete=True)
    development = spark.createDataFrame([(i,) for i in items], "dataset_item_id string")
    made = {"split_manifest_sha256": files.sha256(split), "evaluation_report_sha256": files.sha256(report), "annotations_sha256": files.sha256(annotations)}
    return fit_thresholds(kept(report_facts(spark, report), "report-facts"), gold, development, benchmark, named, made, path, step, objective)


def locked_thresholds(spark: SparkSession, prompts: str, evidence: str, manifest: str, split: str, calibration: str, responses: str, annotations: str) -> dict[str, float]:
    """The calibrated thresholds, if every artifact is there and the chain from benchmark to annotations holds."""
    absent = files.missing((prompts, evidence, manifest, split, calibration, responses, annotations))
    if absent:
        raise FileNotFoundError(f"missing {absent[0]}")
    frozen = files.read_object(manifest)
    hashes = files.sha256(prompts), files.sha256(evidence)
    if frozen.get("schema_version") != 1 or not isinstance(frozen.get("files"), dict):
        raise ValueError("the benchmark manifest needs schema_version 1 and file hashes")
    for path, digest in zip((prompts, evidence), hashes):
        if frozen["files"].get(Path(path).name) != digest:
            raise ValueError(f"{Path(path).name} differs from the freeze manifest")
    named = check_split(files.read_object(split), *hashes)
    test = {k for k, v in named.items() if v == "test"}
    if not test:
        raise ValueError("the split has no test items")
    fitted = files.read_object(calibration)
    made = fitted.get("provenance")
    if fitted.get("schema_version") != 1 or not isinstance(made, dict):
        raise ValueError("the calibration needs schema_version 1 and provenance")
    if (made.get("prompt_sha256"), made.get("evidence_sha256")) != hashes:
        raise ValueError("the calibration's hashes are not the benchmark's")
    if made.get("split_manifest_sha256") != files.sha256(split):
        raise ValueError("the calibration was fitted with another split")
    shared = test & set(fitted.get("development_item_ids", []))
    if shared:
        raise ValueError(f"development and test items overlap: {sorted(shared)}")
    found = {}
    for name, part, key in (("support_threshold", "verification", "support_threshold"), ("contradiction_threshold", "verification", "contradiction_threshold"), ("severity_contradiction_threshold", "severity", "high_contradiction_threshold")):
        value = fitted.get(part, {}).get(key) if isinstance(fitted.get(part), dict) else None
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"the calibration has no numeric {name}")
        if not math.isfinite(value) or not 0 <= value <= 1:
            raise ValueError(f"{name} is outside [0, 1]")
        found[name] = float(value)
    rows = cut(read_responses(spark, responses))
    items = spark.createDataFrame([(i,) for i in sorted(test)], "dataset_item_id string")
    rules.require(items.join(rows, "dataset_item_id", "left_anti").withColumn("rule", F.lit("test item without response")))
    gold = load_gold(spark, annotations, rows, evidence_ids(spark, evidence), complete=True)
    if gold.join(items, "dataset_item_id", "left_semi").isEmpty():
        raise ValueError("the annotations have no test claims")
    return found


# The columns of the released tables.
MODEL_FIELDS = (
    "model_name", "response_count", "dataset_item_count", "claim_count", "supported_rate", "contradicted_rate", "unknown_rate", "hallucination_rate", "severity_weighted_error_rate", "average_trust_score",
    "verification_accuracy", "verification_macro_f1", "retrieval_recall_at_k", "confidence_brier_score", "confidence_ece",
)
COMPARISON_FIELDS = (
    "model_a", "model_b", "paired_item_count", "supported_rate_difference", "mcnemar_exact_p_value", "model_a_error_only_items", "model_b_error_only_items", "supported_rate_difference_lower", "supported_rate_difference_upper",
)


def summarise(report: dict[str, Any]) -> dict[str, Any]:
    """Model and comparison tables of a report and sums over its models; intervals are kept."""
    models = [{k: m.get(k) for k in (*MODEL_FIELDS, "retrieval_k")} for m in report["model_metrics"]]
    total = lambda k: sum(m.get(k) or 0 for m in report["model_metrics"])
    return {
        "schema_version": 1, "dataset_item_count": len(report["dataset_item_ids"]), "model_count": len(models), "total_responses": total("response_count"), "total_claims": total("claim_count"),
        **{f"total_{k}": total(f"{k}_count") for k in LABELS}, "models": models, "paired_comparisons": [dict(c) for c in report["paired_comparisons"]],
    }


def package_release(report: str, folder: str, provenance: Iterable[str] = ()) -> dict[str, Any]:
    """Summary, two CSV tables and a manifest of hashes in a new or empty folder."""
    out = Path(folder)
    provenance = list(provenance)
    absent = files.missing([report, *provenance])
    if absent:
        raise FileNotFoundError(f"missing {absent[0]}")
    if out.exists() and any(out.iterdir()):
        raise FileExistsError(f"{folder} is not empty")
    summary = summarise(load_report(Path(report).read_bytes()))
    out.mkdir(parents=True, exist_ok=True)
    files.write_csv(out / "model_metrics.csv", MODEL_FIELDS, summary["models"])
    rows = []
    for c in summary["paired_comparisons"]:
        interval = c.get("supported_rate_difference") or {}
        rows.append({**c, "supported_rate_difference": interval.get("mean_difference"), "supported_rate_difference_lower": interval.get("lower"), "supported_rate_difference_upper": interval.get("upper")})
    files.write_csv(out / "paired_comparisons.csv", COMPARISON_FIELDS, rows)
    files.write_object(out / "research_summary.json", summary)
    made = {"evaluation_report": str(Path(report).resolve()), "evaluation_report_sha256": files.sha256(report)}
    for p in provenance:
        made |= {Path(p).name: str(Path(p).resolve()), f"{Path(p).name}_sha256": files.sha256(p)}
    names = ("research_summary.json", "model_metrics.csv", "paired_comparisons.csv")
    manifest = {"schema_version": 1, "created_at_utc": _now(), "report": made, "files": {n: files.sha256(out / n) for n in names}}
    files.write_object(out / "release_manifest.json", manifest)
    return manifest


# What a release needs, below its root.
RELEASE_ARTIFACTS = (
    "data/healthcare/benchmark_manifest.json", "data/healthcare/topic-split.json", "data/calibration-dev.json", "data/responses.jsonl", "data/annotations/adjudicated.jsonl", "data/test-evaluation-report.json",
)


def readiness(root: str, tests_passed: bool = True) -> tuple[int, dict[str, bool]]:
    """Exit code (0 ready, 1 tests fail, 2 artifacts missing) and which artifacts are there."""
    status = {p: (Path(root) / p).exists() for p in RELEASE_ARTIFACTS}
    return (1 if not tests_passed else 0 if all(status.values()) else 2), status

"""Evaluation of saved responses, end to end, with any embedder and entailment model."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.functions import models, scores as S
from groundcheck.operators import calibration, compare, metrics, report, retrieval, rules, trust as trust_op, verification as V
from groundcheck.plans.fixtures import extract
from groundcheck.schema import CLAIM_KEY, RESPONSE_KEY
from groundcheck.session import kept, shared_folder
from groundcheck.sources import files, vectors
from groundcheck.sources.benchmark import Benchmark
from groundcheck.sources.report import write_document


@dataclass(frozen=True)
class Settings:
    """What an evaluation is run with."""

    top_k: int = 5
    lexical: float = 0.5
    dense: float = 0.5
    support_threshold: float = S.SUPPORT_THRESHOLD
    contradiction_threshold: float = S.CONTRADICTION_THRESHOLD
    severity: S.SeverityPolicy = S.SeverityPolicy()
    trust: S.TrustPolicy = S.TrustPolicy()
    repetitions: int = 2000
    level: float = 0.95
    seed: int = 0
    #: Items up to which a pair's interval is drawn by Python's generator, in one task; beyond, by hashes over the cluster.
    exact_items: int = 10_000

    def __post_init__(self) -> None:
        if isinstance(self.top_k, bool) or not isinstance(self.top_k, int) or self.top_k < 1:
            raise ValueError("top_k must be a whole number of at least 1")
        if not all(0 <= t <= 1 for t in (self.support_threshold, self.contradiction_threshold)):
            raise ValueError("thresholds must be in [0, 1]")
        if min(self.lexical, self.dense) < 0 or abs(self.lexical + self.dense - 1) > 1e-9:
            raise ValueError("retrieval weights must not be negative and must sum to 1")
        compare.check_bootstrap(self.repetitions, self.level)


@dataclass
class Evaluation:
    """The tables of an evaluation, one a grain; all lazy."""

    facts: DataFrame
    responses: DataFrame
    trust: DataFrame | None
    model_metrics: DataFrame
    comparisons: DataFrame

    def nested(self) -> DataFrame:
        """The report's responses, a row each; :func:`groundcheck.sources.report.to_json_lines` writes them over the cluster."""
        return report.nested_report(self.facts, self.responses, self.trust)

    def arrays(self) -> dict[str, DataFrame]:
        """The report's arrays in order."""
        return {
            "dataset_item_ids": self.responses.select("dataset_item_id").distinct().orderBy("dataset_item_id"),
            "responses": self.nested().orderBy("response.dataset_item_id", "response.model_name"),
            "model_metrics": self.model_metrics.orderBy("model_name"),
            "paired_comparisons": self.comparisons.orderBy("model_a", "model_b"),
        }


def check_matrix(responses: DataFrame, models_: DataFrame | None = None, items: DataFrame | None = None) -> None:
    """Raise unless every model has one proper response to every item, and no others."""
    rules.require(rules.response_violations(responses))
    expected_models = models_ if models_ is not None else responses.select("model_name").distinct()
    expected_items = items if items is not None else responses.select("dataset_item_id").distinct()
    rules.require(rules.missing_pairs(responses, expected_models, expected_items).withColumn("rule", F.lit("missing response")))
    for df, name in ((models_, "model_name"), (items, "dataset_item_id")):
        if df is not None:
            rules.require(responses.select(name).distinct().join(df.select(name), name, "left_anti").withColumn("rule", F.lit("unknown")))


def check_keys(keys: DataFrame, known: DataFrame, key: list[str], what: str) -> None:
    """Raise if a key is not among those known."""
    rules.require(keys.select(*key).join(known.select(*key), key, "left_anti").withColumn("rule", F.lit(f"{what} of no evaluated claim or response")))


#: A text of more than this share of the claims is joined by broadcast; there are fewer such texts than ``HOT``.
HOT = 1024


def _by_text(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """``rows`` with what was judged of their ``claim_text``; texts of many claims do not meet in one task."""
    total = judged.agg(F.sum("n")).first()[0] or 0
    rows = rows.withColumn("digest", vectors.digest(F.col("claim_text")))
    many, few = (judged.where(c).drop("claim_text", "n") for c in (F.col("n") * HOT > total, F.col("n") * HOT <= total))
    rest = rows.join(F.broadcast(many.select("digest")), "digest", "left_anti").join(few, "digest")
    return rows.join(F.broadcast(many), "digest").unionByName(rest).drop("digest")


def claim_facts(
    responses: DataFrame, evidence: DataFrame, embedder: Callable[[], models.Embedder] | None, nli: Callable[[], models.NLIModel], settings: Settings = Settings(),
    claims: Callable[[DataFrame], DataFrame] = extract, similarity: Callable[[Column], Column] | None = None, store: str | None = None, model: str = "embedder",
) -> DataFrame:
    """One row per claim: retrieved passages, scores, label, severity.

    ``similarity`` is built from a hit; by default it is the embedding score, or
    1 where retrieval is lexical alone.

    All of it depends on a claim's text alone, so each distinct text is encoded,
    ranked and judged once and its claims take the result; the distinct texts and
    what was judged of them are written to the shared folder.  ``store`` is a folder
    that keeps vectors by ``model`` for later runs (:mod:`groundcheck.sources.vectors`);
    without it they last for this call.
    """
    dense = settings.dense > 0
    if dense != (embedder is not None):
        raise ValueError("dense retrieval needs an embedder, and an embedder a weight above 0")
    rows, passages = claims(responses), evidence.select("pos", "evidence_id", "text")
    spark = rows.sparkSession
    texts = kept(rows.where(F.col("claim_text").isNotNull()).groupBy(vectors.digest(F.col("claim_text")).alias("digest")).agg(F.first("claim_text").alias("claim_text"), F.count("*").alias("n")), "claim-texts")
    found = None
    if dense:
        store = store or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
        both = vectors.encode_missing(texts.select(F.col("claim_text").alias("text")).union(passages.select("text")), embedder, store, model)
        found = passages.select("pos", vectors.digest(F.col("text")).alias("digest")).join(both, "digest").select("pos", "vector")
        texts = texts.join(both, "digest")
    ranked = retrieval.rank_passages(texts, passages, retrieval.bm25_postings(passages), settings.top_k, F.col("vector") if dense else None, found, settings.lexical, settings.dense, without=("vector",))
    ranked = kept(ranked, "claim-hits")
    hits = ranked.select("digest", "claim_text", F.explode("hits").alias("h")).join(passages.select(F.col("pos").alias("at"), F.col("text").alias("passage")), F.col("h.pos") == F.col("at"))
    pairs = hits.select("digest", "h.rank", "claim_text", "passage").repartition(spark.sparkContext.defaultParallelism)  # judging is dear
    given = pairs.withColumn("p", models.nli_udf(nli)("passage", "claim_text")).groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("rank", "p"))).alias("nli"))
    similarity = similarity or ((lambda h: h["embedding_score"]) if dense else (lambda h: F.lit(1.0)))
    scored = ranked.join(given, "digest", "left").withColumn("evidence_scores", V.evidence_scores(F.col("hits"), similarity, lambda h: F.col("nli")[h["rank"]])).drop("nli")
    verified = V.verify(scored, settings.support_threshold, settings.contradiction_threshold)
    return _by_text(rows, kept(V.assess_severity(verified, policy=settings.severity), "claims-judged"))


def evaluate(facts: DataFrame, responses: DataFrame, consistency: DataFrame | None = None, gold: DataFrame | None = None, settings: Settings = Settings()) -> Evaluation:
    """All tables from claim facts; matrix, claims, consistency and gold keys are checked first.

    The facts are written once, and checks and tables read the columns that they need.
    """
    check_matrix(responses)
    facts = kept(facts, "facts")
    check_keys(facts, responses, RESPONSE_KEY, "claim")
    rules.require(rules.repeated(facts, CLAIM_KEY, "repeated claim id"))
    rules.require(report.span_violations(facts, responses))
    if consistency is not None:
        rules.require(rules.violations(consistency, [rules.Rule("consistency out of range", ~S.in_unit(F.col("consistency_score")))], RESPONSE_KEY))
        rules.require(rules.repeated(consistency, RESPONSE_KEY, "repeated consistency score"))
        check_keys(consistency, responses, RESPONSE_KEY, "consistency")
    if gold is not None:
        check_keys(gold, facts, CLAIM_KEY, "gold label")
        rules.require(rules.repeated(gold, CLAIM_KEY, "repeated gold label"))
    trust = trust_op.trust_scores(facts, consistency, policy=settings.trust) if consistency is not None else None
    pairs = compare.paired_outcomes(compare.item_outcomes(facts, responses))
    p = S.mcnemar_p(F.col("model_a_error_only_items"), F.col("model_b_error_only_items"))
    few = responses.select("dataset_item_id").distinct().limit(settings.exact_items + 1).count() <= settings.exact_items
    interval = (compare.bootstrap_exact if few else compare.bootstrap_hash)(pairs, settings.repetitions, settings.level, settings.seed).withColumn("confidence_level", F.lit(settings.level))
    interval = interval.select("model_a", "model_b", F.struct("mean_difference", "lower", "upper", "sample_size", "repetitions", "confidence_level").alias("supported_rate_difference"))
    comparisons = compare.paired_comparison(pairs).drop("mean_difference").withColumn("mcnemar_exact_p_value", p).join(interval, ["model_a", "model_b"], "left")
    return Evaluation(facts, responses, trust, metrics.model_metrics(facts, responses, gold, consistency, settings.top_k, settings.severity, settings.trust), comparisons)


def save_report(evaluation: Evaluation, path: str, benchmark: Benchmark | None = None, gold: DataFrame | None = None, settings: Settings = Settings(), names: dict[str, str] | None = None) -> dict[str, Any]:
    """Write the report and, beside it, a manifest of what it was made with.

    Claims pass through the driver to the file, a partition at a time; only the
    models' metrics and the ids of items are held.
    """
    write_document(path, {"schema_version": 1}, evaluation.arrays())
    against = {}
    if gold is not None:
        pairs = calibration.severity_pairs(evaluation.facts, gold, CLAIM_KEY, strict=False)
        against = {r.model_name: {k: v for k, v in r.asDict().items() if k != "model_name"} for r in calibration.severity_metrics(pairs, ["model_name"]).collect()}
    ids = [r[0] for r in evaluation.arrays()["dataset_item_ids"].collect()]
    manifest = {
        "schema_version": 1, "bootstrap_draws": "generator" if len(ids) <= settings.exact_items else "hash", "prompt_sha256": benchmark.prompt_sha256 if benchmark else None, "evidence_sha256": benchmark.evidence_sha256 if benchmark else None, "benchmark_frozen": bool(benchmark and benchmark.is_frozen),
        "dataset_item_ids": ids, "models": [r[0] for r in evaluation.responses.select("model_name").distinct().orderBy("model_name").collect()], "top_k": settings.top_k, "support_threshold": settings.support_threshold,
        "contradiction_threshold": settings.contradiction_threshold, "severity_contradiction_threshold": settings.severity.high_contradiction, "severity_metrics_vs_gold": against, **(names or {}),
    }
    files.write_object(Path(path).with_name(Path(path).name + ".manifest.json"), manifest)
    return manifest


def select_split(rows: DataFrame, manifest: dict[str, Any], split: str) -> DataFrame:
    """Rows of the items in one split of a manifest."""
    if split not in ("train", "dev", "test"):
        raise ValueError("a split is train, dev or test")
    named = [(k, v) for k, v in manifest["item_splits"].items()]
    table = rows.sparkSession.createDataFrame(named, "dataset_item_id string, split string").where(F.col("split") == split)
    return rows.join(table.select("dataset_item_id"), "dataset_item_id", "left_semi")

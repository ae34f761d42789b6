"""Command line: ``python -m groundcheck COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from importlib import import_module

from pyspark.sql import functions as F

from groundcheck.functions.extractors import claims_by
from groundcheck.functions.scores import SeverityPolicy
from groundcheck.operators import retrieval, verification
from groundcheck.operators.report import flatten_claims
from groundcheck.plans import annotate, evaluate, gates, generate
from groundcheck.plans.fixtures import extract
from groundcheck.schema import REPORT
from groundcheck.session import local_session
from groundcheck.sources import benchmark, files
from groundcheck.sources.report import read_report, write_claims


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="groundcheck", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *needed: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help_)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        return p

    command("demo", "judge one answer by the lexical baseline")
    p = command("freeze", "check a benchmark and write its manifest", "prompts", "evidence", "dataset", "domain", "hosts")
    p.add_argument("--rows", type=int, nargs=3, metavar=("PROMPTS", "PASSAGES", "PER_TOPIC"), default=(300, 30, 10))
    p = command("split", "assign topics to train, dev and test", "prompts", "evidence", "dataset", "output")
    p.add_argument("--development-fraction", type=float, default=0.2)
    p.add_argument("--test-fraction", type=float, default=0.2)
    p.add_argument("--seed", type=int, default=42)
    p = command("generate", "answer prompts by adapters of module:function", "prompts", "evidence", "adapters", "store")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--max-items", type=int)
    p = command("evaluate", "evaluate saved responses", "prompts", "evidence", "responses", "report", "nli")
    p.add_argument("--split")
    p.add_argument("--dataset-split", choices=gates.SPLITS)
    p.add_argument("--annotations")
    # The thresholds' defaults.
    for name, value in (("support-threshold", 0.55), ("contradiction-threshold", 0.55), ("severity-threshold", 0.8)):
        p.add_argument(f"--{name}", type=float, default=value)
    models = [p]
    p = command("calibrate", "fit thresholds on the development items of a saved report", "prompts", "evidence", "responses", "report", "annotations", "split", "output")
    p.add_argument("--threshold-step", type=float, default=0.05)
    p.add_argument("--objective", choices=("macro_f1", "balanced_accuracy"), default="macro_f1")
    models.append(command("locked-test", "evaluate the test items by calibrated thresholds, if every artifact holds", "prompts", "evidence", "manifest", "split", "calibration", "responses", "annotations", "report", "nli"))
    for p in models:
        p.add_argument("--embedder", help="module:factory; left out, retrieval is lexical")
        p.add_argument("--top-k", type=int, default=5)
        p.add_argument("--claims", help="module:factory of a claim extractor in place of the engine's own")
        p.add_argument("--vectors", help="a folder that keeps the embedder's vectors, so that later runs encode new texts alone")
    p = command("claims", "the claims of a saved report as CSV", "report", "output")
    p.add_argument("--models", nargs="*")
    p.add_argument("--items", nargs="*")
    p = command("worksheet", "export empty annotations", "prompts", "evidence", "responses", "output", "annotator")
    p.add_argument("--allow-unfrozen-pilot", action="store_true")
    p = command("check-annotations", "agreement of two annotators, or tallies of adjudicated ones", "evidence", "responses", "annotations")
    p.add_argument("--second")
    p = command("package", "summary, tables and hashes of a report", "report", "output")
    p.add_argument("--provenance", nargs="*", default=[])
    p = command("readiness", "which release artifacts are there", "root")
    p.add_argument("--run-tests", action="store_true")
    return top


def _factory(name: str):
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


def demo(spark) -> list[dict]:
    """The lexical baseline on one answer."""
    answer = spark.createDataFrame([("demo", "1", "Canberra is the capital of Australia and Sydney is its largest city.")], "model_name string, dataset_item_id string, text string")
    passages = spark.createDataFrame([(0, "e1", "Canberra is the capital city of Australia.")], "pos long, evidence_id string, text string")
    found = verification.baseline_verify(retrieval.baseline_ranking(extract(answer), passages))
    return [r.asDict() for r in found.select("model_name", "dataset_item_id", "claim_id", "similarity", "label").orderBy("claim_id").collect()]


def evaluated(spark, a: argparse.Namespace, thresholds: tuple[float, float, float]) -> dict:
    """Evaluate saved responses, of one split if asked, and write the report; returns its manifest."""
    bench, rows = benchmark.load_benchmark(spark, a.prompts, a.evidence), generate.saved_responses(spark, a.responses)
    gold = gates.load_gold(spark, a.annotations, rows, bench.evidence) if a.annotations else None
    if a.split:
        split = files.read_object(a.split)
        gates.check_split(split, bench.prompt_sha256, bench.evidence_sha256, gates.item_ids(bench))
        rows = evaluate.select_split(rows, split, a.dataset_split)
        gold = gold.join(rows.select("dataset_item_id").distinct(), "dataset_item_id", "left_semi") if gold is not None else None
    dense, (support, contradiction, severity) = 0.5 if a.embedder else 0.0, thresholds
    settings = evaluate.Settings(a.top_k, 1 - dense, dense, support, contradiction, SeverityPolicy(severity))
    facts = evaluate.claim_facts(rows, bench.evidence, _factory(a.embedder) if a.embedder else None, _factory(a.nli), settings, claims_by(_factory(a.claims)) if a.claims else extract, store=a.vectors, model=a.embedder or "")
    done = evaluate.evaluate(facts, rows, gold=gold, settings=settings)
    manifest = evaluate.save_report(done, a.report, bench, gold, settings, {"nli_model": a.nli, "embedding_model": a.embedder})
    done.model_metrics.orderBy(F.col("model_name")).show(truncate=False)
    return manifest


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2, default=str))
    if a.command == "package":
        show(gates.package_release(a.report, a.output, a.provenance))
        return 0
    if a.command == "readiness":
        passed = not a.run_tests or subprocess.run([sys.executable, "-m", "pytest", "-q"], cwd=a.root, check=False).returncode == 0
        code, status = gates.readiness(a.root, passed)
        show(status)
        return code
    if a.command == "evaluate" and bool(a.split) != bool(a.dataset_split):
        raise SystemExit("--split and --dataset-split go together")
    spark = local_session()
    if a.command == "demo":
        show(demo(spark))
        return 0
    if a.command == "freeze":
        hosts = {k: tuple(v) for k, v in files.read_object(a.hosts).items()}
        found = benchmark.freeze(spark, a.prompts, a.evidence, a.dataset, a.domain, hosts, counts=tuple(a.rows[:2]), per_topic=a.rows[2])
        show(found)
        return int(bool(found))
    if a.command == "locked-test":
        found = gates.locked_thresholds(spark, a.prompts, a.evidence, a.manifest, a.split, a.calibration, a.responses, a.annotations)
        a.dataset_split = "test"
        show(found | {"report": evaluated(spark, a, tuple(found.values()))})
        return 0
    if a.command == "evaluate":
        show(evaluated(spark, a, (a.support_threshold, a.contradiction_threshold, a.severity_threshold)))
        return 0
    if a.command == "calibrate":
        made = gates.calibrate(spark, a.report, a.responses, a.annotations, a.prompts, a.evidence, a.split, a.output, a.threshold_step, a.objective)
        show({k: made[k] for k in ("verification", "severity", "retrieval_recall_at_k")})
        return 0
    if a.command == "claims":
        show({"claims": write_claims(flatten_claims(read_report(spark, a.report, REPORT)), a.output, a.models, a.items)})
        return 0
    if a.command == "check-annotations":
        rows, ids = generate.saved_responses(spark, a.responses), benchmark.evidence_ids(spark, a.evidence)
        show(annotate.compare_annotators(spark, a.annotations, a.second, rows, ids) if a.second else annotate.gold_summary(spark, a.annotations, rows, ids))
        return 0
    bench = benchmark.load_benchmark(spark, a.prompts, a.evidence, getattr(a, "max_items", None))
    if a.command == "split":
        show(gates.write_split(bench, a.output, a.dataset, a.development_fraction, a.test_fraction, a.seed)["topic_counts"])
    elif a.command == "generate":
        hashes = {"prompt_sha256": bench.prompt_sha256, "evidence_sha256": bench.evidence_sha256}
        show(generate.run_generation(bench.prompts.select("dataset_item_id", "prompt"), generate.load_adapters(a.adapters), a.store, hashes, a.resume))
    elif a.command == "worksheet":
        show({"claims": annotate.export_worksheet(generate.saved_responses(spark, a.responses), bench, a.output, a.annotator, a.allow_unfrozen_pilot)})
    return 0


if __name__ == "__main__":
    sys.exit(main())

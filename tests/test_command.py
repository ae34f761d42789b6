import json

import pytest
from pyspark.sql import functions as F

from groundcheck import __main__ as command
from groundcheck.operators.rules import RuleError
from groundcheck.plans import annotate, evaluate as E
from groundcheck.sources import benchmark as B
from tests.test_plans import Prefix, Words, annotations, answers, lines, make_benchmark, run_all


def make_words():
    return Words()


def make_prefix():
    return Prefix()


def gold_facts(spark, evidence):
    """Facts that annotators agree with."""
    passages = B.read_table(spark, evidence, B.EVIDENCE).withColumn("pos", F.col("record").cast("long"))
    return E.claim_facts(answers(spark), passages, Words, Prefix, E.Settings(support_threshold=0.3, contradiction_threshold=0.3))


def test_worksheet_and_agreement(spark, tmp_path):
    p, e, b, rows, facts = run_all(spark, tmp_path)
    count = annotate.export_worksheet(rows, b, str(tmp_path / "sheet.jsonl"), "ann")
    sheet = [json.loads(x) for x in (tmp_path / "sheet.jsonl").read_text().splitlines()]
    assert count == len(sheet) == facts.count()
    assert sheet[0]["claim_review_status"] == "pending" and sheet[0]["verification_label"] is None and sheet[0]["evidence_candidates"][0]["evidence_id"] == "e0"
    with pytest.raises(FileExistsError):
        annotate.export_worksheet(rows, b, str(tmp_path / "sheet.jsonl"), "ann")
    with pytest.raises(RuleError):
        annotate.export_worksheet(rows.where("not (model_name = 'model-a' and dataset_item_id = 'i0')"), b, str(tmp_path / "x"), "ann")
    one = [{**a, "annotation_status": "independent"} for a in annotations(facts)]
    two = [{**a, "annotator_id": "b"} for a in one]
    k = next(i for i, a in enumerate(two) if a["verification_label"] == "unknown")
    two[k] = {**two[k], "verification_label": "contradicted"}
    first, second = lines(tmp_path / "a.jsonl", one), lines(tmp_path / "b.jsonl", two)
    got = annotate.compare_annotators(spark, first, second, rows, b.evidence)
    assert got["claim_count"] == count and len(got["disagreements"]) == 1 and 0 < got["cohen_kappa"] < 1
    with pytest.raises(RuleError, match="one only"):
        annotate.compare_annotators(spark, first, lines(tmp_path / "c.jsonl", two[1:]), rows, b.evidence)
    done = annotate.gold_summary(spark, lines(tmp_path / "g.jsonl", annotations(facts)[1:]), rows, b.evidence)
    assert done["claims_without"] == 1 and sum(done["labels"].values()) == count - 1


def test_unfrozen(spark, tmp_path):
    b = B.load_benchmark(spark, *make_benchmark(tmp_path))
    with pytest.raises(ValueError, match="freeze"):
        annotate.export_worksheet(answers(spark), b, str(tmp_path / "x.jsonl"), "ann")
    assert annotate.export_worksheet(answers(spark), b, str(tmp_path / "x.jsonl"), "ann", allow_unfrozen=True) > 0


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(command, "local_session", lambda: spark)
    p, e = make_benchmark(tmp_path)
    (tmp_path / "hosts.json").write_text('{"S": ["s.org"]}')
    both = ["--prompts", p, "--evidence", e]
    assert command.main(["freeze", *both, "--dataset", "x", "--domain", "d", "--hosts", str(tmp_path / "hosts.json"), "--rows", "9", "3", "3"]) == 0
    assert command.main(["split", *both, "--dataset", "x", "--output", str(tmp_path / "split.json"), "--development-fraction", "0.34", "--test-fraction", "0.34"]) == 0
    B.write_responses(answers(spark), str(tmp_path / "r.jsonl"))
    args = ["evaluate", *both, "--responses", str(tmp_path / "r.jsonl"), "--report", str(tmp_path / "rep.json"), "--nli", "tests.test_command:make_prefix", "--embedder", "tests.test_command:make_words"]
    assert command.main([*args, "--split", str(tmp_path / "split.json"), "--dataset-split", "dev"]) == 0
    report = json.loads((tmp_path / "rep.json").read_text())
    assert len(report["dataset_item_ids"]) == 3 and json.loads((tmp_path / "rep.json.manifest.json").read_text())["benchmark_frozen"]
    lines(tmp_path / "gold.jsonl", annotations(gold_facts(spark, e)))
    args += ["--annotations", str(tmp_path / "gold.jsonl")]
    calibrate = ["calibrate", *both, "--responses", str(tmp_path / "r.jsonl"), "--annotations", str(tmp_path / "gold.jsonl"), "--split", str(tmp_path / "split.json")]
    assert command.main([*args[:-4], *args[-2:], "--report", str(tmp_path / "all.json"), "--embedder", "tests.test_command:make_words"]) == 0
    assert command.main([*calibrate, "--report", str(tmp_path / "all.json"), "--output", str(tmp_path / "cal.json")]) == 0
    assert command.main(["claims", "--report", str(tmp_path / "all.json"), "--output", str(tmp_path / "claims.csv"), "--models", "model-a"]) == 0
    assert (tmp_path / "claims.csv").read_text().count("model-a") >= 9
    locked = ["locked-test", *calibrate[1:], "--manifest", str(tmp_path / "benchmark_manifest.json"), "--calibration", str(tmp_path / "cal.json"), "--report", str(tmp_path / "test.json"), "--nli", "tests.test_command:make_prefix", "--embedder", "tests.test_command:make_words"]
    assert command.main(locked) == 0
    held = json.loads((tmp_path / "test.json.manifest.json").read_text())
    fitted = json.loads((tmp_path / "cal.json").read_text())
    assert held["support_threshold"] == fitted["verification"]["support_threshold"] and held["severity_metrics_vs_gold"]
    split = json.loads((tmp_path / "split.json").read_text())["item_splits"]
    assert held["dataset_item_ids"] == sorted(k for k, v in split.items() if v == "test")
    assert command.main(["package", "--report", str(tmp_path / "rep.json"), "--output", str(tmp_path / "out")]) == 0
    assert command.main(["readiness", "--root", str(tmp_path)]) == 2
    capsys.readouterr()
    assert command.main(["demo"]) == 0
    assert [r["label"] for r in json.loads(capsys.readouterr().out)] == ["supported", "unknown"]
    with pytest.raises(SystemExit):
        command.main([*args, "--dataset-split", "dev"])

"""Documents read in splits against the same read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from groundcheck.schema import REPORT
from groundcheck.sources import document, report


def tricky(rng):
    text = "".join(rng.choice(['"', "\\", ",", "{", "}", "[", "]", "é", "日", "\n", " ", "x", '\\"', ":", '",']) for _ in range(rng.randint(0, 12)))
    deep = rng.choice([text, 1.5, None, True, [text, [text]], {"a,]": text, text: [1, {"b": text}]}, [], {}])
    return {"id": rng.randint(0, 9), text: deep, "t": text}


def whole(value):
    return {k: v if isinstance(v, list) else [v] for k, v in value.items()}


def read(spark, path):
    out = {}
    for r in sorted(document.elements(spark, path).collect(), key=lambda r: (r.name, r.place)):
        out.setdefault(json.loads(f'"{r.name}"'), []).extend([json.loads(r.value)] if r.value else [])
    return out


@pytest.fixture
def small_splits(spark):
    """A split of 64 bytes each."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 1])
def test_any_document(spark, tmp_path, small_splits, indent):
    rng = random.Random(indent)
    value = {"version": 1, "rows": [tricky(rng) for _ in range(30)], "none": [], "one": [[1, 2]], 'odd "name"': ["a,b", "]"], "object": {"x": [1, {"y": "}"}]}, "text": 'a\\",[', "end": [None, 2]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(value, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() >= 20
    assert read(spark, str(path)) == whole(value)


def nested(k):
    claim = {"id": f"c{k}", "text": 'say "x, y" [and] {z}', "start": 0, "end": 4}
    return {"response": {"model_name": f"m{k % 3}", "dataset_item_id": f"i{k}", "text": "a, \"b\"\\ [", "confidence": 0.5}, "claims": [{"verification": {"claim": claim, "label": "supported", "similarity": 0.25, "support_score": 0.5, "contradiction_score": 0.1, "explanation": "e,", "evidence_scores": []}, "severity": {"severity": None, "risk_domains": [], "rationale": ""}, "retrieved_evidence": [{"evidence": {"id": "e1"}, "rank": 1}]}] * (k % 3 > 0), "trust_score": None}


def test_report_in_splits(spark, tmp_path, small_splits):
    value = {"schema_version": 1, "dataset_item_ids": ["i0"], "responses": [nested(k) for k in range(25)], "model_metrics": [], "paired_comparisons": []}
    path = tmp_path / "report.json"
    path.write_text(json.dumps(value))  # in one line
    rows = [r.responses[0].asDict(recursive=True) for r in report.read_report(spark, str(path), REPORT).collect()]
    assert sorted(r["response"]["dataset_item_id"] for r in rows) == sorted(r["response"]["dataset_item_id"] for r in value["responses"])
    claims = {c["verification"]["claim"]["id"] for r in rows for c in r["claims"]}
    assert claims == {f"c{k}" for k in range(25) if k % 3}
    unique = value | {"responses": [nested(k) for k in range(25) if k % 3]}
    path.write_text(json.dumps(unique, indent=2))
    facts = report.report_facts(spark, str(path)).select("model_name", "claim_id", "label", "similarity", F.col("hits.evidence_id").alias("ids")).collect()
    assert sorted(map(tuple, facts), key=str) == sorted(((f"m{k % 3}", f"c{k}", "supported", 0.25, ["e1"]) for k in range(25) if k % 3), key=str)


def test_what_is_no_report(spark, tmp_path):
    good = {"schema_version": 1, "dataset_item_ids": [], "responses": [], "model_metrics": [], "paired_comparisons": []}
    path = tmp_path / "r.json"
    path.write_text(json.dumps(good))
    assert report.read_report(spark, str(path), REPORT).collect() == []
    for bad in (good | {"schema_version": 2}, good | {"responses": {}}, {k: v for k, v in good.items() if k != "model_metrics"}, [good]):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError, match="not an evaluation report"):
            report.read_report(spark, str(path), REPORT)

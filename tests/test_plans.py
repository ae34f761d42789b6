import csv
import glob
import json
import os
import signal
import time
import uuid
from functools import partial

import pytest
from pyspark.sql import functions as F

from groundcheck.functions import models
from groundcheck.functions.extractors import Lines, claims_by
from groundcheck.operators import report as report_op, rules
from groundcheck import queries as Q
from groundcheck.plans import evaluate as E, fixtures as fx, gates, generate as G
from groundcheck.plans.fixtures import extract
from groundcheck.schema import CLAIM_KEY, REPORT
from groundcheck.sources import benchmark as B, files, jsonl, report
from groundcheck.streaming.generation import stored, stream_generation


class Words:
    """Texts as counts of three words."""

    def encode(self, texts):
        return [[float(t.lower().count(w)) + 0.01 for w in ("water", "moon", "gold")] for t in texts]


class Prefix:
    """Claims say by their first word how they are to be judged."""

    def predict_many(self, pairs):
        rows = {"supported": (1.0, 0.0, 0.0), "contradicted": (0.0, 1.0, 0.0)}
        return [rows.get(c.split()[0].lower(), (0.0, 0.0, 1.0)) for _, c in pairs]


class Noted:
    """A model that writes down, a file a call, what it is asked."""

    def __init__(self, model, folder):
        self.model, self.folder = model, folder

    def _note(self, rows):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump([list(r) if isinstance(r, tuple) else r for r in rows], f)

    def encode(self, texts):
        self._note(texts)
        return self.model.encode(texts)

    def predict_many(self, pairs):
        self._note(pairs)
        return self.model.predict_many(pairs)


def noted(folder):
    return sorted(x for f in folder.iterdir() for x in json.loads(f.read_text()))


class Echo(G.Adapter):
    def __init__(self, name, fail_on=None):
        self.name, self.fail_on, self.metadata = name, fail_on, {"kind": "echo"}

    def generate(self, item_id, prompt):
        if item_id == self.fail_on:
            raise RuntimeError("a secret")
        return f"Supported {prompt}", 0.5


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def make_benchmark(folder, items=9):
    prompts = [{"dataset_item_id": f"i{k}", "domain": "d", "topic": f"t{k % 3}", "task_type": "factual", "risk_level": "high", "prompt": f"water {k}", "reference_evidence_ids": [f"e{k % 3}"]} for k in range(items)]
    evidence = [{"evidence_id": f"e{k}", "domain": "d", "topic": f"t{k}", "text": f"Water and moon {k}.", "source": "S", "source_url": "https://s.org/a", "publication_date": "2024-01-02"} for k in range(3)]
    return lines(folder / "prompts.jsonl", prompts), lines(folder / "evidence.jsonl", evidence)


def test_benchmark(spark, tmp_path):
    p, e = make_benchmark(tmp_path)
    b = B.load_benchmark(spark, p, e, max_items=4)
    assert [r[0] for r in b.prompts.orderBy("record").select("dataset_item_id").collect()] == ["i0", "i1", "i2", "i3"] and not b.is_frozen
    assert [r.pos for r in b.evidence.orderBy("record").collect()] == [1, 2, 3]
    assert B.freeze(spark, p, e, "x", "d", {"S": ("s.org",)}, counts=(9, 3), per_topic=3) == []
    assert B.load_benchmark(spark, p, e).is_frozen
    assert {x["rule"] for x in B.freeze(spark, p, e, "x", "other", {"S": ("s.org",)}, counts=(9, 4), per_topic=3)} == {"domain", "row count"}
    odd = tmp_path / "odd" / "prompts.jsonl"
    odd.parent.mkdir()
    odd.write_text(open(p).read() + "\n[1]\n{\n" + json.dumps({"dataset_item_id": 5}) + "\n")
    found = B.freeze(spark, str(odd), e, "x", "other", {"S": ("s.org",)}, counts=(9, 3), per_topic=3)
    assert [(x["table"], x["id"], x["rule"]) for x in found[:4]] == [("prompts", "10", "blank line"), ("prompts", "11", "not an object"), ("prompts", "12", "invalid JSON"), ("prompts", "13", "wrong type")]
    assert {x["rule"] for x in found[4:]} == {"domain"} and not (odd.parent / B.MANIFEST).exists()
    with open(e, "a") as f:
        f.write("\n")
    with pytest.raises(ValueError, match="differs"):
        B.load_benchmark(spark, p, e)
    with open(p, "a") as f:
        f.write(json.dumps({"dataset_item_id": "i9", "topic": "t0", "prompt": "x", "reference_evidence_ids": ["e1"]}) + "\n")
    with pytest.raises(rules.RuleError, match="topics differ"):
        B.load_benchmark(spark, p, e, max_items=1)  # all rows are checked before the first are kept
    assert B.evidence_ids(spark, e).count() == 3 and B.prompt_topics(spark, p).count() == 10


def test_bad_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n[1]\nnope\n{"b": 2}\n')
    found = [(r.line, r.record, r.error) for r in jsonl.read_lines(spark, str(path)).orderBy("line").collect()]
    assert found == [(1, 1, None), (3, 2, "not an object"), (4, 3, "invalid JSON"), (5, 4, None)]
    assert [r.line for r in jsonl.read_lines(spark, str(path), blank_is_error=True).where("error = 'blank line'").collect()] == [2]
    with pytest.raises(Exception, match="line 3"):
        B.read_table(spark, str(path), B.EVIDENCE).collect()


def test_lines_of_split_files(spark, tmp_path):
    """Numbers go on from split to split, in files that no task reads whole."""
    paths = []
    for f in range(2):
        text = "".join(("\n" if k % 7 == 3 else "") + json.dumps({"k": k, "pad": "x" * (k * 37 % 900)}) + ("\r\n" if k % 5 == 0 else "\n") for k in range(3000))
        paths.append(tmp_path / "many" / f"{f}.jsonl")
        paths[-1].parent.mkdir(exist_ok=True)
        paths[-1].write_text(text, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert spark.read.option("lineSep", "\n").text(str(tmp_path / "many")).rdd.getNumPartitions() > 8
        rows = jsonl.read_lines(spark, str(tmp_path / "many"))
        found = sorted((r.file[-7:], r.line, r.record, json.loads(r.value)["k"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want, line = [], 0
    for k in range(3000):
        line += 2 if k % 7 == 3 else 1
        want.append((line, k + 1, k))
    assert found == [(f"{f}.jsonl", *x) for f in range(2) for x in want]


def test_response_store(spark, tmp_path):
    rows = spark.createDataFrame([("b", "1", "é", None), ("a", "2", "x", 0.25), ("a", "1", "y", 1.0)], jsonl.RESPONSES)
    path = str(tmp_path / "r.jsonl")
    B.write_responses(rows, path)
    assert "\\u00e9" in open(path).read()
    assert [tuple(r) for r in jsonl.read_responses(spark, path).orderBy("dataset_item_id", "model_name").collect()] == [("a", "1", "y", 1.0), ("b", "1", "é", None), ("a", "2", "x", 0.25)]
    for bad in ({"model_name": "a", "dataset_item_id": "1", "text": "x"}, {"model_name": "a", "dataset_item_id": "1", "text": "x", "confidence": None, "more": 1}, {"model_name": "a", "dataset_item_id": "1", "text": 5, "confidence": 0.5}, {"model_name": "a", "dataset_item_id": "1", "text": "x", "confidence": True}):
        with pytest.raises(Exception, match="Invalid response record on line 1"):
            jsonl.read_responses(spark, lines(tmp_path / "bad.jsonl", [bad])).collect()


def answers(spark, models_=("model-a", "model-b"), items=9):
    texts = ["Supported water claim; contradicted moon claim.", "Unknown gold claim."]
    return spark.createDataFrame([(m, f"i{k}", texts[(k + j) % 2], 0.5) for j, m in enumerate(models_) for k in range(items)], jsonl.RESPONSES)


def run_all(spark, folder):
    p, e = make_benchmark(folder)
    B.freeze(spark, p, e, "x", "d", {"S": ("s.org",)}, counts=(9, 3), per_topic=3)
    b = B.load_benchmark(spark, p, e)
    rows = answers(spark)
    facts = E.claim_facts(rows, b.evidence, Words, Prefix, E.Settings(support_threshold=0.3, contradiction_threshold=0.3)).cache()
    return p, e, b, rows, facts


def test_evaluation(spark, tmp_path):
    p, e, b, rows, facts = run_all(spark, tmp_path)
    labels = {r.label for r in facts.collect()}
    assert labels == {"supported", "contradicted", "unknown"}
    assert facts.count() == extract(rows).count()
    for r in facts.collect():
        assert [h.rank for h in r.hits] == [1, 2, 3] and all(0 <= h.combined_score <= 1 for h in r.hits)
        want = "supported" if r.claim_text.startswith("Supported") else "contradicted" if r.claim_text.startswith("contradicted") else "unknown"
        assert r.label == want
    cons = rows.select("model_name", "dataset_item_id", F.lit(0.9).alias("consistency_score"))
    gold = facts.select(*CLAIM_KEY, F.col("label").alias("gold_label"), "severity", F.array(F.lit("e1")).alias("evidence_ids")).withColumnRenamed("severity", "gold_severity")
    done = E.evaluate(facts, rows, cons, gold, E.Settings(repetitions=20))
    m = {r.model_name: r for r in done.model_metrics.collect()}
    assert m["model-a"].verification_accuracy == 1.0 and m["model-a"].retrieval_recall_at_k == 1.0 and m["model-a"].average_trust_score > 0
    manifest = E.save_report(done, str(tmp_path / "report.json"), b, gold)
    assert manifest["bootstrap_draws"] == "generator"
    assert manifest["benchmark_frozen"] and manifest["severity_metrics_vs_gold"]["model-a"]["accuracy"] == 1.0
    document = report.load_report((tmp_path / "report.json").read_bytes())
    assert len(document["responses"]) == 18 and document["paired_comparisons"][0]["supported_rate_difference"]["repetitions"] == 20
    out = gates.package_release(str(tmp_path / "report.json"), str(tmp_path / "release"), [p])
    assert set(out["files"]) == {"research_summary.json", "model_metrics.csv", "paired_comparisons.csv"} and "prompts.jsonl_sha256" in out["report"]
    summary = files.read_object(tmp_path / "release/research_summary.json")
    assert summary["total_claims"] == facts.count() and summary["paired_comparisons"][0]["supported_rate_difference"]["sample_size"] == 9
    assert (tmp_path / "release/model_metrics.csv").read_text().startswith("model_name,response_count,")
    with pytest.raises(FileExistsError):
        gates.package_release(str(tmp_path / "report.json"), str(tmp_path / "release"))
    with pytest.raises(FileNotFoundError):
        gates.package_release(str(tmp_path / "report.json"), str(tmp_path / "other"), [str(tmp_path / "none")])


def test_models_are_asked_once(spark, tmp_path):
    """Over facts, checks, metrics and report each text is encoded and each pair judged once; a later run encodes new texts alone."""
    p, e = make_benchmark(tmp_path)
    b, rows = B.load_benchmark(spark, p, e), answers(spark)
    texts, pairs, again = (tmp_path / n for n in ("texts", "pairs", "again"))
    for folder in (texts, pairs, again):
        folder.mkdir()
    settings, store = E.Settings(support_threshold=0.3, contradiction_threshold=0.3, repetitions=5), f"file://{tmp_path}/vectors"
    facts = E.claim_facts(rows, b.evidence, partial(Noted, Words(), texts), partial(Noted, Prefix(), pairs), settings, store=store, model="words:1")
    E.save_report(E.evaluate(facts, rows, settings=settings), str(tmp_path / "report.json"), b)
    claims_ = sorted({r.claim_text for r in extract(rows).collect()})
    passages = sorted(f"Water and moon {k}." for k in range(3))
    assert noted(texts) == sorted([*claims_, *passages]) and noted(pairs) == sorted([q, c] for q in passages for c in claims_)
    more = rows.unionByName(rows.limit(1).withColumn("text", F.lit("Gold is new.")))
    E.claim_facts(more, b.evidence, partial(Noted, Words(), again), Prefix, settings, store=store, model="words:1")
    assert noted(again) == ["Gold is new."]
    for f in again.iterdir():
        f.unlink()
    E.claim_facts(rows, b.evidence, partial(Noted, Words(), again), Prefix, settings, store=store, model="words:1")
    assert noted(again) == []
    E.claim_facts(rows, b.evidence, partial(Noted, Words(), again), Prefix, settings, store=store, model="words:2")
    assert noted(again) == sorted([*claims_, *passages])


class Whole:
    """An extractor that makes what it is told."""

    def __init__(self, made):
        self.made = made

    def __call__(self, text):
        return self.made


def test_extractor_of_ones_own(spark, tmp_path):
    p, e = make_benchmark(tmp_path)
    b = B.load_benchmark(spark, p, e)
    rows = spark.createDataFrame([("m", "i0", "Supported \U0001f30a water\n\n  unknown é ", 0.5), ("m", "i1", "\n \n", 0.5), ("m", "i2", None, 0.5)], jsonl.RESPONSES)
    found = claims_by(Lines)(rows)
    assert found.columns == extract(rows).columns
    assert [(r.dataset_item_id, r.claim_id, r.claim_text, r.claim_start, r.claim_end) for r in found.orderBy("ordinal").collect()] == [("i0", "claim-1", "Supported \U0001f30a water", 0, 17), ("i0", "claim-2", "unknown é", 21, 30)]
    assert report_op.span_violations(found, rows).count() == 0
    facts = E.claim_facts(rows, b.evidence, Words, Prefix, E.Settings(support_threshold=0.3), claims_by(Lines))
    assert {r.claim_id: r.label for r in facts.collect()} == {"claim-1": "supported", "claim-2": "unknown"}
    for made, why in (([("water", 0, 5)], "offsets"), ([("S", 0, 1), ("u", 1, 2), ("up", 1, 3)], "overlaps"), ([(" ", 9, 10)], "blank"), ([("x", 0, 99)], "offsets")):
        with pytest.raises(Exception, match=why):
            claims_by(partial(Whole, made))(rows.where("dataset_item_id = 'i0'")).collect()


def test_hot_claim_texts(spark, tmp_path, monkeypatch):
    """Texts of many claims and of few meet what was judged of them by different joins, with the same result."""
    p, e = make_benchmark(tmp_path)
    b, rows = B.load_benchmark(spark, p, e), answers(spark).unionByName(answers(spark, ("model-c",), 1).withColumn("text", F.lit("Rare gold claim.")))
    found = []
    for hot in (1024, 3, 0):
        monkeypatch.setattr(E, "HOT", hot)
        found.append(sorted(map(str, E.claim_facts(rows, b.evidence, Words, Prefix).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == extract(rows).count()


def test_evaluation_rejects(spark):
    rows = answers(spark)
    facts = extract(rows).withColumns({"label": F.lit("unknown"), "severity": F.lit("mild")})
    for bad in (rows.where("not (model_name = 'model-a' and dataset_item_id = 'i0')"), rows.unionByName(rows.limit(1)), rows.withColumn("confidence", F.lit(1.1)), rows.withColumn("confidence", F.lit(float("nan"))), rows.withColumn("text", F.lit(" "))):
        with pytest.raises(rules.RuleError):
            E.check_matrix(bad)
    with pytest.raises(rules.RuleError, match="unknown"):
        E.check_matrix(rows, rows.where("model_name = 'model-a'").select("model_name"))
    cons = rows.select("model_name", "dataset_item_id", F.lit(1.5).alias("consistency_score"))
    with pytest.raises(rules.RuleError, match="consistency"):
        E.evaluate(facts, rows, cons)
    gold = spark.createDataFrame([("model-a", "i0", "claim-99", "unknown", [])], "model_name string, dataset_item_id string, claim_id string, gold_label string, evidence_ids array<string>")
    with pytest.raises(rules.RuleError, match="gold label"):
        E.evaluate(facts, rows, gold=gold)
    with pytest.raises(rules.RuleError, match="repeated claim id"):
        E.evaluate(facts.unionByName(facts.limit(1)), rows)
    with pytest.raises(rules.RuleError, match="invalid span"):
        E.evaluate(facts.withColumn("claim_start", F.lit(-1)), rows)
    with pytest.raises(rules.RuleError, match="claim of no"):
        E.evaluate(facts.withColumn("model_name", F.lit("other")), rows)
    with pytest.raises(ValueError, match="embedder"):
        E.claim_facts(rows, rows, Words, Prefix, E.Settings(lexical=1.0, dense=0.0))
    with pytest.raises(ValueError, match="embedder"):
        E.claim_facts(rows, rows, None, Prefix)
    for bad in ({"top_k": 0}, {"lexical": 0.9}, {"repetitions": 0}, {"level": 1.0}, {"support_threshold": 1.5}, {"top_k": True}):
        with pytest.raises(ValueError):
            E.Settings(**bad)


def annotations(facts):
    return [
        {"schema_version": 1, "annotation_status": "adjudicated", "annotator_id": "a", "claim_review_status": "accepted", "model_name": r.model_name, "dataset_item_id": r.dataset_item_id, "claim_id": r.claim_id, "claim_text": r.claim_text,
         "claim_start": r.claim_start, "claim_end": r.claim_end, "verification_label": r.label, "evidence_ids": ["e1"], "severity": r.severity, "rationale": "seen"}
        for r in facts.collect()
    ]


def test_locked_test(spark, tmp_path):
    p, e, b, rows, facts = run_all(spark, tmp_path)
    split = gates.write_split(b, str(tmp_path / "split.json"), "x", 0.34, 0.34)
    assert split["topic_counts"] == {"train": 1, "dev": 1, "test": 1}
    with pytest.raises(FileExistsError):
        gates.write_split(b, str(tmp_path / "split.json"), "x")
    B.write_responses(rows, str(tmp_path / "responses.jsonl"))
    lines(tmp_path / "gold.jsonl", annotations(facts))
    gold = gates.load_gold(spark, str(tmp_path / "gold.jsonl"), rows, b.evidence, complete=True)
    assert gates.check_split(split, b.prompt_sha256, b.evidence_sha256, {f"i{k}" for k in range(9)}) == split["item_splits"]
    dev = E.select_split(rows, split, "dev")
    made = gates.fit_thresholds(facts, gold, dev, b, split, {"split_manifest_sha256": files.sha256(tmp_path / "split.json")}, str(tmp_path / "cal.json"))
    assert made["verification"]["accuracy"] == 1.0 and made["severity"]["quadratic_weighted_kappa"] == 1.0 and made["retrieval_recall_at_k"]["3"] == 1.0
    args = [str(tmp_path / x) for x in ("prompts.jsonl", "evidence.jsonl", "benchmark_manifest.json", "split.json", "cal.json", "responses.jsonl", "gold.jsonl")]
    found = gates.locked_thresholds(spark, *args)
    assert found["support_threshold"] == made["verification"]["support_threshold"]
    with pytest.raises(FileExistsError):
        gates.fit_thresholds(facts, gold, dev, b, split, {}, args[4])

    def broken(change, match):
        value = json.loads(json.dumps(made))
        change(value)
        files.write_object(args[4], value)
        with pytest.raises(ValueError, match=match):
            gates.locked_thresholds(spark, *args)

    broken(lambda v: v["verification"].pop("support_threshold"), "numeric")
    broken(lambda v: v["severity"].update(high_contradiction_threshold=True), "numeric")
    broken(lambda v: v["severity"].update(high_contradiction_threshold=1.5), "outside")
    broken(lambda v: v["provenance"].update(prompt_sha256="x"), "hashes")
    broken(lambda v: v["provenance"].update(split_manifest_sha256="x"), "another split")
    broken(lambda v: v.update(development_item_ids=[k for k, s in split["item_splits"].items() if s == "test"]), "overlap")
    files.write_object(args[4], made)
    few = annotations(facts)
    few[0]["claim_start"] += 1
    lines(tmp_path / "gold.jsonl", few)
    with pytest.raises(rules.RuleError, match="offsets differ"):
        gates.locked_thresholds(spark, *args)
    lines(tmp_path / "gold.jsonl", annotations(facts)[1:])
    with pytest.raises(rules.RuleError, match="no annotation"):
        gates.locked_thresholds(spark, *args)
    with pytest.raises(FileNotFoundError):
        gates.locked_thresholds(spark, *args[:-1], str(tmp_path / "none"))
    lines(tmp_path / "gold.jsonl", annotations(facts))
    calibrated_from_report(spark, tmp_path, b, rows, facts, made, dev)


def calibrated_from_report(spark, folder, b, rows, facts, made, dev):
    """A saved report gives the thresholds that its facts give."""
    path = lambda name: str(folder / name)
    E.save_report(E.evaluate(facts, rows, settings=E.Settings(repetitions=5)), path("all.json"), b)
    args = [spark, path("all.json"), path("responses.jsonl"), path("gold.jsonl"), path("prompts.jsonl"), path("evidence.jsonl"), path("split.json")]
    again = gates.calibrate(*args, path("cal2.json"))
    assert {k: again[k] for k in ("verification", "severity", "retrieval_recall_at_k", "development_item_ids")} == {k: made[k] for k in ("verification", "severity", "retrieval_recall_at_k", "development_item_ids")}
    assert again["provenance"]["evaluation_report_sha256"] == files.sha256(path("all.json"))
    with pytest.raises(FileExistsError):
        gates.calibrate(*args, path("cal2.json"))
    document = json.loads(open(path("all.json")).read())

    def broken(change, match):
        value = json.loads(json.dumps(document))
        change(value["responses"])
        files.write_object(path("bad.json"), value)
        with pytest.raises(ValueError, match=match):
            gates.calibrate(spark, path("bad.json"), *args[2:], path("cal3.json"))

    claim = lambda r: r[0]["claims"][0]["verification"]["claim"]
    broken(lambda r: r.append(r[0]), "repeated claim key")
    broken(lambda r: claim(r).update(id=" "), "blank")
    broken(lambda r: claim(r).update(id="claim-77"), "differ")
    broken(lambda r: r[0]["claims"][0]["verification"].update(support_score=1.5), "out of range")
    flat = report_op.flatten_claims(report.read_report(spark, path("all.json"), REPORT))
    assert report.write_claims(flat, path("claims.csv"), models=["model-a"], items=["i1", "i0"]) == facts.where("model_name = 'model-a' and dataset_item_id in ('i0', 'i1')").count()
    with open(path("claims.csv"), newline="") as f:
        got = list(csv.DictReader(f))
    assert tuple(got[0]) == report.CLAIM_FIELDS and {r["dataset_item_id"] for r in got} == {"i0", "i1"}
    assert json.loads(got[0]["evidence_ids"]) == [h.evidence_id for h in facts.where("model_name = 'model-a' and dataset_item_id = 'i0' and claim_id = 'claim-1'").first().hits]


def test_intervals_of_many_items(spark):
    """Beyond the stated number of items intervals are drawn by hashes, with the same columns."""
    rows = answers(spark)
    facts = extract(rows).withColumns({"label": F.when(F.col("claim_text").startswith("Supported"), "supported").otherwise("unknown"), "severity": F.lit("mild"), "similarity": F.lit(0.5)})
    facts = facts.withColumn("hits", F.array().cast("array<struct<evidence_id:string>>"))
    few, many = (E.evaluate(facts, rows, settings=E.Settings(repetitions=50, exact_items=n)).comparisons.first() for n in (9, 8))
    assert few.asDict(recursive=True).keys() == many.asDict(recursive=True).keys()
    assert few.supported_rate_difference.mean_difference == pytest.approx(many.supported_rate_difference.mean_difference)
    assert many.supported_rate_difference.repetitions == 50 and many.supported_rate_difference.confidence_level == 0.95


def test_readiness(tmp_path):
    assert gates.readiness(str(tmp_path))[0] == 2 and gates.readiness(str(tmp_path), tests_passed=False)[0] == 1
    for name in gates.RELEASE_ARTIFACTS:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    assert gates.readiness(str(tmp_path))[0] == 0


def prompts_table(spark, n=4):
    return spark.createDataFrame([(f"i{k}", f"prompt {k}") for k in range(n)], "dataset_item_id string, prompt string")


def test_generation(spark, tmp_path):
    store, hashes = str(tmp_path / "store"), {"prompt_sha256": "p", "evidence_sha256": "e"}
    with pytest.raises(G.GenerationError) as failure:
        G.run_generation(prompts_table(spark), [Echo("a"), Echo("b", fail_on="i2")], store, hashes)
    held = G._read_manifest(spark, f"{store}/manifest.json")
    assert held["complete"] is False and "secret" not in json.dumps(held) + str(failure.value)
    assert held["completed_response_count"] == 7 and {k: held["last_error"][k] for k in ("model_name", "dataset_item_id", "error_type")} == {"model_name": "b", "dataset_item_id": "i2", "error_type": "RuntimeError"}
    done = G.run_generation(prompts_table(spark), [Echo("a"), Echo("b")], store, hashes, resume=True)
    assert done["complete"] and done["completed_response_count"] == 8 and "last_error" not in done
    again = G.run_generation(prompts_table(spark), [Echo("a"), Echo("b", fail_on="i2")], store, hashes, resume=True)
    assert again["complete"]  # nothing was pending
    with pytest.raises(ValueError, match="resume"):
        G.run_generation(prompts_table(spark), [Echo("a"), Echo("b")], store, hashes)
    with pytest.raises(ValueError, match="prompt_sha256"):
        G.run_generation(prompts_table(spark), [Echo("a"), Echo("b")], store, hashes | {"prompt_sha256": "q"}, resume=True)
    for bad in ([], [Echo("a"), Echo("a")], [Echo(" ")]):
        with pytest.raises(ValueError):
            G.check_adapters(bad)
    fixed = G.StaticAdapter("s", {f"i{k}": (f"text {k}", None) for k in range(4)})
    found = G.generate(prompts_table(spark), [fixed]).collect()
    assert sorted((r.dataset_item_id, r.text, r.confidence) for r in found) == [(f"i{k}", f"text {k}", None) for k in range(4)]
    assert G.load_adapters("tests.test_plans:make_adapters")[0].name == "a"


class Counted(Echo):
    """Notes every question in a file."""

    def __init__(self, name, log, wrong=()):
        super().__init__(name)
        self.log, self.wrong = log, dict(wrong)

    def generate(self, item_id, prompt):
        with open(self.log, "a") as f:
            f.write(f"{item_id}\n")
        if item_id in self.wrong:
            return self.wrong[item_id]
        return super().generate(item_id, prompt)


def test_resumed_generation_asks_only_the_rest(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    asked = lambda: sorted(open(log).read().split())
    improper = {"i3": (" ", None), "i5": ("x", 1.5)}
    with pytest.raises(G.GenerationError, match="BlankResponse|InvalidConfidence"):
        G.run_generation(prompts_table(spark, 9), [Counted("a", log, improper)], store, {})
    assert asked() == [f"i{k}" for k in range(9)] and G.stored_responses(spark, store).count() == 7
    open(log, "w").close()
    (tmp_path / "store/manifest.json").unlink()  # a lost manifest repeats nothing
    with pytest.raises(ValueError, match="resume"):
        G.run_generation(prompts_table(spark, 9), [Counted("a", log)], store, {})
    assert G.run_generation(prompts_table(spark, 9), [Counted("a", log)], store, {}, resume=True)["complete"]
    assert asked() == ["i3", "i5"]
    assert G.stored_responses(spark, store).select("generated_at_utc").where("generated_at_utc is null").isEmpty()
    open(log, "w").close()
    other = str(tmp_path / "other")  # small batches: those after the failed one are not asked
    with pytest.raises(G.GenerationError):
        G.run_generation(prompts_table(spark, 40), [Counted("a", log, {f"i{k}": ("", None) for k in range(40)})], other, {}, batch=5)
    first = asked()
    assert 0 < len(first) < 40
    assert G.run_generation(prompts_table(spark, 40), [Counted("a", log)], other, {}, resume=True, batch=5)["completed_response_count"] == 40
    (tmp_path / "other/manifest.json").unlink()
    with pytest.raises(rules.RuleError, match="outside this run"):
        G.run_generation(prompts_table(spark, 30), [Counted("a", log)], other, {}, resume=True)


class Dies(Counted):
    """Its worker is killed at one item, once others have been answered."""

    def __init__(self, name, log, item):
        super().__init__(name, log)
        self.item = item

    def generate(self, item_id, prompt):
        if item_id == self.item:
            for _ in range(600):
                if os.path.exists(self.log) and len(open(self.log).read().split()) >= 20:
                    os.kill(os.getpid(), signal.SIGKILL)
                time.sleep(0.1)
        return super().generate(item_id, prompt)


def test_killed_worker_costs_what_it_was_asked(spark, tmp_path):
    """Answers stand as soon as their task is done; those that stand are never asked again."""
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    with pytest.raises(Exception):  # noqa: B017 - Spark's own
        G.run_generation(prompts_table(spark, 40), [Dies("a", log, "i7")], store, {})
    kept = {r.dataset_item_id for r in G.stored_responses(spark, store).collect()}
    assert len(kept) >= 20 - 8  # but for what eight tasks were asked
    open(log, "w").close()
    assert G.run_generation(prompts_table(spark, 40), [Dies("a", log, None)], store, {}, resume=True)["complete"]
    assert sorted(open(log).read().split()) == sorted({f"i{k}" for k in range(40)} - kept)


def test_store_is_read_as_saved_responses_are(spark, tmp_path):
    store = str(tmp_path / "store")
    G.run_generation(prompts_table(spark, 3), [Echo("a"), Echo("b")], store, {})
    B.write_responses(G.saved_responses(spark, store), str(tmp_path / "saved.jsonl"))
    both = [G.saved_responses(spark, p) for p in (store, str(tmp_path / "saved.jsonl"))]
    assert both[0].columns == both[1].columns and sorted(both[0].collect()) == sorted(both[1].collect()) and both[0].count() == 6


def test_answer_left_twice_by_a_lost_task_counts_once(spark, tmp_path):
    store = str(tmp_path / "store")
    G.run_generation(prompts_table(spark, 3), [Echo("a")], store, {})
    (run,) = glob.glob(f"{store}/responses/run=*/batch=0")
    again = spark.read.schema(G.STORED).parquet(run).where("dataset_item_id = 'i1'").withColumn("generated_at_utc", F.lit("9999")).withColumn("text", F.lit("late"))
    spark.createDataFrame(again.collect(), again.schema).write.mode("append").parquet(run)
    found = {r.dataset_item_id: r.text for r in G.stored_responses(spark, store).collect()}
    assert len(found) == 3 and found["i1"] != "late"
    assert G.run_generation(prompts_table(spark, 3), [Echo("a")], store, {}, resume=True)["complete"]


def test_stream_does_not_read_its_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), [Echo("a")], str(tmp_path / "out"), str(tmp_path / "mark"))
    lines(tmp_path / "in/1.jsonl", [{"dataset_item_id": "i0", "prompt": "p"}])
    stream_generation(*args).awaitTermination()
    for f in glob.glob(f"{tmp_path}/out/responses/batch=0/**/*.parquet", recursive=True):
        open(f, "w").write("no Parquet")  # a batch that read older answers would fail
    lines(tmp_path / "in/2.jsonl", [{"dataset_item_id": k, "prompt": "p"} for k in ("i0", "i1")])
    stream_generation(*args).awaitTermination()
    assert [r.dataset_item_id for r in G.stored_responses(spark, args[3], "/batch=1").collect()] == ["i1"]


def make_adapters():
    return [Echo("a")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = lambda k: {"dataset_item_id": f"i{k}", "prompt": f"prompt {k}"}
    args = (spark, str(tmp_path / "in"), [Echo("a"), Echo("b")], str(tmp_path / "out"), str(tmp_path / "mark"))
    lines(tmp_path / "in/1.jsonl", [row(0), row(1), row(1)])
    stream_generation(*args).awaitTermination()
    assert stored(spark, args[3]).count() == 4
    lines(tmp_path / "in/2.jsonl", [row(1), row(2)])
    stream_generation(*args).awaitTermination()
    found = stored(spark, args[3])
    assert found.count() == 6 == found.select("model_name", "dataset_item_id").distinct().count()


def test_stream_after_a_failure(spark, tmp_path):
    """The batch that failed asks only for what it has not stored."""
    (tmp_path / "in").mkdir()
    log = str(tmp_path / "log")
    lines(tmp_path / "in/1.jsonl", [{"dataset_item_id": f"i{k}", "prompt": "p"} for k in range(5)])
    args = lambda a: (spark, str(tmp_path / "in"), [a], str(tmp_path / "out"), str(tmp_path / "mark"))
    with pytest.raises(Exception, match="BlankResponse"):
        stream_generation(*args(Counted("a", log, {"i2": ("", None)}))).awaitTermination()
    assert stored(spark, str(tmp_path / "out")).count() == 4
    open(log, "w").close()
    stream_generation(*args(Counted("a", log))).awaitTermination()
    assert open(log).read().split() == ["i2"] and stored(spark, str(tmp_path / "out")).count() == 5


@pytest.mark.parametrize("bad", ["[]", "{", b"\xff", json.dumps({"schema_version": 2}), json.dumps({"schema_version": 1, "responses": []})])
def test_bad_reports(bad):
    with pytest.raises(ValueError):
        report.load_report(bad)


def test_udfs(spark):
    rows = spark.createDataFrame([("water water",), (None,)], "t string").select("t", models.embedding_udf(Words)("t").alias("v")).collect()
    assert rows[0].v == [2.01, 0.01, 0.01] and rows[1].v is None


def test_ids_of_large_tables(spark, tmp_path):
    """Numbers with more digits than the padding keep them all."""
    numbers = [0, 7, 1234, 9999, 10000, 12340, 12349, 123400, 1234567, 12345678]
    rows = spark.createDataFrame([(k,) for k in numbers], "k long").select(fx.evidence_id(F.col("k")), fx.item_id(F.col("k"))).collect()
    assert [tuple(r) for r in rows] == [(f"ev-{k:04d}", f"item-{k:06d}") for k in numbers]

    n = 12000
    spark.range(n).select(F.col("id").alias("item_id"), F.lit("text").alias("text")).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(20 * k, "Text.") for k in numbers + [11]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert fx.evidence(spark, str(tmp_path)).select("evidence_id").distinct().count() == n
    assert {r.dataset_item_id: r.topic for r in fx.items(spark, str(tmp_path)).collect()} == {f"item-{k:06d}": f"topic-{k % 10}" for k in numbers + [11]}
    want = []
    for k in numbers + [11]:
        for e in (k % n, n if k % 11 == 0 else k * 7 % n):
            rule = "unknown evidence" if e == n else "topics differ" if e % 10 != k % 10 else None
            want += [(f"item-{k:06d}", f"ev-{e:04d}", rule)] if rule else []
    assert sorted(map(tuple, Q.fk_violations(spark, str(tmp_path)).select("dataset_item_id", "evidence_id", "rule").collect())) == sorted(want)

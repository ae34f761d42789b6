"""The jobs over growing input: what is new is taken, once, and nothing else changes."""

import glob
import json
import os
from pathlib import Path

import pytest

from groundcheck import queries as Q
from jobs import claim_ledger as L, model_scorecards as M

CONFIG = {j: json.loads(Path(j.__file__).with_suffix(".json").read_text()) for j in (L, M)}
SF = "/root/testdata/sf0.001"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


DOCS = "doc_id long, text string, source string"
PASSAGES = "item_id long, text string"
LABELS = "doc_id long, quality int"
EVIDENCE = [(0, "Canberra is the capital city of Australia."), (1, "Water boils at one hundred degrees."), (2, None), (3, "")]


def ledger(spark, out):
    return sorted((r.model_name, r.dataset_item_id, r.claim_id, r.label, round(r.similarity, 6), tuple(r.evidence_ids)) for r in L.ledger(spark, out).collect())


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


@pytest.fixture
def paths(tmp_path):
    return [str(tmp_path / n) for n in ("docs", "passages", "out", "mark")]


def test_ledger_takes_what_is_new(spark, paths):
    docs, passages, out, mark = paths
    put(spark, passages, EVIDENCE, PASSAGES)
    put(spark, docs, [(1, "Canberra is the capital of Australia. Water is wet.", "a/b"), (2, None, "a/b"), (3, " ", None)], DOCS)
    first = L.run(spark, docs, passages, out, mark, CONFIG[L])
    assert first == {"batches": 1, "responses": 3, "claims": 2}
    one = ledger(spark, out)
    assert [(r[0], r[1], r[2], r[3]) for r in one] == [("a/b", "1", "claim-1", "supported"), ("a/b", "1", "claim-2", "unknown")]
    assert one[0][5][0] == "0" and one[0][4] == round(6 / 7, 6)
    before = files(out)
    assert L.run(spark, docs, passages, out, mark, CONFIG[L]) == {"batches": 0, "responses": 0, "claims": 0}
    assert files(out) == before and ledger(spark, out) == one

    put(spark, docs, [(4, "Water boils at one hundred degrees; so it does", "12")], DOCS)
    put(spark, docs, [(5, "nothing of the kind", ""), (6, "Canberra", None)], DOCS)
    again = L.run(spark, docs, passages, out, mark, CONFIG[L] | {"files_per_batch": 1})
    assert again["batches"] == 2 and again["responses"] == 3
    both = ledger(spark, out)
    assert set(one) < set(both) and {r[0] for r in both} == {"a/b", "12", "unknown"}
    assert {f: t for f, t in files(out).items() if f in before} == before  # older partitions are left alone
    assert {r.model_name for r in L.ledger(spark, out).where("model_name = '12'").collect()} == {"12"}  # a number as text


def test_ledger_of_one_run_is_that_of_many(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    rows = [(k, f"Water {k} boils. Canberra is capital {k % 3}", f"s{k % 4}") for k in range(40)]
    put(spark, at("p"), EVIDENCE, PASSAGES)
    put(spark, at("once"), rows, DOCS)
    L.run(spark, at("once"), at("p"), at("once-out"), at("once-mark"), CONFIG[L])
    for lo, hi in ((0, 7), (7, 33), (33, 40)):
        put(spark, at("often"), rows[lo:hi], DOCS)
        L.run(spark, at("often"), at("p"), at("often-out"), at("often-mark"), CONFIG[L])
    assert len(ledger(spark, at("once-out"))) == 80 and ledger(spark, at("once-out")) == ledger(spark, at("often-out"))


def test_failed_batch_is_taken_again_once(spark, paths, monkeypatch):
    docs, passages, out, mark = paths
    put(spark, passages, EVIDENCE, PASSAGES)
    put(spark, docs, [(1, "Canberra. Water", "a"), (2, "Gold", "b")], DOCS)
    plain, calls = L.ledger, []

    def dies(*a):
        calls.append(a)
        raise RuntimeError("lost after the claims were written")

    monkeypatch.setattr(L, "ledger", dies)
    with pytest.raises(Exception, match="lost after"):
        L.run(spark, docs, passages, out, mark, CONFIG[L])
    monkeypatch.setattr(L, "ledger", plain)
    written = ledger(spark, out)
    assert calls and len(written) == 3
    assert L.run(spark, docs, passages, out, mark, CONFIG[L])["batches"] == 1
    assert ledger(spark, out) == written


def test_ledger_of_nothing(spark, paths):
    docs, passages, out, mark = paths
    put(spark, passages, EVIDENCE, PASSAGES)
    put(spark, docs, [], DOCS)
    L.run(spark, docs, passages, out, mark, CONFIG[L])
    assert ledger(spark, out) == [] and L.ledger(spark, out).columns == L.LEDGER.names


def cards(spark, out):
    return {r.model_name: r.asDict() for r in M.read_scorecards(spark, out).collect()}


def test_scorecards_compute_new_models_alone(spark, tmp_path):
    docs, passages, gold, out = (str(tmp_path / n) for n in ("docs", "passages", "gold", "out"))
    put(spark, passages, EVIDENCE, PASSAGES)
    put(spark, gold, [(0, 1), (1, 0), (21, 1), (999, 1), (20, None)], LABELS)
    run = lambda **c: M.run(spark, docs, passages, gold, out, CONFIG[M] | c)
    put(spark, docs, [(0, "Canberra is the capital city of Australia.", "x"), (20, "Water boils at one hundred degrees.", "x"), (1, "Stop the insulin dose", "x"), (21, None, "x"), (None, "no key", "x")], DOCS)
    assert run() == {"models": 2, "computed": 2, "responses": 4, "claims": 3}
    first = cards(spark, out)
    zero, one = first["model-0"], first["model-1"]
    assert (zero["responses"], zero["claims"], zero["supported"], zero["better_than"], zero["gold_accuracy"]) == (2, 2, 2, 1, 1.0)
    assert (one["responses"], one["claims"], one["critical"], one["worse_than"], one["gold_accuracy"]) == (2, 1, 1, 1, 1.0)
    before = files(f"{out}/facts")
    assert run() == {"models": 2, "computed": 0, "responses": 0, "claims": 0}
    assert cards(spark, out) == first and files(f"{out}/facts") == before

    put(spark, docs, [(2, "Water boils at one hundred degrees.", "x"), (3, None, "x")], DOCS)
    assert run() == {"models": 4, "computed": 2, "responses": 2, "claims": 1}
    assert {f: t for f, t in files(f"{out}/facts").items() if f in before} == before  # the facts of other models stay
    grown = cards(spark, out)
    assert set(grown) == {"model-0", "model-1", "model-2", "model-3"} and grown["model-3"]["claims"] == 0 and grown["model-3"]["supported_rate"] is None

    put(spark, docs, [(40, "Canberra", "x")], DOCS)  # one more answer of a known model
    assert run()["computed"] == 1 and cards(spark, out)["model-0"]["claims"] == 3
    assert run(support_threshold=0.99)["computed"] == 4  # other settings, other facts
    assert run(support_threshold=0.99)["computed"] == 0


def test_facts_of_older_answers_are_not_read(spark, tmp_path):
    docs, passages, gold, out = (str(tmp_path / n) for n in ("docs", "passages", "gold", "out"))
    put(spark, passages, EVIDENCE, PASSAGES)
    put(spark, gold, [], LABELS)
    put(spark, docs, [(0, "Canberra", "x"), (1, "Water", "x")], DOCS)
    M.run(spark, docs, passages, gold, out, CONFIG[M])
    other = str(tmp_path / "other")
    put(spark, other, [(0, None, "x")], DOCS)  # the answer was taken back, and a model left
    assert M.run(spark, other, passages, gold, out, CONFIG[M]) == {"models": 1, "computed": 1, "responses": 1, "claims": 0}
    assert {k: v["claims"] for k, v in cards(spark, out).items()} == {"model-0": 0}


def test_run_that_dies_before_marking_is_made_up(spark, tmp_path, monkeypatch):
    docs, passages, gold, out = (str(tmp_path / n) for n in ("docs", "passages", "gold", "out"))
    put(spark, passages, EVIDENCE, PASSAGES)
    put(spark, gold, [(0, 1)], LABELS)
    put(spark, docs, [(0, "Canberra", "x"), (1, "Water", "x")], DOCS)
    plain = M._replace

    def dies(rows, path):
        if path.endswith("marks"):
            raise RuntimeError("lost")
        plain(rows, path)

    monkeypatch.setattr(M, "_replace", dies)
    with pytest.raises(RuntimeError, match="lost"):
        M.run(spark, docs, passages, gold, out, CONFIG[M])
    monkeypatch.setattr(M, "_replace", plain)
    assert M.run(spark, docs, passages, gold, out, CONFIG[M])["computed"] == 2
    assert {k: v["claims"] for k, v in cards(spark, out).items()} == {"model-0": 1, "model-1": 1}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_queries_leave_settings(spark):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert Q.QUERIES["job1_claim_ledger"](spark, SF).count() > 0
    assert Q.QUERIES["job2_model_scorecards"](spark, SF).count() == 20
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_command_line(tmp_path, spark, monkeypatch):
    """Paths and a configuration file; the session is the caller's own to stop in tests."""
    from jobs import _common

    put(spark, tmp_path / "p", EVIDENCE, PASSAGES)
    put(spark, tmp_path / "d", [(1, "Canberra", "a")], DOCS)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    own = tmp_path / "own.json"
    own.write_text(json.dumps(CONFIG[L] | {"top_k": 1}))
    given = [f"--{n}={tmp_path / v}" for n, v in (("responses", "d"), ("passages", "p"), ("output", "o"), ("checkpoint", "c"), ("config", "own.json"))]
    assert _common.command("claim_ledger", "about", L.PATHS, L.run, "none.json", given) == {"batches": 1, "responses": 1, "claims": 1}
    assert [len(r[5]) for r in ledger(spark, str(tmp_path / "o"))] == [1]
    source = Path(L.__file__).parent
    assert not any("llm" in f.read_text() or "corpus_pipeline" in f.read_text() for f in source.glob("*.py"))

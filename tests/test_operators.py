import hashlib
import math
import random
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundcheck.functions import scores as S
from groundcheck.operators import annotations as A, calibration as C, compare, metrics as M, report as R, retrieval, rules, trust as T, verification as V
from groundcheck.queries import QUERIES as QUERIES_OF_ENGINE
from groundcheck.schema import CLAIM_KEY, LABELS, SEVERITIES

TEXTS = ["the cat sat on the mat", "dogs chase the cat", "", "quantum mechanics it's hard", "the the the dog"]
QUERIES = ["cat and dog", "it's quantum", "nothing shared", "the the cat"]


def tables(spark):
    evidence = spark.createDataFrame([(k, f"e{k}", t) for k, t in enumerate(TEXTS)], "pos long, evidence_id string, text string")
    claims = spark.createDataFrame([("m", "i", f"claim-{k}", q) for k, q in enumerate(QUERIES)], "model_name string, dataset_item_id string, claim_id string, claim_text string")
    return claims, evidence


def bm25(query):
    """Scores of all passages, from the definition."""
    tok = lambda t: [x.lower() for x in re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)?", t, re.I)]
    docs = [tok(t) for t in TEXTS]
    average = sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    out = []
    for d in docs:
        score = 0.0
        for w, n in Counter(tok(query)).items():
            if f := d.count(w):
                score += n * math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d) / average))
        out.append(score)
    return out


@pytest.mark.parametrize("group", [1 << 26, 30])
def test_ranking(spark, monkeypatch, group):
    monkeypatch.setattr(retrieval, "GROUP_BYTES", group)  # passages at once, or in several groups
    claims, evidence = tables(spark)
    rng = random.Random(0)
    own = [[rng.gauss(0, 1) for _ in range(4)] for _ in QUERIES]
    other = [[rng.gauss(0, 1) for _ in range(4)] for _ in TEXTS[:-1]] + [[0.0] * 4]
    rows = claims.join(spark.createDataFrame([(f"claim-{k}", v) for k, v in enumerate(own)], "claim_id string, v array<double>"), "claim_id")
    vectors = spark.createDataFrame(list(enumerate(other)), "pos long, vector array<double>")
    found = retrieval.rank_passages(rows, evidence, retrieval.bm25_postings(evidence), 3, F.col("v"), vectors).collect()

    def unit(a, b):
        size = math.hypot(*a) * math.hypot(*b)
        return 0.0 if size == 0 else (sum(x * y for x, y in zip(a, b)) / size + 1) / 2

    for r in found:
        k = int(r.claim_id[-1])
        scores, top = bm25(QUERIES[k]), max(bm25(QUERIES[k]))
        combined = [0.5 * (s / top if top else 0) + 0.5 * unit(own[k], o) for s, o in zip(scores, other)]
        order = sorted(range(len(TEXTS)), key=lambda i: (-round(combined[i], 12), i))[:3]
        assert [h.pos for h in r.hits] == order and [h.rank for h in r.hits] == [1, 2, 3] and [h.evidence_id for h in r.hits] == [f"e{i}" for i in order]
        assert [h.combined_score for h in r.hits] == pytest.approx([combined[i] for i in order])
        assert [h.bm25_score for h in r.hits] == pytest.approx([scores[i] for i in order])


def test_passages_without_a_hit_fill_up(spark):
    claims, evidence = tables(spark)
    found = {r.claim_id: r.hits for r in retrieval.rank_passages(claims, evidence, retrieval.bm25_postings(evidence), 4, lexical=1.0, dense=0.0).collect()}
    assert [h.pos for h in found["claim-2"]] == [0, 1, 2, 3] and all(h.combined_score == 0 for h in found["claim-2"])
    none = evidence.limit(0)
    assert all(r.hits == [] for r in retrieval.rank_passages(claims, none, retrieval.bm25_postings(none), 4, lexical=1.0, dense=0.0).collect())
    with pytest.raises(ValueError):
        retrieval.rank_passages(claims, evidence, retrieval.bm25_postings(evidence), 0)


def test_bm25_pairs(spark):
    claims, evidence = tables(spark)
    found = {(r.claim_id, r.pos): r.bm25_score for r in retrieval.bm25_scores(claims, evidence, CLAIM_KEY).collect()}
    for k, q in enumerate(QUERIES):
        for i, s in enumerate(bm25(q)):
            assert found.get((f"claim-{k}", i), 0.0) == pytest.approx(s)


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q1", "e3", 1), ("q1", "e1", 2), ("q1", "e2", 3), ("q2", "e2", 1), ("q2", "e3", 2), ("q3", "e9", 1)], "q string, evidence_id string, rank int")
    gold = spark.createDataFrame([("q1", ["e1", "e2"]), ("q2", ["e2"]), ("q3", [])], "q string, evidence_ids array<string>")
    found = {r.q: r for r in retrieval.ranking_metrics(ranked, gold, ["q"], (2,)).collect()}
    assert (found["q1"].recall_at_2, found["q1"].precision_at_2, found["q1"].reciprocal_rank) == (0.5, 0.5, 0.5)
    assert (found["q3"].recall_at_2, found["q3"].precision_at_2, found["q3"].reciprocal_rank) == (0.0, 0.0, 0.0)
    assert (found["q1"].reciprocal_rank + found["q2"].reciprocal_rank) / 2 == 0.75


def test_first_of_equal_passages_is_named(spark):
    scores = "array<struct<evidence_id:string,rank:int,retrieval_score:double,similarity:double,support_score:double,contradiction_score:double,neutral_score:double>>"
    rows = spark.createDataFrame([(1, [("b", 1, 1.0, 1.0, 0.9, 0.0, 0.0), ("a", 2, 1.0, 0.5, 0.9, 0.0, 0.0)]), (2, []), (3, [("a", 1, 1.0, 1.0, 0.2, 0.3, 0.1)])], f"k int, evidence_scores {scores}")
    found = {r.k: r for r in V.verify(rows).collect()}
    assert found[1].verification_reason == "Evidence 'b' most strongly entails the claim (adjusted support score 0.900)."
    assert (found[2].label, found[2].verification_reason, found[2].similarity) == ("unknown", "No evidence passages were retrieved for this claim.", 0.0)
    assert found[3].verification_reason.endswith("(support 0.200; contradiction 0.300).")


def fact(model, item, k, label, similarity=0.5, severity=None, confidence=None, hits=()):
    return (model, item, f"claim-{k}", label, similarity, severity, confidence, [(h,) for h in hits])


FACTS = "model_name string, dataset_item_id string, claim_id string, label string, similarity double, severity string, confidence double, hits array<struct<evidence_id:string>>"


def test_trust(spark):
    rows = [fact("a", "1", 1, "supported", 0.9, None, 0.9), fact("a", "1", 2, "unknown", 0.4, None, 0.2), fact("b", "1", 1, "contradicted", 0.2, "critical", 0.95), fact("c", "1", 1, "supported", 1.0)]
    cons = spark.createDataFrame([("a", "1", 0.8), ("b", "1", 0.8), ("c", "1", 1.0)], "model_name string, dataset_item_id string, consistency_score double")
    found = {r.model_name: r for r in T.trust_scores(spark.createDataFrame(rows, FACTS), cons).collect()}
    a = found["a"]
    assert (a.factual_score, a.semantic_alignment, a.confidence_calibration, a.severity_penalty) == pytest.approx((0.5, 0.65, 0.85, 0)) and a.trust_score == pytest.approx(0.6425)
    assert (found["b"].severity_penalty, found["b"].trust_score) == (0.6, 0.0)
    assert found["c"].confidence_calibration is None and "unavailable" in found["c"].trust_rationale
    with pytest.raises(ValueError):
        S.TrustPolicy(weights=(1, 1, 0, 0))


def two_by_two(spark):
    rows = [fact("model-a", i, 1, "supported", 0.95, None, c, ["e1"]) for i, c in (("1", 0.9), ("2", 0.85))] + [fact("model-b", "1", 1, "contradicted", 0.95, "moderate", 0.2, ["e1"]), fact("model-b", "2", 1, "unknown", 0.95, "mild", 0.8, [])]
    facts = spark.createDataFrame(rows, FACTS)
    responses = spark.createDataFrame([(m, i, "t", 0.5) for m in ("model-a", "model-b", "model-c") for i in ("1", "2")], "model_name string, dataset_item_id string, text string, confidence double")
    gold = spark.createDataFrame([("model-a", "1", "claim-1", "supported", ["e1"]), ("model-a", "2", "claim-1", "supported", []), ("model-b", "1", "claim-1", "contradicted", ["e1", "e2"]), ("model-b", "2", "claim-1", "supported", ["e3"])], "model_name string, dataset_item_id string, claim_id string, gold_label string, evidence_ids array<string>")
    return facts, responses, gold


def test_model_metrics(spark):
    facts, responses, gold = two_by_two(spark)
    found = {r.model_name: r for r in M.model_metrics(facts, responses, gold).collect()}
    a, b, c = (found[f"model-{x}"] for x in "abc")
    assert (a.supported_rate, b.hallucination_rate, b.severity_weighted_error_rate) == (1.0, 0.5, 3 / 16)
    assert (a.verification_accuracy, b.verification_accuracy, a.retrieval_recall_at_k, b.retrieval_recall_at_k) == (1.0, 0.5, 1.0, 0.25)
    assert (a.confidence_brier_score, a.confidence_ece) == pytest.approx((0.01625, 0.125))
    assert (b.confidence_brier_score, b.confidence_ece) == pytest.approx(((0.8**2 + 0.8**2) / 2, 0.8))
    assert c.response_count == 2 and c.claim_count == 0 and c.supported_rate is None and c.verification_accuracy is None and c.confidence_ece is None
    plain = {r.model_name: r for r in M.model_metrics(facts, responses).collect()}
    assert plain["model-a"].verification_accuracy is None and plain["model-a"].average_trust_score is None


def test_metrics_agree_with_their_parts(spark):
    facts, responses, gold = two_by_two(spark)
    whole = {r.model_name: r for r in M.model_metrics(facts, responses, gold).collect()}
    pairs = M.gold_pairs(facts, gold)
    for r in M.macro_f1(M.class_metrics(pairs, ["model_name"]), ["model_name"]).collect():
        assert whole[r.model_name].verification_macro_f1 == pytest.approx(r.verification_macro_f1)
    for r in M.confidence_calibration(facts, gold, ["model_name"]).collect():
        assert (whole[r.model_name].confidence_brier_score, whole[r.model_name].confidence_ece) == pytest.approx((r.confidence_brier_score, r.confidence_ece))


@pytest.mark.parametrize("confidence, want", [(0.0, 0), (0.1, 1), (0.3, 3), (0.7, 7), (0.99, 9), (1.0, 9), (0.09999, 0)])
def test_buckets(spark, confidence, want):
    assert spark.range(1).select(M.bucket(F.lit(confidence))).first()[0] == want


def test_comparison(spark):
    facts, responses, _ = two_by_two(spark)
    pairs = compare.paired_outcomes(compare.item_outcomes(facts, responses))
    found = {(r.model_a, r.model_b): r for r in compare.paired_comparison(pairs).collect()}
    ab = found["model-a", "model-b"]
    assert (ab.mean_difference, ab.paired_item_count, ab.model_a_error_only_items, ab.model_b_error_only_items) == (1.0, 2, 0, 1)
    assert found["model-a", "model-c"].paired_item_count == 0 and found["model-b", "model-c"].model_a_error_only_items == 1
    rows = spark.createDataFrame([("a", "b", str(k), 0.7, 0.5) for k in range(2)], "model_a string, model_b string, dataset_item_id string, rate_a double, rate_b double")
    r = compare.bootstrap_exact(rows, repetitions=100).first()
    assert (r.mean_difference, r.lower, r.upper, r.sample_size) == pytest.approx((0.2, 0.2, 0.2, 2))
    h = compare.bootstrap_hash(rows, repetitions=50).first()
    assert (h.mean_difference, h.lower, h.upper, h.repetitions) == pytest.approx((0.2, 0.2, 0.2, 50))
    with pytest.raises(ValueError):
        compare.check_bootstrap(0, 0.95)
    with pytest.raises(ValueError):
        compare.check_bootstrap(10, 1.0)


def test_bootstrap_hash_draws_2000(spark):
    """Like the exact form, 2000 repetitions unless told otherwise, each as md5 says."""
    d = [0.0, 1.0, -0.5, 0.25, 0.75]
    rows = spark.createDataFrame([("a", "b", str(k), x, 0.0) for k, x in enumerate(d)], "model_a string, model_b string, dataset_item_id string, rate_a double, rate_b double")
    draw = lambda rep, k: int(hashlib.md5(f"0|{rep}|{k}".encode()).hexdigest()[:8], 16) % len(d)
    means = sorted(sum(d[draw(rep, k)] for k in range(len(d))) / len(d) for rep in range(2000))
    h = compare.bootstrap_hash(rows).first()
    assert h.repetitions == 2000 == compare.bootstrap_exact(rows).first().repetitions
    assert (h.lower, h.upper) == pytest.approx((compare.percentile(means, 0.025), compare.percentile(means, 0.975)))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_drawn_means_are_those_of_the_generator(n):
    """To the last bit, whatever the number of items."""
    values = [random.Random(n).choice([0.1, 1 / 3, -0.7, 1e9, -1e9, 0.0]) * k for k in range(1, n + 1)]
    draw = random.Random(5)
    assert compare._drawn_means(values, 40, 5) == [sum(draw.choice(values) for _ in values) / n for _ in range(40)]


def test_bootstrap_hash_in_blocks(spark, monkeypatch):
    """Items in several lists and pairs of different sizes give what one list gives."""
    rows = spark.createDataFrame([("a", m, f"{k:03d}", (k * 37 % 11) / 7, 0.1) for m, n in (("b", 40), ("c", 23)) for k in range(n)], "model_a string, model_b string, dataset_item_id string, rate_a double, rate_b double")
    want = {r.model_b: r for r in compare.bootstrap_hash(rows, repetitions=50).collect()}
    monkeypatch.setattr(compare, "PLACES", 7)
    for r in compare.bootstrap_hash(rows, repetitions=50).collect():
        assert (r.lower, r.upper, r.repetitions, r.sample_size) == pytest.approx((want[r.model_b].lower, want[r.model_b].upper, 50, 40 if r.model_b == "b" else 23))


def brute_grid(obs, values):
    out = {}
    for a in values:
        for b in values:
            pred = ["supported" if s >= a and s > c else "contradicted" if c >= b and c > s else "unknown" for s, c, _ in obs]
            gold = [g for *_, g in obs]
            f1 = []
            for x in set(gold):
                tp = sum(p == g == x for p, g in zip(pred, gold))
                f1.append(2 * tp / (sum(p == x for p in pred) + sum(g == x for g in gold)))
            recalls = [sum(p == g == x for p, g in zip(pred, gold)) / gold.count(x) for x in set(gold)]
            out[a, b] = (sum(p == g for p, g in zip(pred, gold)) / len(gold), sum(f1) / len(f1), sum(recalls) / len(recalls), sum(p != "unknown" for p in pred) / len(pred))
    return out


def test_verification_grid(spark):
    rng = random.Random(2)
    obs = [(round(rng.random(), 1), round(rng.random(), 1), rng.choice(LABELS[:2])) for _ in range(60)]
    rows = spark.createDataFrame(obs, "support_score double, contradiction_score double, gold_label string")
    values = [0.0, 0.3, 0.5, 0.7, 1.0]
    want = brute_grid(obs, values)
    found = {(r.support_threshold, r.contradiction_threshold): (r.accuracy, r.macro_f1, r.balanced_accuracy, r.coverage) for r in C.verification_grid(rows, values).collect()}
    assert found.keys() == want.keys()
    for k in want:
        assert found[k] == pytest.approx(want[k])
    three = spark.createDataFrame([(0.9, 0.1, "supported"), (0.1, 0.7, "contradicted"), (0.5, 0.4, "unknown")], "support_score double, contradiction_score double, gold_label string")
    best = C.best_verification_thresholds(C.verification_grid(three, [0.6, 0.8])).first()
    assert (best.support_threshold, best.contradiction_threshold, best.macro_f1, best.coverage) == pytest.approx((0.6, 0.6, 1.0, 2 / 3))
    with pytest.raises(ValueError):
        C.verification_grid(three, [1.5])
    with pytest.raises(ValueError):
        C.best_verification_thresholds(C.verification_grid(three), "f2")


def test_severity_search(spark):
    rows = spark.createDataFrame([("x", "contradicted", 0.9, "severe"), ("y", "contradicted", 0.3, "moderate"), ("z", "unknown", 0.1, None)], "claim_text string, label string, contradiction_score double, gold_severity string")
    best = C.best_severity_threshold(C.severity_grid(rows, [0.5, 0.95])).first()
    assert (best.threshold, best.accuracy, best.quadratic_weighted_kappa, best.sample_size) == (0.5, 1.0, 1.0, 2)


def test_severity_metrics(spark):
    rng = random.Random(3)
    pairs = [(rng.choice(SEVERITIES), rng.choice(SEVERITIES[:3])) for _ in range(80)]
    r = C.severity_metrics(spark.createDataFrame(pairs, "gold string, predicted string"), []).first()
    n = Counter(pairs)
    w = lambda a, b: ((SEVERITIES.index(a) - SEVERITIES.index(b)) / 3) ** 2
    rows, cols = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    observed = sum(w(a, b) * n[a, b] / 80 for a in SEVERITIES for b in SEVERITIES)
    expected = sum(w(a, b) * rows[a] * cols[b] / 6400 for a in SEVERITIES for b in SEVERITIES)
    assert r.quadratic_weighted_kappa == pytest.approx(1 - observed / expected) and r.accuracy == pytest.approx(sum(a == b for a, b in pairs) / 80)
    same = C.severity_metrics(spark.createDataFrame([("mild", "mild")], "gold string, predicted string"), []).first()
    assert same.quadratic_weighted_kappa is None and same.macro_f1 == 1.0


def test_missing_severity_is_an_error(spark):
    key = "model_name string, dataset_item_id string, claim_id string"
    facts = spark.createDataFrame([("m", "i", "c", None)], f"{key}, severity string")
    gold = spark.createDataFrame([("m", "i", "c", "mild")], f"{key}, gold_severity string")
    assert C.severity_pairs(facts, gold, CLAIM_KEY, strict=False).count() == 0
    with pytest.raises(Exception, match="no predicted severity"):
        C.severity_pairs(facts, gold, CLAIM_KEY).collect()


def test_topic_split(spark):
    items = spark.createDataFrame([(f"t{k:02d}-{j}", f"topic {k:02d}") for k in range(30) for j in range(10)], "dataset_item_id string, topic string")
    for split in (C.topic_split(items), C.topic_split_hash(items)):
        counts = {r.split: (r.t, r.n) for r in split.groupBy("split").agg(F.count_distinct("topic").alias("t"), F.count("*").alias("n")).collect()}
        assert counts == {"train": (18, 180), "dev": (6, 60), "test": (6, 60)}
    topics = sorted(f"topic {k:02d}" for k in range(30))
    random.Random(42).shuffle(topics)
    assert {r.topic for r in C.topic_split(items).where("split = 'test'").collect()} == set(topics[:6])
    for bad in ((0.0, 0.2), (0.5, 0.5), (0.4, 0.59)):
        with pytest.raises(ValueError):
            C.split_sizes(5, *bad)
    with pytest.raises(ValueError):
        C.split_sizes(2, 0.2, 0.2)


def test_agreement(spark):
    key = "model_name string, dataset_item_id string, claim_id string, label string"
    a = spark.createDataFrame([("m", "i", "1", "supported"), ("m", "i", "2", "contradicted")], key)
    b = spark.createDataFrame([("m", "i", "1", "supported"), ("m", "i", "2", "unknown")], key)
    r = A.agreement(A.label_pairs(a, b)).first()
    assert (r.claim_count, r.exact_agreement, r.cohen_kappa) == pytest.approx((2, 0.5, 1 / 3))
    one = a.limit(1)
    assert A.agreement(A.label_pairs(one, one)).first().cohen_kappa is None
    assert A.agreement(A.label_pairs(a.limit(0), b)).collect() == []
    assert [(x.claim_id, x.only) for x in A.unmatched(a, b.where("claim_id = '1'")).collect()] == [("2", "first")]


def test_explanations(spark):
    responses = spark.createDataFrame([("m", "i", "A <b> & c. Then d.", None), ("m", "j", "", None)], "model_name string, dataset_item_id string, text string, confidence double")
    facts = spark.createDataFrame([("m", "i", "claim-2", 11, 18, "Then d.", "supported", None), ("m", "i", "claim-1", 0, 10, "A <b> & c.", "contradicted", "moderate")], "model_name string, dataset_item_id string, claim_id string, claim_start int, claim_end int, claim_text string, label string, severity string")
    found = {r.dataset_item_id: r.html for r in R.explain_html(facts, responses).collect()}
    assert found["i"] == '<mark data-claim-id="claim-1" data-verification="contradicted" data-severity="moderate">A &lt;b&gt; &amp; c.</mark> <mark data-claim-id="claim-2" data-verification="supported">Then d.</mark>'
    assert found["j"] == ""
    assert R.span_violations(facts, responses).collect() == []
    shifted = facts.withColumn("claim_start", F.when(F.col("claim_id") == "claim-2", 5).otherwise(F.col("claim_start")))
    assert {r.rule for r in R.span_violations(shifted, responses).collect()} == {"span is not the claim", "spans overlap"}


def test_rules(spark):
    prompts = spark.createDataFrame([("1", "t", "p", ["e1"]), ("2", "t", " ", ["e2", "e9"]), ("2", "u", "p", [])], "dataset_item_id string, topic string, prompt string, reference_evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1", "t", "x", "s"), ("e2", "u", "x", "s")], "evidence_id string, topic string, text string, source string")
    found = sorted((r.table, r.id, r.rule) for r in rules.benchmark_violations(prompts, evidence).collect())
    assert found == [("prompts", "2", "no reference"), ("prompts", "2", "prompt is blank"), ("prompts", "2", "repeated id"), ("prompts", "2", "topics differ"), ("prompts", "2", "unknown evidence")]
    with pytest.raises(rules.RuleError):
        rules.require(rules.benchmark_violations(prompts, evidence))
    rules.require(rules.benchmark_violations(prompts.limit(0), evidence.limit(0)))


def test_pending_pairs_are_pairs_that_were_asked_for(spark):
    """A last item of fewer models has no other models pending (the 0.1 GB tables end in the middle of an item)."""
    spark.createDataFrame([(k, f"text {k}") for k in range(43)], "doc_id long, text string").write.mode("overwrite").parquet(f"{(folder := tempfile.mkdtemp())}/documents.parquet")
    found = [tuple(r) for r in QUERIES_OF_ENGINE["resume_pending"](spark, folder).select("model_name", "dataset_item_id").collect()]
    assert sorted(found) == sorted((f"model-{k % 20}", f"item-{k // 20:06d}") for k in range(0, 43, 6))


def test_freeze_rules(spark):
    prompts = spark.createDataFrame([("1", "d", "t", "factual", "high", "p", ["e1"]), ("2", "x", "t", "other", "low", "p", ["e1"])], "dataset_item_id string, domain string, topic string, task_type string, risk_level string, prompt string, reference_evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1", "t", "x", "WHO", "https://www.who.int/a", "2024-02-30"), ("e2", "t", "x", "WHO", "http://who.int.evil/", "2024-02-28")], "evidence_id string, topic string, text string, source string, source_url string, publication_date string")
    found = {(r.id, r.rule) for r in rules.freeze_violations(prompts, evidence, "d", {"WHO": ("who.int",)}, (2, 2), 2).collect()}
    assert found == {("2", "domain"), ("2", "task_type"), ("2", "risk_level"), ("e1", "publication_date"), ("e2", "url is not https"), ("e2", "url host is not the source's"), ("e2", "url is generic")}


def test_evidence_detail(spark):
    """A passage without scores keeps nulls; of repeated scores the last counts; a claim's own row decides, also where its key comes again."""
    hit, score = "struct<evidence:struct<id:string>,combined_score:double>", "struct<evidence:struct<id:string>,similarity:double,support_score:double,contradiction_score:double>"
    s = lambda i, x: ((i,), x, x, x)
    rows = [
        ("m", "i", "claim-1", [(("a",), 0.9), (("b",), 0.8), ((None,), 0.7)], [s("a", 0.1), s("c", 0.2), s("a", 0.3), s(None, 0.4)]),
        ("m", "i", "claim-1", [(("b",), 0.6)], [s("b", 0.5)]),
        ("m", "i", "claim-2", [(("a",), 0.5)], None),
        ("m", "i", "claim-3", [], [s("a", 0.1)]),
        ("m", "i", "claim-4", None, [s("a", 0.1)]),
    ]
    flat = spark.createDataFrame(rows, f"model_name string, dataset_item_id string, claim_id string, evidence array<{hit}>, evidence_scores array<{score}>")
    found = sorted(((r.claim_id, r.place, r.evidence_id, r.combined_score, r.support_score) for r in R.evidence_detail(flat).collect()), key=str)
    assert found == [("claim-1", 0, "a", 0.9, 0.3), ("claim-1", 0, "b", 0.6, 0.5), ("claim-1", 1, "b", 0.8, None), ("claim-1", 2, None, 0.7, None), ("claim-2", 0, "a", 0.5, None)]

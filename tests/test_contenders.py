"""Ranking over several groups of passages against one group, and what leaves a group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundcheck.operators import retrieval, verification as V
from groundcheck.operators.contenders import contenders


def tables(spark, passages=700, claims=40, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([5, 60])]) for _ in range(n))
    rows = [(k, f"e{k:04}", text(rng.randint(0, 12))) for k in range(passages)]
    rows[10:20] = [(k, f"e{k:04}", rows[9][2]) for k in range(10, 20)]  # equal passages: ties go by position
    near = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(passages)]
    near[12] = near[13] = near[9]
    near[5] = [0.0] * 4
    own = [("m", "i", f"claim-{k}", text(rng.randint(0, 8)), None if k == 3 else [rng.gauss(0, 1) for _ in range(4)]) for k in range(claims)]
    evidence = spark.createDataFrame(rows, "pos long, evidence_id string, text string")
    return spark.createDataFrame(own, "model_name string, dataset_item_id string, claim_id string, claim_text string, v array<double>").repartition(3), evidence, spark.createDataFrame(list(enumerate(near)), "pos long, vector array<double>")


def hits(df):
    return {r.claim_id: [tuple(round(x, 9) if isinstance(x, float) else x for x in h) for h in r.hits] for r in df.collect()}


@pytest.mark.parametrize("lexical,dense,normalise", [(0.5, 0.5, True), (1.0, 0.0, True), (0.0, 1.0, True), (0.3, 0.7, False), (1.0, 0.0, False)])
def test_groups_rank_as_one(spark, monkeypatch, lexical, dense, normalise):
    claims, evidence, vectors = tables(spark)
    postings, checkpoints, plain = retrieval.bm25_postings(evidence), [], retrieval.cut

    def rank():
        return hits(retrieval.rank_passages(claims, evidence, postings, 5, F.col("v") if dense else None, vectors if dense else None, lexical, dense, normalise, overlap=True))

    one = rank()
    monkeypatch.setattr(retrieval, "cut", lambda rows: checkpoints.append(1) or plain(rows))
    monkeypatch.setattr(retrieval, "GROUP_BYTES", 1_200_000 if dense else 30_000)
    monkeypatch.setattr(retrieval, "BLOCK", 32)
    assert len(list(retrieval._groups(evidence, postings, vectors if dense else None))) > 4
    assert rank() == one and len(one) == 40 and all(len(h) == 5 for h in one.values())
    assert len(checkpoints) == 1


def test_pairs_and_baseline_of_groups(spark, monkeypatch):
    claims, evidence, _ = tables(spark)
    pairs = lambda: sorted((r.claim_id, r.pos, round(r.bm25_score, 9)) for r in retrieval.bm25_scores(claims, evidence, ["claim_id"]).collect())
    labels = lambda: {r.claim_id: (r.label, r.similarity) for r in V.baseline_verify(retrieval.baseline_ranking(claims, evidence), 0.3).collect()}
    one = pairs(), labels()
    monkeypatch.setattr(retrieval, "GROUP_BYTES", 60_000)
    assert (pairs(), labels()) == one and len({x[0] for x in one[1].values()}) == 2


def test_what_leaves_a_group_is_enough():
    """Whatever divides the lexical scores, the k best are among what is kept; and blocks that can't matter are passed over."""
    rng = np.random.default_rng(0)
    claims, passages, size, k = 6, 4000, 50, 4
    s = np.where(rng.random((claims, passages)) < 0.2, rng.gamma(2, 1, (claims, passages)), 0)
    s[:, 300:] *= 0.1  # the best come first
    e = np.round(rng.random((claims, passages)) * np.where(np.arange(passages) < 300, 1, 0.3), 3)
    blocks = [(a, a + size) for a in range(0, passages, size)]
    part = lambda x: lambda b: x[:, b[0] : b[1]]
    at, p, own_s, own_e, over = contenders(claims, blocks, lambda b: s[:, b[0] : b[1]].max(axis=1), part(s), part(e), k, (0.5, 0.5), np.full(claims, 50.0))
    assert (s[at, p] == own_s).all() and (e[at, p] == own_e).all() and over > len(blocks) / 2
    assert len(at) < 40 * claims
    for top in (0.01, 1, 7, 300):
        both = np.round(s / top + e, 12)
        for c in range(claims):
            first = np.argsort(-both[c], kind="stable")[:k]
            assert set(first) <= set(p[at == c])

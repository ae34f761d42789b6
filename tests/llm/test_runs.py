"""Periodic runs against all stretches of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from groundcheck.llm import periodic_runs as R
from groundcheck.llm.periodic_runs import DIGEST, digest, find_runs, periodic_runs
from groundcheck.llm.queries import _planted


def brute(w, shortest=24):
    """Every maximal stretch of every period, the smallest period of each."""
    w, n, out = list(w), len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            begin = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - begin >= max(shortest, 3 * p):
                out.setdefault((begin, i + p), p)
    return sorted((a, b - a, p) for (a, b), p in out.items())


def kept(n, runs):
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    return [k for k in range(n) if k not in gone]


def sample(rng):
    """Random words with repeats of all kinds, some within others."""
    w = []
    for _ in range(rng.randint(0, 6)):
        w += [rng.randint(0, rng.choice([1, 2, 5, 400])) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            unit = [rng.randint(0, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.4:
                unit = unit * rng.randint(1, 12) + [rng.randint(0, 3)]
            w += (unit * rng.randint(1, 9))[: rng.randint(1, 400)]
    return w


@pytest.mark.parametrize("shortest", [1, 6, 24])
def test_random_words(shortest):
    rng = random.Random(shortest)
    for _ in range(300):
        w = sample(rng)
        runs = find_runs(np.array(w, np.int64), shortest)
        assert runs == brute(w, shortest)
        assert R.collapsed(len(w), runs).tolist() == kept(len(w), runs)


def test_known_words():
    word = lambda s: np.array([ord(c) for c in s])
    assert find_runs(word("a" * 24)) == [(0, 24, 1)] and find_runs(word("a" * 23)) == []
    assert find_runs(word("x" + "abcdefgh" * 3 + "y")) == [(1, 24, 8)]
    assert find_runs(word("abcdefghi" * 3)) == [(0, 27, 9)] and find_runs(word("abcdefghi" * 2 + "abcdefgh")) == []
    assert find_runs(word("ab" * 20 + "b" * 30)) == [(0, 40, 2), (39, 31, 1)]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 3000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert find_runs(word(fibonacci[-1])) == brute(fibonacci[-1])
    inner = ("a" * 30 + "bcdefg") * 5
    assert find_runs(word(inner)) == brute(inner) and find_runs(word(inner))[0][2] == 1


def test_many_points_at_once(monkeypatch):
    """Grids cut anywhere and short comparisons find the same."""
    rng = random.Random(7)
    words = [np.array(sample(rng), np.int64) for _ in range(40)]
    whole = [find_runs(w) for w in words]
    monkeypatch.setattr(R, "PROBES", 13)
    monkeypatch.setattr(R, "NEAR", 2)
    monkeypatch.setattr(R, "FAR", 5)
    assert [find_runs(w) for w in words] == whole


def test_points_within_runs_are_skipped(monkeypatch):
    calls, plain = [], R._extend
    monkeypatch.setattr(R, "_extend", lambda *a: calls.append(a) or plain(*a))
    assert find_runs(np.zeros(30000, np.int64)) == [(0, 30000, 1)]
    assert len(calls) == 1


def plainly(doc_id, text):
    """The contract, word by word."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs, best = brute(words), None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(" ".join(words[k] for k in kept(n, runs)).encode()).hexdigest())


def query(docs):
    found = periodic_runs(docs, derive=digest, schema=DIGEST, order=_planted).select("row.doc_id", *DIGEST.names)
    return sorted(map(tuple, found.collect()), key=str)


def test_documents(odd):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    known = {}
    expected = [known.setdefault((i, t), plainly(i, t)) if len(t or "") < 100000 else None for i, t in texts]
    found = query(odd)
    assert len(found) == len(texts)
    assert [f for f in found if f in set(expected)] == sorted((e for e in expected if e), key=str)
    assert any(r[1] for r in found) and sum(e is None for e in expected) == len(found) - sum(f in set(expected) for f in found)


def test_whole_table(spark):
    """The query over a whole table, against the contract word by word."""
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    from groundcheck.llm.queries import op12_periodic_runs

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, sf).collect()}
    assert len(found) == len(docs)
    assert all(found[r.doc_id] == plainly(r.doc_id, r.text) for r in docs if len((r.text or "").split()) < 4000)


def test_edges(spark, empty):
    long = "tick tock " * 850_000
    other = " ".join(f"w{k * k % 99991}" for k in range(120_000))
    rows = [(1, long), (1, long), (2, other), (3, None), (None, "a " * 30), (4, ""), (5, " \n ")]
    df = spark.createDataFrame([(*r, "k", 1, "t") for r in rows], "a long, b string, c string, d int, e string").toDF("doc_id", "text", "key", "Doc_Id", "TEXT")
    out = periodic_runs(df).collect()
    found = sorted(((r.row[0] or 0, r.n_words, len(r.runs), r.collapsed[:20]) for r in out), key=str)
    assert found == [(0, 30, 1, "a"), (1, 1_700_000, 1, "tick tock"), (1, 1_700_000, 1, "tick tock"), (2, 120_000, 0, other[:20]), (3, 0, 0, ""), (4, 0, 0, ""), (5, 0, 0, "")]
    assert {tuple(r.row)[2:] for r in out} == {("k", 1, "t")}
    assert periodic_runs(empty).collect() == []

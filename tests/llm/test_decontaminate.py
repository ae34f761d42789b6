import re

import numpy as np
import pytest

from groundcheck.llm.decontaminate import find_contamination
from groundcheck.llm.fm_index import BitRank, FMIndex, WaveletMatrix, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(rows, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = []
    for i, t, _ in rows:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in sizes:
                got = wins.get(tuple(w[k : k + n]), ()) if k + n <= len(w) else ()
                if got:
                    found |= got
                    hit.update(range(k, k + n))
        out.append((i if i is not None else -1, len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.fixture(scope="module")
def items(rows):
    return [(1, " ".join(rows[4][1].split()[:15])), (2, "shared5, SHARED6 shared7!"), (3, None), (4, ""), (None, "lazy dog"), (2, "shared5, SHARED6 shared7!"), (5, " ".join(f"shared{k}" for k in range(20, 45))), (6, "no such words here at all"), (7, "ä ö 85")]


def test_contamination(spark, docs, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 40):  # in one pass and in several
        out = find_contamination(docs, bench, block_bytes=block).collect()
        assert sorted((r.row.doc_id, r.n_words, r.n_hit, r["items"]) for r in out) == brute(rows, items)


def test_spans_cover_the_hits(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in find_contamination(docs, bench).collect():
        text = (r.text or "").encode()
        inside = sum(len(words(text[s.begin : s.end].decode())) for s in r.spans)
        assert inside == r.n_hit
        assert all(a.end <= b.begin for a, b in zip(r.spans, r.spans[1:]))


def test_edges(spark, odd, empty, docs, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(empty, bench).collect() == []
    assert all(r.n_hit == 0 for r in find_contamination(docs, none).collect())
    assert find_contamination(odd, bench).count() == len(rows) + 5


@pytest.mark.parametrize("n", [0, 1, 5, 200, 3000])
def test_fm_index(n):
    rng = np.random.default_rng(n)
    s = rng.integers(0, 5, n)
    if n == 3000:
        s[1500:2500] = s[:1000]
    t = np.append(s + 1, 0)
    assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    index = FMIndex(s, 5, sample=7)
    phrases, size = rng.integers(0, 5, (40, 6)), rng.integers(1, 7, 40)
    lo, hi = index.search(phrases, size)
    for p, k, a, b in zip(phrases, size, lo, hi):
        want = [i for i in range(n - k + 1) if (s[i : i + k] == p[:k]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_ranks():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, 300)
    rank = BitRank(bits)
    assert rank.ones(np.arange(301)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
    s = rng.integers(0, 9, 300)
    tree = WaveletMatrix(s, 9)
    zero = np.zeros(300, np.int64)
    for c in range(9):
        got = tree.descend(np.full(300, c), np.arange(300)) - tree.descend(np.full(300, c), zero)
        assert got.tolist() == [int((s[:i] == c).sum()) for i in range(300)]
    assert tree.access(np.arange(300))[0].tolist() == s.tolist()

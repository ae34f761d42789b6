import re

import numpy as np
import pyarrow as pa
import pytest

from groundcheck.llm import substring_dedup as S


def brute(rows, window=20):
    seen, out = {}, {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[k : k + window]), (i, k)) != (i, k):
                gone.update(range(k, k + window))
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def found(df):
    return {r.id: (r.n_words, r.n_removed, r.text) for r in df.collect()}


def test_substring_dedup(docs, rows):
    assert found(S.substring_dedup(docs)) == brute(rows)


def test_shorter_windows(docs, rows):
    assert found(S.substring_dedup(docs, window=5)) == brute(rows, 5)


def test_edges(odd, empty, rows):
    assert S.substring_dedup(empty).collect() == []
    out = S.substring_dedup(odd).collect()
    assert len(out) == len(rows) + 5
    twice = [r for r in out if r.id == 85]
    assert len(twice) == 2 and twice[0] == twice[1]  # the same place: neither is earlier
    assert [r.n_removed for r in out if r.id is None] == [0]  # null ids come first


class Tasks:
    """Stands for Spark's task context; ``at`` is the task that runs."""

    def __init__(self, monkeypatch):
        self.at = 0
        monkeypatch.setattr(S.TaskContext, "get", lambda: self)

    def partitionId(self):
        return self.at

    taskAttemptId = partitionId


def table(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * len(rows), pa.int64()), pa.array([r[1] for r in rows])], names=["id", "mark", "text"])


def ask(tasks, parts, window, bits, base, files=2):
    """The sketch of some partitions and its answers, as the operator makes them."""
    asked, names = [], {}
    for tasks.at, part in enumerate(parts):
        asked += S._sketch(window, bits)(iter([part]))
    told = pa.Table.from_batches(S._answer(S._segment_bits(bits))(pa.Table.from_batches(asked).sort_by("segment").to_batches()))
    told = told.sort_by([("sender", "ascending"), ("flush", "ascending"), ("segment", "ascending")])
    for tasks.at in range(files):
        own = told.filter(pa.array([x % files == tasks.at for x in told.column("sender").to_pylist()]))
        for out in S._write_answers(base)(own.to_batches()):
            names[tasks.at] = out.column(1)[0].as_py()
    return base, names, files


def passing(tasks, parts, window, bits, answers):
    """Of each partition all window hashes, and flags of those that pass."""
    out = []
    for tasks.at, part in enumerate(parts):
        told = S.Answers(*answers, tasks.at)
        for flush, (h, *_) in enumerate(S._flushes(iter([part]), window, True)):
            on = np.zeros(len(h), bool)
            on[told.passing(flush, h, bits)] = True
            out.append((h, on))
    return (np.concatenate(x) for x in zip(*out))


@pytest.mark.parametrize("bits", [3, 10, 16, 21, 30])
def test_no_window_that_occurs_twice_is_lost(rows, monkeypatch, tmp_path, bits):
    """At any load, from a saturated sketch to an empty one of several segments."""
    monkeypatch.setattr(S, "FLUSH", 500)
    tasks, parts = Tasks(monkeypatch), [table(rows[k::3]) for k in range(3)]
    h, on = passing(tasks, parts, 5, bits, ask(tasks, parts, 5, bits, f"file://{tmp_path}/a"))
    _, at, counts = np.unique(h, return_inverse=True, return_counts=True)
    assert on[counts[at] > 1].all()
    if bits >= 21:
        assert not on[counts[at] == 1].any()


def test_the_filter_keeps_its_strength(monkeypatch, tmp_path):
    """The share of single windows that pass does not grow with the input: counters follow it, without an upper limit."""
    assert [S.sketch_bits(1 << k) - k for k in (20, 30, 37, 46)] == [-1] * 4  # up to 64 TiB
    assert S._segment_bits(S.sketch_bits(51 << 30)) == 24
    shares = []
    for n in (20_000, 80_000, 320_000):
        words = np.random.default_rng(n).integers(0, 1 << 20, n).tolist()
        part = table([(0, " ".join(f"{w:05x}" for w in words))])
        monkeypatch.setattr(S, "MIN_BITS", 1)
        bits = S.sketch_bits(6 * n)
        tasks = Tasks(monkeypatch)
        h, on = passing(tasks, [part], 20, bits, ask(tasks, [part], 20, bits, f"file://{tmp_path}/{n}"))
        shares.append(on.mean())
    assert max(shares) < 0.3 and max(shares) - min(shares) < 0.15, shares


def test_small_flushes_group_alike(monkeypatch, rows, tmp_path):
    """What a task sends early is grouped the same way, through the sketch and where answers do not fit."""
    monkeypatch.setattr(S, "FLUSH", 40)
    tasks, parts = Tasks(monkeypatch), [table(rows[k::2]) for k in range(2)]
    answers = ask(tasks, parts, 5, 16, f"file://{tmp_path}/a")
    for told, texts in ((answers, parts), (answers, parts[::-1]), (("file:///none", {}, 2), parts)):  # parts swapped: other windows than asked for
        sent = []
        for tasks.at, part in enumerate(texts):
            sent += S._candidates(5, 16, 8, told)(iter([part]))
        sent = pa.Table.from_batches(sent).sort_by("bucket").to_batches()
        grouped = pa.Table.from_batches(S._group(4)(sent)).sort_by("part").to_batches()
        spans = {}
        for b in S._spans(5)(grouped):
            for i, lo, hi in zip(*(b.column(c).to_pylist() for c in ("id", "begins", "ends"))):
                spans[i] = sum(y - x for x, y in zip(lo, hi))
        assert spans == {i: n for i, (_, n, _) in brute(rows, 5).items() if n}


def test_repeated_ids(spark):
    """Texts under one id keep their own words; a passage of one that starts later in the other is a repeat there."""
    body = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, body), (1, "x y z " + body), (2, body), (2, body)], "doc_id long, text string")
    assert sorted((r.id, r.n_words, r.n_removed) for r in S.substring_dedup(df).collect()) == [(1, 30, 0), (1, 33, 30), (2, 30, 30), (2, 30, 30)]


def test_packing():
    for kind in (np.int64, np.int32, np.uint32):
        x = np.random.default_rng(0).integers(0, 1 << 30, 1000).astype(kind)
        assert (S._unpack(S._pack(x), kind) == x).all()

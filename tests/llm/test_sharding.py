import zlib

import numpy as np
import pytest

from groundcheck.llm import sharding
from groundcheck.llm.sharding import difference, shard_by_bytes


def test_differencing_adds_up():
    rng = np.random.default_rng(0)
    items = np.zeros((3000, 24), np.int64)
    items[:, 0] = rng.lognormal(8, 1, 3000).astype(int)
    total, where = difference(items)
    sums = np.zeros(24, np.int64)
    np.add.at(sums, where[:, 0], items[:, 0])
    assert (sums == total).all() and total.max() - total.min() <= 2


def test_differencing_of_partial_partitions():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 100, (50, 5))
    total, where = difference(items)
    sums = np.zeros(5, np.int64)
    for row, to in zip(items, where):
        assert sorted(to) == list(range(5))
        sums[to] += row
    assert (sums == total).all() and total.max() - total.min() <= 10


def naive_differencing(items):
    """The method as its definition says, every vector kept whole with the items of each of its shards."""
    pool = [sorted(((int(v), [(i, c)] if v or c == 0 else []) for c, v in enumerate(row)), key=lambda x: -x[0]) for i, row in enumerate(items)]
    while len(pool) > 1:
        pool.sort(key=lambda x: -(x[0][0] - x[-1][0]))
        a, b, *pool = pool
        pool.append(sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda x: -x[0]))
    return pool[0]


@pytest.mark.parametrize("shards, n", [(2, 5), (3, 40), (24, 300)])
def test_against_naive_differencing(shards, n):
    """Sizes that all differ leave no choice: shard sums equal those of the plain method."""
    items = np.zeros((n, shards), np.int64)
    items[:, 0] = np.random.default_rng(n).permutation(np.arange(1, n + 1) ** 3 + 10**6)
    total, _ = difference(items)
    assert sorted(total.tolist()) == sorted(s for s, _ in naive_differencing(items))


def test_operator_against_naive_differencing(spark):
    rows = [(k, "x" * (k * k + 3 * k)) for k in range(60)] + [(100 + k, "copy " * 40) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    sizes = {}
    for _, t in rows:
        sizes[t] = sizes.get(t, 0) + len(t) + 8
    items = np.zeros((len(sizes), 5), np.int64)
    items[:, 0] = list(sizes.values())
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one task holds all groups
    try:
        out = shard_by_bytes(df, shards=5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sums = {}
    for r in out:
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
    assert sorted(sums.values()) == sorted(s for s, _ in naive_differencing(items))
    assert len({r.shard for r in out if r.id >= 100}) == 1


def test_known_case():
    total, _ = difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    assert sorted(total) == [14, 16]  # the method's own result


@pytest.mark.parametrize("top", [4096, 1])
def test_shards(docs, rows, monkeypatch, top):
    monkeypatch.setattr(sharding, "TOP", top)  # 1: several levels
    found = {r.id: r for r in shard_by_bytes(docs, shards=4).collect()}
    by_text, slots, sums = {}, {}, {}
    for i, text, _ in rows:
        r, data = found[i], (text or "").encode()
        assert r["size"] == len(data) + 8 and r.text_crc32 == zlib.crc32(data)
        assert by_text.setdefault(text or "", r.shard) == r.shard
        slots.setdefault(r.shard, []).append((r.slot, i))
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
    for line in slots.values():
        assert [s for s, _ in sorted(line)] == list(range(len(line)))
        assert sorted(line) == sorted(line, key=lambda x: x[1])
    rest = sorted(sums.values())[:-1]  # the longest text fills a shard of its own
    assert len(rest) == 3 and max(rest) - min(rest) <= 8


def test_edges(odd, empty, rows):
    assert shard_by_bytes(empty).collect() == []
    out = shard_by_bytes(odd, shards=3).collect()
    assert len(out) == len(rows) + 5
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))

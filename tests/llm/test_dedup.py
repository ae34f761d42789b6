import hashlib
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from groundcheck.llm import _shared, exact_dedup as exact, simhash
from groundcheck.llm._components import connected_components, roots
from groundcheck.llm.exact_dedup import exact_dedup
from groundcheck.llm.simhash import simhash_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(LOW), []).append(-(2**63) if i is None else i)
    out = []
    for t, ids in groups.items():
        for i in ids:
            out.append((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def found_exact(df):
    fix = lambda x: -(2**63) if x is None else x
    return sorted((fix(r.id), fix(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_exact_dedup(docs, rows):
    assert found_exact(exact_dedup(docs)) == brute_exact(rows)


def test_exact_dedup_repeated_rows_and_null_id(odd, rows):
    all_rows = [*rows, *[r for r in rows if r[0] in (3, 62, 85, 92)], (None, rows[1][1], "en")]
    assert found_exact(exact_dedup(odd)) == brute_exact(all_rows)


def test_exact_dedup_empty(empty):
    assert exact_dedup(empty).collect() == []


def test_equal_digest_is_not_enough():
    """Contents are compared, not digests: two texts under one digest stay apart."""
    import pyarrow as pa
    import zstandard

    from groundcheck.llm.exact_dedup import _merge

    pack = zstandard.ZstdCompressor(level=1).compress
    columns = [pa.array([7, 8, 9, 5]), pa.array([b"d"] * 4), pa.array([7, 8, 9, 9]), pa.array([0, 0, 0, 40]), pa.array([pack(b"one"), pack(b"two"), pack(b"one"), None])]
    (out,) = _merge([pa.RecordBatch.from_arrays(columns, names=["id", "digest", "rep", "salt", "content"])])
    assert out.column(3).to_pylist() == [7, 8, 7, None] and [c is None for c in out.column(4).to_pylist()] == [False, False, True, True]


@pytest.mark.parametrize("cache", [1, 200])
def test_forgotten_texts_are_found_again(docs, rows, monkeypatch, cache):
    """A task that can hold hardly any text still puts all copies together."""
    monkeypatch.setattr(exact, "CACHE", cache)
    assert found_exact(exact_dedup(docs)) == brute_exact(rows)


def largest_shares(df):
    """Of every shuffle of a run plan: the largest partition's share of the rows that it wrote."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count") / F.sum("count")).first()[0]


def test_join_of_a_hot_key_is_spread(spark, monkeypatch):
    """Over half of the rows have one key; they stay where they lie, and all others are joined as well."""
    monkeypatch.setattr(_shared, "HEAVY", 4)
    rows = spark.range(0, 4000, 1, 8).select("id", F.when(F.col("id") % 5 < 3, 0).otherwise(F.col("id")).alias("k"))
    table = _shared.materialize(rows.groupBy("k").agg(F.count("*").alias("n")), "sizes").withColumn("v", -F.col("k"))
    out = _shared.join_skewed(rows, table.drop("n"), ["k"], table.select("k", "n"))
    assert out.select("id", "k", "v").orderBy("id").collect() == [(i, 0 if i % 5 < 3 else i, 0 if i % 5 < 3 else -i) for i in range(4000)]
    assert largest_shares(out) < 0.2


def test_links_of_a_hub_are_spread(spark):
    edges = spark.createDataFrame([(0, k) for k in range(1, 3000)] + [(5000, 5001)], "a long, b long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {**{k: 0 for k in range(3000)}, 5000: 5000, 5001: 5000}


def test_dedup_of_a_hot_text(spark):
    """Two thirds of the rows are one text: no task of the result holds much more than its part, and all are found."""
    rows = [(k, "hot text here" if k % 3 else f"text {k}", "en") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    out = exact_dedup(df)
    assert found_exact(out) == brute_exact(rows)
    near = simhash_components(df)
    assert {r.component_id for r in near.where(F.col("id") % 3 > 0).collect()} == {1}


def fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOW).encode())
    shingles = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] if len(words) >= width else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fp = {i: fingerprint(t) for i, t, _ in rows}
    ids = sorted(fp)
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (fp[i], top(i)) for i in ids}


def test_simhash(docs, rows):
    found = {r.id: (r.fp & (2**64 - 1), r.component_id) for r in simhash_components(docs).collect()}
    assert found == brute_components(rows)
    assert found[92] == found[93] == found[94] == (0, 92)


def test_simhash_edges(odd, empty, rows):
    assert simhash_components(empty).collect() == []
    out = simhash_components(odd).collect()
    assert len(out) == len(rows) + 5
    assert [r.component_id for r in out if r.id is None] == [None]


@pytest.mark.parametrize("free, n", [(0xFFFFFF, 3000), (0x3FFFF, 5000), (0xFF00FF00FF00FFFF, 3000), (0xFFFFFFFF, 40)])
def test_long_lists_are_exact(free, n):
    """Tallies of shared bytes and flipped bits find what all pairs do."""
    rng = np.random.default_rng(0)
    x = np.uint64(0x1234567890ABCDEF) ^ (rng.integers(0, 2**64, n, dtype=np.uint64) & np.uint64(free))
    x = np.unique(np.concatenate([x, *(x[: n // 2] ^ np.uint64(free & (0x80 << k)) for k in (0, 9, 17))]))
    label = simhash._list_roots(x, (2**64 - 1) ^ free)
    a, b = [], []
    for lo in range(0, len(x), 500):
        i, j = np.nonzero(np.bitwise_count(x[lo : lo + 500, None] ^ x[None]) <= 3)
        a.append(i + lo)
        b.append(j)
    assert np.array_equal(label, roots(len(x), np.concatenate(a), np.concatenate(b)))


def test_short_lists_are_tallied():
    """Of many short lists the pairs with five shared bytes come back, and no others, whatever their masks fix."""
    rng = np.random.default_rng(2)
    masks = np.array([0xFFFFFF, 0xFFFFFF, 0xFF00FF00FF, 0xFFFFFFFFFF, 0x3FFFFFFFFFFF], np.uint64)
    run = np.repeat(np.arange(40), rng.integers(2, 20, 40))
    mask = masks[run % len(masks)]
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)[run]
    few = rng.integers(0, 2**64, (8, len(run)), dtype=np.uint64)
    bits = base ^ (few[0] & few[1] & few[2] & few[3] & few[4] & few[5] & ~mask)
    shared = ((bits[:, None] ^ bits[None]).view(np.uint8).reshape(len(run), len(run), 8) == 0).sum(axis=2)
    together = np.triu(run[:, None] == run[None], 1)
    want = set(zip(*(x.tolist() for x in np.nonzero(together & (shared >= simhash.NEEDED)))))
    i, j = simhash.tallied(run, bits, mask)
    assert set(zip(i.tolist(), j.tolist())) == want and 0 < len(i) == len(want) < together.sum()
    none = np.zeros(0, np.int64)
    assert [len(x) for x in simhash.tallied(none, none.view(np.uint64), none.view(np.uint64))] == [0, 0]


def test_hot_lists_are_dealt_again(spark, monkeypatch):
    """With a low limit lists go through every level and links stay the same."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k % 5, replace=False))) for k in range(12)]))
    reps = spark.createDataFrame([(int(f.astype(np.int64)), k) for k, f in enumerate(fps)], "fp long, rep long")
    monkeypatch.setattr(simhash, "HOT", 3)
    parts = {r.node: r.root for r in connected_components(simhash.fingerprint_links(reps)).collect()}
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
    want = roots(len(fps), i, j)
    assert [parts.get(k, k) for k in range(len(fps))] == want.tolist()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}

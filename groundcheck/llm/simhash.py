"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight positional bytes.  Two fingerprints that
differ in at most three bits differ in at most three bytes, so they share at
least ``NEEDED`` = 5 positional bytes, the guaranteed minimum; of those, three
lie in one half of the fingerprint.  Every distinct fingerprint is therefore
dealt out under the eight byte triples of its halves, so that no linked pair is
missed and no list of all holders of one byte is ever brought together.  Within
a list, an inverted index of each remaining byte position tallies for every pair
the positional bytes that it shares; pairs with ``NEEDED`` or more are kept and
verified bit by bit.

A list longer than ``HOT`` is not compared as it is: it is dealt out again under
four more byte positions (one of which any linked pair shares), until five bytes
are shared and the tally is met by all its pairs.  What is then still too long is
dealt once more under six-bit pieces of the free bits (again one is shared), and
links in a list of at most 2^18 members are found by flipping up to three free
bits.  Tasks emit a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from groundcheck.llm._bytes import CHUNK, LOWER, chunks
from groundcheck.llm._components import connected_components, roots
from groundcheck.llm._shared import join_skewed, light_count, materialize, only, small_batches

BITS = 3  # fingerprints link at this many differing bits or fewer
NEEDED = 8 - BITS  # positional bytes that a linked pair shares at least
HOT = 16384  # a longer list is dealt out again
SHORT = 64  # lists up to here are tallied together, a longer one by itself, in blocks
PIECE = 6  # bits of a piece of the last dealing
LAST_BITS = 8 * BITS - PIECE  # free bits of a list that is dealt no more

_ONES = np.uint64(0x0101010101010101)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _byte_mask(positions) -> int:
    return sum(0xFF << (8 * p) for p in positions)


#: Three positions of one half.
TRIPLES = [_signed(_byte_mask(c)) for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of every ``width``-word shingle, repeats included; of all words where they are fewer."""
    words = text.split()
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    shingles = map((b" ".join([b"%b"] * width)).__mod__, zip(*(words[k:] for k in range(width))))
    return list(map(xxhash.xxh64_intdigest, shingles, repeat(seed)))


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each consecutive group of ``counts`` hashes, the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    ends = np.cumsum(counts)[full]
    starts = ends - counts[full]
    # byte lanes hold sums of up to 255 rows
    pieces = -(-counts[full] // 255)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _ONES, cuts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        on = (2 * sums > counts[full][:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(on).view(np.uint64).ravel() << np.uint64(bit)
    return out


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(len(batch), np.uint64)
            for lo, hi, raw, at in chunks(batch.column(1), CHUNK):
                low = LOWER[raw].tobytes()
                each = [shingle_hashes(low[a:b], width) for a, b in zip(at[:-1], at[1:])]
                found[lo:hi] = majority_bits(np.array([h for x in each for h in x], np.uint64), np.array([len(x) for x in each], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["id", "fp", "text_hash"])

    return run


def tallied(run: np.ndarray, bits: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one list (``run``) that share ``NEEDED`` positional bytes, of many short lists at once.

    The bytes that a list's mask fixes are shared by all its pairs.  For the others an
    inverted index of list, position and byte tallies the pairs in each of its postings.
    Where the mask alone fixes ``NEEDED`` bytes, every pair of the list meets the tally.
    """
    n = len(run)
    byte = lambda x, p: (x >> np.uint64(8 * p) & np.uint64(0xFF)).astype(np.int64)
    fixed = sum((byte(mask, p) == 0xFF).astype(np.int64) for p in range(8))
    met = np.flatnonzero(fixed >= NEEDED)
    postings = [(met, run[met])]
    for p in range(8):
        rows = np.flatnonzero((fixed < NEEDED) & (byte(mask, p) != 0xFF))
        postings.append((rows, run[rows] * 256 + byte(bits[rows], p)))
    pairs = [np.zeros(0, np.int64)]
    for rows, key in postings:
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        for s in range(1, len(rows)):
            i = np.flatnonzero(key[s:] == key[:-s])
            if not len(i):
                break
            pairs.append(rows[i] * n + rows[i + s])
    pair, count = np.unique(np.concatenate(pairs), return_counts=True)
    return np.divmod(pair[count + fixed[pair // n] >= NEEDED], n) if n else (pair, pair)


def _free_bits(mask: int) -> list[int]:
    return [k for k in range(64) if not mask >> k & 1]


def _by_flipping(fp: np.ndarray, free: list[int]) -> np.ndarray:
    """Roots within distinct fingerprints that agree but on the ``free`` bits."""
    n = len(fp)
    label, order = np.arange(n), np.argsort(fp)
    ranked = fp[order]
    for r in range(1, BITS + 1):
        for bits in combinations(free, r):
            want = ranked ^ np.uint64(sum(1 << k for k in bits))
            at = np.searchsorted(ranked, want)
            at[at == n] = 0
            hit = np.flatnonzero(ranked[at] == want)
            if len(hit):
                a, b = label[order[hit]], label[order[at[hit]]]
                label = roots(n, a, b)[label]
    return label


def _by_tally(fp: np.ndarray, mask: int) -> np.ndarray:
    """Roots within distinct fingerprints that agree on ``mask``: counts shared bytes through an index of each free position."""
    n = len(fp)
    label, free = np.arange(n), [p for p in range(8) if not mask >> (8 * p) & 0xFF]
    need = NEEDED - (8 - len(free))
    index = []
    for p in free:
        byte = (fp >> np.uint64(8 * p)).astype(np.uint8)
        order = np.argsort(byte, kind="stable")
        index.append((byte, order, np.searchsorted(byte[order], np.arange(257))))
    step = max(1, (1 << 20) // n)
    for lo in range(0, n, step):
        rows = np.arange(lo, min(lo + step, n))
        tally = np.zeros(len(rows) * n, np.uint8)
        for byte, order, first in index:  # each pair at most once a position
            own = byte[rows].astype(np.int64)
            count = first[own + 1] - first[own]
            at = np.arange(count.sum()) + np.repeat(first[own] - (np.cumsum(count) - count), count)
            tally[np.repeat((rows - lo) * n, count) + order[at]] += 1
        i, j = np.divmod(np.flatnonzero(tally >= need), n)
        i += lo
        near = np.flatnonzero(np.bitwise_count(fp[i] ^ fp[j]) <= BITS)
        label = roots(n, label[i[near]], label[j[near]])[label]
    return label


def _list_roots(fp: np.ndarray, mask: int) -> np.ndarray:
    """Roots within one list of distinct fingerprints that agree on ``mask``."""
    free = _free_bits(mask)
    return _by_flipping(fp, free) if len(free) <= LAST_BITS else _by_tally(fp, mask)


def _list_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list; yields a spanning forest of the links of each list."""
    names = ["mask", "value", "fp", "rep"]

    def solve(part: list[np.ndarray]) -> pa.RecordBatch:
        mask, value, fp, rep = part
        n = len(fp)
        same = np.flatnonzero((mask[1:] == mask[:-1]) & (value[1:] == value[:-1]))
        starts = np.setdiff1d(np.arange(n), same + 1, assume_unique=True)
        size = np.diff(np.append(starts, n))
        run = np.repeat(np.arange(len(starts)), size)
        bits = fp.view(np.uint64)
        short = np.flatnonzero((size[run] > 1) & (size[run] <= SHORT))
        i, j = tallied(run[short], bits[short], mask[short].view(np.uint64))
        near = np.bitwise_count(bits[short[i]] ^ bits[short[j]]) <= BITS
        a, b = [short[i[near]]], [short[j[near]]]
        for k in np.flatnonzero(size > SHORT):
            lo, hi = starts[k], starts[k] + size[k]
            label = _list_roots(bits[lo:hi], int(mask[lo]) & (2**64 - 1))
            own = np.flatnonzero(label != np.arange(hi - lo))
            a.append(own + lo)
            b.append(label[own] + lo)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        label = roots(n, a, b)
        own = np.flatnonzero(label != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[label[own]])], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        part = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names]
        if not len(part[0]):
            continue
        new = np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))
        cut = int(new[-1]) + 1 if len(new) else 0  # the last list may go on in the next batch
        if cut or held and (held[-1][0][-1] != part[0][0] or held[-1][1][-1] != part[1][0]):
            done = [*held, [x[:cut] for x in part]]
            yield solve([np.concatenate([x[k] for x in done]) for k in range(4)])
            held = []
        held.append([x[cut:] for x in part])
    if held:
        yield solve([np.concatenate([x[k] for x in held]) for k in range(4)])


def _wider(mask: int) -> list[int]:
    """Wider masks, one of which any linked pair of a list under ``mask`` agrees on."""
    mask &= 2**64 - 1
    free = _free_bits(mask)
    if len(free) > 8 * BITS:
        more = [0xFF << (8 * p) for p in range(8) if not mask >> (8 * p) & 0xFF][: BITS + 1]
    else:
        more = [sum(1 << k for k in free[a : a + PIECE]) for a in range(0, len(free), PIECE)]
    return [_signed(mask | m) for m in more]


def fingerprint_links(reps: DataFrame) -> DataFrame:
    """Links ``a, b`` (of ``rep`` ids) among distinct fingerprints ``fp, rep`` whose closure is that of all links."""
    n = light_count(reps.sparkSession)
    keyed = lambda df, masks: df.select("fp", "rep", F.explode(masks).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    posts = keyed(reps, F.array(*(F.lit(m) for m in TRIPLES)))
    masks, found = set(TRIPLES), None
    while True:
        lists = materialize(posts.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "lists", light=True)
        posts = join_skewed(posts, lists, ["mask", "value"], lists)
        last = len(_free_bits(min(masks) & (2**64 - 1))) <= LAST_BITS
        short = posts if last else posts.where(F.col("n") <= HOT)
        part = short.select("mask", "value", "fp", "rep").repartition(n, "mask", "value").sortWithinPartitions("mask", "value").mapInArrow(_list_links, "a long, b long")
        found = part if found is None else found.union(part)
        if last or lists.where(F.col("n") > HOT).isEmpty():
            return found
        wider = {m: _wider(m) for m in masks}
        masks = {w for ws in wider.values() for w in ws}
        table = F.create_map(*(F.lit(x) if isinstance(x, int) else F.array(*(F.lit(w) for w in x)) for kv in wider.items() for x in kv))
        posts = materialize(keyed(posts.where(F.col("n") > HOT), table[F.col("mask")]).distinct(), "posts", light=True)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id, fp, component_id, text_hash`` of every row: fingerprint (a signed long), the smallest id reachable over links, XXH64 of the text.

    A text without words, or a null one, has fingerprint zero and links like any
    other.  A text of any length is read whole, a piece of ``CHUNK`` bytes or one
    longer text at a time.  Rows repeated whole, or with equal texts, share a
    fingerprint and a component; rows that share an id have a fingerprint and
    component each.  A null id ranks below all others and comes back as null.
    An empty table gives an empty result; other columns, whatever their names,
    are not read.
    """
    small_batches(docs.sparkSession)
    lowest = -(2**63)
    rows = only(docs, id_col, text_col).select(F.coalesce(F.col(id_col), F.lit(lowest)).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    prints = materialize(rows.mapInArrow(_fingerprints(width), "id long, fp long, text_hash long"), "fingerprints")
    reps = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "fp-reps", light=True)
    parts = connected_components(fingerprint_links(reps))
    near = reps.join(parts, reps.rep == parts.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    near = materialize(near, "fp-components", light=True)
    back = lambda c: F.when(F.col(c) != lowest, F.col(c))
    return join_skewed(prints, near, ["fp"], reps).select(back("id").alias("id"), "fp", back("component_id").alias("component_id"), "text_hash").coalesce(2 * light_count(docs.sparkSession))

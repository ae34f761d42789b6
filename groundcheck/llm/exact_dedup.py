"""Exact deduplication by skew-safe combining.

Three stages, each comparing whole contents and never trusting a digest alone:

1. *local*: every row is named by a representative of its content in its task, the
   first row there that holds it; only a representative carries the content
   onward.  A task remembers up to ``CACHE`` bytes of contents, forgetting the
   least recently met; a forgotten text that comes again is represented again.
2. *salted*: representatives meet others of their digest and salt, so that one
   group of copies is spread over ``SALTS`` tasks.  The stage keeps one content per
   distinct text and streams the rest.
3. *global*: at most ``SALTS`` salt winners of a digest and content meet and name
   the class.

A class's size and largest id are sums over representatives.  Rows that carry no
content never travel with their class: they are dealt out by representative, which
no more rows share than one task has read, and learn from it the row that stays.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from groundcheck.llm._bytes import text_buffers
from groundcheck.llm._shared import join_skewed, materialize, only, shuffle_count, small_batches

#: Tasks that one group of copies is spread over.
SALTS = 32

#: Bytes of distinct contents that a local task remembers.
CACHE = 32 << 20

_LOCAL = "id long, digest binary, rep long, content binary"
_MERGED = "id long, digest binary, rep long, win long, content binary"


def lower_ascii(text: bytes) -> bytes:
    """A-Z to a-z, everything else unchanged."""
    return text.lower()


def _local(normalise: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        known: OrderedDict[bytes, list[tuple[bytes, int]]] = OrderedDict()  # digest to contents and their representatives
        held = 0
        for batch in batches:
            raw, at = text_buffers(batch.column(1))
            digests, reps, contents = [], [], []
            for k, i in enumerate(batch.column(0).to_pylist()):
                text = normalise(raw[at[k] : at[k + 1]].tobytes())
                digest = hashlib.sha256(text).digest()
                same = known.setdefault(digest, [])
                known.move_to_end(digest)
                rep = next((r for t, r in same if t == text), None)
                content = None
                if rep is None:
                    rep, content = i, packer.compress(text)
                    same.append((text, i))
                    held += len(text)
                    while held > CACHE and len(known) > 1:
                        held -= sum(len(t) for t, _ in known.popitem(last=False)[1])
                digests.append(digest)
                reps.append(rep)
                contents.append(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(reps, pa.int64()), pa.array(contents, pa.binary())], names=["id", "digest", "rep", "content"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, digest, rep, salt, content) sorted by digest, salt and rep: names the first of equal contents, which alone is passed on.

    A row without content is passed on as it is, without a winner.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    key: tuple | None = None
    variants: list[tuple[bytes, int]] = []  # packed content, winner
    for batch in batches:
        wins, kept = [], []
        for digest, rep, salt, content in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            if content is None:
                wins.append(None)
                kept.append(None)
                continue
            if (digest, salt) != key:
                key, variants = (digest, salt), []
            # equal bytes are equal contents; else compare the contents themselves
            win = next((w for c, w in variants if c == content or unpack(c) == unpack(content)), None)
            new = win is None
            if new:
                win = rep
                variants.append((content, rep))
            wins.append(win)
            kept.append(content if new else None)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(wins, pa.int64()), pa.array(kept, pa.binary())], names=["id", "digest", "rep", "win", "content"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[bytes], bytes] = lower_ascii) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when ``normalise`` makes equal bytes of them; whole texts of
    any length are compared.  Of equal texts the row with the largest id stays.  A
    null text counts as empty; a null id is ranked below all others and comes
    back as null.  Rows repeated whole (same id and text) are members of their
    group and count in ``group_size``; each is marked kept if its id is the one
    that stays.  An empty table gives an empty result.  Other columns, whatever
    their names, are never read.
    """
    small_batches(docs.sparkSession)
    n = shuffle_count(docs.sparkSession)
    lowest = -(2**63)
    local = only(docs, id_col, text_col).select(F.coalesce(F.col(id_col), F.lit(lowest)).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_local(normalise), _LOCAL)
    # one pass deals out both: contents by digest and salt, other rows by their representative
    spread = F.pmod(F.xxhash64("rep"), F.when(F.col("content").isNotNull(), SALTS).otherwise(1 << 30)) + F.when(F.col("content").isNull(), SALTS).otherwise(0)
    dealt = local.select("id", "digest", "rep", spread.alias("salt"), "content").repartition(n, "digest", "salt").sortWithinPartitions("digest", "salt", "rep")
    merged = materialize(dealt.mapInArrow(_merge, _MERGED), "dedup")
    # a representative is named by its id and digest: repeated ids may stand for different texts
    members = merged.groupBy("rep", "digest").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    winners = merged.where(F.col("content").isNotNull()).select("id", "digest", "rep", F.lit(0).alias("salt"), "content")
    named = winners.repartition(n, "digest").sortWithinPartitions("digest", "rep").mapInArrow(_merge, _MERGED).select(F.col("rep").alias("win"), "digest", F.col("win").alias("class"))
    reps = merged.where(F.col("win").isNotNull()).select("rep", "digest", "win").dropDuplicates(["rep", "digest"])
    classes = materialize(reps.join(named, ["win", "digest"]).join(members, ["rep", "digest"]).select("rep", "digest", "class", "n", "most"), "dedup-classes", light=True)
    totals = materialize(classes.groupBy("class", "digest").agg(F.sum("n").alias("group_size"), F.max("most").alias("keep_id"), F.count("*").alias("n")), "dedup-totals", light=True)
    final = join_skewed(classes.select("rep", "digest", "class"), totals.drop("n"), ["class", "digest"], totals).drop("class")
    back = lambda c: F.when(F.col(c) != lowest, F.col(c))
    return merged.select("id", "rep", "digest").join(final, ["rep", "digest"]).select(
        back("id").alias("id"), back("keep_id").alias("keep_id"), "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )

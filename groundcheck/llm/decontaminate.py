"""Benchmark decontamination: one FM-index per shard of training text.

A shard is a run of rows within one Arrow batch.  Words that occur in no test
phrase cannot be part of an occurrence; they, and the ends of texts, become one
separator symbol, and stretches shorter than the shortest phrase are left out.
Over what remains an FM-index is built; all test phrases are searched backwards
at once, occurrences are located from sampled suffix positions, and the words
they cover are merged into removal spans.

The phrases are made once, on the driver, and broadcast as arrays, in blocks of at
most ``BLOCK_BYTES`` of benchmark text, whatever the benchmark's size.  One block is
one pass over the rows without a shuffle; each further block is one more pass that
adds to the spans and items found before, which are written to the shared folder
in between, so that one block is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from groundcheck.llm._bytes import ALNUM, LOWER, chunks, span_hash, text_buffers, word_spans
from groundcheck.llm._shared import materialize, only, row_and_text, small_batches
from groundcheck.llm.fm_index import FMIndex

WINDOW = 10  # words of a test phrase; a shorter item is one phrase
BLOCK_BYTES = 8 << 20

_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


@dataclass
class Phrases:
    """All distinct test phrases of some items, as rows of vocabulary numbers, and the items of each."""

    vocabulary: np.ndarray  # hashes of words
    check: np.ndarray  # other hashes of the same words
    rows: np.ndarray
    size: np.ndarray
    names: list[str]  # of items, in order
    first: np.ndarray  # where each phrase's items begin in ``of``
    of: np.ndarray

    @classmethod
    def made_of(cls, items: Sequence[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
        raw, at = text_buffers(pa.array([t for _, t in items], pa.string()))
        raw = LOWER[raw]
        starts, ends, first = word_spans(raw, at, ALNUM)
        h = span_hash(raw, starts, ends)
        vocabulary, place, number = np.unique(h, return_index=True, return_inverse=True)
        words = np.diff(first)
        count = np.where(words, np.maximum(words - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), count)
        begin = first[item] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(words[item], window)
        at = begin[:, None] + np.arange(window)
        rows = np.where(np.arange(window) < size[:, None], number[np.minimum(at, max(len(number) - 1, 0))] if len(number) else 0, 0)
        whole, phrase = np.unique(np.concatenate([rows, size[:, None]], axis=1), axis=0, return_inverse=True)
        names, rank = np.unique(np.array([i or "" for i, _ in items], object), return_inverse=True)
        pairs = np.unique(phrase * max(len(names), 1) + rank[item]) if len(item) else np.zeros(0, np.int64)
        owner, of = np.divmod(pairs, max(len(names), 1))
        return cls(vocabulary, span_hash(raw, starts[place], ends[place], seed=2), whole[:, :-1], whole[:, -1], names.tolist(), np.searchsorted(owner, np.arange(len(whole) + 1)), of)

    def items(self, doc: np.ndarray, phrase: np.ndarray) -> dict[int, list[str]]:
        """Of every document the names of the items of its phrases, in order."""
        doc, phrase = np.divmod(np.unique(doc * max(len(self.size), 1) + phrase), max(len(self.size), 1))
        count = self.first[phrase + 1] - self.first[phrase]
        at = np.arange(count.sum()) + np.repeat(self.first[phrase] - (np.cumsum(count) - count), count)
        found: dict[int, list[str]] = {}
        for d, i in zip(*np.divmod(np.unique(np.repeat(doc, count) * max(len(self.names), 1) + self.of[at]), max(len(self.names), 1))):
            found.setdefault(int(d), []).append(self.names[i])
        return found

    def numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary, from 1; 0 if it isn't there."""
        out = np.zeros(len(starts), np.int64)
        if not len(self.vocabulary):
            return out
        h = span_hash(raw, starts, ends)
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        known = np.flatnonzero(self.vocabulary[at] == h)
        known = known[self.check[at[known]] == span_hash(raw, starts[known], ends[known], seed=2)]
        out[known] = at[known] + 1
        return out

    def occurrences(self, number: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and phrase of every occurrence; ``texts``: where each text's words begin."""
        none = np.zeros(0, np.int64)
        if not len(self.size):
            return none, none
        known = number > 0
        head = known.copy()
        head[1:] &= ~known[:-1]
        cuts = texts[(texts > 0) & (texts < len(number))]
        head[cuts] = known[cuts]
        heads = np.flatnonzero(head)
        stretch = np.cumsum(head) - 1
        length = np.bincount(stretch[known], minlength=len(heads)) if len(heads) else none
        use = np.flatnonzero(known)
        use = use[length[stretch[use]] >= self.size.min()]
        if not len(use):
            return none, none
        # a separator (0) after each stretch
        gap = np.concatenate([np.flatnonzero(head[use[1:]] | (use[1:] != use[:-1] + 1)) + 1, [len(use)]])
        text = np.insert(number[use], gap, 0)
        origin = np.insert(use, gap, -1)
        index = FMIndex(text, len(self.vocabulary) + 1)
        lo, hi = index.search(self.rows + 1, self.size)
        hits = np.flatnonzero(hi > lo)
        count = (hi - lo)[hits]
        ranks = np.repeat(lo[hits] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return origin[index.locate(ranks)], np.repeat(hits, count)


def _search(block, name: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = block.value
        for batch in batches:
            text = batch.column(0)
            old_items, old_spans = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out: list[list] = [[], [], [], []]
            for lo, hi, raw, at in chunks(text):
                raw = LOWER[raw]
                starts, ends, first = word_spans(raw, at, ALNUM)
                n = len(starts)
                where, which = phrases.occurrences(phrases.numbers(raw, starts, ends), first)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, where, 1)
                np.add.at(edge, where + phrases.size[which], -1)
                for r in range(lo, hi):  # what earlier blocks found
                    for s in old_spans[r] or ():
                        a, b = np.searchsorted(starts, at[r - lo] + s["begin"]), np.searchsorted(starts, at[r - lo] + s["end"])
                        edge[a] += 1
                        edge[b] -= 1
                hit = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                doc = np.searchsorted(first, where, "right") - 1
                found = phrases.items(doc, which)
                out[0] += np.diff(first).tolist()
                out[1] += (total[first[1:]] - total[first[:-1]]).tolist()
                for k in range(hi - lo):
                    out[2].append(sorted({*found.get(k, ()), *old_items[lo + k]}) if old_items[lo + k] else found.get(k, []))
                    a, b = first[k], first[k + 1]
                    if total[a] == total[b]:
                        out[3].append([])
                        continue
                    own = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                    out[3].append([{"begin": int(starts[a + x] - at[k]), "end": int(ends[a + y - 1] - at[k])} for x, y in own.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [text, batch.column(1), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], _SPANS), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=name
            )

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row, text, items, spans, n_words, n_hit`` of every row of ``docs``.

    ``row`` holds the whole input row, whatever its columns are called; texts of
    any length are searched whole.  Words
    are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in
    lower case.  ``spans`` are merged byte ranges of the text that occurrences
    of test phrases cover; ``items`` are the ids (as strings, sorted) of the
    items that have one.  A null text has no words; a null item text no
    phrases; a null item id counts as the empty string.  Repeated items or rows
    change nothing; without items or rows nothing is hit.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    items = only(benchmark, item_col, item_text_col).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    spans = "array<struct<begin:int,end:int>>"
    now = row_and_text(docs, text_col).select("text", "row", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast(spans).alias("spans"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"))
    kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in now.schema])
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        block = spark.sparkContext.broadcast(Phrases.made_of(sorted(((r.item, r.text) for r in part.collect()), key=str), window))
        now = now.mapInArrow(_search(block, kinds.names), kinds)
        if k < blocks - 1:
            now = materialize(now, "spans")
            block.destroy()
    return now

"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are the trigrams of its characters' classes, bands of three
ratios (different words, words equal to the one before, different lines) and its
words, hashed to ``WORDS`` columns, A-Z in lower case.  As some scripts have no
spaces, characters of three bytes or more also count as words each.  Term
weights (log frequency times inverse document frequency) of a labelled sample
are projected by a truncated singular value decomposition.  The sample's
vectors, at most ``SAMPLE`` x ``RANK`` numbers, are broadcast; for every
document exact cosine products with all of them are taken in blocks, and the
``NEIGHBOURS`` most similar vote with their similarity as weight; of equally
similar ones those of smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from groundcheck.llm._bytes import ALNUM, LOWER, NOT_SPACE, byte_class, chunks, span_hash, word_spans
from groundcheck.llm._shared import only, row_and_text, small_batches

SAMPLE = 4096  # labelled rows, at most, chosen by a hash of the id
RANK = 32
NEIGHBOURS = 25
BLOCK = 256  # documents whose products are taken at once

#: Classes of bytes; all others are class 0.
CLASSES = (" ", "\t\n\v\f\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,", ";:!?'\"-", "|", "#*$%&", "/@_=+~^\\`", "()[]{}<>")
_CLASS = np.zeros(256, np.int64)
for _k, _members in enumerate(CLASSES):
    _CLASS[list(_members.encode())] = _k + 1
_N = len(CLASSES) + 1
_TRIGRAMS = _N**3
_BANDS = 16
WORDS = 2048  # columns that words are hashed to
_FIRST_WORD = _TRIGRAMS + 3 * _BANDS
TERMS = _FIRST_WORD + WORDS
_BAND_WEIGHT = 0.5
_WORD_WEIGHT = 0.5  # length of the words' part; that of the trigrams is 1
_NOT_NEWLINE = byte_class(inverse_of="\n")


def _different(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: spans, different spans, spans equal to the one before."""
    starts, ends, first = word_spans(raw, at, table)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    h = span_hash(raw, starts, ends)
    order = np.lexsort((h, text))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1]))[: len(h)]
    again = np.append(False, (h[1:] == h[:-1]) & (text[1:] == text[:-1]))[: len(h)]
    tally = lambda flags, of: np.bincount(of, weights=flags, minlength=len(count))
    return count, tally(new, text[order]), tally(again, text)


def _word_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each text has words of each hash, a row a text."""
    n, raw = len(at) - 1, LOWER[raw]
    starts, ends, first = word_spans(raw, at, ALNUM)
    lead = np.flatnonzero(raw >= 0xE0)  # characters of three or four bytes
    text = np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.searchsorted(at, lead, "right") - 1])
    h = span_hash(raw, np.concatenate([starts, lead]), np.concatenate([ends, lead + 3 + (raw[lead] >= 0xF0)]))
    return np.bincount(text * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)


def term_frequencies(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log frequencies of the trigrams and words, and bands, a row a text."""
    n = len(at) - 1
    c = _CLASS[raw]
    out = np.zeros((n, TERMS), np.float32)
    if len(c) >= 3:
        code = (c[:-2] * _N + c[1:-1]) * _N + c[2:]
        text = np.repeat(np.arange(n), np.diff(at))
        whole = np.flatnonzero(text[:-2] == text[2:])
        counts = np.bincount(text[whole] * _TRIGRAMS + code[whole], minlength=n * _TRIGRAMS).reshape(n, _TRIGRAMS)
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        out[:, :_TRIGRAMS] = np.log1p(counts * (1000.0 / total))
    words, different, again = _different(raw, at, NOT_SPACE)
    lines, other, _ = _different(raw, at, _NOT_NEWLINE)
    for k, (part, of) in enumerate(((different, words), (again, words), (other, lines))):
        band = np.minimum((part / np.maximum(of, 1) * _BANDS).astype(np.int64), _BANDS - 1)
        some = np.flatnonzero(of)
        out[some, _TRIGRAMS + k * _BANDS + band[some]] = 1
    if n:
        out[:, _FIRST_WORD:] = np.log1p(_word_counts(raw, at))
    return out


@dataclass
class Neighbours:
    """Inverse document frequencies, projection, the sample's unit vectors and labels, and their mean."""

    weight: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def vectors_of(self, terms: np.ndarray) -> np.ndarray:
        v = _weighted(terms, self.weight) @ self.projection
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """The share of label 1 in the neighbours' similarity; the prior where nothing is similar."""
        out = np.full(len(terms), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(terms), BLOCK):
            v = self.vectors_of(terms[a : a + BLOCK])
            cosine = np.round(v @ self.vectors.T, 5)  # products of equal vectors are equal, in whatever order they are summed
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
            for r in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):  # ties at the edge go by the sample's order
                near[r] = np.argsort(-cosine[r], kind="stable")[:k]
            w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64)
            total = w.sum(axis=1)
            vote = (w * self.labels[near]).sum(axis=1)
            some = total > 0
            out[a : a + BLOCK][some] = vote[some] / total[some]
        return out


def _weighted(terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = terms * weight
    for part, length in ((x[:, :_TRIGRAMS], 1), (x[:, _FIRST_WORD:], _WORD_WEIGHT)):
        part *= length / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return x


def fit(terms: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 0) -> Neighbours:
    """Weights and a truncated singular value decomposition by subspace iteration."""
    n = len(labels)
    weight = np.log((1 + n) / (1 + (terms > 0).sum(axis=0))).astype(np.float32) + 1
    weight[_TRIGRAMS:_FIRST_WORD] = _BAND_WEIGHT
    if not n:
        return Neighbours(weight, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = _weighted(terms, weight)
    q = np.random.default_rng(seed).normal(size=(TERMS, min(rank + 8, n))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
    made = Neighbours(weight, (q @ turn.T[:, :rank]).astype(np.float32), np.zeros((0, rank), np.float32), labels.astype(np.float64), float(labels.mean()))
    made.vectors = made.vectors_of(terms)
    return made


_TERMS = (T.StructField("cols", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType())))


def _sparse_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, at in chunks(batch.column(1), 1 << 18):
            terms = term_frequencies(raw, at)
            rows, cols = np.nonzero(terms)
            edges = pa.array(np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (cols.astype(np.int32), terms[rows, cols])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], names=["of", "cols", "values"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Neighbours:
    """Fit on at most ``sample`` labelled rows; labels that are null or of no document are passed over.

    The sample is in the order of its ids, then labels, which decides ties between
    equally similar neighbours.  An id with two labels counts with each; of rows
    that share an id the least text counts.
    """
    rows = only(labels, id_col, label_col).where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).distinct()
    chosen = rows.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    texts = only(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    texts = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    got = texts.select(F.struct("id", "label").alias("of"), "text").mapInArrow(_sparse_terms, T.StructType([T.StructField("of", texts.select(F.struct("id", "label")).schema[0].dataType), *_TERMS])).collect()
    got.sort(key=lambda r: tuple(r.of))  # the same whatever order tasks end in
    terms = np.zeros((len(got), TERMS), np.float32)
    for k, r in enumerate(got):
        terms[k, r.cols] = r.values
    return fit(terms, np.array([r.of.label for r in got], np.float64))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = model.value
        for batch in batches:
            scores = np.zeros(len(batch))
            for lo, hi, raw, at in chunks(batch.column(1), 1 << 18):
                for a in range(lo, hi, BLOCK):  # short texts: a block at a time
                    b = min(hi, a + BLOCK)
                    own = at[a - lo : b - lo + 1]
                    scores[a:b] = near.scores(term_frequencies(raw[own[0] : own[-1]], own - own[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["row", "score"])

    return run


def quality_scores(docs: DataFrame, model: Neighbours, text_col: str = "text") -> DataFrame:
    """``row`` (the whole input row) and ``score`` (0 to 1, higher: label 1 likelier) of every row.

    An empty or null text, or one like nothing in the sample, gets the sample's
    share of label 1; texts of any length are read whole.  Only the text counts, so
    repeated rows are alike; other columns ride along in ``row`` whatever their
    names.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = row_and_text(docs, text_col)
    kinds = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), kinds)

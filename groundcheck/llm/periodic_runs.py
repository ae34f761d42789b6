"""Maximal periodic runs of words by probes on harmonic grids.

A run of period p and at least 3p words has 2p places or more, one after another,
whose word equals the one p later.  Any 2p such places hold two neighbouring
points of the grid 0, p, 2p, ..., so it is enough to test, for every p, words jp
and (j+1)p: n/p tests a period and n ln n in all.  Points that pass, and whose
next point passes, are extended by comparing arrays a chunk at a time.  Points
within a run already found, whose period divides p, are skipped: there the run
of period p is that run.

Everything happens within one text, so rows stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from groundcheck.llm._bytes import chunks
from groundcheck.llm._shared import row_with, small_batches

#: Words and periods that a run has at least.
SHORTEST, REPEATS = 24, 3
#: Grid points that are tested at once.
PROBES = 1 << 16
#: Words that are compared at once when a run is extended, first and at most.
NEAR, FAR = 32, 1 << 14

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words by equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _grids(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (period, point) with two more points of the grid before n, in order of the period, some ``PROBES`` at a time."""
    first, last = 1, n // REPEATS
    while first <= last:
        p = np.arange(first, min(last, first + PROBES) + 1)
        count = (n - 1) // p - 1
        take = max(1, int(np.searchsorted(np.cumsum(count), PROBES)))
        p, count = p[:take], count[:take]
        period = np.repeat(p, count)
        yield period, period * (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count))
        first += take


def _passing(w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Periods, and the grid points jp whose word equals those at (j+1)p and (j+2)p.

    Further places between such points must agree as well, or the points lie in no
    run; some are looked at, all points at once, before any is extended.
    """
    for p, i in _grids(len(w)):
        held = np.flatnonzero(w[i] == w[i + p])
        held = held[w[i[held] + p[held]] == w[i[held] + 2 * p[held]]]
        for share in (1, 2, 3):
            if len(held):
                near = i[held] + share * p[held] // 4
                held = held[w[near] == w[near + p[held]]]
        if len(held):
            cut = np.flatnonzero(np.diff(p[held])) + 1
            for part in np.split(held, cut):
                yield int(p[part[0]]), i[part]


def _extend(w: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The first and the past-the-last place around ``i`` from which on each word equals the one ``p`` later."""
    n, end, size = len(w) - p, i, NEAR
    while end < n:
        stop = min(end + size, n)
        differ = w[end:stop] != w[end + p : stop + p]
        k = int(differ.argmax())
        if differ[k]:
            end += k
            break
        end, size = stop, min(2 * size, FAR)
    begin, size = i, NEAR
    while begin > 0:
        stop = max(begin - size, 0)
        differ = (w[stop:begin] != w[stop + p : begin + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            begin -= k
            break
        begin, size = stop, min(2 * size, FAR)
    return begin, end


def find_runs(w: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of numbered words, by start, then period.

    A run has the smallest period that its words have, at least ``shortest`` words
    and three periods, and no neighbouring word that would keep the period.
    """
    found: dict[tuple[int, int], int] = {}
    cover = np.full(len(w), -1, np.int64)  # the run found last around each place
    ends, periods = np.zeros(64, np.int64), np.ones(64, np.int64)
    for p, points in _passing(w):
        if found:
            run = cover[points]
            points = points[~((run >= 0) & (points + 2 * p < ends[run]) & (p % periods[run] == 0))]
        past = -1
        for i in points.tolist():
            if i < past:
                continue
            begin, past = _extend(w, i, p)
            stop = past + p
            if stop - begin < max(shortest, REPEATS * p) or (begin, stop) in found:
                continue  # too short, or the run of a smaller period
            k = len(found)
            if k == len(ends):
                ends, periods = np.resize(ends, 2 * k), np.resize(periods, 2 * k)
            ends[k], periods[k] = stop, p
            cover[begin:stop] = k
            found[begin, stop] = p
    return sorted((a, b - a, p) for (a, b), p in found.items())


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words that stay: of every run the first period, and what lies in none."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.flatnonzero(np.cumsum(gone[:n]) == 0)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length in periods, compared exactly; ties to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run  # runs come by start, then period
    return best


class Found:
    """The words of a text and its runs."""

    def __init__(self, words: list[bytes], order: np.ndarray | None, shortest: int):
        numbers = word_numbers(words)
        if order is not None:
            words, numbers = [words[k] for k in order.tolist()], numbers[order]
        self.words, self.runs = words, find_runs(numbers, shortest)

    @property
    def text(self) -> bytes:
        """The words that stay, joined by one space."""
        if not self.runs:
            return b" ".join(self.words)
        return b" ".join([self.words[k] for k in collapsed(len(self.words), self.runs).tolist()])


def full(f: Found) -> tuple:
    return len(f.words), [dict(zip(RUN.names, r)) for r in f.runs], f.text.decode()


FULL = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def digest(f: Found) -> tuple:
    """Number of runs, the strongest one, and hashes of all runs and of what stays."""
    best, lines = strongest(f.runs), "".join(f"{a},{n},{p}\n" for a, n, p in f.runs)
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(f.runs), *own, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(f.text).hexdigest()


DIGEST = T.StructType([*(T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), *(T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256"))])


def _apply(derive: Callable[[Found], tuple], kinds: pa.Schema, order: Callable[[int | None, int], np.ndarray | None] | None, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1)
            for lo, hi, raw, at in chunks(batch.column(2)):
                data, rows = raw.tobytes(), []
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    words = data[a:b].split()  # of bytes: at ASCII white space only
                    rows.append(derive(Found(words, order(keys[lo + k].as_py(), len(words)) if order else None, shortest)))
                found = [pa.array(c, kinds.field(k + 1).type) for k, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *found], names=kinds.names)

    return run


def periodic_runs(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", derive: Callable[[Found], tuple] = full, schema: T.StructType = FULL, order: Callable[[int | None, int], np.ndarray | None] | None = None, shortest: int = SHORTEST) -> DataFrame:
    """``row`` (the whole input row) and the columns of ``schema`` for every row of ``docs``.

    Words are runs of anything but ASCII white space.  A run is a stretch of
    consecutive words with smallest period q and at least ``max(shortest, 3q)``
    words that no neighbouring word extends.  By default the columns are the
    number of words, all runs by start, then period, and the text less the words
    that some run holds after its first q.  ``derive`` makes others of a
    :class:`Found` in the worker that made it.

    ``order``, if given, says of a row's key and number of words which words stand
    in which place instead (None: as they are); it is asked with None for a null key.

    A null or empty text has no words and no runs; one of any length is read
    whole, in one task, in memory of some hundred bytes a word.  Only key and text
    count, so repeated rows are alike; other columns ride along in ``row`` whatever
    their names.  An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    rows = row_with(docs, key=key_col, text=text_col)
    out = T.StructType([rows.schema["row"], *schema.fields])
    return rows.mapInArrow(_apply(derive, to_arrow_schema(out), order, shortest), out)


"""Substring deduplication behind a count-min prefilter.

Pass 1: the hashes of a partition's word windows, ``FLUSH`` at a time, are
sketched into a count-min sketch: ``DEPTH`` rows of 2^b counters that saturate at
two.  A partial sketch is sent in pieces, as sorted counter numbers; the pieces
of one segment of counters meet in one task and are added up.  As 2^b follows the
input, some three windows fall on ten counters at any size.  The merged sketch
stays where its segments are: each sender is answered with one bit, "two or
more", for every counter that it sent, in files of the shared folder.  Nothing
that grows with the input is collected or broadcast.

Pass 2: the same partition derives the same windows again, reads its answers and
lets on only windows with every bit set.  The estimate never falls below the true
count, so a window that occurs twice is never lost.  A checksum goes along with
question and answer: should a partition ever hold other windows than before, all
of them go on, which costs time and loses nothing.  Each partition keeps the first
of equal windows (later ones are repeats already) and sends it with a 96-bit key
from two hashes that share nothing, neither of words nor of windows; equal keys
are grouped and all but the first occurrence are repeats.  A window common to
very many documents costs one row per partition.

Spans of repeats then meet their documents, and covered words are taken out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from groundcheck.llm._bytes import NOT_SPACE, chunks, mix, span_hash, window_hash, word_spans
from groundcheck.llm._shared import batch_rows, materialize, new_path, only, shuffle_count, small_batches, store_of

WINDOW = 20  # words
DEPTH = 2  # rows of the sketch
MIN_BITS = 16  # counters of a row, as a power of two, at least
SEGMENT, MAX_SEGMENT = 20, 28  # counters of a segment, as a power of two: some 2^10 segments a row, until they would outgrow a task
FLUSH = 1 << 20  # windows that a task holds before it sends them on
BLOB_ROWS = 128  # rows of an Arrow batch where a row is a packed piece of some kB
_BYTES_A_WINDOW = 4  # for the sketch's size only

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def sketch_bits(size: int) -> int:
    """Counters of a row, as a power of two, for texts of so many bytes."""
    return max(MIN_BITS, (size // _BYTES_A_WINDOW).bit_length())


def _segment_bits(bits: int) -> int:
    return min(bits, MAX_SEGMENT, max(SEGMENT, bits - 10))


def _counters(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return h * np.uint64(_ODD[row]) >> np.uint64(64 - bits)


def _sorted_counters(h: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters of a row in order, and the window of each."""
    c, k = _counters(h, row, bits), max(1, (len(h) - 1).bit_length())
    if bits + k > 64:
        order = np.argsort(c)
        return c[order], order
    both = c << np.uint64(k) | np.arange(len(h), dtype=np.uint64)
    both.sort()
    return both >> np.uint64(k), (both & np.uint64((1 << k) - 1)).astype(np.int64)


def _windows(batch: pa.RecordBatch, window: int, full: bool):
    """For each chunk the hash of every window; if ``full``, also its second hash, id, mark and first word."""
    for lo, hi, raw, at in chunks(batch.column(2)):
        starts, ends, first = word_spans(raw, at, NOT_SPACE)
        if len(starts) < window:
            continue
        text = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(first))
        whole = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :])
        found = [window_hash(span_hash(raw, starts, ends), window)[whole]]
        if full:
            text = text[whole]
            second = window_hash(span_hash(raw, starts, ends, seed=2), window, seed=2)[whole].astype(np.uint32)
            ids, marks = (batch.column(k).slice(lo, hi - lo).to_numpy() for k in (0, 1))
            found += [second, ids[text], marks[text], (whole - first[text]).astype(np.int32)]
        yield found


def _flushes(batches: Iterator[pa.RecordBatch], window: int, full: bool) -> Iterator[list[np.ndarray]]:
    """All windows of a partition in order, ``FLUSH`` at a time whatever the batches."""
    held, count = [], 0
    for batch in batches:
        for found in _windows(batch, window, full):
            held.append(found)
            count += len(found[0])
            if count >= FLUSH:
                all_ = [np.concatenate(x) for x in zip(*held)]
                while count >= FLUSH:
                    yield [x[:FLUSH] for x in all_]
                    all_ = [x[FLUSH:] for x in all_]
                    count -= FLUSH
                held = [[x.copy() for x in all_]]
    if count:
        yield [np.concatenate(x) for x in zip(*held)]


def _checksum(h: np.ndarray) -> int:
    return int((np.bitwise_xor.reduce(h) + np.uint64(len(h))).view(np.int64))


_QUESTIONS = "segment int, sender int, flush int, checksum long, steps binary, many binary"
_ANSWERS = "sender int, flush int, segment int, checksum long, n int, bits binary"


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], names=[x.split()[0] for x in names.split(", ")])


def _sketch(window: int, bits: int):
    """Partial sketches: of each flush and segment the counters set, as steps, and which of them more than once."""
    segment = _segment_bits(bits)
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    bounds = np.arange(1 << (bits - segment), dtype=np.uint64) << np.uint64(segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, zip_ = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1).compress
        for flush, (h,) in enumerate(_flushes(batches, window, False)):
            check = _checksum(h)
            for row in range(DEPTH):
                c = _counters(h, row, bits)
                c.sort()
                new = np.append(True, c[1:] != c[:-1])
                at, many = c[new], np.diff(np.append(np.flatnonzero(new), len(c))) > 1
                cut = np.append(np.searchsorted(at, bounds), len(at))
                rows = []
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    a, b = cut[k], cut[k + 1]
                    own = (at[a:b] - bounds[k]).astype(np.uint32)
                    rows.append((row << (bits - segment) | k, sender, flush, check, _pack(np.diff(own, prepend=np.uint32(0))), zip_(np.packbits(many[a:b]).tobytes())))
                for a in range(0, len(rows), 256):
                    yield _batch(rows[a : a + 256], kinds, _QUESTIONS)

    return run


def _answer(segment: int):
    """Rows sorted by segment: adds up a segment's partial sketches and answers each, a bit a counter: two or more."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def solve(seg: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sums, unzip = np.zeros(1 << segment, np.uint8), zstandard.ZstdDecompressor().decompress
        for *_, steps, many in rows:
            at = np.cumsum(_unpack(steps, np.uint32), dtype=np.int64)
            twice = np.unpackbits(np.frombuffer(unzip(many), np.uint8), count=len(at))
            sums[at] = np.minimum(sums[at] + 1 + twice, 2)
        out = []
        for sender, flush, check, steps, _ in rows:
            at = np.cumsum(_unpack(steps, np.uint32), dtype=np.int64)
            out.append((sender, flush, seg, check, len(at), np.packbits(sums[at] > 1).tobytes()))
            if len(out) == 256:
                yield _batch(out, kinds, _ANSWERS)
                out = []
        if out:
            yield _batch(out, kinds, _ANSWERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for seg, *row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if seg != now and rows:
                    yield from solve(now, rows)
                    rows = []
                now = seg
                rows.append(tuple(row))
        if rows:
            yield from solve(now, rows)

    return run


def _write_answers(base: str):
    """Rows sorted by sender, flush and segment: one file of answers a task, and where in it each flush's are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(base)
        task, out, at, now, parts, directory = TaskContext.get(), None, 0, None, [], []
        name = f"answers-{task.partitionId():06d}-{task.taskAttemptId()}"

        def flush() -> None:
            nonlocal out, at, parts
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}", compression=None)
            data = zstandard.ZstdCompressor(level=1).compress(np.packbits(np.concatenate(parts)).tobytes())
            directory.append((*now, sum(map(len, parts)), at, len(data)))
            out.write(data)
            at, parts = at + len(data), []

        for batch in batches:
            for sender, number, _, check, n, bits in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (sender, number, check) != now:
                    if parts:
                        flush()
                    now = (sender, number, check)
                parts.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=n))
        if parts:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{top}/{name}.idx", compression=None) as f:
                f.write(np.array(directory, np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name])], names=["part", "name"])

    return run


class Answers:
    """The answers to one sender."""

    def __init__(self, base: str, names: dict[int, str], files: int, sender: int) -> None:
        self.at, name = {}, names.get(sender % files)
        if name is None:
            return
        self.store, top = store_of(base)
        with self.store.open_input_file(f"{top}/{name}.idx") as f:
            directory = np.frombuffer(f.read(), np.int64).reshape(-1, 6)
        self.path = f"{top}/{name}"
        self.at = {(int(r[1]), int(r[2])): r[3:].tolist() for r in directory[directory[:, 0] == sender]}

    def passing(self, flush: int, h: np.ndarray, bits: int) -> np.ndarray:
        """Windows whose every counter is two or more; all where these are not the windows that were asked for."""
        place = self.at.get((flush, _checksum(h)))
        if place is None:
            return np.arange(len(h))
        with self.store.open_input_file(self.path) as f:
            flags = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read_at(place[2], place[1])), np.uint8), count=place[0])
        keep, done = np.ones(len(h), bool), 0
        for row in range(DEPTH):
            c, order = _sorted_counters(h, row, bits)
            number = np.cumsum(np.append(True, c[1:] != c[:-1])) - 1
            if done + number[-1] >= len(flags):
                return np.arange(len(h))
            keep[order] &= flags[done + number].astype(bool)
            done += int(number[-1]) + 1
        return np.flatnonzero(keep)


def ask_sketch(rows: DataFrame, window: int, bits: int) -> tuple[str, dict[int, str], int]:
    """Where the answers lie: a folder, the file of each task that wrote one, and how many tasks there were."""
    spark = rows.sparkSession
    n, base = shuffle_count(spark), new_path(spark, "sketch")
    asked = rows.mapInArrow(_sketch(window, bits), _QUESTIONS).repartition(n, "segment").sortWithinPartitions("segment")
    told = asked.mapInArrow(_answer(_segment_bits(bits)), _ANSWERS).repartitionById(n, "sender").sortWithinPartitions("sender", "flush", "segment")
    with batch_rows(spark, BLOB_ROWS):
        names = {r.part: r.name for r in told.mapInArrow(_write_answers(base), "part int, name string").collect()}  # a row a task
    return base, names, n


_ENTRY = np.dtype([("hi", "<u8"), ("lo", "<u4")])


def _firsts(hi, lo, ids, pos):
    """An order that puts equal windows together, the first occurrence first, and flags of the heads."""
    if np.all((ids[1:] > ids[:-1]) | (ids[1:] == ids[:-1]) & (pos[1:] >= pos[:-1])):
        order = np.argsort(hi, kind="stable")
    else:
        order = np.lexsort((pos, ids, hi))
    same = (hi[order][1:] == hi[order][:-1])
    if np.any(same & (lo[order][1:] != lo[order][:-1])):
        order = np.lexsort((pos, ids, lo, hi))
        same = (hi[order][1:] == hi[order][:-1]) & (lo[order][1:] == lo[order][:-1])
    return order, np.append(True, ~same)


def _repeats(order, head, ids, pos) -> np.ndarray:
    """Occurrences that are not the first of their window, nor the same place as the first."""
    group = np.flatnonzero(head)[np.cumsum(head) - 1]
    first = order[group]
    return order[(ids[order] != ids[first]) | (pos[order] != pos[first])]


_PARTS = "bucket int, keys binary, ids binary, marks binary, places binary"


def _part(bucket: int, keys, ids, marks, pos) -> tuple:
    return bucket, zstandard.ZstdCompressor(level=1).compress(keys.tobytes()), _pack(ids), _pack(marks), _pack(pos)


def _candidates(window: int, bits: int, buckets: int, answers):
    kinds = [pa.int32(), *[pa.binary()] * 4]

    def send(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        hi, lo, ids, marks, pos = (np.concatenate(x) for x in zip(*held))
        order, head = _firsts(hi, lo, ids, pos)
        rows = []
        known = _repeats(order, head, ids, pos)
        if len(known):  # these need no other partition; they go with their document
            own = (mix(ids[known].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            for k in np.unique(own):
                x = np.sort(known[own == k])
                rows.append(_part(int(k), np.zeros(0, _ENTRY), ids[x], marks[x], pos[x]))
        first = np.sort(order[head])
        own = ((hi[first] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(own, kind="stable")
        first, own = first[by], own[by]
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(first))):
            x = first[a:b]
            keys = np.empty(len(x), _ENTRY)
            keys["hi"], keys["lo"] = hi[x], lo[x]
            rows.append(_part(int(own[a]), keys, ids[x], marks[x], pos[x]))
        for a in range(0, len(rows), 256):
            yield _batch(rows[a : a + 256], kinds, _PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Answers(*answers, TaskContext.get().partitionId())
        held, count = [], 0
        for flush, found in enumerate(_flushes(batches, window, True)):
            keep = told.passing(flush, found[0], bits)
            if len(keep):
                held.append([x[keep] for x in found])
                count += len(keep)
            if count >= FLUSH:
                yield from send(held)
                held, count = [], 0
        if count:
            yield from send(held)

    return run


_REPEATS = "part int, ids binary, marks binary, places binary"


def _group(parts: int):
    """Rows sorted by bucket: groups the windows of a bucket exactly; yields repeats, packed by part of the documents."""

    def solve(rows: list[tuple]) -> list[np.ndarray]:
        unzip = zstandard.ZstdDecompressor().decompress
        got, done = [], []
        for keys, ids, marks, pos in rows:
            own = (_unpack(ids, np.int64), _unpack(marks, np.int64), _unpack(pos, np.int32))
            keys = np.frombuffer(unzip(keys), _ENTRY)
            got.append((keys["hi"], keys["lo"], *own)) if len(keys) else done.append(own)
        if got:
            hi, lo, ids, marks, pos = (np.concatenate(x) for x in zip(*got))
            order, head = _firsts(hi, lo, ids, pos)
            x = _repeats(order, head, ids, pos)
            done.append((ids[x], marks[x], pos[x]))
        return [np.concatenate(x) for x in zip(*done)]

    def send(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, marks, pos = (np.concatenate(x) for x in zip(*held))
        own = (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((pos, marks, ids, own))
        ids, marks, pos, own = ids[order], marks[order], pos[order], own[order]
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
        rows = [(int(own[a]), _pack(ids[a:b]), _pack(marks[a:b]), _pack(pos[a:b])) for a, b in zip(cut, np.append(cut[1:], len(own)))]
        for a in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 256]), (pa.int32(), *[pa.binary()] * 3))], names=["part", "ids", "marks", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held, count = None, [], [], 0
        for batch in batches:
            for bucket, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if bucket != now and rows:
                    held.append(solve(rows))
                    count, rows = count + len(held[-1][0]), []
                    if count >= FLUSH:
                        yield from send(held)
                        held, count = [], 0
                now = bucket
                rows.append(tuple(row))
        if rows:
            held.append(solve(rows))
        if held:
            yield from send(held)

    return run


def _spans(window: int):
    """Rows sorted by part: yields for each document the first words and ends of its merged spans."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, marks, pos = (np.concatenate(x) for x in zip(*((_unpack(i, np.int64), _unpack(m, np.int64), _unpack(p, np.int32)) for i, m, p in rows)))
        order = np.lexsort((pos, marks, ids))
        ids, marks, pos = ids[order], marks[order], pos[order]
        doc = np.append(True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]))
        start = doc | np.append(True, pos[1:] > pos[:-1] + window)
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(pos)) - 1
        heads = np.flatnonzero(doc)
        edges = np.append(np.searchsorted(begin, heads), len(begin)).astype(np.int32)
        for a in range(0, len(heads), 1024):
            e = edges[a : a + 1025]
            lists = [pa.ListArray.from_arrays(pa.array(e - e[0]), pa.array(x[e[0] : e[-1]].astype(np.int32))) for x in (pos[begin], pos[end] + window)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[heads[a : a + 1024]]), pa.array(marks[heads[a : a + 1024]]), *lists], names=["id", "mark", "begins", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for part, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if part != now and rows:
                    yield from solve(rows)
                    rows = []
                now = part
                rows.append(tuple(row))
        if rows:
            yield from solve(rows)

    return run


def _take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words_n, removed, kept = [], [], []
        for text, begins, ends in zip(batch.column("text"), batch.column("begins"), batch.column("ends")):
            text = (text.as_py() or "").encode()
            words = text.split()
            gone = 0
            if begins.is_valid:
                stay = np.ones(len(words), bool)
                for a, b in zip(begins.as_py(), ends.as_py()):
                    stay[a:b] = False
                gone = int(len(words) - stay.sum())
                text = b" ".join(compress(words, stay.tolist()))
            else:
                text = b" ".join(words)
            words_n.append(len(words))
            removed.append(gone)
            kept.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id, n_words, n_removed, text`` of every row; ``text`` is its kept words, joined by one space.

    Words are runs of anything but ASCII white space, unchanged, of whole texts of
    any length.  A word goes if a window of ``window`` words covers it whose words
    also start earlier: in a row of smaller id, or earlier in the same row.
    Windows are judged on the input, and are equal if two hashes of 64 and 32 bits
    over two hashes of 64 bits of each word are.  A null text has no words.  A null
    id comes before all others and stays null.  Of rows that share an id, those of
    equal text are the same place, so neither copy is earlier than the other; nor
    is one place of different texts under one id earlier than the same place of
    the other.  An empty table gives an empty result; other columns, whatever
    their names, are not read.
    """
    spark, lowest, docs = docs.sparkSession, -(2**63), only(docs, id_col, text_col)
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(lowest)).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    bits = sketch_bits(docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)
    n = shuffle_count(spark)
    answers = ask_sketch(rows, window, bits)
    parts = rows.mapInArrow(_candidates(window, bits, 8 * n, answers), _PARTS)
    found = parts.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_group(4 * n), _REPEATS)
    spans = found.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_spans(window), "id long, mark long, begins array<int>, ends array<int>")
    with batch_rows(spark, BLOB_ROWS):
        spans = materialize(spans, "repeats", light=True)
    out = rows.join(spans.hint("shuffle_hash"), ["id", "mark"], "left").select("id", "text", "begins", "ends").mapInArrow(_take_out, "id long, n_words long, n_removed long, text string")
    return out.withColumn("id", F.when(F.col("id") != lowest, F.col("id")))

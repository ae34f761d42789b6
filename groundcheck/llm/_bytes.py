"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Texts are never turned into Python strings here: words are (start, end) spans
over the column's own data buffer, and hashes are computed for all spans at
once with numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20


def byte_class(inverse_of: str = "", members: str = "", above: int = 256) -> np.ndarray:
    """A table of 256 flags: all but ``inverse_of``, or ``members`` and all from ``above``."""
    if inverse_of:
        table = np.ones(256, bool)
        table[list(inverse_of.encode())] = False
        return table
    table = np.arange(256) >= above
    table[list(members.encode())] = True
    return table


#: Words are runs of anything but ASCII white space.
NOT_SPACE = byte_class(inverse_of=" \t\n\v\f\r")
#: Words are runs of digits, lower-case letters and all beyond ASCII.
ALNUM = byte_class(members="0123456789abcdefghijklmnopqrstuvwxyz", above=128)
#: A-Z to a-z, every other byte as it is.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        # a null's slot may hold bytes; drop them by rebuilding without nulls
        return text_buffers(column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""))
    return raw, at


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi at a time, with their bytes and offsets from 0."""
    raw, at = text_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word's number of each text (n + 1)."""
    inside = np.zeros(len(raw) + 1, bool)
    np.take(table, raw, out=inside[:-1])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[1:-1]
    first[cuts] = inside[cuts]  # a word never runs from one text into the next
    last = inside[:-1].copy()
    last &= ~inside[1:]
    back = cuts[cuts > 0] - 1
    last[back] = inside[back]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every span's bytes."""
    size = ends - starts
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    words = np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, 0, (1,))
    salt = _U((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = mix(size.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + salt)
    todo = None
    k, longest = 0, int(size.max()) if len(size) else 0
    while k < min(longest, 256):
        if todo is None:
            part = words[starts + k] if k else words[starts]
            h = mix((h ^ (part & _MASKS[np.clip(size - k, 0, 8)])) * _U(0xFF51AFD7ED558CCD) + salt)
            todo = np.flatnonzero(size > 8)
        else:
            s, z = starts[todo] + k, size[todo] - k
            h[todo] = mix((h[todo] ^ (words[s] & _MASKS[np.clip(z, 0, 8)])) * _U(0xFF51AFD7ED558CCD) + salt)
            todo = todo[z > 8]
        k += 8
        if not len(todo):
            break
    if longest > 256:
        for i in np.flatnonzero(size > 256):
            digest = hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
            h[i] = int.from_bytes(digest.digest(), "little")
    return h


def window_hash(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A hash of every n consecutive items of ``h``, by doubling."""
    q = ((seed * 0x9E3779B97F4A7C15) ^ 0x2545F4914F6CDD1D) & (2**64 - 1) | 1
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total, have, power, span, rest = None, 0, h, 1, n
    while rest:
        if rest & 1:  # append ``span`` items after the ``have`` that are in total
            count = len(h) - have - span + 1
            if total is None:
                total = power[:count].copy()
            else:
                total = total[:count] * _U(pow(q, span, 2**64)) + power[have : have + count]
            have += span
        rest >>= 1
        if rest:
            power = power[: len(power) - span] * _U(pow(q, span, 2**64)) + power[span:]
            span *= 2
    return mix(total.copy())

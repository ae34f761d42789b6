"""SentencePiece encoding and decoding that keeps source offsets.

The model file's own normaliser is carried out here: the compiled character map
(a double-array trie and its replacement strings) is walked for the longest
matching prefix at each place, and every byte of the normalised text remembers
the source byte it came from.  The library then only segments the normalised
text, through a copy of the model whose normaliser does nothing.  Cumulative
piece lengths, looked up in that alignment, give each piece's span of bytes in
the original text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, types as T

from groundcheck.llm._bytes import chunks
from groundcheck.llm._shared import row_and_text, small_batches

_SPACE = "▁".encode()
# Fixed values of the model file's format: field numbers and piece types.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_UNKNOWN, _USER_DEFINED, _BYTE = 2, 4, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """Number, value and raw bytes of every field of a message."""
    at = 0
    while at < len(data):
        start = at
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value, data[start:at]


class CharacterMap:
    """The compiled map: longest prefix to its replacement."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest match at ``at``, or None."""
        units, found = self.units, None
        node = self._child(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            unit = units[node]
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(0, found[1])]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


@dataclass
class Encoded:
    """One text: ids, byte spans of the source for each id, and the ids decoded."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    decoded: str


class PieceCodec:
    """Normalise, encode and decode as the model file says."""

    def __init__(self, model: bytes) -> None:
        spec, rest, pieces, trainer = b"", [], [], b""
        for number, value, raw in _fields(model):
            if number == _NORMALIZER:
                spec = value
                continue
            rest.append(raw)
            if number == _PIECES:
                pieces.append(dict((n, v) for n, v, _ in _fields(value)))
            elif number == _TRAINER:
                trainer = value
        have = {n: v for n, v, _ in _fields(spec)}
        self.map = CharacterMap(have[2]) if have.get(2) else None
        self.dummy, self.squeeze, self.escape = (bool(have.get(n, 1)) for n in (3, 4, 5))
        self.suffix = bool({n: v for n, v, _ in _fields(trainer)}.get(24, 0))
        kinds = [p.get(3, 1) for p in pieces]
        self.symbols = sorted((p[1] for p, k in zip(pieces, kinds) if k == _USER_DEFINED), key=len, reverse=True)
        self.unknown = np.array([k == _UNKNOWN for k in kinds])
        self.size = np.array([1 if k == _BYTE else len(p[1]) for p, k in zip(pieces, kinds)], np.int64)
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + b"\x1a" + bytes([len(plain)]) + plain)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos = self.decoder.bos_id(), self.decoder.eos_id()

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        for s in self.symbols:
            if text.startswith(s, at):
                return len(s), s
        if self.map is not None and (got := self.map.longest(text, at)) is not None:
            return got
        b = text[at]
        n = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return n, text[at : at + n]

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte it comes from."""
        if not text:
            return b"", np.zeros(1, np.int64)
        space = _SPACE if self.escape else b" "
        if self.map is None and not self.squeeze and not self.symbols:
            raw = np.frombuffer(text, np.uint8)
            align = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(space), 1))
            pad = space if self.dummy else b""
            before, after = (b"", pad) if self.suffix else (pad, b"")
            return before + text.replace(b" ", space) + after, np.concatenate([np.zeros(len(before), np.int64), align, np.full(len(after) + 1, len(raw))])
        out, align, at, n = bytearray(), [], 0, len(text)
        while self.squeeze and at < n:
            size, new = self._prefix(text, at)
            if new != b" ":
                break
            at += size
        if at == n:
            return b"", np.zeros(1, np.int64)
        if self.dummy and not self.suffix:
            out += space
            align += [at] * len(space)
        spaced = self.squeeze
        while at < n:
            size, new = self._prefix(text, at)
            if spaced:
                new = new.lstrip(b" ")
            if new:
                spaced = self.squeeze and new.endswith(b" ")
                new = new.replace(b" ", space)
                out += new
                align += [at] * len(new)
            at += size
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = align[len(out)]
                del align[len(out) :]
        if self.dummy and self.suffix:
            out += space
            align += [at] * len(space)
        return bytes(out), np.array([*align, at], np.int64)

    def encode(self, texts: list[bytes], ends: bool = True, decode: bool = True) -> Iterator[Encoded]:
        """All ids of each text, with begin and end ids where ``ends`` is set."""
        plain = [self.normalise(t) for t in texts]
        lists = self.segmenter.encode([p.decode() for p, _ in plain], out_type=int, num_threads=1)
        for (normal, align), ids in zip(plain, lists):
            own = np.array(ids, np.int64)
            if self.unknown[own].any():
                size = [len(p.surface.encode()) for p in self.segmenter.encode(normal.decode(), return_type="proto").pieces]
                edge = np.concatenate([[0], np.cumsum(size)])
            else:
                edge = np.concatenate([[0], np.cumsum(self.size[own])])
            begin, end = align[edge[:-1]], align[edge[1:]]
            if ends:
                ids = [self.bos, *ids, self.eos]
                begin, end = np.concatenate([[0], begin, align[-1:]]), np.concatenate([[0], end, align[-1:]])
                own = np.concatenate([[self.bos], own, [self.eos]])
            yield Encoded(own.astype(np.uint32), begin.astype(np.uint32), end.astype(np.uint32), self.decoder.decode(ids) if decode else "")


#: What the operator returns of a text unless told otherwise.
FULL = T.StructType([*(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "begin", "end")), T.StructField("decoded", T.StringType())])


def full(e: Encoded) -> tuple:
    return e.ids.astype(np.int32), e.begin.astype(np.int32), e.end.astype(np.int32), e.decoded


def _apply(model: bytes, derive: Callable[[Encoded], tuple], kinds: pa.Schema, ends: bool, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in batches:
            for lo, hi, raw, at in chunks(batch.column(1)):
                data = raw.tobytes()
                rows = [derive(e) for e in codec.encode([data[a:b] for a, b in zip(at[:-1], at[1:])], ends, decode)]
                found = [pa.array(c, kinds.field(k + 1).type) for k, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *found], names=kinds.names)

    return run


def sentencepiece_encode(docs: DataFrame, model_path: str, text_col: str = "text", derive: Callable[[Encoded], tuple] = full, schema: T.StructType = FULL, ends: bool = True, decode: bool = True) -> DataFrame:
    """``row`` (the whole input row) and the columns of ``schema`` for every row of ``docs``.

    ``derive`` makes those columns of an :class:`Encoded`, in the worker that
    made it; by default ids, the byte span in the text of every id, and the
    decoded text.  ``ends`` adds the begin and end ids, whose spans are empty.
    A null text counts as empty, one of any length is encoded whole.  Only the text
    counts, so repeated rows are alike; other columns ride along in ``row``
    whatever their names.  An empty table gives an empty result.  The model file
    is read by the driver and sent along.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    rows = row_and_text(docs, text_col)
    out = T.StructType([rows.schema["row"], *schema.fields])
    return rows.mapInArrow(_apply(model, derive, to_arrow_schema(out), ends, decode), out)


def _decode(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            texts = (decoder.decode(ids.as_py()) if ids.is_valid and len(ids) else "" for ids in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "decoded"])

    return run


def sentencepiece_decode(docs: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``row`` (the whole input row) and ``decoded``, the text of its list of ids.

    Begin and end ids stand for no text.  A null list counts as empty and gives
    the empty text; an id that the model lacks is an error; an empty table gives
    an empty result.  The model file is read by the driver and sent along.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    rows = row_and_text(docs, ids_col)
    return rows.mapInArrow(_decode(model), T.StructType([rows.schema["row"], T.StructField("decoded", T.StringType())]))

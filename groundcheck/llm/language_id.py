"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's bytes, A-Z in lower case and white space as blanks, in
both directions and across words, and gives language log-odds at every position.
A document's probabilities pool the log-probabilities of all its positions.  So
that many run side by side, a text is cut into stretches of ``CORE`` bytes, each
read with the ``EDGE`` bytes before and after it; only its own bytes count, so
every byte of every text is labelled once.

Training is backpropagation through time in numpy on a bounded sample: at most
``SAMPLE`` documents a language and ``PIECES`` pieces of ``TRAIN`` bytes of each,
drawn at even steps from the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from groundcheck.llm._bytes import LOWER, chunks
from groundcheck.llm._shared import only, row_and_text, small_batches

HIDDEN = 16
CORE, EDGE = 224, 16  # bytes of a stretch, and bytes read on either side of it
CELLS = 1 << 20  # position scores that a block of stretches may hold
TOGETHER = 8  # positions whose scores are made log-probabilities at once
SAMPLE = 400  # training documents of a language, at most
PIECES, TRAIN = 20, 64  # pieces of a training document, at most, and their bytes
STEPS, BATCH, RATE = 600, 96, 0.02
UNDETERMINED = "und"
_RANGE = 1 << 30

#: A-Z to a-z, white space to blanks.
_READ = LOWER.copy()
_READ[9:14] = 32

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter; numerals of any kind are none."""
    found = _LETTER.search(text or "")
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _rows(raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spans as rows of bytes, zeros behind."""
    at = np.arange(int(size.max(initial=0)))
    inside = at < size[:, None]
    out = np.zeros(inside.shape, np.uint8)
    out[inside] = raw[(starts[:, None] + at)[inside]]
    return out


def _tokens(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte rows and their lengths."""
    size = np.array([len(w) for w in pieces], np.int64)
    return _rows(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size), size


@dataclass
class ByteGRU:
    """Weights: per direction a table of byte inputs (256 x 3H), recurrent 3H and bias; then the output layer."""

    langs: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> ByteGRU:
        rng = np.random.default_rng(seed)
        small = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        return cls(langs, [small(256, 3 * hidden) for _ in "fb"], [small(hidden, 3 * hidden) for _ in "fb"], small(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.out, self.bias]

    def _run(self, x: np.ndarray, live: np.ndarray, d: int, keep: bool) -> tuple[np.ndarray, list]:
        """States at every position of one direction; ``live``: position is inside the piece."""
        n, length = x.shape
        hidden = self.recurrent[d].shape[0]
        h, saved = np.zeros((n, hidden), np.float32), []
        states = np.zeros((length, n, hidden), np.float32)
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            a = self.tables[d][x[:, t]]
            r = h @ self.recurrent[d]
            zr = _sigmoid(a[:, : 2 * hidden] + r[:, : 2 * hidden])
            z, g = zr[:, :hidden], zr[:, hidden:]
            c = np.tanh(a[:, 2 * hidden :] + g * r[:, 2 * hidden :])
            on = live[:, t : t + 1]
            new = np.where(on, z * h + (1 - z) * c, h)
            if keep:
                saved.append((t, h, z, g, c, r[:, 2 * hidden :], on))
            h = new
            states[t] = h
        return states, saved

    def _states(self, x: np.ndarray, size: np.ndarray, d: int, until: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Positions, the first row that reaches so far and the states from that row on (overwritten by the next step).

        ``x`` is positions x rows, shorter rows first, so that the rows inside their piece are
        the last ones at every position.  Read from the front, positions end before ``until``;
        from behind, with it.  Sigmoids and hyperbolic tangents come from exponentials, which
        take numpy half the time: 1 / (1 + exp(-v)) and 2 / (1 + exp(-2 v)) - 1, their
        factors put into the weights.
        """
        hidden, n = self.recurrent[d].shape[0], x.shape[1]
        factor = np.array([-1, -1, -2], np.float32)[:, None, None]  # update, reset, candidate
        table, turn = (np.ascontiguousarray(w.reshape(-1, 3, hidden).transpose(1, 0, 2)) * factor for w in (self.tables[d], self.recurrent[d]))
        state, inputs, turned = np.zeros((n, hidden), np.float32), np.empty((3, n, hidden), np.float32), np.empty((3, n, hidden), np.float32)
        begun = np.searchsorted(size, np.arange(len(x)), "right")
        for t in range(until) if d == 0 else range(len(x) - 1, until - 1, -1):
            k = int(begun[t])
            h, a, r, at = state[k:], inputs[:, k:], turned[:, k:], x[t, k:].astype(np.intp)
            for gate, out in zip(table, a):
                gate.take(at, 0, out, "clip")
            np.matmul(h, turn, out=r)
            gates, c = a[:2], r[2]
            gates += r[:2]
            np.exp(gates, out=gates)
            gates += 1
            c /= gates[1]
            c += a[2]
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1
            h -= c
            h /= gates[0]
            h += c
            yield t, k, h

    def log_probabilities(self, x: np.ndarray, size: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Log-probabilities of every language, summed over positions ``lo`` to ``hi`` (all) of each row of bytes."""
        lo, hi = np.zeros_like(size) if lo is None else lo, size if hi is None else hi
        order = np.argsort(size, kind="stable")
        x, size, lo, hi = np.ascontiguousarray(x[order].T), size[order], lo[order], hi[order]
        hidden, langs = self.recurrent[0].shape[0], len(self.langs)
        first, last = int(lo.min()), int(hi.max())  # states behind the last position asked for, or before the first, say nothing
        left, right = self.out[:hidden].T.copy(), self.out[hidden:].T.copy()
        scores = np.zeros((last, langs, x.shape[1]), np.float32)
        total = np.zeros((langs, x.shape[1]))
        with np.errstate(over="ignore"):  # the gate is shut then
            for t, k, h in self._states(x, size, 0, last):
                if t >= first:
                    np.matmul(left, h.T, out=scores[t, :, k:])
            for t, k, h in self._states(x, size, 1, first):
                if t < last:
                    scores[t, :, k:] += right @ h.T
        for t in range(first, last, TOGETHER):
            score = scores[t : t + TOGETHER]
            score += self.bias[:, None]
            score -= score.max(axis=1, keepdims=True)
            score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
            at = np.arange(t, t + len(score))[:, None]
            total += np.einsum("tln,tn->ln", score, ((lo <= at) & (at < hi)).astype(np.float32))
        out = np.empty((len(order), langs))
        out[order] = total.T
        return out

    def gradients(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over positions, and its gradients by backpropagation through time."""
        live = np.arange(x.shape[1]) < size[:, None]
        runs = [self._run(x, live, d, True) for d in (0, 1)]
        both = np.concatenate([runs[0][0], runs[1][0]], axis=2)
        hidden = self.recurrent[0].shape[0]
        score = both @ self.out + self.bias
        score -= score.max(axis=2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=2, keepdims=True)
        on = live.T.astype(np.float32)
        total = on.sum()
        rows = np.arange(len(y))
        loss = -(np.log(p[:, rows, y] + 1e-9) * on).sum() / total
        d_score = p
        d_score[:, rows, y] -= 1
        d_score *= (on / total)[:, :, None]
        grads = [np.zeros_like(w) for w in self.weights()]
        grads[4] = np.tensordot(both, d_score, ((0, 1), (0, 1))).astype(np.float32)
        grads[5] = d_score.sum(axis=(0, 1))
        d_both = d_score @ self.out.T
        for d in (0, 1):
            back = np.zeros((len(y), hidden), np.float32)
            inputs, places = [], []
            for t, h, z, g, c, rc, alive in reversed(runs[d][1]):
                dh = back + d_both[t][:, d * hidden : (d + 1) * hidden]
                flow = np.where(alive, dh, 0)
                dc = flow * (1 - z) * (1 - c * c)
                dz = flow * (h - c) * z * (1 - z)
                dg = dc * rc * g * (1 - g)
                da = np.concatenate([dz, dg, dc], axis=1)
                dr = np.concatenate([dz, dg, dc * g], axis=1)
                inputs.append(da)
                places.append(x[:, t])
                grads[2 + d] += h.T @ dr
                back = np.where(alive, flow * z, dh) + dr @ self.recurrent[d].T
            at = np.concatenate(places)
            order = np.argsort(at, kind="stable")
            head = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
            grads[d][at[order][head]] = np.add.reduceat(np.concatenate(inputs)[order], head, axis=0)
        return float(loss), grads


def train(pieces: list[bytes], labels: list[int], langs: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 0) -> ByteGRU:
    """Fit by Adam; languages are drawn evenly."""
    net, rng = ByteGRU.fresh(langs, seed=seed), np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    by = [np.flatnonzero(y == k) for k in range(len(langs))]
    by = [b for b in by if len(b)]
    if len(by) < 2:
        return net
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in "mv")
    each = max(1, batch // len(by))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, each) for b in by])
        x, size = _tokens([pieces[i] for i in pick])
        _, grads = net.gradients(x, size, y[pick])
        scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads)))))
        now = rate * (1 - 0.9 * step / steps)
        for w, g, m, v in zip(net.weights(), grads, first, second):
            g *= scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _sampled_pieces(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, pieces = [], []
            for lang, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                data = _READ[np.frombuffer((text or "").encode(), np.uint8)].tobytes()
                count = -(-len(data) // TRAIN)
                own = [data[k * TRAIN : (k + 1) * TRAIN] for k in range(0, count, max(1, -(-count // most)))]
                langs += [lang] * len(own)
                pieces += own
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.binary())], names=["lang", "piece"])

    return run


def fit_language_id(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, pieces: int = PIECES, **training) -> ByteGRU:
    """Train on at most ``sample`` rows a language, chosen by a hash of the id, and ``pieces`` pieces of each.

    Rows without a language or text are passed over.  Of rows that share an id and
    language one counts, that of the least text.
    """
    rows = only(labelled, lang_col, id_col, text_col).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    ranked = rows.select("lang", "id").distinct().withColumn("h", F.pmod(F.xxhash64("id"), F.lit(_RANGE)))
    counts = ranked.groupBy("lang").agg(F.count("*").alias("rows"))
    few = ranked.join(counts, "lang").where(F.col("h") * F.col("rows") < 4.0 * sample * _RANGE)  # some 4 x sample a language, the lowest hashes
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("lang", "id")
    texts = rows.join(F.broadcast(chosen), ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text"))
    small_batches(labelled.sparkSession)
    got = texts.select("lang", "text").mapInArrow(_sampled_pieces(pieces), "lang string, piece binary").collect()
    langs = sorted({r.lang for r in got})
    number = {k: i for i, k in enumerate(langs)}
    got = sorted((r.lang, bytes(r.piece)) for r in got)  # the same whatever order tasks end in
    return train([w for _, w in got], [number[k] for k, _ in got], langs, **training)


def pooled(net: ByteGRU, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of each text summed over all its positions, and the number of positions."""
    raw, n = _READ[raw], np.diff(at)
    count = -(-n // CORE)
    text = np.repeat(np.arange(len(n)), count)
    core = CORE * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    begin = np.maximum(core - EDGE, 0)
    size = np.minimum(core + CORE + EDGE, n[text]) - begin
    lo, hi = core - begin, np.minimum(core + CORE, n[text]) - begin
    scores = np.zeros((len(text), len(net.langs)))
    order, k = np.argsort(size, kind="stable"), 0
    while k < len(order):  # stretches of like length together
        ahead = int(size[order[min(k + 1023, len(order) - 1)]])
        part = order[k : k + min(1024, max(16, CELLS // (ahead * len(net.langs))))]
        scores[part] = net.log_probabilities(_rows(raw, at[text[part]] + begin[part], size[part]), size[part], lo[part], hi[part])
        k += len(part)
    total = np.stack([np.bincount(text, weights=scores[:, k], minlength=len(n)) for k in range(len(net.langs))], axis=1)
    return total, n


def _predict(net, temperature: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for batch in batches:
            langs, scores = [], []
            for lo, hi, raw, at in chunks(batch.column(1)):
                if model.langs:
                    total, n = pooled(model, raw, at)
                    total = total / np.maximum(n, 1)[:, None] * np.minimum(n, temperature)[:, None]
                    p = np.exp(total - total.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                texts = batch.column(1).slice(lo, hi - lo)
                for k, text in enumerate(texts):
                    text = text.as_py()
                    if not model.langs or not has_letter(text):
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                    else:
                        best = int(p[k].argmax())
                        langs.append(model.langs[best])
                        scores.append(float(p[k, best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, net: ByteGRU, text_col: str = "text", temperature: float = 20.0) -> DataFrame:
    """``row`` (the whole input row), ``lang_pred`` and ``score`` (0 to 1) of every row.

    The score pools mean log-probabilities over all positions, as if of
    ``temperature`` positions at most, so that long texts are not all 1; texts of
    any length are read whole.  A text that is null or has no letter is ``und``
    with score 0.  Ties go to the language first in order.  Only the text counts,
    so repeated rows are alike; other columns ride along in ``row`` whatever their
    names, those that differ only in case included.  An empty table gives an empty
    result.
    """
    small_batches(docs.sparkSession)
    rows = row_and_text(docs, text_col)
    kinds = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(net), temperature), kinds)


def held_out(id_col: str = "doc_id"):
    """True for the third of rows that training never sees: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))

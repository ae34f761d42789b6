"""Exact top-k search by inner product with a table of distances to pivots.

For vectors q and x, ``<q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2``, and every pivot
p gives ``d(q, x) >= |d(q, p) - d(x, p)|``.  The distances of all rows to all
pivots are computed once and kept in a table; for a query the largest of these
lower bounds is an upper bound of a candidate's product.  Candidates are met in
the order of that bound until it falls below the k-th best product known, at
which point no other can be better: the search is exact, and pivots only decide
how much of it is saved.

Rows never meet all in one place.  The table stays in the shared folder; queries
are written beside it in files of at most ``QUERY_BYTES``.  A task holds
``GROUP_BYTES`` of candidates and reads the files of queries one after another,
so its memory is bounded whatever the number of either; what leaves it is at most
k lines for a query and group, and a window cuts these to k before and after the
only shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from groundcheck.llm._shared import materialize, new_path, only, small_batches
from groundcheck.session import spread

#: Pivots, and rows that they are chosen from (a bounded sample: it decides speed, never results).
PIVOTS, SAMPLE = 64, 4096
#: The sample's bytes, at most; candidates that a task holds; queries in a file.
SAMPLE_BYTES, GROUP_BYTES, QUERY_BYTES = 8 << 20, 48 << 20, 8 << 20
#: Queries whose bounds are computed together, and candidates.
ROWS, COLUMNS = 32, 2048
#: Candidates that are evaluated before the bound is looked at again, first and at most.
STEP, STEPS = 64, 1024
#: Rounding of distances in single precision and of their differences, in shares of the lengths that take part.
SLACK = 1e-6
#: Scaled components must be below this, so that doubles hold them exactly.
MOST = 2.0**53


@dataclass
class Pivots:
    """Points that distances are measured to, and the sample's rows, which give queries their first k-th best."""

    points: np.ndarray
    seeds: np.ndarray
    seed_keys: np.ndarray

    @property
    def dim(self) -> int:
        return self.points.shape[1]

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1)[:, None] + (self.points * self.points).sum(axis=1) - 2 * (x @ self.points.T)
        return np.sqrt(np.maximum(square, 0)).astype(np.float32)

    def threshold(self, x: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
        """The k-th best product of each query with rows of the sample of another id; -inf where there are fewer."""
        scores = products(x, self.seeds)
        scores[keys[:, None] == self.seed_keys] = -np.inf
        if len(self.seeds) < k:
            return np.full(len(x), -np.inf)
        return np.partition(scores, -k, axis=1)[:, -k]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of whole numbers as doubles, rounded down where doubles can't hold them: a bound from below."""
    found = a @ b.T
    if not _fits(a, b):
        found -= np.abs(a) @ np.abs(b).T * 1e-12
    return found


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    return not (a.size and b.size) or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[-1] < MOST


def choose(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows, each the farthest from those before it; fewer if the sample has fewer different rows."""
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _matrix(lists: pa.Array, dim: int, scale: float | None = None) -> np.ndarray:
    """Rows of numbers, shorter ones filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), dim))
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat if scale is None else np.floor(flat * scale)
    return out


def _cells(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as a binary cell."""
    width = rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _of_cells(cells: pa.Array, dtype: str) -> np.ndarray:
    cells = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
    return np.frombuffer(b"".join(cells.to_pylist()), dtype).reshape(len(cells), -1)


def _measure(pivots, scale: float, dtype: str):
    """The table's lines: vectors and their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pivots.value
        for batch in batches:
            x = _matrix(batch.column("vec"), own.dim, scale)
            cells = [_cells(x.astype(dtype)), _cells(own.distances(x))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("uid"), batch.column("key"), *cells], names=["id", "uid", "key", "v", "d"])

    return run


def _first(pivots, k: int, dtype: str):
    """Queries with the product that a candidate must reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pivots.value
        for batch in batches:
            at = np.concatenate([own.threshold(_of_cells(part.column("v"), dtype).astype(np.float64), part.column("key").to_numpy(), k) for part in (batch.slice(a, 256) for a in range(0, len(batch), 256))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "least"])

    return run


@dataclass
class Side:
    """Rows of the table as arrays; ``rank`` orders candidates by id, null last."""

    ids: pa.Array
    uids: np.ndarray
    x: np.ndarray
    d: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, dtype: str) -> Side:
        order = pc.sort_indices(table, sort_keys=[("id", "ascending")]).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return cls(table.column("id").combine_chunks(), table.column("uid").to_numpy(), _of_cells(table.column("v"), dtype).astype(np.float64), _of_cells(table.column("d"), "<f4"), rank)

    def __post_init__(self):
        self.square = (self.x * self.x).sum(axis=1)
        self.length = np.sqrt(self.square)


def bounds(q: Side, rows: slice, c: Side, far: float) -> np.ndarray:
    """What the products of these queries with all candidates can't exceed."""
    own, squares = q.d[rows], q.square[rows]
    out = np.empty((len(own), len(c.x)), np.float32)
    for a in range(0, len(c.x), COLUMNS):
        part = slice(a, a + COLUMNS)
        other = np.ascontiguousarray(c.d[part].T)
        least = np.zeros((len(own), other.shape[1]), np.float32)
        gap = np.empty_like(least)
        for p in range(other.shape[0]):
            np.subtract(own[:, p, None], other[p], out=gap)
            np.abs(gap, out=gap)
            np.maximum(least, gap, out=least)
        span = q.length[rows][:, None] + c.length[part] + far
        least = np.maximum(least - SLACK * span, 0)
        both = squares[:, None] + c.square[part]
        out[:, part] = (both - least * least) / 2 + SLACK * both
    return out


def _score(c: Side, at: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return c.x[at] @ q
    whole = [int(v) for v in q]
    return np.array([sum(int(a) * b for a, b in zip(c.x[k], whole)) for k in at], object)


def best(bound: np.ndarray, c: Side, q: np.ndarray, least: float, k: int, exact: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and products of the k best candidates of at least ``least``, ties to the smaller rank, and how many were evaluated.

    Candidates are evaluated in the order of their bound.  The bound of the next
    being below the k-th best product ends the search; an equal one does not, as
    its id may be smaller.
    """
    open_ = np.flatnonzero(bound >= least)
    open_ = open_[np.argsort(-bound[open_], kind="stable")]
    at, scores, done, step = np.zeros(0, np.int64), np.zeros(0, np.float64 if exact else object), 0, STEP
    while done < len(open_) and bound[open_[done]] >= least:
        more = open_[done : done + step]
        found = _score(c, more, q, exact)
        good = found >= least
        if good.any():
            at, scores = np.concatenate([at, more[good]]), np.concatenate([scores, found[good]])
            order = np.lexsort((c.rank[at], -scores)) if exact else sorted(range(len(at)), key=lambda j: (-scores[j], c.rank[at[j]]))
            at, scores = at[order[:k]], scores[order[:k]]
            if len(at) == k:
                least = max(least, float(scores[-1]) if exact else math.nextafter(float(scores[-1]), -math.inf))
        done += len(more)
        step = min(2 * step, STEPS)
    return at, scores, done


def _search(files: list[str], pivots, k: int, dtype: str, kinds: pa.Schema):
    """Each group of candidates against every file of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = float(np.sqrt((pivots.value.points ** 2).sum(axis=1)).max())
        held, size = [], 0
        for batch in batches:
            if size + batch.nbytes > GROUP_BYTES and held:
                yield from meet(held, far)
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from meet(held, far)

    def meet(held: list[pa.RecordBatch], far: float) -> Iterator[pa.RecordBatch]:
        if not (table := pa.Table.from_batches(held)).num_rows:
            return
        c = Side.of(table, dtype)
        place = {int(u): k for k, u in enumerate(c.uids)}
        for name in files:
            store, path = fs.FileSystem.from_uri(name)
            asked = pq.read_table(path, filesystem=store, partitioning=None)
            if not asked.num_rows:
                continue
            q, least, lines = Side.of(asked, dtype), asked.column("least").to_numpy(), []
            exact = _fits(q.x, c.x)
            for a in range(0, len(q.x), ROWS):
                bound = bounds(q, slice(a, a + ROWS), c, far)
                for r in range(len(bound)):
                    if (self_at := place.get(int(q.uids[a + r]))) is not None:
                        bound[r, self_at] = np.nan  # no candidate at all
                    at, scores, _ = best(bound[r], c, q.x[a + r], least[a + r], k, exact)
                    lines += [(a + r, int(p), int(s)) for p, s in zip(at, scores)]
            if lines:
                of, at, scores = (list(v) for v in zip(*lines))
                columns = [pa.array(q.uids[of]), q.ids.take(pa.array(of)), pa.array(scores, pa.int64()), c.ids.take(pa.array(at))]
                yield pa.RecordBatch.from_arrays([v.cast(kinds.field(j).type) for j, v in enumerate(columns)], schema=kinds)

    return run


def exact_top_k(vectors: DataFrame, asks: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of every query with all other rows.

    Components are turned into ``floor(scale * x)``, x as double, and products are
    whole numbers.  Queries are the rows for whose id ``asks`` is true; candidates
    are all rows but the query's own.  Ties go to the smaller id, a null one last.
    A null id can be found but asks nothing unless ``asks`` says so.

    Vectors that are null or hold null or non-finite components take no part.  Of
    vectors of different lengths the shorter counts as filled with zeros, an empty
    one as all zeros.  Repeated rows are candidates each, so one copy finds the
    others, and queries each, with lines of their own.  A scaled component of
    2^53 or more, or a product that no long holds, is an error.  An empty table
    gives an empty result; columns other than the two are not read, whatever their
    names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = vectors.sparkSession
    small_batches(spark)
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = only(vectors, id_col, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec").isNotNull() & F.forall("vec", sound)).withColumn("key", F.xxhash64("id"))
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("uid", T.LongType()), T.StructField("query_id", kind), T.StructField("score", T.LongType()), T.StructField("vec_id", kind)])
    seen = rows.agg(F.max(F.size("vec")).alias("dim"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(F.floor(x * scale).cast("double"))))).alias("top")).first()
    if seen.dim is None:
        return spark.createDataFrame([], out).withColumn("rank", F.lit(1)).select("query_id", "rank", "vec_id", "score")
    dim, top = max(seen.dim, 1), seen.top or 0.0
    if top >= MOST:
        raise ValueError("a component is too large")
    dtype = "<f4" if top < 2**24 else "<f8"

    few = min(sample, max(pivots, SAMPLE_BYTES // (8 * dim)))
    got = rows.orderBy(F.xxhash64("id", "vec"), "id").limit(few).select("key", "vec").toArrow()
    seeds = _matrix(got.column("vec"), dim, scale)
    shared = spark.sparkContext.broadcast(Pivots(choose(seeds, pivots), seeds, got.column("key").to_numpy()))

    lines = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("uid", "key")), *(T.StructField(c, T.BinaryType()) for c in ("v", "d"))])
    measured = rows.withColumn("uid", F.monotonically_increasing_id()).select("id", "uid", "key", "vec").mapInArrow(_measure(shared, scale, dtype), lines)
    table = materialize(measured, "pivots")

    asked = table.where(asks(F.col("id"))).mapInArrow(_first(shared, k, dtype), T.StructType([*lines.fields, T.StructField("least", T.DoubleType())]))
    path, most = new_path(spark, "asked"), max(1, QUERY_BYTES // (8 * dim + 4 * pivots + 64))
    asked.write.option("maxRecordsPerFile", most).parquet(path)
    files = sorted(spark.read.schema(asked.schema).parquet(path).inputFiles())
    found = spread(table).mapInArrow(_search(files, shared, k, dtype, to_arrow_schema(out)), out)
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

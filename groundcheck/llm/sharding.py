"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

A *partial partition* is a vector of shard sums.  Differencing takes the two
with the largest spread (most less least) and adds them oppositely ordered, the
fullest shard of one onto the emptiest of the other, until one is left.

Groups never meet in one place.  Some ``HELD`` groups at a time are differenced
into one partial partition; these are items of the next level, which is differenced
in the same way, until ``TOP`` or fewer are left for the driver.  A group's
shard follows from the permutations on its way up, looked up by joins on ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from groundcheck.llm._shared import join_skewed, light_count, materialize, only, small_batches

#: Partial partitions that the driver combines: at most this many vectors of shard sums.
TOP = 4096
#: Items that a task differences at once, at least; the last of a partition up to twice as many.
HELD = 32768


def difference(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of shard sums): total sums, and where each item's shards go."""
    n, k = items.shape
    order = np.argsort(-items, axis=1, kind="stable")
    sums = [items[i][order[i]] for i in range(n)]  # each falling
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []  # children and the order that sorts their sum
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        by = np.argsort(-total, kind="stable")
        sums[a], sums[b] = None, None
        sums.append(total[by])
        made.append((a, b, by))
        heapq.heappush(heap, (-int(sums[-1][0] - sums[-1][-1]), len(sums) - 1))
    top = len(sums) - 1
    to: list[np.ndarray | None] = [None] * len(sums)
    to[top] = np.arange(k)
    for j in range(len(made) - 1, -1, -1):  # sorted place of a sum -> shard
        a, b, by = made[j]
        back = np.empty(k, np.int64)
        back[by] = to[n + j]
        to[a], to[b] = back, back[::-1]
        to[n + j] = None
    where = np.empty((n, k), np.int64)
    for i in range(n):
        where[i, order[i]] = to[i]
    return sums[top], where


def _level(shards: int, first: bool):
    """One row per item: where its shards go, in the piece that it becomes part of; and one row per piece."""

    def solve(ids: list[bytes], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        size = np.zeros((n, shards), np.int64)
        if first:
            size[:, 0] = np.concatenate(sizes)
        else:
            size = np.concatenate(sizes).reshape(n, shards)
        total, where = difference(size)
        goes = where[:, :1] if first else where
        for a in range(0, n, 4096):
            part = goes[a : a + 4096]
            m = len(part)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel().astype(np.int32)))
            yield batch(ids[a : a + m], [ids[0]] * m, lists, [None] * m)
        yield batch([None], [ids[0]], pa.array([None], pa.list_(pa.int32())), [total.tolist()])

    def batch(items, pieces, goes, sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(items, pa.binary()), pa.array(pieces, pa.binary()), goes, pa.array(sums, pa.list_(pa.int64()))], names=["item", "piece", "goes", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[bytes] = []
        sizes: list[np.ndarray] = []
        for got in batches:
            ids += got.column(0).to_pylist()
            sizes.append(got.column(1).to_numpy() if first else got.column(1).flatten().to_numpy())
            if len(ids) >= 2 * HELD:  # so that no piece is small beside the others
                sizes, cut = [np.concatenate(sizes)], HELD * (1 if first else shards)
                yield from solve(ids[:HELD], [sizes[0][:cut]])
                ids, sizes = ids[HELD:], [sizes[0][cut:]]
        if ids:
            yield from solve(ids, sizes)

    return run


_LEVEL = "item binary, piece binary, goes array<int>, sums array<long>"


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``item, shard`` for ``groups`` of ``item`` (binary, distinct) and ``bytes`` (long)."""
    spark = groups.sparkSession
    now, first, path = groups.select("item", "bytes"), True, None
    while True:
        done = materialize(now.mapInArrow(_level(shards, first), _LEVEL), "differencing", light=True)
        goes = done.where("item is not null").select("item", "piece", "goes")
        if first:
            path = goes.select("item", "piece", F.col("goes")[0].alias("at"))
        else:
            path = path.join(goes.select(F.col("item").alias("piece"), F.col("piece").alias("up"), "goes"), "piece").select("item", F.col("up").alias("piece"), F.element_at("goes", F.col("at") + 1).alias("at"))
        pieces = done.where("item is null").select(F.col("piece").alias("item"), F.col("sums").alias("bytes"))
        count = pieces.count()
        if count <= TOP:
            break
        now, first = pieces.repartition(max(1, count // 1024)), False
    rows = sorted((bytes(r.item), r.bytes) for r in pieces.collect())
    if not rows:
        return path.select("item", F.col("at").alias("shard"))
    _, where = difference(np.array([b for _, b in rows], np.int64).reshape(len(rows), shards))
    table = spark.createDataFrame([(i, w.tolist()) for (i, _), w in zip(rows, where)], "piece binary, goes array<int>")
    return path.join(F.broadcast(table), "piece").select("item", F.element_at("goes", F.col("at") + 1).alias("shard"))  # at most TOP rows


def with_slots(rows: DataFrame, group: str, order: list[str], name: str = "slot") -> DataFrame:
    """Number the rows of each ``group`` without gaps from 0 along ``order``, without bringing a group together."""
    n = light_count(rows.sparkSession)
    place = F.monotonically_increasing_id()
    line = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).select("*", place.alias("_place"))
    line = materialize(line.withColumn("_part", F.shiftright("_place", 33)), "slots", light=True)
    runs = line.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))  # partitions x groups at most
    before = runs.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return line.join(before.drop("_n"), [group, "_part"]).withColumn(name, F.col("_place") - F.col("_first") + F.col("_before")).drop("_place", "_first", "_before", "_part").coalesce(n)


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """``id, size, text_crc32, shard, slot`` of every row; shard sizes in bytes are near equal.

    A row's size is its text's UTF-8 bytes plus ``overhead``, however long the
    text; rows of equal texts are one group and share a shard.  A null text counts
    as empty (and so groups with empty ones).  Slots number a shard's rows from 0
    by id, null ids first; rows of equal id, repeated rows too, get slots of their
    own.  Groups are differenced in a fixed order of their digests, but how batches
    fall depends on the cluster: the law holds for any such order, the shard of a
    given group may differ, as between groups of equal size.  An empty table gives
    an empty result; other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    n = light_count(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("item"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups", light=True)
    placed = assign_groups(groups.repartition(n, "item").sortWithinPartitions("item"), shards)
    placed = join_skewed(rows, placed, ["item"], groups).select("id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    placed = materialize(placed, "placed", light=True)  # ranges are sampled: don't join twice
    return with_slots(placed, "shard", ["id", "text_crc32"])

"""Shared storage for tables that cut a plan's lineage.

Executors may be lost at any time, so intermediate results never live on one
machine: they are Parquet tables below ``spark.checkpoint.dir``, which the
cluster shares.  Only where that setting is absent and the master is this one
machine (tests, a laptop) a temporary folder takes its place; a cluster without
it is refused.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, with its scheme; on one machine without that setting, one made for this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        place = spark._jvm.org.apache.hadoop.fs.Path(named.rstrip("/"))
        full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
        return re.sub(r"^file:/+", "file:///", full)
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="groundcheck-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses."""
    path = f"{shared_dir(spark)}/groundcheck-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def store_of(base: str) -> tuple[fs.FileSystem, str]:
    """The store of a path from :func:`new_path`, for code that runs in tasks, and the path there."""
    return fs.FileSystem.from_uri(base)


def _remove(spark: SparkSession, path: str) -> None:
    """Tables of a run go when it ends, as far as their store can still be reached."""
    if path.startswith("file://"):
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        return
    with contextlib.suppress(Exception):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str, light: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it; ``light`` tables hold no texts and get fewer files."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if light:
        df = df.coalesce(light_count(spark))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _named(docs: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """``docs`` with columns named by place, and the one of a given name: exactly that, else the only one that differs in case."""

    def place(name: str) -> Column:
        found = [k for k, c in enumerate(docs.columns) if c == name] or [k for k, c in enumerate(docs.columns) if c.lower() == name.lower()]
        if len(found) != 1:
            raise ValueError(f"{len(found)} columns named {name}")
        return F.col(f"c{found[0]}")

    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), place


def only(docs: DataFrame, *names: str) -> DataFrame:
    """These columns of ``docs``, whatever others are called."""
    plain, place = _named(docs)
    return plain.select(*(place(n).alias(n) for n in names))


def row_with(docs: DataFrame, **named: str) -> DataFrame:
    """``row``, a struct of all columns, and the ``named`` ones; columns may have any names, those that differ only in case too."""
    plain, place = _named(docs)
    return plain.select(F.struct(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns))).alias("row"), *(place(c).alias(n) for n, c in named.items()))


def row_and_text(docs: DataFrame, text_col: str) -> DataFrame:
    """``row``, a struct of all columns, and ``text``."""
    return row_with(docs, text=text_col)


#: Bytes and rows of an Arrow batch: workers hold a batch and what is made of it.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1024


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory does not follow the texts' lengths."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = int("".join(c for c in spark.conf.get(key) if c.isdigit()) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Fewer rows a batch for what runs inside, where rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_count(spark: SparkSession) -> int:
    """Partitions to deal keyed rows to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def light_count(spark: SparkSession) -> int:
    """Partitions for rows of ids and numbers, which are some hundred times smaller than texts."""
    return -(-shuffle_count(spark) // 8)


#: A key of more than one in so many rows is hot; there can be no more such keys than this.
HEAVY = 1024
#: Rows that are broadcast at most (ids or digests, some 50 bytes each).
FEW = 1 << 18


def join_skewed(rows: DataFrame, table: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``table``, whose ``keys`` are distinct, in which no key is gathered in one task.

    ``sizes`` (``keys, n``, written out) counts the rows of each key.  Keys of
    more than one ``HEAVY``-th of the sum of ``n`` are fewer than ``HEAVY``:
    their lines of ``table`` are broadcast to where rows lie, and only rows of
    other keys are dealt out.  Null keys join nothing.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.where(F.col("n") * HEAVY > total).select(*keys)
    here = rows.join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys)
    dealt = rows.join(F.broadcast(hot), keys, "left_anti").join(table.join(F.broadcast(hot), keys, "left_anti"), keys)
    return here.unionByName(dealt)


def without(docs: DataFrame, gone: DataFrame, on: Callable[[DataFrame], Column]) -> DataFrame:
    """``docs`` less the rows that ``on(gone)`` matches; up to ``FEW`` rows of ``gone`` are broadcast, more are joined by key."""
    gone = materialize(gone, "gone", light=True)
    few = gone.limit(FEW + 1).count() <= FEW
    return docs.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), on(gone), "left_anti")

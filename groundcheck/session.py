"""Session settings that the engine's results rely on."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, partitions: int | None = None, app: str = "groundcheck") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GROUNDCHECK_DRIVER_MEMORY", "4g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores, as of one small file, dealt out; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine without that setting, one made for this process, which is set."""
    context = spark.sparkContext
    if context.getConf().get("spark.checkpoint.dir"):
        return context.getConf().get("spark.checkpoint.dir").rstrip("/")
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="groundcheck-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(f"file://{folder}")
    return context.getCheckpointDir()


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` computed and kept in the shared folder."""
    if rows.sparkSession.sparkContext.getCheckpointDir() is None:
        rows.sparkSession.sparkContext.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to a new Parquet table in the shared folder and read back, so that no later plan computes them again."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

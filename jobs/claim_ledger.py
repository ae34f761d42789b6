"""Verify answers as they arrive and keep a ledger of their claims.

    python -m jobs.claim_ledger --responses PATH --passages PATH --output PATH --checkpoint PATH

A stream of Parquet files: a run takes the files that no earlier run has taken,
as its checkpoint tells, in batches of at most ``files_per_batch`` files, and
ends.  Each answer is cut into claims, every claim is given the ``top_k``
passages with which it shares most words, and is supported if it overlaps one of
them by more than ``support_threshold``.

The ledger is partitioned by model and batch.  A batch replaces its own
partitions and no others, so one that is run again after a failure leaves what
one run leaves; a run that finds no new file changes nothing.
"""

from __future__ import annotations

import logging
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from groundcheck.operators import retrieval, verification
from groundcheck.plans.fixtures import extract
from groundcheck.schema import struct
from groundcheck.session import spread
from jobs._common import columns, command, read

LOG = logging.getLogger("jobs.claim_ledger")

LEDGER = struct(
    dataset_item_id=T.StringType(), claim_id=T.StringType(), claim_text=T.StringType(), claim_start=T.IntegerType(), claim_end=T.IntegerType(),
    evidence_ids=T.ArrayType(T.StringType()), similarity=T.DoubleType(), label=T.StringType(), model_name=T.StringType(), batch_id=T.LongType(),
)


def verified(responses: DataFrame, passages: DataFrame, top_k: int, threshold: float) -> DataFrame:
    """A line for each claim; narrow, as passages are the bounded side that goes to the claims."""
    ranked = retrieval.baseline_ranking(extract(responses), passages, top_k)
    found = verification.baseline_verify(ranked, threshold)
    return found.select("model_name", "dataset_item_id", "claim_id", "claim_text", "claim_start", "claim_end", F.col("hits.evidence_id").alias("evidence_ids"), "similarity", "label")


def ledger(spark: SparkSession, output: str) -> DataFrame:
    """The claims of all batches so far."""
    return spark.read.schema(LEDGER).parquet(output)


def _either(path: str) -> str:
    """The path as a pattern that only it matches: a stream takes a pattern for a single file, too, but a plain path for a folder only."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, responses: str, passages: str, output: str, checkpoint: str, config: dict[str, Any]) -> dict[str, int]:
    """Take what is new under ``responses`` into the ledger; counts of batches, responses and claims.

    Responses without text, or with a blank one, make no claims.  Model and item
    are a response's key; a row that arrives again in another file is taken again.
    An empty table gives an empty ledger.
    """
    evidence = columns(read(spark, passages), config["passages"])
    total = {"batches": 0, "responses": 0, "claims": 0}
    # with no lines: the folder exists, whatever arrives
    spark.createDataFrame([], LEDGER).write.mode("append").partitionBy("model_name", "batch_id").parquet(output)

    def take(batch: DataFrame, number: int) -> None:
        rows = spread(columns(batch, config["responses"]))
        lines = verified(rows, evidence, config["top_k"], config["support_threshold"]).withColumn("batch_id", F.lit(number).cast("long"))
        # rebalanced: files of one model each, those of a large model several
        writer = lines.select(*LEDGER.names).hint("rebalance", "model_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("model_name", "batch_id").parquet(output)
        counts = {"responses": batch.count(), "claims": ledger(spark, output).where(F.col("batch_id") == number).count()}  # of Parquet's own counts
        LOG.info("batch %d: read %d responses of %s, wrote %d claims to %s", number, counts["responses"], responses, counts["claims"], output)
        total.update({k: total[k] + n for k, n in counts.items()}, batches=total["batches"] + 1)

    source = spark.readStream.schema(read(spark, responses).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_either(responses))
    query = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("read %d responses in %d batches, wrote %d claims", total["responses"], total["batches"], total["claims"])
    return total


PATHS = {"responses": "Parquet table of answers, a file or a folder that grows", "passages": "Parquet table of trusted passages", "output": "folder of the ledger", "checkpoint": "folder of the stream's checkpoint"}

if __name__ == "__main__":
    command("claim_ledger", __doc__, PATHS, run, str(Path(__file__).with_suffix(".json")))

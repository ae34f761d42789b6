"""Prompts as a stream: each is answered once per model and appended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from groundcheck.plans.generate import Adapter, GenerationError, STORED, check_adapters, pending, store_answers, stored_responses
from groundcheck.schema import PROMPTS


def stream_generation(spark: SparkSession, prompts: str, adapters: list[Adapter], store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Read JSON Lines prompts as they arrive and append responses to the Parquet store.

    Which items have come is the stream's own state, so the store is never read
    for it: an item that comes again is not asked again.  A batch that is run again
    after a failure reads what its own earlier tries have stored, and asks for the
    rest; all proper answers are stored before a failure ends the batch.
    """
    check_adapters(adapters)
    names = [a.name for a in adapters]
    rows = spark.readStream.schema(PROMPTS).json(prompts).select("dataset_item_id", "prompt").dropDuplicates(["dataset_item_id"])

    def append(batch: DataFrame, epoch: int) -> None:
        own = f"/batch={epoch}"
        path = f"{store}/responses{own}/try={uuid.uuid4().hex}"
        store_answers(pending(batch, names, stored_responses(batch.sparkSession, store, own)).persist(), adapters, path)
        failed = batch.sparkSession.read.schema(STORED).parquet(path).where("error is not null").limit(1).collect()
        if failed:
            raise GenerationError(f"{failed[0].error} for {failed[0].model_name} on {failed[0].dataset_item_id}")

    writer = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The responses of all batches so far."""
    return stored_responses(spark, store).select("model_name", "dataset_item_id", "text", "confidence")


def rolling_label_counts(facts: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Claims by model, label and window of a stream of facts; late rows count within the watermark."""
    return facts.withWatermark(time, late).groupBy(F.window(time, window), "model_name", "label").agg(F.count("*").alias("claims"))

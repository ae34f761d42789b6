"""Resumable generation of responses by pluggable adapters."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from importlib import import_module
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundcheck.operators.rules import Rule, pending_pairs, repeated, require, violations
from groundcheck.functions.scores import in_unit
from groundcheck.functions.text import is_blank
from groundcheck.schema import RESPONSE_KEY, RESPONSES
from groundcheck.sources.jsonl import read_responses

#: A row of the response store; ``error`` is the type of a failure, which has no text.
STORED = "model_name string, dataset_item_id string, text string, confidence double, generated_at_utc string, error string"


class Adapter:
    """A model: ``name``, JSON-ready ``metadata`` and ``generate(item_id, prompt) -> (text, confidence)``.

    Adapters are sent to executors, so clients belong into ``generate``.
    """

    name: str = ""
    metadata: dict[str, Any] = {}

    def generate(self, item_id: str, prompt: str) -> tuple[str, float | None]:
        raise NotImplementedError


class StaticAdapter(Adapter):
    """Answers from a dict; an item that it does not have is an error."""

    def __init__(self, name: str, answers: dict[str, tuple[str, float | None]], metadata: dict[str, Any] | None = None) -> None:
        self.name, self.answers, self.metadata = name, answers, metadata or {}

    def generate(self, item_id: str, prompt: str) -> tuple[str, float | None]:
        return self.answers[item_id]


def load_adapters(spec: str) -> list[Adapter]:
    """Adapters of ``module:function``."""
    module, _, name = spec.partition(":")
    if not module or not name:
        raise ValueError("an adapter factory is named module:function")
    return list(getattr(import_module(module), name)())


def static_responses(prompts: DataFrame, answers: DataFrame, model: str) -> DataFrame:
    """Canned answers as a join; prompts without one are left out."""
    return prompts.select("dataset_item_id").join(answers, "dataset_item_id").withColumn("model_name", F.lit(model))


def check_adapters(adapters: list[Adapter]) -> None:
    names = [a.name for a in adapters]
    if not names or any(not n.strip() for n in names) or len(set(names)) < len(names):
        raise ValueError("adapters need unique names that are not blank")
    for a in adapters:
        json.dumps(a.metadata)


def pending(prompts: DataFrame, names: list[str], done: DataFrame | None) -> DataFrame:
    """Item and model pairs that have no response yet; the models' names are the caller's list."""
    models = F.explode(F.array(*(F.lit(n) for n in names))).alias("model_name")
    pairs = prompts.select("dataset_item_id", "prompt", models)
    return pairs if done is None else pending_pairs(pairs, done)


def generate(prompts: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """One response per prompt and adapter; materialise it once, as adapters may have side effects.  A failure fails the job."""
    check_adapters(adapters)
    rows = answers(pending(prompts, [a.name for a in adapters], None), adapters)
    failed = F.raise_error(F.concat(F.lit("no response: "), "error")).cast("boolean")
    return rows.where(F.when(F.col("error").isNull(), True).otherwise(failed)).select("model_name", "dataset_item_id", "text", "confidence")


def _wrong(text: Any, confidence: Any) -> str | None:
    """What makes a response improper, as the rules of :func:`response_rules` have it."""
    if not isinstance(text, str) or not text.strip():
        return "BlankResponse"
    if confidence is not None and (isinstance(confidence, bool) or not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1):
        return "InvalidConfidence"
    return None


def answers(pairs: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """A row of :data:`STORED` for each pair: a proper response, or the type of what went wrong and nothing else."""
    by = {a.name: a for a in adapters}

    def answer(model: str, item: str, prompt: str) -> tuple:
        try:
            text, confidence = by[model].generate(item, prompt)
            wrong = _wrong(text, confidence)
        except Exception as error:  # noqa: BLE001 - other answers of the task are kept
            wrong = type(error).__name__
        if wrong:
            return model, item, None, None, datetime.now(UTC).isoformat(), wrong
        return model, item, text, confidence, datetime.now(UTC).isoformat(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("model_name", "dataset_item_id", "prompt")
        for batch in batches:
            rows = [answer(*pair) for pair in zip(*(batch.column(n).to_pylist() for n in names), strict=True)]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string()] * 3 + [pa.float64()] + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in STORED.split(", ")])

    return pairs.select("model_name", "dataset_item_id", "prompt").mapInArrow(run, STORED)


def response_rules() -> list[Rule]:
    return [Rule("blank text", is_blank(F.col("text"))), Rule("confidence out of range", F.col("confidence").isNotNull() & ~in_unit(F.col("confidence")))]


def stored_responses(spark: SparkSession, store: str, part: str = "") -> DataFrame | None:
    """All proper responses of a store, or of a folder in it, or None where nothing was ever stored.

    A task that was done but not known to be, as when its executor is lost, is run
    again and may leave two answers to a pair; the earlier one of a run counts.
    """
    data = f"{store}/responses{part}"
    if not _exists(spark, data):
        return None
    rows = spark.read.schema(STORED).option("recursiveFileLookup", True).parquet(data).where(F.col("error").isNull())
    own, rest = F.regexp_extract(F.col("_metadata.file_path"), "(?:run|batch)=([^/]+)", 1), ("generated_at_utc", "text", "confidence")
    first = rows.groupBy(*RESPONSE_KEY, own.alias("run")).agg(F.min(F.struct(*rest)).alias("r"))
    return first.select(*RESPONSE_KEY, *(F.col(f"r.{c}").alias(c) for c in rest))


def saved_responses(spark: SparkSession, path: str) -> DataFrame:
    """The responses of a store of :func:`run_generation`, or of JSON Lines files, with the same columns."""
    if not _exists(spark, f"{path}/responses"):
        return read_responses(spark, path)
    return stored_responses(spark, path).select(*RESPONSES.names)


def store_answers(pairs: DataFrame, adapters: list[Adapter], path: str, at_once: int = 1) -> None:
    """Ask for ``pairs`` and write the answers, ``at_once`` to a task.

    A task's answers stand in the store as soon as it is done (the committer's
    second algorithm), whatever becomes of the job, so what dies costs the answers
    of the tasks that were running.
    """
    tasks = max(1, -(-pairs.count() // at_once))
    answers(pairs.repartition(tasks), adapters).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


class GenerationError(RuntimeError):
    """Some pairs have no response; those that have one are stored."""


def run_generation(prompts: DataFrame, adapters: list[Adapter], store: str, hashes: dict[str, str], resume: bool = False, batch: int = 1000, at_once: int = 1) -> dict[str, Any]:
    """Generate what is pending, some ``batch`` pairs at a time, into the Parquet store; returns the run's manifest.

    What is pending is found once, and kept by batch, so that a batch reads its own
    pairs alone.  Answers are stored task by task, ``at_once`` each, so a lost
    executor or driver costs those that were being asked; a pair that fails, or
    whose response breaks a rule, costs no other its answer.  After a batch with
    failures the run stops; the manifest and the error name one pair and the
    failure's type alone.

    The store is the record of what is done.  The manifest beside it fixes
    prompts, hashes and adapters; resuming with others is refused, as is a store
    with responses to other pairs, with repeated ones or with fewer than the
    manifest counts.  Without its manifest a store can still be resumed.
    """
    spark = prompts.sparkSession
    check_adapters(adapters)
    if min(batch, at_once) < 1:
        raise ValueError("batch and at_once must be at least 1")
    require(violations(prompts, [Rule("blank id", is_blank(F.col("dataset_item_id"))), Rule("blank prompt", is_blank(F.col("prompt")))], ["dataset_item_id"]))
    require(repeated(prompts, ["dataset_item_id"], "repeated id"))
    names, beside = [a.name for a in adapters], f"{store}/manifest.json"
    items = prompts.agg(F.count("*").alias("n"), F.sum(F.xxhash64("dataset_item_id").cast("decimal(20,0)")).cast("string").alias("digest")).first()
    if not items.n:
        raise ValueError("there are no prompts")
    fixed = {"schema_version": 1, **hashes, "dataset_item_digest": items.digest, "adapters": [{"model_name": a.name, "adapter_type": type(a).__name__, "metadata": a.metadata} for a in adapters], "expected_response_count": items.n * len(adapters)}
    old, done = _read_manifest(spark, beside), stored_responses(spark, store)
    if (old is not None or done is not None) and not resume:
        raise ValueError("the store holds a run; resume it or choose another")
    differ = [k for k, v in fixed.items() if old is not None and old.get(k) != v]
    if differ:
        raise ValueError(f"the run to resume differs in {', '.join(differ)}")
    expected = pending(prompts, names, None)
    count = 0
    if done is not None:
        require(done.join(expected.select(*RESPONSE_KEY), RESPONSE_KEY, "left_anti").select(*RESPONSE_KEY, F.lit("response outside this run").alias("rule")))
        require(repeated(done, RESPONSE_KEY, "repeated response"))
        count = done.count()
        if old is not None and old.get("completed_response_count", 0) > count:
            raise ValueError("the manifest counts responses that are not stored")
    now = lambda: datetime.now(UTC).isoformat()
    manifest = fixed | {"created_at_utc": old["created_at_utc"] if old else now()}
    note = lambda **more: _write_manifest(spark, beside, manifest | {"completed_response_count": count, "complete": count == fixed["expected_response_count"], "updated_at_utc": now(), **more})
    note()
    left, run = fixed["expected_response_count"] - count, uuid.uuid4().hex
    batches = -(-left // batch)
    todo, kept = f"{store}/todo/run={run}", pending(prompts, names, done).withColumn("part", F.pmod(F.xxhash64(*RESPONSE_KEY), F.lit(max(batches, 1))).cast("int"))
    kept.repartition("part").write.partitionBy("part").parquet(todo)
    pairs = spark.read.schema("dataset_item_id string, model_name string, prompt string, part int").parquet(todo)
    for k in range(batches):
        path = f"{store}/responses/run={run}/batch={k}"
        store_answers(pairs.where(F.col("part") == k), adapters, path, at_once)
        part = spark.read.schema(STORED).parquet(path)
        count += part.where(F.col("error").isNull()).select(*RESPONSE_KEY).distinct().count()
        failed = part.where(F.col("error").isNotNull()).orderBy(*RESPONSE_KEY).limit(1).collect()
        if failed:
            last = {"model_name": failed[0].model_name, "dataset_item_id": failed[0].dataset_item_id, "error_type": failed[0].error, "occurred_at_utc": failed[0].generated_at_utc}
            note(last_error=last)
            raise GenerationError(f"{failed[0].error} for {failed[0].model_name} on {failed[0].dataset_item_id}")
        note()
    return _read_manifest(spark, beside)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _read_manifest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if _exists(spark, path) else None


def _write_manifest(spark: SparkSession, path: str, value: dict[str, Any]) -> None:
    """Written beside its place and renamed over it, so that readers see the old one or the new."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    place, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = place.getFileSystem(conf).create(part, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    over[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf).rename(part, place, over)

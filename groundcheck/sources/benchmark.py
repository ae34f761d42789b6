"""The benchmark: prompts, trusted passages, hashes and its freeze manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundcheck.operators import rules
from groundcheck.operators.ranks import numbered
from groundcheck.schema import EVIDENCE, PROMPTS
from groundcheck.session import cut
from groundcheck.sources import files
from groundcheck.sources.jsonl import read_lines, strict

MANIFEST = "benchmark_manifest.json"


@dataclass(frozen=True)
class Benchmark:
    """Validated tables; passages carry ``pos``, their place in the file."""

    prompts: DataFrame
    evidence: DataFrame
    prompt_sha256: str
    evidence_sha256: str
    is_frozen: bool


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Records of a JSON Lines file with ``record``, their number; a bad line is an error."""
    lines = read_lines(spark, path)
    message = F.concat(F.lit(f"{path}: "), F.coalesce("error", F.lit("wrong type")), F.lit(" on line "), F.col("line").cast("string"))
    rows = lines.select("record", F.when(F.col("error").isNull(), strict(F.col("value"), schema)).alias("r"), message.alias("message"))
    checked = rows.select("record", F.coalesce("r", F.raise_error(F.col("message")).cast(schema)).alias("r"))
    return checked.select("record", "r.*")


def scan_table(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """The good records of a JSON Lines file, and ``line, error`` of all others, blank lines included."""
    lines = read_lines(spark, path, blank_is_error=True)
    rows = lines.select("line", "record", "error", F.when(F.col("error").isNull(), strict(F.col("value"), schema)).alias("r"))
    good = rows.where(F.col("r").isNotNull()).select("record", "r.*")
    return good, rows.where(F.col("r").isNull()).select("line", F.coalesce("error", F.lit("wrong type")).alias("error"))


def load_benchmark(spark: SparkSession, prompts: str, evidence: str, max_items: int | None = None) -> Benchmark:
    """Read and check everything, then keep the first ``max_items`` prompts."""
    if max_items is not None and max_items < 1:
        raise ValueError("max_items must be at least 1")
    p, e = cut(read_table(spark, prompts, PROMPTS)), cut(read_table(spark, evidence, EVIDENCE))  # parsed once for all checks
    rules.require(rules.benchmark_violations(p, e))
    hashes = files.sha256(prompts), files.sha256(evidence)
    frozen = check_freeze(prompts, evidence, hashes)
    if max_items is not None:
        p = p.orderBy("record").limit(max_items)
    return Benchmark(p, e.withColumn("pos", F.col("record").cast("long")), *hashes, frozen)


def check_freeze(prompts: str, evidence: str, hashes: tuple[str, str]) -> bool:
    """Whether a manifest lies beside the prompts; if so both hashes must be its own."""
    place = Path(prompts).parent / MANIFEST
    if not place.exists():
        return False
    named = files.read_object(place).get("files")
    for path, digest in zip((prompts, evidence), hashes):
        if not isinstance(named, dict) or named.get(Path(path).name) != digest:
            raise ValueError(f"{Path(path).name} differs from the freeze manifest")
    return True


def freeze(spark: SparkSession, prompts: str, evidence: str, dataset: str, domain: str, hosts: dict[str, tuple[str, ...]], **counts: Any) -> list[dict[str, str]]:
    """Write the freeze manifest if no rule is broken; returns all that is broken, bad lines first.

    No line may be blank, and each must hold an object of proper types; the other
    rules are checked on the lines that do.
    """
    (p, bad_p), (e, bad_e) = scan_table(spark, prompts, PROMPTS), scan_table(spark, evidence, EVIDENCE)
    found = [{"table": t, "id": str(r.line), "rule": r.error} for t, bad in (("prompts", bad_p), ("evidence", bad_e)) for r in bad.orderBy("line").collect()]
    found += [r.asDict() for r in rules.freeze_violations(p, e, domain, hosts, **counts).orderBy("table", "id", "rule").collect()]
    if not found:
        n = p.agg(F.count("*").alias("prompts"), F.count_distinct("topic").alias("topics")).first()
        hashes = {Path(x).name: files.sha256(x) for x in (prompts, evidence)}
        files.write_object(Path(prompts).parent / MANIFEST, {"schema_version": 1, "dataset": dataset, "frozen_at_utc": datetime.now(UTC).isoformat(), "prompt_count": n.prompts, "evidence_count": e.count(), "topic_count": n.topics, "files": hashes})
    return found


def evidence_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of passages; blank or repeated ones are errors."""
    rows = cut(read_table(spark, path, EVIDENCE).select("evidence_id"))
    rules.require(rules.violations(rows, [rules.Rule("evidence_id is blank", rules.is_blank(F.col("evidence_id")))], ["evidence_id"]))
    rules.require(rules.repeated(rows, ["evidence_id"], "repeated id"))
    return rows


def prompt_topics(spark: SparkSession, path: str) -> DataFrame:
    """Item ids and topics; repeated ids are errors."""
    rows = read_table(spark, path, PROMPTS).select("dataset_item_id", "topic")
    rules.require(rules.repeated(rows, ["dataset_item_id"], "repeated id"))
    return rows


def write_responses(rows: DataFrame, path: str) -> None:
    """A response store as one JSON Lines file, ASCII only, in order of item and model.

    The rows pass through the driver to the file, one partition at a time; a large
    store is written as Parquet instead (:func:`groundcheck.plans.generate.run_generation`).
    """
    ordered = rows.select("model_name", "dataset_item_id", "text", "confidence").orderBy("dataset_item_id", "model_name")
    with files.atomic(path) as f:
        for r in ordered.toLocalIterator():
            f.write(json.dumps(r.asDict(), ensure_ascii=True) + "\n")


def first_seen(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Distinct values in the order of their first row."""
    return numbered(rows.groupBy(name).agg(F.min(order).alias("first")), ["first", name]).drop("first")

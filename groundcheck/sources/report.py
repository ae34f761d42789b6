"""Evaluation reports: one nested JSON document, written and read without gathering it, and tables made of it."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from groundcheck.operators import report, rules
from groundcheck.schema import CLAIM_KEY, REPORT
from groundcheck.sources import document, files

ARRAYS = ("dataset_item_ids", "responses", "model_metrics", "paired_comparisons")
VERSION = 1


def to_json_lines(responses: DataFrame) -> DataFrame:
    """A JSON line per nested response; nulls are kept."""
    return responses.select(F.to_json(F.struct(*responses.columns), {"ignoreNullFields": "false"}).alias("value"))


def from_json(lines: DataFrame, schema: T.StructType) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def load_report(source: str | bytes | dict[str, Any]) -> dict[str, Any]:
    """A small report as a dict; its version and four arrays are checked."""
    if isinstance(source, bytes):
        try:
            source = source.decode()
        except UnicodeDecodeError as error:
            raise ValueError("a report must be UTF-8 JSON") from error
    if isinstance(source, str):
        try:
            source = json.loads(source)
        except json.JSONDecodeError as error:
            raise ValueError(f"invalid report JSON: {error.msg}") from error
    if not isinstance(source, dict):
        raise ValueError("a report must be a JSON object")
    if source.get("schema_version") != VERSION:
        raise ValueError("unsupported or missing schema_version")
    for name in ARRAYS:
        if not isinstance(source.get(name), list):
            raise ValueError(f"report field {name!r} must be an array")
    return source


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The responses of a report file, each as a row with an array ``responses`` of that one.

    The file is read in splits, in one line or many; only one response is ever
    held.  Its version and arrays are checked first.
    """
    found = document.elements(spark, path)
    named = F.col("name").isin("schema_version", *ARRAYS) & (F.col("place") == 0)
    version = F.when(F.col("name") == "schema_version", F.col("value"))
    fields = {r.name: r for r in found.where(named).select("name", "array", version.alias("value")).collect()}
    if "schema_version" not in fields or fields["schema_version"].value != str(VERSION) or any(n not in fields or not fields[n].array for n in ARRAYS):
        raise ValueError("not an evaluation report")
    kind = schema["responses"].dataType
    rows = found.where((F.col("name") == "responses") & (F.col("value") != ""))
    return rows.select(F.array(F.from_json("value", kind.elementType, {"mode": "FAILFAST"})).cast(kind).alias("responses"))


def write_document(path: str | Path, head: dict[str, Any], arrays: dict[str, DataFrame]) -> dict[str, int]:
    """``head`` and then arrays of objects or, of tables with one column, of values; returns their lengths.

    Rows pass through the driver to the file, one partition at a time.
    """
    counts = {}
    with files.atomic(path) as f:
        f.write(json.dumps(head, ensure_ascii=False)[:-1])
        for name, rows in arrays.items():
            f.write(f',\n"{name}": [')
            counts[name] = 0
            for r in rows.toLocalIterator():
                f.write((",\n" if counts[name] else "\n") + json.dumps(r[0] if len(rows.columns) == 1 else r.asDict(recursive=True), ensure_ascii=False))
                counts[name] += 1
            f.write("]")
        f.write("}\n")
    return counts


def report_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row per claim of a saved report, with its scores and ``hits``; blank and repeated claim keys are errors."""
    flat = report.flatten_claims(read_report(spark, path, REPORT))
    rules.require(rules.violations(flat, [rules.Rule(f"{k} is blank", rules.is_blank(F.col(k))) for k in CLAIM_KEY], CLAIM_KEY))
    rules.require(rules.repeated(flat, CLAIM_KEY, "repeated claim key"))
    hits = F.transform("evidence_ids", lambda e, k: F.struct(e.alias("evidence_id"), (k + 1).alias("rank")))
    return flat.select(*CLAIM_KEY, "claim_text", F.col("verification_label").alias("label"), "severity", "similarity", "support_score", "contradiction_score", hits.alias("hits"))


# The columns of the claim table, in order.
CLAIM_FIELDS = (
    "model_name", "dataset_item_id", "claim_id", "claim_start", "claim_end", "response_text", "claim_text", "verification_label", "severity", "similarity", "support_score", "contradiction_score",
    "verification_reason", "severity_reason", "evidence_ids",
)


def write_claims(flat: DataFrame, path: str | Path, models: Iterable[str] | None = None, items: Iterable[str] | None = None) -> int:
    """The claims of some models and items (all) as CSV, in order of their keys; returns how many there are."""
    for name, chosen in (("model_name", models), ("dataset_item_id", items)):
        if chosen is not None:
            flat = flat.where(F.col(name).isin(*chosen))
    count = 0
    with files.atomic(path) as f:
        out = csv.writer(f)
        out.writerow(CLAIM_FIELDS)
        for r in flat.select(*CLAIM_FIELDS).orderBy(*CLAIM_KEY).toLocalIterator():
            out.writerow([json.dumps(v, ensure_ascii=False) if isinstance(v, list) else v for v in r])
            count += 1
    return count

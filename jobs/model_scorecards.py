"""Score every model's answers against trusted passages, and compare the models.

    python -m jobs.model_scorecards --responses PATH --passages PATH --gold PATH --output PATH

Three Parquet tables under the output, each partitioned by model:

* ``facts``, a line for each claim with its passages, label and severity,
* ``marks``, for each model a fingerprint of what its facts were made of:
  answers, passages and settings,
* ``scorecards``, a line for each model: rates, severities, agreement with gold
  labels, and how many models it does better and worse than on shared items.

A run computes the facts of models whose fingerprint is not the one marked, and
of no others; a new model costs its own partition.  Facts are replaced by
partition and marked afterwards, so a run that dies leaves models unmarked that
the next one computes again, and a run without anything new leaves the same
tables.  Facts name their fingerprint; those of older answers are never read.
"""

from __future__ import annotations

import json
import logging
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from groundcheck.operators import compare, metrics, retrieval, verification
from groundcheck.plans.fixtures import extract
from groundcheck.schema import RESPONSE_KEY, SEVERITIES, struct
from groundcheck.session import cut, spread
from jobs._common import columns, command, read

LOG = logging.getLogger("jobs.model_scorecards")

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()
FACTS = struct(dataset_item_id=_S, claim_id=_S, claim_text=_S, evidence_ids=T.ArrayType(_S), similarity=_D, label=_S, severity=_S, risk_domains=T.ArrayType(_S), fingerprint=_S, model_name=_S)
MARKS = struct(fingerprint=_S, responses=_L, model_name=_S)
CARDS = struct(responses=_L, claims=_L, supported=_L, mild=_L, moderate=_L, severe=_L, critical=_L, better_than=_L, worse_than=_L, supported_rate=_D, mean_similarity=_D, gold_accuracy=_D, model_name=_S)


def _digest(*names: str) -> list:
    """Sums over rows that hang neither on their order nor on how they are spread, and tell repeated rows."""
    one, other = F.xxhash64(*names), F.xxhash64(F.lit("other"), *names)
    return [F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("sum"), F.bit_xor(other).alias("xor"), F.sum(other.cast("decimal(38,0)")).alias("sum_2")]


def fingerprints(responses: DataFrame, passages: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """``model_name, fingerprint, responses`` from one pass over the answers."""
    text = lambda *c: F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in c))
    sums = ("n", "sum", "xor", "sum_2")
    known = passages.agg(*_digest("pos", "evidence_id", "text")).select(text(*sums).alias("passages"))
    rows = responses.groupBy("model_name").agg(*_digest("dataset_item_id", "text")).crossJoin(F.broadcast(known))  # one row
    return rows.select(F.sha2(F.concat_ws("|", text(*sums), "passages", F.lit(json.dumps(settings, sort_keys=True))), 256).alias("fingerprint"), F.col("n").alias("responses"), "model_name")


def facts_of(responses: DataFrame, passages: DataFrame, top_k: int, threshold: float) -> DataFrame:
    """A line for each claim: passages by BM25, overlap, label and severity; narrow."""
    ranked = retrieval.rank_passages(extract(responses), passages, retrieval.bm25_postings(passages), top_k, lexical=1.0, dense=0.0, overlap=True)
    judged = verification.baseline_verify(ranked, threshold).withColumn("contradiction_score", F.lit(0.0))
    return verification.assess_severity(judged).withColumn("evidence_ids", F.col("hits.evidence_id"))


def _replace(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", "model_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_name").parquet(path)


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, made without lines if there is none."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy("model_name").parquet(path)
    return spark.read.schema(schema).parquet(path)


def scorecards(facts: DataFrame, responses: DataFrame, gold: DataFrame) -> DataFrame:
    """A line for each model."""
    claims = facts.groupBy("model_name").agg(
        F.count("*").alias("claims"),
        F.count_if(F.col("label") == "supported").alias("supported"),
        F.avg("similarity").alias("mean_similarity"),
        *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES),
    )
    sizes = responses.groupBy("model_name").agg(F.count("*").alias("responses"))
    agreed = metrics.accuracy(facts.select(*RESPONSE_KEY, F.col("label").alias("predicted")).join(gold, RESPONSE_KEY), ["model_name"])
    pairs = compare.paired_comparison(compare.paired_outcomes(compare.item_outcomes(facts, responses)))
    ahead = F.round("mean_difference", 9)
    sides = pairs.select(F.col("model_a").alias("model_name"), ahead.alias("d")).unionByName(pairs.select(F.col("model_b").alias("model_name"), (-ahead).alias("d")))
    duels = sides.groupBy("model_name").agg(F.count_if(F.col("d") > 0).alias("better_than"), F.count_if(F.col("d") < 0).alias("worse_than"))
    counts = ["claims", "supported", *SEVERITIES, "better_than", "worse_than"]
    out = sizes.join(claims, "model_name", "left").join(agreed, "model_name", "left").join(duels, "model_name", "left").fillna(0, counts)
    rate = F.try_divide(F.col("supported").cast("double"), F.col("claims"))
    return out.select("responses", *counts, F.round(rate, 9).alias("supported_rate"), F.round("mean_similarity", 9).alias("mean_similarity"), F.round("verification_accuracy", 9).alias("gold_accuracy"), "model_name")


def run(spark: SparkSession, responses: str, passages: str, gold: str, output: str, config: dict[str, Any]) -> dict[str, int]:
    """Bring facts, marks and scorecards up to date; counts of models, computed ones and claims written.

    Answers without text, or with a blank one, count as responses and make no
    claims; those without model or item are passed over.  Gold labels that are null or of no answer are passed over.  A model
    that has left the table leaves the scorecards; its facts stay unread.
    """
    answers = spread(columns(read(spark, responses), config["responses"]).where("model_name is not null and dataset_item_id is not null"))
    evidence = columns(read(spark, passages), config["passages"])
    settings = {k: config[k] for k in ("responses", "passages", "top_k", "support_threshold")}
    now = cut(fingerprints(answers, evidence, settings))
    todo = cut(now.join(_table(spark, f"{output}/marks", MARKS), ["model_name", "fingerprint"], "left_anti"))
    models, new = now.count(), todo.count()
    _table(spark, f"{output}/facts", FACTS)
    counts = {"models": models, "computed": new, "responses": 0, "claims": 0}
    if new:
        rows = answers.join(F.broadcast(todo.select("model_name", "fingerprint")), "model_name")  # a line for each model
        _replace(facts_of(rows, evidence, config["top_k"], config["support_threshold"]).select(*FACTS.names), f"{output}/facts")
        _replace(todo.select(*MARKS.names), f"{output}/marks")
        made = spark.read.schema(FACTS).parquet(f"{output}/facts").join(F.broadcast(todo), ["model_name", "fingerprint"], "left_semi")
        counts |= {"responses": todo.agg(F.sum("responses")).first()[0], "claims": made.count()}
    kept = spark.read.schema(FACTS).parquet(f"{output}/facts").join(F.broadcast(now.select("model_name", "fingerprint")), ["model_name", "fingerprint"], "left_semi")
    labels = columns(read(spark, gold), config["gold"]).where("gold_label is not null")
    cards = scorecards(kept, answers.select(*RESPONSE_KEY), labels)
    cards.coalesce(1).write.mode("overwrite").partitionBy("model_name").parquet(f"{output}/scorecards")  # a line for each model
    LOG.info("read %d models' answers of %s, of which %d are new: %d answers; wrote %d claims and %d scorecards to %s", models, responses, new, counts["responses"], counts["claims"], models, output)
    return counts


def read_scorecards(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(CARDS).parquet(f"{output}/scorecards")


PATHS = {"responses": "Parquet table of answers", "passages": "Parquet table of trusted passages", "gold": "Parquet table of gold labels", "output": "folder of facts, marks and scorecards"}

if __name__ == "__main__":
    command("model_scorecards", __doc__, PATHS, run, str(Path(__file__).with_suffix(".json")))

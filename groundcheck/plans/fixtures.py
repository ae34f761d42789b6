"""Deterministic evaluation inputs over the test tables.

The tables hold no model answers, so the documents of each source play one
model's responses, all of them, ``benchmark`` the trusted passages and ``labels`` the gold
labels; probabilities of entailment are drawn from md5.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundcheck.functions import text as X
from groundcheck.operators import retrieval, trust as trust_op, verification as V
from groundcheck.schema import CLAIM_KEY, LABELS, RESPONSE_KEY, SEVERITIES
from groundcheck.session import spread

SOURCES = 20
TOP_K = 5
# With the drawn probabilities these give all labels and severities.
SUPPORT = CONTRADICTION = 0.20
HIGH = 0.30


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    confidence = F.when(d % 7 != 0, ((d * 37) % 101) / 100)
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return spread(rows).select(
        "doc_id", F.concat(F.lit("model-"), (d % SOURCES).cast("string")).alias("model_name"), item_id((d - d % SOURCES) / SOURCES).alias("dataset_item_id"), "text", confidence.alias("confidence")
    )


def padded(number: Column, width: int) -> Column:
    """The number with zeros before it; one of more digits than ``width`` is kept whole, which lpad would cut."""
    digits = number.cast("long").cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0")


def item_id(number: Column) -> Column:
    return F.concat(F.lit("item-"), padded(number, 6))


def item_number() -> Column:
    """The number of ``dataset_item_id``: all that follows ``item-``."""
    return F.col("dataset_item_id").substr(F.lit(6), F.length("dataset_item_id")).cast("long")


def items(spark: SparkSession, sf: str) -> DataFrame:
    number = item_number()
    return responses(spark, sf).select("dataset_item_id").distinct().withColumn("topic", F.concat(F.lit("topic-"), (number % 10).cast("string")))


def evidence_id(number: Column) -> Column:
    return F.concat(F.lit("ev-"), padded(number, 4))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), evidence_id(F.col("item_id")).alias("evidence_id"), "text", F.lit("").alias("source"), F.concat(F.lit("topic-"), (F.col("item_id") % 10).cast("string")).alias("topic"))


def claims(spark: SparkSession, sf: str) -> DataFrame:
    return extract(responses(spark, sf))


def extract(rows: DataFrame) -> DataFrame:
    """One row per claim of every response, numbered from 1."""
    out = rows.select(*(c for c in rows.columns if c != "text"), F.posexplode(X.claims(F.col("text"))).alias("ordinal", "c"))
    return out.select(*(c for c in out.columns if c not in ("ordinal", "c")), (F.col("ordinal") + 1).alias("ordinal"), F.concat(F.lit("claim-"), (F.col("ordinal") + 1).cast("string")).alias("claim_id"), "c.*")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("vector"))


def with_vectors(rows: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    count = table(spark, sf, "embeddings").agg(F.count("*").alias("vectors"))
    at = rows.crossJoin(F.broadcast(count)).withColumn("pos", (F.col("doc_id") * 31 + F.col("ordinal")) % F.col("vectors")).drop("vectors")  # one row
    return at.join(vectors(spark, sf).hint("shuffle_hash"), "pos").drop("pos")  # vectors are the smaller side: claims are not sorted to meet them


def labelled_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of responses with gold labels, all that a result over gold claims needs."""
    return extract(responses(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"))


def ranked(spark: SparkSession, sf: str, made: DataFrame | None = None) -> DataFrame:
    """Claims, all unless given, with their hits by BM25 and vectors."""
    passages = evidence(spark, sf)
    found = vectors(spark, sf).join(F.broadcast(passages.select("pos")), "pos", "left_semi")  # passages are the bounded side
    rows = with_vectors(claims(spark, sf) if made is None else made, spark, sf)
    return retrieval.rank_passages(rows, passages, retrieval.bm25_postings(passages), TOP_K, claim_vector=F.col("vector"), vectors=found, without=("vector",))


def drawn_nli(claim: Column, ids: Column) -> Column:
    """Of each passage three probabilities, from eight hex digits each of the md5 of ``claim|id``."""
    return F.arrow_udf(_drawn, "array<struct<entailment:double,contradiction:double,neutral:double>>")(claim, ids)


def _drawn(claim: pa.Array, ids: pa.Array) -> pa.Array:
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    keys, digests, at = ids.flatten().to_pylist(), [], 0
    for own, n in zip(claim.to_pylist(), sizes.tolist()):
        digests += (md5(f"{own}|{key}".encode()).digest() for key in keys[at : at + n])
        at += n
    words = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4)[:, :3].astype(np.float64) + 1
    shares = words / (words[:, 0] + words[:, 1] + words[:, 2])[:, None]
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(shares[:, k])) for k in range(3)], names=["entailment", "contradiction", "neutral"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def scored(spark: SparkSession, sf: str, made: DataFrame | None = None) -> DataFrame:
    rows = ranked(spark, sf, made).withColumn("drawn", drawn_nli(F.concat_ws("|", *CLAIM_KEY), F.col("hits.evidence_id")))
    nli = lambda h: F.get(F.col("drawn"), h["rank"] - 1)
    return rows.withColumn("evidence_scores", V.evidence_scores(F.col("hits"), lambda h: h["embedding_score"], nli)).drop("drawn")


def facts(spark: SparkSession, sf: str, made: DataFrame | None = None) -> DataFrame:
    """One row per claim, all unless given, with its hits, scores, label, severity and reasons; no shuffle but the vectors' join."""
    return V.assess_severity(V.verify(scored(spark, sf, made), SUPPORT, CONTRADICTION), HIGH)


def consistency(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return responses(spark, sf).where(d % 5 != 0).select(*RESPONSE_KEY, (((d * 13) % 101) / 100).alias("consistency_score"))


def trust(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return trust_op.trust_scores(rows if rows is not None else facts(spark, sf), consistency(spark, sf))


def gold(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """``CLAIM_KEY, gold_label, gold_severity, evidence_ids`` of claims of labelled documents, and other columns of the claims.

    Documents meet their labels before claims are made of them.
    """
    count = evidence(spark, sf).agg(F.count("*").alias("passages"))
    both = extract(responses(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")).crossJoin(F.broadcast(count))
    label = F.when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 1, "supported").otherwise("unknown")
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", *CLAIM_KEY)), 1, 8), 16, 10).cast("long") % 4
    level = F.when(label != "supported", F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), (drawn + 1).cast("int")))
    ids = F.array_distinct(F.array(evidence_id(F.col("doc_id") % F.col("passages")), evidence_id((F.col("doc_id") * 3 + F.col("ordinal")) % F.col("passages"))))
    return both.select(*CLAIM_KEY, *keep, label.alias("gold_label"), level.alias("gold_severity"), ids.alias("evidence_ids"))


def annotator_b(gold_: DataFrame) -> DataFrame:
    """The gold labels, turned on by one where md5 mod 5 is 0."""
    names = F.array(*(F.lit(k) for k in LABELS))
    turn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("b"), *CLAIM_KEY)), 1, 8), 16, 10).cast("long") % 5 == 0
    place = F.array_position(names, F.col("gold_label")).cast("int")
    return gold_.select(*CLAIM_KEY, F.when(turn, F.element_at(names, place % 3 + 1)).otherwise(F.col("gold_label")).alias("label"))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """One prompt per item with two references; some refer to a passage of another topic or to none."""
    number = item_number()
    count = evidence(spark, sf).agg(F.count("*").alias("passages"))
    rows = items(spark, sf).crossJoin(F.broadcast(count))
    refs = F.array(evidence_id(number % F.col("passages")), evidence_id(F.when(number % 11 == 0, F.greatest(F.lit(9999), F.col("passages"))).otherwise((number * 7) % F.col("passages"))))
    return rows.select("dataset_item_id", "topic", F.concat(F.lit("Question "), number.cast("string")).alias("prompt"), refs.alias("reference_evidence_ids"))

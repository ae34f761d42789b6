"""A training-corpus pipeline of five operators.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``, any others that the table has included.  Texts of
any length are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from groundcheck.llm._shared import materialize, without
from groundcheck.llm.decontaminate import find_contamination
from groundcheck.llm.exact_dedup import exact_dedup
from groundcheck.llm.language_id import UNDETERMINED, fit_language_id, has_letter, held_out, predict_language
from groundcheck.llm.sentencepiece_codec import sentencepiece_encode
from groundcheck.llm.simhash import simhash_components


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; those without text or without a letter go.

    That is all that is rejected: every text with a letter is given the likeliest
    of the languages learned, and a low score rejects nothing, so letter noise
    and languages not learned stay.  Where no training row has a language, there
    is no network and the same rule holds.  Each row is judged by its text alone,
    so equal rows, equal ids and null ids make no difference.
    """
    net = fit_language_id(docs.where(~held_out()))
    if not net.langs:
        return docs.where(F.udf(lambda t: has_letter(t), T.BooleanType())("text"))
    return predict_language(docs, net).where(F.col("lang_pred") != UNDETERMINED).select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z in lower case) the one with the largest id.

    A null text equals an empty one; a null id is below all others.  Of rows that
    share an id but not the text each is judged by its text; rows repeated whole
    are one document and stay or go together.
    """
    gone = exact_dedup(docs).where(~F.col("kept")).select("id", F.unhex("text_sha256").alias("digest")).distinct()
    text = F.translate(F.coalesce(docs.text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return without(docs, gone, lambda g: docs.doc_id.eqNullSafe(g.id) & (F.unhex(F.sha2(text, 256)) == g.digest))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id, a null one before all others.

    Texts without words are near duplicates of each other.  Of rows that share an
    id but not the text each is judged by its text; rows repeated whole are one
    document and stay or go together.
    """
    found = simhash_components(docs)
    gone = found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "text_hash").distinct()
    return without(docs, gone, lambda g: docs.doc_id.eqNullSafe(g.id) & (F.xxhash64(docs.text) == g.text_hash))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; each row is judged by its text alone, a null one has no words and stays."""
    return find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select("row.*")


def _tokens(e) -> tuple:
    import numpy as np

    return len(e.ids), e.ids.astype(np.int32), e.begin.astype(np.int32), e.end.astype(np.int32), e.decoded


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their text, the byte span of each, and the text that the ids decode to.

    A null text counts as empty: begin and end id and an empty decoded text.  No
    row goes.  The new columns are in a struct ``pieces`` if ``documents`` has a
    column of one of their names.
    """
    import public_tokenizers

    ints = T.ArrayType(T.IntegerType())
    kinds = T.StructType([T.StructField("n_tokens", T.LongType()), *(T.StructField(c, ints) for c in ("ids", "begin", "end")), T.StructField("decoded", T.StringType())])
    found = sentencepiece_encode(docs, public_tokenizers.path("piece_bpe_32k.model"), derive=_tokens, schema=kinds)
    if {c.lower() for c in docs.columns} & set(kinds.names):
        return found.select("row.*", F.struct(*kinds.names).alias("pieces"))
    return found.select("row.*", *kinds.names)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: No SQL: a trained network, fingerprints and a tokenizer decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs

"""Vectors by content: a Parquet table of the SHA-256 of a text and its vector, a partition a model.

A text is encoded once, wherever and however often it occurs, and not at all if an
earlier run has encoded it with the same model.  A model whose vectors change needs
a new name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundcheck.functions import models

SCHEMA = "digest string, vector array<double>, model string"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def read_vectors(spark: SparkSession, store: str, model: str) -> DataFrame:
    """``digest, vector`` of one model; its partition alone is read.  Of vectors that two runs at once added for a text, one."""
    return spark.read.schema(SCHEMA).parquet(store).where(F.col("model") == model).select("digest", "vector").dropDuplicates(["digest"])


def encode_missing(texts: DataFrame, embedder: Callable[[], models.Embedder], store: str, model: str) -> DataFrame:
    """:func:`read_vectors`, after those of ``texts`` (a column ``text``) that the store lacks were encoded and added.

    Null texts have no vector.  What is missing is dealt out over all cores, as
    encoding is dear and texts are short.  The files are added when the job ends,
    so one that fails adds nothing and can be run again.
    """
    spark = texts.sparkSession
    spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("model").parquet(store)
    wanted = texts.where(F.col("text").isNotNull()).groupBy(digest(F.col("text")).alias("digest")).agg(F.first("text").alias("text"))
    lacking = wanted.join(read_vectors(spark, store, model).select("digest"), "digest", "left_anti").repartition(spark.sparkContext.defaultParallelism)
    added = lacking.select("digest", models.embedding_udf(embedder)("text").alias("vector"), F.lit(model).alias("model"))
    added.write.mode("append").partitionBy("model").parquet(store)
    return read_vectors(spark, store, model)

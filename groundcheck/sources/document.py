"""Large JSON documents, read in parts over the cluster.

A document is split at every comma, so that Spark reads it in byte ranges as it
reads lines, however it is laid out, in one line too.  Commas occur within
strings, so what a piece does depends on what came before it: whether it begins
within a string, and how deep.  A split's effect is small, the number of its
quotes and the change of depth for either beginning, and splits are brought
together by running sums over these few numbers.  Where a comma stands at depth
one a field of the document ends, at depth two an element of a field's array;
pieces meet again by element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, at, value`` of every piece; ``at`` orders the pieces of a split."""
    raw = spark.read.option("lineSep", ",").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def _depth(parts: Column, within: int) -> Column:
    """What a piece adds to the depth, if it begins within a string (1) or not (0)."""
    plain = F.array_join(F.filter(parts, lambda _, i: i % 2 == within), "")
    count = lambda signs: F.length(plain) - F.length(F.translate(plain, signs, ""))
    return count("{[") - count("}]")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, name, array, place, value``: a line for each element of the arrays of a document, and for each other field.

    Every file at ``path`` is a document, an object.  Values are the text as it
    stands and are not checked to be JSON; the one of an empty array is empty.
    """
    rows = _pieces(spark, path)
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # no escaped quotes
    parts = F.split(bare, '"', -1)
    rows = rows.select("file", "start", "at", "value", (F.size(parts) - 1).alias("quotes"), _depth(parts, 0).alias("out"), _depth(parts, 1).alias("in"))
    split = Window.partitionBy("file", "start").orderBy("at")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.withColumn("odd", zero(F.sum("quotes").over(before)) % 2)  # begins within a string, if the split does not
    pick = lambda within: F.when(F.col("odd") == within, F.col("out")).otherwise(F.col("in"))
    rows = rows.select("file", "start", "at", "value", "quotes", "odd", pick(0).alias("d0"), pick(1).alias("d1"))

    # a line for each split: what it does from outside and from within a string
    effect = rows.groupBy("file", "start").agg(F.sum("quotes").alias("quotes"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    whole = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # of splits, some numbers each
    effect = effect.withColumn("within", zero(F.sum("quotes").over(whole)) % 2)
    effect = effect.withColumn("change", F.when(F.col("within") == 0, F.col("d0")).otherwise(F.col("d1")))
    effect = effect.select("file", "start", "within", zero(F.sum("change").over(whole)).alias("depth"))

    rows = rows.join(F.broadcast(effect), ["file", "start"])
    upto = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.when(F.col("within") == 0, F.col("d0")).otherwise(F.col("d1"))
    rows = rows.withColumn("after", F.col("depth") + F.sum(change).over(upto))
    rows = rows.withColumn("open", (F.col("within") + F.col("odd") + F.col("quotes")) % 2 == 1)
    ends = lambda depth: (~F.col("open") & (F.col("after") == depth)).cast("long")
    rows = rows.select("file", "start", "at", "value", ends(1).alias("field_ends"), ends(2).alias("element_ends"))
    counts = rows.groupBy("file", "start").agg(F.sum("field_ends").alias("f"), F.sum(F.col("field_ends") + F.col("element_ends")).alias("e"))
    counts = counts.select("file", "start", zero(F.sum("f").over(whole)).alias("f"), zero(F.sum("e").over(whole)).alias("e"))
    rows = rows.join(F.broadcast(counts), ["file", "start"])
    field = F.col("f") + zero(F.sum("field_ends").over(before))
    element = F.col("e") + zero(F.sum(F.col("field_ends") + F.col("element_ends")).over(before))
    rows = rows.select("file", field.alias("field"), element.alias("element"), F.struct("start", "at", "value").alias("piece"))

    joined = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["value"]), ",")
    rows = rows.groupBy("file", "element").agg(F.first("field").alias("field"), joined.alias("value"))
    # a line for each field: its first and last element, and whether the document ends with it
    bounds = rows.groupBy("file", "field").agg(F.min("element").alias("first"), F.max("element").alias("last"))
    bounds = bounds.withColumn("final", F.col("field") == F.max("field").over(Window.partitionBy("file")))
    rows = rows.join(bounds, ["file", "field"])
    head, opens = r'(?s)^\s*\{?\s*"((?:[^"\\]|\\.)*)"\s*:\s*', F.col("element") == F.col("first")
    rows = rows.withColumn("name", F.when(opens, F.regexp_extract("value", head, 1))).withColumn("value", F.when(opens, F.regexp_replace("value", head, "")).otherwise(F.col("value")))
    named = rows.where(opens).select("file", "field", "name", F.startswith(F.col("value"), F.lit("[")).alias("array"))
    rows = rows.drop("name").join(named, ["file", "field"])
    closes = F.col("element") == F.col("last")
    value = F.when(closes & F.col("final"), F.regexp_replace("value", r"\s*\}\s*$", "")).otherwise(F.col("value"))
    value = F.when(F.col("array") & closes, F.regexp_replace(value, r"\s*\]\s*$", "")).otherwise(value)
    value = F.when(F.col("array") & opens, F.substring(value, 2, 2**31 - 1)).otherwise(value)
    return rows.select("file", "name", "array", (F.col("element") - F.col("first")).alias("place"), F.regexp_replace(value, r"^\s+|\s+$", "").alias("value"))

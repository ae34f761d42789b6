"""JSON Lines sources with line numbers and strict typing.

Files are read by line and in splits, however large; a line's number is its place
in its split and the lines of the splits before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from groundcheck.functions.text import is_blank
from groundcheck.schema import RESPONSES


def scan_lines(files: DataFrame, blank_is_error: bool = False) -> DataFrame:
    """``file, line, record, value, error`` of every line of ``files`` (``file, value``: whole contents).

    ``line`` is the physical line, ``record`` counts lines that are not blank.
    Blank lines are passed over, or are errors where asked.  A line must hold a
    JSON object.
    """
    cut = F.split("value", "\n")
    lines = F.transform(cut, lambda v, i: F.struct((i + 1).alias("line"), F.regexp_replace(v, "\r$", "").alias("value")))
    # blank lines go before rows are made of them: later steps may raise, whatever order filters run in
    kept = F.filter(lines, lambda x: ~is_blank(x["value"]) | (F.lit(blank_is_error) & (x["line"] < F.size(cut))))
    rows = files.select("file", F.posexplode(kept).alias("k", "x")).select("file", "x.line", (F.col("k") + 1).alias("record"), "x.value")
    return rows.withColumn("error", F.when(is_blank(F.col("value")), "blank line").otherwise(object_error(F.col("value"))))


def object_error(value: Column) -> Column:
    """Why a line is no JSON object, or null."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    return F.when(kind.isNull(), "invalid JSON").when(~kind.startswith("OBJECT"), "not an object")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, record, value, blank`` of every line of the files at a path.

    Lines are counted by split, and those few counts added up along each file; only
    where ``record`` is asked for are lines of a split brought in order.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    split = ["file", "start"]
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("blank", F.coalesce(is_blank(F.col("value")), F.lit(True)))
    counts = rows.groupBy(*split).agg(F.min("at").alias("first"), F.count("*").alias("lines"), F.count_if(~F.col("blank")).alias("records"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*split, "first", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "records")))
    so_far = Window.partitionBy(*split).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    record = F.col("records_before") + F.sum((~F.col("blank")).cast("long")).over(so_far)
    line = F.col("at") - F.col("first") + F.col("lines_before") + 1
    return rows.join(counts, split).select("file", line.alias("line"), record.alias("record"), "value", "blank")


def read_lines(spark: SparkSession, path: str, blank_is_error: bool = False) -> DataFrame:
    """What :func:`scan_lines` gives, of the files at a path, which may be larger than a task can hold."""
    rows = numbered(spark, path)
    rows = rows if blank_is_error else rows.where(~F.col("blank"))
    error = F.when(F.col("blank"), "blank line").otherwise(object_error(F.col("value")))
    return rows.select("file", F.col("line").cast("int").alias("line"), F.col("record").cast("int").alias("record"), "value", error.alias("error"))


def strict(value: Column, schema: T.StructType) -> Column:
    """A line parsed by an explicit schema, null where a value is of another type.

    Integers must be whole JSON numbers, never booleans or decimals.
    """
    whole = F.try_parse_json(value)
    typed = F.from_json(value, schema)
    checks = F.lit(True)
    for f in schema:
        kind = F.schema_of_variant(F.try_variant_get(whole, f"$.{f.name}", "variant"))
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):
            checks = checks & F.coalesce(kind.isin("BIGINT", "VOID"), F.lit(True))
        elif isinstance(f.dataType, T.DoubleType):
            checks = checks & F.coalesce(~kind.isin("BOOLEAN", "STRING"), F.lit(True))
        elif isinstance(f.dataType, T.StringType):
            checks = checks & F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))
    return F.when(checks, typed)


def parse_responses(lines: DataFrame) -> DataFrame:
    """``line`` and the fields of a response; ``valid`` is false unless its keys are exactly those and of their types."""
    keys = F.json_object_keys("value")
    want = F.array(*(F.lit(f.name) for f in RESPONSES))
    exact = F.coalesce((F.size(keys) == len(RESPONSES)) & (F.size(F.array_intersect(keys, want)) == len(RESPONSES)), F.lit(False))
    parsed = lines.select("line", F.when(object_error(F.col("value")).isNull(), F.col("value")).alias("value"))
    rows = parsed.select("line", exact.alias("exact"), strict(F.col("value"), RESPONSES).alias("r"))
    valid = F.col("exact") & F.col("r").isNotNull()
    return rows.select("line", *(F.when(valid, F.col(f"r.{f.name}")).alias(f.name) for f in RESPONSES), valid.alias("valid"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """A response store; a bad line is an error that names it."""
    rows = parse_responses(numbered(spark, path).where(~F.col("blank")))
    message = F.concat(F.lit("Invalid response record on line "), F.col("line").cast("string"))
    return rows.where(F.when(F.col("valid"), True).otherwise(F.raise_error(message).cast("boolean"))).drop("valid", "line")
